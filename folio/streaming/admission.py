"""Request admission with state, as a stream and as a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, ts timestamp, source string, status string"
STATE = "pending array<string>, sources array<string>, accepted array<double>, fetched array<string>, fetched_at array<double>"


def decide(rows: pd.DataFrame, state: dict, min_interval: float, hourly: int, capacity: int) -> list[tuple]:
    """Statuses of one lane's requests in order of time; ``state`` changes along.

    In this order: fresh (fetched within ``min_interval``), queued (already pending; ``user`` upgrades the source), busy
    (the rolling hour holds ``hourly`` accepted ones, 0 meaning no limit, or the queue is full), queued. A row of
    source ``done`` says that a key was fetched. Only accepted requests count towards the hour.
    """
    out = []
    for r in rows.sort_values(["ts", "key"], kind="stable").itertuples(index=False):
        t = r.ts.timestamp()
        source = r.source if r.source in ("user", "auto", "done") else "auto"
        if source == "done":
            state["pending"].pop(r.key, None)
            state["fetched"][r.key] = t
            continue
        state["accepted"] = [a for a in state["accepted"] if a >= t - 3600]
        if r.key in state["fetched"] and t - state["fetched"][r.key] < min_interval:
            status = "fresh"
        elif r.key in state["pending"]:
            status = "queued"
            if source == "user":
                state["pending"][r.key] = "user"
        elif hourly and len(state["accepted"]) >= hourly or len(state["pending"]) >= capacity:
            status = "busy"
        else:
            status = "queued"
            state["pending"][r.key] = source
            state["accepted"].append(t)
        out.append((r.key, r.ts, source, status))
    # what was fetched too long ago to matter is forgotten
    last = max((r.ts.timestamp() for r in rows.itertuples(index=False)), default=0.0)
    state["fetched"] = {k: v for k, v in state["fetched"].items() if last - v < min_interval}
    return out


def new_state() -> dict:
    return {"pending": {}, "accepted": [], "fetched": {}}


def admit_stream(requests: DataFrame, min_interval: float = 60.0, hourly: int = 300, capacity: int = 100) -> DataFrame:
    """Statuses of a stream (lane, key, ts, source). A lane's limits are global to it, so its state has one key; lanes run apart."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = new_state()
        if held.exists:
            pending, sources, accepted, fetched, at = held.get
            state = {"pending": dict(zip(pending, sources, strict=True)), "accepted": list(accepted), "fetched": dict(zip(fetched, at, strict=True))}
        rows = pd.concat(list(batches), ignore_index=True)
        out = decide(rows, state, min_interval, hourly, capacity)
        held.update((list(state["pending"]), list(state["pending"].values()), [float(x) for x in state["accepted"]], list(state["fetched"]), [float(x) for x in state["fetched"].values()]))
        yield pd.DataFrame(out, columns=["key", "ts", "source", "status"])

    return requests.groupBy("lane").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def admit_batch(requests: DataFrame, min_interval: float = 60.0, hourly: int = 300, capacity: int = 100) -> DataFrame:
    """The same for a finished table (lane, key, ts, source)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(decide(rows, new_state(), min_interval, hourly, capacity), columns=["key", "ts", "source", "status"])

    return requests.groupBy("lane").applyInPandas(run, OUT)
