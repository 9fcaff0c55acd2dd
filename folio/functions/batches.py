"""Arrow batches of documents in pieces of bounded text, so that a Python worker holds few of them at once, whatever a batch has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that are taken at once, unless one document has more; rows that go back at once.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 8192


def pieces(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose texts in ``column`` have PIECE_BYTES at most, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(b):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE_BYTES, "right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def text_pieces(batches: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    """The texts of an Arrow function's batches in order, as many at once as :func:`pieces` takes."""
    for texts in batches:
        for piece in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), 0):
            yield piece.column(0).to_pylist()


def map_documents(docs: DataFrame, parse: Callable[[str | None], Iterator[tuple]], schema: str, longer: int | None = None) -> DataFrame:
    """``docs`` (key, text) as rows of ``schema``: the key, and what ``parse`` makes of the text, any number of rows.

    ``longer`` is the place in a row of ``parse`` of texts that may together be longer than the document; PIECE_BYTES characters
    of them go back at once, unless one has more.
    """
    kind = StructType.fromDDL(schema)
    fields = to_arrow_schema(kind)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields, strict=True)], schema=fields)  # noqa: B905

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces(b, 1):
                rows: list[tuple] = []
                held = 0
                for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    for row in parse(text):
                        rows.append((key, *row))
                        if longer is not None:
                            held += len(row[longer])
                        if len(rows) == PIECE_ROWS or held >= PIECE_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return docs.mapInArrow(run, kind)
