"""Operator 5: byte-level BPE encoding and decoding.

The merges are compiled into a finite-state transducer that is determinised lazily. It rests on a known
property of BPE: after each prefix of a piece exactly one vocabulary entry can be the last token, namely the
one that, put behind the last token of the remaining shorter prefix, is kept apart from it by the merges. The
prefixes thus form a tree of boundaries. A later byte can only start a token at a *live* boundary, one from
which the bytes read so far are still the beginning of some vocabulary entry. What all live boundaries have in
common is final, and is emitted: the lookahead is bounded by the longest vocabulary entry.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import give_back, small_batches

#: Bounds of what a worker remembers, and the bytes read before tokens are emitted (more where the vocabulary needs it).
MAX_STATES, MAX_PIECES, MAX_PAIRS, LOOK = 250_000, 120_000, 200_000, 48
#: Multiple of these bounds where only digests return and a worker has the room; encoded columns beside other stages have one.
ROOM = 2
#: The pairs last met, by their hash, for lookups of many at once.
PAIR_BITS = 19
#: Characters of text whose pieces are held at a time.
GROUP_CHARS = 1 << 19
#: Characters of text that are encoded and handed on at a time, unless one text has more.
PART_CHARS = 1 << 20
#: What ends at a state instead of a token: the start of the text, and nothing.
START, NONE = -1, -2
_BASE = 0x9E3779B97F4A7C15


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class MergeTransducer:
    """Tokens of one piece of text, left to right, one byte at a time."""

    def __init__(self, ranks: dict[bytes, int], room: int = 1):
        #: what it remembers at most, in multiples of the bounds above
        self.room = room
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.digits = {i: str(i) for i in self.tokens}
        self._beginnings: set[bytes] = set()
        self.longest = max(map(len, ranks), default=1)
        self.powers = np.array([pow(_BASE, n, 1 << 64) for n in range(LOOK + 1)], np.uint64)
        self.hashed = [self._hashed([t for t in ranks if len(t) == n]) for n in range(min(self.longest, LOOK) + 1)]
        self.token, self.begin, self.back, self.depth = (np.zeros(room * MAX_STATES + 1024 * LOOK, np.int32) for _ in range(4))
        self.hash = np.zeros(len(self.token), np.uint64)
        self.forget()
        self.split: dict[bytes, tuple[bytes, bytes]] = {}
        self.left_edges: dict[int, list] = {}
        self.right_edges: dict[int, list] = {}
        self.pairs: dict[int, bool] = {}
        self.pair_keys, self.pair_apart = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _hashed(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes in order, token ids) of the vocabulary entries of one length; two entries with one hash are an error."""
        h = np.zeros(len(tokens), np.uint64)
        for column in np.array([list(t) for t in tokens], np.uint64).T:
            h = h * np.uint64(_BASE) + column + np.uint64(1)
        order = np.argsort(h)
        if len(np.unique(h)) < len(h):
            raise ValueError("two vocabulary entries share a hash")
        return h[order], np.array([self.ranks[tokens[i]] for i in order], np.int64)

    @property
    def beginnings(self) -> set[bytes]:
        """What some vocabulary entry begins with; only long pieces ask."""
        if not self._beginnings:
            self._beginnings = {t[:n] for t in self.ranks for n in range(1, len(t) + 1)}
        return self._beginnings

    def edge(self, token: int, right: bool) -> list[tuple[bytes, int, int]]:
        """What stands at one end of a token while it is being merged: bytes, and the ranks at which each part comes and goes."""
        edges = self.right_edges if right else self.left_edges
        if (known := edges.get(token)) is None:
            known, data, gone = [], self.tokens[token], 1 << 60
            while True:
                born = self.ranks[data] if len(data) > 1 else -1
                known.append((data, born, gone))
                if len(data) == 1:
                    break
                data, gone = self.halves(data)[right], born
            edges[token] = known
        return known

    def halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts that the last merge of a token joins."""
        if (known := self.split.get(token)) is None:
            parts, own = [token[i : i + 1] for i in range(len(token))], self.ranks[token]
            while len(parts) > 2:
                rank, at = min((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1], own)) != own)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self.split[token] = (parts[0], parts[1])
        return known

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges leave these neighbours as they are: no merge across the gap comes while both its parts stand."""
        if left == START:
            return True
        key = left << 32 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= MAX_PAIRS:
                for known in (self.pairs, self.left_edges, self.right_edges, self.split):
                    known.clear()
            known, rank_of, starts = True, self.ranks.get, self.edge(right, False)
            for x, x_born, x_gone in self.edge(left, True):
                for y, y_born, y_gone in starts:
                    if (rank := rank_of(x + y)) is not None and x_gone > max(rank, x_born, y_born) <= y_gone:
                        known = False
                        break
                if not known:
                    break
            self.pairs[key] = known
        return known

    def all_apart(self, pairs: np.ndarray) -> np.ndarray:
        """:meth:`stay_apart` of packed pairs (left << 32 | right)."""
        slot = ((pairs.astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        apart = self.pair_apart[slot]
        if len(unknown := np.flatnonzero(self.pair_keys[slot] != pairs)):
            keys, inverse = np.unique(pairs[unknown], return_inverse=True)
            got = np.array([self.stay_apart(p >> 32, p & 0xFFFFFFFF) for p in keys.tolist()], bool)[inverse]
            apart[unknown], self.pair_keys[slot[unknown]] = got, pairs[unknown]
            self.pair_apart[slot[unknown]] = got
        return apart

    def forget(self) -> None:
        """Drop the states; they are built again as they are met.

        A state is a boundary in the bytes read since the last final one, numbered as it was met: the token that
        ends there (NONE: none does), the state where it begins, the state one byte before, the bytes since the root
        and their hash.
        """
        self.count = 0
        self.state(START, 0, -1, 0)
        self.moves: dict[int, int] = {}
        self.final: dict[int, tuple[int, ...]] = {}
        self.roots = {START: 0}

    def clear(self) -> None:
        """Forget all that texts have taught: an idle worker holds the vocabulary alone."""
        self.forget()
        for known in (self.split, self.left_edges, self.right_edges, self.pairs, self.pieces, self.older, self._beginnings):
            known.clear()
        give_back()

    def state(self, token: int, begin: int, back: int, depth: int, hash_: int = 0) -> int:
        at, self.count = self.count, self.count + 1
        if at >= len(self.token):  # one piece alone may need more than all others
            for name in ("token", "begin", "back", "depth", "hash"):
                setattr(self, name, np.concatenate((old := getattr(self, name), np.zeros_like(old))))
        self.token[at], self.begin[at], self.back[at], self.depth[at], self.hash[at] = token, begin, back, depth, hash_
        return at

    def tokens_since(self, root: int, state: int) -> tuple[int, ...]:
        out = []
        while state != root:
            out.append(int(self.token[state]))
            state = int(self.begin[state])
        out.reverse()
        return tuple(out)

    def grow(self, state: int, data: bytes) -> int:
        """The state after the last byte of data, which holds all bytes since the root."""
        begin, n = state, len(data)
        hash_ = (int(self.hash[state]) * _BASE + data[-1] + 1) & ((1 << 64) - 1)
        for j in range(n - 1, max(-1, n - 1 - self.longest), -1):
            if (token := self.ranks.get(data[j:])) is not None and (left := int(self.token[begin])) != NONE and self.stay_apart(left, token):
                return self.state(token, begin, state, n, hash_)
            begin = int(self.back[begin])
        return self.state(NONE, -1, state, n, hash_)

    def grow_all(self, states: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte each, for distinct (state, byte) below LOOK bytes from the start; all in step.

        Strings are looked up by a 64-bit hash among the vocabulary entries of their length.
        """
        n, new = len(states), np.arange(self.count, self.count + len(states))
        self.count += n
        hashes = self.hash[states] * np.uint64(_BASE) + byte.astype(np.uint64) + np.uint64(1)
        self.token[new], self.begin[new], self.back[new], self.depth[new], self.hash[new] = NONE, -1, states, self.depth[states] + 1, hashes
        todo, boundary, length = np.arange(n), states.astype(np.int64), 1
        while len(todo) and length < len(self.hashed):
            known, ids = self.hashed[length]
            if len(known):
                h = hashes[todo] - self.hash[boundary] * self.powers[length]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                left = self.token[boundary].astype(np.int64)
                hit = np.flatnonzero((known[at] == h) & (left != NONE))
                if len(hit):
                    fits = hit[self.all_apart((left[hit] << 32) | ids[at[hit]])]
                    self.token[new[todo[fits]]], self.begin[new[todo[fits]]] = ids[at[fits]], boundary[fits]
                    open_ = np.ones(len(todo), bool)
                    open_[fits] = False
                    todo, boundary = todo[open_], boundary[open_]
            boundary = self.back[boundary].astype(np.int64)
            todo, boundary = todo[boundary >= 0], boundary[boundary >= 0]
            length += 1
        return new

    def walk(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces of fewer than LOOK bytes, packed: all of them take their next byte together."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-size, kind="stable")
        size, width = size[order], int(size.max())
        data = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in order.tolist()]), np.uint8).reshape(len(pieces), width)
        state = np.zeros(len(pieces), np.int64)
        for j in range(width):
            n = int(np.searchsorted(-size, -j, "left"))  # those with a byte at j come first
            key = (state[:n] << 8) | data[:n, j]
            get = self.moves.get
            to = np.array([get(k, -1) for k in key.tolist()], np.int64)
            if len(unknown := np.flatnonzero(to < 0)):
                keys, inverse = np.unique(key[unknown], return_inverse=True)
                met = self.grow_all(keys >> 8, keys & 255)
                self.moves.update(zip(keys.tolist(), met.tolist(), strict=True))
                to[unknown] = met[inverse]
            state[:n] = to
        columns, at = [], state
        while (at > 0).any():
            columns.append(np.where(at > 0, self.token[at], NONE))
            at = np.where(at > 0, self.begin[at], 0)
        ids = np.array(columns[::-1], np.int32).T
        first, packed, row = ((ids == NONE).sum(1) * 4).tolist(), ids.tobytes(), ids.shape[1] * 4
        out = [b""] * len(pieces)
        for k, i in enumerate(order.tolist()):
            out[i] = packed[k * row + first[k] : (k + 1) * row]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Make sure that ``self.pieces`` has the packed ids of all these; what was met least of late may go."""
        new = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(new) > self.room * MAX_PIECES and self.pieces:  # what is met again comes back from the older half
            self.older, self.pieces, new = self.pieces, {}, list(pieces)
        unknown = []
        for p in new:
            if (known := self.older.get(p)) is not None:
                self.pieces[p] = known
            else:
                unknown.append(p)
        short = []
        for p in unknown:
            if len(p) * 4 < LOOK or len(p.encode()) < LOOK:
                short.append(p)
            else:
                self.pieces[p] = self.piece(p)
        for lo in range(0, len(short), 1024):
            part = [p.encode() for p in short[lo : lo + 1024]]
            if self.count + sum(map(len, part)) > self.room * MAX_STATES:
                self.forget()
            self.pieces.update(zip(short[lo : lo + 1024], self.walk(part), strict=True))

    def step(self, state: int, byte: int, data: bytes) -> int:
        """A transition met for the first time: the state behind it; ``final`` gets the tokens that it makes final."""
        key, to = state << 8 | byte, self.grow(state, data)
        depth = len(data)
        if depth >= LOOK and depth % 16 == 0:
            live = {depth: to} if self.token[to] != NONE else {}
            at = state
            while at >= 0 and depth - int(self.depth[at]) < self.longest:
                if self.token[at] != NONE and data[int(self.depth[at]) :] in self.beginnings:
                    live[int(self.depth[at])] = at
                at = int(self.back[at])
            while len(live) > 1:  # the nearest boundary that all of them descend from; starts come before ends
                top = int(self.begin[live.pop(max(live))])
                live[int(self.depth[top])] = top
            (root,) = live.values()
            if self.depth[root]:
                first = root
                while self.depth[first]:
                    first = int(self.begin[first])
                self.final[key] = self.tokens_since(first, root)
                last, rest = int(self.token[root]), data[int(self.depth[root]) :]
                if (to := self.roots.get(last, -1)) < 0:
                    to = self.roots[last] = self.state(last, 0, -1, 0)
                for n, b in enumerate(rest, 1):
                    if (old := self.moves.get(to << 8 | b)) is None:
                        old = self.moves[to << 8 | b] = self.grow(to, rest[:n])
                    to = old
        self.moves[key] = to
        return to

    def piece(self, text: str) -> bytes:
        """The ids of a piece of any length, packed as 32-bit integers; tokens are emitted as soon as they are final."""
        data = text.encode()
        if self.count >= self.room * MAX_STATES:
            self.forget()
        moves, final, root, state = self.moves, self.final, 0, 0
        out = array("i")
        for n, byte in enumerate(data, 1):
            key = state << 8 | byte
            if (to := moves.get(key)) is None:
                to = self.step(state, byte, data[n - 1 - int(self.depth[state]) : n])
            if final and key in final:
                out.extend(final[key])
                root = self.roots[out[-1]]
            state = to
        out.extend(self.tokens_since(root, state))
        return out.tobytes()


class Utf8Stream:
    """Text from bytes that come in parts: holds back the bytes of a character that has not ended."""

    #: lead byte's upper bits -> bytes of the character
    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end begin a character that needs more."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1
            return back if need > back else 0
        return 0

    def feed(self, part: bytes) -> str:
        data = self.held + part
        cut = len(data) - self._open(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def ascii_pattern(pattern: str) -> re.Pattern | None:
    """A pattern of the standard library, twice as fast, with the same matches in ASCII texts; None if it is not of that kind."""
    classes = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": " \\t\\n\\r\\x0b\\x0c"}
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part == r"\S" and not inside:
            part = f"[^{classes[chr(92) + 's']}]"
        elif part in classes:
            part = classes[part] if inside else f"[{classes[part]}]"
        elif part[0] == "\\" and part[1:].isalnum() or part[:2] in (r"\p", r"\P"):
            return None
        inside = part == "[" or inside and part != "]"
        out.append(part)
    return re.compile("".join(out))


class Pieces:
    """The pieces of a text, in order."""

    def __init__(self, pattern, ascii_only: re.Pattern | None):
        self.whole, self.ascii = pattern.findall, (ascii_only or pattern).findall

    def findall(self, text: str) -> list[str]:
        return self.ascii(text) if text.isascii() else self.whole(text)


_loaded: dict[tuple[str, str, int], tuple] = {}


def _coder(path: str, pattern: str, room: int = 1) -> tuple:
    """The transducer and the piece pattern, once per Python worker."""
    if (path, pattern, room) not in _loaded:
        import regex

        gc.set_threshold(200_000, 100, 100)  # the tables hold no cycles; looking for some takes a quarter of the time
        _loaded[path, pattern, room] = MergeTransducer(load_ranks(path), room), Pieces(regex.compile(pattern), ascii_pattern(pattern))
    return _loaded[path, pattern, room]


def encode_texts(texts: Iterable[str | None], coder: MergeTransducer, pieces) -> Iterator[np.ndarray]:
    """The ids of each text, in order; new pieces of neighbouring texts are learned together."""

    def done(group: list[list[str]]) -> Iterator[np.ndarray]:
        coder.learn(set().union(*group))
        known = coder.pieces.__getitem__
        for found in group:
            yield np.frombuffer(b"".join(map(known, found)), np.int32)

    group, chars = [], 0
    for t in texts:
        group.append(pieces.findall(t or ""))
        chars += len(t or "")
        if chars >= GROUP_CHARS:
            yield from done(group)
            group, chars = [], 0
    yield from done(group)


def decode_ids(ids: np.ndarray, coder: MergeTransducer) -> str:
    """The text of ids, a part at a time."""
    stream, token = Utf8Stream(), coder.tokens.__getitem__
    parts = [stream.feed(b"".join(map(token, ids[i : i + 4096].tolist()))) for i in range(0, len(ids), 4096)]
    return "".join(parts) + stream.close()


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out`` array<int>: the ids of the whole text under the rank file ``vocabulary``.

    Null and empty texts give an empty array. All other columns, repeated rows included, pass through; a column
    that is already called ``out`` is replaced. The file must be readable on the executors.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder, pieces = _coder(vocabulary, pattern)
        try:
            for texts in batches:
                yield pd.Series(list(encode_texts(texts, coder, pieces)), dtype=object)
        finally:
            coder.clear()

    return df.withColumn(out, ids(F.col(text)))


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows from and to, of some PART_CHARS characters together; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_CHARS, "right")))
        yield at, to
        at = to


def encode_checked(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: tuple[str, str] = ("token_ids", "round_trip"), keep: list[str] | None = None) -> DataFrame:
    """Add the columns ``out``: the ids, as :func:`encode` does, and whether decoding them as a stream gives the text back.

    One function in one worker does both, a part of a batch at a time, whose ids are one flat array with offsets: a task holds the
    vocabulary and a part, however long its texts are together. Columns of these names are replaced. Of the other columns all
    pass through, or those of ``keep``: texts that are not among them don't come back from the workers.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in out]
    plain = df.select(*kept)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pieces = _coder(vocabulary, pattern)
        try:
            for b in batches:
                for lo, hi in _parts(b.column(0)):
                    texts, *part = (c.slice(lo, hi - lo) for c in b.columns)
                    texts = texts.to_pylist()
                    ids, same = [], []
                    for t, i in zip(texts, encode_texts(texts, coder, pieces), strict=True):
                        ids.append(i)
                        same.append(decode_ids(i, coder) == (t or ""))
                    offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                    yield pa.RecordBatch.from_arrays([*part, listed, pa.array(same)], [*kept, *out])
        finally:
            coder.clear()

    schema = T.StructType([*plain.schema.fields, T.StructField(out[0], T.ArrayType(T.IntegerType())), T.StructField(out[1], T.BooleanType())])
    return df.select(F.col(text).alias("_folio_text"), *kept).mapInArrow(both, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` string: the text of the ids, decoded as a stream of parts.

    Null ids give null, an empty array an empty text. Bytes that are no UTF-8 become U+FFFD; an id outside of the
    vocabulary raises an error.
    """

    @F.pandas_udf(T.StringType())
    def text(arrays: pd.Series) -> pd.Series:
        coder, _ = _coder(vocabulary, "")
        return pd.Series([None if a is None else decode_ids(a, coder) for a in arrays], dtype=object)

    return df.withColumn(out, text(F.col(ids)))


def digests(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each row's whole text.

    Encoding, decoding and both digests run in one function, so that only the text goes to Python and only digests return.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder, pieces = _coder(vocabulary, pattern, ROOM)
        sha, digits = lambda t: hashlib.sha256(t.encode()).hexdigest(), coder.digits.__getitem__
        try:
            for texts in batches:
                rows = [(len(ids), sha(" ".join(map(digits, ids.tolist()))), sha(decode_ids(ids, coder))) for ids in encode_texts(texts, coder, pieces)]
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            coder.clear()

    return df.select("doc_id", of("text").alias("d")).select("doc_id", "d.*")
