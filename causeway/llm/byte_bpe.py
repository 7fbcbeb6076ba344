"""Byte-level BPE encoding and decoding (operator 8).

The distinct new pieces of a block of texts form a corpus.  An inverted index
lists, for the token each adjacent pair would make, the positions of such
pairs; merges are replayed over the whole corpus in rank order, each touching
the listed positions and their two neighbours only.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from causeway.llm.common import column, text_column

#: Pieces that a task remembers; beyond it the older half is forgotten (and encoded anew when met).
REMEMBERED = 300_000
#: Pieces, short ones, that a worker keeps from one task to the next, and their length.
KEPT, SHORT = 120_000, 9
#: Pieces of one corpus; its index then stays in the processor's cache.
CORPUS = 3_000
#: Documents encoded at a time.
BLOCK_DOCS = 256

_loaded: dict[tuple[str, str], Codec] = {}


class Codec:
    """Encoder and decoder for a rank file (``base64-token rank`` lines) and the pattern that splits texts into pieces."""

    def __init__(self, lines: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.size = size = max(self.tokens) + 1
        self.pieces = regex.compile(pattern)
        self.made: dict[int, int] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        every = [self.tokens.get(i, b"") for i in range(size)]
        self.all_bytes = np.frombuffer(b"".join(every), np.uint8)
        self.length = np.array([len(t) for t in every], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def _merged(self, pair: int) -> int:
        """The rank of the token that a pair (left * size + right) makes, or -1; worked out when first met."""
        if len(self.made) > KEPT:
            self.made.clear()
        left, right = divmod(pair, self.size)
        found = self.made[pair] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return found

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """The token ids of each piece, by replaying all merges over all pieces at once."""
        token: list[int] = []
        after: list[int] = []
        before: list[int] = []
        heads: list[int] = []
        at: dict[int, list[int]] = {}
        single = [self.ranks.get(bytes([x]), -1) for x in range(256)]
        known, merged, size, ranks = self.made.get, self._merged, self.size, self.ranks
        for piece in pieces:
            first = len(token)
            heads.append(first)
            whole = ranks.get(piece)
            if whole is not None:
                token.append(whole)
                after.append(-1)
                before.append(-1)
                continue
            token += [single[x] for x in piece]
            last = len(token) - 1
            after += range(first + 1, last + 1)
            after.append(-1)
            before.append(-1)
            before += range(first, last)
            left = token[first]
            for p in range(first, last):
                right = token[p + 1]
                r = known(pair := left * size + right)
                if r is None:
                    r = merged(pair)
                if r >= 0:
                    if r in at:
                        at[r].append(p)
                    else:
                        at[r] = [p]
                left = right
        todo = list(at)
        heapify(todo)
        while todo:
            r = heappop(todo)
            places = at.pop(r, None)
            if places is None:
                continue
            places.sort()
            for k, p in enumerate(places):
                q = after[p]
                if q < 0 or token[p] < 0:
                    continue
                # An earlier merge may have taken one of the two.
                now = known(pair := token[p] * size + token[q])
                if (merged(pair) if now is None else now) != r:
                    continue
                token[p], token[q] = r, -1
                after[p] = end = after[q]
                lower = False
                if end >= 0:
                    before[end] = p
                    new = known(pair := r * size + token[end])
                    if new is None:
                        new = merged(pair)
                    if new >= 0:
                        if new in at:
                            at[new].append(p)
                        else:
                            _list(at, todo, new, p)
                        lower = new < r
                left = before[p]
                if left >= 0:
                    new = known(pair := token[left] * size + r)
                    if new is None:
                        new = merged(pair)
                    if new >= 0:
                        if new in at:
                            at[new].append(left)
                        else:
                            _list(at, todo, new, left)
                        lower = lower or new < r
                if lower:  # that merge comes first, before the other places of this one
                    for rest in places[k + 1 :]:
                        _list(at, todo, r, rest)
                    break
        out = []
        for p in heads:
            ids = []
            while p >= 0:
                ids.append(token[p])
                p = after[p]
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (unsigned 32 bit) of each text."""
        collects = gc.isenabled()
        gc.disable()  # many small lists and no cycles: the collector would only walk over what is remembered
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pieces.findall(t) for t in texts]
        parts = [list(map(self.young.get, s)) for s in split]
        short = [k for k, p in enumerate(parts) if None in p]
        todo = []
        for piece in {x for k in short for x, v in zip(split[k], parts[k]) if v is None}:
            if piece in self.old:
                self.young[piece] = self.old[piece]
            else:
                todo.append(piece)
        for i in range(0, len(todo), CORPUS):
            part = todo[i : i + CORPUS]
            for piece, ids in zip(part, self.replay([x.encode("utf-8") for x in part])):
                self.young[piece] = array("I", ids).tobytes()
        for k in short:
            parts[k] = map(self.young.__getitem__, split[k])
        out = [np.frombuffer(b"".join(p), "<u4") for p in parts]
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        return out

    def trim(self) -> None:
        """Give back what a task remembered, but for short pieces, which most texts have."""
        short = (x for x in self.young.items() if len(x[0]) <= SHORT)
        self.young, self.old = dict(islice(short, KEPT)), {}

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens, one after the other."""
        out = []
        for i in range(0, len(ids), 1 << 16):
            part = ids[i : i + (1 << 16)].astype(np.int64)
            length = self.length[part]
            total = np.cumsum(length)
            place = np.repeat(self.start[part] - (total - length), length) + np.arange(int(total[-1]))
            out.append(self.all_bytes[place].tobytes())
        return b"".join(out)


def _list(at: dict[int, list[int]], todo: list[int], rank: int, place: int) -> None:
    if rank in at:
        at[rank].append(place)
    else:
        at[rank] = [place]
        heappush(todo, rank)


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a vocabulary file that every executor has at ``path``."""
    if (path, pattern) not in _loaded:
        with open(path, "rb") as f:
            _loaded[path, pattern] = Codec(f.read(), pattern)
    return _loaded[path, pattern]


def _run(df: DataFrame, step, name: str, kind: pa.DataType, spark_type: str, after=lambda: None) -> DataFrame:
    """``df`` with one more column, computed for each batch by ``step``; ``after`` runs at the end of each task."""
    schema = StructType([*df.schema, StructField(name, _parse_datatype_string(spark_type))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, BLOCK_DOCS):
                    part = batch.slice(i, BLOCK_DOCS)
                    values = pa.array(step(part.column(part.num_columns - 1)), type=kind)
                    yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*part.schema.names, name])
        finally:
            after()

    return df.mapInArrow(rows, schema)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", doc_id: str = "doc_id", out: str = "token_ids") -> DataFrame:
    """``(doc_id, token_ids array<int>)`` of each whole text, without special tokens.

    Null and empty texts have no tokens; very long ones are encoded whole;
    every row, repeated or not, gives a row; null ids and ids of any type pass
    through; an empty table gives an empty result; other columns are not read.
    The vocabulary file is read by path on each executor and must hold all 256
    single bytes.
    """

    def step(texts: pa.Array) -> pa.Array:
        ids = codec(vocabulary, pattern).encode([t or "" for t in texts.to_pylist()])
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32), pa.int32()))

    return _run(docs.select(column(doc_id).alias("doc_id"), text_column(docs, text).alias("__cw_text")), step, out, pa.list_(pa.int32()), "array<int>", lambda: codec(vocabulary, pattern).trim()).drop("__cw_text")


def decode(encoded: DataFrame, vocabulary: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in one more (binary) column.

    A null list of ids decodes to no bytes, as an empty one; lists of any
    length are decoded whole; repeated rows give a row each; an empty table
    gives an empty result; other columns pass through, but one named ``out``
    is replaced.
    """

    def step(lists: pa.Array) -> list[bytes]:
        coder = codec(vocabulary, pattern)
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        return [coder.decode(values[i:j]) for i, j in zip(ends[:-1], ends[1:])]

    others = [column(c) for c in encoded.columns if c not in (ids, out)]
    filled = encoded.select(*others, F.coalesce(column(ids), F.array().cast("array<int>")).alias(ids))
    return _run(filled, step, out, pa.binary(), "binary")
