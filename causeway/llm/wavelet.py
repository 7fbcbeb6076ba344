"""Token ids in wavelet-matrix files (operator 2).

A shard is one file.  It holds the ids of consecutive documents as a wavelet
matrix: one bit-plane for each bit of an id, highest first; after each plane
the ids are dealt stably into those with a 0 and those with a 1.  Together
with sampled counts of ones, the planes give access to a token, its count in a
range and its n-th place without decoding the rest.

File: ``CWM1``, header length (unsigned 32 bit), header (JSON: number of
tokens, of documents, of bits, zeros of each plane, compressed lengths), then
zstandard frames: document ids (signed 64 bit), null flags, token counts
(unsigned 64 bit), and the planes.  All numbers are little-endian.  Counts of
ones are rebuilt on opening, one for each 64 bits.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import get_file, id_column, map_rows, put_file, text_column

MAGIC = b"CWM1"
#: A shard is closed when it holds so many tokens; its last document is kept whole.
SHARD_TOKENS = 1 << 20
#: Ids of a plane that are dealt at a time.
PIECE = 1 << 15
#: Words that a worker remembers; beyond it the older half is forgotten.
REMEMBERED = 700_000


class WaveletMatrix:
    """Bit-planes over a sequence of ids below ``2**bits``."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], size: int) -> None:
        """planes: packed bits, lowest bit of a byte first, padded to 64 bits."""
        self.planes, self.zeros, self.size, self.bits = [p.view("<u8") for p in planes], zeros, size, len(planes)
        self._ones: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (now & now.dtype.type(1 << b)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]))
            after = np.empty_like(now)
            zero = len(now) - int(np.count_nonzero(bit))
            i, j = 0, zero
            for at in range(0, len(now), PIECE):  # pieces that stay in the processor's cache
                part, one = now[at : at + PIECE], bit[at : at + PIECE]
                low, high = np.compress(~one, part), np.compress(one, part)
                after[i : i + len(low)], after[j : j + len(high)] = low, high
                i, j = i + len(low), j + len(high)
            zeros.append(zero)
            now = after
        return cls(planes, zeros, len(ids))

    def _plane(self, k: int) -> np.ndarray:
        return np.unpackbits(self.planes[k].view(np.uint8), count=self.size, bitorder="little").view(bool)

    def all(self) -> np.ndarray:
        """Every id, in order."""
        now = np.zeros(self.size, np.uint16 if self.bits <= 16 else np.uint32)
        places = np.arange(min(self.size, PIECE))
        for k in range(self.bits - 1, -1, -1):
            bit, back = self._plane(k), np.empty_like(now)
            now[self.zeros[k] :] |= now.dtype.type(1 << (self.bits - 1 - k))
            i, j = 0, self.zeros[k]
            for at in range(0, self.size, PIECE):
                part, one = back[at : at + PIECE], bit[at : at + PIECE]
                low, high = np.compress(~one, places[: len(one)]), np.compress(one, places[: len(one)])
                part[low], part[high] = now[i : i + len(low)], now[j : j + len(high)]
                i, j = i + len(low), j + len(high)
            now = back
        return now

    def _rank(self, k: int, i: int) -> int:
        """Ones before position ``i`` of a plane."""
        if self._ones is None:
            self._ones = [np.concatenate([[0], np.cumsum(np.bitwise_count(p).astype(np.int64))]) for p in self.planes]
        word, rest = divmod(i, 64)
        return int(self._ones[k][word]) + (int(self.planes[k][word]) & ((1 << rest) - 1)).bit_count() if rest else int(self._ones[k][word])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            word, rest = divmod(i, 64)
            bit = int(self.planes[k][word]) >> rest & 1
            ones = self._rank(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self._rank(k, i), self._rank(k, j)
            i, j = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (i - a, j - b)
        return i, j

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often a token stands in ``[start, end)``."""
        if token >> self.bits:
            return 0
        i, j = self._range(token, start, self.size if end is None else end)
        return j - i

    def select(self, token: int, n: int) -> int:
        """The place of the n-th occurrence (from 0) of a token."""
        i, j = self._range(token, 0, self.size) if not token >> self.bits else (0, 0)
        if not 0 <= n < j - i:
            raise IndexError(n)
        at = i + n
        for k in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - k) & 1
            at = self._select(k, at - self.zeros[k] if one else at, one)
        return at

    def _select(self, k: int, n: int, one: int) -> int:
        self._rank(k, 0)
        ones = self._ones[k]
        counts = ones if one else np.arange(len(ones)) * 64 - ones
        word = int(np.searchsorted(counts, n, side="right")) - 1
        bits = np.unpackbits(self.planes[k][word : word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits == one)[n - int(counts[word])])

    def places(self, token: int) -> list[int]:
        """All places of a token."""
        return [self.select(token, n) for n in range(self.count(token))]


def pack(doc_ids: list[int | None], ids: list[np.ndarray], bits: int) -> bytes:
    """A shard file."""
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    matrix = WaveletMatrix.build(every, bits)
    squeeze = zstandard.ZstdCompressor(level=1)
    parts = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), np.array([len(x) for x in ids], "<u8").tobytes(), *(p.tobytes() for p in matrix.planes)]
    frames = [squeeze.compress(p) for p in parts]
    header = json.dumps({"tokens": len(every), "docs": len(doc_ids), "bits": bits, "zeros": matrix.zeros, "lengths": [len(f) for f in frames]}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *frames])


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, token counts and the matrix of a shard file."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard file")
    at = 8 + int.from_bytes(data[4:8], "little")
    header = json.loads(data[8:at])
    frames = []
    for n in header["lengths"]:
        frames.append(zstandard.ZstdDecompressor().decompress(data[at : at + n]))
        at += n
    doc_ids = [None if null else d for d, null in zip(np.frombuffer(frames[0], "<i8").tolist(), frames[1])]
    return doc_ids, np.frombuffer(frames[2], "<u8").astype(np.int64), WaveletMatrix([np.frombuffer(f, np.uint8) for f in frames[3:]], header["zeros"], header["tokens"])


#: Words that every version of Unicode normalizes, lowers and splits alike.
LATIN = regex.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class _Encoder:
    """The ids of whole texts, from those of their words.

    The vocabulary's splitter drops white space and never joins what stands
    on both sides of it, so each blank-separated word is encoded on its own
    and remembered.  Capitals A-Z are lowered first, as its normalizer does.
    New words of ASCII and Latin-1 letters are lowered and split here as the
    vocabulary file says, and their pieces handed to the tokenizers library's
    model; words with any other character go to the library whole, because
    what counts as a letter there is up to its version of Unicode.  With
    ``added_tokens``, the vocabulary's added tokens are taken out of the raw
    texts before, each as its one id.
    """

    def __init__(self, path: str, added_tokens: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Added tokens are taken out of the texts before; within a word they are text.
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        steps, parts = held["normalizer"]["normalizers"], held["pre_tokenizer"]["pretokenizers"]
        if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in parts] != ["Split", "ByteLevel"] or parts[1]["add_prefix_space"]:
            raise ValueError("a vocabulary with another normalizer or splitter")
        added = held["added_tokens"] if added_tokens else []
        if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that aren't matched as they stand")
        self.pattern = regex.compile(parts[0]["pattern"]["Regex"])
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.code = "H" if self.bits <= 16 else "I"
        # After a line break, which no word holds: a word may be a token's lower case.
        self.added = {b"\n" + x["content"].encode(): array(self.code, [x["id"]]).tobytes() for x in added}
        self.contents = sorted((k[1:] for k in self.added), key=len, reverse=True)
        self.border = regex.compile(b"(" + b"|".join(map(regex.escape, self.contents)) + b")")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.visible = {b: chr(c) for b, c in _visible_bytes().items()}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            shown = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
            if len(self.pieces) > REMEMBERED // 2:
                self.pieces.clear()
            found = self.pieces[piece] = array(self.code, [t.id for t in self.tokenizer.model.tokenize(shown.translate(self.visible))]).tobytes()
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if not text.isascii():
            if not LATIN.fullmatch(text):
                return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            text = text.lower()
        if text.isalpha():
            return self._piece(text)
        if text[-1] in ".,;:?" and text[:-1].isalpha():
            return self._piece(text[:-1]) + self._piece(text[-1])
        return b"".join(map(self._piece, self.pattern.findall(text)))

    def _words(self, text: bytes) -> list[bytes]:
        if not any(x in text for x in self.contents):
            return text.lower().split()
        words = []
        for i, part in enumerate(self.border.split(text)):
            words += [b"\n" + part] if i % 2 else part.lower().split()
        return words

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of UTF-8 texts."""
        out = []
        for t in texts:
            words = self._words(t or b"")
            parts = list(map(self.young.get, words))
            if None in parts:
                for i, p in enumerate(parts):
                    if p is None:
                        w = words[i]
                        found = self.young.get(w) or self.old.get(w) or self.added.get(w) or self._word(w)
                        parts[i] = self.young[w] = found
            out.append(np.frombuffer(b"".join(parts), self.kind))
            if len(self.young) > REMEMBERED:
                self.young, self.old = {}, self.young
        return out


def _visible_bytes() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


_encoders: dict[tuple[str, bool], _Encoder] = {}


def _encoder(path: str, added_tokens: bool) -> _Encoder:
    if (path, added_tokens) not in _encoders:
        _encoders[path, added_tokens] = _Encoder(path, added_tokens)
    return _encoders[path, added_tokens]


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int, text: str = "text", doc_id: str = "doc_id", partitions: int | None = None, added_tokens: bool = False) -> DataFrame:
    """Encode ``docs`` into shard files in ascending order of ``doc_id``; return their manifest.

    The manifest, a table at ``<folder>/manifest``, has a row for each shard:
    part, seq, file, docs, tokens.  Nulls come first; rows of the same id are
    ordered by text; null texts are empty and have the end id alone; a very
    long text is a shard of its own, built in a task's memory; ids are whole
    numbers or null; other columns are not read; an empty
    table gives an empty manifest.  Added tokens of the vocabulary that stand
    in a text are text like any other (the tokenizers library with
    ``encode_special_tokens``) or, with ``added_tokens``, have their own id (the
    library's default).  A shard's name depends on its place alone,
    so a task that is tried again writes the same files.
    """
    narrow = docs.select(id_column(docs, doc_id).alias("doc_id"), text_column(docs, text).cast("binary").alias("text"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    shards = f"{folder}/shards"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        from pyspark import TaskContext

        part, seq, held, count = TaskContext.get().partitionId(), 0, ([], []), 0
        encoder = _encoder(vocabulary, added_tokens)
        end = np.array([end_id], encoder.kind)

        def close() -> list[tuple]:
            name = f"{part:06d}-{seq:06d}.cwm"
            put_file(shards, name, pack(*held, encoder.bits))
            return [(part, seq, name, len(held[0]), count)]

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                piece = batch.slice(i, 256)
                for d, ids in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist())):
                    held[0].append(d)
                    held[1].append(np.concatenate([ids, end]))
                    count += len(ids) + 1
                    if count >= SHARD_TOKENS:
                        yield close()
                        seq, held, count = seq + 1, ([], []), 0
        if held[0]:
            yield close()

    map_rows(ordered, rows, "part int, seq int, file string, docs long, tokens long").write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def open_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, start)``: the shards of a folder and the number of ids before each.

    Shards are numbered within a partition, partitions among themselves; the
    one window over all has a row for each partition.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    own = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")
    return manifest.withColumn("own", own).join(before, "part").select("file", (F.col("own") + F.col("before")).alias("start"), "docs", "tokens")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, ids)`` of every document, read back from its shard; ids: unsigned 32 bit, little-endian.

    Null ids, empty texts (the end id alone) and repeated rows come back as
    they were written, a very long text as one value; an empty folder gives an
    empty result.
    """
    shards = f"{folder}/shards"
    # A fixed number of partitions: rows are few, but each stands for a shard.
    files = open_shards(spark, folder).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("file"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids, lengths, matrix = unpack(get_file(shards, file))
                ids = matrix.all().astype("<u4")
                ends = np.cumsum(lengths)
                yield [(d, start + e - n, ids[e - n : e].tobytes()) for d, n, e in zip(doc_ids, lengths.tolist(), ends.tolist())]

    return map_rows(files.select("file", "start"), rows, "doc_id long, start long, ids binary")
