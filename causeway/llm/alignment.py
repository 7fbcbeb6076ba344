"""Alignment of two tokenizers' tokens over a corpus (operator 12).

Both tokenizers cut the same bytes.  Offsets where tokens of both end part a
text into groups, and the two tokens that end there are linked.  How often an
id pair is linked in the whole corpus is found by a cogroup over the second
tokenizer's ids: documents' pair multiplicities and the corpus's pair counts
are shuffled by that id and sorted (Spark spills the sort), each id's counts
come first in the stream, its highest count is taken there, and the
multiplicities that follow become contributions of their documents, summed by
document.  An id with more multiplicities than a task should take is salted;
its counts, at most as many as the first tokenizer has ids, go to each part.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import drop_path, id_column, text_column, written

#: Chunks a worker remembers, twice over.
REMEMBERED = 1 << 18
#: Longer chunks aren't remembered.
LONG = 64
#: Multiplicities of one id that go to one part.
PART = 1_000_000
#: Multiplicities gathered before they are summed by document.
BATCH = 1 << 18
#: Documents whose sums travel together: 2 ** 16.
BLOCK_BITS = 16
#: Latin letters, which every version of Unicode has as letters, and the marks at which a word ends for both vocabularies.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-/:-@\[-^`{-~"
_CHUNKS = re.compile(f"[ \n]*[{LETTERS}]+(?=[{MARKS} \n]|\\Z)|[ \n]*[^ \n]+|[ \n]+")
_OTHER_BLANKS = re.compile(r"[^\S \n]")
_SAFE_CUTS = re.compile(r"(?<=\S)(?=[ \n])")
_ONE_PIECE = re.compile(f" ?[{LETTERS}]+")
_WITHIN = re.compile(f"[{LETTERS}][{MARKS}]|[^▁]▁|\n")

#: What a stretch of text gives, whichever text it stands in: numbers of tokens of both kinds and of groups, the groups, the links.
Chunk = tuple[int, int, int, str, bytes]


class _Aligner:
    """Encodes texts with both vocabularies, chunk by chunk.

    A chunk starts at a blank (space or line break) that follows a character
    other than white space, or at a mark that follows a run of Latin letters.
    Neither vocabulary joins across such a place: the first one's splitter
    ends a piece there, and the second one has no piece that holds it (looked
    up at the start).  So chunks are encoded by themselves and frequent ones
    remembered.
    """

    def __init__(self, vocabulary_a: str, vocabulary_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(vocabulary_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_b)
        b = self.b
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any(_WITHIN.search(p) for i, p in enumerate(pieces) if not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i))):
            raise ValueError("pieces that join what stands on both sides of a cut")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.before = [b.piece_to_id("▁"), b.piece_to_id("<0x0A>")]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in shown]
        self.visible = {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(hidden)}
        byte = {c: x for x, c in self.visible.items()}
        tokens = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(map(byte.get, t)) if set(t) <= set(byte) else b"" for t in tokens]
        self.names = list(map(str, range(max(len(tokens), len(pieces)))))
        self.young: dict[str, Chunk | None] = {}
        self.old: dict[str, Chunk | None] = {}

    def _encode_a(self, chunk: str) -> list[int]:
        if _ONE_PIECE.fullmatch(chunk):
            return [t.id for t in self.a.model.tokenize(chunk.encode("utf-8").decode("latin-1").translate(self.visible))]
        return self.a.encode(chunk, add_special_tokens=False).ids

    def _encode_b(self, chunk: str) -> list[int]:
        """Ids of a chunk of space+text; the library puts a space in front by itself, which a line break keeps apart from other chunks."""
        if chunk[0] == " ":
            return self.b.encode(chunk[1:]) or self.before[:1]
        ids = self.b.encode("\n" + chunk)
        if ids[:2] != self.before:
            raise ValueError("a vocabulary that joins a line break")
        return ids[2:]

    def _aligned(self, chunk: str) -> Chunk | None:
        a, b, whole = self._encode_a(chunk), self._encode_b(chunk), chunk.encode("utf-8")
        a_bytes, b_bytes = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return None
        names, ends_b = self.names, list(accumulate(map(len, b_bytes)))
        pairs, groups, j, i0, j0 = array("q"), [], 0, 0, 0
        for i, end in enumerate(accumulate(map(len, a_bytes))):
            while ends_b[j] < end:
                j += 1
            if ends_b[j] == end:
                pairs.append(a[i] << 32 | b[j])
                groups.append(names[a[i]] + "|" + names[b[j]] if i == i0 and j == j0 else ",".join([names[x] for x in a[i0 : i + 1]]) + "|" + ",".join([names[x] for x in b[j0 : j + 1]]))
                i0, j0 = i + 1, j + 1
        return len(a), len(b), len(groups), ";".join(groups), pairs.tobytes()

    def chunks(self, text: str) -> list[Chunk] | None:
        """The chunks of space+text; null where bytes get lost."""
        whole = " " + text
        names = _SAFE_CUTS.split(whole) if _OTHER_BLANKS.search(text) else _CHUNKS.findall(whole)
        out = list(map(self.young.get, names))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    name = names[i]
                    if name in self.young:
                        found = self.young[name]
                    else:
                        found = self.old[name] if name in self.old else self._aligned(name)
                        if len(name) <= LONG:
                            self.young[name] = found
                    if found is None:
                        return None
                    out[i] = found
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        return out


_aligners: dict[tuple[str, str], _Aligner] = {}


def _aligner(a: str, b: str) -> _Aligner:
    if (a, b) not in _aligners:
        _aligners[a, b] = _Aligner(a, b)
    return _aligners[a, b]


def token_groups(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(row, doc_id, n_a, n_b, n_groups, groups, pairs, times)``, one row per document.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` in ids; ``pairs`` (binary, 64 bits
    each, little-endian) holds the document's different links ``a << 32 | b``
    in ascending order and ``times`` (32 bits each) how often each stands in
    it.  ``row`` numbers rows.  Texts that are null or empty, or whose bytes
    either vocabulary doesn't give back, have no tokens.  Very long texts are
    taken whole in a task's memory; an empty table gives an empty result.
    """
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, groups string, pairs binary, times binary"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
    arrow = pa.schema(list(zip(("row", "doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"), kinds)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, row = _aligner(vocabulary_a, vocabulary_b), TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, out = batch.slice(i, 256), []
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    chunks = aligner.chunks(t) if t else None
                    if chunks:
                        n_a, n_b, n_groups, cut, links = zip(*chunks)
                        pairs, times = np.unique(np.frombuffer(b"".join(links), "<i8"), return_counts=True)
                        out.append((row, d, sum(n_a), sum(n_b), sum(n_groups), ";".join(cut), pairs.tobytes(), times.astype("<i4").tobytes()))
                    else:
                        out.append((row, d, 0, 0, 0, "", b"", b""))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema=arrow)

    return docs.select(id_column(docs, doc_id), text_column(docs, text)).mapInArrow(rows, schema)


def pair_counts(groups: DataFrame) -> DataFrame:
    """``(b, a, n, postings)``: how many links hold an id pair in the whole corpus, and in how many documents.

    Each task adds up blocks of documents before anything is shuffled.
    """
    arrow = pa.schema([("pair", pa.int64()), ("n", pa.int64()), ("postings", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(held: list) -> list[np.ndarray]:
            pairs, n, postings = map(np.concatenate, zip(*held))
            order = np.argsort(pairs, kind="stable")
            pairs = pairs[order]
            starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.empty(0, np.int64)
            return [pairs[starts], np.add.reduceat(n[order], starts) if len(starts) else n, np.add.reduceat(postings[order], starts) if len(starts) else postings]

        held, size = [], 0
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x:
                    pairs = np.frombuffer(x, "<i8")
                    held.append([pairs, np.frombuffer(y, "<i4").astype(np.int64), np.ones(len(pairs), np.int64)])
                    size += len(pairs)
                    if size > 4 * BATCH:
                        held = [summed(held)]
                        size = len(held[0][0])
                        if size > 2 * BATCH:
                            yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), schema=arrow)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, summed(held))), schema=arrow)

    found = groups.select("pairs", "times").mapInArrow(rows, "pair long, n long, postings long")
    return found.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("postings").alias("postings")).select(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), F.shiftright("pair", 32).cast("int").alias("a"), "n", "postings")


def _sent(groups: DataFrame, parts: np.ndarray) -> DataFrame:
    """``(b, part, kind, a, row, times)``: the documents' multiplicities, addressed to their id's parts."""
    arrow = pa.schema([("b", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("a", pa.int32()), ("row", pa.int64()), ("times", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                held = [(r, np.frombuffer(x, "<i8"), np.frombuffer(y, "<i4")) for r, x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()) if x]
                if not held:
                    continue
                row = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[1]) for h in held])
                pair, times = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]).astype(np.int64)
                b = (pair & 0xFFFFFFFF).astype(np.int32)
                # A document's place in the numbering decides, so that a task that is tried again sends alike.
                to = ((row * 0x9E3779B1 & 0x7FFFFFFF) >> 8) % parts[b]
                columns = (b, to.astype(np.int32), np.ones(len(b), np.int32), (pair >> 32).astype(np.int32), row, times)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), schema=arrow)

    return groups.select("row", "pairs", "times").mapInArrow(rows, "b int, part int, kind int, a int, row long, times long")


def contributions(groups: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """``(row, n_best, count_sum)`` of each document that has links."""
    counts = written(pair_counts(groups), "alignment-counts")
    # A row for each id of the second vocabulary at most.
    parts = np.ones(size_b, np.int64)
    for b, n in counts.groupBy("b").agg(F.sum("postings").alias("n")).filter(F.col("n") > PART).collect():
        parts[b] = -(-n // PART)
    often = counts.sparkSession.createDataFrame([(int(b), int(parts[b])) for b in np.flatnonzero(parts > 1)], "b int, parts int")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    addressed = counts.join(often, "b", "left").select("b", copies, F.lit(0).alias("kind"), "a", F.lit(0).cast("long").alias("row"), F.col("n").alias("times"))
    stream = addressed.unionByName(_sent(groups, parts)).repartition("b", "part").sortWithinPartitions("b", "part", "kind")
    packed = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("best", pa.binary()), ("total", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known, most, group = np.zeros(size_a, np.int64), [], 0, None
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            """A row for each block of documents that the gathered contributions touch."""
            row, best, total = map(np.concatenate, zip(*held))
            order = np.argsort(row, kind="stable")
            row = row[order]
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            row, best, total = row[starts], np.add.reduceat(best[order], starts), np.add.reduceat(total[order], starts)
            block = row >> BLOCK_BITS
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            pieces = [(int(block[i]), (row[i:j] & (1 << BLOCK_BITS) - 1).astype("<u2").tobytes(), best[i:j].tobytes(), total[i:j].tobytes()) for i, j in zip(cuts.tolist(), cuts[1:].tolist())]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces), packed)], schema=packed)

        for batch in batches:
            b, part, kind, a, row, times = (c.to_numpy() for c in batch.columns)
            ends = np.concatenate([np.flatnonzero((b[1:] != b[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(b)]])
            i = 0
            for j in ends.tolist():
                if (b[i], part[i]) != group:
                    for x in known:
                        count[x] = 0
                    group, known, most = (b[i], part[i]), [], 0
                if kind[i] == 0:
                    count[a[i:j]] = times[i:j]
                    known.append(a[i:j])
                    most = max(most, int(times[i:j].max()))
                else:
                    n = count[a[i:j]]
                    held.append((row[i:j], np.where(n == most, times[i:j], 0), times[i:j] * n))
                    size += j - i
                    if size >= BATCH:
                        yield summed()
                        held, size = [], 0
                i = j
        if held:
            yield summed()

    arrow = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, total, met = None, np.zeros(1 << BLOCK_BITS, np.int64), np.zeros(1 << BLOCK_BITS, np.int64), np.zeros(1 << BLOCK_BITS, bool)

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(met)
            return pa.RecordBatch.from_arrays([pa.array((block << BLOCK_BITS) + at), pa.array(best[at]), pa.array(total[at])], schema=arrow)

        for batch in batches:
            for now, docs, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if now != block:
                    if block is not None:
                        yield done()
                    block = now
                    best[:], total[:], met[:] = 0, 0, False
                at = np.frombuffer(docs, "<u2")
                best[at] += np.frombuffer(x, "<i8")
                total[at] += np.frombuffer(y, "<i8")
                met[at] = True
        if block is not None:
            yield done()

    found = stream.mapInArrow(rows, "block long, docs binary, best binary, total binary").repartition("block").sortWithinPartitions("block")
    out = written(found.mapInArrow(totals, "row long, n_best long, count_sum long"), "alignment-sums")
    drop_path(groups.sparkSession, counts._scratch_path)
    return out


def align(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, text: str = "text", doc_id: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)``, one row per document.

    ``n_links`` counts links (one ends each group), ``n_best`` those whose
    pair is linked as often in the corpus as any pair of its second id, ties
    included, ``count_sum`` adds up the counts of all links' pairs.  ``keep``
    names columns to have in place of ``groups``, made from it before
    anything is stored (a digest, where the groups themselves aren't wanted).
    Null ids and repeated rows each keep their row; see ``token_groups`` for
    odd texts; other columns are not read.
    """
    import sentencepiece
    from tokenizers import Tokenizer

    size_a = Tokenizer.from_file(vocabulary_a).get_vocab_size()
    size_b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_b).get_piece_size()
    kept = keep or {"groups": F.col("groups")}
    groups = written(token_groups(docs, vocabulary_a, vocabulary_b, text, doc_id).select("row", "doc_id", "n_a", "n_b", "n_groups", *[c.alias(n) for n, c in kept.items()], "pairs", "times"), "alignment-groups")
    sums = contributions(groups, size_a, size_b)
    zero = F.lit(0).cast("long")
    own = groups.select("row", "doc_id", "n_a", "n_b", "n_groups", *kept)
    out = written(own.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), *kept), "alignment")
    for table in (groups, sums):
        drop_path(docs.sparkSession, table._scratch_path)
    return out
