"""Near-duplicate detection on SimHash fingerprints (operator 3).

A fingerprint is eight bytes, each with a position.  Two fingerprints that
differ in at most ``max_bits`` = 4 bits differ in at most four bytes, so they
share at least four positional bytes: the guaranteed minimum.  The inverted
index lists fingerprints under triples of positional bytes, chosen so that
every four positions contain a triple (20 of the 56 do).  Every pair with the
guaranteed minimum therefore meets in a list; for each pair that meets, the
shared positional bytes are tallied, pairs below the minimum are dropped, and
the rest verified bit by bit.  Lists of single bytes would hold 1/256 of all
fingerprints each; those of triples hold 1/2**24.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import column, drop_path, fresh_prefix, id_column, map_rows, text_column, written
from causeway.llm.graph import connected_components

SEED = 42
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16
#: Fingerprints of a posting list that one task compares with one another; longer lists are dealt out as pairs of blocks.
BLOCK = 1024


def _fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: n - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts, ends[shingle - 1 :].tolist())]
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        block = np.array(hashes[i : i + CHUNK], dtype="<u8")
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, key: str | None = None) -> DataFrame:
    """``(doc_id, fp)``, and a string column ``key`` of ``docs`` if one is named: the signed 64-bit SimHash of each whole text's word shingles, repeats included.

    Words are lower-cased (A-Z).  Fewer words than a shingle: the whole
    sequence is one shingle.  Null and blank texts: 0.  Very long texts are
    hashed whole, a block of shingles at a time.  Ids are whole numbers or
    null; a row gives a row; an empty table gives an empty result.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                d, t, *keys = (c.to_pylist() for c in part.columns)
                yield list(zip(d, (_fingerprint(x, shingle) for x in t), *keys))

    kept = [column(key).cast("string")] if key else []
    return map_rows(docs.select(id_column(docs, doc_id), text_column(docs, text), *kept), rows, "doc_id long, fp long" + ", key string" * len(kept))


def index_triples() -> list[tuple[int, int, int]]:
    """Twenty triples of the eight byte positions, one within every four positions.

    Positions fall into three groups; a triple lies within a group, or has two
    positions in one group and one in the next.  Of any four positions, two
    lie in one group and a third in the same or the next one.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    chosen = []
    for t in combinations(range(8), 3):
        counts = [sum(group[p] == g for p in t) for g in range(3)]
        if 3 in counts or any(counts[g] == 2 and counts[(g + 1) % 3] == 1 for g in range(3)):
            chosen.append(t)
    return chosen


def _first_triple() -> np.ndarray:
    """For each set of shared positions (as bits), the first triple within it, or -1."""
    triples = [sum(1 << p for p in t) for t in index_triples()]
    return np.array([next((k for k, t in enumerate(triples) if t & s == t), -1) for s in range(256)], np.int64)


def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """The positions, as bits, at which two fingerprints agree, from their exclusive or."""
    same = x.astype("<u8").view(np.uint8).reshape(*x.shape, 8) == 0
    return np.packbits(same, axis=-1, bitorder="little")[..., 0]


class _Forest:
    """Union-find over the members of one group."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(p, p)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _links(combo: int, left: np.ndarray, right: np.ndarray, within: bool, max_bits: int, first: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Links between two blocks of one posting list, without those that close a cycle."""
    forest, out = _Forest(), []
    for i in range(0, len(left), 256):
        rows = left[i : i + 256]
        x = rows[:, None] ^ right[None, :]
        if within:
            x = np.where(np.arange(len(right))[None, :] > (np.arange(len(rows)) + i)[:, None], x, np.uint64(2**64 - 1))
        shared = _shared_bytes(x)
        a, b = np.nonzero((np.bitwise_count(shared) >= least) & (first[shared] == combo) & (np.bitwise_count(x) <= max_bits))
        for u, v in zip(rows[a].view(np.int64).tolist(), right[b].view(np.int64).tolist()):
            if forest.join(u, v):
                out.append((u, v))
    return out


def linked(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """``(a, b)``: links between the distinct fingerprints ``fp``, enough to connect all that are within ``max_bits``."""
    if max_bits > 4:
        raise ValueError("the index guarantees a shared triple up to 4 differing bits")
    least = 8 - max_bits
    triples = index_triples()
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = F.array(*[F.lit(k << 24).bitwiseOR(F.shiftleft(byte[t[0]], 16)).bitwiseOR(F.shiftleft(byte[t[1]], 8)).bitwiseOR(byte[t[2]]).cast("long") for k, t in enumerate(triples)])
    postings = fps.select("fp", F.explode(keys).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # A list of one block goes to one group; a longer one to a group for each pair of its blocks.
    dealt = (
        postings.join(sizes, "key")
        .select("key", "fp", blocks.alias("blocks"))
        .select("key", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "fp")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "mine", "fp")
    )
    first = _first_triple()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        rest = None
        for batch in batches:
            now = np.column_stack([batch.column(c).to_numpy() for c in range(5)])
            now = now if rest is None else np.concatenate([rest, now])
            changes = np.flatnonzero((now[1:, :3] != now[:-1, :3]).any(1)) + 1
            cut = int(changes[-1]) if len(changes) else 0
            rest = now[cut:]
            if cut:
                yield _groups(now[:cut], changes[:-1])
        if rest is not None and len(rest):
            yield _groups(rest, np.array([], np.int64))

    def _groups(rows_: np.ndarray, starts: np.ndarray) -> list[tuple]:
        bounds = np.concatenate([[0], starts, [len(rows_)]])
        size = np.diff(bounds)
        fp, key = rows_[:, 4].view(np.uint64), rows_[:, 0]
        out: list[tuple] = []
        # Groups of up to eight: compare at each distance, all groups at once.
        group = np.repeat(np.arange(len(size)), size)
        small = np.flatnonzero((size[group] <= 8) & (rows_[:, 1] == rows_[:, 2]))
        for d in range(1, 8):
            a, b = small[:-d], small[d:]
            meet = group[a] == group[b]
            if not meet.any():
                break
            a, b = a[meet], b[meet]
            x = fp[a] ^ fp[b]
            shared = _shared_bytes(x)
            ok = (np.bitwise_count(shared) >= least) & (first[shared] == key[a] >> 24) & (np.bitwise_count(x) <= max_bits)
            out += zip(fp[a][ok].view(np.int64).tolist(), fp[b][ok].view(np.int64).tolist())
        for g in np.flatnonzero((size > 8) | (rows_[bounds[:-1], 1] != rows_[bounds[:-1], 2])):
            part = rows_[bounds[g] : bounds[g + 1]]
            fps_, combo = part[:, 4].copy().view(np.uint64), int(part[0, 0] >> 24)
            if part[0, 1] == part[0, 2]:
                out += _links(combo, fps_, fps_, True, max_bits, first, least)
            else:
                one = part[:, 3] == part[0, 1]
                out += _links(combo, fps_[one], fps_[~one], False, max_bits, first, least)
        return out

    return map_rows(dealt.select("key", F.col("i").cast("long"), F.col("j").cast("long"), F.col("mine").cast("long"), "fp"), rows, "a long, b long")


def _grouped(marked: DataFrame, least: Column, max_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written classes of equal fingerprints, ``(fp, root)`` of their components, and written ``(root, least)``: the smallest value of ``least`` in each component."""
    classes = written(marked.groupBy("fp").agg(F.min(least).alias("least")), "classes")
    nodes = connected_components(linked(classes.select("fp"), max_bits))
    rooted = classes.join(nodes, classes.fp == nodes.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written, so that the joins on it read plain exchanges, whose large partitions Spark can split: a component may hold a third of all fingerprints.
    roots = written(rooted.groupBy("root").agg(F.min("least").alias("least")), "roots")
    return classes, rooted.select("fp", "root"), roots


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per document.

    ``component_id`` is the smallest id of the documents that can be reached
    over links.  Null ids take part in linking and are never the smallest
    (null if a component has no other); other ids must be whole numbers; null
    texts count as empty; texts of any length are hashed whole; repeated
    rows each get a row; an empty table gives an empty result.  Other columns
    are not read.
    """
    marked = written(fingerprints(docs, text, doc_id, shingle), "fingerprints")
    classes, rooted, roots = _grouped(marked, F.col("doc_id"), max_bits)
    labels = rooted.join(roots, "root").select("fp", F.col("least").alias("component_id"))
    out = written(marked.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"), "near-duplicates")
    for table in (marked, classes, roots):
        drop_path(docs.sparkSession, table._scratch_path)
    return out


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one document of each group; all its columns.

    A document is a row's id and text, so rows of one id with different texts
    are different documents, and no group goes without its own.  Of a group
    the document of the smallest id stays, null ids last, of equal ids the one
    whose text has the smaller SHA-256; of rows alike in both the one whose
    columns hash lowest.  So what stays doesn't depend on how rows are
    partitioned.  Null and empty texts count as equal; very long texts are
    taken whole; an empty table gives an empty result; other columns pass
    through whatever their names.
    """
    own = fresh_prefix(docs)
    digest = F.sha2(F.coalesce(text_column(docs, text), F.lit("")).cast("binary"), 256)
    marked = written(fingerprints(docs.withColumn(f"{own}key", digest), text, doc_id, shingle, f"{own}key"), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("key"))
    classes, _, roots = _grouped(marked, first, max_bits)
    keep = written(roots.select(*[F.col(f"least.{c}").alias(f"{own}{c}") for c in ("none", "id", "key")]), "one-of-each-group")
    for table in (marked, classes, roots):
        drop_path(docs.sparkSession, table._scratch_path)
    given = id_column(docs, doc_id)
    met = docs.join(keep, (digest == F.col(f"{own}key")) & (given.isNull() == F.col(f"{own}none")) & (F.coalesce(given, F.lit(0)) == F.col(f"{own}id")), "left_semi")
    hashed = F.xxhash64(*[column(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"])
    row = F.struct(*[column(c) for c in docs.columns])
    alike = met.groupBy(given.alias(f"{own}id"), digest.alias(f"{own}key")).agg(F.min_by(row, hashed).alias(f"{own}row"))
    return alike.select(*[F.col(f"{own}row")[c].alias(c) for c in docs.columns])
