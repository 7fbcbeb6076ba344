"""Benchmark decontamination by seeds and local alignment (operator 9).

The rare word 3-grams of each benchmark item are its seeds: those in few
items, and an item's next least frequent ones until it has so many that two
are left wherever a fifth of its words are changed (items of one template
share most of theirs).  Frequency in the training texts doesn't count, as a
leaked passage may stand in a third of them.

Texts are read once.  A filter of the seeds' hashes picks the places that may
be seeds; these join the table of seeds, and where several seeds of an item
stand close together, text and item meet for Smith-Waterman alignment, which
scores the copy, edited or not.  The filter has a bounded size: the more seeds
it must hold, the more places pass it, and the join decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import drop_path, fresh_prefix, id_column, map_rows, text_column, words_of, written

#: A seed is rare if so many items have it.
RARE_ITEMS = 3
#: Alignment: match, mismatch, gap.
MATCH, MISMATCH, GAP = 1, -1, -1
#: Bits of the filter for each seed, at most in all (32 MB), and places that a seed sets.
FILTER_BITS, FILTER_MOST, PROBES = 64, 1 << 28, 4
#: Words whose hashes a worker remembers; beyond it they are forgotten.
REMEMBERED = 300_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def align(region: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local score of an item in a region, and its start and end there."""
    best, end = _best(region, item)
    if best <= 0:
        return 0, 0, 0
    back, length = _best(region[:end][::-1], item[::-1])
    return best, end - length, end


def _best(region: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """The highest local score and the first place in the region where it ends."""
    n = len(region)
    steps = np.arange(n + 1) * -GAP
    above, best, end = np.zeros(n + 1, np.int64), 0, 0
    for w in item.tolist():
        now = np.zeros(n + 1, np.int64)
        now[1:] = np.maximum(above[:-1] + np.where(region == w, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + steps) - steps  # gaps along the region
        at = int(now.argmax())
        if now[at] > best:
            best, end = int(now[at]), at
        above = now
    return best, end


def copies(ids: np.ndarray, item: np.ndarray, places: list[int], size: int, least: float) -> Iterator[tuple[float, int, int]]:
    """Score (share of the item's own), first word and end of every copy of an item around the places of its seeds in a text.

    An alignment that scores enough is at most ``reach`` words long, so the
    regions around the seeds are searched in windows of three such lengths, and
    the work grows with their length.
    """
    reach, need = len(item) + len(item) // 2, min(2, max(1, len(item) - size + 1))
    places, regions = sorted(set(places)), []
    for a in range(len(places) - need + 1):
        if places[a + need - 1] - places[a] <= reach:
            start, end = max(0, places[a] - reach), min(len(ids), places[a + need - 1] + reach)
            if regions and start <= regions[-1][1]:
                regions[-1][1] = end
            else:
                regions.append([start, end])
    todo = regions[::-1]
    while todo:
        start, end = todo.pop()
        if end - start < 1:
            continue
        stop = min(end, start + 3 * reach)
        score, i, j = align(ids[start:stop], item)
        if score < least * len(item):
            if stop < end:  # what begins in the last third of the window may end beyond it
                todo.append([stop - reach, end])
            continue
        if stop < end and start + j > stop - reach:  # it may go on beyond the window
            if i > reach:
                todo.append([start + i - reach, end])
                todo.append([start, start + i])
                continue
            score, i, j = align(ids[start : start + 4 * reach], item)
        # Other copies may stand on either side.
        todo.append([start + j, end])
        todo.append([start, start + i])
        yield score / len(item), start + i, start + j


def _hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words."""
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _seeds(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each run of ``size`` words; none for fewer words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _lowered(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def _items(benchmark: DataFrame, text: str, item_id: str) -> DataFrame:
    """``(item, words, item_id)``: the distinct items, ``item`` a hash of their words."""
    words = words_of(F.translate(text_column(benchmark, text), UPPER, LOWER))
    every = benchmark.select(F.array_join(words, " ").alias("words"), id_column(benchmark, item_id).alias("item_id")).filter("words != ''")
    return every.groupBy("words").agg(F.min("item_id").alias("item_id")).select(F.xxhash64("words").alias("item"), "words", "item_id")


def _chosen_seeds(items: DataFrame, size: int) -> DataFrame:
    """``(seed, size, item)``: the seeds that are looked for, each with the items it leads to."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode("utf-8").split(b" ")
                own = min(size, len(words))
                # A changed word touches as many seeds as a seed has words.
                enough = min(len(words) - own + 1, 2 + size * -(-len(words) // 5))
                yield [(item, s, own, enough) for s in _seeds(_hashes(words, {}), own).view(np.int64).tolist()]

    held = map_rows(items.select("item", "words"), rows, "item long, seed long, size int, enough int")
    found = held.select("item", "seed").distinct().groupBy("seed").agg(F.count("*").alias("found"))
    ranked = held.join(found, "seed").withColumn("at", F.row_number().over(Window.partitionBy("item").orderBy("found")))
    limit = ranked.filter("at = enough").select("item", F.greatest("found", F.lit(RARE_ITEMS)).alias("most"))
    return ranked.join(limit, "item").filter("found <= most").select("seed", "size", "item").distinct()


def _probes(seeds: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The places of seeds in a filter of ``bits`` bits, a power of two."""
    for k in range(PROBES):
        yield (seeds >> np.uint64(9 * k)) & np.uint64(bits - 1)


def _filter(seeds: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the seeds' hashes."""
    bits = min(FILTER_MOST, 1 << max(10, (FILTER_BITS * count - 1).bit_length()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        own = np.zeros(bits, bool)
        for batch in batches:
            for at in _probes(batch.column(0).to_numpy().view(np.uint64), bits):
                own[at] = True
        yield [(zstandard.ZstdCompressor(level=1).compress(np.packbits(own, bitorder="little").tobytes()),)]

    out = np.zeros(bits // 8, np.uint8)
    for part in map_rows(seeds.select("seed"), rows, "part binary").toLocalIterator():
        out |= np.frombuffer(zstandard.ZstdDecompressor().decompress(part.part), np.uint8)
    return out


def _met(texts: DataFrame, seeds: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``texts`` (key, text) with places that may hold a copy: ``(key, text, seeds array<long>, places array<int>)``."""
    count, sizes = seeds.agg(F.count("*"), F.sort_array(F.collect_set("size"))).first()
    own = F.size(F.split("words", " "))
    longest, shortest = items.agg(F.max(own), F.min(own)).first()
    if not count:
        return texts.select("key", "text", F.array().cast("array<long>").alias("seeds"), F.array().cast("array<int>").alias("places")).filter(F.lit(False))
    shared = texts.sparkSession.sparkContext.broadcast(_filter(seeds, count))
    # An item of several seeds must have two of them close together.
    reach, alone = longest + longest // 2, shortest <= max(sizes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        bitmap, known = shared.value, {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                piece, out = batch.slice(i, 256), []
                if len(known) > REMEMBERED:
                    known.clear()
                for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    hashes, found, at = _hashes(_lowered(text), known), [], []
                    for size in sizes:
                        s = _seeds(hashes, size)
                        left = np.arange(len(s))
                        for place in _probes(s, len(bitmap) * 8):
                            place = place[left]
                            left = left[(bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                        found.append(s[left].view(np.int64))
                        at.append(left)
                    at = np.concatenate(at)
                    ordered = np.sort(at)
                    if len(at) and (alone or (np.diff(ordered) <= reach).any()):
                        out.append((key, text, np.concatenate(found).tolist(), at.tolist()))
                yield out

    return map_rows(texts, rows, "key long, text string, seeds array<long>, places array<int>")


def _found(met: DataFrame, seeds: DataFrame, items: DataFrame, seed_words: int, least: float) -> DataFrame:
    """``(h, g, item_id, score, start_word, end_word, passage)`` of each copy in each distinct text, the text by 128 bits of hash."""
    texts = met.select(*_text_hashes(), "text", "seeds", "places").dropDuplicates(["h", "g"])
    hits = texts.select("h", "g", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("h", "g", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    near = hits.join(seeds.select("seed", "item"), "seed").groupBy("h", "g", "item").agg(F.collect_set("place").alias("at"))
    pairs = near.join(items, "item").filter((F.size("at") > 1) | (F.size(F.split("words", " ")) <= seed_words))
    both = pairs.join(texts.select("h", "g", "text"), ["h", "g"]).select("h", "g", "item_id", "words", "at", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            for k in range(batch.num_rows):
                h, g, item_id, words, at, text = (c[k].as_py() for c in batch.columns)
                raw, wanted = text.encode("utf-8"), words.encode("utf-8").split(b" ")
                number = {w: n + 1 for n, w in enumerate(dict.fromkeys(wanted))}
                get = number.get
                ids = np.array([get(w, 0) for w in raw.lower().split()], np.int64)
                item = np.array([number[w] for w in wanted], np.int64)
                plain = raw.split()
                yield [(h, g, item_id, score, start, end, b" ".join(plain[start:end]).decode("utf-8")) for score, start, end in copies(ids, item, at, seed_words, least)]

    return map_rows(both, rows, "h long, g long, item_id long, score double, start_word long, end_word long, passage string")


def _text_hashes() -> list:
    return [F.xxhash64("text").alias("h"), F.xxhash64(F.lit("second"), "text").alias("g")]


def _search(texts: DataFrame, benchmark: DataFrame, item_text: str, item_id: str, seed_words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows of ``texts`` (key, text) that may hold copies as ``(key, h, g)``, and the copies of each distinct text; both written."""
    spark = texts.sparkSession
    items = written(_items(benchmark, item_text, item_id), "items")
    seeds = written(_chosen_seeds(items, seed_words), "seeds")
    met = written(_met(texts, seeds, items), "seed-places")
    found = written(_found(met, seeds, items, seed_words, least), "copies")
    rows = written(met.select("key", *_text_hashes()), "texts-met")
    for table in (items, seeds, met):
        drop_path(spark, table._scratch_path)
    return rows, found


def find_copies(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", seed_words: int = 3, least: float = 0.5) -> DataFrame:
    """``(doc_id, item_id, score, start_word, end_word, passage)``, a row for each copy of an item in a whole text.

    Words are lower-cased (A-Z).  score: alignment score as a share of the
    item's own, ``least`` at least.  Items with the same words count as one,
    under their smallest id.  Null and blank texts and items have no copies;
    very long texts are searched whole, in windows around seeds; null ids are
    kept, other ids must be whole numbers; repeated rows each give their rows;
    empty tables give an empty result; other columns are not read.
    """
    texts = docs.select(id_column(docs, doc_id).alias("key"), text_column(docs, text).alias("text"))
    rows, found = _search(texts, benchmark, item_text, item_id, seed_words, least)
    return rows.join(found, ["h", "g"]).select(F.col("key").alias("doc_id"), "item_id", "score", "start_word", "end_word", "passage")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", seed_words: int = 3, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that hold a copy of an item, found as by ``find_copies``; all columns of the rest, whatever their names."""
    texts = docs.select(F.lit(None).cast("long").alias("key"), text_column(docs, text).alias("text"))
    _, found = _search(texts, benchmark, item_text, item_id, seed_words, least)
    own = fresh_prefix(docs)
    gone = found.select(F.col("h").alias(f"{own}h"), F.col("g").alias(f"{own}g")).distinct()
    here = text_column(docs, text)
    return docs.join(gone, (F.xxhash64(here) == F.col(f"{own}h")) & (F.xxhash64(F.lit("second"), here) == F.col(f"{own}g")), "left_anti")
