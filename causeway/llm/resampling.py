"""Target-distribution importance resampling (operator 13).

Hashed word and word-pair counts of a raw and a target corpus give each bucket
a gain, the log ratio of its smoothed shares.  A document's weight is the mean
gain of its features; weights plus Gumbel noise, the highest first, are a draw
without replacement in proportion to the importance weights.

Higher-order functions make a document's array of buckets within its row, and
``aggregate`` over ``element_at`` of an array literal scores it, so features
are never rows of their own on the way to a score.  What is shuffled are
totals: of each task's buckets, and of ranges of scores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import drop_path, id_column, let, text_column, written

BUCKETS = 10_000
#: What lies between words, once A-Z are lower case: ASCII that is neither a digit nor a letter.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Whole scores that make a range, whose sizes are added up in one window.
LEVELS = 256


def words_of(text: Column) -> Column:
    """Words of a whole text; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN)
    return F.filter(parts, lambda w: w != "")


def buckets_of(words: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of every word, then of every pair of neighbours, repeats included."""
    bucket = lambda feature: (F.crc32(feature.cast("binary")) % buckets).cast("short" if buckets <= 1 << 15 else "int")
    following = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.filter(F.zip_with(words, following, lambda a, b: bucket(F.concat(a, F.lit(" "), b))), lambda x: x.isNotNull())
    return F.concat(F.transform(words, bucket), pairs)


def bucket_totals(arrays: DataFrame, name: str, buckets: int = BUCKETS) -> list[int]:
    """How often each bucket stands in the column ``name``; tasks add up their own rows before anything is shuffled."""
    counts = arrays.select(F.explode(name).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    out = [0] * buckets
    for b, n in counts.collect():  # a row for each bucket at most
        out[b] = n
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """``floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))`` for each bucket."""
    b, s_all, t_all = len(raw), sum(raw), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(raw, target)]


def gumbel(doc_id: Column, seed: int = 7) -> Column:
    """Noise ``floor(-1000 ln(-ln u))``, u from the hash of ``<seed>:<doc_id>`` alone; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)``, one row per document.

    Weight: the floored mean gain of a document's features, 0 without any
    (null, blank and wordless texts).  Score: weight plus noise that depends
    on the id alone, so rows of one id share it.  Counts cover all documents
    and all target texts; an empty target counts as no features, an empty
    table gives an empty result.  Texts of any length are taken whole; other
    columns are not read; ids are whole numbers or null.
    """
    # Words are made once a row, and the buckets written once for both passes over them.
    words = docs.select(id_column(docs, doc_id).alias("doc_id"), words_of(text_column(docs, text)).alias("w"))
    made = let(F.col("w"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), buckets_of(w, buckets).alias("buckets")))
    held = written(words.select("doc_id", made.alias("x")).select("doc_id", "x.n_words", "x.buckets"), "resampling-buckets")
    aims = target.select(let(words_of(text_column(target, target_text)), lambda w: buckets_of(w, buckets)).alias("buckets"))
    gain = gains(bucket_totals(held, "buckets", buckets), bucket_totals(aims, "buckets", buckets))
    # One string, which is folded into an array literal before the job runs.
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")
    n = F.size("buckets").cast("long")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(literal, b.cast("int") + 1))
    summed = held.select("doc_id", "n_words", n.alias("n_features"), total.alias("total"))
    # Whole-number division that goes down for negative sums, too.
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    out = written(summed.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "resampling-scores")
    drop_path(docs.sparkSession, held._scratch_path)
    return out


def draw(scored: DataFrame, share: tuple[int, int] = (25, 100), min_words: int = 20) -> DataFrame:
    """``scored``'s rows with ``rank``: 1, 2, 3 ... for the drawn ones, the highest scores; null for the others.

    Of the N rows with at least ``min_words`` words, floor(N * share) are
    drawn; equal scores go by the smaller id, null ids last.  Scores are whole
    numbers: each is a level, ranked within itself, to which the sizes of the
    levels above are added.  Rows that are alike in all columns are one row
    with their number until they have been ranked, so that no level grows with
    copies; rows of one score and id, but other features, get neighbouring ranks in any order.
    """
    spark, given = scored.sparkSession, scored.columns
    classes = written(scored.groupBy(*given).agg(F.count("*").alias("rows")), "resampling-classes")
    open_ = classes.filter(F.col("n_words") >= min_words)
    levels = open_.groupBy("score").agg(F.sum("rows").alias("held")).withColumn("range", F.floor(F.col("score") / LEVELS))
    ranges = levels.groupBy("range").agg(F.sum("held").alias("all"))
    # A row for each range of levels: this window is small whatever the table.
    above = ranges.select("range", F.coalesce(F.sum("all").over(Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    within = F.coalesce(F.sum("held").over(Window.partitionBy("range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = levels.withColumn("within", within).join(above, "range").select(F.col("score").alias("level"), (F.col("within") + F.col("above")).alias("start"))
    own = F.coalesce(F.sum("rows").over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = share[0] * (open_.agg(F.sum("rows")).first()[0] or 0) // share[1]
    each = open_.withColumn("own", own).join(starts, F.col("score") == F.col("level")).select(*given, (F.col("start") + F.col("own")).alias("first"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("i"))
    ranked = each.select(*given, F.when(F.col("first") + F.col("i") <= wanted, F.col("first") + F.col("i")).alias("rank"))
    others = classes.filter(F.col("n_words") < min_words).select(*given, F.lit(None).cast("long").alias("rank"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("i")).drop("i")
    out = written(ranked.unionByName(others), "resampled")
    drop_path(spark, classes._scratch_path)
    return out
