"""License scans (operator 10), in DataFrame functions alone.

The lines of files, the openings of licence files and the whole texts of
licence files are compared with templates by the cosine of sparse TF-IDF
vectors.  Files without a licence of their own inherit that of the licence
file in their nearest directory upwards.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import BLANKS, column, fresh_prefix, text_column, written
from causeway.llm.license_texts import GENERIC, NOTICES, TEXTS
from causeway.llm.url_filter import LOWER, UPPER

#: Names of licence files.
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice|unlicense)[^/]*$"
#: A tag that names the licence.
TAG = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?: (?:AND|OR|WITH) [A-Za-z0-9.+-]+)*)"
#: Words that any text may have; they are no terms.
COMMON = ["a", "an", "and", "any", "are", "as", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with"]
#: What decides first: a tag, a whole text, a line or an opening, a line that several licences share.
BY_TAG, BY_TEXT, BY_NOTICE, BY_GENERIC = 4, 3, 2, 1

#: A line of a licence file speaks for it if it is one in so many of its characters.
COVERED = 20

Template = tuple[str, str, int]  # licence, text, rank
LINE_TEMPLATES: list[Template] = [(name, t, BY_NOTICE) for name, t in NOTICES] + [(name, t, BY_GENERIC) for name, t in GENERIC]
TEXT_TEMPLATES: list[Template] = [(name, t, BY_TEXT) for name, t in TEXTS]


def _terms(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t and t not in COMMON]


class Templates:
    """TF-IDF vectors of the templates; terms in none of them weigh as much as a term in none can."""

    def __init__(self, templates: list[Template], least: float) -> None:
        n = len(templates)
        held = [Counter(_terms(t)) for _, t, _ in templates]
        df = Counter(t for h in held for t in h)
        self.idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
        self.unknown = math.log(1 + n) + 1
        self.rows, heavy = [], set()
        for k, ((name, _, rank), counts) in enumerate(zip(templates, held)):
            weight = {t: c * self.idf[t] for t, c in counts.items()}
            norm = math.sqrt(sum(w * w for w in weight.values()))
            self.rows += [(k, name, rank, t, w / norm, self.idf[t]) for t, w in weight.items()]
            # A text that has only terms whose weights together stay under ``least`` can't reach it.
            light = 0.0
            for t, w in sorted(weight.items(), key=lambda x: (x[1], x[0])):
                light += (w / norm) ** 2
                if light >= least * least * (1 - 1e-9):
                    heavy.add(t)
        by_letter = {t[0]: sorted(x[1:] for x in heavy if x[0] == t[0]) for t in sorted(heavy)}
        self.heavy = rf"(?i)(?<![A-Za-z0-9])(?:{'|'.join(f'{a}(?:{"|".join(rest)})' for a, rest in by_letter.items())})(?![A-Za-z0-9])"


def match_texts(texts: DataFrame, least: float = 0.6, templates: list[Template] | None = None, text: str = "unit") -> DataFrame:
    """``(unit, rank, license, score)``: the best template of each distinct text among those with a cosine of ``least`` or more.

    Templates of a higher rank go first, then those of a higher cosine, then
    the first.  Null texts match nothing.
    """
    vectors = Templates(templates or LINE_TEMPLATES, least)
    spark = texts.sparkSession
    table = spark.createDataFrame(vectors.rows, "template int, license string, rank int, term string, share double, idf double")
    idf = table.select("term", "idf").distinct()
    # Terms carry 128 bits of hash in place of their text.
    units = texts.select(F.col(text).alias("unit")).filter("unit is not null").distinct().select("unit", F.xxhash64("unit").alias("h"), F.xxhash64(F.lit("second"), "unit").alias("g"))
    split = units.select("h", "g", F.explode(F.split(F.translate("unit", UPPER, LOWER), "[^a-z0-9]+")).alias("term"))
    terms = split.filter((F.col("term") != "") & ~F.col("term").isin(COMMON)).groupBy("h", "g", "term").agg(F.count("*").alias("tf"))
    weighed = terms.join(F.broadcast(idf), "term", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.lit(vectors.unknown))).drop("idf")
    norms = weighed.groupBy("h", "g").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = weighed.join(F.broadcast(table.drop("idf")), "term").groupBy("h", "g", "template", "license", "rank").agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    scored = dots.join(norms, ["h", "g"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("score") >= least)
    best = scored.groupBy("h", "g").agg(F.max(F.struct("rank", "score", -F.col("template"), "license")).alias("best"))
    return units.join(best, ["h", "g"]).select("unit", "best.rank", "best.license", "best.score")


def directory_of(path: Column) -> Column:
    """What stands before the last ``/``; empty at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/", 1)


def _ancestors(directory: Column) -> Column:
    """``(depth, directory)`` of a directory and all above it; the top is empty, of depth 0."""
    parts = F.split(directory, "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))
    top = F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above")))
    return F.when(directory == "", top).otherwise(F.concat(top, below))


def _units(text: Column, holder: Column, heavy: str) -> Column:
    """What is compared of a file, as ``(rank, unit)``: its tag, lines with a term heavy enough and, of a licence file, its opening (the first two lines with a word) and the whole text.

    A line of a licence file must be a ``COVERED``-th of it: in a long licence
    text single lines are quotations and phrases that other licences share.
    """
    lines = F.split(text, "\n")
    worded = F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    opening = F.when(holder & (F.size(worded) > 1), F.array(F.array_join(F.slice(worded, 1, 2), " "))).otherwise(F.array().cast("array<string>"))
    speaking = F.filter(lines, lambda x: ~holder | (COVERED * F.char_length(x) >= F.char_length(text)))
    notices = F.filter(F.array_distinct(F.concat(speaking, opening)), lambda x: x.rlike(heavy))
    tag = F.filter(F.array(F.regexp_extract(text, TAG, 1)), lambda x: x != "")
    whole = F.when(holder & (F.size(worded) > 0), F.array(text)).otherwise(F.array().cast("array<string>"))
    ranked = lambda units, rank: F.transform(units, lambda x: F.struct(F.lit(rank).alias("rank"), x.alias("unit")))
    return F.when(holder | text.rlike(heavy) | text.contains("SPDX-License-Identifier:"), F.concat(ranked(tag, BY_TAG), ranked(whole, BY_TEXT), ranked(notices, BY_NOTICE)))


def scan(files: DataFrame, least: float = 0.6, path: str = "path", text: str = "text", notices: list[Template] | None = None, texts: list[Template] | None = None) -> DataFrame:
    """``files`` with own_license, score, inherited_license, inherited_from and license; a row for each row.

    A file's own licence is that of its first tag (score 1), else that of the
    whole text if it is a licence file, else the best match of its lines and,
    in a licence file, of its opening; lines of a licence file count only if
    they are a twentieth of it or more.  The licence file of a directory with
    several is that of the highest rank and score, then of the smallest path.
    ``license`` is the file's own, else the inherited one, else null.

    Null and empty texts have no licence of their own; texts of any length are
    looked at whole.  Rows of one path are one file with all their texts.  A
    row of a null path is a file of its own text in no directory: nothing is
    inherited to or from it, and rows of the same text are alike.  An empty
    table gives an empty result.  Other columns pass through; those named like
    a result are replaced.
    """
    vectors = Templates(notices or LINE_TEMPLATES, least)
    own = fresh_prefix(files)
    results = ["own_license", "score", "inherited_license", "inherited_from", "license"]
    # A file is its path or, without one, a hash of its text.
    named = files.withColumns({f"{own}path": column(path).cast("string"), f"{own}text": text_column(files, text)}).withColumn(f"{own}key", F.when(column(path).isNull(), F.concat(F.lit("\0"), F.xxhash64(text_column(files, text)).cast("string"))).otherwise(F.col(f"{own}path")))
    narrow = named.select(F.col(f"{own}key").alias("file"), F.col(f"{own}path").alias("path"), F.col(f"{own}text").alias("text"))
    holder = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    # Few lines are left; they are written once, as texts would be read again for each use below.
    units = written(narrow.select("file", "path", F.explode_outer(_units(F.col("text"), holder, vectors.heavy)).alias("u")).select("file", "path", "u.rank", "u.unit"), "license-lines")
    # Files without such a line have a null unit; only the others take part in the joins, whose other side is written so that Spark knows its size and can split a frequent line's partition.
    some = lambda rank: units.filter((F.col("rank") == rank) & F.col("unit").isNotNull())
    found = written(match_texts(some(BY_NOTICE), least, notices).union(match_texts(some(BY_TEXT), least, texts or TEXT_TEMPLATES)).withColumn("as", F.when(F.col("rank") == BY_TEXT, BY_TEXT).otherwise(BY_NOTICE)), "license-matches")
    matched = units.filter(F.col("rank").isin(BY_TEXT, BY_NOTICE)).withColumnRenamed("rank", "as").join(found, ["as", "unit"]).select("file", "rank", "score", "license")
    tagged = some(BY_TAG).select("file", "rank", F.lit(1.0).alias("score"), F.col("unit").alias("license"))
    hits = matched.union(tagged).groupBy("file").agg(F.max(F.struct("rank", "score", "license")).alias("best"))
    placed = units.select("file", "path").distinct().join(hits, "file", "left").select("file", "path", F.col("best.rank").alias("rank"), F.col("best.license").alias("own_license"), F.col("best.score").alias("score"), directory_of(F.col("path")).alias("directory"))
    holders = placed.filter(F.col("own_license").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy("directory").agg(F.min(F.struct(-F.col("rank"), -F.col("score"), "path", "own_license")).alias("holder")).select(F.col("directory").alias("above"), F.col("holder.path").alias("inherited_from"), F.col("holder.own_license").alias("inherited_license"))
    # Each directory looks upwards once, however many files it has.
    nearest = (
        placed.filter("path is not null")
        .select("directory")
        .distinct()
        .select("directory", F.explode(_ancestors(F.col("directory"))).alias("a"))
        .select("directory", "a.depth", "a.above")
        .join(holders, "above")
        .groupBy("directory")
        .agg(F.max(F.struct("depth", "inherited_from", "inherited_license")).alias("n"))
        .select(F.col("directory").alias("d"), "n.inherited_from", "n.inherited_license")
    )
    judged = placed.join(nearest, F.col("directory") == F.col("d"), "left").select(F.col("file").alias(f"{own}file"), *[F.col(c).alias(own + c) for c in results[:4]], F.coalesce("own_license", "inherited_license").alias(f"{own}license"))
    kept = [c for c in files.columns if c.lower() not in results]
    return named.select(*[column(c) for c in kept], F.col(f"{own}key")).join(judged, F.col(f"{own}key") == F.col(f"{own}file"), "left").select(*[column(c) for c in kept], *[F.col(own + c).alias(c) for c in results])
