"""Line deduplication on overlapping three-line windows (operator 6), in DataFrame functions alone.

Every run of three lines is hashed; windows that stand anywhere else before
are later occurrences; the lines that later occurrences cover are removed.
Texts are read twice, and only hashes and places are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import BLANKS, column, fresh_prefix, id_column, let, text_column

WINDOW = 3


def _windows(lines: Column) -> Column:
    """``(place, h, g)`` of each window with a word: 128 bits of hash over its trimmed lines."""

    def hashed(ls: Column) -> Column:
        last = F.size(ls) - WINDOW
        every = F.transform(
            ls,
            lambda x, i: F.when(
                (i <= last) & (F.concat(x, F.get(ls, i + 1), F.get(ls, i + 2)) != ""),
                F.struct(i.alias("place"), F.xxhash64(x, F.get(ls, i + 1), F.get(ls, i + 2)).alias("h"), F.xxhash64(F.lit("second"), F.get(ls, i + 2), F.get(ls, i + 1), x).alias("g")),
            ),
        )
        return F.filter(every, lambda w: w.isNotNull())

    return let(F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS))), hashed)


def _without(lines: Column, places: Column) -> Column:
    """The lines that no window at ``places`` covers."""
    covered = F.flatten(F.transform(places, lambda p: F.sequence(p, p + WINDOW - 1)))
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    return F.transform(keep, lambda i: F.get(lines, i))


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", figures: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with repeated lines removed from the text; ``figures`` names two more columns, the numbers of lines and of removed ones.

    Lines are split at ``\\n`` and compared without surrounding blanks.  Of
    the occurrences of a window that of the smallest (doc_id, place) stays;
    windows of blank lines alone are never repeated.  Texts of fewer than
    three lines have no window and stay as they are; a very long text is taken
    whole.  Rows with the same id and text count as one document; a null text
    stays null, an empty one empty; a document of a null id is never the first
    if any other has the window, other ids must be whole numbers; an empty
    table gives an empty result; columns of any other names pass through.
    """
    raw, own = text_column(docs, text), fresh_prefix(docs)
    doc = F.coalesce(id_column(docs, doc_id), F.lit(2**63 - 1))
    windows = docs.select(doc.alias("doc"), F.xxhash64(raw).alias("text"), F.explode(_windows(F.split(raw, "\n"))).alias("w")).select("doc", "text", "w.*")
    first = windows.groupBy("h", "g").agg(F.min(F.struct("doc", "place", "text")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "g", "first")
    later = windows.join(first, ["h", "g"]).filter(~((F.col("doc") == F.col("first.doc")) & (F.col("place") == F.col("first.place")) & (F.col("text") == F.col("first.text"))))
    names = {x: own + x for x in ("d", "t", "places", "left")}
    removed = later.groupBy("doc", "text").agg(F.collect_set("place").alias("places")).select(F.col("doc").alias(names["d"]), F.col("text").alias(names["t"]), F.col("places").alias(names["places"]))
    lines, places, kept = F.split(raw, "\n"), F.col(names["places"]), F.col(names["left"])
    met = docs.join(removed, (doc == F.col(names["d"])) & (F.xxhash64(raw) == F.col(names["t"])), "left")
    out = met.withColumn(names["left"], F.when(places.isNull(), lines).otherwise(_without(lines, places)))
    more = [F.size(lines).cast("long").alias(figures[0]), (F.size(lines) - F.size(kept)).cast("long").alias(figures[1])] if figures else []
    return out.select(*[F.when(places.isNull(), column(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else column(c) for c in docs.columns], *more)
