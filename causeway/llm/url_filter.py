"""URL filtering by rules on hosts and paths (operator 4), in DataFrame functions alone.

Every URL is expanded into expressions, a suffix of its host followed by a
prefix of its path that ends in ``/``.  Expressions and rules meet in an
equi-join on the first four bytes of their SHA-256 digests; equal full digests
confirm a meeting, and the longest rule that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import column, text_column

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the prefix that the join compares.
PREFIX = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.when(_rest(url).isNotNull(), F.translate(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*", 0), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.when(_rest(url).isNotNull(), F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _suffixes(host: Column, most: int) -> Column:
    """The host and its parents, of at most ``most`` labels (as many as any rule has)."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(labels))), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))


def _prefixes(path: Column, most: int) -> Column:
    """Prefixes of the path that end in ``/``, of at most ``most`` slashes (as many as any rule has), and the empty one."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return F.transform(F.sequence(F.lit(0), F.least(F.lit(most), slashes)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), n), F.lit("/"))))


def _up_to_slash(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^.*/", 0)


def apply_rules(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id", default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages``.

    ``rules`` has host, path and verdict.  A rule fits its host and all
    subdomains of it if the URL's path starts with the rule's; the longest
    rule (host and path) wins, then that of the longest host, then block.
    Null URLs and those without ``://`` have an empty host and path, which no
    rule with a host fits; they and all URLs without a rule get ``default``.
    Null ids and repeated rows pass through; URLs of any length are judged
    whole; an empty table gives an empty result.  Rules with a null host or path
    are ignored, as are those with an empty host; an empty rule table is
    allowed.  Other columns are not read.
    """
    ruled = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").filter((F.col("rule_host") != "") & F.col("rule_path").isNotNull())
    # As many labels and slashes as the rules have: longer expressions can meet none.
    most = ruled.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.max(F.length("rule_path") - F.length(F.replace("rule_path", F.lit("/"), F.lit("")))).alias("slashes")).first()
    indexed = ruled.withColumn("digest", F.sha2(F.concat("rule_host", _up_to_slash(F.col("rule_path"))), 256)).withColumn("short", F.substring("digest", 1, PREFIX))

    split = pages.select(column(page_id).alias("page_id"), host_of(text_column(pages, url)).alias("host"), path_of(text_column(pages, url)).alias("path"))
    places = split.select("host", "path").distinct()
    expressions = (
        places.filter("host != ''")
        .select("host", "path", F.explode(_suffixes(F.col("host"), most.labels or 1)).alias("suffix"))
        .select("host", "path", F.explode(F.transform(_prefixes(F.col("path"), most.slashes or 0), lambda p: F.concat("suffix", p))).alias("expression"))
        .withColumn("full", F.sha2("expression", 256))
    )
    # Only the short prefix is a join key.  The digests, of one length, are compared afterwards, in a form that the optimizer doesn't take for another key.
    met = expressions.join(indexed, F.substring("full", 1, PREFIX) == F.col("short")).filter(F.col("full").startswith(F.col("digest")) & F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"), (F.col("verdict") == "block").cast("int"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("verdict"))
    decided = met.groupBy("host", "path").agg(F.max(rank).alias("best")).select(F.col("host").alias("h"), F.col("path").alias("p"), "best.rule", "best.verdict")
    # URLs without a host can have no rule: they stay out of the join, where they would share one key.
    judged = split.filter("host != ''").join(decided, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    return judged.unionByName(split.filter("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}))
