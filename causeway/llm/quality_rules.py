"""Line-first quality rules (operator 1), in DataFrame functions alone.

Each line is judged by punctuation, navigation and boilerplate rules; lines
that fail are removed; a document that loses too much of its text is rejected.
Everything is computed within a row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import BLANKS, column, fresh_prefix, let, words_of

SYMBOLS = "#*$%&|<>"
#: Marks that end a sentence, possibly within quotes or brackets.
ENDS = r"[.!?:;。！？…][\"'”’»)\]]*$"
#: Phrases of pages' surroundings.
BOILERPLATE = r"(?i)\b(?:(?:accept|use|uses|using) (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|lorem ipsum|sign up for our newsletter|click here to)\b"


def _count(line: Column, what: str) -> Column:
    return (F.char_length(line) - F.char_length(F.replace(line, F.lit(what), F.lit("")))) / len(what)


def bad_line(line: Column, max_symbols: float = 0.3, max_shouts: float = 0.3, min_bars: int = 2, short: int = 10) -> Column:
    """Whether a line fails a rule; blank lines pass.

    Punctuation: symbols, or doubled exclamation marks, for over
    ``max_symbols`` / ``max_shouts`` of its words; or under ``short`` words
    and no mark that ends a sentence.  Navigation: ``min_bars`` bars or more,
    one for every three words at least.  Boilerplate: a phrase of pages'
    surroundings, or 20 words and more of which under a tenth are different.
    """

    def judged(words: Column) -> Column:
        n, trimmed = F.size(words), F.btrim(line, F.lit(BLANKS))
        bars = _count(line, "|")
        symbols = F.char_length(line) - F.char_length(F.translate(line, SYMBOLS, ""))
        return (n > 0) & (
            (symbols > max_symbols * n)
            | (_count(line, "!!") > max_shouts * n)
            | ((n < short) & ~trimmed.rlike(ENDS))
            | ((bars >= min_bars) & (3 * bars >= n))
            | trimmed.rlike(BOILERPLATE)
            | ((n >= 20) & (10 * F.size(F.array_distinct(words)) < n))
        )

    return let(words_of(line), judged)


def repeated_window_words(words: Column) -> Column:
    """Words within 3-word windows that a text holds twice or more, the first included.

    Each window becomes one number: the upper bits of its hash, the lower its
    place (as many bits as the text needs).  After sorting, equal windows are
    neighbours.  Two different windows of a text of n words are taken for
    equal with a probability of n / 2**64 (at 1,000 words, 5e-17 a pair).
    """

    def packed(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w).cast("long")))
        place_mask = F.pow(F.lit(2.0), bits).cast("long") - 1

        def sized(b: Column) -> Column:
            keys = F.transform(w, lambda x, i: F.coalesce(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(b)).bitwiseOR(i.cast("long")), F.lit(0).cast("long")))
            ordered = F.sort_array(F.slice(keys, F.lit(1), F.size(w) - 2))

            def places(s: Column) -> Column:
                upper = F.bitwise_not(b)
                same = lambda x, y: x.bitwiseXOR(F.coalesce(y, F.bitwise_not(x))).bitwiseAND(upper) == 0
                # A window is taken if a neighbour has its hash; what is beyond either end differs.
                taken = F.filter(s, lambda x, i: same(x, F.when(i > 0, F.get(s, i - 1))) | same(x, F.get(s, i + 1)))
                starts = F.sort_array(F.transform(taken, lambda x: x.bitwiseAND(b)))
                start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
                step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n"), p.alias("last"))
                return F.aggregate(starts, start, step, lambda a: a["n"])

            return let(ordered, places)

        return let(place_mask, sized)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(packed(words))


def verdict(text: Column, max_lost: float = 0.3) -> Column:
    """A struct of a text's figures, its verdict and its cleaned text; see ``judge``."""

    def by_lines(ls: Column) -> Column:
        worded = F.filter(ls, lambda x: F.btrim(x, F.lit(BLANKS)) != "")

        def cleaned(good: Column) -> Column:
            return F.struct(
                (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
                F.size(ls).cast("long").alias("n_lines"),
                (F.size(ls) - F.size(good)).cast("long").alias("n_bad_lines"),
                (F.char_length(F.array_join(ls, "")) - F.char_length(F.array_join(good, ""))).cast("long").alias("lost_chars"),
                F.array_join(good, "\n").alias("clean_text"),
            )

        return let(F.filter(ls, lambda x: ~bad_line(x)), cleaned)

    def judged(v: Column) -> Column:
        base = (v["words"]["n"] < 50) | (100 * v["words"]["again"] > 50 * v["words"]["n"])
        kept = ~base & (v["lines"]["lost_chars"] <= max_lost * v["n_chars"])
        return F.struct(
            v["words"]["n"].alias("n_words"),
            v["word_chars"].alias("word_chars"),
            v["n_symbols"].alias("n_symbols"),
            v["lines"]["n_dup_lines"].alias("n_dup_lines"),
            v["words"]["again"].alias("n_repeat_words"),
            base.alias("base_failed"),
            kept.alias("kept"),
            *[v["lines"][c].alias(c) for c in ("n_lines", "n_bad_lines", "lost_chars", "clean_text")],
        )

    def measured(t: Column) -> Column:
        return let(
            F.struct(
                F.char_length(t).alias("n_chars"),
                F.char_length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
                (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_window_words(w).alias("again"))).alias("words"),
                let(F.split(t, "\n"), by_lines).alias("lines"),
            ),
            judged,
        )

    return let(F.coalesce(text.cast("string"), F.lit("")), measured)


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_lost: float = 0.3) -> DataFrame:
    """One row per document: its figures, its verdict and its cleaned text.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_lines, n_bad_lines, lost_chars,
    clean_text.  ``kept`` is false for under 50 words, for more than half of
    the words in repeated windows, or if the lines that fail hold over
    ``max_lost`` of the text's characters.  A null text counts as empty (and
    is not kept); a text of any length is judged whole; null ids and repeated
    rows pass through; an empty table gives an empty result; other columns are
    not read.
    """
    return docs.select(column(doc_id).alias("doc_id"), verdict(column(text), max_lost).alias("v")).select("doc_id", "v.*")


def clean(docs: DataFrame, text: str = "text", max_lost: float = 0.3) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns and their cleaned text in place of the text.

    Null and empty texts are not kept; other columns, nulls in them included,
    pass through whatever their names; repeated rows are judged each; an empty
    table gives an empty result.
    """
    # A filter on the verdict would be pushed below it and work it out twice.
    own = f"{fresh_prefix(docs)}text"
    kept = let(verdict(column(text), max_lost), lambda v: F.when(v["kept"], F.array(v["clean_text"])).otherwise(F.array().cast("array<string>")))
    return docs.select("*", F.explode(kept).alias(own)).select(*[F.col(own).alias(c) if c == text else column(c) for c in docs.columns])
