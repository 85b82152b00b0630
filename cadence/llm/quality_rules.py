"""Quality rules, line first: failing lines go, and a document that loses too much of its text is rejected.

All counts are of whole texts and are made by built-in functions, a row at a time, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import WORD, WORD_GAPS, let, words_of

SYMBOLS = "#*$%&|<>"
#: A line of prose has one of these somewhere.
SENTENCE_MARKS = r"[.!?:;…。！？؟।]"
#: Three or more of these in a line: a menu or a breadcrumb.
SEPARATORS = "|»›•·>"
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|privacy policy|cookie policy|terms of (?:use|service)|we use cookies|accept cookies|enable javascript"
    r"|click here to|subscribe to our|sign in to|log in to|skip to (?:main )?content|copyright \d{4}|lorem ipsum)\b"
)


def count_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among `chars`."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column, n: int) -> Column:
    """Words inside n-word windows that occur twice or more; windows are compared by 64-bit hashes of hashed words."""

    def over(hashes: Column) -> Column:
        last = F.size(hashes) - n
        windows = F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(n)))
        )
        return F.when(last < 0, F.lit(0).cast("long")).otherwise(let(windows, covered))

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(ordered, positions))

    def positions(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, k: (x.h == F.get(ordered, k + 1)["h"]).eqNullSafe(True) | ((k > 0) & (x.h == F.get(ordered, k - 1)["h"])),
        )
        return let(F.sort_array(F.transform(twice, lambda x: x.i)), total)

    def total(starts: Column) -> Column:
        spans = F.transform(starts, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(starts, k + 1) - p, F.lit(n))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(F.transform(words, lambda w: F.xxhash64(w)), over)


def judge_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    window: int = 5,
    max_lost_percent: int = 50,
    max_symbol_percent: int = 10,
    with_text: bool = False,
) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines
    (with a word), n_failed_lines, lost_chars, kept, and clean_text if `with_text`.

    A line (between line feeds) with a word fails if it has no sentence mark (punctuation), three or more menu
    separators (navigation), or a stock phrase or more than `max_symbol_percent` symbols (boilerplate). Failing lines
    are removed. base_failed: fewer than `min_words` words, or over `max_repeat_percent` of words in repeated windows.
    kept: not base_failed, and removed lines hold at most `max_lost_percent` of the characters of lines with a word.

    Lines may have any length and any number of separators. Null and empty texts have no words: counts are 0, base_failed is true. Repeated rows are judged each; null ids
    stay null. Further columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))

    def fails(line: Column) -> Column:
        # counted, not matched: a repeated group in a Java pattern recurses once a repetition and overflows the stack
        return (
            ~line.rlike(SENTENCE_MARKS) | (count_of(line, SEPARATORS) >= 3) | line.rlike(BOILERPLATE)
            | (count_of(line, SYMBOLS) * 100 > F.length(line) * max_symbol_percent)
        )

    def chars(array: Column) -> Column:
        return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + F.length(x))

    figures = let(
        words_of(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w, window).alias("n_repeat_words")),
    )
    line_figures = let(
        lines,
        lambda x: let(
            F.filter(x, fails),
            lambda bad: F.struct(
                F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.size(bad).alias("n_failed_lines"), chars(x).alias("line_chars"), chars(bad).alias("lost_chars"),
            ),
        ),
    )
    out = base.select(
        "id", "text", figures.alias("w"), line_figures.alias("l"), count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.length(F.translate("text", WORD_GAPS, "")).cast("long").alias("word_chars"),
    )
    failed = (F.col("w.n_words") < min_words) | (F.col("w.n_repeat_words") * 100 > F.col("w.n_words") * max_repeat_percent)
    kept = ~failed & (F.col("l.lost_chars") * 100 <= F.col("l.line_chars") * max_lost_percent)
    cols = [
        F.col("id").alias(id_col), F.col("w.n_words").alias("n_words"), "word_chars", "n_symbols", F.col("l.n_dup_lines").alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"), failed.alias("base_failed"), F.col("l.n_lines").alias("n_lines"),
        F.col("l.n_failed_lines").alias("n_failed_lines"), F.col("l.lost_chars").alias("lost_chars"), kept.alias("kept"),
    ]
    if with_text:
        clean = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~(x.rlike(WORD) & fails(x))), "\n")
        cols.append(clean.alias("clean_text"))
    return out.select(*cols)
