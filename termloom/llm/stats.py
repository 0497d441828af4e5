"""Document statistics as Spark expressions; the quality rules and the quality classifier both read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios that thresholds and trees see; none of them comes from labels, lang, source or doc_id.
FEATURES = ["n_words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "dup_line_share", "repeat_share", "distinct_share", "words_per_line"]


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once, not once for each use inside a lambda."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, the first occurrence included; overlaps count once.

    Windows are compared by 64-bit hash within one text. Texts whose windows all differ end there; in the others
    the windows are sorted with their places, so a text of n words takes n log n steps.
    """

    def in_order(s):
        again = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("n"))
        return F.aggregate(F.sort_array(F.transform(again, lambda x: x["p"])), start, lambda a, p: F.struct((p + 3).alias("e"), (a["n"] + p + 3 - F.greatest(a["e"], p)).alias("n")), lambda a: a["n"])

    def covered(h):
        places = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.sort_array(places), in_order))

    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    return F.when(F.size(words) >= 4, let(windows(words), covered)).otherwise(0).cast("long")


def fewer(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def split_words(text: Column) -> Column:
    """Every white space byte becomes a space first: splitting at one plain character needs no pattern matching."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the statistics of every whole text. A null text counts as empty: all its statistics are 0.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier
    line), n_repeat_words, n_upper, n_digits, n_marks, n_lines, n_distinct: all long.
    """
    t, x = F.col("_t"), F.col("_x")
    one = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    one = one.select("*", F.regexp_replace(t, r"[^A-Z0-9#*$%&|<>.,;:!?]+", "").alias("_x"))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c: c.cast("long")

    def of_words(w):
        return F.struct(long(F.size(w)).alias("n_words"), long(F.length(F.array_join(w, ""))).alias("word_chars"), repeat_words(w).alias("n_repeat_words"), long(F.size(F.array_distinct(w))).alias("n_distinct"))

    def of_lines(x):
        return F.struct(long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    def of_marks(x):
        return F.struct(*[long(fewer(x, p)).alias(n) for n, p in (("n_symbols", r"[#*$%&|<>]+"), ("n_upper", "[A-Z]+"), ("n_digits", "[0-9]+"), ("n_marks", "[.,;:!?]+"))])

    found = one.select(*keep, let(split_words(t), of_words).alias("_w"), let(lines, of_lines).alias("_l"), let(x, of_marks).alias("_m"))
    names = {"_w": ["n_words", "word_chars", "n_repeat_words", "n_distinct"], "_l": ["n_lines", "n_dup_lines"], "_m": ["n_symbols", "n_upper", "n_digits", "n_marks"]}
    return found.select(*keep, *(F.col(f"{k}.{c}") for k, v in names.items() for c in v))


def features() -> list[Column]:
    """FEATURES from the statistics; an empty text has 0 in all of them."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    share = {
        "n_words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / n, "symbol_share": F.col("n_symbols") / chars, "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars, "mark_share": F.col("n_marks") / chars, "dup_line_share": F.col("n_dup_lines") / lines, "repeat_share": F.col("n_repeat_words") / n,
        "distinct_share": F.col("n_distinct") / n, "words_per_line": F.col("n_words") / lines,
    }
    return [share[f].alias(f"f_{f}") for f in FEATURES]
