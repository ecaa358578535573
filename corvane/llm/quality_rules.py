"""Quality rules: a table of thresholds compiled into one projection of Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACES, WORD, let, named_apart, without

#: Characters that count as symbols; fixed value.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = (
    "the of and to in is that for it with as on be this are by from not was or "
    "der die das und in den von zu mit sich des ist im dem nicht ein eine auf für als "
    "le la les de des et un une du en est que qui dans pour par sur au avec pas "
    "el la los las de que y en un una del se por con no para su al como más"
).split()


class Rule(NamedTuple):
    """A measure and the range it must lie in; None leaves a side open."""

    name: str
    measure: str
    least: float | None
    most: float | None


#: Measures are the columns of measured(); a text passes if every rule holds.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.3),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("dup_lines", "dup_line_ratio", None, 0.3),
)


def _stats(text: Column) -> Column:
    """A struct of counts of one text. Words and lines are made once and bound, as lambdas inside use them often."""

    def of_words(words: Column) -> Column:
        n = F.size(words)
        # 64 bits of hash tell a text's windows apart: a million of them collide with a chance of 3e-8
        window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
        windows = F.when(n < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window)))

        def starts(ordered: Column) -> Column:
            """Positions, ascending, of windows that have an equal one beside them in the order."""
            same = lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"])
            return F.array_sort(F.transform(F.filter(ordered, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))

        def covered(at: Column) -> Column:
            """Words in windows of three that begin at these positions."""
            steps = F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(3)), F.lit(3)))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        stop = F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))
        return F.struct(n.cast("long").alias("n_words"), let(let(windows, starts), covered).alias("n_repeat_words"), F.size(stop).cast("long").alias("n_stop_words"))

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)


def _lines(text: Column) -> Column:
    worded = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(worded, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts and ratios that rules may name. A ratio whose denominator is 0 is 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = lambda chars: F.octet_length(text) - F.octet_length(without(text, chars))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    words, lines = named_apart(docs.columns, "_words", "_lines")
    counts = docs.withColumns({words: _stats(text), lines: _lines(text), "n_symbols": gone(SYMBOLS).cast("long"), "word_chars": (F.char_length(text) - gone(SPACES)).cast("long")})
    counts = counts.withColumns({k: F.col(f"{words}.{k}") for k in ("n_words", "n_repeat_words", "n_stop_words")} | {k: F.col(f"{lines}.{k}") for k in ("n_lines", "n_dup_lines")})
    return counts.drop(words, lines).withColumns(
        {
            "mean_word_chars": ratio("word_chars", "n_words"),
            "symbol_ratio": ratio("n_symbols", "n_words"),
            "stop_word_ratio": ratio("n_stop_words", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        }
    )


def verdict(rules: Sequence[Rule] = RULES) -> Column:
    """The rules as one condition over the columns of measured()."""
    sides = [F.col(r.measure) >= r.least for r in rules if r.least is not None] + [F.col(r.measure) <= r.most for r in rules if r.most is not None]
    return reduce(lambda a, b: a & b, sides, F.lit(True))


def failed_rules(rules: Sequence[Rule] = RULES) -> Column:
    """Names of the rules that a row breaks."""
    broken = [F.when(~verdict([r]), F.lit(r.name)) for r in rules]
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, min_words: int = 50, repeat_percent: int = 50, text_col: str = "text") -> DataFrame:
    """docs with counts, ratios, base_failed, kept and failed_rules, from expressions of Spark alone.

    base_failed: fewer than min_words words, or more than repeat_percent of them in three-word windows found
    twice or more in the text. kept: not base_failed, and every rule holds. A null text counts as an empty one
    (no words, so base_failed). Rows stay as they are, repeated ones too; columns of docs that bear a new name
    are replaced. One projection over the scan, no shuffle; a text's words are held while its row is computed.
    """
    out = measured(docs, text_col).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
    return out.withColumns({"kept": ~F.col("base_failed") & verdict(rules), "failed_rules": failed_rules(rules)})
