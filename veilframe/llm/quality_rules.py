"""Quality rules: one threshold table, compiled into a single projection of built-in expressions.

Statistics come from the whole text. Words are maximal runs of characters other than
space and \\t \\n \\v \\f \\r. Null and empty texts have no words: every count is 0, every
ratio 0, ``base_failed`` is true and ``kept`` false. Ties do not arise (each row stands
alone); repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words per window of the repetition count.
WINDOW = 5

#: Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "the of and to in is it that with as for was on are be this by at or from an",
    "fr": "de la le et les des en un du une que dans qui par pour au sur est avec aux",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}


@dataclass(frozen=True)
class Rule:
    """A row of the table: the document fails where ``statistic`` lies under ``least`` or over ``most``."""

    statistic: str
    least: float | None = None
    most: float | None = None


#: Production thresholds. Ratios are of words, lines or characters of words.
RULES = (
    Rule("n_words", least=10, most=1_000_000),
    Rule("mean_word_chars", least=2.0, most=15.0),
    Rule("symbol_word_ratio", most=0.30),
    Rule("stop_word_ratio", least=0.04),
    Rule("duplicate_line_ratio", most=0.50),
    Rule("shouted_ratio", most=0.50),
    Rule("ellipsis_line_ratio", most=0.30),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable over a one-element array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the text.

    Windows are compared by a 64-bit hash; sorted (hash, place) pairs bring equal windows
    together, and the gaps between marked places, capped at the window, count covered words.
    """
    places = F.sequence(F.lit(1), F.size(words) - F.lit(WINDOW - 1))
    hashed = F.transform(places, lambda i: F.struct(F.xxhash64(*[F.get(words, i + F.lit(k - 1)) for k in range(WINDOW)]).alias("h"), i.alias("i")))

    def marked(s: Column) -> Column:
        same = lambda a, b: F.get(s, a)["h"].eqNullSafe(F.get(s, b)["h"])
        twice = F.filter(F.transform(s, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"])), lambda x: x.isNotNull())
        return _let(F.array_sort(twice), lambda p: F.coalesce(F.aggregate(
            F.transform(p, lambda v, k: F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - v), F.lit(WINDOW))), F.lit(0), lambda a, b: a + b), F.lit(0)))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(F.array_sort(hashed), marked))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and every statistic that a rule may name."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    has_word = lambda s: F.length(F.translate(s, WHITE, "")) > 0
    stop = sorted(set(" ".join(STOP_WORDS.values()).split()))
    words = F.filter(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), has_word)
    count = lambda c: c.cast("long")
    # two projections on purpose: the arrays are attributes below, so lambdas read them instead of splitting again
    arrays = df.select(F.col(f"`{id_col}`").alias(id_col), text.alias("_t"), words.alias("_w"), lines.alias("_l"))
    counted = arrays.select(
        id_col,
        count(F.size("_w")).alias("n_words"),
        count(F.length(F.translate("_t", WHITE, ""))).alias("word_chars"),
        count(F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).alias("n_symbols"),
        count(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        count(_repeated(F.col("_w"))).alias("n_repeat_words"),
        count(F.size("_l")).alias("n_lines"),
        count(F.size(F.filter("_w", lambda w: F.lower(F.translate(w, ".,!?;:", "")).isin(stop)))).alias("n_stop_words"),
        count(F.size(F.filter("_w", lambda w: (F.length(w) >= 2) & (w == F.upper(w)) & (w != F.lower(w))))).alias("n_shouted"),
        count(F.size(F.filter("_l", lambda s: F.rtrim(s).endswith("...") | F.rtrim(s).endswith("…")))).alias("n_ellipsis_lines"),
    )
    return counted.select(
        "*",
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_word_ratio"),
        _ratio(F.col("n_stop_words"), F.col("n_words")).alias("stop_word_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("duplicate_line_ratio"),
        _ratio(F.col("n_shouted"), F.col("n_words")).alias("shouted_ratio"),
        _ratio(F.col("n_ellipsis_lines"), F.col("n_lines")).alias("ellipsis_line_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one expression: the array of names of failed rules."""
    failed = []
    for r in rules:
        c = F.col(r.statistic)
        bad = [c < r.least] * (r.least is not None) + [c > r.most] * (r.most is not None)
        if not bad:
            raise ValueError(f"rule on {r.statistic} has no threshold")
        failed.append(F.when(bad[0] if len(bad) == 1 else bad[0] | bad[1], F.lit(r.statistic)))
    return F.filter(F.array(*failed), lambda x: x.isNotNull()) if failed else F.array().cast("array<string>")


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, ``base_failed``, ``failed_rules`` and ``kept`` per document; a narrow, shuffle-free plan."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        statistics(df, id_col, text_col)
        .withColumn("base_failed", base)
        .withColumn("failed_rules", compile_rules(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )
