"""Quality rules: base rules, then levels of cutoffs that labelled holdouts certify by exact binomial bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.llm.common import UPPER, SPACES, cut, let, null_key, words

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rules of the method and their scales: a document is rejected where a feature is above level * scale.
RULES = {"symbol_ratio": 1.0, "mark_ratio": 1.0, "repeat_share": 4.0, "dup_line_share": 4.0, "upper_ratio": 4.0}
#: Levels to test, loosest first, set before any label is seen.
LEVELS = (0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.04, 0.03, 0.02, 0.01)


def repeat_words(tokens: Column) -> Column:
    """Words inside 5-word windows that the text holds twice or more, the first included.

    Windows are compared by 64-bit hash. Only texts with a repeated window sort their windows; positions p1 < p2 < ... of
    repeated windows cover min(5, gap to the next) words each, so the whole is n log n also for very long texts.
    """

    def covered(w: Column) -> Column:
        runs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            twice = F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))
            return let(twice, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(runs, places))

    def windows(h: Column) -> Column:
        each = F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))
        return let(F.slice(each, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), covered)

    return F.when(F.size(tokens) <= WINDOW, F.lit(0)).otherwise(let(F.transform(tokens, lambda x: F.xxhash64(x)), windows))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def stratum(lang: Column) -> Column:
    return null_key(lang)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, base columns, base_failed, one column for each rule, worst: the greatest of them over their scales). Null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    measure = let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")))
    count_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.select("doc_id", stratum(F.col("lang")).alias("stratum"), measure.alias("m"), count_lines.alias("l"), F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"), without(SYMBOLS).cast("long").alias("n_symbols"), without(UPPER).alias("n_upper"), without("!?|;:").alias("n_marks"), text_hash(F.col("text")).alias("text_hash"))
    share = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    c = F.col
    out = out.select("doc_id", "text_hash", "stratum", c("m.n_words").alias("n_words"), "word_chars", "n_symbols", c("l.n_dup_lines").alias("n_dup_lines"), c("m.n_repeat_words").alias("n_repeat_words"), c("l.n").alias("n_lines"), "n_upper", "n_marks")
    failed = (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))
    out = out.select(
        "doc_id", "text_hash", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        share(c("n_symbols"), c("word_chars")).alias("symbol_ratio"), share(c("n_dup_lines"), c("n_lines")).alias("dup_line_share"), share(c("n_repeat_words"), c("n_words")).alias("repeat_share"),
        share(c("n_upper"), c("word_chars")).alias("upper_ratio"), share(c("n_marks"), c("word_chars")).alias("mark_ratio"),
    )
    return out.withColumn("worst", F.greatest(*(c(r) / scale for r, scale in RULES.items())))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1, by Stirling's series at x + 8."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(8):
        series = series - F.log(x + float(k))
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), the exact Clopper-Pearson test of "the rate is above p".

    The sum runs from k downward, each term a ratio of the one before; below the mean terms fall, and those past 40 standard deviations lie
    under the last bit of a double and are left out, so its length is bounded by sqrt(n). At or above the mean, where the tail is about a half
    or more and no test can pass, it is given as 1.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.least(k, F.ceil(40 * F.sqrt(n * p * (1 - p)) + 60)).cast("int")
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j + 1) * (1 - p) / ((n - k + j) * p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    rest = F.when(steps > 0, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), first * F.aggregate(rest, zero, add, lambda a: a["sum"])))


def certified(feats: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, level): for each stratum the level that it uses, if the holdout bounds the false rejections of any.

    A labelled document with quality 1 is good. A level rejects what any rule rejects at it, so its test is of all rules
    together: it passes if, were its rate of rejected good documents above ``risk``, so few of them would show with probability at
    most delta / number of strata (the exact binomial tail; Bonferroni over strata). Levels are tested from the loosest on
    and the first that fails ends the sequence, so a stratum's sequence needs no further correction: with probability 1 - delta every level
    that passed, in whatever stratum, rejects at most ``risk`` of the good documents. Of those the one is used whose share of bad documents caught exceeds
    its share of good ones lost by most, the loosest of equals; one that catches none is not. Without a false rejection a level needs ln(delta / strata) / ln(1 - risk) good labels,
    217 with four strata; a stratum with fewer keeps all that the base rules keep.

    Labels of null quality or without a document are left out; repeated labels of one document count once, the lowest.
    """
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = feats.filter(~F.col("base_failed")).join(marked, "doc_id")
    # A document in cell c is above the last c levels, so counts a cell give the counts of all levels.
    cell = sum((F.col("worst") > level).cast("int") for level in LEVELS)
    counts = held.groupBy("stratum", cell.alias("cell")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad"))
    levels = F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(level).alias("level")) for i, level in enumerate(LEVELS))))
    above = lambda c: F.sum(F.when(F.col("cell") + F.col("l.turn") >= len(LEVELS), F.col(c)).otherwise(0))
    table = counts.select("*", levels.alias("l")).groupBy("stratum", "l.turn", "l.level").agg(F.sum("good").alias("n"), F.sum("bad").alias("bad"), above("good").alias("k"), above("bad").alias("caught"))
    strata = counts.select(F.countDistinct("stratum").alias("strata"))
    tested = table.withColumn("p", F.when(F.col("n") > 0, binomial_tail(F.col("k"), F.col("n"), risk)).otherwise(F.lit(1.0))).crossJoin(strata)
    sequence = Window.partitionBy("stratum").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    passed = tested.withColumn("highest", F.max("p").over(sequence)).filter((F.col("highest") <= delta / F.col("strata")) & (F.col("caught") > 0))
    gain = F.col("caught") / F.col("bad") - F.col("k") / F.col("n")
    return passed.groupBy("stratum").agg(F.max(F.struct(gain.alias("gain"), "level")).alias("best")).select("stratum", F.col("best.level").alias("level"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """features() of every document with ``kept``: false if a base rule rejects it, or the certified level of its stratum.

    Null or empty text has no words and fails. Null lang is a stratum of its own. Without labels only the base rules work.
    Repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
    """
    feats = cut(features(docs))
    levels = F.broadcast(certified(feats, labels, risk, delta))  # one row a stratum
    above = F.coalesce(F.col("worst") > F.col("level"), F.lit(False))
    return feats.join(levels, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~above)
