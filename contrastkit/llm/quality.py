"""Quality rules (operator 9): base rules, then cutoffs whose false rejections are bounded on labelled holdouts.

Each rule is a signal with a ladder of cutoffs from loose to strict. In each stratum a cutoff is certified if the exact
binomial bound shows, from the labelled good documents it would reject, that it rejects at most its share of `risk`.
The level is divided among strata and rules, and a ladder is tested from its loose end until the first cutoff that
fails, so that all certified cutoffs hold together. Of those the one that parts bad from good best is used, if it
rejects bad documents much more often than good ones. All of it is DataFrame operations.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrastkit.llm.common import SPACE_RE, cut, let, words_of

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Ladders of cutoffs, loose to strict; a document over a cutoff is rejected.
LADDERS: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03),
    "duplicate_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeated_word_share": (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "characters_a_word": (20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0),
}


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of three words that the text holds more than once.

    A window's hash and place share one number: sorted, windows whose hashes begin alike are neighbours. The place takes
    as few bits as the text allows. The whole hashes of such neighbours, few in most texts, then tell which are equal.
    """

    def of(w: Column) -> Column:
        windows = F.size(w) - 2
        bits = F.length(F.bin(windows.cast("long")))
        mask = F.expr("1L")

        def hashed(i: Column) -> Column:
            return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

        def place_bits(b: Column) -> Column:
            keyed = F.transform(F.sequence(F.lit(0), windows - 1), lambda i: _shifted(hashed(i), b).bitwiseOR(i.cast("long")))

            def alike(s: Column) -> Column:
                def same(i: Column, x: Column) -> Column:
                    return _down(F.get(s, i), b) == _down(x, b)

                at = F.filter(s, lambda x, i: same(i + 1, x) | ((i > 0) & same(i - 1, x)))
                at = F.transform(at, lambda x: x.bitwiseAND(_shifted(mask, b) - 1))
                return let(F.array_sort(F.transform(at, lambda p: F.struct(hashed(p.cast("int")).alias("h"), p.alias("p")))), equal)

            def equal(s: Column) -> Column:
                at = F.filter(s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])))
                at = F.sort_array(F.transform(at, lambda x: x["p"]))
                return let(at, lambda p: F.aggregate(p, F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("sum")), lambda t, x: F.struct(x.alias("last"), (t["sum"] + F.least(F.lit(3).cast("long"), x - t["last"])).alias("sum")))["sum"])

            return let(F.sort_array(keyed), alike)

        return let(bits, place_bits)

    return F.when(F.size(words) >= 4, let(words, of)).otherwise(F.lit(0).cast("long"))


def _shifted(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def _down(x: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, bits)


def base_features(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, *more, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed) per row of docs.

    n_lines counts lines with a word. A null text has no words and fails.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("lines", lines)
    rows = rows.select(
        "doc_id",
        *more,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE_RE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _signals() -> dict[str, Column]:
    """Signals by rule, never null."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "duplicate_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated_word_share": F.col("n_repeat_words") / words,
        "characters_a_word": F.col("word_chars") / words,
    }


def _log_factorial(n: Column) -> Column:
    """Stirling's series at n + 8, taken back by seven factors."""
    y = n + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - reduce(lambda a, k: a + F.log(n + float(k)), range(2, 8), F.log(n + 1.0))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of a binomial (n, p), for k below the mean; 1 from there on. Never less than the exact value.

    Terms are summed from k downwards; those left out shrink at least as fast as the last ratio and are bounded so.
    """
    n, k = n.cast("double"), k.cast("double")
    at_k = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    terms = F.least(k, F.floor(F.sqrt(n) * 20) + 50).cast("int")
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def down(state: Column, i: Column) -> Column:
        term = state["term"] * (k - i + 1) / (n - k + i) * odds
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    summed = F.when(terms > 0, F.aggregate(F.sequence(F.lit(1), terms), start, down)).otherwise(start)
    ratio = F.greatest((k - terms) / (n - k + terms + 1) * odds, F.lit(0.0))
    bound = F.exp(at_k) * (summed["sum"] + summed["term"] * ratio / (1 - F.least(ratio, F.lit(0.999999))))
    return F.when((n <= 0) | (k >= n * p), F.lit(1.0)).otherwise(F.least(bound * (1 + 1e-9), F.lit(1.0)))


def certified_cutoffs(features: DataFrame, labels: DataFrame, stratum: str, risk: float, level: float, least_lift: float) -> DataFrame:
    """(stratum, rule, cutoff): the cutoffs in use; no row where none is certified or none is worth it.

    Good documents have a label 1 in column quality (any of their rows); only those that pass the base rules count.
    """
    good = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).alias("good"))
    held = features.where(~F.col("base_failed")).join(good, "doc_id")
    signals = _signals()
    met = held.select(stratum, "good", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), value.alias("signal")) for name, value in signals.items()])).alias("s"))
    met = met.select(stratum, "good", "s.rule", "s.signal")
    # how many rungs of its ladder a document is over: the last of them, as cutoffs fall
    over = reduce(lambda a, item: F.when(F.col("rule") == item[0], sum((F.col("signal") > c).cast("int") for c in item[1])).otherwise(a), LADDERS.items(), F.lit(0))
    rungs = met.groupBy(stratum, "rule", over.alias("over")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    steps = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(k).alias("rung"), F.lit(len(ladder) - k + 1).alias("least"), F.lit(c).alias("cutoff")) for name, ladder in LADDERS.items() for k, c in enumerate(ladder, 1)]))
    totals = rungs.groupBy(stratum, "rule").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    ladder = totals.withColumn("s", steps).where(F.col("s.rule") == F.col("rule")).select(stratum, "rule", "n_good", "n_bad", "s.rung", "s.least", "s.cutoff")
    same = F.col(stratum).eqNullSafe(F.col("r_stratum")) & (F.col("rule") == F.col("r_rule")) & (F.col("r_over") >= F.col("least"))
    counts = rungs.select(F.col(stratum).alias("r_stratum"), F.col("rule").alias("r_rule"), F.col("over").alias("r_over"), F.col("good").alias("r_good"), F.col("bad").alias("r_bad"))
    tried = ladder.join(counts, same, "left").groupBy(stratum, "rule", "rung", "cutoff", "n_good", "n_bad")
    tried = tried.agg(F.coalesce(F.sum("r_good"), F.lit(0)).alias("good"), F.coalesce(F.sum("r_bad"), F.lit(0)).alias("bad"))
    strata = max(1, totals.select(stratum).distinct().count())
    passes = binomial_tail(F.col("n_good"), F.col("good"), risk / len(LADDERS)) <= level / len(LADDERS) / strata
    order = Window.partitionBy(stratum, "rule").orderBy("rung").rowsBetween(Window.unboundedPreceding, 0)
    certified = tried.withColumn("passes", F.min(passes).over(order)).where("passes")
    good_share = F.col("good") / F.greatest(F.col("n_good"), F.lit(1))
    bad_share = F.col("bad") / F.greatest(F.col("n_bad"), F.lit(1))
    worth = certified.where(bad_share > least_lift * good_share).withColumn("gain", bad_share - good_share)
    best = worth.groupBy(stratum, "rule").agg(F.max(F.struct(F.col("gain"), (-F.col("rung")).alias("rung"), F.col("cutoff"))).alias("b"))
    return best.select(stratum, "rule", F.col("b.cutoff").alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, level: float = 0.05, least_lift: float = 10.0) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept): one row per row of docs.

    Of the good documents of a stratum that pass the base rules, all cutoffs together reject at most the share `risk`,
    with probability 1 - level for all strata at once. A stratum without enough labels rejects nothing beyond the base
    rules; null is a stratum. labels: (doc_id, quality); nulls are ignored, and a document labelled both ways is good.
    Rows that repeat, or share a doc_id, have a row each. Null texts have no words. Other
    columns are not read. No rows in: no rows out.
    """
    own = docs.withColumn("stratum", F.col(stratum).cast("string")) if stratum in docs.columns else docs.withColumn("stratum", F.lit(None).cast("string"))
    features = cut(base_features(own, "stratum"), "features")
    cutoffs = certified_cutoffs(features, labels, "stratum", risk, level, least_lift)
    ruled = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"_{name}") for name in LADDERS])
    ruled = cut(ruled.withColumnRenamed("stratum", "_stratum"), "cutoffs")
    joined = features.join(ruled, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    rejected = reduce(lambda a, b: a | b, [F.coalesce(value > F.col(f"_{name}"), F.lit(False)) for name, value in _signals().items()])
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
