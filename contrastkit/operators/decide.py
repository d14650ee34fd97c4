"""Decision rules: one row each, (decision, reasons)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrastkit.functions.numeric import floor_percentile


def _one(*frames: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    out = frames[0].withColumn("_k", F.lit(1))
    for frame in frames[1:]:
        out = out.join(frame.withColumn("_k", F.lit(1)), "_k", "left")
    return out.drop("_k")


def _shown(x: Column | str) -> Column:
    """Four decimals; minus zero is zero, and null stays."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNotNull(), F.replace(F.format_string("%.4f", x), F.lit("-0.0000"), F.lit("0.0000")))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("none")) for p in parts])


#: Words of the published audit verdicts (fixed values).
PUBLISHED = ("検証可能", "検証不能")


def audit_verdict(degrees: DataFrame, identities: DataFrame, least_keys: int = 10, least_rows: int = 50, words: tuple[str, str] = ("TESTABLE", "NOT_TESTABLE")) -> DataFrame:
    """Testable if enough keys are shared by classes, they hold enough rows, and each class has several identities.

    degrees: audit.key_degrees; identities: (cls, identities). words: the decision where it is testable, and where not;
    PUBLISHED are those of the published results.
    """
    shared = degrees.where("degree > 1").agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"))
    own = identities.agg(F.coalesce(F.min("identities") > 1, F.lit(False)).alias("several"))
    enough = (F.col("keys") >= least_keys) & (F.col("rows") >= least_rows) & F.col("several")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("keys") < least_keys, _text("only ", F.col("keys"), " keys are found in several classes")),
            F.when(F.col("rows") < least_rows, _text("only ", F.col("rows"), " rows are in such keys")),
            F.when(~F.col("several"), F.lit("a class has a single identity")),
        )
    )
    return _one(shared, own).select(F.when(enough, words[0]).otherwise(words[1]).alias("decision"), reasons.alias("reasons"))


def model_gate(classes: DataFrame, crossed: DataFrame, dependence: DataFrame) -> DataFrame:
    """Whether modelling is worth it. classes: (observations, unique_identities) for each major class; crossed: crossed
    contexts with observations and has_label_variation; dependence: one row with cramers_v of class and identity."""
    own = classes.agg(F.coalesce(F.min("unique_identities"), F.lit(0)).alias("ids"), F.coalesce(F.min("observations"), F.lit(0)).alias("obs"))
    met = crossed.agg(F.count(F.lit(1)).alias("contexts"), F.coalesce(F.sum("observations"), F.lit(0)).alias("rows"), F.coalesce(F.sum("has_label_variation"), F.lit(0)).alias("varied"))
    go = (F.col("ids") >= 5) & (F.col("obs") >= 50) & (F.col("contexts") >= 20) & (F.col("rows") >= 100)
    decision = F.when(go, "GO_FOR_CHEAP_FALSIFICATION").when((F.col("ids") >= 3) & (F.col("contexts") > 0), "PIVOT").otherwise("KILL")
    reasons = F.array_compact(
        F.array(
            _text("identities in the class with fewest: ", F.col("ids")),
            _text("observations in the smallest class: ", F.col("obs")),
            _text("crossed contexts: ", F.col("contexts"), ", with observations: ", F.col("rows")),
            _text("crossed contexts with both labels: ", F.col("varied")),
            F.when(F.col("cramers_v") > 0.95, F.lit("identity all but determines class: gains under a random split say nothing")),
        )
    )
    return _one(own, met, dependence.select("cramers_v")).select(decision.alias("decision"), reasons.alias("reasons"))


def model_verdict(pooled: DataFrame, shuffled: DataFrame, split: str = "payload_group", least_gain: float = 0.02) -> DataFrame:
    """GO if the class adds average precision over both base models and MCC over one, and beats shuffled classes.

    pooled: (split, model, average_precision, mcc) of the four models; shuffled: average_precision of each repeat.
    """
    names = ("bio", "bio_plus_mechanism", "bio_plus_payload", "bio_plus_payload_plus_mechanism")
    of = lambda m, c: F.max(F.when((F.col("split") == split) & (F.col("model") == m), F.col(c)))
    own = pooled.agg(*[of(m, "average_precision").alias(f"ap_{k}") for k, m in enumerate(names)], *[of(m, "mcc").alias(f"mcc_{k}") for k, m in enumerate(names)], F.count_distinct(F.when((F.col("split") == split) & F.col("model").isin(*names), F.col("model"))).alias("found"))
    control = shuffled.where("average_precision is not null").agg(F.count(F.lit(1)).alias("repeats"), floor_percentile(F.col("average_precision"), 0.95).alias("p95"), F.avg("average_precision").alias("mean"))
    gain, gain_ident, gain_mcc = F.col("ap_1") - F.col("ap_0"), F.col("ap_3") - F.col("ap_2"), F.col("mcc_1") - F.col("mcc_0")
    beaten = F.coalesce((F.col("repeats") > 0) & (F.col("ap_1") <= F.col("p95")), F.lit(False))
    go = F.coalesce((gain >= least_gain) & (gain_ident >= least_gain) & (gain_mcc > 0), F.lit(False))
    decision = F.when((F.col("found") < 4) | beaten, "PIVOT").when(go, "GO").otherwise("PIVOT")
    reasons = F.when(F.col("found") < 4, F.array(F.lit("the central comparison is not there"))).otherwise(
        F.array_compact(
            F.array(
                _text("gain in average precision over bio: ", _shown(gain)),
                _text("gain in average precision over bio and payload: ", _shown(gain_ident)),
                _text("gain in MCC over bio: ", _shown(gain_mcc)),
                F.when(F.col("repeats") > 0, _text("with shuffled classes: mean ", _shown("mean"), ", p95 ", _shown("p95"))),
                F.when(beaten, F.lit("the true classes do not beat shuffled ones")),
            )
        )
    )
    return _one(own, control).select(decision.alias("decision"), reasons.alias("reasons"))


def contrast_verdict(pairs: DataFrame, bootstrap: DataFrame, left_out: DataFrame, permutation: DataFrame) -> DataFrame:
    """PIVOT-GO if a pair is replicated, significant, away from zero and stable; PIVOT-WEAK on a descriptive pattern.

    Inputs are keyed by (class_a, class_b); what is missing counts against a pair.
    """
    keys = ["class_a", "class_b"]
    met = pairs.join(permutation.select(*keys, "p"), keys, "left").join(bootstrap.select(*keys, "p025", "p975"), keys, "left").join(left_out.select(*keys, "unavailable_holdouts", "sign_change_holdouts"), keys, "left")
    away = F.coalesce((F.col("p025") > 0) | (F.col("p975") < 0), F.lit(False))
    stable = (F.coalesce("unavailable_holdouts", F.lit(999)) == 0) & (F.coalesce("sign_change_holdouts", F.lit(999)) == 0)
    go = (F.col("both_replicated") >= 3) & (F.coalesce("p", F.lit(1.0)) <= 0.05) & away & stable
    weak = (F.col("contexts") >= 5) & (F.abs("mean_diff") >= 0.15) & (F.greatest("a_higher", "b_higher") >= 3)
    line = _text(F.col("class_a"), " vs ", F.col("class_b"), ": contexts ", F.col("contexts"), ", mean difference ", _shown("mean_diff"), ", p ", _shown("p"), ", replicated contexts ", F.col("both_replicated"))
    out = met.agg(F.coalesce(F.max(go.cast("int")), F.lit(0)).alias("go"), F.coalesce(F.max(weak.cast("int")), F.lit(0)).alias("weak"), F.array_sort(F.collect_list(line)).alias("lines"), F.coalesce(F.sum("both_replicated"), F.lit(0)).alias("replicated"))
    decision = F.when(F.col("go") == 1, "PIVOT-GO").when(F.col("weak") == 1, "PIVOT-WEAK").otherwise("KILL")
    last = F.when(F.col("go") == 1, F.lit("a replicated contrast stands")).when(F.col("weak") == 1, F.lit("a pattern within contexts rests on single identities")).otherwise(F.lit("no convincing pattern within contexts"))
    reasons = F.concat("lines", F.array(_text("pair contexts with both arms replicated: ", F.col("replicated")), last))
    return out.select(decision.alias("decision"), reasons.alias("reasons"))
