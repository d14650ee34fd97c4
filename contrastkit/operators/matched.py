"""Contrasts of classes inside exact contexts. Input: units (see measurements.units) with columns for the context, cls,
ident, response_rate, n_observations and positives. Differences are a minus b, for a before b in class order. A context
of nulls is a context like any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrastkit.functions.numeric import EPS
from contrastkit.operators.ordered import null_safe, order_statistics
from contrastkit.session import cut


def _ordered(cls: Column, order: Sequence[str] | None) -> Column:
    """A sortable form of a class: declared classes first, as declared."""
    if not order:
        return F.struct(F.lit(0).alias("place"), cls.alias("name"))
    place = F.coalesce(*[F.when(cls == name, F.lit(k)) for k, name in enumerate(order)], F.lit(len(order)))
    return F.struct(place.alias("place"), cls.alias("name"))


def matched(units: DataFrame, context: Sequence[str], cls: str = "cls") -> DataFrame:
    """The units of contexts in which more than one class is found."""
    shared = units.groupBy(*context).agg((F.min(cls) != F.max(cls)).alias("_shared")).where("_shared").select(*context)
    return null_safe(units, shared, context)


def prevalence_effects(rows: DataFrame, context: Sequence[str], cls: str, ident: str, label: str) -> DataFrame:
    """For each context and pair of its classes: sizes, positives, prevalences and their difference, by observation."""
    arms = rows.groupBy(*context, F.col(cls).alias("cls")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("positives"), F.avg(label).alias("prevalence"), F.array_join(F.array_sort(F.collect_set(F.col(ident).cast("string"))), ";").alias("idents")
    )
    met = _pairs(arms, context, None)
    diff = F.col("prevalence_a") - F.col("prevalence_b")
    varied = ((F.col("positives_a") + F.col("positives_b")) % (F.col("n_a") + F.col("n_b")) != 0).cast("int")
    return met.withColumn("diff", diff).withColumn("has_label_variation", varied)


def prevalence_summary(effects: DataFrame) -> DataFrame:
    """For each pair of classes: contexts, mean and weighted mean difference, and in how many contexts which is higher."""
    weight = F.col("n_a") + F.col("n_b")
    return effects.groupBy("class_a", "class_b").agg(
        F.count(F.lit(1)).alias("contexts"),
        F.sum("has_label_variation").cast("long").alias("contexts_with_label_variation"),
        F.sum(weight).cast("long").alias("observations"),
        F.avg("diff").alias("mean_diff"),
        (F.sum(F.col("diff") * weight) / F.sum(weight)).alias("weighted_diff"),
        F.count_if(F.col("diff") > 0).alias("a_higher"),
        F.count_if(F.col("diff") < 0).alias("b_higher"),
        F.count_if(F.col("diff") == 0).alias("equal"),
    )


def _pairs(arms: DataFrame, context: Sequence[str], order: Sequence[str] | None) -> DataFrame:
    """All pairs of classes in a context: an equi join on the context with an order on the classes."""
    others = [c for c in arms.columns if c not in (*context, "cls")]
    side = lambda s: arms.select(*context, F.col("cls").alias(f"class_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in others])
    met = null_safe(side("a"), side("b"), context)
    return met.where(_ordered(F.col("class_a"), order) < _ordered(F.col("class_b"), order))


def pair_effects(units: DataFrame, context: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """For each context and pair of its classes: what each arm holds, its mean unit response and prevalence, which is
    higher, whether arms are replicated, the identities of either arm in order, and the signature of all pairs of them.

    A signature is worked out from the two arms' identities, as two hashes; `displayed` writes it out.
    """
    arms = units.groupBy(*context, "cls").agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("n_observations").cast("long").alias("observations"),
        F.count_distinct("ident").alias("unique_idents"),
        F.avg("response_rate").alias("unit_response"),
        (F.sum("positives") / F.sum("n_observations")).alias("prevalence"),
        F.array_sort(F.collect_set(F.col("ident").cast("string"))).alias("idents"),
    )
    met = _pairs(arms, context, order)
    diff = F.col("unit_response_a") - F.col("unit_response_b")
    met = met.withColumn("diff", diff).withColumn("prevalence_diff", F.col("prevalence_a") - F.col("prevalence_b"))
    flags = {
        "a_higher": F.col("diff") > EPS,
        "b_higher": F.col("diff") < -EPS,
        "equal": F.abs("diff") <= EPS,
        "both_replicated": (F.col("units_a") >= 2) & (F.col("units_b") >= 2),
        "either_replicated": (F.col("units_a") >= 2) | (F.col("units_b") >= 2),
        "differs": F.abs("diff") > EPS,
    }
    met = met.withColumns({name: F.coalesce(flag, F.lit(False)).cast("int") for name, flag in flags.items()})
    return met.withColumn("signature", F.struct(F.xxhash64("idents_a", "idents_b").alias("h"), F.xxhash64(F.lit(1), "idents_b", "idents_a").alias("h2")))


def displayed(rows: DataFrame) -> DataFrame:
    """Effects, summaries or pairings with identities and signatures as texts: "a;b" and "a|x;a|y;b|x;b|y"."""

    def pairs(a: str, b: str) -> Column:
        return F.array_join(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat_ws("|", x, y)))), ";")

    if "top_idents_a" in rows.columns:
        rows = rows.withColumn("top_signature", pairs("top_idents_a", "top_idents_b")).drop("top_idents_a", "top_idents_b")
    if "signature" in rows.columns:
        rows = rows.withColumn("signature", pairs("idents_a", "idents_b"))
    return rows.withColumns({c: F.array_join(c, ";") for c in ("idents_a", "idents_b") if c in rows.columns})


def _first_seen(effects: DataFrame) -> Column:
    """The order of effects of a pair: the largest difference first, then by context."""
    context = effects.columns[: effects.columns.index("class_a")]
    return F.struct((-F.round(F.abs("diff"), 12)).alias("far"), *context)


def pair_summary(effects: DataFrame) -> DataFrame:
    """For each pair of classes over its contexts: sums, means, weighted means, identities, and the arms' identities of the
    most frequent signature, of equally frequent ones that which comes first."""
    keys, effects = ["class_a", "class_b"], cut(effects, "effects")  # read four times
    units, observations = F.col("units_a") + F.col("units_b"), F.col("observations_a") + F.col("observations_b")
    total = lambda c: F.sum(c).cast("long").alias(c)
    out = effects.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("contexts"),
        F.sum(observations).cast("long").alias("observations"),
        F.sum(units).cast("long").alias("units"),
        total("differs"),
        total("a_higher"),
        total("b_higher"),
        total("equal"),
        F.avg("diff").alias("mean_diff"),
        (F.sum(F.col("diff") * units) / F.sum(units)).alias("unit_weighted_diff"),
        (F.sum(F.col("prevalence_diff") * observations) / F.sum(observations)).alias("observation_weighted_diff"),
        total("both_replicated"),
        total("either_replicated"),
    )
    named = effects.select(*keys, F.explode(F.array(F.struct(F.lit("a").alias("arm"), F.col("idents_a").alias("i")), F.struct(F.lit("b").alias("arm"), F.col("idents_b").alias("i")))).alias("x"))
    named = named.select(*keys, "x.arm", F.explode("x.i").alias("ident")).distinct()
    arm = lambda s: F.array_sort(F.collect_list(F.when(F.col("arm") == s, F.col("ident")))).alias(f"idents_{s}")
    named = named.groupBy(*keys).agg(arm("a"), arm("b"))
    named = named.withColumns({f"unique_idents_{s}": F.size(f"idents_{s}").cast("long") for s in "ab"})
    counted = effects.groupBy(*keys, "signature").agg(F.count(F.lit(1)).alias("n"), F.min(_first_seen(effects)).alias("first"), F.any_value(F.struct("idents_a", "idents_b")).alias("idents"))
    top = counted.groupBy(*keys).agg(F.min_by(F.struct("idents", "n"), F.struct((-F.col("n")).alias("n"), "first")).alias("top"))
    top = top.select(*keys, F.col("top.idents.idents_a").alias("top_idents_a"), F.col("top.idents.idents_b").alias("top_idents_b"), F.col("top.n").alias("top_signature_contexts"))
    return out.join(order_statistics(effects, keys, "diff", {"median_diff": ("linear", 0.5)}), keys, "left").join(named, keys).join(top, keys)


def pairings(effects: DataFrame, context: Sequence[str], examples: int = 5) -> DataFrame:
    """For each pair and signature: contexts, which class is higher, the arms' identities, and the first contexts: those of
    the largest difference, then by key."""
    key = F.concat_ws(" || ", *[F.col(c).cast("string") for c in context])
    keys = ["class_a", "class_b", "signature"]
    counted = effects.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("contexts"),
        F.sum("a_higher").cast("long").alias("a_higher"),
        F.sum("b_higher").cast("long").alias("b_higher"),
        F.sum("equal").cast("long").alias("equal"),
        F.any_value("idents_a").alias("idents_a"),
        F.any_value("idents_b").alias("idents_b"),
    )
    # Spark keeps the first few rows of a group before it shuffles them
    order = F.struct((-F.round(F.abs("diff"), 12)).alias("far"), key.alias("key"))
    first = effects.select(*keys, order.alias("_order")).withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("_order"))).where(F.col("_place") <= examples)
    shown = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_order")), lambda x: x["key"]), "; ").alias("example_contexts"))
    return counted.join(shown, keys)


def coverage(units: DataFrame, context: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """For each context: classes, units, observations, identities, replicated classes, response range, and one "k=v"
    list each of units, observations, mean responses and identities by class."""
    arms = units.groupBy(*context, "cls").agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("n_observations").cast("long").alias("observations"),
        F.sum("positives").cast("long").alias("positives"),
        F.sum("response_rate").alias("rates"),
        F.avg("response_rate").alias("rate"),
        F.min("response_rate").alias("least"),
        F.max("response_rate").alias("most"),
        F.array_sort(F.collect_set(F.col("ident").cast("string"))).alias("idents"),
    )
    row = F.struct(_ordered(F.col("cls"), order).alias("o"), "cls", "units", "observations", F.format_string("%.4f", "rate").alias("rate"), F.array_join("idents", ",").alias("idents"))
    out = arms.groupBy(*context).agg(
        F.count(F.lit(1)).alias("classes"),
        F.array_sort(F.collect_list(row)).alias("arms"),
        F.sum("units").cast("long").alias("units"),
        F.sum("observations").cast("long").alias("observations"),
        F.size(F.array_distinct(F.flatten(F.collect_list("idents")))).alias("unique_idents"),
        F.count_if(F.col("units") >= 2).alias("replicated_classes"),
        (F.min("units") >= 2).cast("int").alias("all_replicated"),
        (F.sum("rates") / F.sum("units")).alias("unit_response"),
        (F.sum("positives") / F.sum("observations")).alias("prevalence"),
        F.min("least").alias("response_min"),
        F.max("most").alias("response_max"),
    )
    listed = lambda field: F.array_join(F.transform("arms", lambda x: F.concat_ws("=", x["cls"], x[field].cast("string"))), "; ")
    out = out.withColumn("class_list", F.array_join(F.col("arms.cls"), "; ")).withColumn("has_variation", (F.col("response_max") - F.col("response_min") > EPS).cast("int"))
    return out.withColumns({f"{f}_by_class": listed(f) for f in ("units", "observations", "rate", "idents")}).drop("arms")


def strong_overlap(covered: DataFrame, context: Sequence[str], classes: int = 3, units: int = 4) -> DataFrame:
    """Contexts with many classes or many units."""
    return covered.where((F.col("classes") >= classes) | (F.col("units") >= units)).select(*context)


def reduction(scopes: dict[str, tuple[DataFrame, DataFrame]], context: Sequence[str], cls: str, ident: str, label: str) -> DataFrame:
    """For named scopes of (observations, units): how much is left in each."""
    out = None
    for place, (name, (rows, units)) in enumerate(scopes.items()):
        by_row = rows.agg(F.count(F.lit(1)).alias("observations"), F.sum(label).cast("long").alias("positives"), F.avg(label).alias("prevalence"))
        key = F.struct(*context)
        by_unit = units.agg(F.count(F.lit(1)).alias("units"), F.avg("response_rate").alias("unit_response"), F.count_distinct("ident").alias("idents"), F.count_distinct("cls").alias("classes"), F.count_distinct(key).alias("contexts"))
        both = by_row.withColumn("_k", F.lit(1)).join(by_unit.withColumn("_k", F.lit(1)), "_k").drop("_k").withColumn("scope", F.lit(name)).withColumn("place", F.lit(place))
        out = both if out is None else out.unionByName(both)
    return out


def survival(reduced: DataFrame, part: str, whole: str) -> DataFrame:
    """One row: what share of the observations and units of scope `whole` is in `part`; null where whole has none."""
    of = lambda c, s: F.max(F.when(F.col("scope") == s, F.col(c)))
    return reduced.agg(*[F.try_divide(of(c, part).cast("double"), of(c, whole)).alias(f"{c}_share") for c in ("observations", "units")])


def residuals(units: DataFrame, context: Sequence[str]) -> DataFrame:
    """units with their context's mean response and the difference from it.

    Means combine before they are shuffled and come back by a join, in which Spark splits a context of very many units.
    """
    means = units.groupBy(*context).agg(F.avg("response_rate").alias("context_mean"))
    return null_safe(units, means, context).withColumn("residual", F.col("response_rate") - F.col("context_mean"))


def residual_summary(units: DataFrame, context: Sequence[str]) -> DataFrame:
    """For each class: units, identities, contexts, and the spread and signs of its residuals."""
    r, own = F.col("residual"), cut(residuals(units, context), "residuals")
    out = own.groupBy("cls").agg(
        F.count(F.lit(1)).alias("units"),
        F.count_distinct("ident").alias("idents"),
        F.count_distinct(F.struct(*context)).alias("contexts"),
        F.avg(r).alias("mean_residual"),
        F.min(r).alias("min_residual"),
        F.max(r).alias("max_residual"),
        F.count_if(r > EPS).alias("positive"),
        F.count_if(r < -EPS).alias("negative"),
        F.count_if(F.abs(r) <= EPS).alias("zero"),
    )
    return null_safe(out, order_statistics(own, ["cls"], "residual", {"median_residual": ("linear", 0.5)}), ["cls"])


def residual_class_means(units: DataFrame, context: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, cls, mean_residual) over the contexts of more than one class, for each value of `by`."""
    own = [*by, *context]
    means = units.groupBy(*own).agg((F.min("cls") != F.max("cls")).alias("_shared"), F.avg("response_rate").alias("_mean")).where("_shared")
    centred = null_safe(units, means, own).withColumn("residual", F.col("response_rate") - F.col("_mean"))
    return centred.groupBy(*by, "cls").agg(F.avg("residual").alias("mean_residual"))


def residual_range(units: DataFrame, context: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, stat): the largest class mean less the smallest; null with fewer than two classes."""
    means = residual_class_means(units, context, by)
    stat = F.when(F.count(F.lit(1)) > 1, F.max("mean_residual") - F.min("mean_residual")).alias("stat")
    return means.groupBy(*by).agg(stat) if by else means.agg(stat)


def pair_units(units: DataFrame, context: Sequence[str], order: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(class_a, class_b, by, the units' columns): for each pair, the units of both classes in contexts that hold both."""
    held = units.select(*by, *context, "cls").distinct()
    left = held.withColumnRenamed("cls", "class_a")
    met = left.join(held.withColumnRenamed("cls", "class_b"), [*by, *context])
    met = met.where(_ordered(F.col("class_a"), order) < _ordered(F.col("class_b"), order))
    return met.join(units, [*by, *context]).where((F.col("cls") == F.col("class_a")) | (F.col("cls") == F.col("class_b")))


def pair_diffs(pair: DataFrame, context: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(class_a, class_b, by, contexts, units, stat): the mean over contexts of the difference of the arms' means.

    weight: how often a unit counts; contexts in which an arm is left without weight drop out.
    """
    w = F.col(weight) if weight else F.lit(1)
    arm = lambda s: F.try_divide(F.sum(F.when(F.col("cls") == F.col(f"class_{s}"), F.col("response_rate") * w)), F.sum(F.when(F.col("cls") == F.col(f"class_{s}"), w).otherwise(0)).cast("double"))
    each = pair.groupBy("class_a", "class_b", *by, *context).agg((arm("a") - arm("b")).alias("diff"), F.sum(w).alias("_units"))
    return each.groupBy("class_a", "class_b", *by).agg(F.count("diff").alias("contexts"), F.sum(F.when(F.col("diff").isNotNull(), F.col("_units"))).cast("long").alias("units"), F.avg("diff").alias("stat"))
