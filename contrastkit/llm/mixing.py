"""Mixing sources to target weights (operator 2): entropy balancing by Newton steps on the dual, in DataFrame operations.

Of all rates r between 0 and `most` whose words meet a source's target, those nearest to 1 in relative entropy are
r = min(most, exp(lambda * size / mean size)): each source's lambda solves one convex dual. A document's rate depends
on its source and size only, so the steps run on a histogram of sizes. Rates become whole copies: first by cumulated
rounding from the largest documents down, which leaves an error of half a document at most, then by corrections from the
largest size that fits downwards, many copies at once. All sums are of whole numbers, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrastkit.llm.common import cut, forget, own_names, words_of
from contrastkit.operators.ordered import running

#: Documents of one source and size that are ranked together, as expected where one source and size hold them all.
RANKED = 8192
#: Newton steps after which a dual that has not settled is an error: the bracket alone settles it in fewer.
_NEWTON_STEPS = 200
_NEAR = 1e-6
#: What share of its target a source may miss without single corrections.
_FINE = 0.0005


def source_targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """sources (key, source, source_size) with weight and target.

    Sources by code point, null last, take the weights in turn and share all words by them; a target stops at most
    times its source's size and what is over is shared again by weight among those below.
    """
    order = [F.col("source").isNull(), "source"]
    turned = running(sources, [], order, {"turn": F.lit(1)})
    turn = (F.col("turn") - 1) % len(weights)
    placed = turned.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    placed = placed.withColumn("cap", F.col("source_size") * float(most)).drop("turn")
    # by cap for each weight: those before the first that keeps its share are all at their caps
    placed = running(placed, [], [F.col("cap") / F.col("weight"), *order], {"place": F.lit(1), "caps": "cap", "weights": "weight"})
    one = lambda frame: frame.withColumn("_one", F.lit(1))
    whole = one(placed.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight")))
    placed = one(placed).join(F.broadcast(whole), "_one")
    level = (F.col("all_size") - (F.col("caps") - F.col("cap"))) / (F.col("all_weight") - (F.col("weights") - F.col("weight")))
    keeps = F.col("cap") >= level * F.col("weight")
    first = one(placed.where(keeps).agg(F.min_by(level, "place").alias("level")))
    placed = placed.join(F.broadcast(first), "_one", "left")
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0)))
    return placed.select(*sources.columns, "weight", target.alias("target"))


def _rate(most: float) -> Column:
    """The tilted rate; 1 in the exponent is a document of the source's mean size."""
    exponent = F.col("lam") * F.col("size") / F.col("mean")
    return F.when(F.col("full"), F.lit(most)).when(exponent >= F.log(F.lit(most)), F.lit(most)).otherwise(F.exp(exponent))


def _whole(x: Column) -> Column:
    return F.sum(F.round(x * 1000.0).cast("decimal(38,0)")).cast("double") / 1000.0


def dual_lambdas(histogram: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """(key, mean, full, lam): each source's solution. histogram: (key, size, n); sizes of 0 have no say.

    full: the target is all that the cap allows. Each step is one aggregation; a step out of the bracket halves it. A dual
    that has not settled in 200 steps is an error; the bracket alone settles it in fewer.
    """
    sized = histogram.where("size > 0")
    sums = sized.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"))
    state = sums.join(targets.select("key", "target"), "key").select(
        "key",
        "target",
        (F.col("words") / F.col("docs")).alias("mean"),
        (F.col("target") >= F.col("words") * most * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"),
    )
    state = state.withColumn("low", -700.0 * F.col("mean")).withColumn("high", 2.0 + 2.0 * F.col("mean")).withColumn("done", F.col("full"))
    state = cut(state, "dual")
    for _ in range(_NEWTON_STEPS):
        if not state.where(~F.col("done")).limit(1).count():
            return state.select("key", "mean", "full", "lam")
        rated = sized.join(state.where(~F.col("done")), "key").withColumn("r", _rate(most)).withColumn("words", F.col("r") * F.col("size") * F.col("n"))
        slope = F.when(F.col("r") < most, F.col("words") * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = rated.groupBy("key").agg(_whole(F.col("words")).alias("f"), _whole(slope).alias("df"))
        joined_from, joined = state, state.join(sums, "key", "left")
        over = F.col("f") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("high"))
        # Newton on the logarithm of the words, which is nearly straight
        newton = F.when((F.col("df") > 0) & (F.col("f") > 0) & (F.col("target") > 0), F.col("lam") + (F.log("target") - F.log("f")) * F.col("f") / F.col("df"))
        step = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        met = F.abs(F.col("f") - F.col("target")) <= _NEAR * F.col("target") + 0.01
        fresh = ~F.col("done")
        state = joined.select(
            "key",
            "target",
            "mean",
            "full",
            F.when(fresh & ~met, step).otherwise(F.col("lam")).alias("lam"),
            F.when(fresh, low).otherwise(F.col("low")).alias("low"),
            F.when(fresh, high).otherwise(F.col("high")).alias("high"),
            (F.col("done") | F.coalesce(met, F.lit(True))).alias("done"),
        )
        state = cut(state, "dual", instead_of=[joined_from])
    raise RuntimeError(f"rates did not settle in {_NEWTON_STEPS} steps")


def rounded_copies(histogram: DataFrame, lambdas: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(key, size, n, copies): copies of all n documents of a size together, most * n at most."""
    rated = histogram.join(lambdas, "key", "left").withColumn("r", F.when(F.col("size") > 0, _rate(float(most))).otherwise(1.0))
    down = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    rated = rated.withColumn("upto", F.round(F.sum(F.round(F.col("r") * F.col("n") * 1e6).cast("decimal(38,0)")).over(down).cast("double") / 1e6))
    before = F.lag("upto", 1, 0.0).over(Window.partitionBy("key").orderBy(F.desc("size")))
    limit = F.col("n") * most
    plan = rated.withColumn("copies", F.least(limit, F.greatest(F.lit(0), (F.col("upto") - before).cast("long"))))
    plan = cut(plan.select("key", "size", "n", "copies"), "copies")
    while True:
        changed = cut(_corrected(plan, targets, most), "corrections")
        if not changed.where("change <> 0").limit(1).count():
            forget(changed)
            return plan
        plan = cut(changed.select("key", "size", "n", (F.col("copies") + F.col("change")).alias("copies")), "copies", instead_of=[plan, changed])


def _corrected(plan: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """plan with change: copies to add or take away, by which a source comes nearer to its target.

    Sizes up to what is missing are used from the largest down, each with as many copies as there are and as still fit,
    up to the first that has more; what is missing then is less than half of what was left for that size. So rounds are
    as the logarithm of what is missing. If no size fits, one copy of the nearest size, where it takes a tenth at least.
    """
    taken = plan.groupBy("key").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    missing = targets.select("key", "target").join(taken, "key").select("key", "target", (F.col("target") - F.col("taken")).alias("missing"))
    gap, size = F.abs("missing"), F.col("size")
    open_ = (size > 0) & (gap > _FINE * F.col("target"))
    able = F.when(~open_, 0).when(F.col("missing") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
    down = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    tried = plan.join(missing, "key").withColumn("able", able).withColumn("room", F.when(size <= gap, F.col("able") * size).otherwise(0))
    left = gap - (F.sum("room").over(down) - F.col("room"))
    tried = tried.withColumn("many", F.when((F.col("room") > 0) & (left >= size), F.least("able", F.floor(left / size))).otherwise(0))
    far = F.abs(gap - size)
    single = F.when((F.col("able") > 0) & (far < gap * 0.9), F.struct(far.alias("far"), size.alias("size")))
    whole = Window.partitionBy("key")
    change = F.when(F.sum("many").over(whole) > 0, F.col("many")).when(F.min(single).over(whole)["size"] == size, 1).otherwise(0)
    return tried.select("key", "size", "n", "copies", (change * F.signum("missing")).cast("long").alias("change"))


def mixed_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): one row per row of docs.

    size: words of the text (null: 0); taken: words that the mix takes, copies times size, at most `most` times size.
    A null source is a source, after all others. Documents without words are taken once. Rows that share a doc_id count
    each for itself. No rows in: no rows out.
    """
    return _mixed(docs, weights, most)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3) -> DataFrame:
    """The rows of docs as the mix takes them: each as often as it has copies, none of those without."""
    one, two, copies, rows, copy = own_names(docs, "row_hash", "row_hash2", "n_copies", "n_rows", "nth_copy")
    keyed = docs.withColumn(one, F.xxhash64(*docs.columns)).withColumn(two, F.xxhash64(F.lit(1), *docs.columns))
    row = [one, two]
    taken = cut(_mixed(keyed, weights, most, row).groupBy(*row).agg(F.sum("copies").cast("int").alias(copies), F.count(F.lit(1)).alias(rows)), "taken")
    if taken.where(F.col(rows) > 1).limit(1).count():  # rows that are alike in all columns stand for each other
        keyed = keyed.dropDuplicates(row)
    many = keyed.join(taken.where(F.col(copies) > 0).drop(rows), row)
    return many.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def _mixed(docs: DataFrame, weights: tuple[float, ...], most: int, row: list[str] = []) -> DataFrame:
    """row: columns of docs by other names than those given out, which tell rows apart and are kept."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
        F.size(words_of(F.col("text"))).cast("long").alias("size"),
        *row,
    )
    sized = cut(sized, "sized")
    sized = sized.withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(max(64, sized.count() // RANKED))))
    parted = cut(sized.groupBy("key", "size", "part").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source")), "size-parts")
    histogram = cut(parted.groupBy("key", "size").agg(F.sum("n").alias("n"), F.first("source").alias("source")), "sizes")
    sources = histogram.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = cut(source_targets(sources, weights, float(most)), "targets")
    histogram = histogram.drop("source")
    plan = rounded_copies(histogram, dual_lambdas(histogram, targets, float(most)), targets, most)
    before = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parted.select("key", "size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    parts = parts.join(plan, ["key", "size"]).join(targets.select("key", "source_size", "target"), "key")
    order = Window.partitionBy("key", "size", "part").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = sized.withColumn("rank", F.row_number().over(order)).join(parts, ["key", "size", "part"])
    share, over = F.floor(F.col("copies") / F.col("n")).cast("long"), F.col("copies") % F.col("n")
    ranked = ranked.withColumn("copies", share + F.when(F.col("before") + F.col("rank") <= over, 1).otherwise(0))
    return ranked.select(*row, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
