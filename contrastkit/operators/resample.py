"""Permutation, bootstrap and leave-one-out checks.

Draws are whole numbers worked out from (seed, replicate, key), so that reruns, retried tasks and other engines agree.
All replicates run in one plan. A context of up to WHOLE units is one row, whose replicates are worked out together in
numpy; the units of a larger one are dealt to tasks by replicate and draw instead, which gives the same results.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrastkit.functions.numeric import EPS, sign
from contrastkit.operators.matched import matched, pair_diffs, pair_units, residuals
from contrastkit.operators.ordered import running
from contrastkit.session import cut, spread

#: Draws are numbers below this prime; so are the two numbers of a replicate. Keys are below 2 ** 28.
PRIME = 2147483647
#: Most units of a context that one row holds.
WHOLE = 4096
#: Units of a block, most blocks of a pair of classes, and replicates of a part: a task draws all of a part's replicates for
#: the contexts of a block.
_BLOCK, _BLOCKS, _PART = 1 << 21, 64, 500
#: Draws that one row holds, and how many that hit a block are worked out together.
_CHUNK, _HITS = 1 << 14, 1 << 19
#: Most numbers that are drawn at once: what a core's cache holds. Draws of a context that are put in order together, and the
#: least replicates that are, if there are as many.
_AT_ONCE, _DEALT, _LEAST = 1 << 14, 1 << 18, 128
#: Replicates in which the units of an arm are summed together, and contexts whose sums are held before they are compared.
_TIMES, _SOME = 250, 64


def hashed(*parts: Column | str) -> Column:
    """A number below 2 ** 28: the first seven digits of the md5 of the parts, joined by colons; a null part is empty."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def drawn(key: Column, v: Column, w: Column) -> Column:
    """A draw from 0 to PRIME - 1 for a key in a replicate with the numbers v and w."""
    x = (key * v + w) % PRIME
    x = (x * x + key) % PRIME
    return (x * v + w) % PRIME


def _keep_memory() -> None:
    """From now on this process keeps what it frees: malloc asks the system for fresh pages for each array of over 128 KB,
    which takes longer than to draw its numbers, until it has freed one of as many bytes (mallopt(3), M_MMAP_THRESHOLD)."""
    np.empty(31 << 20, np.uint8)


def _below_prime(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, in place, for x below 2 * PRIME as 32 bits: PRIME less wraps round to a large number below PRIME."""
    return np.minimum(x, x - np.uint32(PRIME), out=x)


def _modulo(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME as 32 bits, for x from 0 to PRIME ** 2 - PRIME: PRIME is 2 ** 31 - 1, so the high bits are added to the low ones."""
    out = (x >> 31).astype(np.uint32)
    out += x.astype(np.uint32) & np.uint32(PRIME)
    return _below_prime(out)


def _nearest(x: np.ndarray) -> np.ndarray:
    """What is x modulo PRIME and nearest to 0."""
    x = _modulo(x).astype(np.int64)
    return np.where(x > PRIME // 2, x - PRIME, x)


def _coefficients(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(3, replicates): a draw is a * key ** 2 + b * key + c modulo PRIME, where a and b are nearest to 0, and c is so large
    that the sum is not negative: with x = key * v + w it is x * x * v + x."""
    v, w = (np.atleast_1d(x).astype(np.int64) for x in (v, w))
    times = lambda x, y: _modulo(x * y).astype(np.int64)
    vv, vw = times(v, v), times(v, w)
    return np.stack([_nearest(v * vv), _nearest(2 * times(v, vw) + v), times(w, vw) + w + (PRIME << 30)])


def _draws(key: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, square: np.ndarray | None = None) -> np.ndarray:
    """drawn() as 32 bits, for keys as 64 bits, _coefficients and the keys' squares, nearest to 0. Sums are below 2 ** 62."""
    x = (_nearest(key * key) if square is None else square) * a
    x += key * b
    x += c
    return _modulo(x)


def _drawn(key: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """drawn() for the numbers v and w of one replicate."""
    return _draws(key.astype(np.int64), *_coefficients(v, w))


def _replicates(spark, repeats: int, seed: int) -> DataFrame:
    """(rep, v, w): the two numbers of each replicate."""
    number = lambda name: (hashed(str(seed), F.col("rep"), name) * 7 + 1) % PRIME
    return spark.range(repeats).select(F.col("id").cast("int").alias("rep"), number("v").alias("v"), number("w").alias("w"))


def _numbers(spark, repeats: int, seed: int) -> np.ndarray:
    """The _coefficients of all replicates: three numbers each, whatever the data."""
    found = _replicates(spark, repeats, seed).orderBy("rep").toArrow()
    return _coefficients(found.column("v").to_numpy(), found.column("w").to_numpy())


def _replicated(rows: DataFrame, repeats: int, seed: int) -> DataFrame:
    """rows once for each replicate, with rep, v and w."""
    many = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return many.join(F.broadcast(_replicates(rows.sparkSession, repeats, seed)), "rep")


def permuted(units: DataFrame, within: Sequence[str], unit: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """units for each replicate `rep`, with classes dealt anew among the units of each group `within`: in the order of
    draws, the first units get the first class, as many as it has."""
    many = _replicated(units.withColumn("_key", hashed(*[F.col(c) for c in unit])), repeats, seed)
    many = many.withColumn("_draw", drawn(F.col("_key"), F.col("v"), F.col("w"))).drop("v", "w")
    placed = running(many, ["rep", *within], ["_draw", *unit], {"_place": F.lit(1)})
    sizes = units.groupBy(*within, "cls").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*within).orderBy("cls").rowsBetween(Window.unboundedPreceding, 0))
    shares = sizes.withColumn("upto", upto).groupBy(*within).agg(F.array_sort(F.collect_list(F.struct("upto", "cls"))).alias("_shares"))
    dealt = placed.join(shares, list(within))
    return dealt.withColumn("cls", F.filter("_shares", lambda x: x["upto"] >= F.col("_place"))[0]["cls"]).drop("_shares", "_place", "_draw", "_key")


def _arms(units: DataFrame, within: Sequence[str], unit: Sequence[str], value: str) -> DataFrame:
    """(within, arms): one row for each group, with an array of (cls, members), and members of (unit, key, value), sorted."""
    member = F.struct(*[F.col(c).alias(f"u{k}") for k, c in enumerate(unit)], hashed(*[F.col(c) for c in unit]).alias("key"), F.col(value).alias("value"))
    own = spread(units, *within).groupBy(*within, "cls").agg(F.array_sort(F.collect_list(member)).alias("members"))
    return own.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct("cls", "members"))).alias("arms"))


def _flat(arms: DataFrame, *keep: str | Column) -> DataFrame:
    """(keep, classes, sizes, keys, values) of rows with arms: units in the order of (class, unit)."""
    members = F.flatten(F.transform("arms", lambda x: x["members"]))
    return arms.select(*keep, F.col("arms.cls").alias("classes"), F.transform("arms", lambda x: F.size(x["members"])).alias("sizes"), F.transform(members, lambda m: m["key"]).alias("keys"), F.transform(members, lambda m: m["value"]).alias("values"))


def _split(units: DataFrame, within: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The units of groups of at most WHOLE units, and of larger ones."""
    large = units.groupBy(*within).count().where(F.col("count") > WHOLE).select(*within)
    return units.join(large, list(within), "left_anti"), units.join(large, list(within), "left_semi")


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row's begin (and the last end)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return column.flatten(), ends


def _bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The len(a)-th least of all draws of a and b, each in order: the least are the smaller ones of a and b the other way."""
    k, m = len(a), min(len(a), len(b))
    out = np.minimum(a[k - m :], b[m - 1 :: -1]).max(axis=0)
    return np.maximum(out, a[k - m - 1]) if m < k else out


class _Dealt:
    """Contexts whose classes are dealt anew among their units: for each class the sum of residuals, for each pair of
    classes the difference of mean responses, summed over the contexts of a task. A context is drawn once for all of them."""

    def __init__(self, numbers: np.ndarray, classes: bool, pairs: bool, order: Sequence[str] | None) -> None:
        self.numbers, self.order, self.of_pairs = numbers, list(order or []), pairs
        self.totals, self.pairs = {} if classes else None, _PairSums(numbers.shape[1])

    def add(self, classes: list, sizes: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
        """A context: its classes in order, their sizes, and its units in the order of (class, unit).

        Dealing gives the k units of least draws to the first class or classes. What these sum up to is k times the commonest
        value, and for the other units whose draw is at most the k-th, by how much their values differ from it.
        """
        sizes, n = sizes.tolist(), len(keys)
        ends = [0, *itertools.accumulate(sizes)]
        arms = [slice(a, b) for a, b in zip(ends, ends[1:])]
        found, count = np.unique(values, return_counts=True)
        common, mean = found[count.argmax()], values.mean()
        odd = np.flatnonzero(values != common)
        beyond, square = values[odd] - common, _nearest(keys * keys)
        own, pairs = [], []
        if self.totals is not None:
            # what a class gets is what the first units get, less what goes to the classes before
            own = [self.totals.setdefault(c, np.zeros(self.pairs.repeats)) for c in classes]
            for total, k in zip(own, sizes):
                total += k * (common - mean)
            own[-1] += beyond.sum()
        if self.of_pairs:
            at = [0, *np.searchsorted(odd, ends[1:]).tolist()]
            place = [(self.order.index(c) if c in self.order else len(self.order), k) for k, c in enumerate(classes)]
            for a, b in ((a, b) for a in range(len(arms)) for b in range(len(arms)) if place[a] < place[b]):
                total, met = self.pairs.of((classes[a], classes[b]))
                own_odd = np.concatenate([np.arange(at[a], at[a + 1]), np.arange(at[b], at[b + 1])])
                # the mean of a less that of b: the first has the sum s of the units dealt to it, the other what is left
                each = 1 / sizes[a] + 1 / sizes[b]
                total += sizes[a] * common * each - (values[arms[a]].sum() + values[arms[b]].sum()) / sizes[b]
                met += 1
                pairs.append((a, b, total, own_odd, beyond[own_odd] * each))
        some = max(_LEAST, _DEALT // n)
        rows = max(1, 2 * _AT_ONCE // some)
        for first in range(0, self.pairs.repeats, some):
            at = slice(first, first + some)
            numbers = self.numbers[:, None, at]
            draws = np.concatenate([_draws(keys[a : a + rows, None], *numbers, square[a : a + rows, None]) for a in range(0, n, rows)])
            placed = np.ascontiguousarray(draws.T)
            placed.sort(axis=1)
            flat = placed.ravel()
            equal = flat[1:] == flat[:-1]
            tied = np.unique(np.flatnonzero(equal) // n) if equal.any() else ()
            theirs = draws[odd]
            for k, (total, upto) in enumerate(zip(own, ends[1:-1])):
                sums = beyond @ (theirs <= placed[:, upto - 1]).astype(np.float64)
                if len(tied):
                    self._in_order(draws, values - common, upto, tied, sums)
                total[at] += sums
                own[k + 1][at] -= sums
            if pairs:
                ranked = [np.ascontiguousarray(np.sort(np.ascontiguousarray(draws[arm].T), axis=1).T) for arm in arms]
            for a, b, total, own_odd, weights in pairs:
                sums = weights @ (theirs[own_odd] <= _bound(ranked[a], ranked[b])).astype(np.float64)
                if len(tied):
                    both, each = np.r_[arms[a], arms[b]], 1 / sizes[a] + 1 / sizes[b]
                    self._in_order(draws[both], (values[both] - common) * each, sizes[a], tied, sums)
                total[at] += sums

    def _in_order(self, draws: np.ndarray, values: np.ndarray, k: int, tied: np.ndarray, sums: np.ndarray) -> None:
        """Sets sums of the values of the k units of least draws in the replicates tied, where draws may be equal: the first
        of equal ones come first."""
        sums[tied] = values[np.argsort(draws[:, tied], axis=0, kind="stable")[:k]].sum(axis=0)

    def batches(self, kind: pa.DataType | None) -> Iterator[pa.RecordBatch]:
        """Rows as those of pairs; those of a class have no class_b and no contexts."""
        for name, total in (self.totals or {}).items():
            n = len(total)
            columns = [pa.array([name] * n, kind), pa.nulls(n, kind), pa.array(np.arange(n, dtype=np.int32)), pa.array(total), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["class_a", "class_b", "rep", "total", "contexts"])
        yield from self.pairs.batches(kind)


def _dealt_sums(own: DataFrame, context: Sequence[str], unit: Sequence[str], repeats: int, seed: int, classes: bool = False, pairs: bool = False, order: Sequence[str] | None = None) -> DataFrame:
    """(class_a, class_b, rep, total, contexts) of units dealt anew in the contexts of matched units; see _Dealt."""
    numbers = _numbers(own.sparkSession, repeats, seed)
    small, large = _split(own, context)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        found, kind = _Dealt(numbers, classes, pairs, order), None
        for batch in batches:
            keys, ends = _ragged(batch.column("keys"))
            keys, values = keys.to_numpy(zero_copy_only=False), _ragged(batch.column("values"))[0].to_numpy(zero_copy_only=False)
            sizes, edges = _ragged(batch.column("sizes"))
            names, sizes = _ragged(batch.column("classes"))[0], sizes.to_numpy(zero_copy_only=False)
            kind, names = names.type, names.to_pylist()
            for k in range(batch.num_rows):
                arms, members = slice(edges[k], edges[k + 1]), slice(ends[k], ends[k + 1])
                found.add(names[arms], sizes[arms], keys[members], values[members])
        yield from found.batches(kind)

    sums = _flat(_arms(small, context, unit, "response_rate")).mapInArrow(run, _pair_schema(own))
    if large.limit(1).count():
        if classes:
            wide = permuted(residuals(large, context), context, unit, repeats, seed)
            sums = sums.unionByName(wide.select(F.col("cls").alias("class_a"), F.lit(None).cast(own.schema["cls"].dataType).alias("class_b"), "rep", F.col("residual").alias("total"), F.lit(None).cast("long").alias("contexts")))
        if pairs:
            keys = ["class_a", "class_b"]
            wide = permuted(pair_units(large, context, order), [*keys, *context], unit, repeats, seed)
            wide = wide.groupBy(*keys, "rep", *context).agg(_difference().alias("total"))
            sums = sums.unionByName(wide.select(*keys, "rep", "total", F.lit(1).cast("long").alias("contexts")))
    return sums


def _tested(observed: DataFrame, stats: DataFrame, keys: Sequence[str], two_sided: bool) -> DataFrame:
    """p = (replicates at least as far out as observed + 1) / (replicates + 1)."""
    size = F.abs if two_sided else (lambda x: x)
    met = stats.where("stat is not null").join(observed.withColumnRenamed("stat", "observed"), list(keys))
    out = met.groupBy(*keys, "observed").agg(
        F.count(F.lit(1)).alias("permutations"),
        F.avg("stat").alias("permutation_mean"),
        F.percentile("stat", F.lit(0.025)).alias("p025"),
        F.percentile("stat", F.lit(0.975)).alias("p975"),
        ((F.count_if(size(F.col("stat")) >= size(F.col("observed")) - EPS) + 1) / (F.count(F.lit(1)) + 1)).alias("p"),
    )
    return out


def _matched_units(units: DataFrame, context: Sequence[str], unit: Sequence[str]) -> DataFrame:
    return cut(matched(units, context).select(*dict.fromkeys([*context, "cls", "ident", *unit, "response_rate"])), "matched-units")


def _range_test(own: DataFrame, sums: DataFrame, context: Sequence[str]) -> DataFrame:
    sizes = own.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.where("contexts is null").groupBy(F.col("class_a").alias("cls"), "rep").agg(F.sum("total").alias("total"))
    means = sums.join(F.broadcast(sizes), "cls").select("rep", (F.col("total") / F.col("n")).alias("m"))
    stats = means.groupBy("rep").agg(F.when(F.count(F.lit(1)) > 1, F.max("m") - F.min("m")).alias("stat")).withColumn("k", F.lit(0))
    observed = residuals(own, context).groupBy("cls").agg(F.avg("residual").alias("m")).agg(F.when(F.count(F.lit(1)) > 1, F.max("m") - F.min("m")).alias("stat")).withColumn("k", F.lit(0))
    return _tested(observed, stats, ["k"], two_sided=False).drop("k")


def _pair_test(own: DataFrame, sums: DataFrame, context: Sequence[str], order: Sequence[str] | None) -> DataFrame:
    keys = ["class_a", "class_b"]
    observed = pair_diffs(pair_units(own, context, order), context).select(*keys, "stat")
    return _tested(observed, _mean_of(sums.where("contexts is not null")), keys, two_sided=True)


def range_permutation(units: DataFrame, context: Sequence[str], unit: Sequence[str], repeats: int = 10000, seed: int = 54) -> DataFrame:
    """One row: the residual range against classes dealt anew within contexts; upper tail.

    Dealing leaves residuals and the classes' sizes as they are, so a replicate is a sum of residuals for each class.
    """
    own = _matched_units(units, context, unit)
    return _range_test(own, _dealt_sums(own, context, unit, repeats, seed, classes=True), context)


def _paired(arms: DataFrame, context: Sequence[str], order: Sequence[str] | None) -> DataFrame:
    """(context, class_a, class_b, arms): each pair of arms of a context."""
    place = lambda c: F.coalesce(*[F.when(c == name, F.lit(k)) for k, name in enumerate(order)], F.lit(len(order))) if order else F.lit(0)
    pairs = F.flatten(F.transform("arms", lambda a: F.transform("arms", lambda b: F.struct(a.alias("a"), b.alias("b"), F.struct(place(a["cls"]), a["cls"]).alias("pa"), F.struct(place(b["cls"]), b["cls"]).alias("pb")))))
    pairs = arms.select(*context, F.explode(F.filter(pairs, lambda x: x["pa"] < x["pb"])).alias("x"))
    return pairs.select(*context, F.col("x.a.cls").alias("class_a"), F.col("x.b.cls").alias("class_b"), F.array("x.a", "x.b").alias("arms"))


class _PairSums:
    """(class_a, class_b, rep, total, contexts): differences summed for each pair of classes of a task."""

    def __init__(self, repeats: int) -> None:
        self.repeats, self.held = repeats, {}

    def of(self, pair: tuple) -> tuple[np.ndarray, np.ndarray]:
        return self.held.setdefault(pair, (np.zeros(self.repeats), np.zeros(self.repeats, np.int64)))

    def batches(self, kind: pa.DataType | None) -> Iterator[pa.RecordBatch]:
        for (a, b), (total, contexts) in self.held.items():
            columns = [pa.array([a] * self.repeats, kind), pa.array([b] * self.repeats, kind), pa.array(np.arange(self.repeats, dtype=np.int32)), pa.array(total), pa.array(contexts)]
            yield pa.RecordBatch.from_arrays(columns, names=["class_a", "class_b", "rep", "total", "contexts"])


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """((class_a, class_b, block, part), kind, rows) of rows in the order of these: all rows of a batch that share them."""
    names = ("class_a", "class_b", "_block", "_part", "_kind")
    for batch in rows:
        codes = [batch.column(c).dictionary_encode() if c.startswith("class") else batch.column(c) for c in names]
        codes = np.array([(c.indices if isinstance(c, pa.DictionaryArray) else c).to_numpy(zero_copy_only=False) for c in codes])
        edges = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for first, last in zip(edges, edges[1:]):
            if last > first:
                *key, kind = (batch.column(c)[first].as_py() for c in names)
                yield tuple(key), kind, batch.slice(first, last - first)


def _dealt_blocks(rows: DataFrame) -> DataFrame:
    """rows with those of a block and part in one task, in order; there are more tasks than cores, as blocks are uneven."""
    keys = ["class_a", "class_b", "_block", "_part"]
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "_kind", "_at")


def _parts(repeats: int) -> Column:
    """The numbers of the parts of _PART replicates, one row each."""
    return F.explode(F.sequence(F.lit(0), F.lit((repeats - 1) // _PART))).alias("_part")


def _pair_schema(units: DataFrame) -> str:
    kind = units.schema["cls"].dataType.simpleString()
    return f"class_a {kind}, class_b {kind}, rep int, total double, contexts long"


def _mean_of(sums: DataFrame) -> DataFrame:
    """(class_a, class_b, rep, stat): the mean over contexts; null without any."""
    keys = ["class_a", "class_b", "rep"]
    own = sums.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("contexts").alias("contexts"))
    return own.select(*keys, F.try_divide(F.col("total"), F.col("contexts").cast("double")).alias("stat"))


def pair_permutation(units: DataFrame, context: Sequence[str], unit: Sequence[str], repeats: int = 10000, seed: int = 54, order: Sequence[str] | None = None) -> DataFrame:
    """For each pair of classes: the mean context difference against classes dealt anew within contexts; two-sided."""
    own = _matched_units(units, context, unit)
    return _pair_test(own, _dealt_sums(own, context, unit, repeats, seed, pairs=True, order=order), context, order)


def permutations(units: DataFrame, context: Sequence[str], unit: Sequence[str], repeats: int = 10000, seed: int = 54, order: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """range_permutation and pair_permutation, whose draws are the same: a context is drawn once for both."""
    own = _matched_units(units, context, unit)
    sums = cut(_dealt_sums(own, context, unit, repeats, seed, classes=True, pairs=True, order=order), "dealt-sums")
    return _range_test(own, sums, context), _pair_test(own, sums, context, order)


def _difference() -> Column:
    """An aggregate: the mean response of class_a's rows less that of class_b's."""
    arm = lambda s: F.avg(F.when(F.col("cls") == F.col(f"class_{s}"), F.col("response_rate")))
    return arm("a") - arm("b")


def _intervals(stats: DataFrame, observed: DataFrame, repeats: int) -> DataFrame:
    keys = ["class_a", "class_b"]
    s = F.col("stat")
    out = stats.where("stat is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("available"),
        F.avg(s).alias("bootstrap_mean"),
        F.percentile(s, F.lit(0.025)).alias("p025"),
        F.percentile(s, F.lit(0.975)).alias("p975"),
        F.avg((s > EPS).cast("double")).alias("above_zero"),
        F.avg((s < -EPS).cast("double")).alias("below_zero"),
    )
    out = observed.select(*keys, F.col("stat").alias("observed")).join(out, keys, "left").withColumn("requested", F.lit(repeats))
    return out.withColumn("available", F.coalesce("available", F.lit(0))).withColumn("unavailable", F.col("requested") - F.col("available"))


def context_bootstrap(units: DataFrame, context: Sequence[str], unit: Sequence[str], repeats: int = 5000, seed: int = 64, order: Sequence[str] | None = None) -> DataFrame:
    """For each pair: contexts drawn with replacement, then in each the units of either arm with replacement.

    No draw is shuffled. The contexts of a pair are cut into blocks; a task reads a block and the keys of all the pair's
    draws, works the draws out for a part of the replicates, and goes on with those that hit its block.
    """
    spark, keys = units.sparkSession, ["class_a", "class_b"]
    own = _matched_units(units, context, unit)
    small, large = _split(own, context)
    numbers = _numbers(spark, repeats, seed)
    pairs = _flat(_paired(_arms(small, context, unit, "response_rate"), context, order), *keys, *context)
    pairs = cut(pairs.select(*keys, *context, F.col("sizes").cast("array<int>").alias("sizes"), "values"), "pairs")
    wide = pair_units(large, context, order)
    every = pairs.select(*keys, *context, F.size("values").alias("_held")).unionByName(wide.select(*keys, *context).distinct().withColumn("_held", F.lit(0)))
    named = cut(running(every, keys, list(context), {"_c": F.lit(1), "_upto": "_held"}), "contexts")
    sizes = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("_held").alias("_units"))
    each = F.greatest(F.lit(_BLOCK), F.ceil(F.col("_units") / _BLOCKS))
    block = lambda upto: F.floor((upto - 1) / each).cast("int")
    # contexts: sizes and values; draws: the keys of the contexts and of the arms drawn
    held = named.where("_held > 0").join(F.broadcast(sizes), keys).select(*keys, *context, "_c", "_n", block(F.col("_upto")).alias("_block"))
    held = held.join(pairs, [*keys, *context]).select(*keys, "_block", _parts(repeats), F.lit(0).alias("_kind"), F.col("_c").alias("_at"), "_n", F.col("sizes").alias("_x"), F.lit(None).cast("array<int>").alias("_y"), "values")
    key_of = lambda name: hashed(name, F.col("class_a"), F.col("class_b"), F.col("_c")).cast("int")
    draws = named.select(*keys, "_c", F.floor((F.col("_c") - 1) / _CHUNK).alias("_at"), key_of("context").alias("x"), key_of("arm").alias("y"))
    draws = draws.groupBy(*keys, "_at").agg(F.array_sort(F.collect_list(F.struct("_c", "x", "y"))).alias("_d")).join(F.broadcast(sizes), keys)
    draws = draws.select(*keys, "_at", "_n", F.explode(F.sequence(F.lit(0), block(F.col("_units")))).alias("_block"), F.col("_d.x").alias("_x"), F.col("_d.y").alias("_y")).where("_block >= 0")
    draws = draws.select(*keys, "_block", _parts(repeats), F.lit(1).alias("_kind"), "_at", "_n", "_x", "_y", F.lit(None).cast("array<double>").alias("values"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        sums, kind, at, found = _PairSums(repeats), None, None, None
        for key, which, batch in _blocks(rows):
            kind = batch.column("class_a").type
            if key != at:
                if found:
                    found.flush()
                at, found = key, _Bootstrap(*sums.of(key[:2]), numbers, range(key[3] * _PART, min(repeats, (key[3] + 1) * _PART)))
            found.held(batch) if which == 0 else found.drawn(batch)
        if found:
            found.flush()
        yield from sums.batches(kind)

    sums = _dealt_blocks(held.unionByName(draws)).mapInArrow(run, _pair_schema(units))
    if large.limit(1).count():
        sums = sums.unionByName(_large_context_sums(wide, named.join(F.broadcast(sizes), keys), context, unit, repeats, seed))
    return _intervals(_mean_of(sums), pair_diffs(pair_units(own, context, order), context), repeats)


class _Bootstrap:
    """The contexts of a block, and the differences of what is drawn of them in some replicates."""

    def __init__(self, total: np.ndarray, times: np.ndarray, numbers: np.ndarray, reps: range) -> None:
        self.total, self.times, self.reps = total[reps.start : reps.stop], times[reps.start : reps.stop], reps
        self.numbers = numbers[:, reps.start : reps.stop]
        self.numbers = np.concatenate([self.numbers, _steps(self.numbers)])
        self.parts, self.hits, self.n_hits, self.place = [], [], 0, None

    def held(self, batch: pa.RecordBatch) -> None:
        values = _ragged(batch.column("values"))[0].to_numpy(zero_copy_only=False)
        sizes = _ragged(batch.column("_x"))[0].to_numpy(zero_copy_only=False).reshape(-1, 2)
        self.parts.append((batch.column("_at").to_numpy(zero_copy_only=False), sizes, values))

    def drawn(self, batch: pa.RecordBatch) -> None:
        if self.place is None:
            if not self.parts:
                return
            c, self.sizes, self.values = (np.concatenate(x) for x in zip(*self.parts))
            self.low = int(c.min())
            self.place = np.full(int(c.max()) - self.low + 1, -1, np.int32)
            self.place[c - self.low] = np.arange(len(c))
            ends = np.cumsum(self.sizes.astype(np.int64).sum(axis=1))
            first = np.concatenate([[0], ends[:-1]])
            self.first, self.sizes = (first, first + self.sizes[:, 0]), tuple(np.ascontiguousarray(x, np.uint16) for x in self.sizes.T)
            self.parts = []
        n = batch.column("_n")[0].as_py()
        columns = [_ragged(batch.column(c)) for c in ("_x", "_y")]
        x, y = (c[0].to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        for a in range(0, len(x), _AT_ONCE):
            context, arm = x[a : a + _AT_ONCE], y[a : a + _AT_ONCE]
            each = max(1, _AT_ONCE // len(context))
            for b in range(0, len(self.reps), each):
                at = _draws(context, *self.numbers[:3, b : b + each, None]).astype(np.int64) * n // PRIME + (1 - self.low)
                rep, draw = np.nonzero((at >= 0) & (at < len(self.place)))
                place = self.place[at[rep, draw]]
                there = place >= 0
                self.hits.append(((b + rep[there]).astype(np.int32), arm[draw[there]].astype(np.int32), place[there]))
                self.n_hits += len(self.hits[-1][0])
                if self.n_hits >= _HITS:
                    self.flush()

    def flush(self) -> None:
        """Draws the units of the contexts hit, those of arms of one size together."""
        if not self.n_hits:
            return
        rep, key, place = (np.concatenate(x) for x in zip(*self.hits))
        self.hits, self.n_hits = [], 0
        for side, part in ((0, 1.0), (1, -1.0)):
            sizes = self.sizes[side].take(place)
            order, begin = np.argsort(sizes, kind="stable"), 0
            for n, count in enumerate(np.bincount(sizes).tolist()):
                for a in range(begin, begin + count, _AT_ONCE):
                    rows = order[a : min(a + _AT_ONCE, begin + count)]
                    own, first, total = rep.take(rows), self.first[side].take(place.take(rows)), np.zeros(len(rows))
                    for draw in _slot_draws(key.take(rows).astype(np.int64), self.numbers.take(own, axis=1), n, side):
                        # no product is nearer to a whole number than 1 / PRIME, unless it is 0
                        total += self.values.take(first + (draw * (n / PRIME)).astype(np.int32))
                    self.total += np.bincount(own, weights=total, minlength=len(self.total)) * (part / n)
                begin += count
        self.times += np.bincount(rep, minlength=len(self.times))


def _steps(numbers: np.ndarray) -> np.ndarray:
    """(3, replicates): where a key grows by 2 * _SLOT, its draw grows by the first number times the key and the second, and
    that by the third, modulo PRIME."""
    a, b, step = numbers[0] % PRIME, numbers[1] % PRIME, 2 * _SLOT
    last = 2 * (a * step % PRIME) % PRIME
    return np.stack([last, (a * step % PRIME * step + b * step) % PRIME, last * step % PRIME])


def _slot_draws(key: np.ndarray, numbers: np.ndarray, n: int, side: int) -> Iterator[np.ndarray]:
    """The draws of the n slots of an arm, one slot after the other, for the keys and numbers (_coefficients and _steps) of
    arms drawn. A draw is the same array each time.

    A slot's key is 2 * _SLOT above that of the slot before, modulo 2 ** 28. Draws are a square in the key, so they grow by
    numbers that grow by the same number each time. Draws of keys that begin anew are worked out one by one.
    """
    mask, step = (1 << 28) - 1, 2 * _SLOT
    key = (key + _SLOT * side) & mask
    draw, more, again = _draws(key, *numbers[:3]), _modulo(key * numbers[3] + numbers[4]), numbers[5].astype(np.uint32)
    late = np.flatnonzero(key + step * (n - 1) > mask)
    some = max(1, _AT_ONCE // max(1, len(late)))
    for k in range(n):
        if k:
            _below_prime(np.add(draw, more, out=draw))
            _below_prime(np.add(more, again, out=more))
        if len(late):
            if k % some == 0:
                slots = np.arange(k, min(k + some, n))[:, None]
                anew = _draws((key[late] + step * slots) & mask, *numbers[:3, None, late])
            draw[late] = anew[k % some]
        yield draw


def _large_context_sums(wide: DataFrame, named: DataFrame, context: Sequence[str], unit: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """(class_a, class_b, rep, total, contexts) of the draws of contexts of more than WHOLE units: one row for each unit drawn."""
    keys = ["class_a", "class_b"]
    reps = _replicates(wide.sparkSession, repeats, seed)
    arm = [*keys, *context, "cls"]
    placed = running(wide, arm, list(unit), {"_slot": F.lit(1)})
    arms = wide.groupBy(*arm).agg(F.count(F.lit(1)).alias("_arm"))
    # the keys of a draw are hashed once for all replicates
    key_of = lambda name: hashed(name, F.col("class_a"), F.col("class_b"), F.col("_c")).alias(f"_{name}")
    draws = _replicated(spread(named.select(*keys, F.col("_c").alias("_draw"), "_n", key_of("context"), key_of("arm"))), repeats, seed)
    draw = drawn(F.col("_context"), F.col("v"), F.col("w"))
    draws = draws.select(*keys, (F.floor(draw * F.col("_n") / F.lit(PRIME)) + 1).cast("long").alias("_c"), "rep", "_draw", F.col("_arm").alias("_key"))
    hit = draws.join(F.broadcast(named.where("_held = 0").select(*keys, *context, "_c")), [*keys, "_c"])
    hit = hit.join(arms, [*keys, *context]).join(F.broadcast(reps), "rep")
    slots = hit.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_arm") - 1)))
    side = F.when(F.col("cls") == F.col("class_a"), 0).otherwise(1)
    key = (F.col("_key") + _SLOT * (2 * F.col("_k") + side)) % (1 << 28)
    slots = slots.withColumn("_slot", F.floor(drawn(key, F.col("v"), F.col("w")) * F.col("_arm") / F.lit(PRIME)).cast("long") + 1)
    picked = slots.join(placed.select(*arm, "_slot", "response_rate"), [*arm, "_slot"])
    return picked.groupBy(*keys, "rep", "_draw").agg(_difference().alias("total")).select(*keys, "rep", "total", F.lit(1).cast("long").alias("contexts"))


#: What sets the slots of an arm apart.
_SLOT = 104729


def cluster_bootstrap(units: DataFrame, context: Sequence[str], repeats: int = 5000, seed: int = 64, order: Sequence[str] | None = None) -> DataFrame:
    """For each pair: identities of either arm drawn with replacement; a unit counts as often as its identity was drawn.

    Contexts that lose an arm drop out; a replicate without contexts is unavailable. degenerate: an arm has one identity.
    A task reads a block of contexts and the keys of the pair's identities, and works out how often these are drawn; only
    the units of contexts of more than WHOLE units carry that with them.
    """
    keys = ["class_a", "class_b"]
    pair = cut(pair_units(matched(units, context), context, order).select(*keys, *context, "cls", "ident", "response_rate"), "pair-units")
    arm = [*keys, "cls"]
    named = cut(running(pair.select(*arm, "ident").distinct(), arm, ["ident"], {"_i": F.lit(1)}), "identities")
    small, large = _split(pair, [*keys, *context])
    numbers = _numbers(units.sparkSession, repeats, seed)
    side = (F.col("cls") == F.col("class_b")).cast("int")
    sizes = pair.groupBy(*keys).agg(F.count(F.lit(1)).alias("_units"))
    many = F.least(F.lit(_BLOCKS), F.ceil(F.col("_units") / _BLOCK)).cast("int")
    block = F.pmod(F.xxhash64(F.struct(*context)), many).cast("int")
    # contexts: their units' sides and identities, and responses; identities: the keys of their draws
    member = F.struct(side.alias("s"), F.col("_i").cast("int").alias("i"), "response_rate")
    held = small.join(named, [*arm, "ident"]).groupBy(*keys, *context).agg(F.array_sort(F.collect_list(member)).alias("_m")).join(F.broadcast(sizes), keys)
    held = held.where(F.array_contains("_m.s", 0) & F.array_contains("_m.s", 1))
    held = held.select(*keys, block.alias("_block"), F.xxhash64(F.struct(*context)).alias("_at"), F.col("_m.s").alias("_x"), F.col("_m.i").alias("_y"), F.col("_m.response_rate").alias("values"))
    held = held.select(*keys, "_block", _parts(repeats), F.lit(1).alias("_kind"), "_at", "_x", "_y", "values")
    draws = named.select(*keys, side.alias("_side"), F.floor((F.col("_i") - 1) / _CHUNK).alias("_at"), F.struct("_i", hashed("identity", *[F.col(c) for c in arm], F.col("_i")).cast("int").alias("x")).alias("_d"))
    draws = draws.groupBy(*keys, "_side", "_at").agg(F.array_sort(F.collect_list("_d")).alias("_d")).join(F.broadcast(sizes), keys)
    draws = draws.select(*keys, "_side", "_at", F.explode(F.sequence(F.lit(0), many - 1)).alias("_block"), F.col("_d.x").alias("_x"))
    draws = draws.select(*keys, "_block", _parts(repeats), F.lit(0).alias("_kind"), "_at", "_x", F.array("_side").alias("_y"), F.lit(None).cast("array<double>").alias("values"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        sums, kind, at, found = _PairSums(repeats), None, None, None
        for key, which, batch in _blocks(rows):
            kind = batch.column("class_a").type
            if key != at:
                at, found = key, _Clusters(*sums.of(key[:2]), numbers, range(key[3] * _PART, min(repeats, (key[3] + 1) * _PART)))
            found.keyed(batch) if which == 0 else found.met(batch)
        yield from sums.batches(kind)

    sums = _dealt_blocks(held.unionByName(draws)).mapInArrow(run, _pair_schema(units))
    if large.limit(1).count():
        sums = sums.unionByName(_large_cluster_sums(large, named, context, repeats, seed))
    ends = named.groupBy(*keys).agg(F.count_if(F.col("cls") == F.col("class_a")).alias("idents_a"), F.count_if(F.col("cls") == F.col("class_b")).alias("idents_b"))
    return _intervals(_mean_of(sums), pair_diffs(pair, context), repeats).join(ends, keys).withColumn("degenerate", (F.least("idents_a", "idents_b") < 2).cast("int"))


class _Clusters:
    """The keys of both arms' identities, and the differences of contexts whose units count as often as these are drawn."""

    def __init__(self, total: np.ndarray, times: np.ndarray, numbers: np.ndarray, reps: range) -> None:
        self.total, self.times, self.numbers, self.reps = total, times, numbers, reps
        self.keys = ([], [])

    def keyed(self, batch: pa.RecordBatch) -> None:
        x, ends = _ragged(batch.column("_x"))
        x = x.to_numpy(zero_copy_only=False).astype(np.int64)
        for k, side in enumerate(_ragged(batch.column("_y"))[0].to_pylist()):
            self.keys[side].append(x[ends[k] : ends[k + 1]])

    def _drawn(self, first: int, last: int) -> np.ndarray:
        """How often each identity of either arm, one after the other, is drawn in each of some replicates."""
        out = []
        for own in self.keys:
            keys = np.concatenate(own)
            found = np.empty((last - first, len(keys)), np.int32)
            for r in range(first, last):
                at = _draws(keys, *self.numbers[:, r]).astype(np.int64) * len(keys) // PRIME
                found[r - first] = np.bincount(at, minlength=len(keys))
            out.append(found)
        return np.concatenate(out, axis=1)

    def met(self, batch: pa.RecordBatch) -> None:
        side, ends = _ragged(batch.column("_x"))
        side = side.to_numpy(zero_copy_only=False).astype(np.int64)
        n_a = sum(map(len, self.keys[0]))
        ident = _ragged(batch.column("_y"))[0].to_numpy(zero_copy_only=False).astype(np.int64) - 1 + side * n_a
        rate = _ragged(batch.column("values"))[0].to_numpy(zero_copy_only=False)
        # a context has both arms, a before b
        middle = ends[1:] - np.add.reduceat(side, ends[:-1])
        arms = np.stack([ends[:-1], middle, ends[1:]], axis=1)
        most = int(np.diff(arms, axis=1).max())
        each = max(1, min(_TIMES, (1 << 24) // max(1, sum(len(x) for own in self.keys for x in own))))
        for first in range(self.reps.start, self.reps.stop, each):
            drawn_ = np.ascontiguousarray(self._drawn(first, min(first + each, self.reps.stop)).T, np.float64)
            n = drawn_.shape[1]
            low, top, times = np.empty((_SOME, 2, n)), np.empty((_SOME, 2, n)), np.empty((most, n))
            for a in range(0, len(arms), _SOME):
                mine = arms[a : a + _SOME].tolist()
                for k, (begin, mid, end) in enumerate(mine):
                    for s, own in enumerate((slice(begin, mid), slice(mid, end))):
                        found = drawn_.take(ident[own], axis=0, out=times[: own.stop - own.start], mode="clip")
                        np.add.reduce(found, axis=0, out=low[k, s])
                        np.dot(rate[own], found, out=top[k, s])
                there = (low[: len(mine)] > 0).all(axis=1)
                with np.errstate(invalid="ignore"):
                    means = top[: len(mine)] / low[: len(mine)]
                found = np.where(there, means[:, 0] - means[:, 1], 0.0)
                self.total[first : first + n] += found.sum(axis=0)
                self.times[first : first + n] += there.sum(axis=0)


def _large_cluster_sums(large: DataFrame, named: DataFrame, context: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """(class_a, class_b, rep, total, contexts) of contexts of more than WHOLE units: a unit carries how often its identity
    was drawn in each replicate, and a context's units are read one after the other."""
    keys = ["class_a", "class_b"]
    arm = [*keys, "cls"]
    sizes = named.groupBy(*arm).agg(F.count(F.lit(1)).alias("_n"))
    keyed = named.join(F.broadcast(sizes), arm).select(*arm, "_n", hashed("identity", *[F.col(c) for c in arm], F.col("_i")).alias("_identity"))
    draws, draw = _replicated(spread(keyed), repeats, seed), drawn(F.col("_identity"), F.col("v"), F.col("w"))
    draws = draws.select(*arm, (F.floor(draw * F.col("_n") / F.lit(PRIME)).cast("long") + 1).alias("_i"), "rep")
    times = draws.groupBy(*arm, "_i", "rep").agg(F.count(F.lit(1)).alias("n")).groupBy(*arm, "_i").agg(F.map_from_entries(F.collect_list(F.struct("rep", "n"))).alias("n"))
    every = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: F.coalesce(F.try_element_at("n", r), F.lit(0)).cast("int"))
    times = named.join(times, [*arm, "_i"]).select(*arm, "ident", every.alias("times"))
    weighted = large.join(times, [*arm, "ident"]).select(*keys, F.struct(*context).alias("_context"), (F.col("cls") == F.col("class_b")).cast("int").alias("_side"), "response_rate", "times")
    weighted = spread(weighted, *keys, "_context").sortWithinPartitions(*keys, "_context")
    weighted = weighted.select(*keys, F.xxhash64("_context").alias("_context"), "_side", "response_rate", "times")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kind = _PairSums(repeats), None
        at, top, low = None, np.zeros((2, repeats)), np.zeros((2, repeats))

        def close() -> None:
            if at is None:
                return
            total, met = sums.of(at[:2])
            there = (low > 0).all(axis=0)
            total[there] += top[0, there] / low[0, there] - top[1, there] / low[1, there]
            met[there] += 1
            top[:], low[:] = 0.0, 0.0

        for batch in rows:
            kind = batch.column("class_a").type
            values, ends = _ragged(batch.column("times"))
            values = values.to_numpy(zero_copy_only=False)
            a, b, where, side, rate = (batch.column(c).to_pylist() for c in ("class_a", "class_b", "_context", "_side", "response_rate"))
            for k in range(batch.num_rows):
                if (a[k], b[k], where[k]) != at:
                    close()
                    at = (a[k], b[k], where[k])
                own = values[ends[k] : ends[k + 1]]
                top[side[k]] += rate[k] * own
                low[side[k]] += own
        close()
        yield from sums.batches(kind)

    return weighted.mapInArrow(run, _pair_schema(large))


def _pair_diffs_without(pair: DataFrame, context: Sequence[str]) -> DataFrame:
    """pair_diffs without each identity of a pair: only its own contexts are worked out anew, from their other identities."""
    keys = ["class_a", "class_b"]
    place = [*keys, *context]
    arms = [F.when(F.col("cls") == F.col(f"class_{s}"), F.col("response_rate")) for s in "ab"]
    sums = [F.coalesce(F.sum(x), F.lit(0.0)).alias(f"sum_{s}") for s, x in zip("ab", arms)]
    own = pair.groupBy(*place, "ident").agg(*sums, *[F.count(x).alias(f"n_{s}") for s, x in zip("ab", arms)])
    here = own.groupBy(*place).agg(*[F.sum(f"{x}_{s}").alias(f"{x}_{s}_all") for x in ("sum", "n") for s in "ab"])
    mean = lambda total, n: F.try_divide(total, n.cast("double"))
    here = here.withColumn("_diff", mean(F.col("sum_a_all"), F.col("n_a_all")) - mean(F.col("sum_b_all"), F.col("n_b_all")))
    rest = {f"{x}_{s}": F.col(f"{x}_{s}_all") - F.col(f"{x}_{s}") for x in ("sum", "n") for s in "ab"}
    anew = own.join(here, place).withColumns(rest).withColumn("_new", mean(F.col("sum_a"), F.col("n_a")) - mean(F.col("sum_b"), F.col("n_b")))
    there = F.col("_diff").isNotNull()
    whole = here.groupBy(*keys).agg(F.sum("_diff").alias("all_diffs"), F.count("_diff").alias("all_contexts"), F.sum(F.when(there, F.col("n_a_all") + F.col("n_b_all"))).alias("all_units"))
    change = anew.groupBy(*keys, F.col("ident").alias("held_out")).agg(
        F.sum(F.coalesce("_new", F.lit(0.0)) - F.coalesce("_diff", F.lit(0.0))).alias("diffs"),
        (F.count("_new") - F.count("_diff")).alias("more"),
        F.sum(F.when(F.col("_new").isNotNull(), F.col("n_a") + F.col("n_b")).otherwise(0) - F.when(there, F.col("n_a_all") + F.col("n_b_all")).otherwise(0)).alias("units"),
    )
    contexts = F.col("all_contexts") + F.col("more")
    out = change.join(whole, keys).withColumns({"contexts": contexts, "units": (F.col("all_units") + F.col("units")).cast("long"), "stat": F.when(contexts > 0, mean(F.col("all_diffs") + F.col("diffs"), contexts))})
    return out.select(*keys, "held_out", "contexts", "units", "stat")


def leave_one_out_pairs(units: DataFrame, context: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """For each pair and identity in its contexts: the pair's statistic without that identity.

    sign_changed: the statistic is there and its sign is another, going to 0 included.
    """
    keys = ["class_a", "class_b"]
    pair = pair_units(units, context, order)
    observed = pair_diffs(pair, context).select(*keys, F.col("stat").alias("observed"))
    held = pair.select(*keys, "ident").distinct()
    left = _pair_diffs_without(pair, context)
    out = held.withColumnRenamed("ident", "held_out").join(left, [*keys, "held_out"], "left").join(observed, keys)
    changed = F.col("stat").isNotNull() & (sign(F.col("observed")) != 0) & (sign(F.col("stat")) != sign(F.col("observed")))
    return out.select(
        *keys,
        "held_out",
        "observed",
        F.coalesce("contexts", F.lit(0)).alias("remaining_contexts"),
        F.coalesce("units", F.lit(0)).alias("remaining_units"),
        "stat",
        F.col("stat").isNull().cast("int").alias("unavailable"),
        changed.cast("int").alias("sign_changed"),
    )


def leave_one_out_range(units: DataFrame, context: Sequence[str]) -> DataFrame:
    """For each identity: the residual range without it, and what is left of the matched contexts.

    Only the contexts of an identity change without it: each of their classes is worked out anew, and the change is
    added to the classes' sums over all contexts.
    """
    place = list(context)
    by_class = units.groupBy(*place, "cls").agg(F.sum("response_rate").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = by_class.groupBy(*place).agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("k"))
    here = cut(by_class.join(whole, place), "class-sums")
    residual = F.col("s") - F.col("n") * F.col("s_all") / F.col("n_all")
    shared = F.col("k") > 1
    here = here.withColumn("old", F.when(shared, residual).otherwise(0.0)).withColumn("old_n", F.when(shared, F.col("n")).otherwise(0))
    totals = here.groupBy("cls").agg(F.sum("old").alias("r"), F.sum("old_n").alias("u"))
    own = cut(units.groupBy(*place, "ident", "cls").agg(F.sum("response_rate").alias("ds"), F.count(F.lit(1)).alias("dn")), "identity-sums")
    gone = own.join(by_class.select(*place, "cls", "n"), [*place, "cls"]).groupBy(*place, "ident").agg(F.sum("ds").alias("ds_all"), F.sum("dn").alias("dn_all"), F.count_if(F.col("n") == F.col("dn")).alias("lost"))
    anew = here.join(gone, place).join(own, [*place, "ident", "cls"], "left").na.fill(0, ["ds", "dn"])
    left = F.col("k") - F.col("lost")
    s, n = F.col("s") - F.col("ds"), F.col("n") - F.col("dn")
    mean = F.try_divide(F.col("s_all") - F.col("ds_all"), (F.col("n_all") - F.col("dn_all")).cast("double"))
    stays = (left > 1) & (n > 0)
    anew = anew.withColumn("new", F.when(stays, s - n * mean).otherwise(0.0)).withColumn("new_n", F.when(stays, n).otherwise(0))
    change = cut(anew.groupBy("ident", "cls").agg(F.sum(F.col("new") - F.col("old")).alias("dr"), F.sum(F.col("new_n") - F.col("old_n")).alias("du")), "changes")
    contexts = gone.join(whole, place).groupBy("ident").agg(F.sum((left > 1).cast("int") - shared.cast("int")).alias("dc"))
    one = lambda frame: frame.withColumn("_one", F.lit(1))
    every = one(units.select("ident").distinct()).join(F.broadcast(one(totals)), "_one").drop("_one")  # a row for each class
    sums = every.join(change, ["ident", "cls"], "left").na.fill(0, ["dr", "du"]).withColumn("u", F.col("u") + F.col("du"))
    sums = sums.groupBy("ident").agg(F.count_if(F.col("u") > 0).alias("classes"), F.sum("u").cast("long").alias("remaining_units"), F.max(F.when(F.col("u") > 0, (F.col("r") + F.col("dr")) / F.col("u"))).alias("high"), F.min(F.when(F.col("u") > 0, (F.col("r") + F.col("dr")) / F.col("u"))).alias("low"))
    base = one(whole.agg(F.count_if(shared).alias("c")))
    out = one(sums.join(contexts, "ident")).join(F.broadcast(base), "_one").drop("_one")
    stat = F.when(F.col("classes") > 1, F.col("high") - F.col("low"))
    return out.select(F.col("ident").alias("held_out"), stat.alias("stat"), (F.col("c") + F.col("dc")).cast("long").alias("remaining_contexts"), "remaining_units", stat.isNull().cast("int").alias("unavailable"))


def leave_one_out_summary(rows: DataFrame) -> DataFrame:
    """For each pair: how many holdouts make the statistic unavailable or change its sign, and its range."""
    return rows.groupBy("class_a", "class_b").agg(
        F.count(F.lit(1)).alias("idents_tested"),
        F.sum("unavailable").cast("long").alias("unavailable_holdouts"),
        F.sum("sign_changed").cast("long").alias("sign_change_holdouts"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("sign_changed") == 1, F.col("held_out")))), ";").alias("changing_sign"),
        F.min("remaining_contexts").alias("min_remaining_contexts"),
        F.max("remaining_contexts").alias("max_remaining_contexts"),
        F.min("stat").alias("min_stat"),
        F.max("stat").alias("max_stat"),
    )


def _dealt_anew(rows: DataFrame, cls: str, ident: str, seed: int, repeats: int) -> DataFrame:
    """(_ident, rep, _new): the class of each identity in each replicate."""
    named = running(rows.groupBy(F.col(ident).alias("_ident")).agg(F.min(cls).alias("_new")), [], ["_ident"], {"_place": F.lit(1)})
    named = cut(named, "identities")
    many = _replicated(named.select("_ident", "_new"), repeats, seed)
    many = many.select("rep", "_ident", "_new", drawn(hashed("shuffle", F.col("_ident")), F.col("v"), F.col("w")).alias("_draw"))
    dealt = running(many, ["rep"], ["_draw", "_ident"], {"_place": F.lit(1)}).select("rep", "_place", "_new")
    return named.select("_ident", "_place").join(dealt, "_place").drop("_place")


def shuffled_classes(rows: DataFrame, cls: str, ident: str, seed: int, repeats: int = 1, name: str = "shuffled") -> DataFrame:
    """rows for each replicate `rep`, with the classes of identities dealt anew among identities; an identity of several
    classes stands for the first of them. The identity of the k-th smallest draw gives its class to the k-th by name."""
    new = _dealt_anew(rows, cls, ident, seed, repeats).withColumnRenamed("_new", name)
    return rows.join(new, F.col(ident).eqNullSafe(F.col("_ident"))).drop("_ident")


def dealt_classes(rows: DataFrame, cls: str, ident: str, seed: int, repeats: int = 1) -> DataFrame:
    """(ident, dealt): the classes that shuffled_classes gives to an identity, by replicate. One row for each identity."""
    new = _dealt_anew(rows, cls, ident, seed, repeats).groupBy(F.col("_ident").alias(ident))
    return new.agg(F.array_sort(F.collect_list(F.struct("rep", F.col("_new").alias("c")))).alias("_d")).select(ident, F.transform("_d", lambda x: x["c"]).alias("dealt"))
