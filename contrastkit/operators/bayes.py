"""A categorical naive Bayes classifier, cross-validated for all splits, models and folds in one plan.

Counts of (feature, value, label) are taken once for all rows and once for each fold; a fold's training counts are their
difference. So the logarithms of a value are those of all rows, but for the folds that it is found in: a value carries
those as a map, and a row, or a tuple of values that many rows share, looks its fold up.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrastkit.operators.metrics import best_of_counted, evaluated, of_counted
from contrastkit.operators.ordered import null_safe, running, with_row_id
from contrastkit.session import cut, spread

#: Decimal places of a score: sums taken in another order tie alike.
PLACES = 12


def _score(odds: Column) -> Column:
    """The probability of label 1 of log odds of label 0."""
    return F.round(1 / (1 + F.exp(odds)), PLACES)


class _Fit:
    """Logarithms of a set of models, for all splits and folds."""

    def __init__(self, rows: DataFrame, folds: DataFrame, models: Mapping[str, Sequence[str]], label: str, row_id: str, alpha: float, ident: str | None = None) -> None:
        self.models, self.alpha = models, alpha
        self.features = sorted({f for own in models.values() for f in own})
        self.place = {f: k for k, f in enumerate(self.features)}
        values = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"_v{k}") for k, f in enumerate(self.features)]
        kept = [F.col(ident).alias("_ident")] if ident else []
        own = rows.select(row_id, F.col(label).cast("int").alias("label"), *values, *kept)
        self.placed = cut(spread(folds.select("split", row_id, "fold").join(own, row_id)), "placed")
        self.values = cut(self._values(), "values") if self.features else None
        self.constants = cut(self._constants(), "constants")

    def _values(self) -> DataFrame:
        """(split, feature, value, c0, c1, inside): counts by label, and those inside each fold that holds the value."""
        each = F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"_v{k}").alias("value")) for k in range(len(self.features))])
        long = self.placed.select("split", "fold", "label", F.explode(each).alias("x")).select("split", "fold", "label", "x.feature", "x.value")
        inside = long.groupBy("split", "feature", "value", "fold").agg(F.count_if(F.col("label") == 0).alias("l0"), F.count_if(F.col("label") == 1).alias("l1"))
        entry = F.struct("fold", F.struct("l0", "l1"))
        return inside.groupBy("split", "feature", "value").agg(F.sum("l0").alias("c0"), F.sum("l1").alias("c1"), F.map_from_entries(F.collect_list(entry)).alias("inside"))

    def _constants(self) -> DataFrame:
        """(split, fold, n, p, parts): size and positives of the fold, and for each model the log odds of label 0 that do
        not depend on values."""
        inside = self.placed.groupBy("split", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("p"))
        whole = inside.groupBy("split").agg(F.sum("n").alias("_n"), F.sum("p").alias("_p"))
        out = inside.join(whole, "split").withColumn("n1", F.col("_p") - F.col("p")).withColumn("n0", F.col("_n") - F.col("n") - F.col("n1"))
        kinds = F.create_map()
        if self.features:
            total = self.values.groupBy("split", "feature").agg(F.count(F.lit(1)).alias("k"))
            # a value found in one fold only is not met in that fold's training rows
            only = self.values.where(F.size("inside") == 1).groupBy("split", "feature", F.map_keys("inside")[0].alias("fold")).agg(F.count(F.lit(1)).alias("gone"))
            met = inside.select("split", "fold").join(total, "split").join(only, ["split", "feature", "fold"], "left")
            met = met.groupBy("split", "fold").agg(F.map_from_entries(F.collect_list(F.struct("feature", (F.col("k") - F.coalesce("gone", F.lit(0)) + 1).alias("k")))).alias("met"))
            out, kinds = out.join(met, ["split", "fold"]), F.col("met")
        a = self.alpha
        size = lambda y, f: F.log(F.col(f"n{y}") + a * kinds[F.lit(self.place[f])])
        parts = []
        for name, own in self.models.items():
            odds = F.log(F.col("n0") + a) - F.log(F.col("n1") + a)
            for f in own:
                odds = odds - (size(0, f) - size(1, f))
            parts.append(F.struct(F.lit(name).alias("model"), odds.alias("odds")))
        return out.select("split", "fold", "n", "p", F.array(*parts).alias("parts"))

    def attached(self, rows: DataFrame) -> DataFrame:
        """rows (split, _v0, _v1, ...) with what each value brings: one join for each feature; a null value brings nothing."""
        a = self.alpha
        odds = lambda c0, c1: F.log(c0 + a) - F.log(c1 + a)
        for k in range(len(self.features)):
            own = self.values.where(F.col("feature") == k).select(
                F.col("split").alias("_split"),
                F.col("value").alias("_value"),
                odds(F.col("c0"), F.col("c1")).alias(f"_odds{k}"),
                F.transform_values("inside", lambda _, x: odds(F.col("c0") - x["l0"], F.col("c1") - x["l1"])).alias(f"_in{k}"),
            )
            rows = rows.join(own, (F.col("split") == F.col("_split")) & (F.col(f"_v{k}") == F.col("_value")), "left").drop("_split", "_value")
        return rows

    def odds(self, constant: Column, fold: Column, features: Sequence[str]) -> Column:
        """The log odds of label 0 with a fold's logarithms."""
        odds = constant
        for k in sorted(self.place[f] for f in features):
            brought = F.coalesce(F.try_element_at(f"_in{k}", fold), F.col(f"_odds{k}"))
            odds = odds + F.coalesce(brought, F.lit(0.0))
        return odds

    def _cells(self) -> DataFrame:
        """(split, j, _v0, ..., fold, n, p): how often the values of model j occur together in each fold; others are null."""
        columns = [f"_v{k}" for k in range(len(self.features))]
        masked = [F.struct(F.lit(j).alias("j"), *[F.col(c) if self.features[k] in own else F.lit(None).cast("string").alias(c) for k, c in enumerate(columns)]) for j, own in enumerate(self.models.values())]
        cells = self.placed.select("split", "fold", "label", F.explode(F.array(*masked)).alias("x")).select("split", "fold", "label", "x.*")
        keys = ["split", "j", *columns]
        # counted before they are shuffled: a model of few values has few cells, however many rows
        return cells.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("p"))

    def scored(self, training: bool) -> DataFrame:
        """(split, model, fold, held, row..., label, n, p, score): each row in its own fold (held), and with training counts
        of positives and rows of the training rows of each fold at each score.

        What has the same values is scored once at each fold, for all rows less those of the fold, which it carries as a
        map; values are attached to these and to the held-out rows together.
        """
        columns = [f"_v{k}" for k in range(len(self.features))]
        rest = [c for c in self.placed.columns if c not in ("split", "fold", "label") and not c.startswith("_v")]
        inside = F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "p")))).alias("_inside")
        every = self.placed.withColumns({"j": F.lit(None).cast("int"), "n": F.lit(1).cast("long"), "p": F.col("label").cast("long")})
        if training:
            cells = cut(self._cells(), "cells")
            whole = cells.groupBy("split", "j", *columns).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), inside)
            every = every.unionByName(whole, allowMissingColumns=True)
        folds = self.constants.groupBy("split").agg(F.collect_list(F.struct("fold", "parts")).alias("_folds"))
        met = self.attached(every).join(folds, "split").withColumn("_own", F.filter("_folds", lambda x: F.col("fold").isNull() | (x["fold"] == F.col("fold"))))
        met = met.drop("fold", "_folds").withColumn("_f", F.explode("_own"))
        if training:
            less = F.try_element_at("_inside", F.col("_f.fold"))
            met = met.withColumns({c: F.col(c) - F.coalesce(less[c], F.lit(0)) for c in ("n", "p")}).where("n > 0")
        odds = lambda j, own: self.odds(F.col("_f.parts")[j]["odds"], F.col("_f.fold"), own)
        found = [F.when(F.col("j").isNull() | (F.col("j") == j), F.struct(F.lit(name).alias("model"), _score(odds(j, own)).alias("score"))) for j, (name, own) in enumerate(self.models.items())]
        out = met.select("split", F.col("_f.fold").alias("fold"), F.col("j").isNull().alias("held"), *rest, "label", "n", "p", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
        return out.select("split", "x.model", "fold", "held", *rest, "label", "n", "p", "x.score")


def _held(scored: DataFrame) -> DataFrame:
    """(split, model, fold, row..., label, score) of each row in its own fold."""
    return scored.where("held").drop("held", "n", "p")


def scores(rows: DataFrame, folds: DataFrame, models: Mapping[str, Sequence[str]], label: str, row_id: str, alpha: float = 1.0) -> DataFrame:
    """(split, model, fold, row_id, label, score): each row scored by each model trained without the row's fold.

    folds: (split, row_id, fold); splits and folds are never null. A value not met in training counts 0 of k, with k the
    values met plus one; blanks and nulls are one value. A model without features scores by the classes' sizes. No rows
    in: no rows out.
    """
    return _held(_Fit(rows, folds, models, label, row_id, alpha).scored(training=False))


def cross_validated(rows: DataFrame, folds: DataFrame, models: Mapping[str, Sequence[str]], label: str, row_id: str, alpha: float = 1.0) -> DataFrame:
    """(split, model, fold, row_id, label, score, threshold, predicted): the held-out rows, labelled by the threshold
    that is best on the training rows."""
    scored = cut(_Fit(rows, folds, models, label, row_id, alpha).scored(training=True), "scores")
    counted = scored.where("not held").groupBy("split", "model", "fold", F.col("score").alias("threshold")).agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where("n > 0")
    best = best_of_counted(counted, ["split", "model", "fold"])
    held = _held(scored).join(best, ["split", "model", "fold"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    return cut(held.withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int")), "predictions")


#: Decimal places to which sums of logarithms are alike; rows that are tallied together at most.
ALIKE, TALLIED = 12, 1 << 16


class _Control:
    """What a model of `features` and of a class dealt anew among identities needs in all replicates.

    folds: (row_id, fold); deals: (ident, dealt), the class of an identity in each replicate. Dealing changes one feature
    only, so what the others bring to a row at each fold is worked out once, and classes are counted from identities.
    Sums that differ in the last bits only, as of equal ratios of counts, are one.
    """

    def __init__(self, rows: DataFrame, folds: DataFrame, features: Sequence[str], deals: DataFrame, ident: str, label: str, row_id: str, alpha: float) -> None:
        self.fit = _Fit(rows, folds.select(F.lit("").alias("split"), row_id, "fold"), {"base": features}, label, row_id, alpha, ident)
        self.columns, self.row_id = ["split", *[f"_v{k}" for k in range(len(self.fit.features))]], row_id
        deals = cut(deals.select(F.col(ident).alias("_ident"), F.transform("dealt", lambda c: F.coalesce(c.cast("string"), F.lit(""))).alias("_dealt")), "deals")
        each = deals.select("_ident", F.posexplode("_dealt").alias("rep", "_c"))
        named = cut(with_row_id(each.select("_c").distinct(), ["_c"], "_code").select("_c", (F.col("_code") - 1).cast("int").alias("_code")), "classes")
        self.classes, self.repeats = named.count(), deals.agg(F.max(F.size("_dealt"))).first()[0] or 0
        self.deals = cut(each.join(named, "_c").groupBy("_ident").agg(F.array_sort(F.collect_list(F.struct("rep", "_code"))).alias("_d")), "codes")
        self.folds = sorted(r["fold"] for r in self.fit.constants.select("fold").collect())
        self.based = cut(self._based(), "base")
        self.owners = cut(self.fit.placed.groupBy("_ident", "fold").agg(F.count_if(F.col("label") == 0).alias("l0"), F.count_if(F.col("label") == 1).alias("l1")), "identities")
        self.shifts = cut(self._shifts(alpha), "shifts")
        self.rows = cut(self._rows(), "rows")
        self.best = best_of_counted(cut(self._trained(), "scores"), ["rep", "fold"])

    def dealt(self, frame: DataFrame) -> DataFrame:
        return null_safe(frame, self.deals, ["_ident"]).select(*frame.columns, F.explode("_d").alias("_x")).select(*frame.columns, "_x.rep", "_x._code")

    def _based(self) -> DataFrame:
        """(values, _base): what the other features bring to each tuple of values, by fold."""
        fit = self.fit
        ends = fit.constants.groupBy("split").agg(F.collect_list(F.struct("fold", F.col("parts")[0]["odds"].alias("odds"))).alias("_ends"))
        tuples = fit.attached(fit.placed.select(*self.columns).distinct()).join(ends, "split")
        each = tuples.select(*self.columns, F.explode(F.transform("_ends", lambda x: F.struct(x["fold"], fit.odds(x["odds"], x["fold"], fit.features).alias("odds")))).alias("_x"))
        each = each.select(*self.columns, "_x.fold", "_x.odds").withColumn("_near", F.round("odds", ALIKE))
        shared = each.groupBy("fold", "_near").agg(F.min("odds").alias("_shared"))
        return each.join(shared, ["fold", "_near"]).groupBy(*self.columns).agg(F.map_from_entries(F.collect_list(F.struct("fold", "_shared"))).alias("_base"))

    def _shifts(self, alpha: float) -> DataFrame:
        """(rep, _code, fold, _shift): what a class brings in each replicate at each fold."""
        inside = self.dealt(self.owners).groupBy("rep", "_code", "fold").agg(F.sum("l0").alias("l0"), F.sum("l1").alias("l1"))
        classes = inside.groupBy("rep", "_code").agg(F.sum("l0").alias("c0"), F.sum("l1").alias("c1"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("l0", "l1")))).alias("_in"))
        sizes = self.fit.constants.groupBy("split").agg(F.sum("n").alias("_n"), F.sum("p").alias("_p"), F.collect_list(F.struct("fold", "n", "p")).alias("_folds"))
        each = classes.withColumn("split", F.lit("")).join(sizes, "split").select("rep", "_code", "c0", "c1", "_in", "_n", "_p", F.explode("_folds").alias("_f"))
        own = F.try_element_at("_in", F.col("_f.fold"))
        left = [F.col(f"c{y}") - F.coalesce(own[f"l{y}"], F.lit(0)) for y in (0, 1)]
        n1 = F.col("_p") - F.col("_f.p")
        each = cut(each.select("rep", "_code", F.col("_f.fold").alias("fold"), left[0].alias("d0"), left[1].alias("d1"), (F.col("_n") - F.col("_f.n") - n1).alias("n0"), n1.alias("n1")), "classes")
        kinds = each.groupBy("rep", "fold").agg((F.count_if(F.col("d0") + F.col("d1") > 0) + 1).alias("k"))
        log = lambda x: F.log(x + alpha)
        shift = log(F.col("d0")) - log(F.col("d1")) - F.log(F.col("n0") + alpha * F.col("k")) + F.log(F.col("n1") + alpha * F.col("k"))
        return each.join(kinds, ["rep", "fold"]).select("rep", "_code", "fold", shift.alias("_shift"))

    def _rows(self) -> DataFrame:
        """(row_id, fold, label, _bases, _base, _codes): each row once, with what its values bring at each fold, in the order
        of folds, and at its own, and the numbers of its classes of all replicates, packed."""
        packed = self.deals.select("_ident", F.unhex(F.array_join(F.transform("_d", lambda x: F.lpad(F.hex(x["_code"]), 2 * self.width, "0")), "")).alias("_codes"))
        own = null_safe(self.fit.placed.join(self.based, self.columns), packed, ["_ident"])
        bases = F.array(*[F.element_at("_base", F.lit(f)) for f in self.folds]).cast("array<double>")
        return own.select(self.row_id, "fold", "label", bases.alias("_bases"), F.element_at("_base", F.col("fold")).alias("_base"), "_codes")

    @property
    def width(self) -> int:
        """Bytes of a class's number."""
        return 1 if self.classes <= 1 << 8 else 2 if self.classes <= 1 << 16 else 4

    def _trained(self) -> DataFrame:
        """(rep, fold, threshold, n, p): the training rows of each fold, counted by score in each replicate."""
        folds, repeats, classes, unpacked = self.folds, self.repeats, self.classes, self._unpacked()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own in _gathered(batches):
                at, positive = np.searchsorted(folds, own["fold"].to_numpy()), own["label"].to_numpy(zero_copy_only=False) == 1
                bases = own["_bases"].flatten().to_numpy().reshape(-1, len(folds))
                kinds = np.arange(repeats) * classes + unpacked(own["_codes"])
                for k, fold in enumerate(folds):
                    held = at != k
                    values, place = np.unique(bases[held, k], return_inverse=True)
                    keys, n, p = _tallied(place.reshape(-1, 1) * (repeats * classes) + kinds[held], positive[held], len(values) * repeats * classes)
                    rep, code = np.divmod(keys % (repeats * classes), classes)
                    yield _batch(fold=np.full(len(keys), fold, np.int64), _base=values[keys // (repeats * classes)], rep=rep.astype(np.int32), _code=code.astype(np.int32), n=n, p=p)

        counted = self.rows.select("fold", "label", "_bases", "_codes").mapInArrow(run, "fold long, _base double, rep int, _code int, n long, p long")
        counted = counted.groupBy("fold", "_base", "rep", "_code").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
        met = counted.join(self.shifts, ["rep", "_code", "fold"]).select("rep", "fold", _score(F.col("_base") + F.col("_shift")).alias("threshold"), "n", "p")
        return met.groupBy("rep", "fold", "threshold").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))

    def _unpacked(self):
        width, repeats = self.width, self.repeats
        return lambda codes: np.frombuffer(b"".join(codes.to_pylist()), f">u{width}").reshape(len(codes), repeats).astype(np.int64)

    def parts(self) -> DataFrame:
        """(fold, _base, _range, _part, rep, _code, n, p, z, places): the held-out rows of a fold and base in the order of
        row ids as text, in parts of up to a batch; for each replicate and class of a part its rows, positives and
        negatives, and where the positives stand among its rows, from 1."""
        repeats, classes, unpacked = self.repeats, self.classes, self._unpacked()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = 0
            for own in batches:
                if not own.num_rows:
                    continue
                fold, base, label = (own.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "_base", "label"))
                new = np.r_[True, (fold[1:] != fold[:-1]) | (base[1:] != base[:-1])]
                first, segment = np.flatnonzero(new), np.cumsum(new) - 1
                key = (segment.reshape(-1, 1) * (repeats * classes) + np.arange(repeats) * classes + unpacked(own.column("_codes"))).reshape(-1)
                order = np.argsort(key, kind="stable")
                key, y = key[order], np.repeat(label, repeats)[order]
                start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                n, hit = np.diff(np.r_[start, len(key)]), y == 1
                p, z = np.add.reduceat(hit.astype(np.int64), start), np.add.reduceat((y == 0).astype(np.int64), start)
                place = np.arange(len(key)) - np.repeat(start, n) + 1
                key, (rep, code) = key[start] // (repeats * classes), np.divmod(key[start] % (repeats * classes), classes)
                places = pa.ListArray.from_arrays(np.r_[0, np.cumsum(p)].astype(np.int32), place[hit].astype(np.int32))
                yield _batch(fold=fold[first[key]].astype(np.int64), _base=base[first[key]], _range=np.full(len(key), own.column("_range")[0].as_py(), np.int32), _part=part + key, rep=rep.astype(np.int32), _code=code.astype(np.int32), n=n.astype(np.int64), p=p, z=z, places=places)
                part += len(first)

        order = ["fold", "_base", "_key"]
        ranged = self.rows.select("fold", "_base", F.col(self.row_id).cast("string").alias("_key"), "label", "_codes").repartitionByRange(*order).sortWithinPartitions(*order)
        ranged = ranged.select("fold", "_base", F.coalesce("label", F.lit(-1)).alias("label"), "_codes", F.spark_partition_id().alias("_range"))
        return ranged.mapInArrow(run, "fold long, _base double, _range int, _part long, rep int, _code int, n long, p long, z long, places array<int>")


def _batch(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()], names=list(columns))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about TALLIED."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
        if held and (batch is None or sum(b.num_rows for b in held) >= TALLIED):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []


def _tallied(keys: np.ndarray, positive: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, n, p): the different keys of a matrix, one row of it a row, with how often they are there and in positive rows."""
    every, hits = keys.reshape(-1), keys[positive].reshape(-1)
    if size <= 8 * every.size + TALLIED:
        n, p = np.bincount(every, minlength=size), np.bincount(hits, minlength=size)
        found = np.flatnonzero(n)
        return found, n[found], p[found]
    found, n = np.unique(every, return_counts=True)
    return found, n, np.bincount(np.searchsorted(found, hits), minlength=len(found))


def shuffle_control(rows: DataFrame, folds: DataFrame, features: Sequence[str], deals: DataFrame, ident: str, label: str, row_id: str, alpha: float = 1.0) -> DataFrame:
    """(rep, fold, row_id, label, score, threshold, predicted): the held-out rows of a model of `features` and of a class
    that is dealt anew among identities in each replicate, labelled by the threshold that is best on the training rows.

    folds: (row_id, fold); deals: (ident, dealt), the class of an identity in each replicate. A row for each row and
    replicate; shuffle_control_results gives metrics without making them. No rows in: no rows out.
    """
    own = _Control(rows, folds, features, deals, ident, label, row_id, alpha)
    brought = own.dealt(own.owners.select("_ident", "fold")).join(own.shifts, ["rep", "_code", "fold"]).groupBy("_ident", "fold").agg(F.array_sort(F.collect_list(F.struct("rep", "_shift"))).alias("_shifts"))
    held = spread(own.fit.placed.join(own.based, own.columns))
    held = null_safe(held.select("_ident", "fold", row_id, "label", F.element_at("_base", F.col("fold")).alias("_base")), brought, ["_ident", "fold"])
    held = held.select("fold", row_id, "label", "_base", F.explode("_shifts").alias("_s"))
    held = held.select(F.col("_s.rep").alias("rep"), "fold", row_id, "label", _score(F.col("_base") + F.col("_s._shift")).alias("score"))
    held = held.join(own.best, ["rep", "fold"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    return cut(held.withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int")), "predictions")


def shuffle_control_results(rows: DataFrame, folds: DataFrame, features: Sequence[str], deals: DataFrame, ident: str, label: str, row_id: str, alpha: float = 1.0) -> DataFrame:
    """(rep, metrics): pooled_results of shuffle_control by replicate, with ties in the order of folds and of row ids as text.

    Rows are not repeated. Those of a fold that the other features bring the same are put in order once; in a replicate
    their classes part them into runs of one score each, whose places follow from the sizes of the runs above. Where
    runs of several bases or classes have one rounded score, their rows alone are put in order for that replicate.
    """
    own = _Control(rows, folds, features, deals, ident, label, row_id, alpha)
    rules = cut(own.shifts.join(own.best, ["rep", "fold"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5))), "rules")
    parts = cut(own.parts(), "parts").join(rules, ["rep", "_code", "fold"]).withColumn("_s", _score(F.col("_base") + F.col("_shift")))
    parts = parts.withColumn("_above", F.col("_s") >= F.col("threshold")).withColumn("score", F.round("_s", 8))
    run, kind = ["rep", "score", "fold"], F.struct("_base", "_code")
    put = lambda c, above: F.sum(F.when(F.col("_above") if above else ~F.col("_above"), F.col(c)).otherwise(0))
    four = {"tp": put("p", True), "tn": put("z", False), "fp": put("z", True), "fn": put("p", False)}
    runs = parts.groupBy(*run).agg(F.sum("n").alias("_n"), F.sum("p").alias("_p"), (F.min(kind) != F.max(kind)).alias("_mixed"), *[c.alias(name) for name, c in four.items()])
    runs = cut(running(runs, ["rep"], [F.desc("score"), "fold"], {"_hits": "_p", "_place": "_n"}), "runs")
    starts = runs.where("_p > 0").select(*run, (F.col("_hits") - F.col("_p")).alias("_h0"), (F.col("_place") - F.col("_n")).alias("_p0"), "_mixed")
    # runs of one base and class: parts follow each other
    before = Window.partitionBy(*run).orderBy("_base", "_code", "_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    follow = parts.select(*run, "_base", "_code", "_range", "_part", "n", "p", "places").withColumns({"_h": upto("p"), "_q": upto("n")}).join(starts.where("not _mixed"), run)
    share = F.transform("places", lambda x, k: (F.col("_h0") + F.col("_h") + k + 1) / (F.col("_p0") + F.col("_q") + x))
    single = follow.groupBy("rep").agg(F.sum(F.aggregate(share, F.lit(0.0), lambda a, x: a + x)).alias("_precision"))
    # other runs: by rows
    mixed = parts.join(starts.where("_mixed"), run).select("fold", "_base", F.struct("rep", "_code", "score", "_h0", "_p0").alias("_x")).distinct()
    mixed = mixed.groupBy("fold", "_base").agg(F.collect_list("_x").alias("_mixed"))
    code = F.conv(F.hex(F.substring("_codes", F.col("_x.rep") * own.width + 1, F.lit(own.width))), 16, 10).cast("int")
    met = own.rows.join(mixed, ["fold", "_base"]).select("fold", "label", F.col(row_id).cast("string").alias("_key"), "_codes", F.explode("_mixed").alias("_x")).where(code == F.col("_x._code"))
    met = running(met.select("fold", "label", "_key", "_x.rep", "_x.score", "_x._h0", "_x._p0"), run, ["_key"], {"_hits": F.when(F.col("label") == 1, 1).otherwise(0), "_place": F.lit(1)})
    by_rows = met.where("label = 1").groupBy("rep").agg(F.sum((F.col("_h0") + F.col("_hits")) / (F.col("_p0") + F.col("_place"))).alias("_precision"))
    at = runs.groupBy("rep", "score").agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"), (F.max("_place") - F.max("_hits")).alias("_negatives"), F.lit(None).cast("double").alias("_precision"), *[F.sum(name).alias(name) for name in four])
    none = [F.lit(0).cast("long").alias(c) for c in ("_n", "_p", "_negatives", *four)]
    precision = single.unionByName(by_rows).select("rep", F.lit(None).cast("double").alias("score"), "_precision", *none)
    return of_counted(at.unionByName(precision), ["rep"], "score")


def fold_results(predictions: DataFrame, row_id: str) -> DataFrame:
    return evaluated(predictions, ["split", "model", "fold"], "label", "score", "predicted", [row_id])


def pooled_results(predictions: DataFrame, row_id: str, by: Sequence[str] = ("split", "model")) -> DataFrame:
    """Metrics over all folds together: labels as decided in each fold, scores rounded to 8 places before ranking, ties
    in the order of folds."""
    own = predictions.withColumn("score", F.round("score", 8))
    return evaluated(own, list(by), "label", "score", "predicted", ["fold", row_id])
