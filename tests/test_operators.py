import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrastkit.operators import association, audit, bayes, decide, folds, matched, measurements, metrics, ordered, resample
from contrastkit.plans import analyses

CTX, UNIT = ["ctx"], ["ctx", "cls", "ident"]


@pytest.fixture(scope="module")
def units(spark):
    draw = random.Random(3)
    rows = []
    for c in range(7):
        for cls in "ABC"[: 2 + c % 2]:
            for i in range(1 + (c + ord(cls)) % 2):
                n = draw.randint(1, 3)
                p = draw.randint(0, n)
                rows.append((f"c{c}", cls, f"{cls}{(i + c) % 3}", n, p, p / n))
    rows.append(("alone", "A", "A9", 1, 1, 1.0))
    return spark.createDataFrame(rows, "ctx string, cls string, ident string, n_observations long, positives long, response_rate double").cache()


def diffs_of(rows, a, b):
    out = []
    for c in {r["ctx"] for r in rows}:
        x = [r["response_rate"] for r in rows if r["ctx"] == c and r["cls"] == a]
        y = [r["response_rate"] for r in rows if r["ctx"] == c and r["cls"] == b]
        if x and y:
            out.append(sum(x) / len(x) - sum(y) / len(y))
    return out


def test_routing_and_collapse(spark):
    rows = [(1, "k", "<", 5.0, "nM", "IC50"), (2, "k", "", 20.0, "nM", "IC50"), (3, "k", ">", 5.0, "nM", "IC50"), (4, "k", "=", 5.0, "mg", "IC50"), (5, "k", "=", 5.0, "nM", "Cmax"), (6, "l", "=", 5.0, "nM", "IC50"), (7, "l", "=", 5.0, "nM", "IC50")]
    frame = measurements.routed(spark.createDataFrame(rows, "row_id int, key string, relation string, v double, units string, kind string"), F.col("kind") == "IC50", value="v")
    assert {r["row_id"]: (r["label"], r["reason"]) for r in frame.collect()} == {
        1: (1, None), 2: (0, None), 3: (None, "ambiguous_censored_value"), 4: (None, "non_molar_or_missing_value"), 5: (None, "non_potency_endpoint"), 6: (1, None), 7: (1, None),
    }
    assert {r["reason"]: r["rows"] for r in measurements.exclusion_counts(frame).collect()} == {x: 1 for x in measurements.REASONS}
    own = measurements.usable(frame)
    one = {r["key"]: r for r in measurements.collapsed(own, ["key"], "value_nm", "label", "row_id", ["units"], "row_id").collect()}
    assert (one["k"]["value_nm"], one["k"]["label"], one["k"]["has_conflicting_labels"], one["k"]["source_ids"]) == (5.0, 1, 1, "1;2")
    assert one["l"]["source_rows"] == 2 and one["l"]["has_conflicting_labels"] == 0
    found = measurements.conflicts(own, ["key"], "value_nm", "label", "row_id").collect()
    assert [(r["key"], r["labels"], r["values"]) for r in found] == [("k", "0,1", "5.0;20.0")]


def test_blank_rules(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", ""), (3, "a", None), (4, "b", "x"), (5, "b", "y")], "row_id int, cls string, ident string")
    assert audit.unique_counts(rows, ["ident"]).first()[0] == 2
    assert audit.dependency(rows, "ident", "cls").first() == (2, 1, 1, 0.5)
    assert audit.top_values(rows, "cls", "ident", 1, "row_id").where("cls = 'b'").first()["ident"] == "x"
    summary = {r["cls"]: r for r in audit.modelling_summary(rows.withColumn("label", F.lit(1)), "cls", "ident", "label", [], "row_id").collect()}
    assert summary["a"]["unique_identities"] == 2  # blank and null are one value here
    empty = rows.limit(0)
    assert audit.dependency(empty, "ident", "cls").first()["single_share"] is None
    assert audit.prevalence(empty.withColumn("label", F.lit(1)), "label").first() == (0, None)
    with pytest.raises(ValueError):
        audit.generic_audit(rows, "cls", "nothing")
    assert set(audit.generic_audit(rows, "cls", "ident", ["row_id", "absent"])) == {"classes", "identities", "dependency", "shared_row_id"}


def test_association(spark):
    rows = spark.createDataFrame([("a", "x", "1"), ("a", "x", ""), ("b", "y", "1"), ("b", "y", "2")], "cls string, full string, part string")
    got = {r["association"]: r for r in association.associations(rows, {"f": ("cls", "full"), "p": ("cls", "part"), "n": ("cls", "cls")}).collect()}
    assert got["f"]["cramers_v"] == pytest.approx(1.0) and 0 <= got["p"]["cramers_v"] <= 1 and got["p"]["right_unique_values"] == 2
    single = association.associations(rows.where("cls = 'a'"), {"f": ("cls", "full")}).first()
    assert single["cramers_v"] is None
    assert {(r[0], r[1]): r[2] for r in association.shared_contexts(rows, ["full"], "cls").collect()} == {("a", "b"): 0}
    assert association.contingency(rows, "cls", "full").orderBy("cls").collect()[0]["y"] == 0


def test_residuals_sum_to_zero(units):
    own = matched.residuals(matched.matched(units, CTX), CTX)
    assert own.where("ctx = 'alone'").count() == 0
    for r in own.groupBy("ctx").agg(F.sum("residual")).collect():
        assert abs(r[1]) < 1e-12


def test_pairs(units):
    rows = units.collect()
    got = {(r["class_a"], r["class_b"]): r for r in matched.pair_summary(matched.pair_effects(units, CTX)).collect()}
    for a, b in (("A", "B"), ("A", "C"), ("B", "C")):
        d = diffs_of(rows, a, b)
        assert got[a, b]["contexts"] == len(d) and got[a, b]["mean_diff"] == pytest.approx(sum(d) / len(d))
        assert got[a, b]["a_higher"] + got[a, b]["b_higher"] + got[a, b]["equal"] == len(d)
    turned = matched.pair_effects(units, CTX, order=["C", "B", "A"])
    assert {(r[0], r[1]) for r in turned.select("class_a", "class_b").distinct().collect()} == {("C", "B"), ("C", "A"), ("B", "A")}


def test_identities_may_hold_separators(spark):
    rows = [("c1", "A", "x;y", 1.0), ("c1", "A", "x", 0.0), ("c1", "B", "p|q", 0.0), ("c2", "A", "x", 0.5), ("c2", "A", "y", 0.5), ("c2", "B", "p|q", 0.0), ("c3", "A", "x;y", 0.5), ("c3", "A", "x", 0.0), ("c3", "B", "p|q", 0.0)]
    frame = spark.createDataFrame([(*r, 1, int(r[3] > 0.7)) for r in rows], "ctx string, cls string, ident string, response_rate double, n_observations int, positives int")
    effects = matched.pair_effects(frame, CTX)
    got = matched.pair_summary(effects).first()
    assert got["idents_a"] == ["x", "x;y", "y"] and got["idents_b"] == ["p|q"] and (got["unique_idents_a"], got["unique_idents_b"]) == (3, 1)
    assert (got["top_idents_a"], got["top_signature_contexts"]) == (["x", "x;y"], 2)
    shown = {r["contexts"]: (r["signature"], r["example_contexts"]) for r in matched.displayed(matched.pairings(effects, CTX)).collect()}
    assert shown == {2: ("x|p|q;x;y|p|q", "c1; c3"), 1: ("x|p|q;y|p|q", "c2")}


def test_arms_of_many_identities(spark):
    """What 10,000 identities on either side would pair to is never written out."""
    frame = spark.range(20000).selectExpr("'c' as ctx", "if(id % 2 = 0, 'A', 'B') as cls", "concat('i', id) as ident", "cast(id % 3 = 0 as double) as response_rate", "1 as n_observations", "cast(id % 3 = 0 as int) as positives")
    got = matched.pair_summary(matched.pair_effects(frame, CTX)).first()
    assert (got["unique_idents_a"], got["unique_idents_b"], len(got["top_idents_a"])) == (10000, 10000, 10000)
    assert matched.pairings(matched.pair_effects(frame, CTX), CTX).count() == 1


def test_a_context_with_half_of_all_units_is_spread(spark):
    """The join that brings means back is split where one context is large: no task reads all its units."""
    names = ["spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    frame = spark.range(200000, numPartitions=16).selectExpr("if(id % 2 = 0, 0, id % 5000) as ctx", "if(id % 3 = 0, 'A', 'B') as cls", "concat('ident', id) as ident", "rand(3) as response_rate")
    try:
        for name, value in zip(names, ("64k", "64k", "2", "-1", "-1")):
            spark.conf.set(name, value)
        out = matched.residuals(frame, CTX)
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id().alias("task")).agg(F.count_if(F.col("ctx") == 0)).select(F.col("count_if((ctx = 0))")).collect()]
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in names:
            spark.conf.unset(name)
    assert sum(sizes) == 100000 and max(sizes) < 50000
    assert "Window" not in plan
    assert abs(out.where("ctx = 0").agg(F.sum("residual")).first()[0]) < 1e-6


def test_null_contexts_are_a_context(spark):
    rows = [(None, "A", "i", 1.0), (None, "B", "j", 0.0), ("c", "A", "i", 1.0)]
    frame = spark.createDataFrame(rows, "ctx string, cls string, ident string, response_rate double")
    assert sorted(r["residual"] for r in matched.residuals(matched.matched(frame, CTX), CTX).collect()) == [-0.5, 0.5]
    assert matched.residual_range(frame, CTX).first()[0] == 1.0


@pytest.mark.parametrize(("most", "parts"), [(1 << 14, 256), (12, 64)])
def test_order_statistics_close_in(spark, monkeypatch, most, parts):
    monkeypatch.setattr(ordered, "SORTED", most)
    monkeypatch.setattr(ordered, "BINS", parts)
    draw = random.Random(2)
    groups = {"a": [draw.choice([draw.gauss(0, 1), draw.lognormvariate(0, 10), -1e308, 1e308, 0.0]) for _ in range(300)], "b": [7.0] * 50, None: [float(k) for k in range(90)], "d": [5.0, None], "e": [None], "f": [float("inf"), float("-inf"), 1.0, 2.0, 3.0, 4.0, 5.0]}
    frame = spark.createDataFrame([(g, v) for g, own in groups.items() for v in own], "g string, v double")
    got = {r["g"]: r for r in ordered.order_statistics(frame, ["g"], "v", {"m": ("linear", 0.5), "f": ("floor", 0.95), "p": ("floor", 0.1)}).collect()}
    assert set(got) == {"a", "b", None, "d", "f"}
    for g, r in got.items():
        own = sorted(v for v in groups[g] if v is not None)
        assert r["f"] == own[int(0.95 * (len(own) - 1))] and r["p"] == own[int(0.1 * (len(own) - 1))]
        assert r["m"] == pytest.approx((own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2)
    assert ordered.order_statistics(frame, [], "v", {"f": ("floor", 0.0)}).first()[0] == float("-inf")


def test_permutation_keeps_arms_and_nears_the_exact_p(units):
    pair = units.where("cls in ('A', 'B')")
    dealt = resample.permuted(matched.matched(pair, CTX), CTX, UNIT, 20, 5)
    sizes = {tuple(r) for r in dealt.groupBy("rep", "ctx", "cls").count().select("ctx", "cls", "count").distinct().collect()}
    assert sizes == {tuple(r) for r in matched.matched(pair, CTX).groupBy("ctx", "cls").count().collect()}
    observed = sum(d := diffs_of(pair.collect(), "A", "B")) / len(d)
    arms = {}
    for r in pair.collect():
        arms.setdefault(r["ctx"], []).append((r["cls"], r["response_rate"]))
    choices = []
    for own in arms.values():
        n = sum(c == "A" for c, _ in own)
        if 0 < n < len(own):
            rates = [x for _, x in own]
            choices.append([sum(rates[i] for i in s) / n - (sum(rates) - sum(rates[i] for i in s)) / (len(own) - n) for s in itertools.combinations(range(len(own)), n)])
    stats = [sum(c) / len(c) for c in itertools.product(*choices)]
    exact = sum(abs(x) >= abs(observed) - 1e-12 for x in stats) / len(stats)
    got = resample.pair_permutation(pair, CTX, UNIT, 2000, 7).first()
    assert got["observed"] == pytest.approx(observed) and abs(got["p"] - exact) < 0.06


def test_own_numbers_of_replicates(units):
    """10,000 permutations and 5,000 bootstraps, near what 1,000 give, and a range that the exact p lies in."""
    whole = resample.range_permutation(units, CTX, UNIT).first()
    few = resample.range_permutation(units, CTX, UNIT, 1000).first()
    assert whole["permutations"] == 10000 and abs(whole["p"] - few["p"]) < 0.06 and whole["observed"] == few["observed"]
    assert {r["permutations"] for r in resample.pair_permutation(units, CTX, UNIT).collect()} == {10000}
    for boot in (resample.context_bootstrap(units, CTX, UNIT), resample.cluster_bootstrap(units, CTX)):
        assert all(r["requested"] == 5000 == r["available"] + r["unavailable"] for r in boot.collect())


def test_large_contexts_are_dealt_alike(units, monkeypatch):
    """Contexts over WHOLE units go another way to the same results."""
    tests = [lambda: resample.range_permutation(units, CTX, UNIT, 40), lambda: resample.pair_permutation(units, CTX, UNIT, 40), lambda: resample.context_bootstrap(units, CTX, UNIT, 40)]
    rounded = lambda frame: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.collect())
    before = [rounded(t()) for t in tests]
    monkeypatch.setattr(resample, "WHOLE", 3)
    assert [rounded(t()) for t in tests] == before


def test_bootstraps(units):
    for r in resample.context_bootstrap(units, CTX, UNIT, 200).collect():
        assert r["available"] == 200 and r["p025"] <= r["bootstrap_mean"] <= r["p975"]
    for r in resample.cluster_bootstrap(units, CTX, 200).collect():
        assert r["available"] + r["unavailable"] == 200
    one = units.where("(cls = 'A' and ident = 'A0') or cls = 'B'")
    assert resample.cluster_bootstrap(one, CTX, 20).first()["degenerate"] == 1


def test_leave_one_out(units):
    rows = units.collect()
    for r in resample.leave_one_out_pairs(units, CTX).collect():
        left = [x for x in rows if x["ident"] != r["held_out"]]
        d = diffs_of(left, r["class_a"], r["class_b"])
        assert r["remaining_contexts"] == len(d) and (r["stat"] == pytest.approx(sum(d) / len(d)) if d else r["unavailable"] == 1)
    summary = resample.leave_one_out_summary(resample.leave_one_out_pairs(units, CTX))
    assert summary.count() == 3
    assert resample.leave_one_out_range(units, CTX).count() == units.select("ident").distinct().count()


def test_sign_change_to_zero_counts(spark):
    rows = [("1", "A", "a1", 1, 1, 1.0), ("1", "A", "a2", 1, 0, 0.0), ("1", "B", "b1", 1, 0, 0.0)]
    own = spark.createDataFrame(rows, "ctx string, cls string, ident string, n_observations long, positives long, response_rate double")
    got = {r["held_out"]: (r["sign_changed"], r["unavailable"]) for r in resample.leave_one_out_pairs(own, CTX).collect()}
    assert got == {"a1": (1, 0), "a2": (0, 0), "b1": (0, 1)}


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(8)
    rows = [(k, f"g{draw.randrange(30)}", draw.choice("xyz"), draw.choice(["u", "v", ""]), int(draw.random() < 0.4)) for k in range(300)]
    return spark.createDataFrame(rows, "row_id int, ident string, f string, g string, label int").cache()


def test_folds(labelled):
    own = folds.stratified_folds(labelled, "label", "row_id", 5).groupBy("label", "fold").count()
    for label in (0, 1):
        sizes = [r["count"] for r in own.where(F.col("label") == label).collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    grouped = folds.group_folds(labelled, "ident", "label", 4)
    assert grouped.count() == 300 and grouped.select("ident", "fold").distinct().count() == 30
    sizes = [r["count"] for r in grouped.groupBy("fold").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 20
    assert folds.leave_one_group_folds(labelled, "ident").select("fold").distinct().count() == 30


def greedy(groups, k, share):
    """(n, p, hash, name) in order of placing -> fold of each, one group after the other."""
    n, p, out = [0] * k, [0] * k, {}
    for size, positive, _, name in sorted(groups, key=lambda g: (-g[0], -g[1], g[2], g[3])):
        best = min(range(k), key=lambda i: (n[i] + size, abs((p[i] + positive) / (n[i] + size) - share), i))
        n[best] += size
        p[best] += positive
        out[name] = best
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_group_folds_are_those_of_one_pass(spark, monkeypatch, k):
    monkeypatch.setattr(folds, "_BLOCK", 7)
    draw = random.Random(k)
    rows = [(f"g{g}", int(draw.random() < 0.3)) for g in range(400) for _ in range(draw.choice([1, 1, 1, 2, 2, 3, 17]))]
    frame = spark.createDataFrame(rows, "g string, y int")
    sizes = {}
    for g, y in rows:
        sizes.setdefault(g, [0, 0])
        sizes[g][0] += 1
        sizes[g][1] += y
    groups = [(n, p, hashlib.md5(f"44:{g}".encode()).hexdigest(), g) for g, (n, p) in sizes.items()]
    got = {r["g"]: r["fold"] for r in folds.group_folds(frame, "g", "y", k).select("g", "fold").distinct().collect()}
    assert got == greedy(groups, k, sum(y for _, y in rows) / len(rows))
    assert folds.group_folds(frame.limit(0), "g", "y", k).count() == 0


def test_running_sums_and_places(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), k, draw.choice([1.0, 2.5, 7.0, None])) for k in range(500)]
    frame = spark.createDataFrame(rows, "g string, k int, v double").repartition(7)
    got = {r["k"]: r["upto"] for r in ordered.running(frame, ["g"], [F.desc("k")], {"upto": F.lit(1)}).collect()}
    assert got == {k: sum(h == g and j >= k for h, j, _ in rows) for g, k, _ in rows}
    for r in ordered.order_statistics(frame, ["g"], "v", {"m": ("linear", 0.5), "f": ("floor", 0.95), "p": ("linear", 0.1)}).collect():
        own = sorted(v for g, _, v in rows if g == r["g"] and v is not None)
        assert r["m"] == pytest.approx(np.percentile(own, 50)) and r["p"] == pytest.approx(np.percentile(own, 10)) and r["f"] == own[int(0.95 * (len(own) - 1))]
    assert ordered.order_statistics(frame.limit(0), ["g"], "v", {"m": ("linear", 0.5)}).count() == 0
    assert sorted(r["row_id"] for r in ordered.with_row_id(frame, ["k"]).collect()) == list(range(1, 501))


def bayes_scores(train, test, features):
    out = []
    n = {y: sum(r["label"] == y for r in train) for y in (0, 1)}
    for row in test:
        logs = []
        for y in (0, 1):
            log = math.log((n[y] + 1) / (len(train) + 2))
            for f in features:
                k = len({r[f] for r in train}) + 1
                log += math.log((sum(r[f] == row[f] and r["label"] == y for r in train) + 1) / (n[y] + k))
            logs.append(log)
        out.append(1 / (1 + math.exp(logs[0] - logs[1])))
    return out


def test_classifier(labelled):
    models = {"none": [], "f": ["f"], "all": ["f", "g", "ident"]}
    own = folds.group_folds(labelled, "ident", "label", 4).select(F.lit("s").alias("split"), "row_id", "fold")
    place = {r["row_id"]: r["fold"] for r in own.collect()}
    rows = labelled.collect()
    got = bayes.cross_validated(labelled, own, models, "label", "row_id").collect()
    assert len(got) == 900
    found = {(r["model"], r["row_id"]): r for r in got}
    for fold in range(4):
        train, test = [r for r in rows if place[r["row_id"]] != fold], [r for r in rows if place[r["row_id"]] == fold]
        for name, features in models.items():
            for row, score in zip(test, bayes_scores(train, test, features)):
                assert found[name, row["row_id"]]["score"] == pytest.approx(score, rel=1e-9)
            scores = bayes_scores(train, train, features)
            best = (-1e9, -1e9, 0.5)
            for t in sorted(set(round(s, 12) for s in scores)):
                tp, fp = (sum(s >= t - 1e-9 and r["label"] == y for s, r in zip(scores, train)) for y in (1, 0))
                fn, tn = sum(r["label"] for r in train) - tp, sum(1 - r["label"] for r in train) - fp
                m = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
                key = ((tp * tn - fp * fn) / math.sqrt(m) if m else -999, (tp / (tp + fn) + tn / (tn + fp)) / 2)
                if key > (best[0] + 1e-12, best[1]):
                    best = (*key, t)
            assert found[name, test[0]["row_id"]]["threshold"] == pytest.approx(best[2], rel=1e-9)
    pooled = {r["model"]: r for r in bayes.pooled_results(bayes.cross_validated(labelled, own, models, "label", "row_id"), "row_id").collect()}
    assert pooled["all"]["n"] == 300 and pooled["all"]["tp"] + pooled["all"]["fn"] == sum(r["label"] for r in rows)
    assert bayes.fold_results(bayes.cross_validated(labelled, own, models, "label", "row_id"), "row_id").count() == 12


def test_metrics(spark):
    rows = [("a", k, y, s) for k, (y, s) in enumerate([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.2), (1, 0.2)])] + [("one", 9, 1, 0.4)]
    frame = spark.createDataFrame(rows, "g string, row_id int, label int, score double")
    auc = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(frame, ["g"], "label", "score").collect()}
    assert auc["a"] == pytest.approx(3.5 / 6 - 0.5 / 6) and auc["one"] is None
    other = metrics.roc_auc(frame.withColumn("score", 1 - F.col("score")), ["g"], "label", "score").where("g = 'a'").first()["roc_auc"]
    assert other == pytest.approx(1 - auc["a"])
    ap = metrics.average_precision(frame, ["g"], "label", "score", ["row_id"]).where("g = 'a'").first()[1]
    assert ap == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    grouped = metrics.average_precision(frame, ["g"], "label", "score", ["row_id"], ties="grouped").where("g = 'a'").first()[1]
    assert grouped == pytest.approx((1 / 2 + 2 / 3 + 3 / 5) / 3)
    full = {r["g"]: r for r in metrics.evaluated(frame.withColumn("p", (F.col("score") >= 0.5).cast("int")), ["g"], "label", "score", "p", ["row_id"]).collect()}
    assert full["one"]["mcc"] is None and full["one"]["balanced_accuracy"] is None and full["a"]["tp"] == 2
    assert metrics.best_thresholds(frame.where("g = 'one'"), ["g"], "label", "score").first()["threshold"] == 0.4
    wrong = metrics.wrong_predictions(frame.withColumn("p", (F.col("score") >= 0.5).cast("int")).withColumn("t", F.lit(0.5)), "label", "p", "score", "t", ["row_id"]).collect()
    assert [(r["row_id"], r["error_type"]) for r in wrong] == [(1, "FP"), (4, "FN"), (9, "FN")]


def test_decisions(spark):
    degrees = spark.createDataFrame([(k, 2, 6) for k in range(10)], "key int, degree int, n_rows int")
    several = spark.createDataFrame([("a", 2), ("b", 3)], "cls string, identities int")
    assert decide.audit_verdict(degrees, several).first()["decision"] == "TESTABLE"
    assert decide.audit_verdict(degrees.limit(3), several).first()["decision"] == "NOT_TESTABLE"
    assert decide.audit_verdict(degrees, several, words=decide.PUBLISHED).first()["decision"] == "検証可能"
    classes = spark.createDataFrame([(60, 6), (80, 9)], "observations int, unique_identities int")
    crossed = spark.createDataFrame([(6, 1)] * 20, "observations int, has_label_variation int")
    v = spark.createDataFrame([(0.99,)], "cramers_v double")
    gate = decide.model_gate(classes, crossed, v).first()
    assert gate["decision"] == "GO_FOR_CHEAP_FALSIFICATION" and len(gate["reasons"]) == 5
    assert decide.model_gate(classes, crossed.limit(1), v).first()["decision"] == "PIVOT"
    assert decide.model_gate(classes.limit(0), crossed.limit(0), v).first()["decision"] == "KILL"
    pooled = spark.createDataFrame([("payload_group", m, ap, 0.1 * k) for k, (m, ap) in enumerate([("bio", 0.5), ("bio_plus_mechanism", 0.6), ("bio_plus_payload", 0.6), ("bio_plus_payload_plus_mechanism", 0.7)])], "split string, model string, average_precision double, mcc double")
    shuffled = spark.createDataFrame([(0.55,)] * 5, "average_precision double")
    assert decide.model_verdict(pooled, shuffled).first()["decision"] == "GO"
    assert decide.model_verdict(pooled, spark.createDataFrame([(0.61,)], "average_precision double")).first()["decision"] == "PIVOT"
    assert decide.model_verdict(pooled.limit(3), shuffled).first()["decision"] == "PIVOT"
    assert decide.model_verdict(pooled, shuffled.limit(0)).first()["decision"] == "GO"
    pairs = spark.createDataFrame([("A", "B", 6, 4, 0.3, 5, 1)], "class_a string, class_b string, contexts int, both_replicated int, mean_diff double, a_higher int, b_higher int")
    boot = spark.createDataFrame([("A", "B", 0.1, 0.5)], "class_a string, class_b string, p025 double, p975 double")
    left = spark.createDataFrame([("A", "B", 0, 0)], "class_a string, class_b string, unavailable_holdouts int, sign_change_holdouts int")
    p = spark.createDataFrame([("A", "B", 0.01)], "class_a string, class_b string, p double")
    assert decide.contrast_verdict(pairs, boot, left, p).first()["decision"] == "PIVOT-GO"
    assert decide.contrast_verdict(pairs, boot, left.limit(0), p).first()["decision"] == "PIVOT-WEAK"
    assert decide.contrast_verdict(pairs.withColumn("mean_diff", F.lit(0.01)), boot, left, p.withColumn("p", F.lit(0.2))).first()["decision"] == "KILL"
    assert decide.contrast_verdict(pairs.limit(0), boot, left, p).first()["decision"] == "KILL"


def test_shuffle_control_scores_rows_as_the_classifier_does(spark):
    """Against every repeat as a split of its own, with null identities, classes and values."""
    rows = [(k, [None, "i0", "i1", "i2", "i3", "i4"][k * 7 % 6], ["A", "B", None][k * 7 % 6 % 3], f"c{k % 4}" if k % 9 else None, int(k * 5 % 3 == 0)) for k in range(60)]
    schema = "row_id int, ident string, cls string, ctx string, label int"
    frame = spark.createDataFrame(rows, schema)
    placed = frame.selectExpr("row_id", "row_id % 3 as fold")
    for features in (["ctx"], []):
        got = bayes.shuffle_control(frame, placed, features, resample.dealt_classes(frame, "cls", "ident", 5, 4), "ident", "label", "row_id")
        many = resample.shuffled_classes(frame, "cls", "ident", 5, 4).withColumn("key", F.concat_ws(":", "rep", "row_id"))
        own = many.select(F.col("rep").cast("string").alias("split"), "key", (F.col("row_id") % 3).alias("fold"))
        wanted = bayes.cross_validated(many, own, {"m": [*features, "shuffled"]}, "label", "key")
        a = sorted((f"{r['rep']}:{r['row_id']}", r["fold"], round(r["score"], 9), round(r["threshold"], 9), r["predicted"]) for r in got.collect())
        b = sorted((r["key"], r["fold"], round(r["score"], 9), round(r["threshold"], 9), r["predicted"]) for r in wanted.collect())
        assert len(a) == 240 and a == b
    none = spark.createDataFrame([], schema)
    empty = bayes.shuffle_control(none, placed.limit(0), ["ctx"], resample.dealt_classes(none, "cls", "ident", 5, 4), "ident", "label", "row_id")
    assert empty.count() == 0


def test_bootstraps_by_blocks(units, monkeypatch):
    """Draws worked out by block and part of the replicates, or row by row, are the same; so are those of large contexts."""
    rounded = lambda frame: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.collect())
    tests = [lambda: resample.context_bootstrap(units, CTX, UNIT, 40), lambda: resample.cluster_bootstrap(units, CTX, 40)]
    before = [rounded(t()) for t in tests]
    for name, value in (("_BLOCK", 5), ("_CHUNK", 3), ("WHOLE", 0)):
        monkeypatch.setattr(resample, name, value)
        assert [rounded(t()) for t in tests] == before, name


def test_draws_in_numpy():
    rng = np.random.default_rng(7)
    p = resample.PRIME
    key = np.concatenate([[0, (1 << 28) - 1], rng.integers(0, 1 << 28, 500)]).astype(np.uint64)
    for v, w in ((1, 0), (p - 1, p - 1), (0, p - 1), *rng.integers(0, p, (20, 2)).tolist()):
        x = [(k * v + w) % p for k in key.tolist()]
        x = [(a * a + k) % p for a, k in zip(x, key.tolist())]
        assert resample._drawn(key, np.uint64(v), np.uint64(w)).tolist() == [(a * v + w) % p for a in x]


def test_training_cells_are_scored_once_at_each_fold(spark):
    """No row takes another's count off, and each fold has the training rows of the other folds."""
    rows = spark.createDataFrame([(k, k % 2, f"a{k % 3}", f"b{k % 7}") for k in range(60)], "row_id long, label int, x string, y string")
    own = rows.select(F.lit("s").alias("split"), "row_id", (F.col("row_id") % 4).cast("int").alias("fold"))
    fit = bayes._Fit(rows, own, {"none": [], "x": ["x"], "both": ["x", "y"]}, "label", "row_id", 1.0)
    trained = fit.scored(training=True).where("not held")
    assert trained.where("n <= 0 or p < 0 or p > n").count() == 0
    counts = trained.groupBy("model", "fold").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect()
    assert {(r["model"], r["fold"]): (r["n"], r["p"]) for r in counts} == {(m, f): (45, 15 if f % 2 else 30) for m in ("none", "x", "both") for f in range(4)}


@pytest.mark.parametrize("features, batch", [(["ctx"], 7), (["ctx", "row_id"], 10000)])
def test_shuffle_control_results_are_those_of_its_rows(spark, features, batch):
    """In runs of one base and class and in mixed ones, and in parts."""
    rows = [(k, [None, *(f"i{j}" for j in range(20))][k * 13 % 21], ["A", "B", "C", None][k * 13 % 21 % 4], f"c{k * k % 11 % 3}", int(k * 5 % 7 < 2)) for k in range(900)]
    frame = spark.createDataFrame(rows, "row_id int, ident string, cls string, ctx string, label int")
    placed = folds.group_folds(frame, "ident", "label", 3).select("row_id", "fold")
    deals = resample.dealt_classes(frame, "cls", "ident", 5, 12)
    wanted = bayes.shuffle_control(frame, placed, features, deals, "ident", "label", "row_id")
    wanted = bayes.pooled_results(wanted.withColumn("key", F.col("row_id").cast("string")), "key", ["rep"])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = bayes.shuffle_control_results(frame, placed, features, deals, "ident", "label", "row_id")
        assert got.columns == wanted.columns
        a, b = (sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in x.collect()) for x in (got, wanted))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(a) == 12 and a == b


def test_shuffle_control_orders_no_row_for_each_repeat(spark, monkeypatch):
    rows = [(k, f"i{k * 13 % 21}", "ABC"[k * 13 % 21 % 3], f"u{k % 2}", f"c{k % 4}", int(k * 5 % 7 < 2)) for k in range(600)]
    frame = spark.createDataFrame(rows, "row_id int, ident string, cls string, units string, ctx string, label int")
    most = []
    for module in (bayes, metrics):
        monkeypatch.setattr(module, "running", lambda frame, *rest: most.append(frame.count()) or ordered.running(frame, *rest), raising=False)
    roles = analyses.Roles(row_id="row_id", cls="cls", ident="ident", context=("units", "ctx"))
    assert analyses.shuffle_control(frame, roles, "label", 3, 44, 10).count() == 10
    assert most and max(most) < 600 * 10 / 2


def test_draws_of_slots():
    """Slots' draws follow from one another, also where keys begin anew, which those of large arms do more than once."""
    p, top = resample.PRIME, 1 << 28
    rng = np.random.default_rng(4)
    v, w = (np.concatenate([x, rng.integers(0, p, 40)]) for x in ([0, 1, p - 1, p // 2], [p - 1, 0, p - 1, p // 2 + 1]))
    key = np.concatenate([[0, top - 1, top - resample._SLOT, top - 2 * resample._SLOT], rng.integers(0, top, 40)])
    numbers = resample._coefficients(v, w)
    numbers = np.concatenate([numbers, resample._steps(numbers)])
    for n, side in ((1, 0), (9, 1), (resample.WHOLE, 0)):
        for k, got in enumerate(resample._slot_draws(key, numbers, n, side)):
            at = [(int(x) + resample._SLOT * (2 * k + side)) % top for x in key]
            assert got.tolist() == [(((x * a + b) ** 2 + x) * a + b) % p for x, a, b in zip(at, v.tolist(), w.tolist())]
    assert k == resample.WHOLE - 1


@pytest.mark.parametrize("n, same", [(9, False), (9, True), (300, False)])
def test_dealt_classes_in_numpy(n, same, monkeypatch):
    """Against units put in order one replicate at a time, with equal draws, an order of classes, and few and many values."""
    monkeypatch.setattr(resample, "_LEAST", 3)
    rng = np.random.default_rng(n)
    v, w = rng.integers(1, resample.PRIME, (2, 70))
    numbers, found = resample._coefficients(v, w), resample._Dealt(resample._coefficients(v, w), True, True, ["C", "A"])
    totals, pairs = {c: 0.0 for c in "ABC"}, {}
    for k in range(6):
        sizes = np.array([n - 4, 3, 1] if k % 2 else [1, 2, n - 3])
        keys = rng.integers(0, 4 if same else 1 << 28, n)
        values = rng.random(n) if k % 3 else (rng.random(n) < 0.3).astype(float)
        found.add(list("ABC"), sizes, keys, values)
        draws = np.array([resample._draws(keys, *numbers[:, r]) for r in range(70)])
        arms = dict(zip("ABC", np.split(np.arange(n), np.cumsum(sizes)[:2])))
        order = np.argsort(draws, axis=1, kind="stable")
        for c, arm in arms.items():
            totals[c] = totals[c] + (values - values.mean())[order[:, arm]].sum(axis=1)
        for a, b in ("CA", "CB", "AB"):
            both = np.concatenate([arms[a], arms[b]])
            dealt = values[both[np.argsort(draws[:, both], axis=1, kind="stable")]]
            here = dealt[:, : len(arms[a])].mean(axis=1) - dealt[:, len(arms[a]) :].mean(axis=1)
            pairs[a, b] = pairs.get((a, b), 0.0) + here
    for c, wanted in totals.items():
        assert found.totals[c] == pytest.approx(wanted, abs=1e-9)
    assert {pair: times.tolist() for pair, (_, times) in found.pairs.held.items()} == {pair: [6] * 70 for pair in pairs}
    for pair, wanted in pairs.items():
        assert found.pairs.held[pair][0] == pytest.approx(wanted, abs=1e-9)


def test_both_permutation_tests_draw_once(units, monkeypatch):
    """Together they give what each gives, from a draw a unit and replicate."""
    rounded = lambda frame: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.collect())
    wanted = [rounded(test(units, CTX, UNIT, 40)) for test in (resample.range_permutation, resample.pair_permutation)]
    seen, dealt_sums = [], resample._dealt_sums
    monkeypatch.setattr(resample, "_dealt_sums", lambda own, *a, **b: seen.append(own) or dealt_sums(own, *a, **b))
    assert [rounded(frame) for frame in resample.permutations(units, CTX, UNIT, 40)] == wanted and len(seen) == 1
