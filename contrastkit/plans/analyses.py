"""Whole analyses: pages to an activity audit, activities to a study, observations to matched contrasts.

Each gives named DataFrames. Frames that several results branch from are written to the scratch folder and read back, so
that no plan holds another. The one data-dependent branch is the gate before modelling, a single row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrastkit.functions.text import MAJOR, contains_any
from contrastkit.operators import association, audit, bayes, decide, folds, matched, measurements, resample
from contrastkit.session import cut


@dataclass(frozen=True)
class Roles:
    """Which columns play which part. Defaults are those of an activity table."""

    row_id: str = "row_id"
    source: str = "adc_id"
    cls: str = "payload_mechanism"
    ident: str = "payload_identity"
    context: tuple[str, ...] = ("cell_line", "antigen_name")
    major: tuple[str, ...] = MAJOR


def activity_audit(rows: DataFrame, roles: Roles = Roles(), key: str = "cell_line", unit: str = "units") -> dict[str, DataFrame]:
    """What an activity table can tell: class summaries, dependency of class on identity, shared keys, verdict."""
    own = cut(rows.where((F.col("is_potency_endpoint") == "1") | contains_any(F.col("standard_type"))), "potency")
    degrees = audit.key_degrees(own, key, roles.cls)
    return {
        "potency": own,
        "classes": audit.class_summary(own, roles.cls, roles.ident, [roles.ident, *roles.context, roles.source], roles.row_id, unit=unit),
        "imbalance": audit.imbalance(own, roles.cls),
        "degrees": audit.degree_distribution(degrees),
        "shared_keys": degrees.where("degree > 1"),
        "rows_in_shared_keys": audit.rows_in_shared_keys(own, key, roles.cls),
        "pair_overlap": association.shared_contexts(own, [key], roles.cls, skip_blank=True),
        "dependency": audit.dependency(own, roles.ident, roles.cls),
        "verdict": decide.audit_verdict(degrees, audit.identities_by_class(own, roles.cls, roles.ident)),
    }


def feature_sets(roles: Roles) -> dict[str, list[str]]:
    bio = [*reversed(roles.context)]
    return {
        "global": [],
        "mechanism_only": [roles.cls],
        "payload_only": [roles.ident],
        **{f"{c}_only": [c] for c in bio},
        "bio": bio,
        "bio_plus_mechanism": [*bio, roles.cls],
        "bio_plus_payload": [*bio, roles.ident],
        "bio_plus_payload_plus_mechanism": [*bio, roles.ident, roles.cls],
    }


def _splits(rows: DataFrame, roles: Roles, label: str, k: int, seed: int) -> DataFrame:
    """(split, row_id, fold): random rows, and whole groups by identity, by each context column and by context."""
    own = lambda frame, name: frame.select(F.lit(name).alias("split"), roles.row_id, "fold")
    out = own(folds.stratified_folds(rows, label, roles.row_id, k, seed), "random_row")
    out = out.unionByName(own(folds.group_folds(rows, roles.ident, label, k, seed), "payload_group"))
    for c in roles.context:
        out = out.unionByName(own(folds.group_folds(rows, c, label, k, seed), f"{c}_group"))
    return out.unionByName(own(folds.leave_one_group_folds(rows, roles.ident), "leave_one_payload_out"))


def shuffle_control(rows: DataFrame, roles: Roles, label: str, k: int, seed: int, repeats: int) -> DataFrame:
    """(repeat, model, metrics): pooled metrics of each repeat with classes dealt anew among identities. Rows with equal
    scores rank in the order of folds and of row ids as text."""
    grouped = folds.group_folds(rows, roles.ident, label, k, seed).select(roles.row_id, "fold")
    deals = resample.dealt_classes(rows, roles.cls, roles.ident, seed + 1000, repeats)
    out = bayes.shuffle_control_results(rows, grouped, list(roles.context), deals, roles.ident, label, roles.row_id)
    return out.select(F.col("rep").alias("repeat"), F.lit("bio_plus_shuffled_mechanism").alias("model"), *[c for c in out.columns if c != "rep"])


def study(rows: DataFrame, roles: Roles = Roles(), threshold: float = 10.0, k: int = 5, seed: int = 44, repeats: int = 50, always: bool = False) -> dict[str, DataFrame]:
    """From measured rows to a verdict on the class: routing, collapsing, audit, overlap, gate, and models if the gate
    lets them through (or `always`)."""
    potency = (F.col("is_potency_endpoint") == "1") | contains_any(F.col("standard_type"))
    sent = cut(measurements.routed(rows, potency, threshold=threshold), "routed")
    keys = [roles.source, *roles.context, roles.ident]
    collapsed = cut(measurements.collapsed(measurements.usable(sent), keys, "value_nm", "label", roles.row_id, [roles.cls, roles.row_id], roles.row_id), "collapsed")
    major = collapsed.where(F.col(roles.cls).isin(*roles.major))
    context = list(roles.context)
    overlap = association.overlap(major, context, roles.cls, roles.ident, "label")
    effects = matched.prevalence_effects(major, context, roles.cls, roles.ident, "label")
    links = association.associations(collapsed.withColumn("_context", F.concat_ws(" || ", *context)), {c: (roles.cls, c) for c in (roles.ident, *context, "_context")})
    classes = audit.modelling_summary(major, roles.cls, roles.ident, "label", context, roles.row_id)
    gate = decide.model_gate(classes, overlap.where("degree > 1"), links.where(F.col("association") == roles.ident))
    out = {
        "exclusions": measurements.exclusion_counts(sent),
        "collapsed": collapsed,
        "conflicts": measurements.conflicts(measurements.usable(sent), keys, "value_nm", "label", roles.row_id),
        "classes": classes,
        "associations": links,
        "crossed": association.crossed(overlap, context),
        "pair_overlap": association.shared_contexts(major, context, roles.cls),
        "prevalence_effects": effects,
        "prevalence_summary": matched.prevalence_summary(effects),
        "gate": gate,
    }
    if not always and gate.first()["decision"] != "GO_FOR_CHEAP_FALSIFICATION":
        return out
    splits = cut(_splits(major, roles, "label", k, seed), "splits")
    predictions = bayes.cross_validated(major, splits, feature_sets(roles), "label", roles.row_id)
    pooled = cut(bayes.pooled_results(predictions, roles.row_id), "pooled")
    shuffled = cut(shuffle_control(major, roles, "label", k, seed, repeats), "shuffled")
    return out | {"predictions": predictions, "fold_results": bayes.fold_results(predictions, roles.row_id), "pooled": pooled, "shuffled": shuffled, "verdict": decide.model_verdict(pooled, shuffled)}


def contrasts(rows: DataFrame, context: Sequence[str], cls: str, ident: str, label: str, repeats: Mapping[str, int] | None = None, seed: int = 44, order: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Class contrasts inside exact contexts, with permutation, bootstrap and leave-one-out checks, and the verdict.

    repeats: of "permutation" and "bootstrap".
    """
    times = {"permutation": 10000, "bootstrap": 5000} | dict(repeats or {})
    keys = [*context, "cls", "ident"]
    every = cut(measurements.units(rows, context, cls, ident, label), "units")
    own = cut(matched.matched(every, context), "matched")
    effects = cut(matched.pair_effects(own, context, order), "effects")
    summary = matched.pair_summary(effects)
    covered = matched.coverage(own, context, order)
    strong = own.join(matched.strong_overlap(covered, context), list(context), "left_semi")
    permutation = resample.pair_permutation(own, context, keys, times["permutation"], seed + 10, order)
    bootstrap = resample.context_bootstrap(own, context, keys, times["bootstrap"], seed + 20, order)
    left_out = resample.leave_one_out_pairs(own, context, order)
    matched_rows = rows.join(own.select(*context).distinct(), list(context), "left_semi")
    reduced = matched.reduction({"all": (rows, every), "matched": (matched_rows, own)}, context, cls, ident, label)
    return {
        "units": every,
        "reduction": reduced,
        "survival": matched.survival(reduced, "matched", "all"),
        "coverage": covered,
        "effects": matched.displayed(effects),
        "summary": matched.displayed(summary),
        "pairings": matched.displayed(matched.pairings(effects, context)),
        "residuals": matched.residuals(own, context),
        "residual_summary": matched.residual_summary(own, context),
        "range_permutation": resample.range_permutation(own, context, keys, times["permutation"], seed + 10),
        "pair_permutation": permutation,
        "context_bootstrap": bootstrap,
        "cluster_bootstrap": resample.cluster_bootstrap(own, context, times["bootstrap"], seed + 20, order),
        "leave_one_out": left_out,
        "leave_one_out_range": resample.leave_one_out_range(own, context),
        "strong_overlap_summary": matched.displayed(matched.pair_summary(matched.pair_effects(strong, context, order))),
        "verdict": decide.contrast_verdict(summary, bootstrap, resample.leave_one_out_summary(left_out), permutation),
    }
