"""DuckDB SQL of resampling, folds and cross-validation, as views by name: what the queries of the catalog are held against."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

PRIME = 2147483647


def _hashed(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 7))::bigint"


def _drawn(key: str, v: str = "v", w: str = "w") -> str:
    first = f"(({key} * {v} + {w}) % {PRIME})"
    return f"((({first} * {first} + {key}) % {PRIME} * {v} + {w}) % {PRIME})"


def _replicates(repeats: int, seed: int) -> str:
    number = lambda name: f"({_hashed(repr(str(seed)), 'r', repr(name))} * 7 + 1) % {PRIME}"
    return f"select r::int as rep, {number('v')} as v, {number('w')} as w from range({repeats}) t(r)"


def _tested(stats: str, observed: str, keys: str, size: str) -> str:
    """p values of v_... stats (keys, rep, stat) against observed (keys, observed)."""
    on = f"using ({keys})" if keys else "on true"
    return f"""select {keys + ', ' if keys else ''}observed, count(*) as permutations, avg(stat) as permutation_mean, quantile_cont(stat, 0.025) as p025, quantile_cont(stat, 0.975) as p975,
        (count(*) filter ({size}(stat) >= {size}(observed) - 1e-12) + 1) / (count(*) + 1) as p from {stats} join {observed} {on} where stat is not null group by {keys + ', ' if keys else ''}observed"""


def _intervals(stats: str, repeats: int) -> str:
    return f"""select o.class_a, o.class_b, o.stat as observed, {repeats} as requested, count(s.stat) as available, {repeats} - count(s.stat) as unavailable, avg(s.stat) as bootstrap_mean, quantile_cont(s.stat, 0.025) as p025, quantile_cont(s.stat, 0.975) as p975,
        avg(case when s.stat > 1e-12 then 1.0 when s.stat is not null then 0.0 end) as above_zero, avg(case when s.stat < -1e-12 then 1.0 when s.stat is not null then 0.0 end) as below_zero from v_observed o left join {stats} s on s.class_a = o.class_a and s.class_b = o.class_b group by 1, 2, 3"""


def resampling(permutations: int, bootstraps: int) -> dict[str, str]:
    """Views over act_units and act_matched (ctx, cls, ident, response_rate)."""
    return {
        "v_perm": _replicates(permutations, 54),
        "v_boot": _replicates(bootstraps, 64),
        "v_keyed": f"select *, {_hashed('ctx', 'cls', 'ident')} as key, response_rate - avg(response_rate) over (partition by ctx) as residual from act_matched",
        "v_shares": "select ctx, cls, sum(n) over (partition by ctx order by cls) - n as lo, sum(n) over (partition by ctx order by cls) as hi from (select ctx, cls, count(*) as n from v_keyed group by 1, 2)",
        "v_range_places": f"select rep, ctx, residual, row_number() over (partition by rep, ctx order by {_drawn('key')}, cls, ident) as place from v_keyed, v_perm",
        "v_range_stats": "select rep, max(m) - min(m) as stat from (select rep, s.cls, avg(residual) as m from v_range_places p join v_shares s on p.ctx = s.ctx and place > lo and place <= hi group by 1, 2) group by 1",
        "v_range_observed": "select max(m) - min(m) as observed from (select cls, avg(residual) as m from v_keyed group by 1)",
        "v_range_test": _tested("v_range_stats", "v_range_observed", "", ""),
        "v_pairs": "select class_a, class_b, k.* from (select distinct a.ctx as c, a.cls as class_a, b.cls as class_b from act_units a join act_units b on a.ctx = b.ctx and a.cls < b.cls) p join v_keyed k on k.ctx = p.c and k.cls in (class_a, class_b)",
        "v_observed": "select class_a, class_b, avg(d) as stat from (select class_a, class_b, ctx, avg(response_rate) filter (cls = class_a) - avg(response_rate) filter (cls = class_b) as d from v_pairs group by 1, 2, 3) group by 1, 2",
        "v_pair_places": f"select rep, class_a, class_b, ctx, response_rate, count(*) filter (cls = class_a) over (partition by rep, class_a, class_b, ctx) as na, row_number() over (partition by rep, class_a, class_b, ctx order by {_drawn('key')}, cls, ident) as place from v_pairs, v_perm",
        "v_pair_stats": "select class_a, class_b, rep, avg(d) as stat from (select class_a, class_b, rep, ctx, avg(response_rate) filter (place <= na) - avg(response_rate) filter (place > na) as d from v_pair_places group by 1, 2, 3, 4) group by 1, 2, 3",
        "v_pair_test": _tested("v_pair_stats", "(select class_a, class_b, stat as observed from v_observed) o", "class_a, class_b", "abs"),
        "v_names": "select *, row_number() over (partition by class_a, class_b order by ctx) as c, count(*) over (partition by class_a, class_b) as n from (select distinct class_a, class_b, ctx from v_pairs)",
        "v_context_draws": f"select class_a, class_b, rep, v, w, c as draw, {_drawn(_hashed(repr('context'), 'class_a', 'class_b', 'c'))} * n // {PRIME} + 1 as c, {_hashed(repr('arm'), 'class_a', 'class_b', 'c')} as key from v_names, v_boot",
        "v_slots": "select class_a, class_b, ctx, cls, response_rate, row_number() over (partition by class_a, class_b, ctx, cls order by ident) as slot, count(*) over (partition by class_a, class_b, ctx, cls) as arm from v_pairs",
        "v_arm_slots": "select distinct class_a, class_b, ctx, cls, arm, unnest(range(arm)) as k from v_slots",
        "v_slot_draws": f"""select d.class_a, d.class_b, d.rep, d.draw, a.ctx, a.cls, {_drawn('((d.key + 104729 * (2 * a.k + case when a.cls = a.class_a then 0 else 1 end)) % 268435456)', 'd.v', 'd.w')} * arm // {PRIME} + 1 as slot
            from v_context_draws d join v_names n on d.class_a = n.class_a and d.class_b = n.class_b and d.c = n.c join v_arm_slots a on a.class_a = n.class_a and a.class_b = n.class_b and a.ctx = n.ctx""",
        "v_context_stats": """select class_a, class_b, rep, avg(d) as stat from (select d.class_a, d.class_b, d.rep, d.draw, avg(response_rate) filter (d.cls = d.class_a) - avg(response_rate) filter (d.cls = d.class_b) as d
            from v_slot_draws d join v_slots s on s.class_a = d.class_a and s.class_b = d.class_b and s.ctx = d.ctx and s.cls = d.cls and s.slot = d.slot group by 1, 2, 3, 4) group by 1, 2, 3""",
        "v_context_bootstrap": _intervals("v_context_stats", bootstraps),
        "v_idents": "select *, row_number() over (partition by class_a, class_b, cls order by ident) as i, count(*) over (partition by class_a, class_b, cls) as n from (select distinct class_a, class_b, cls, ident from v_pairs)",
        "v_times": f"select class_a, class_b, cls, rep, {_drawn(_hashed(repr('identity'), 'class_a', 'class_b', 'cls', 'i'))} * n // {PRIME} + 1 as i, count(*) as times from v_idents, v_boot group by 1, 2, 3, 4, 5",
        "v_cluster_contexts": """select p.class_a, p.class_b, t.rep, p.ctx, sum(response_rate * times) filter (p.cls = p.class_a) / sum(times) filter (p.cls = p.class_a) - sum(response_rate * times) filter (p.cls = p.class_b) / sum(times) filter (p.cls = p.class_b) as d
            from v_pairs p join v_idents i on i.class_a = p.class_a and i.class_b = p.class_b and i.cls = p.cls and i.ident = p.ident join v_times t on t.class_a = p.class_a and t.class_b = p.class_b and t.cls = p.cls and t.i = i.i group by 1, 2, 3, 4""",
        "v_cluster_stats": "select class_a, class_b, rep, avg(d) as stat from v_cluster_contexts group by 1, 2, 3",
        "v_arm_idents": "select class_a, class_b, count(*) filter (cls = class_a) as idents_a, count(*) filter (cls = class_b) as idents_b from v_idents group by 1, 2",
        "v_cluster_bootstrap": f"select b.*, idents_a, idents_b, least(idents_a, idents_b) < 2 as degenerate from ({_intervals('v_cluster_stats', bootstraps)}) b join v_arm_idents a on a.class_a = b.class_a and a.class_b = b.class_b",
        "v_held": "select distinct class_a, class_b, ident as held_out from v_pairs",
        "v_left": """select h.class_a, h.class_b, h.held_out, u.ctx, count(*) as units, avg(response_rate) filter (u.cls = u.class_a) - avg(response_rate) filter (u.cls = u.class_b) as d
            from v_held h join v_pairs u on u.class_a = h.class_a and u.class_b = h.class_b and u.ident <> h.held_out group by 1, 2, 3, 4""",
        "v_leave_one_out": """select h.class_a, h.class_b, h.held_out, o.stat as observed, count(d) as remaining_contexts, coalesce(sum(units) filter (d is not null), 0) as remaining_units, avg(d) as stat, avg(d) is null as unavailable,
            avg(d) is not null and abs(o.stat) > 1e-12 and (case when abs(avg(d)) <= 1e-12 then 0 else sign(avg(d)) end) <> sign(o.stat) as sign_changed
            from v_held h join v_observed o on o.class_a = h.class_a and o.class_b = h.class_b left join v_left l on l.class_a = h.class_a and l.class_b = h.class_b and l.held_out = h.held_out group by 1, 2, 3, 4""",
        "v_leave_one_out_summary": """select class_a, class_b, count(*) as idents_tested, count(*) filter (unavailable) as unavailable_holdouts, count(*) filter (sign_changed) as sign_change_holdouts, coalesce(string_agg(held_out, ';' order by held_out) filter (sign_changed), '') as changing_sign,
            min(remaining_contexts) as min_remaining_contexts, max(remaining_contexts) as max_remaining_contexts, min(stat) as min_stat, max(stat) as max_stat from v_leave_one_out group by 1, 2""",
        "v_range_left": """select h.held_out, u.ctx, u.cls, u.response_rate - avg(response_rate) over (partition by h.held_out, u.ctx) as r, min(cls) over (partition by h.held_out, u.ctx) <> max(cls) over (partition by h.held_out, u.ctx) as shared
            from (select distinct ident as held_out from act_units) h join act_units u on u.ident <> h.held_out""",
        "v_leave_one_out_range": """select held_out, max(m) - min(m) as stat, max(contexts) as remaining_contexts, sum(units) as remaining_units, max(m) - min(m) is null as unavailable
            from (select held_out, cls, avg(r) as m, count(*) as units from v_range_left where shared group by 1, 2) join (select held_out, count(distinct ctx) as contexts from v_range_left where shared group by 1) using (held_out) group by 1""",
    }


def shuffled(repeats: int, seed: int = 1044) -> dict[str, str]:
    """v_shuffled (rep, ident, shuffled) over acts (cls, ident)."""
    return {
        "v_shuffles": _replicates(repeats, seed),
        "v_named": "select ident, min(cls) as own, row_number() over (order by ident) as place, (select avg(label) from acts) as share from acts group by 1",
        "v_deals": f"select rep, own, row_number() over (partition by rep order by {_drawn(_hashed(repr('shuffle'), 'ident'))}, ident) as place from v_named, v_shuffles",
        "v_shuffled": "select d.rep, n.ident, d.own as shuffled from v_named n join v_deals d on d.place = n.place",
    }


def group_folds(k: int = 5, seed: int = 44) -> dict[str, str]:
    """v_group_folds (ident, fold) over acts (ident, label): one step for each group, largest first."""
    zeros = "[" + ", ".join(["0::bigint"] * k) + "]"
    return {
        "v_groups": f"select ident as g, count(*) as n, sum(label)::bigint as p, row_number() over (order by count(*) desc, sum(label) desc, md5('{seed}:' || ident), ident) as place, (select avg(label) from acts) as share from acts group by 1",
        "v_fold_steps": f"""select 0::bigint as place, null::varchar as g, {zeros} as ns, {zeros} as ps, -1::bigint as fold
            union all select o.place, o.g, list_transform(s.ns, lambda x, j: case when j = b then x + o.n else x end), list_transform(s.ps, lambda x, j: case when j = b then x + o.p else x end), b - 1
            from (select s.*, o.place as next, list_sort(list_transform(range(1, {k + 1}), lambda j: {{'n': s.ns[j] + o.n, 'off': abs((s.ps[j] + o.p) / (s.ns[j] + o.n) - o.share), 'j': j}}))[1].j as b from v_fold_steps s join v_groups o on o.place = s.place + 1) s join v_groups o on o.place = s.next""",
        "v_group_folds": "select g as ident, fold from v_fold_steps where place > 0",
    }


def cross_validation(prefix: str, placed: str, models: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Views by prefix over placed (split, row_id, fold, label, features as text): ..._held with labels by threshold."""
    features = sorted({f for own in models.values() for f in own})
    n = lambda name: f"{prefix}_{name}"
    local = " union all ".join(f"select split, fold, '{f}' as feature, {f} as value, count(*) - sum(label) as l0, sum(label) as l1 from {n('placed')} group by 1, 2, 4" for f in features)
    scored = []
    for name, own in models.items():
        joins = "".join(f" join {n('logs')} x{k} on x{k}.split = t.split and x{k}.fold = t.fold and x{k}.feature = '{f}' and x{k}.value = r.{f}" for k, f in enumerate(own))
        odds = "".join(f" + x{k}.d" for k in range(len(own)))
        scored.append(f"select t.split, '{name}' as model, t.fold, r.row_id, r.label, r.fold = t.fold as held, round(1 / (1 + exp(ln(n - n1 + 1.0::double) - ln(n1 + 1.0::double){odds})), 12) as score from {n('placed')} r join {n('train')} t on r.split = t.split{joins}")
    tp, fp, fn, tn = ("tp::double", "fp::double", "fn::double", "tn::double")
    margins = f"({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn})"
    return {
        n("placed"): placed,
        n("train"): f"select split, fold, sum(n) over (partition by split) - n as n, sum(p) over (partition by split) - p as n1 from (select split, fold, count(*) as n, sum(label) as p from {n('placed')} group by 1, 2)",
        n("local"): local,
        n("counts"): f"select t.split, r.fold, t.feature, t.value, t.c0 - coalesce(l.l0, 0) as c0, t.c1 - coalesce(l.l1, 0) as c1 from (select split, feature, value, sum(l0) as c0, sum(l1) as c1 from {n('local')} group by 1, 2, 3) t join {n('train')} r on r.split = t.split left join {n('local')} l on l.split = t.split and l.fold = r.fold and l.feature = t.feature and l.value = t.value",
        n("met"): f"select split, fold, feature, count(*) filter (c0 + c1 > 0) + 1 as k from {n('counts')} group by 1, 2, 3",
        n("logs"): f"select c.split, c.fold, c.feature, c.value, ln((c0 + 1.0::double) / (n - n1 + k)) - ln((c1 + 1.0::double) / (n1 + k)) as d from {n('counts')} c join {n('met')} m on m.split = c.split and m.fold = c.fold and m.feature = c.feature join {n('train')} t on t.split = c.split and t.fold = c.fold",
        n("scores"): " union all ".join(scored),
        n("cuts"): f"select split, model, fold, score, sum(p) over down as tp, sum(n - p) over down as fp, sum(p) over part - sum(p) over down as fn, sum(n - p) over part - sum(n - p) over down as tn from (select split, model, fold, score, sum(label) as p, count(*) as n from {n('scores')} where not held group by 1, 2, 3, 4) window part as (partition by split, model, fold), down as (partition by split, model, fold order by score desc rows unbounded preceding)",
        n("best"): f"select split, model, fold, arg_max(score, (coalesce(case when {margins} > 0 then ({tp} * {tn} - {fp} * {fn}) / sqrt({margins}) end, -999), coalesce(({tp} / nullif({tp} + {fn}, 0) + {tn} / nullif({tn} + {fp}, 0)) / 2, -999), -score)) as threshold from {n('cuts')} group by 1, 2, 3",
        n("held"): f"select s.split, s.model, s.fold, s.row_id, s.label, s.score, coalesce(b.threshold, 0.5) as threshold, (s.score >= coalesce(b.threshold, 0.5))::int as predicted from {n('scores')} s left join {n('best')} b on b.split = s.split and b.model = s.model and b.fold = s.fold where s.held",
    }


def evaluated(source: str, by: str, order: str, digits: int | None = None) -> str:
    """Metrics of scored and labelled rows for each value of the columns `by`; scores rounded to `digits` places before."""
    score = f"round(score, {digits})" if digits else "score"
    tp, fp, fn, tn = ("tp::double", "fp::double", "fn::double", "tn::double")
    margins = f"({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn})"
    return f"""select {by}, n, positives, prevalence, log_loss, brier, tp, tn, fp, fn, ({tp} / nullif({tp} + {fn}, 0) + {tn} / nullif({tn} + {fp}, 0)) / 2 as balanced_accuracy, case when {margins} > 0 then ({tp} * {tn} - {fp} * {fn}) / sqrt({margins}) end as mcc,
        case when positives > 0 and n > positives then (ranks - positives * (positives + 1) / 2.0::double) / (positives * (n - positives))::double end as roc_auc, average_precision from
        (select {by}, count(*) as n, sum(label) as positives, avg(label) as prevalence, avg(-case when label = 1 then ln(c) else ln(1 - c) end) as log_loss, avg((s - label) * (s - label)) as brier, count(*) filter (label = 1 and predicted = 1) as tp, count(*) filter (label = 0 and predicted = 0) as tn,
        count(*) filter (label = 0 and predicted = 1) as fp, count(*) filter (label = 1 and predicted = 0) as fn, sum(case when label = 1 then r else 0 end) as ranks, avg(case when label = 1 then hits / place::double end) as average_precision from
        (select *, least(greatest(s, 1e-15), 1 - 1e-15) as c, rank() over (partition by {by} order by s) + (count(*) over (partition by {by}, s) - 1) / 2.0::double as r, sum(label) over w as hits, count(*) over w as place from (select *, {score} as s from {source}) window w as (partition by {by} order by s desc, {order} rows unbounded preceding)) group by {by})"""
