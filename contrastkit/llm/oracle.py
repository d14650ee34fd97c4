"""DuckDB SQL for the results of corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

from itertools import permutations

from contrastkit.llm.filters import FILTERS
from contrastkit.llm.licenses import LEAST, TEMPLATES
from contrastkit.llm.quality import LADDERS

_BLANK = r"[\x20\x09-\x0D]+"
_SPACE = r"[^\x20\x09-\x0D]+"
_LINE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({k}, {_quoted(name)}, {_quoted(text)})" for k, (name, text) in enumerate(TEMPLATES))
_SHINGLES = "select distinct {key}, array_to_string(w[i:i + 4], ' ') as s from (select {key}, w, unnest(range(1, len(w) - 3)) as i from (select {key}, string_split(trim(regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') as w from {source}))"

_RUNGS = ", ".join(f"('{name}', {k}, {c}::double)" for name, ladder in LADDERS.items() for k, c in enumerate(ladder, 1))
_SIGNALS = {"symbol_share": "n_symbols / greatest(word_chars, 1)", "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeated_word_share": "n_repeat_words / greatest(n_words, 1)", "characters_a_word": "word_chars / greatest(n_words, 1)"}
_RULES = " union all ".join(f"select doc_id, lang, base_failed, '{name}' as rule, {signal} as signal from base" for name, signal in _SIGNALS.items())
_RISK, _LEVEL, _LIFT = 0.02, 0.05, 10.0
_P = _RISK / len(LADDERS)

_ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations(FILTERS))

_CLUSTERS, _ROUNDS = 8, 10
_ASSIGNED = "a{n} as materialized (select i, any_value(x) as x, min(struct_pack(d := cast(xx - 2 * list_inner_product(x, c) + list_inner_product(c, c) as bigint), k := k)) as m from kept, c{n} group by i)"
_MOVED = """c{m} as materialized (select o.k, coalesce(n.c, o.c) as c from c{n} o left join (select k, list(floor(s / n) order by p) as c from
            (select m.k as k, p, sum(v) as s, count(*) as n from (select m, unnest(x) as v, unnest(range(64)) as p from a{n}) group by 1, 2) group by 1) n on n.k = o.k)"""

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": f"""with templates as (select * from (values {_TEMPLATES}) t(template, license, text)), own as ({_SHINGLES.format(key="template", text="text", source="templates")}),
        met as ({_SHINGLES.format(key="doc_id", text="text", source="documents")}), size as (select template, count(*) as n from own group by 1)
        select doc_id, cast(t.template as integer) as template, t.license, cast(count(*) as integer) as shared, count(*) / max(n)::double as containment
        from met join own on met.s = own.s join size on size.template = own.template join templates t on t.template = own.template group by doc_id, t.template, t.license having count(*) >= {LEAST} * max(n)""",
    "op4_substring_dedup": f"""with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') as w from documents),
        windows as (select doc_id, i, array_to_string(w[i:i + 34], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from docs)),
        gone as (select distinct doc_id, unnest(range(i, i + 35)) as p from (select *, count(*) over (partition by s) as n from windows) where n > 1),
        words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from docs),
        kept as (select k.doc_id, count(g.p) as n_removed, string_agg(word, ' ' order by k.p) filter (g.p is null) as t from words k left join gone g on k.doc_id = g.doc_id and k.p = g.p group by 1)
        select d.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from docs d left join kept k on d.doc_id = k.doc_id""",
    "op7_embedding_near_dedup": """with recursive good as (select vec_id, label, embedding::double[] as x from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0),
        links as (select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.x, b.x) >= 0.98),
        reach as (select vec_id as v, vec_id as r from embeddings union select l.b, reach.r from reach join links l on reach.v = l.a)
        select e.vec_id, (select count(*) from links where a = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept from embeddings e join (select v, min(r) as component_id from reach group by 1) c on c.v = e.vec_id""",
    "op9_quality_rules": f"""with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') as w from documents),
        windows as (select doc_id, i, array_to_string(w[i:i + 2], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words)),
        repeats as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(i, i + 3)) as p from (select *, count(*) over (partition by doc_id, s) as n from windows) where n > 1) group by 1),
        lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents) where regexp_matches(line, '{_SPACE}') group by 1),
        base as (select d.doc_id, d.lang, len(w) as n_words, length(regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g')) as word_chars, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) as n_symbols,
            coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, len(w) < 50 or 100 * coalesce(r.n, 0) > 50 * len(w) as base_failed
            from documents d join words using (doc_id) left join repeats r using (doc_id) left join lines using (doc_id)),
        good as (select doc_id, max(quality) > 0 as good from labels where quality is not null group by 1), rungs(rule, rung, cutoff) as (values {_RUNGS}),
        rules as ({_RULES}), held as (select lang, rule, signal, good from rules join good using (doc_id) where not base_failed),
        tried as (select h.lang, g.rule, rung, cutoff, count(*) filter (good) as n_good, count(*) filter (not good) as n_bad, count(*) filter (good and signal > cutoff) as over_good, count(*) filter (not good and signal > cutoff) as over_bad from held h join rungs g using (rule) group by 1, 2, 3, 4),
        tails as (select *, case when n_good = 0 or over_good >= n_good * {_P} then 1.0 else list_sum(list_transform(range(0, over_good + 1), lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({_P}) + (n_good - j) * ln(1 - {_P})))) end as tail from tried),
        certified as (select *, max(tail) over (partition by lang, rule order by rung rows unbounded preceding) <= {_LEVEL} / {len(LADDERS)} / (select greatest(1, count(distinct coalesce('=' || lang, ''))) from held) as passes, over_good / greatest(n_good, 1) as share_good, over_bad / greatest(n_bad, 1) as share_bad from tails),
        cutoffs as (select lang, rule, arg_max(cutoff, (share_bad - share_good, -rung)) as cutoff from certified where passes and share_bad > {_LIFT} * share_good group by 1, 2),
        rejected as (select distinct r.doc_id from rules r join cutoffs c on r.rule = c.rule and r.lang is not distinct from c.lang where signal > cutoff)
        select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and r.doc_id is null as kept from base b left join rejected r on r.doc_id = b.doc_id""",
    "op8_line_dedup": f"""with lines as (select doc_id, p, line, translate(trim(line, {_LINE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
        from (select doc_id, unnest(l) as line, unnest(range(len(l))) as p from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))),
        owners as (select k, min(doc_id) as owner from lines where length(k) >= 10 group by 1 having count(distinct doc_id) > 1)
        select doc_id, count(*) as n_lines, count(*) filter (owner <> doc_id) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by p) filter (owner is null or owner = doc_id), '')) as kept_sha256
        from lines left join owners on lines.k = owners.k group by 1""",
    "op11_filter_audit": f"""with words as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') as w from documents),
        good as (select doc_id, coalesce(max((quality = 1)::int), 0) as good, coalesce(max((toxic = 1)::int), 0) as toxic from labels where doc_id is not null group by 1),
        failed as (select d.doc_id, part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
            coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)] as f from words d left join good g on g.doc_id = d.doc_id),
        masks as (select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by 1, 2),
        orders as (select o, unnest(range(1, 6)) as step from (values {_ORDERS}) t(o)),
        steps as (select o, step, strpos('{FILTERS}', o[step]) as own, list_transform(range(1, step), lambda i: strpos('{FILTERS}', o[i])) as earlier from orders),
        told as (select part, o as filter_order, step, own, n, good, toxic, f[own] as fails, len(list_filter(earlier, lambda k: f[k])) > 0 as gone, len(list_filter(f, lambda x: x)) as fails_all from masks, steps),
        rows as (select part, filter_order, step, own, sum(n) filter (not fails and not gone) as kept, sum(n) filter (fails and not gone) as removed, sum(n) filter (fails and gone) as redundant, sum(n) filter (fails and fails_all = 1) as unique_fails,
            sum(good) filter (fails and not gone) as good_lost, sum(toxic) filter (fails and not gone) as toxic_lost from told group by 1, 2, 3, 4)
        select part, filter_order, cast(step as integer) as step, {", ".join(f"cast(coalesce({c}, 0) as bigint) as {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, cast(coalesce(sum(removed) over (partition by part, own), 0) as bigint) as shapley from rows""",
    "op12_centroid_clusters": f"""with kept as materialized (select *, list_inner_product(x, x) as xx from (select vec_id, row_number() over () as i, list_transform(embedding, lambda v: floor(1024 * v::double)) as x
            from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0)),
        c0 as materialized (select row_number() over (order by sha256('3:' || vec_id) nulls last, x) - 1 as k, x as c from kept qualify k < {_CLUSTERS}),
        {", ".join(_ASSIGNED.format(n=n) + ", " + _MOVED.format(n=n, m=n + 1) for n in range(_ROUNDS))}, {_ASSIGNED.format(n=_ROUNDS)}
        select vec_id, cast(m.k as integer) as cluster, m.d as distance, cast(sum(m.d) over (partition by m.k) as bigint) as cluster_inertia, cast(sum(m.d) over () as bigint) as inertia,
            sha256(array_to_string(list_transform(c, lambda v: cast(v as bigint)), ',')) as centroid_sha256 from a{_ROUNDS} a join kept on kept.i = a.i join c{_ROUNDS} c on c.k = m.k""",
}
