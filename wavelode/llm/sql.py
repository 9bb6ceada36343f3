"""DuckDB SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

import re

from . import decontaminate, filter_audit, hard_negatives, secret_scan

_REACH = "reach(a, b) as (select id, id from nodes union select r.a, l.b from reach r join links l on r.b = l.a), part as (select a as id, min(b) as component_id from reach group by a)"


def near_vectors(threshold: float = 0.93) -> str:
    """Links of op3 by comparing all vectors of a label, and their groups."""
    return f"""
    with recursive nodes as (
      select vec_id as id, label, embedding::double[] as x,
        label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0
          and len(list_filter(embedding, lambda v: v <> 0)) > 0 as ok
      from embeddings),
    links as (
      select p.id as a, q.id as b from nodes p join nodes q on p.label = q.label and p.id <> q.id and p.ok and q.ok and len(p.x) = len(q.x)
      where list_cosine_similarity(p.x, q.x) >= {threshold}),
    {_REACH},
    n as (select a, count(*) as n from links group by a)
    select part.id as vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, part.id = component_id as kept
    from part left join n on n.a = part.id
    """


def near_texts(percent: int = 85) -> str:
    """Links of op4 by counting shared shingles of all pairs that share one, and their groups."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    with recursive w as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') as w from documents),
    nodes as (
      select doc_id as id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) end as s from w),
    e as (select id, len(s) as n, unnest(s) as s from nodes),
    shared as (select a.id as a, b.id as b, count(*) as c, any_value(a.n) as n, any_value(b.n) as m from e a join e b on a.s = b.s and a.id <> b.id group by 1, 2),
    links as (select a, b from shared where 100 * c >= {percent} * (n + m - c)),
    {_REACH}
    select part.id as doc_id, len(nodes.s)::bigint as n_shingles, component_id, part.id = component_id as kept from part join nodes on nodes.id = part.id
    """


def secrets() -> str:
    """Spans of op8: lengths of the text between a rule's matches give where each match begins."""
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(secret_scan.BASE + secret_scan.EXTRA):
        # What must not stand before a match is taken as a group of its own there, and possessive repeats as plain ones.
        behind = re.match(r"\(\?<!\[(.*?)\]\)", pattern)
        pattern = pattern.replace("}+", "}")
        quoted = "'" + (f"(^|[^{behind[1]}]){pattern[behind.end():]}" if behind else pattern).replace("'", "''") + "'"
        before = f"regexp_extract_all(text, {quoted}, 1)" if behind else "null"
        parts.append(f"""
        select doc_id, {rank} as rank, '{kind}' as kind, list_sum([length(x) for x in b[1:i]]) + coalesce(list_sum([length(x) for x in w[1 : i - 1]]), 0) + coalesce(length(u[i]), 0) as start, length(w[i]) - coalesce(length(u[i]), 0) as n
        from (select doc_id, b, w, u, v, unnest(range(1, len(w) + 1)) as i from (
          select doc_id, string_split_regex(text, {quoted}) as b, regexp_extract_all(text, {quoted}, 0) as w, {before} as u, regexp_extract_all(text, {quoted}, {group}) as v
          from documents where regexp_matches(text, {quoted})))
        where length(v[i]) >= {least}""")
    span = "kind || ':' || start::bigint || ':' || (start + n)::bigint"
    counts = ", ".join(f"count(*) filter (where kind = '{rule[0]}') as n_{rule[0]}" for rule in secret_scan.BASE)
    zero = ", ".join(f"coalesce(n_{rule[0]}, 0)::bigint as n_{rule[0]}" for rule in secret_scan.BASE)
    return f"""
    with s as ({' union all '.join(parts)}),
    g as (select doc_id, {counts}, string_agg({span}, ',' order by start, rank) as spans, string_agg({span}, ',' order by start, rank) filter (where rank < {len(secret_scan.BASE)}) as base from s group by doc_id)
    select d.doc_id, {zero}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents d left join g on g.doc_id = d.doc_id
    """


def all_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontaminate.overlap_sql(),
        "op3_vector_near_dedup": near_vectors(),
        "op4_minhash_near_dedup": near_texts(),
        "op8_secret_scan": secrets(),
        "op12_filter_audit": filter_audit.audit_sql(),
        "op13_hard_negatives": hard_negatives.mine_sql(),
    }
