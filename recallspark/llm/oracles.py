"""SQL for the queries of this subpackage that SQL can express: op1, op2, op8 and op10.

The others need a tokenizer, a model, XXH64 or spans beyond their base patterns; tests compare them with plain versions.
"""

from __future__ import annotations

from recallspark.llm.secrets import RULES


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""select doc_id, '{kind}' as kind, {rank} as rank, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i:
  {{'a': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'ok': length(j[i]) >= {least}}}), lambda s: s.ok)) as s
 from (select doc_id, string_split_regex(t, '{pattern}') as g, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {group}) as j from texts_ where regexp_matches(t, '{pattern}'))"""


_FOUND = " union all ".join(_spans(r.kind, k, r.pattern, r.group, r.least) for k, r in enumerate(RULES))
_BASE = [r.kind for r in RULES if r.base]
_COUNTS = ", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in _BASE)
_SUMS = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in _BASE)
_LIST = "string_agg(kind || ':' || cast(s.a as bigint) || ':' || cast(s.a + s.n as bigint), ',' order by s.a, rank)"

ORACLE_SQL = {
    "op1_secrets": f"""with texts_ as (select doc_id, coalesce(text, '') as t from documents), found_ as ({_FOUND}),
each_ as (select doc_id, {_SUMS}, {_LIST} filter (rank < {len(_BASE)}) as base, {_LIST} as spans from found_ group by doc_id)
select doc_id, {_COUNTS}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents left join each_ using (doc_id)""",
    "op2_substring_dedup": r"""with words_ as (select doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
windows_ as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from words_ where len(w) >= 13)),
least_ as (select s, min(doc_id) as d from windows_ group by s), hits_ as (select doc_id, i from windows_ join least_ using (s) where d < doc_id),
gone_ as (select distinct doc_id, unnest(range(i, i + 13)) as p from hits_), each_ as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from words_),
kept_ as (select doc_id, count(*) as n_words, count(g.doc_id) as n_removed, string_agg(case when g.doc_id is null then x end, ' ' order by e.p) as k from each_ e left join gone_ g using (doc_id, p) group by doc_id)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256 from documents left join kept_ using (doc_id)""",
    "op8_vector_dedup": """with recursive fine_ as (select vec_id, embedding::double[] as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
links_ as (select a.vec_id as a, b.vec_id as b from fine_ a join fine_ b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.9),
reach_(vec_id, r) as (select vec_id, vec_id from embeddings union select reach_.vec_id, b from reach_ join links_ on r = a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from (select vec_id, min(r) as component_id from reach_ group by vec_id) left join (select a as vec_id, count(*) as n from links_ group by a) using (vec_id)""",
    "op10_topk_search": """with fine_ as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored_ as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from fine_ q join fine_ c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored_) where rank <= 5""",
}
