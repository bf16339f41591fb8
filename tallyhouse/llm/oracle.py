"""SQL for DuckDB that says what operators should find, by plain joins over all pairs that share something."""

from __future__ import annotations

from .secrets import ALLOWED, CLASSES, STAND_INS

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(nodes: str, links: str) -> str:
    """Common table ``comp`` (node, component): the smallest node that links lead to; ``links`` has a and b, in one direction or both."""
    return f"""comp as (
  with recursive both_ways as (select a, b from {links} union select b, a from {links}), reach(node, top) as (
    select node, node from {nodes} union select l.b, r.top from reach r join both_ways l on l.a = r.node where r.top < l.b
  ) select node, min(top) as component from reach group by node
)"""


OP1_SQL = rf"""
with d as (
  select doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') as w from documents
), s as materialized (
  select doc_id, case when w is null or len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as t from d
), p as materialized (
  select doc_id, len(t) as n, unnest(t) as token from s
), near as materialized (
  select x.doc_id as a, y.doc_id as b from p x join p y on x.token = y.token and x.doc_id < y.doc_id group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))
), nodes as (select doc_id as node from d), {_components("nodes", "near")}, links as (
  select a, count(*) as n_links from (select a, b from near union all select b, a from near) group by a
)
select s.doc_id, len(t)::bigint as n_shingles, component as component_id, coalesce(n_links, 0)::bigint as n_links from s join comp on node = s.doc_id left join links on a = s.doc_id
"""

OP5_SQL = rf"""
with e as (
  select vec_id, embedding::double[] as v, embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as fit from embeddings
), near as (
  select x.vec_id as a, y.vec_id as b from e x join e y on x.vec_id < y.vec_id and x.fit and y.fit and len(x.v) = len(y.v)
  where list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v)) / sqrt(list_dot_product(y.v, y.v)) >= 0.9
), nodes as (select vec_id as node from e), {_components("nodes", "near")}, links as (
  select a, count(*) as n_links from (select a, b from near union all select b, a from near) group by a
)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component as component_id, component = vec_id as kept from e join comp on node = vec_id left join links on a = vec_id
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP7_SQL = rf"""
with d as (
  select doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}'), []) as w from documents
), i as (
  select item_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}'), []) as w from benchmark where item_id is not null
), g as (
  select distinct item_id, least(len(w), 10) as size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k : k + 9], ' '))) as phrase from i where len(w) > 0
), o as (
  select doc_id, size, unnest(range(1, len(w) - size + 2)) as k, w from d join (select distinct size from g) on len(w) >= size
), h as (
  select doc_id, k, o.size, item_id from (select doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') as phrase from o) o join g on g.phrase = o.phrase and g.size = o.size
), c as (
  select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(k, k + size)) as place from h) group by doc_id
), f as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id::varchar as item_id from h) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join f using (doc_id)
"""

OP9_SQL = r"""
with p as (
  select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as top from pages
), h as (
  select *, sha1(html) as hex from p
)
select page_id, octet_length(encode(html))::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4 * 5 + 1)::int, 5))::bigint >> ((3 - i % 4) * 5)::int) & 31)::int + 1, 1)), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id < top then top end as refers_to
from h
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(kind: int, pattern: str, least: int, part: str) -> str:
    """(doc_id, kind, a, b) of the matches of one form: what lies between matches gives their places."""
    return f"""select doc_id, {kind} as kind, a - len(hit) as a, a as b from (
    select doc_id, unnest(hits) as hit, unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(hits[1:i], lambda x: len(x))) + list_sum(list_transform(gaps[1:i], lambda x: len(x))))) as a
    from (select doc_id, regexp_extract_all(text, {_quoted(pattern)}) as hits, regexp_split_to_array(text, {_quoted(pattern)}) as gaps from d)
  ) where len({part}) >= {least}"""


_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"""({_EITHER})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_RUN = f"[{CLASSES[-1].signs}]{{{min(c.window for c in CLASSES)},}}"
_WINDOW = "case " + " ".join(f"when regexp_full_match(run, '[{c.signs}]+') then {c.window}" for c in CLASSES) + " end"
_MOST = "case " + " ".join(f"when regexp_full_match(run, '[{c.signs}]+') then {c.most_sum}" for c in CLASSES) + " end"
_PERMITTED = " or ".join([f"regexp_full_match(run, {_quoted(p)})" for p in ALLOWED] + [f"contains(lower(run), {_quoted(w)})" for w in STAND_INS])

OP12_SQL = f"""
with d as (
  select doc_id, coalesce(text, '') as text from documents
), base as (
  {_spans(0, _ASSIGN, 12, f"regexp_extract(hit, {_quoted(_ASSIGN)}, 2)")}
  union all {_spans(1, "AKIA[A-Z0-9]{14,}", 18, "hit")}
  union all {_spans(2, "[0-9a-f]{16,}", 16, "hit")}
), runs as (
  select doc_id, hit as run, a - len(hit) as start from (
    select doc_id, unnest(hits) as hit, unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(hits[1:i], lambda x: len(x))) + list_sum(list_transform(gaps[1:i], lambda x: len(x))))) as a
    from (select doc_id, regexp_extract_all(text, '{_RUN}') as hits, regexp_split_to_array(text, '{_RUN}') as gaps from d)
  )
), windows as (
  select doc_id, start, i, size, most, substr(run, (i + 1)::int, size::int) as piece from (
    select doc_id, start, run, size, most, unnest(range(0, len(run) - size + 1)) as i
    from (select *, {_WINDOW} as size, {_MOST} as most from runs where not ({_PERMITTED})) where len(run) >= size
  )
), high as (
  select doc_id, start, i, size from windows
  where list_sum(list_transform(list_distinct(string_split(piece, '')), lambda s: round((len(piece) - len(replace(piece, s, ''))) * log2(len(piece) - len(replace(piece, s, ''))) * 1048576)::bigint)) <= most
), joined as (
  select *, sum(fresh) over (partition by doc_id, start order by i) as island
  from (select *, case when i <= lag(i) over (partition by doc_id, start order by i) + size then 0 else 1 end as fresh from high)
), added as (
  select doc_id, 3 as kind, start + min(i) as a, start + max(i) + any_value(size) as b from joined group by doc_id, start, island
), spans as (
  select * from base union all select * from added where not exists (select 1 from base where base.doc_id = added.doc_id and base.a <= added.a and base.b >= added.b)
), told as (
  select doc_id, kind, a, (['assign', 'access', 'hex', 'entropy'])[kind + 1] || ':' || a::bigint || ':' || b::bigint as span from spans
), counts as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    string_agg(span, ',' order by a, kind) filter (kind < 3) as base, string_agg(span, ',' order by a, kind) as spans from told group by doc_id
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join counts using (doc_id)
"""
