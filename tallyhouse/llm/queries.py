"""Thin queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination_digest, find_benchmark
from .embedding_dedup import embedding_near_duplicates
from .hard_negatives import mine_hard_negatives
from .html_text import extract_main_text
from .language_id import predict_language, train_language_model
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_join
from .oracle import OP1_SQL, OP5_SQL, OP7_SQL, OP9_SQL, OP12_SQL
from .prefix_trie import conversation_trie, rebuilt
from .quality import score_quality, train_quality_model
from .secrets import find_secrets
from .url_filter import filter_urls, host_of
from .warc import warc_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        have = sc.environment.get("PYTHONPATH", "")
        if root not in have.split(":"):
            sc.environment["PYTHONPATH"] = f"{root}:{have}".rstrip(":")
    elif not getattr(sc, "_tallyhouse_shipped", False):
        import shutil
        import tempfile

        base = os.path.join(tempfile.mkdtemp(), "tallyhouse")
        sc.addPyFile(shutil.make_archive(base, "zip", root, "tallyhouse"))
        sc._tallyhouse_shipped = True


def crc_mod(column: str, n: int):
    return F.crc32(F.col(column).cast("string")) % n


def op1_ngram_join(spark, sf_dir):
    out = ngram_jaccard_join(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def op2_html_text(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least_words=1)


def op5_embedding_dedup(spark, sf_dir):
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_language_model(docs.where(crc_mod("doc_id", 4) != 2))
    out = predict_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark, sf_dir):
    return contamination_digest(find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train_quality_model(docs, labels.where(crc_mod("doc_id", 5) != 0))
    out = score_quality(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_warc(spark, sf_dir):
    return warc_round_trip(table(spark, sf_dir, "pages"))


def _digit(text: str, at: int):
    """Value of the hexadecimal digit at a place of a text."""
    return F.expr(f"instr('0123456789abcdef', substring({text}, {at}, 1)) - 1")


def op10_url_filter(spark, sf_dir):
    """Pages as captures of day ``page_id mod 365``; a quarter of hosts are listed at a day of their own, most are taken off later."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetched", F.col("page_id") % 365)
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).dropna().distinct().withColumn("h", F.md5("pattern"))
    hosts = hosts.withColumns({"pick": _digit("h", 1), "since": _digit("h", 2) * 16 + _digit("h", 3), "days": _digit("h", 4) * 8})
    on = hosts.where("pick < 4").select("pattern", F.lit("host").alias("category"), F.col("since").cast("long").alias("dated"), F.lit(True).alias("active"))
    off = hosts.where("pick < 3").select("pattern", F.lit("host").alias("category"), (F.col("since") + F.col("days")).cast("long").alias("dated"), F.lit(False).alias("active"))
    sections = spark.createDataFrame([("example.org", "domain", 100, True), ("example.org", "domain", 130, False), ("example.org", "domain", 300, True)], "pattern string, category string, dated long, active boolean")
    out = filter_urls(pages, on.unionByName(off).unionByName(sections))
    return out.select("page_id", "fetched", "n_active", "blocked", "category", "pattern")


def op11_hard_negatives(spark, sf_dir):
    """Some labels are moved, so that neighbours of a vector have other labels than its own."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("if(vec_id % 7 = 0, (label + 1L) % 10, label)").alias("label"))
    return mine_hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op12_secrets(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op13_prefix_trie(spark, sf_dir):
    return conversation_trie(*rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


OP3_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as h from documents
), s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source
), w as (
  select *, ([5, 2, 1])[place % 3 + 1]::bigint as weight, source_size * 3 as cap from s
), l as (
  select *, row_number() over o as ord,
    (sum(source_size) over () - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))::double
      / (sum(weight) over (o rows between current row and unbounded following))::double as level
  from w window o as (order by cap / weight, place)
), f as (
  select *, min(case when not (cap::double <= level * weight) then ord end) over () as first_free from l
), t as (
  select source, source_size, place, case when first_free is null or ord < first_free then cap::double else (max(case when ord = first_free then level end) over ()) * weight end as target from f
), p as (
  select doc_id, size, source_size, target, place, least(floor(target + 0.5), source_size * 3)::bigint as quota,
    sum(size) over (partition by d.source order by h, doc_id, size rows between unbounded preceding and current row) - size as start
  from d join t on d.source is not distinct from t.source
), c as (
  select sum(source_size)::bigint as total, count(*) as sources, greatest(64, (sum(source_size) + 67108863) // 67108864)::bigint as block from t
), u as (
  select *, round(sum(target) over (order by place) / total::double * 1e18)::bigint as high, least(floor(target + 0.5), source_size * 3)::bigint as quota,
    (source_size + block - 1) // block as blocks from t, c where total > 0
), g as (
  select slot, (slot::hugeint * 618033988749894848 % 1000000000000000000)::bigint as point
  from (select unnest(range(1, (total + block - 1) // block + 4 * sources + 1)) as slot from c)
), r as (
  select u.*, slot, row_number() over (partition by place order by slot) - 1 as r
  from g join (select *, coalesce(lag(high) over (order by place), 0) as low from u) u on point >= low and point < high
), k as (
  select place, slot, r % blocks * block as a, r % blocks * block + least(block, source_size - r % blocks * block, quota - r // blocks * source_size - r % blocks * block) as b
  from r where source_size > 0 and r < quota // source_size * blocks + (quota % source_size + block - 1) // block
), o as (
  select doc_id, p.place, start, min(slot)::bigint as first_slot from p join k on p.place = k.place and start < b and start + size > a where size > 0 group by all
)
select p.doc_id, size, source_size, target,
  (case when size = 0 then 0 else (quota // source_size) * size + greatest(least(quota % source_size - p.start, size), 0) end)::bigint as taken, first_slot
from p left join o on p.doc_id is not distinct from o.doc_id and p.place = o.place and p.start = o.start and size > 0
"""

OP4_SQL = r"""
with l as (
  select doc_id, line, body, list_filter(regexp_split_to_array(lower(body), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from (select doc_id, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents)
), t as (
  select doc_id, line, case when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as t from l where len(w) >= 1
), s as (
  select list_sort(t) as t, min({'doc_id': doc_id, 'line': line}) as f from t group by 1
), p as (
  select f, len(t) as n, unnest(t) as token from s
), near as (
  select x.f from p x join p y on x.token = y.token and y.f < x.f group by x.f, y.f, x.n, y.n having count(*) * 100 >= 80 * (x.n + y.n - count(*))
), gone as (
  select doc_id, line from t where {'doc_id': doc_id, 'line': line} not in (select f from s) union select f.doc_id, f.line from near
)
select doc_id, coalesce(string_agg(body, chr(10) order by l.line) filter (gone.line is null), '') as text, count(*)::bigint as n_lines, count(gone.line)::bigint as n_removed
from l left join gone using (doc_id, line) group by doc_id
"""

OP10_SQL = r"""
with c as (
  select page_id, page_id % 365 as fetched, url, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1)), '.') as host from pages
), h as (
  select distinct host as pattern, md5(host) as h from c where host <> ''
), n as (
  select pattern, strpos('0123456789abcdef', substr(h, 1, 1)) - 1 as pick,
    (strpos('0123456789abcdef', substr(h, 2, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 3, 1)) - 1 as since,
    (strpos('0123456789abcdef', substr(h, 4, 1)) - 1) * 8 as days from h
), e as (
  select pattern, 'host' as category, since as dated, true as active from n where pick < 4
  union all select pattern, 'host', since + days, false from n where pick < 3
  union all values ('example.org', 'domain', 100, true), ('example.org', 'domain', 130, false), ('example.org', 'domain', 300, true)
), once as (
  select pattern, category, dated, bool_or(active) as active from e group by all
), i as (
  select *, lead(dated) over (partition by pattern, category order by dated) as until from once
), m as (
  select page_id, count(*) as n, min({'dated': dated, 'pattern': pattern, 'category': category}) as f
  from c join i on (c.host = i.pattern or ends_with(c.host, '.' || i.pattern))
  where active and dated <= fetched and (until is null or fetched < until) group by page_id
)
select c.page_id, c.fetched, coalesce(n, 0)::bigint as n_active, coalesce(n, 0) > 0 as blocked, f.category as category, f.pattern as pattern
from c left join m using (page_id)
"""

OP11_SQL = r"""
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1::bigint) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), p as (
  select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where same qualify k <= 5
)
select p.anchor_id, p.vec_id as positive_id, (row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id))::int as rank, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.anchor_id = p.anchor_id and not n.same and 100 * n.score between 50 * p.score and 95 * p.score qualify rank <= 3
"""

# CRC32 goes through the bits of each sign: -1 stands for a shift
OP13_SQL = r"""
with p as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as place, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as said
  from conversations where conv_id is not null
), c as (
  select conv_id, conv_id - conv_id % 20 as source,
    xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda h, b: case when b >= 0 then xor(h, b) when h % 2 = 1 then xor(h // 2, 3988292384) else h // 2 end), 4294967295::bigint) % 4 as h
  from (select distinct conv_id from p)
), r as (
  select c.conv_id, 0 as own, place, said from c join p on p.conv_id = c.source and place < h
  union all select c.conv_id, 1, place, said from c join p on p.conv_id = c.conv_id and place >= h
), t as (
  select conv_id, coalesce(list(said order by own, place) filter (said is not null), []) as turns from c left join r using (conv_id) group by conv_id
), x as (
  select conv_id, len(turns) as n, unnest(range(0, len(turns) + 1)) as depth, turns from t
), g as (
  select turns[1:depth] as path, depth, min(conv_id) as conv_id, count(*) as n_convs, string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth) as ends,
    coalesce(len(regexp_extract_all((any_value(turns)[depth]).text, '[^\x20\x09-\x0D]+')), 0) as words from x group by 1, 2
), k as (
  select a.path, a.depth, count(*) filter (b.depth = a.depth + 1) as n_children, count(*) filter (b.leaf) as n_leaves, sum((b.n_convs - 1) * b.words)::bigint as saved
  from g a join (select *, not exists (select 1 from g y where y.depth = g.depth + 1 and y.path[1:g.depth] = g.path) as leaf from g) b on b.depth >= a.depth and b.path[1:a.depth] = a.path group by 1, 2
)
select g.conv_id, g.depth, u.conv_id as parent_conv_id, g.n_convs, n_children, n_leaves, saved as saved_tokens, sha256(coalesce(g.ends, '')) as ends_sha256
from g join k using (path, depth) left join g u on u.depth = g.depth - 1 and u.path = g.path[1:u.depth]
"""

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_html_text, op3_mixing, op4_line_dedup, op5_embedding_dedup, op6_language_id, op7_decontamination, op8_quality, op9_warc, op10_url_filter, op11_hard_negatives, op12_secrets, op13_prefix_trie)}
SQL = {
    "op1_ngram_join": OP1_SQL, "op5_embedding_dedup": OP5_SQL, "op7_decontamination": OP7_SQL, "op9_warc": OP9_SQL, "op12_secrets": OP12_SQL, "op4_line_dedup": OP4_SQL, "op3_mixing": OP3_SQL, "op10_url_filter": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_prefix_trie": OP13_SQL,
}
