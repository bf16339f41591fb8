"""URL filters with dates: a temporal join of captures with list entries.

Entries (pattern, dated, active) say that a pattern is put on a list or taken off.  They become
validity intervals; each capture is judged by the entries active when it was fetched.  A
pattern is a domain, which covers its subdomains, or a host with the first segments of a path.
A capture is looked up under each domain its host belongs to and each of its path
prefixes, so the join is on equal keys, with the interval as a further condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Intervals up to which their list is broadcast (about 100 bytes each); beyond, look-ups are shuffled.
BROADCAST_INTERVALS = 200_000
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without port, user and last dot; null if there is none."""
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def lookup_keys(url: Column, depth: int | None = None) -> Column:
    """Patterns that would cover ``url``: its domains, and its host with 1, 2, ... path segments, up to ``depth``."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    if depth is not None:
        segments = F.slice(segments, F.lit(1), F.lit(depth))
    paths = F.transform(segments, lambda x, i: F.concat_ws("/", host, F.array_join(F.slice(segments, F.lit(1), i + 1), "/")))
    return F.array_distinct(F.concat(domains, paths))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, since, until) for which an entry is active; until is null for those that last.

    Of entries of a pattern and category at the same time an active one wins.  Null patterns, times
    or states are ignored; a null category is ''.
    """
    e = entries.select(F.lower("pattern").alias("pattern"), F.coalesce("category", F.lit("")).alias("category"), "dated", "active").dropna(subset=["pattern", "dated", "active"])
    e = e.groupBy("pattern", "category", "dated").agg(F.max("active").alias("active"))
    later = Window.partitionBy("pattern", "category").orderBy("dated")
    return e.withColumn("until", F.lead("dated").over(later)).where("active").select("pattern", "category", F.col("dated").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """``captures`` with n_active (entries that cover it), blocked, category and pattern.

    Pattern and category are those of the entry active the longest, then the first by name.  Null urls,
    urls without a host and null times are covered by nothing.  Columns of ``captures`` with
    the added names are replaced; repeated captures are looked up once and each keeps its row.  Path prefixes
    are made up to the length of the longest pattern, so long urls cost no more than patterns ask for.
    """
    added = ["n_active", "blocked", "category", "pattern"]
    captures = captures.select(*[c for c in captures.columns if c not in added])
    asked = captures.select(F.col(url_col).alias("_url"), F.col(fetched_col).alias("_at")).dropna().distinct()
    intervals = written(validity_intervals(entries), "intervals")
    # prefixes longer than any pattern cover nothing
    size, depth = intervals.agg(F.count("*"), F.max(F.size(F.split("pattern", "/")) - 1)).first()
    keys = asked.select("_url", "_at", F.explode(lookup_keys(F.col("_url"), depth or 0)).alias("pattern"))
    active = keys.join(F.broadcast(intervals) if size <= BROADCAST_INTERVALS else intervals, "pattern").where("since <= _at and (until is null or _at < until)")
    first = F.min(F.struct("since", "pattern", "category"))
    found = active.groupBy("_url", "_at").agg(F.count("*").alias("n_active"), first.alias("_first"))
    out = captures.join(found, (captures[url_col] == found["_url"]) & (captures[fetched_col] == found["_at"]), "left")
    n, cover = F.coalesce(found["n_active"], F.lit(0)), found["_first"]
    return out.select(*[captures[c] for c in captures.columns], n.alias("n_active"), (n > 0).alias("blocked"), cover["category"].alias("category"), cover["pattern"].alias("pattern"))
