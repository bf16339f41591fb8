"""Registered queries of the vote domain, each with SQL for the same result."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from .config import Config
from .functions import identity
from .functions.numeric import backoff_seconds, shard
from .operators.admission import admit, request_option, status_counts, validate_polls
from .operators.batching import batch_numbers, done_is_last, pack
from .operators.completion import completion, deadlines, stale_counts
from .operators.limits import issue_counts, issue_limit, newest_entries
from .operators.progress import commit_prefix, deltas
from .operators.report import labelled_counts, load_profile_of, mean_rate, option_of, percentiles, reconcile, rolled_up, throughput
from .operators.settle import evictable, new_finals, outcomes
from .operators.tally import poll_totals, snapshot, tally, workers
from .plans.tables import SECRET, events, messages, polls, votes, votes_of_events
from .sources.messages import decode, encode_value, read_json_folder, votes_of, write_json_folder
from .sources.polls import create_poll, get_poll, public_view, with_results
from .sources.store import exists, working_folder
from .streaming.ledger import Ledger
from .streaming.metrics import counts_of, observed
from .streaming.stateful import BATCHES, OUTPUT, batches, final_results, open_polls

QUERIES: dict = {}
SQL: dict[str, str] = {}

_VOTES = """v as (
  select strftime(ts, '%Y-%m-%d') as poll_id, user_id::varchar as fingerprint, cast(json_extract_string(props, '$.k') as bigint) % 4 + 1 as option_id,
    'w' || (event_id % 3)::varchar as worker_id, event_id as seq, ts from events
), polls as (
  select strftime(ts, '%Y-%m-%d') as id, min(date_trunc('day', ts))::timestamp + interval 20 hours as ends_at from events group by 1
)"""
_FIRST = "f as (select poll_id, fingerprint, arg_min(option_id, seq) as option_id from v group by 1, 2)"
_TALLY = f"{_FIRST}, t as (select poll_id, option_id, count(*) as votes from f group by 1, 2)"
_MESSAGES = """e as (
  select poll_id, worker_id, max(seq) as seq from v group by 1, 2
), m as (
  select v.*, e.seq is not null and (v.worker_id <> 'w2' or substr(v.poll_id, 9, 2)::int % 2 = 0) as done from v left join e using (poll_id, worker_id, seq)
)"""
_WORKERS = "w as (select poll_id, count(distinct worker_id) as workers_seen, count(distinct case when done then worker_id end) as workers_done from m group by 1)"


def query(sql: str, *parts: str):
    """Registers a query with its SQL, behind the parts it builds on."""

    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"with {', '.join(parts)} {sql}" if parts else sql
        return f

    return keep


@query("select * from t", _VOTES, _TALLY)
def tally_first_wins(spark, sf_dir):
    return tally(votes(spark, sf_dir)).withColumnRenamed("count", "votes")


@query("select poll_id, count(distinct fingerprint) as unique_voters, (select sum(votes)::bigint from t where t.poll_id = v.poll_id) as total from v group by poll_id", _VOTES, _TALLY)
def unique_voters(spark, sf_dir):
    v = votes(spark, sf_dir)
    return v.groupBy("poll_id").agg(F.count_distinct("fingerprint").alias("unique_voters")).join(poll_totals(v), "poll_id")


@query("select poll_id, sum(votes)::bigint as total from t group by 1", _VOTES, _TALLY)
def poll_totals_query(spark, sf_dir):
    return poll_totals(votes(spark, sf_dir))


@query(
    """select poll_id, '[' || string_agg('{"option_id":' || option_id || ',"count":' || votes || '}', ',' order by option_id) || ']' as options, sum(votes)::bigint as total from t group by 1""",
    _VOTES,
    _TALLY,
)
def poll_results_nested(spark, sf_dir):
    options = F.to_json(F.array_sort(F.collect_list(F.struct("option_id", "count"))))
    return tally(votes(spark, sf_dir)).groupBy("poll_id").agg(options.alias("options"), F.sum("count").alias("total"))


_STATUS = """a as (
  select seq, poll_id, case when id is null then 404 when option_id not in (1, 2, 3) then 400 when ts >= ends_at then 403 else 202 end as status
  from (select v.*, id, ends_at from (select * replace (case when seq % 50 = 7 then 'none' else poll_id end as poll_id) from v) v left join polls on id = poll_id)
)"""


def _requests(spark, sf_dir):
    return votes(spark, sf_dir).withColumn("poll_id", F.when(F.col("seq") % 50 == 7, "none").otherwise(F.col("poll_id")))


@query("select seq, poll_id, status from a", _VOTES, _STATUS)
def admission_status(spark, sf_dir):
    return admit(_requests(spark, sf_dir), polls(spark, sf_dir)).select("seq", "poll_id", "status")


@query(
    "select poll_id, count(*) filter (status = 202) as accepted, count(*) filter (status = 403) as forbidden, count(*) filter (status = 400) as bad, count(*) filter (status = 404) as unknown from a group by 1",
    _VOTES,
    _STATUS,
)
def admission_status_counts(spark, sf_dir):
    return status_counts(admit(_requests(spark, sf_dir), polls(spark, sf_dir)), "poll_id")


_ADDRESS = """x as (
  select event_id, case event_id % 4 when 0 then ' 10.0.' || user_id % 256 || '.1 , 6.6.6.6' when 1 then '' end as xff,
    case event_id % 4 when 1 then ' 8.8.' || user_id % 256 || '.8 ' end as real_ip,
    case event_id % 4 when 2 then '9.9.' || user_id % 256 || '.9:1111' else 'pipe' end as remote,
    case event_id % 4 when 0 then '10.0.' || user_id % 256 || '.1' when 1 then '8.8.' || user_id % 256 || '.8' when 2 then '9.9.' || user_id % 256 || '.9' else 'pipe' end as client_ip
  from events
)"""


@query("select event_id, client_ip, sha256(client_ip) as fingerprint from x", _ADDRESS)
def fingerprint_fallback(spark, sf_dir):
    k, u = F.col("event_id") % 4, (F.col("user_id") % 256).cast("string")
    rows = events(spark, sf_dir).select(
        "event_id",
        F.when(k == 0, F.concat(F.lit(" 10.0."), u, F.lit(".1 , 6.6.6.6"))).when(k == 1, "").alias("xff"),
        F.when(k == 1, F.concat(F.lit(" 8.8."), u, F.lit(".8 "))).alias("real_ip"),
        F.when(k == 2, F.concat(F.lit("9.9."), u, F.lit(".9:1111"))).otherwise("pipe").alias("remote"),
    )
    rows = rows.withColumn("client_ip", identity.client_ip(F.col("xff"), F.col("real_ip"), F.col("remote")))
    return rows.select("event_id", "client_ip", identity.hash_ip(F.col("client_ip")).alias("fingerprint"))


def _hmac_sql(message: str) -> str:
    key = SECRET.ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in key).hex() for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message})))"


_SIGNED = f"c as (select seq, poll_id, fingerprint, fingerprint || '.' || {_hmac_sql("encode(poll_id) || unhex('00') || encode(fingerprint)")} as cookie from v)"


@query("select seq, cookie from c", _VOTES, _SIGNED)
def cookie_sign(spark, sf_dir):
    return votes(spark, sf_dir).select("seq", identity.sign(SECRET, F.col("poll_id"), F.col("fingerprint")).alias("cookie"))


@query("select seq, case when seq % 4 in (0, 3) then fingerprint end as raw from c", _VOTES, _SIGNED)
def cookie_verify(spark, sf_dir):
    """Every fourth cookie is for another poll, every fourth cut short, every fourth in upper case."""
    v = votes(spark, sf_dir).withColumn("cookie", identity.sign(SECRET, F.col("poll_id"), F.col("fingerprint")))
    k = F.col("seq") % 4
    poll = F.when(k == 1, "other").otherwise(F.col("poll_id"))
    cookie = F.when(k == 2, F.expr("left(cookie, length(cookie) - 1)")).when(k == 3, F.upper("cookie")).otherwise(F.col("cookie"))
    return v.select("seq", identity.verify(SECRET, poll, cookie).alias("raw"))


@query(
    """select seq, row_number() over (partition by v.poll_id, user5 order by ts, seq) <= 20 or ts > ends_at + interval 10 minutes as issued
    from (select *, fingerprint::bigint % 5 as user5 from v) v join polls on id = poll_id""",
    _VOTES,
)
def issue_limit_query(spark, sf_dir):
    rows = votes(spark, sf_dir).join(polls(spark, sf_dir).select(F.col("id").alias("poll_id"), "ends_at"), "poll_id")
    rows = rows.withColumn("ip_hash", identity.hash_ip((F.col("fingerprint").cast("bigint") % 5).cast("string")))
    return issue_limit(rows, 20).select("seq", "issued")


@query("select poll_id, sha256((fingerprint::bigint % 5)::varchar) as ip_hash, count(*) as requests from v group by all", _VOTES)
def issue_counts_query(spark, sf_dir):
    return issue_counts(votes(spark, sf_dir).withColumn("ip_hash", identity.hash_ip((F.col("fingerprint").cast("bigint") % 5).cast("string"))))


@query("select fingerprint as key, max(seq) as first_seen from v group by 1 order by 2 desc limit 100", _VOTES)
def newest_limiter_entries(spark, sf_dir):
    entries = votes(spark, sf_dir).groupBy(F.col("fingerprint").alias("key")).agg(F.max("seq").alias("first_seen"))
    return newest_entries(entries, 100)


@query(
    "select poll_id, worker_id, batch, count(*) as votes, min(seq) as first_seq from (select *, (row_number() over (partition by poll_id, worker_id order by seq) - 1) // 10 as batch from v) group by 1, 2, 3",
    _VOTES,
)
def batch_pack(spark, sf_dir):
    return batch_numbers(votes(spark, sf_dir), 10).groupBy("poll_id", "worker_id", "batch").agg(F.count("*").alias("votes"), F.min("seq").alias("first_seq"))


@query("select poll_id, worker_id, coalesce(max(case when done then seq end) = max(seq), true) as ok from m group by 1, 2", _VOTES, _MESSAGES)
def done_is_last_query(spark, sf_dir):
    return done_is_last(messages(spark, sf_dir))


@query("select * from w", _VOTES, _MESSAGES, _WORKERS)
def workers_seen_done(spark, sf_dir):
    return workers(messages(spark, sf_dir))


_NOW = "timestamp '2024-01-15 20:00:10'"
_STALE = "n as (select count(*) as total from m), s as (select poll_id, total - 1 - min(seq) - (count(*) - 1) as code, total - 1 - max(seq) as spec from m, n group by poll_id, total)"


@query("select poll_id, code as stale from s", _VOTES, _MESSAGES, _STALE)
def stale_code(spark, sf_dir):
    return stale_counts(messages(spark, sf_dir), "code")


@query("select poll_id, spec as stale from s", _VOTES, _MESSAGES, _STALE)
def stale_spec(spark, sf_dir):
    return stale_counts(messages(spark, sf_dir), "spec")


_REASON = f"""r as (
  select poll_id, workers_seen, workers_done, code as stale, case when {_NOW} < ends_at + interval 1 second then null when {_NOW} >= ends_at + interval 10 days then 'hard_timeout'
    when not q and code >= 300 then 'stale' when q then 'quorum' end as reason
  from (select *, workers_seen > 0 and workers_done >= greatest((workers_seen * 90 + 99) // 100, 1) as q from w join s using (poll_id) join polls on id = poll_id)
)"""


def _completion(spark, sf_dir):
    ends = polls(spark, sf_dir).select(F.col("id").alias("poll_id"), "ends_at")
    return completion(messages(spark, sf_dir), ends, F.expr("timestamp_ntz '2024-01-15 20:00:10'"), Config(stale_messages=300, hard_timeout=864000.0))


@query("select * from r", _VOTES, _MESSAGES, _WORKERS, _STALE, _REASON)
def completion_reason(spark, sf_dir):
    return _completion(spark, sf_dir)


_PARTITIONED = "p as (select poll_id, (seq % 2)::int as part, seq as off, seq % 97 = 0 as malformed from v), settled as (select distinct poll_id from v where substr(poll_id, 9, 2)::int <= 12)"


@query(
    """select part as partition, max(off) as committed from (
      select part, off, bool_and(malformed or poll_id in (select poll_id from settled)) over (partition by part order by off rows unbounded preceding) as ok from p) where ok group by 1""",
    _VOTES,
    _PARTITIONED,
)
def commit_prefix_query(spark, sf_dir):
    v = votes(spark, sf_dir)
    rows = v.select("poll_id", (F.col("seq") % 2).cast("int").alias("partition"), F.col("seq").alias("offset"), (F.col("seq") % 97 == 0).alias("malformed"))
    settled = v.where(F.substring("poll_id", 9, 2).cast("int") <= 12).select("poll_id")
    return commit_prefix(rows, settled)


_SETTLE = "fin as (select poll_id from r where reason is not null union all values ('none')), comp as (select id as poll_id from polls where substr(id, 9, 2)::int % 3 = 0)"


def _settling(spark, sf_dir):
    finals = _completion(spark, sf_dir).where("reason is not null").select("poll_id").unionByName(spark.createDataFrame([("none",)], "poll_id string"))
    done = polls(spark, sf_dir).select(F.col("id").alias("poll_id")).where(F.substring("poll_id", 9, 2).cast("int") % 3 == 0)
    return finals, done


@query(
    "select poll_id, case when poll_id not in (select id from polls) then 'not_found' when poll_id in (select poll_id from comp) then 'already_completed' else 'written' end as outcome from fin",
    _VOTES, _MESSAGES, _WORKERS, _STALE, _REASON, _SETTLE,
)
def settle_outcome(spark, sf_dir):
    finals, done = _settling(spark, sf_dir)
    return outcomes(finals, polls(spark, sf_dir), done)


@query("select poll_id from fin where poll_id not in (select poll_id from comp)", _VOTES, _MESSAGES, _WORKERS, _STALE, _REASON, _SETTLE)
def new_finals_query(spark, sf_dir):
    return new_finals(*_settling(spark, sf_dir))


@query("select distinct poll_id from fin where poll_id not in (select poll_id from v where seq >= 5000)", _VOTES, _MESSAGES, _WORKERS, _STALE, _REASON, _SETTLE)
def evict_candidates(spark, sf_dir):
    return evictable(_settling(spark, sf_dir)[0], votes(spark, sf_dir).where("seq >= 5000"))


@query(
    "select poll_id, total, workers_seen, workers_done, substr(poll_id, 9, 2)::int % 3 = 0 as flushed from w join (select poll_id, sum(votes)::bigint as total from t group by 1) using (poll_id)",
    _VOTES, _TALLY, _MESSAGES, _WORKERS,
)
def active_polls(spark, sf_dir):
    m = messages(spark, sf_dir)
    return snapshot(m, m, _settling(spark, sf_dir)[1])


@query(
    """select poll_id, accepted, total as counted, case when total is null then 'NO RESULT' when total < accepted then 'LOST ' || (accepted - total) when total > accepted then '+' || (total - accepted) || ' unconfirmed' else 'OK' end as verdict,
      total is null or total < accepted as failed
    from (select poll_id, count(*) filter (status = 202) as accepted from a group by 1) left join (select poll_id, sum(votes)::bigint as total from t group by 1) using (poll_id)""",
    _VOTES, _STATUS, _TALLY,
)
def reconcile_accepted(spark, sf_dir):
    accepted = status_counts(admit(_requests(spark, sf_dir), polls(spark, sf_dir)), "poll_id").select("poll_id", "accepted")
    return reconcile(accepted, poll_totals(votes(spark, sf_dir)))


@query(
    """select event_type, n, s[(floor(0.5::double * (n - 1)))::bigint + 1] as p50, s[(floor(0.9::double * (n - 1)))::bigint + 1] as p90, s[(floor(0.99::double * (n - 1)))::bigint + 1] as p99, s[n] as highest
    from (select event_type, count(value) as n, list_sort(list(value) filter (value is not null)) as s from events group by 1)"""
)
def latency_percentiles(spark, sf_dir):
    return percentiles(events(spark, sf_dir), "event_type", "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, count(*) as n, sum(count(*)) over (order by date_trunc('hour', ts))::bigint as running from events group by date_trunc('hour', ts)")
def throughput_per_window(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"))
    return rows.withColumn("running", F.sum("n").over(Window.orderBy("hour")))


@query("select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as delta from events group by 1, 2")
def running_deltas(spark, sf_dir):
    """Running totals by day taken apart again."""
    n = events(spark, sf_dir).groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    running = n.withColumn("total", F.sum("n").over(Window.partitionBy("event_type").orderBy("day")))
    return deltas(running, "event_type", "day", "total").select("event_type", "day", "delta")


@query("select count(*) as n, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) as rate from events")
def mean_rate_query(spark, sf_dir):
    return mean_rate(events(spark, sf_dir), "ts").select("n", F.round("rate", 9).alias("rate"))


@query(
    """select day, tick, floor(n * case when tick >= 24 then 1 else 3 * (tick / 24.0::double) ^ 2 - 2 * (tick / 24.0::double) ^ 3 end)::bigint as want,
      want - lag(want, 1, 0) over (partition by day order by tick) as launch, seen
    from (select day, n, unnest(range(1, 25)) as tick from (select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1))
    left join (select strftime(ts, '%Y-%m-%d') as day, extract(hour from ts)::bigint + 1 as tick, count(*) as seen from events group by 1, 2) using (day, tick)"""
)
def load_profile(spark, sf_dir):
    """What a ramped load of each day's size would have begun by each hour, beside what the hour had."""
    e = events(spark, sf_dir)
    days = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    seen = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.hour("ts") + 1).cast("bigint").alias("tick")).agg(F.count("*").alias("seen"))
    return load_profile_of(days, "day", "n", 24).join(seen, ["day", "tick"], "left")


_ASKED = """q as (
  select event_id, case event_id % 7 when 0 then '' when 1 then null else event_type end as question,
    case event_id % 5 when 0 then ['yes'] when 1 then ['yes', null, 'no'] when 2 then ['yes', 'no', ''] when 3 then null else ['yes', 'no', 'yes'] end as options,
    case event_id % 3 when 0 then 60 when 1 then 0 end as seconds,
    case event_id % 4 when 0 then timestamp '2024-01-15 12:00:00' + interval 1 hour when 1 then timestamp '2024-01-15 12:00:00' end as given from events
), x as (
  select *, case when coalesce(question, '') = '' then 'question is required' when coalesce(len(options), 0) < 2 then 'at least two options are required'
    when list_position(list_transform(options, lambda o: coalesce(o, '')), '') > 0 then 'option ' || (list_position(list_transform(options, lambda o: coalesce(o, '')), '') - 1) || ' is empty'
    when given is not null and given <= timestamp '2024-01-15 12:00:00' then 'ends_at is in the past' when given is null and coalesce(seconds, 0) <= 0 then 'duration_seconds or ends_at is required' end as error from q
)"""


@query("select event_id, error, case when error is null then len(options) end as options, case when error is null then strftime(coalesce(given, timestamp '2024-01-15 12:00:00' + interval 60 seconds), '%Y-%m-%d %H:%M:%S') end as ends_at from x", _ASKED)
def create_poll_validate(spark, sf_dir):
    """A request for a poll from each event, with faults by its number: no question, too few options, missing and empty ones, bad ends."""
    now, k = "timestamp_ntz '2024-01-15 12:00:00'", F.col("event_id")
    options = "case event_id % 5 when 0 then array('yes') when 1 then array('yes', null, 'no') when 2 then array('yes', 'no', '') when 3 then null else array('yes', 'no', 'yes') end"
    rows = events(spark, sf_dir).select(
        "event_id",
        F.when(k % 7 == 0, "").when(k % 7 != 1, F.col("event_type")).alias("question"),
        F.expr(options).alias("options"),
        F.when(k % 3 == 0, 60).when(k % 3 == 1, 0).alias("duration_seconds"),
        F.when(k % 4 == 0, F.expr(f"{now} + interval 1 hour")).when(k % 4 == 1, F.expr(now)).alias("ends_at"),
    )
    out = validate_polls(rows, F.expr(now))
    return out.select("event_id", "error", F.when(F.col("error").isNull(), F.size("options")).cast("bigint").alias("options"), F.date_format("ends_at", "yyyy-MM-dd HH:mm:ss").alias("ends_at"))


#: Kinds of message bodies by number; {p}, {w}, {f}, {o} are the poll, worker, voter and option of an event.
_BODIES = [
    '{"poll_id":"{p}","worker_id":"{w}","done":false,"votes":[{"fingerprint":"{f}","option_id":{o}}]}',
    '{"POLL_ID":"{p}","Worker_Id":"{w}","Done":true,"more":{"done":1},"VOTES":[{"FingerPrint":"{f}","Option_ID":{o}}]}',
    '{"poll_id":"{p}","done":true} x',
    '{"poll_id":"{p}"}]',
    '{"poll_id":"{p}"},{"poll_id":"{p}"}',
    '{"poll_id":"{p}","votes":[{"fingerprint":"{f}","option_id":"{o}"}]}',
    '{"worker_id":"{w}"}',
    '["{p}"]',
    '{"poll_id":"{p}"',
    ' ',
    ' {"poll_id":"{p}","votes":[{"option_id":{o}}, {"fingerprint":"{f}"}],"worker_id":null} ',
    '{"poll_id":7,"worker_id":"{w}"}',
    '{"poll_id":"{p}","votes":[{"fingerprint":{o},"option_id":{o}}]}',
    "{'poll_id':'{p}'}",
    '{"poll_id":"{p}","worker_id":"a\\"Poll_ID\\":b"}',
]


def _bodies(v):
    """The body of an event by its number."""
    text = F.element_at(F.array(*[F.lit(b) for b in _BODIES]), (F.col("seq") % len(_BODIES) + 1).cast("int"))
    for mark, value in (("{p}", F.col("poll_id")), ("{w}", F.col("worker_id")), ("{f}", F.col("fingerprint")), ("{o}", F.col("option_id").cast("string"))):
        text = F.replace(text, F.lit(mark), value)
    return text


@query(
    """select seq, k not in (0, 1, 10, 14) as malformed, poll_id, case k when 14 then 'a"Poll_ID":b' when 10 then '' else worker_id end as worker_id, k = 1 as done,
      case k when 10 then ':' || option_id || ',' || fingerprint || ':0' when 14 then '' else fingerprint || ':' || option_id end as votes
    from (select *, seq % 15 as k from v) where k in (0, 1, 10, 14)
    union all select seq, true, '', '', false, '' from v where seq % 15 not in (0, 1, 10, 14)""",
    _VOTES,
)
def message_decode(spark, sf_dir):
    """Messages from events: names of fields in other cases, text behind the value, wrong types, missing fields, quotes in texts."""
    v = votes(spark, sf_dir)
    rows = decode(v.select("seq", _bodies(v).cast("binary").alias("value")), strict=True)
    text = F.array_join(F.transform("votes", lambda x: F.concat(F.coalesce(x["fingerprint"], F.lit("")), F.lit(":"), F.coalesce(x["option_id"], F.lit(0)).cast("string"))), ",")
    good = lambda c, other: F.when(F.col("malformed"), other).otherwise(c)
    return rows.select("seq", "malformed", good(F.col("poll_id"), "").alias("poll_id"), good(F.col("worker_id"), "").alias("worker_id"), good(F.col("done"), False).alias("done"), good(text, "").alias("votes"))


@query(
    """select seq, case seq % 9 when 0 then option_id when 1 then option_id when 2 then option_id when 6 then 0 end as option_id
    from v""",
    _VOTES,
)
def request_bodies(spark, sf_dir):
    """Bodies of vote requests: as they should be, in other cases, within spaces; with text behind, as text, twice, without an option, too long, and none."""
    k, o = F.col("seq") % 9, F.col("option_id").cast("string")
    made = lambda a, b: F.concat(F.lit(a), o, F.lit(b))
    body = (
        F.when(k == 0, made('{"option_id":', "}")).when(k == 1, made('{"x":[{"option_id":9}],"Option_Id":', "}")).when(k == 2, made('\n\t{"option_id" : ', ' }\r\n'))
        .when(k == 3, made('{"option_id":', "} x")).when(k == 4, made('{"option_id":"', '"}')).when(k == 5, made('{"option_id":', '}{"option_id":1}'))
        .when(k == 6, "{}").when(k == 7, F.concat(made('{"option_id":', ""), F.repeat(F.lit(" "), 1 << 20), F.lit("}")))
    )
    rows = votes(spark, sf_dir).select("seq", body.alias("body"))  # made once for each row
    return rows.select("seq", request_option(F.col("body")).alias("option_id"))


@query("select * from t", _VOTES, _TALLY)
def round_trip_tally(spark, sf_dir):
    """Votes packed into messages, encoded, decoded and counted."""
    v = votes(spark, sf_dir)
    one = v.select(F.col("seq").alias("offset"), "poll_id", "worker_id", F.lit(False).alias("done"), F.array(F.struct("fingerprint", "option_id")).alias("votes"))
    sent = one.select("offset", encode_value().alias("value"))
    return tally(votes_of(decode(sent))).withColumnRenamed("count", "votes")


@query("select id as poll_id, o as option_id, 'option ' || o as text, coalesce(votes, 0)::bigint as votes from polls cross join (values (1), (2), (3)) x(o) left join t on t.poll_id = id and t.option_id = o", _VOTES, _TALLY)
def option_labels(spark, sf_dir):
    counts = labelled_counts(polls(spark, sf_dir), tally(votes(spark, sf_dir)))
    return counts.withColumnRenamed("count", "votes").withColumn("option_id", F.col("option_id").cast("int"))


@query("select poll_id, min(seq) as first_seen, max(seq) as last_seen from v group by 1", _VOTES)
def first_last_seen(spark, sf_dir):
    return votes(spark, sf_dir).groupBy("poll_id").agg(F.min("seq").alias("first_seen"), F.max("seq").alias("last_seen"))


@query("select strftime(max(ends_at), '%Y-%m-%d %H:%M') as last_end from polls", _VOTES)
def last_end(spark, sf_dir):
    return polls(spark, sf_dir).agg(F.date_format(F.max("ends_at"), "yyyy-MM-dd HH:mm").alias("last_end"))


@query("select f.poll_id, v.seq, v.fingerprint from v join (select poll_id, fingerprint, min(seq) as seq from v group by 1, 2) f using (poll_id, fingerprint) where v.seq > f.seq", _VOTES)
def repeated_votes(spark, sf_dir):
    """Votes that don't count because their fingerprint has voted."""
    v = votes(spark, sf_dir)
    first = v.groupBy("poll_id", "fingerprint").agg(F.min("seq").alias("_first"))
    return v.join(first, ["poll_id", "fingerprint"]).where("seq > _first").select("poll_id", "seq", "fingerprint")


@query(
    """select key, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(key, ''), lambda c: ascii(c)::bigint)), lambda h, b: xor(h, b) * 16777619 % 4294967296) % 64 as shard
    from (select distinct poll_id || '|' || worker_id as key from v)""",
    _VOTES,
)
def shard_of(spark, sf_dir):
    keys = votes(spark, sf_dir).select(F.concat_ws("|", "poll_id", "worker_id").alias("key")).distinct()
    return keys.select("key", shard(F.col("key"), 64).alias("shard"))


@query(
    """select seq, raw is not null and raw <> '' as had_cookie, case when seq % 3 = 0 then fingerprint else sha256('192.0.2.' || fingerprint::bigint % 256) end as fingerprint,
      case when seq % 9 = 3 then 400 when seq % 50 = 7 then 404 when seq % 9 = 4 or option_id not in (1, 2, 3) then 400 when ts >= ends_at then 403 else 202 end as status
    from (select v.*, ends_at, case seq % 3 when 0 then cookie when 1 then 'x.y' when 2 then case when seq % 2 = 0 then '' end end as raw from v join polls on id = v.poll_id join c using (seq))""",
    _VOTES, _SIGNED,
)
def vote_requests(spark, sf_dir):
    """The vote call as one plan: body, fingerprint by cookie or address, admission.  Some bodies are cut short, some have no option."""
    v, k = votes(spark, sf_dir), F.col("seq") % 9
    body = F.when(k == 3, '{"option_id":').when(k == 4, "{}").otherwise(F.format_string('{"option_id":%d}', "option_id"))
    cookie = F.when(F.col("seq") % 3 == 0, identity.sign(SECRET, F.col("poll_id"), F.col("fingerprint"))).when(F.col("seq") % 3 == 1, "x.y").when(F.col("seq") % 2 == 0, "")
    address = identity.client_ip(F.lit(""), F.lit(""), F.concat(F.lit("192.0.2."), (F.col("fingerprint").cast("bigint") % 256).cast("string"), F.lit(":80")))
    rows = v.withColumns({"cookie": cookie, "address": address, "body": body}).withColumn("option_id", request_option(F.col("body")))
    rows = rows.withColumns({"had_cookie": identity.has_cookie(F.col("cookie")), "fingerprint": identity.fingerprint(SECRET, F.col("poll_id"), F.col("cookie"), F.col("address"))})
    rows = rows.withColumn("poll_id", F.when(F.col("seq") % 50 == 7, "none").otherwise(F.col("poll_id")))
    return admit(rows, polls(spark, sf_dir)).select("seq", "had_cookie", "fingerprint", "status")


@query("select strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as second, count(*) as n from events group by 1")
def throughput_per_second(spark, sf_dir):
    return throughput(events(spark, sf_dir), "ts", "1 second").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("second"), "n")


@query(
    """select poll_id, worker_id, batch, false as done, string_agg(fingerprint || ':' || option_id, ',' order by seq) as votes from b group by 1, 2, 3
    union all select poll_id, worker_id, max(batch) + 1, true, '' from b group by 1, 2""",
    _VOTES, "b as (select *, (row_number() over (partition by poll_id, worker_id order by seq) - 1) // 10 as batch from v)",
)
def packed_messages(spark, sf_dir):
    text = F.array_join(F.transform("votes", lambda x: F.concat(x["fingerprint"], F.lit(":"), x["option_id"].cast("string"))), ",")
    return pack(votes(spark, sf_dir), 10).select("poll_id", "worker_id", "batch", "done", text.alias("votes"))


@query(
    """select id, case when total is null then 'active' else 'completed' end as status, total, options, w.workers_seen, w.workers_done
    from polls left join (select poll_id, sum(votes)::bigint as total, string_agg(option_id || '=' || votes, ',' order by option_id) as options from t where substr(poll_id, 9, 2)::int % 3 = 0 group by 1) r on r.poll_id = id
    left join w on w.poll_id = r.poll_id""",
    _VOTES, _TALLY, _MESSAGES, _WORKERS,
)
def polls_with_results(spark, sf_dir):
    """Every third day's poll is settled; the others have no result."""
    counts = tally(votes(spark, sf_dir)).where(F.substring("poll_id", 9, 2).cast("int") % 3 == 0)
    out = with_results(polls(spark, sf_dir), counts.join(workers(messages(spark, sf_dir)), "poll_id"))
    options = F.array_join(F.transform("results.options", lambda o: F.concat(o["option_id"].cast("string"), F.lit("="), o["count"].cast("string"))), ",")
    return out.select("id", "status", "results.total", options.alias("options"), "results.workers_seen", "results.workers_done")


@query("select id, 3 as options, strftime(ends_at, '%Y-%m-%d %H:%M:%S') as ends_at from polls where id = '2024-01-15'", _VOTES)
def public_poll(spark, sf_dir):
    known = polls(spark, sf_dir).withColumn("results", F.lit(None).cast("string"))
    return public_view(get_poll(known, "2024-01-15")).withColumns({"options": F.size("options"), "ends_at": F.date_format("ends_at", "yyyy-MM-dd HH:mm:ss")})


@query("select event_id % 3 + 1 as option_id, count(*) as votes from events group by 1")
def assigned_options(spark, sf_dir):
    return events(spark, sf_dir).groupBy(option_of(F.col("event_id"), 3).alias("option_id")).agg(F.count("*").alias("votes"))


@query("select event_id, least(0.5 * 2 ^ (event_id % 8), 20)::double as wait from events")
def retry_waits(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", backoff_seconds(F.col("event_id") % 8, 0.5, 20.0).alias("wait"))


@query(
    "select poll_id, strftime(case when substr(poll_id, 9, 2)::int % 2 = 0 then ends_at else first + interval 1 hour end, '%Y-%m-%d %H:%M:%S') as ends_at from (select poll_id, min(ts)::timestamp as first from v group by 1) join polls on id = poll_id",
    _VOTES,
)
def deadline_default(spark, sf_dir):
    """Polls of odd days aren't known, so they end a hard timeout after their first message."""
    known = polls(spark, sf_dir).where(F.substring("id", 9, 2).cast("int") % 2 == 0)
    seen = votes(spark, sf_dir).select("poll_id", F.col("ts").cast("timestamp_ntz").alias("arrived"))
    return deadlines(seen, known, Config(hard_timeout=3600.0)).select("poll_id", F.date_format("ends_at", "yyyy-MM-dd HH:mm:ss").alias("ends_at"))


@query(
    """select day, unnest(range(1, len(kinds) + 1)) as id, unnest(kinds) as text
    from (select strftime(ts, '%Y-%m-%d') as day, list_sort(list(distinct event_type)) as kinds from events group by 1) where len(kinds) >= 2"""
)
def numbered_options(spark, sf_dir):
    """A poll for each day about the kinds of its events."""
    kinds = events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("options"))
    asked = kinds.select("day", F.lit("which?").alias("question"), "options", F.lit(60).alias("duration_seconds"), F.lit(None).cast("timestamp_ntz").alias("ends_at"))
    made = validate_polls(asked, F.expr("timestamp_ntz '2026-09-10 08:00:00'")).where("error is null")
    return made.select("day", F.explode("options").alias("o")).select("day", F.col("o.id").cast("bigint").alias("id"), "o.text")


@query(
    """select poll_id, count(distinct worker_id) filter (worker_id <> '') as workers_seen, count(distinct worker_id) filter (done and worker_id <> '') as workers_done
    from (select * replace (case when seq % 5 < 4 then '' else worker_id end as worker_id) from m) group by 1""",
    _VOTES, _MESSAGES,
)
def workers_without_name(spark, sf_dir):
    return workers(messages(spark, sf_dir).withColumn("worker_id", F.when(F.col("seq") % 5 < 4, "").otherwise(F.col("worker_id"))))


@query(
    """select fingerprint as key, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(fingerprint, ''), lambda c: ascii(c)::bigint)), lambda h, b: xor(h, b) * 16777619 % 4294967296) % 64 as shard
    from (select distinct fingerprint from v)""",
    _VOTES,
)
def shard_of_voters(spark, sf_dir):
    return votes(spark, sf_dir).select(F.col("fingerprint").alias("key")).distinct().withColumn("shard", shard(F.col("key"), 64))


_ANSWERED = """z as (
  select seq, poll_id, case when substr(poll_id, 9, 2)::int % 7 = 0 then 503 when id is null then 404 when option_id not in (1, 2, 3) then 400
    when ts >= ends_at or substr(poll_id, 9, 2)::int % 5 = 0 then 403 else 202 end as status
  from v left join (select * from polls where substr(id, 9, 2)::int % 6 <> 0) on id = poll_id
)"""


@query("select seq, status from z", _VOTES, _ANSWERED)
def vote_answers(spark, sf_dir):
    """Every seventh day's look-up fails, every sixth day's poll isn't there, every fifth day's is closed before its end."""
    day = lambda c: F.substring(c, 9, 2).cast("int")
    v, p = votes(spark, sf_dir), polls(spark, sf_dir)
    ids = v.select("poll_id").distinct()
    return admit(v, p.where(day("id") % 6 != 0), ids.where(day("poll_id") % 7 == 0), ids.where(day("poll_id") % 5 == 0)).select("seq", "status")


@query("select seq, true as holds, 36 as length from v", _VOTES)
def issued_cookies(spark, sf_dir):
    """Fresh cookies hold for their poll and carry a UUID."""
    v = votes(spark, sf_dir).withColumn("cookie", identity.issue(SECRET, F.col("poll_id")))
    raw = identity.verify(SECRET, F.col("poll_id"), F.col("cookie"))
    shape = raw.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return v.select("seq", F.coalesce(shape, F.lit(False)).alias("holds"), F.length(raw).alias("length"))


@query("select id, len([1, 2, 3]) as options, strftime(ends_at, '%Y-%m-%d %H:%M') as ends_at from polls", _VOTES)
def created_polls(spark, sf_dir):
    """Polls written to the table of polls in two parts and read again."""
    folder, made = working_folder(spark, "polls"), polls(spark, sf_dir)
    odd = F.substring("id", 9, 2).cast("int") % 2 == 1
    for part in (made.where(odd), made.where(~odd)):
        create_poll(part, folder)
    return spark.read.schema(made.schema).parquet(folder).select("id", F.size("options").cast("bigint").alias("options"), F.date_format("ends_at", "yyyy-MM-dd HH:mm").alias("ends_at"))


@query("select * from t", _VOTES, _TALLY)
def json_sink_tally(spark, sf_dir):
    """Votes written as messages of JSON with offsets by partition, in two parts, read back and counted."""
    folder, v = working_folder(spark, "votes"), votes(spark, sf_dir)
    half = v.agg(F.percentile_approx("seq", 0.5)).first()[0]
    for part in (v.where(F.col("seq") <= half), v.where(F.col("seq") > half)):
        one = part.select("seq", "poll_id", "worker_id", F.lit(False).alias("done"), F.array(F.struct("fingerprint", "option_id")).alias("votes"))
        write_json_folder(one, folder, order="seq")
    return tally(votes_of(decode(read_json_folder(spark, folder)))).withColumnRenamed("count", "votes")


@query("select count(*) filter (seq % 97 > 0) as produced, count(*) filter (seq % 97 = 0) as failed, count(*) filter (seq % 97 > 0) as votes from v", _VOTES)
def produced_failed(spark, sf_dir):
    """Messages counted on their way to the sink; every 97th is spoiled."""
    v = votes(spark, sf_dir)
    one = v.select("seq", "poll_id", "worker_id", F.lit(False).alias("done"), F.array(F.struct("fingerprint", "option_id")).alias("votes"))
    sent = one.select(F.when(F.col("seq") % 97 == 0, F.lit(b"{")).otherwise(encode_value()).alias("value"))
    seen = Observation("sent")
    observed(decode(sent), seen).write.parquet(working_folder(spark, "sent"))
    return counts_of(spark, seen)


def _ledger_batches(spark, sf_dir, parts):
    """Events as messages in so many micro-batches, by their numbers."""
    v = votes(spark, sf_dir)
    last = v.agg(F.max("seq")).first()[0] or 0
    sent = v.select("seq", F.lit(0).alias("partition"), F.col("seq").alias("offset"), F.struct("poll_id", "worker_id", F.lit(False).alias("done"), F.array(F.struct("fingerprint", "option_id")).alias("votes")).alias("m"))
    sent = sent.select("seq", "partition", "offset", F.to_json("m").cast("binary").alias("value"))
    step = last // parts + 1
    return [sent.where(F.col("seq").between(i * step, i * step + step - 1)).drop("seq") for i in range(parts)]


def _known(spark, sf_dir):
    return polls(spark, sf_dir).withColumn("ends_at", F.col("ends_at").cast("timestamp"))


@query("select poll_id, option_id, votes, sum(votes) over (partition by poll_id)::bigint as total, 3 as workers_seen, 'hard_timeout' as reason from t", _VOTES, _TALLY)
def ledger_replay(spark, sf_dir):
    """Events as a stream of five micro-batches through the ledger, compacted on the way; all polls end by timeout."""
    ledger = Ledger(spark, working_folder(spark, "ledger"), _known(spark, sf_dir), Config(hard_timeout=60.0), compact_every=2)
    start = datetime(2000, 1, 1)
    for i, batch in enumerate(_ledger_batches(spark, sf_dir, 5)):
        ledger.on_batch(lambda: start)(batch, i)
    ledger.settle(datetime(2100, 1, 1))
    return ledger.finals().select("poll_id", "option_id", F.col("count").alias("votes"), "total", F.col("workers_seen").cast("int"), "reason")


@query(
    """select poll_id, case when in_a then 'written' end as first, case when not in_b then null when in_a then 'already_completed' else 'written' end as second
    from (select poll_id, bool_or(seq < half) as in_a, bool_or(seq >= half) as in_b from v, (select max(seq) // 2 + 1 as half from v) group by 1)""",
    _VOTES,
)
def settled_by_two(spark, sf_dir):
    """Two consumers have half of the events each and settle into one table: what each is told about its polls."""
    shared, told = working_folder(spark, "finals"), []
    for i, batch in enumerate(_ledger_batches(spark, sf_dir, 2)):
        ledger = Ledger(spark, working_folder(spark, f"consumer{i}"), _known(spark, sf_dir), Config(hard_timeout=60.0), finals=shared)
        ledger.append(batch, 0, datetime(2000, 1, 1))
        told.append(ledger.settle(datetime(2100, 1, 1)).withColumnRenamed("outcome", ("first", "second")[i]))
    return told[0].join(told[1], "poll_id", "full")


def _as_stream(spark, sf_dir, ends):
    """Events as a stream of votes, each a message; ``ends`` gives the milliseconds at which their poll ends."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # as a pattern, as the name may be a file or a folder
    raw = spark.readStream.schema(events(spark, sf_dir).schema).parquet(f"{sf_dir}/events.parque[t]")
    return votes_of_events(raw).withColumn("ends_ms", ends)


def _with_last_words(v, spark, sf_dir):
    """``v`` with done; the few last words are written first, so that a stream's plan knows that they are few."""
    folder = working_folder(spark, "last")
    messages(spark, sf_dir).where("done").select("seq", "done").write.parquet(folder)
    return v.join(spark.read.schema("seq long, done boolean").parquet(folder), "seq", "left").withColumn("done", F.coalesce("done", F.lit(False)))


def _end_of_day(now):
    """Milliseconds of a poll's end, moved so that ``now`` is the present."""
    end = F.unix_millis((F.to_date("poll_id").cast("timestamp_ntz") + F.expr("interval 20 hours")).cast("timestamp"))
    return end + F.lit(int(time.time() * 1000) - int(now.replace(tzinfo=timezone.utc).timestamp() * 1000))


def _run(stream, folder, wait=0, until=None):
    """What a stream leaves once it has read all there is, or for as long as ``until`` isn't there; and its checkpoint."""
    # batches without data, which make timers run, would never end what is to end once all is read
    stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(until is not None).lower())
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check")
    query = writer.trigger(**({"processingTime": "500 milliseconds"} if until else {"availableNow": True})).start()
    try:
        if until is None:
            query.awaitTermination()
        else:
            end = time.time() + wait
            while time.time() < end and query.isActive and not until():
                time.sleep(0.5)
    finally:
        query.stop()
    return f"{folder}/out", f"{folder}/check"


@query("select poll_id, workers_seen, workers_done, reason from r where reason is not null", _VOTES, _MESSAGES, _WORKERS, _STALE, _REASON)
def keyed_state_reasons(spark, sf_dir):
    """Events through keyed state, each a message: why polls end, silence among the reasons."""
    v = _as_stream(spark, sf_dir, _end_of_day(datetime(2024, 1, 15, 20, 0, 10)))
    v = _with_last_words(v, spark, sf_dir)
    told = v.select(F.lit("c").alias("consumer"), "poll_id", "seq", "ends_ms")
    config = Config(stale_messages=300, hard_timeout=864000.0)
    out, _ = _run(final_results(v, config, told), working_folder(spark, "keyed"))
    found = spark.read.schema(OUTPUT).parquet(out).where("reason <> 'late'")
    return found.select("poll_id", "workers_seen", "workers_done", "reason").distinct()


@query("select poll_id, total, workers_seen, workers_done from w join (select poll_id, sum(votes)::bigint as total from t group by 1) using (poll_id)", _VOTES, _TALLY, _MESSAGES, _WORKERS)
def state_of_open_polls(spark, sf_dir):
    """Polls that are still open, as a reader finds them in the state of a stream that has stopped."""
    v = _as_stream(spark, sf_dir, F.unix_millis(F.current_timestamp()) + F.lit(86_400_000))
    v = _with_last_words(v, spark, sf_dir)
    _, checkpoint = _run(final_results(v, Config()), working_folder(spark, "open"))
    return open_polls(spark, checkpoint)


@query(
    """select poll_id, worker_id, batch, false as done, string_agg(fingerprint || ':' || option_id, ',' order by seq) as votes from b group by 1, 2, 3
    union all select poll_id, worker_id, max(batch) + 1, true, '' from b group by 1, 2""",
    _VOTES, "b as (select *, (row_number() over (partition by poll_id, worker_id order by seq) - 1) // 10 as batch from v)",
)
def streamed_batches(spark, sf_dir):
    """Batches of ten of a stream of votes; timers close the polls a while after their votes were read."""
    groups = votes(spark, sf_dir).select("poll_id", "worker_id").distinct().count()
    v = _as_stream(spark, sf_dir, F.lit(int(time.time() * 1000) + 5_000))
    folder = working_folder(spark, "batches")
    read = lambda: spark.read.schema(BATCHES).parquet(f"{folder}/out")
    ended = lambda: exists(spark, f"{folder}/out/_spark_metadata") and read().where("done").count() == groups
    _run(batches(v, 10), folder, 300, ended)
    text = F.array_join(F.transform("votes", lambda x: F.concat(x["fingerprint"], F.lit(":"), x["option_id"].cast("string"))), ",")
    return read().select("poll_id", "worker_id", "batch", "done", text.alias("votes"))


@query("select count(*) filter (status = 202) as accepted, count(*) filter (status = 403) as forbidden, count(*) filter (status = 400) as bad, count(*) filter (status = 404) as unknown from a", _VOTES, _STATUS)
def scenario_totals(spark, sf_dir):
    return status_counts(admit(_requests(spark, sf_dir), polls(spark, sf_dir)))


@query("select count(*) as runs, min(rate) as lowest, median(rate) as median, max(rate) as highest from (select poll_id, sum(n / 64)::double as rate from (select poll_id, worker_id, count(*)::double as n from v group by 1, 2) group by 1)", _VOTES)
def rates_rolled_up(spark, sf_dir):
    """Days as runs, workers as clients of so many votes in 64 seconds."""
    clients = votes(spark, sf_dir).groupBy("poll_id", "worker_id").agg((F.count("*") / F.lit(64.0)).alias("rate"))
    return rolled_up(clients, "poll_id", "rate")
