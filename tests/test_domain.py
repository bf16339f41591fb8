import hashlib
import hmac
import json
import random
import time
from datetime import datetime, timedelta

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tallyhouse.config import Config, duration
from tallyhouse.functions import identity
from tallyhouse.operators.completion import completion, deadlines, stale_counts
from tallyhouse.operators.tally import tally
from tallyhouse.sources.messages import decode, votes_of
from tallyhouse.sources.polls import migrate
from tallyhouse.streaming.ledger import Ledger
from tallyhouse.streaming.stateful import final_results

NOW = datetime(2031, 2, 3, 4, 5)
POLL = "id string, options array<struct<id:int,text:string>>, ends_at timestamp"


def test_config_reads_durations_and_keeps_defaults():
    assert duration("1m30s") == 90 and duration("-5s") == -5 and duration("x") is None
    c = Config.from_env({"CLOSE_GRACE": "0s", "DONE_PERCENT": "75", "CLOSE_HARD_TIMEOUT": "soon"})
    assert (c.close_grace, c.done_percent, c.hard_timeout) == (1.0, 75, 300.0)


def test_cookies(spark):
    secret = b"k" * 100
    mac = hmac.new(secret, b"p\0a.b", hashlib.sha256).hexdigest()
    good = f"a.b.{mac}"
    # by rule: each part empty, the last sign changed, added or cut, a sign that isn't hexadecimal
    bad = [good[:-1] + ("1" if good[-1] == "0" else "0"), good + "0", good[:-2], good[:-1] + "z", f".{mac}", "a.b.", "a.b", "." * 3, " ", "", None]
    cases = [(good, "a.b"), (f"a.b.{mac.upper()}", "a.b"), *((c, None) for c in bad)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = {r.i: r.v for r in df.select("i", identity.verify(secret, F.lit("p"), F.col("c")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    assert df.select(identity.sign(secret, F.lit("p"), F.lit("a.b"))).first()[0] == f"a.b.{mac}"


@pytest.mark.parametrize(
    "forwarded,real,remote,want",
    [
        ("203.0.113.5 , 198.51.100.9", "192.0.2.44", "192.0.2.1:5000", "203.0.113.5"), (" ", "198.51.100.3", "192.0.2.1:5000", ""), ("", " 198.51.100.20 ", "192.0.2.1:5000", "198.51.100.20"), (None, "", "192.0.2.77:61000", "192.0.2.77"),
        (None, None, "[2001:db8::7]:443", "2001:db8::7"), (None, None, "unix", "unix"), (None, None, "2001:db8::9", "2001:db8::9"),
    ],
)
def test_client_address(spark, forwarded, real, remote, want):
    df = spark.createDataFrame([(forwarded, real, remote)], "f string, r string, a string")
    assert df.select(identity.client_ip(F.col("f"), F.col("r"), F.col("a"))).first()[0] == want


def test_first_vote_wins_in_any_order(spark):
    rows = [("p", "a", 1, "w", 5), ("p", "a", 2, "w", 3), ("p", "b", 1, "w", 9), ("q", "a", 4, "w", 1), ("p", "b", 2, "w", 10)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "poll_id string, fingerprint string, option_id long, worker_id string, seq long")
        assert sorted(map(tuple, tally(df).collect())) == [("p", 1, 1), ("p", 2, 1), ("q", 4, 1)]


def test_stale_modes(spark):
    df = spark.createDataFrame([("p1", 0), ("p2", 1), ("p2", 2), ("p1", 3), ("p2", 4)], "poll_id string, seq long")
    assert dict(map(tuple, stale_counts(df, "code").collect())) == {"p1": 3, "p2": 1}
    assert dict(map(tuple, stale_counts(df, "spec").collect())) == {"p1": 1, "p2": 0}


@pytest.mark.parametrize(
    "done,after,config,want",
    [(1, 90, Config(), None), (2, 90, Config(), None), (3, 90, Config(), "quorum"), (3, 59, Config(), None), (3, 60, Config(), None), (0, 361, Config(), "hard_timeout"), (0, 90, Config(stale_messages=2), "stale"), (2, 90, Config(done_percent=66), "quorum")],
)
def test_completion(spark, done, after, config, want):
    rows = [("p", f"w{i}", False, i) for i in range(3)] + [("p", f"w{i}", True, 3 + i) for i in range(done)]
    rows += [("other", "", False, len(rows) + i) for i in range(2)]
    m = spark.createDataFrame(rows, "poll_id string, worker_id string, done boolean, seq long")
    ends = spark.createDataFrame([("p", NOW + timedelta(seconds=60))], "poll_id string, ends_at timestamp")
    assert completion(m, ends, F.lit(NOW + timedelta(seconds=after)), config).first().reason == want


def test_unknown_poll_gets_a_deadline(spark):
    seen = spark.createDataFrame([("x", NOW)], "poll_id string, arrived timestamp")
    r = deadlines(seen, spark.createDataFrame([], POLL), Config()).first()
    assert r.ends_at == NOW + timedelta(seconds=300) and not r.known


def test_strict_decoding_rejects_numbers_for_texts(spark):
    df = spark.createDataFrame([(0, b'{"poll_id":5,"votes":[]}'), (1, b'{"poll_id":"p"}'), (2, None)], "offset long, value binary")
    assert [r.malformed for r in decode(df, strict=True).orderBy("offset").collect()] == [True, False, True]
    assert not decode(df).where("offset = 0").first().malformed
    assert votes_of(decode(df)).count() == 0


def test_migrations_run_twice(spark, tmp_path):
    (tmp_path / "002_b.sql").write_text("create or replace temporary view b as select * from polls;")
    (tmp_path / "001_a.sql").write_text("create table if not exists extra (x int) using parquet")
    first = migrate(spark, str(tmp_path))
    assert [p[-9:] for p in first] == ["001_a.sql", "002_b.sql"] and migrate(spark, str(tmp_path)) == first
    for t in ("extra", "polls", "poll_results"):
        spark.sql(f"drop table {t}")


def _message(poll, worker, votes=(), done=False):
    return json.dumps({"poll_id": poll, "worker_id": worker, "done": done, "votes": [{"fingerprint": f, "option_id": o} for f, o in votes]}).encode()


def test_ledger_settles_once(spark, tmp_path):
    polls = spark.createDataFrame([("p1", [(1, "a"), (2, "b")], NOW + timedelta(seconds=60)), ("p2", [(1, "a"), (2, "b")], NOW + timedelta(hours=1))], POLL)
    ledger = Ledger(spark, str(tmp_path / "ledger"), polls)
    batch = lambda rows: spark.createDataFrame([(0, o, v) for o, v in rows], "partition int, offset long, value binary")
    first = batch([(0, _message("p1", "w1", [("a", 1), ("b", 2)])), (1, b"{not json"), (2, _message("p2", "w1", [("a", 2)]))])
    ledger.append(first, 0, NOW)
    ledger.append(first, 0, NOW)  # a repeated batch
    assert ledger.settle_due(NOW + timedelta(seconds=90)) == 0
    ledger.append(batch([(3, _message("p1", "w1", [("a", 2), ("c", 1)])), (4, _message("p1", "w1", done=True))]), 1, NOW + timedelta(seconds=50))
    assert ledger.settle_due(NOW + timedelta(seconds=60)) == 0  # the grace isn't over
    assert ledger.settle_due(NOW + timedelta(seconds=90)) == 2
    ledger.append(batch([(5, _message("p1", "w1", [("late", 1)]))]), 2, NOW + timedelta(seconds=95))
    assert ledger.settle_due(NOW + timedelta(seconds=99)) == 0
    assert sorted((r.poll_id, r.option_id, r["count"], r.total, r.reason) for r in ledger.finals().collect()) == [("p1", 1, 2, 3, "quorum"), ("p1", 2, 1, 3, "quorum")]


@pytest.mark.parametrize("start", [0, 1000])
def test_ledger_counts_silence_over_gaps_and_partitions(spark, tmp_path, start):
    """A poll without a quorum ends once enough messages of others went by, whatever their offsets."""
    polls = spark.createDataFrame([("p1", [(1, "a")], NOW), ("p2", [(1, "a")], NOW + timedelta(days=9))], POLL)
    ledger = Ledger(spark, str(tmp_path / "ledger"), polls, Config(stale_messages=4))
    batch = lambda rows: spark.createDataFrame(rows, "partition int, offset long, value binary")
    other, gone = _message("p2", "w1", [("x", 1)]), _message("p9", "w1", [("x", 1)])
    ledger.append(batch([(0, start, _message("p1", "w1", [("a", 1)])), (0, start + 2, other), (0, start + 3, b"{"), (1, start, other)]), 0, NOW)
    assert ledger.settle_due(NOW + timedelta(seconds=60)) == 0
    ledger.append(batch([(0, start + 9, other), (1, start + 50, b"none"), (1, start + 70, gone)]), 1, NOW)
    assert ledger.settle_due(NOW + timedelta(seconds=60)) == 1
    assert ledger.settle_due(NOW + timedelta(seconds=61)) == 0
    assert [(r.poll_id, r["count"], r.reason) for r in ledger.finals().collect()] == [("p1", 1, "stale")]
    assert [tuple(r) for r in ledger.not_found().collect()] == [("p9", 1)]


def test_options_beyond_int_are_unknown(spark):
    from tallyhouse.operators.admission import admit

    polls = spark.createDataFrame([("p", [(1, "a")], NOW)], POLL)
    asked = spark.createDataFrame([("p", o, NOW - timedelta(seconds=1)) for o in (1, 2, 2**31, 2**62, -(2**40), None)], "poll_id string, option_id long, ts timestamp")
    assert sorted((str(r.option_id), r.status) for r in admit(asked, polls).collect()) == sorted((str(o), s) for o, s in ((1, 202), (2, 400), (2**31, 400), (2**62, 400), (-(2**40), 400), (None, 400)))


def test_ledger_as_a_stream(spark, tmp_path):
    import base64

    (tmp_path / "in").mkdir()
    row = {"topic": "votes", "partition": 0, "offset": 0, "value": base64.b64encode(_message("p1", "w1", [("a", 1)])).decode()}
    (tmp_path / "in/1.json").write_text(json.dumps(row))
    from tallyhouse.sources.messages import read_json_folder

    polls = spark.createDataFrame([("p1", [(1, "a")], NOW)], POLL)
    ledger = Ledger(spark, str(tmp_path / "ledger"), polls)
    for _ in range(2):  # a restart reads nothing again
        q = ledger.start(read_json_folder(spark, str(tmp_path / "in"), streaming=True), str(tmp_path / "check"), lambda: NOW + timedelta(hours=1), availableNow=True)
        q.awaitTermination(60)
    assert [(r["count"], r.reason) for r in ledger.finals().collect()] == [(1, "hard_timeout")]


def test_keyed_state_ends_a_poll_by_timer(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ends = int(time.time() * 1000) + 1000
    rows = [("p", "a", 1, "w1", False, 2), ("p", "a", 2, "w1", False, 1), ("p", None, 0, "w1", True, 3)]
    names = ["poll_id", "fingerprint", "option_id", "worker_id", "done", "seq"]
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(dict(zip(names, r)) | {"ends_ms": ends}) for r in rows))
    schema = "poll_id string, fingerprint string, option_id long, worker_id string, done boolean, seq long, ends_ms long"
    votes = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = final_results(votes, Config()).writeStream.format("memory").queryName("finals").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not (got := spark.table("finals").collect()):
            time.sleep(0.5)
    finally:
        q.stop()
    assert [tuple(r) for r in got] == [("p", 2, 1, 1, 1, 1, "quorum")]


def test_votes_of_a_message_count_in_its_order(spark):
    one = _message("p", "w", [("a", 2), ("b", 1), ("a", 1), ("b", 2)])
    df = spark.createDataFrame([(7, _message("p", "w", [("a", 3), ("c", 3)])), (5, one)], "offset long, value binary")
    v = votes_of(decode(df))
    assert [tuple(r) for r in v.orderBy("seq").select("fingerprint", "option_id").collect()] == [("a", 2), ("b", 1), ("a", 1), ("b", 2), ("a", 3), ("c", 3)]
    assert sorted(map(tuple, tally(v).collect())) == [("p", 1, 1), ("p", 2, 1), ("p", 3, 1)]


@pytest.mark.parametrize("grace,lost", [(1.0, 2), (5.0, 0)])
def test_a_worker_unknown_at_the_quorum_loses_its_votes(spark, grace, lost):
    """A worker whose first message comes after the grace doesn't count for the quorum; a longer grace waits for it."""
    at = lambda s: NOW + timedelta(seconds=s)
    rows = [("p", "w1", False, 0, at(-1), "a"), ("p", "w1", True, 1, at(0), None), ("p", "w2", False, 2, at(3), "b"), ("p", "w2", False, 3, at(3), "c"), ("p", "w2", True, 4, at(3), None)]
    m = spark.createDataFrame(rows, "poll_id string, worker_id string, done boolean, seq long, arrived timestamp, fingerprint string")
    ends = spark.createDataFrame([("p", NOW)], "poll_id string, ends_at timestamp")
    for now in range(0, 10):  # the first second at which the poll is final
        seen = m.where(F.col("arrived") <= F.lit(at(now)))
        if completion(seen, ends, F.lit(at(now)), Config(close_grace=grace)).first().reason == "quorum":
            break
    counted = tally(seen.where("fingerprint is not null").withColumn("option_id", F.lit(1)))
    assert 3 - counted.first()["count"] == lost


def test_a_stream_of_files_takes_as_many_as_it_is_told(spark, tmp_path):
    import base64

    from tallyhouse.sources.messages import read_json_folder

    (tmp_path / "in").mkdir()
    for i in range(3):
        row = {"topic": "votes", "partition": 0, "offset": i, "value": base64.b64encode(_message("p1", "w1", [(f"v{i}", 1)])).decode()}
        (tmp_path / f"in/{i}.json").write_text(json.dumps(row))
    sizes = []
    q = read_json_folder(spark, str(tmp_path / "in"), streaming=True, per_trigger=1).writeStream.foreachBatch(lambda df, i: sizes.append(df.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60) and sizes == [1, 1, 1]


def test_bodies_are_made_once_and_long_ones_not_read(spark):
    """A body is one column of the plan, however often it is read; one at the limit counts, one above it is bad."""
    from tallyhouse import catalog
    from tallyhouse.operators.admission import request_option
    from tallyhouse.sources.messages import MOST_BODY

    for name, part in (("request_bodies", '"Option_Id":'), ("vote_requests", '{"option_id":%d}')):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(part) == 1, name
    bodies = ['{"option_id":2}' + " " * (MOST_BODY - 15), '{"option_id":2}' + " " * (MOST_BODY - 14), '{"option_id":3}', "", None]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i long, b string").select("i", request_option(F.col("b")).alias("o"))
    assert [r.o for r in rows.orderBy("i").collect()] == [2, None, 3, None, None]
