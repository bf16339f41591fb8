import json
import threading
import time
from datetime import datetime, timedelta

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tallyhouse import catalog
from tallyhouse.config import Config
from tallyhouse.plans.tables import votes
from tallyhouse.sources import store
from tallyhouse.sources.messages import encode_value
from tallyhouse.streaming import ledger as module
from tallyhouse.streaming.ledger import Finals, Ledger

NOW = datetime(2031, 2, 3, 4, 5)
POLL = "id string, options array<struct<id:int,text:string>>, ends_at timestamp"


def message(poll, worker, marks=(), done=False):
    return json.dumps({"poll_id": poll, "worker_id": worker, "done": done, "votes": [{"fingerprint": f, "option_id": o} for f, o in marks]}).encode()


def batch_of(spark, rows):
    return spark.createDataFrame([(0, o, v) for o, v in rows], "partition int, offset long, value binary")


def polls_of(spark, **ends):
    return spark.createDataFrame([(k, [(1, "a"), (2, "b")], NOW + timedelta(seconds=s)) for k, s in ends.items()], POLL)


def counts(ledger):
    return sorted((r.poll_id, r.option_id, r["count"], r.total, r.reason) for r in ledger.finals().collect())


def test_a_file_is_made_once(spark, tmp_path):
    for base in (str(tmp_path), f"file:{tmp_path}/x", f"file://{tmp_path}/y"):
        assert store.create_if_absent(spark, f"{base}/deep/a.json", "first") and not store.create_if_absent(spark, f"{base}/deep/a.json", "second")
        assert store.read_text(spark, f"{base}/deep/a.json") == "first" and store.names(spark, f"{base}/deep") == ["a.json"]
    won = []
    tries = [threading.Thread(target=lambda i=i: won.append(i) if store.create_if_absent(spark, f"{tmp_path}/race", str(i)) else None) for i in range(8)]
    for t in tries:
        t.start()
    for t in tries:
        t.join()
    assert len(won) == 1 and store.read_text(spark, f"{tmp_path}/race") == str(won[0])


def test_triggers_read_open_polls_and_the_new_batch_only(spark, tmp_path):
    """Forty batches of one closed poll leave nothing to read again; files read don't grow with history."""
    polls = polls_of(spark, early=0, late=10**6)
    ledger = Ledger(spark, str(tmp_path / "l"), polls, Config(done_percent=100), compact_every=3)
    run = ledger.on_batch(lambda: NOW + timedelta(seconds=30))
    run(batch_of(spark, [(0, message("early", "w", [("a", 1), ("b", 2)])), (1, message("early", "w", done=True)), (2, message("late", "w", [("a", 1)]))]), 0)
    assert counts(ledger) == [("early", 1, 1, 2, "quorum"), ("early", 2, 1, 2, "quorum")]
    read = []
    for i in range(1, 10):
        run(batch_of(spark, [(10 * i, message("early", "w", [(f"v{i}", 1)])), (10 * i + 1, message("late", "w", [("a", 2), (f"n{i % 4}", 2)]))]), i)
        read.append((ledger.open_votes().count(), len(ledger.open_votes().inputFiles())))
    assert all(rows <= 5 + 2 * 2 for rows, _ in read), read  # 5 voters of the open poll, 2 rows a batch since the state
    assert max(files for _, files in read[4:]) <= max(files for _, files in read[:4])
    assert ledger.message_count() == 3 + 18 and counts(ledger)[0][3] == 2
    assert ledger.messages().count() == 21
    assert {r.fingerprint: r.option_id for r in ledger.open_votes().groupBy("fingerprint").agg(F.min_by("option_id", "seq").alias("option_id")).collect()}["a"] == 1


@pytest.mark.parametrize("at", ["state", "version"])
def test_a_crash_in_compaction_loses_nothing(spark, tmp_path, monkeypatch, at):
    polls = polls_of(spark, p=60)
    made = lambda: Ledger(spark, str(tmp_path / "l"), polls, compact_every=100)
    ledger = made()
    ledger.append(batch_of(spark, [(0, message("p", "w", [("a", 1)])), (1, b"bad")]), 0, NOW)
    ledger.append(batch_of(spark, [(2, message("p", "w", [("a", 2), ("b", 2)]))]), 1, NOW)

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        if at == "state":
            m.setattr(store.VersionLog, "publish", crash)  # the rows of the state are there, its version isn't
        else:
            m.setattr(module, "delete", crash)  # the version is there, what it replaces as well
        with pytest.raises(OSError):
            ledger.compact(NOW)
    again = made()
    again.append(batch_of(spark, [(2, message("p", "w", [("a", 2), ("b", 2)]))]), 1, NOW)  # the stream repeats its last batch
    assert again.message_count() == 2 and again.open_votes().groupBy("fingerprint").count().count() == 2
    again.compact(NOW)
    again.append(batch_of(spark, [(3, message("p", "w", [("b", 1), ("c", 1)])), (4, message("p", "w", done=True))]), 2, NOW)
    again.settle(NOW + timedelta(seconds=90))
    assert counts(again) == [("p", 1, 2, 3, "quorum"), ("p", 2, 1, 3, "quorum")]


def test_two_ledgers_settle_a_poll_once(spark, tmp_path, monkeypatch):
    """Consumers with partial views of one poll propose different counts; the first one stays, also if both have looked before either wrote."""
    polls = polls_of(spark, p=0, q=0)
    shared = str(tmp_path / "finals")
    a, b = (Ledger(spark, str(tmp_path / n), polls, finals=shared) for n in "ab")
    for ledger, marks in ((a, [("x", 1)]), (b, [("x", 1), ("y", 2)])):
        ledger.append(batch_of(spark, [(0, message("p", "w", marks)), (1, message("p", "w", done=True)), (2, message("none", "w", marks))]), 0, NOW)
    b.append(batch_of(spark, [(5, message("q", "w", [("z", 1)], True))]), 1, NOW)
    later = NOW + timedelta(hours=1)
    real, between = store.VersionLog.publish, []

    def publish(log, version, record):
        if not between:  # the other one gets in first
            between.append(1)
            told = {r.poll_id: r.outcome for r in b.settle(later).collect()}
            assert told == {"p": "written", "q": "written", "none": "not_found"}
        return real(log, version, record)

    monkeypatch.setattr(store.VersionLog, "publish", publish)
    assert {r.poll_id: r.outcome for r in a.settle(later).collect()} == {"p": "already_completed", "none": "not_found"}
    assert counts(a) == counts(b) == [("p", 1, 1, 2, "hard_timeout"), ("p", 2, 1, 2, "hard_timeout"), ("q", 1, 1, 1, "hard_timeout")]
    assert [tuple(r) for r in a.not_found().collect()] == [("none", 1)]
    assert a.settle(later).where("outcome = 'written'").isEmpty()


def test_folders_of_results_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "MOST_FOLDERS", 2)
    finals = Finals(spark, str(tmp_path))
    polls = polls_of(spark, **{f"p{i}": 0 for i in range(7)})
    for i in range(7):
        row = spark.createDataFrame([(f"p{i}", 1, i, i, 1, 1, "quorum")], module.FINAL)
        assert finals.settle(row, polls).first().outcome == "written" and finals.settle(row, polls).first().outcome == "already_completed"
    assert sorted(r["count"] for r in finals.read().collect()) == list(range(7)) and len(finals.log.latest()[1]["folders"]) <= 2
    assert len(store.names(spark, str(tmp_path))) <= 9 and len(store.names(spark, f"{tmp_path}/versions")) <= 4  # what was replaced has gone


def test_events_replayed_in_batches_equal_the_tally(spark, tmp_path):
    v = votes(spark, DATA)
    sent = v.select("seq", F.col("seq").alias("offset"), "poll_id", "worker_id", F.lit(False).alias("done"), F.array(F.struct("fingerprint", "option_id")).alias("votes"))
    sent = sent.select("seq", F.lit(0).alias("partition"), "offset", encode_value().alias("value")).cache()
    known = v.select(F.col("poll_id").alias("id")).distinct().withColumns({"options": F.lit(None).cast("array<struct<id:int,text:string>>"), "ends_at": F.lit(NOW)})
    ledger = Ledger(spark, str(tmp_path / "l"), known, compact_every=2)
    run = ledger.on_batch(lambda: NOW)
    for i in range(4):
        run(sent.where(F.col("seq") % 4 == (3 * i) % 4), i)  # not in the order of their numbers
    ledger.settle(NOW + timedelta(hours=1))
    want = {tuple(r) for r in catalog.QUERIES["tally_first_wins"](spark, DATA).select("poll_id", "option_id", "votes").collect()}
    assert {(r.poll_id, r.option_id, r["count"]) for r in ledger.finals().collect()} == want


def test_a_heartbeat_ends_silent_polls(spark, tmp_path):
    (tmp_path / "in").mkdir()
    import base64

    row = {"topic": "votes", "partition": 0, "offset": 0, "value": base64.b64encode(message("p", "w", [("a", 1)])).decode()}
    (tmp_path / "in/1.json").write_text(json.dumps(row))
    from tallyhouse.sources.messages import read_json_folder

    ledger, shift = Ledger(spark, str(tmp_path / "l"), polls_of(spark, p=0)), [0]
    stream = read_json_folder(spark, str(tmp_path / "in"), streaming=True)
    query = ledger.start(stream, str(tmp_path / "c"), lambda: NOW + timedelta(seconds=shift[0]), heartbeat=True, processingTime="1 second")
    try:
        until = time.time() + 90
        while time.time() < until and not ledger.message_count():
            time.sleep(1)
        assert ledger.finals().isEmpty()
        shift[0] = 10_000  # no message comes any more
        while time.time() < until and ledger.finals().isEmpty():
            time.sleep(1)
    finally:
        query.stop()
    assert counts(ledger) == [("p", 1, 1, 1, "hard_timeout")]


def test_results_are_waited_for(spark, tmp_path):
    finals, polls = Finals(spark, str(tmp_path)), polls_of(spark, p=0, q=0)
    row = lambda p: spark.createDataFrame([(p, 1, 1, 1, 1, 1, "quorum")], module.FINAL)
    finals.settle(row("p"), polls)
    assert [r.poll_id for r in finals.watch(polls, 0.1).collect()] == ["q"]
    late = threading.Timer(2, lambda: finals.settle(row("q"), polls))
    late.start()
    assert finals.watch(polls, 60).isEmpty()
    late.join()
