import json
import random
import time

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tallyhouse.config import Config
from tallyhouse.streaming.metrics import CounterListener, observed
from tallyhouse.streaming.stateful import BATCHES, OUTPUT, batches, final_results, open_polls, state_rows

VOTE = "poll_id string, fingerprint string, option_id long, worker_id string, done boolean, seq long, ends_ms long"
SENT = "consumer string, poll_id string, seq long, ends_ms long"
NAMES = [c.split()[0] for c in VOTE.split(", ")]


class Feed:
    """A folder of JSON files read as a stream, and what a query over it leaves."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        (root / "in").mkdir()
        self.files = 0

    def add(self, rows, ends):
        text = "\n".join(json.dumps(dict(zip(NAMES, r)) | {"ends_ms": ends}) for r in rows)
        (self.root / f"in.tmp{self.files}").write_text(text)
        (self.root / f"in.tmp{self.files}").rename(self.root / f"in/{self.files}.json")
        self.files += 1

    def stream(self):
        return self.spark.readStream.schema(VOTE).json(str(self.root / "in"))

    def run(self, stream, schema=OUTPUT):
        """All there is, as one batch after another; the same checkpoint each time."""
        self.spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else it doesn't end
        q = stream.writeStream.format("parquet").option("path", str(self.root / "out")).option("checkpointLocation", str(self.root / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        self.spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
        return self.spark.read.schema(schema).parquet(str(self.root / "out")).collect()


def test_corrections_of_earlier_votes_and_late_ones(spark, tmp_path):
    """A later batch brings an earlier vote; after the end votes are told as late and the result stays."""
    feed, ends = Feed(spark, tmp_path), int(time.time() * 1000) + 3_600_000
    results = final_results(feed.stream(), Config())
    feed.add([("p", f"v{i}", 1, "w", False, 100 + i) for i in range(200)] + [("p", "v0", 2, "w", False, 1000)], ends)
    assert feed.run(results) == []
    open_ = open_polls(spark, str(tmp_path / "c")).collect()
    assert [tuple(r) for r in open_] == [("p", 200, 1, 0)]
    feed.add([("p", f"v{i}", 2, "w2", False, i) for i in range(50)] + [("p", None, None, "w", True, 5000), ("p", None, None, "w2", True, 5001)], ends)
    assert feed.run(results) == []
    counts = {r.key.option_id if "option_id" in r.key else r.user_map_key.option_id: r.user_map_value.n for r in state_rows(spark, str(tmp_path / "c"), "counts").collect()}
    assert counts == {1: 150, 2: 50}


def test_results_by_quorum_then_late_votes_then_nothing_left(spark, tmp_path):
    feed, past = Feed(spark, tmp_path), int(time.time() * 1000) - 60_000
    results = final_results(feed.stream(), Config(), keep_ms=1)
    feed.add([("p", "a", 1, "w", False, 2), ("p", "a", 2, "w", False, 1), ("p", "b", 1, "w", False, 3), ("p", None, None, "w", True, 4), ("q", None, None, "", False, 1)], past)
    got = feed.run(results)
    assert sorted(tuple(r) for r in got) == [("p", 1, 1, 2, 1, 1, "quorum"), ("p", 2, 1, 2, 1, 1, "quorum")]
    assert state_rows(spark, str(tmp_path / "c"), "info").where("key.poll_id = 'p'").isEmpty() and state_rows(spark, str(tmp_path / "c"), "counts").isEmpty() and state_rows(spark, str(tmp_path / "c"), "workers").isEmpty()


def test_late_votes_are_told_and_change_nothing(spark, tmp_path):
    feed, past = Feed(spark, tmp_path), int(time.time() * 1000) - 60_000
    results = final_results(feed.stream(), Config(hard_timeout=30.0))
    feed.add([("p", "a", 1, "w", False, 1)], past)
    assert [tuple(r) for r in feed.run(results)] == [("p", 1, 1, 1, 1, 0, "hard_timeout")]
    feed.add([("p", "b", 2, "w", False, 2), ("p", "c", 2, "w", False, 3), ("p", "a", 2, "w", False, 4)], past)
    assert sorted(tuple(r) for r in feed.run(results) if r.reason == "late") == [("p", None, 2, None, None, None, "late")]
    assert len(feed.run(results)) == 2


def test_the_tombstone_goes(spark, tmp_path):
    """With a short time to be remembered a settled poll leaves no row of state at all."""
    feed, past = Feed(spark, tmp_path), int(time.time() * 1000) - 60_000
    results = final_results(feed.stream(), Config(hard_timeout=30.0), keep_ms=1_000)
    feed.add([("p", "a", 1, "w", False, 1)], past)
    feed.run(results)
    time.sleep(2)
    feed.add([("other", "a", 1, "w", False, 1)], past + 3_600_000)  # a batch in which what is over goes
    feed.run(results)
    for name in ("info", "counts", "workers", "tombstone"):
        assert state_rows(spark, str(tmp_path / "c"), name).where("key.poll_id = 'p'").isEmpty(), name
    assert state_rows(spark, str(tmp_path / "c"), "voted").where("key.poll_id = 'p'").isEmpty()


@pytest.mark.parametrize("mode,want", [("code", "stale"), ("spec", None)])
def test_silence_ends_a_poll(spark, tmp_path, mode, want):
    """p has a message first and one at the end; five of others lie between: all count, or only those after its last."""
    feed, past = Feed(spark, tmp_path), int(time.time() * 1000) - 60_000
    rows = [("p", "a", 1, "w", False, 0)] + [("q", f"v{i}", 1, "w", False, 1 + i) for i in range(5)] + [("p", "b", 1, "w", False, 9)]
    feed.add(rows, past)
    sent = feed.stream().select(F.lit("c").alias("consumer"), "poll_id", "seq", "ends_ms")
    got = {r.poll_id: r.reason for r in feed.run(final_results(feed.stream(), Config(stale_messages=5, stale_mode=mode), sent))}
    assert got.get("p") == want and "q" not in got
    if want is None:  # enough come later
        feed.add([("q", f"x{i}", 1, "w", False, 20 + i) for i in range(5)], past)
        got = {r.poll_id: (r.reason, r.total) for r in feed.run(final_results(feed.stream(), Config(stale_messages=5, stale_mode=mode), sent))}
        assert got.get("p") == ("stale", 2)


def test_batches_over_restarts(spark, tmp_path):
    """Votes that wait for a full batch are still there after a restart; the rest and the last word come at the end, and nothing after."""
    feed, ends = Feed(spark, tmp_path), int(time.time() * 1000) + 25_000
    made = batches(feed.stream(), 4)
    feed.add([("p", f"v{i}", 1, "w", False, i) for i in random.Random(1).sample(range(6), 6)], ends)
    assert [(r.batch, r.done, [v.fingerprint for v in r.votes]) for r in feed.run(made, BATCHES)] == [(0, False, ["v0", "v1", "v2", "v3"])]
    feed.add([("p", f"v{i}", 1, "w", False, i) for i in range(6, 11)], ends)
    feed.run(made, BATCHES)
    time.sleep(max(0, ends / 1000 - time.time()) + 1)
    feed.add([("r", "z", 1, "w", False, 1)], ends + 10**9)
    feed.run(made, BATCHES)
    feed.add([("p", "late", 1, "w", False, 99), ("r", "z2", 1, "w", False, 2)], ends)
    got = sorted((r.batch, r.done, [v.fingerprint for v in r.votes]) for r in feed.run(made, BATCHES) if r.poll_id == "p")
    assert got == [(0, False, ["v0", "v1", "v2", "v3"]), (1, False, ["v4", "v5", "v6", "v7"]), (2, False, ["v8", "v9", "v10"]), (3, True, [])]


def test_a_listener_keeps_counters(spark, tmp_path):
    listener = CounterListener(spark, str(tmp_path / "counters"))
    rows = spark.readStream.schema(spark.read.parquet(f"{DATA}/events.parquet").schema).parquet(f"{DATA}/events.parque[t]")
    decoded = rows.select((F.col("event_id") % 10 == 0).alias("malformed"), F.array(F.lit(1), F.lit(2)).alias("votes"))
    spark.streams.addListener(listener)
    try:
        q = observed(decoded).writeStream.format("noop").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        until = time.time() + 30
        while time.time() < until and listener.rows().isEmpty():
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    n = spark.read.parquet(f"{DATA}/events.parquet").count()
    bad = spark.read.parquet(f"{DATA}/events.parquet").where("event_id % 10 = 0").count()
    got = listener.rows().agg(F.sum("rows"), F.sum("produced"), F.sum("failed"), F.sum("votes")).first()
    assert tuple(got) == (n, n - bad, bad, 2 * (n - bad)) and listener.rows().first().query == "counted"


def test_silence_reads_sums_of_ranges_not_messages(spark, tmp_path, monkeypatch):
    """All messages of a consumer come to one task only as a row for each range and poll."""
    from tallyhouse.streaming import stateful

    base = stateful.Silence

    class Watched(base):
        def handleInputRows(self, key, rows, timerValues):
            rows = list(rows)
            assert sum(map(len, rows)) < 100, "too many rows for one task"
            yield from base.handleInputRows(self, key, rows, timerValues)

    monkeypatch.setattr(stateful, "Silence", Watched)
    feed, past = Feed(spark, tmp_path), int(time.time() * 1000) - 60_000
    feed.add([("p" if i == 0 else f"q{i % 5}", f"v{i}", 1, "w", False, i) for i in range(3000)], past)
    sent = feed.stream().select(F.lit("c").alias("consumer"), "poll_id", "seq", "ends_ms")
    got = {r.poll_id: r.reason for r in feed.run(final_results(feed.stream(), Config(stale_messages=2990), sent))}
    assert got == {"p": "stale"}


@pytest.mark.parametrize("mode", ["code", "spec"])
def test_silence_over_many_ranges_and_batches(spark, tmp_path, mode):
    """Numbers far apart, so that a range holds about three messages, in two batches in any order: the polls that a count by hand finds."""
    feed, past, rng = Feed(spark, tmp_path), int(time.time() * 1000) - 60_000, random.Random(4)
    polls = [rng.choice("abcdefgh" if i < 60 else "abc") for i in range(120)]
    results = lambda: final_results(feed.stream(), Config(stale_messages=60, stale_mode=mode), feed.stream().select(F.lit("c").alias("consumer"), "poll_id", "seq", "ends_ms"))
    for part in (range(40), range(40, 120)):
        feed.add([(polls[i], f"v{i}", 1, "w", False, i * 20_000 - 700_000) for i in rng.sample(part, len(part))], past)
        got = feed.run(results())
    places = {p: [i for i, x in enumerate(polls) if x == p] for p in set(polls)}
    silent = {p for p, at in places.items() if (119 - at[0] - (len(at) - 1) if mode == "code" else 119 - at[-1]) >= 60}
    assert silent and {r.poll_id for r in got if r.reason == "stale"} == silent


def test_voters_are_held_in_parts(spark, tmp_path):
    """State has no row for each voter, and holds for each one the earliest vote over batches."""
    feed, ends = Feed(spark, tmp_path), int(time.time() * 1000) + 3_600_000
    results = final_results(feed.stream(), Config())
    feed.add([("p", f"v{i}", 1, "w", False, 10_000 + i) for i in range(5000)], ends)
    feed.run(results)
    assert state_rows(spark, str(tmp_path / "c"), "voted").count() <= 32 * 64
    feed.add([("p", f"v{i}", 2, "w", False, i if i % 2 else 20_000 + i) for i in range(4900, 5100)], ends)
    feed.run(results)
    counts = {r.key.option_id if "option_id" in r.key else r.user_map_key.option_id: r.user_map_value.n for r in state_rows(spark, str(tmp_path / "c"), "counts").collect()}
    assert counts == {1: 4950, 2: 150}
