"""Streaming by keyed state, in stages that each see a part of a poll.

* ``FirstVotes``, keyed by poll and a bucket of fingerprints, holds who voted, and passes on counts: what a batch adds to
  each option, with corrections if an earlier vote of a voter comes later.  A poll with most of all votes is spread over its buckets.
* ``Ranges``, keyed by consumer and range of numbers, has no state and sums up the messages of a range by poll.
* ``Silence``, keyed by consumer, puts the ranges of a batch in order and tells polls when enough of others went by.
* ``Poll``, keyed by poll, adds up counts and workers, and ends the poll by quorum, silence or hard timeout; timers end it without input.
* ``Batcher``, keyed by poll and worker, makes batches of a fixed size, and at the end of the poll the rest and a last word.

State goes: ``Poll`` clears counts and workers when it settles and keeps a tombstone for a time, by which late votes are told; the
other stages drop what they hold once a poll must have ended and the time of the tombstone is over.
Needs ``spark.sql.streaming.stateStore.providerClass`` set to RocksDB's.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..config import Config

#: Results, one row for each option; late votes have the reason ``late`` and only their count.
OUTPUT = "poll_id string, option_id long, count long, total long, workers_seen long, workers_done long, reason string"
#: What the first stages tell of a poll: kind is vote (n more of an option), worker (seen, or done) or silence (n is 1 or 0).
NEWS = "poll_id string, kind string, option_id long, n long, worker_id string, done boolean, ends_ms long"
BATCHES = "poll_id string, worker_id string, batch long, done boolean, votes array<struct<fingerprint:string,option_id:long>>"
#: What a range of a consumer's messages holds of a poll: its first and last place in the range and how many it has; ``total`` counts all of the range.
SPANS = "consumer string, span long, total long, poll_id string, first long, last long, own long, ends_ms long"
#: Buckets of a poll's voters.
BUCKETS = 32
#: Parts of a bucket; a part's voters are read and written at once.
PARTS = 64
#: Numbers of a range of messages.
SPAN = 1 << 16
#: Milliseconds for which a settled poll is remembered.
KEEP_MS = 3_600_000


def _frame(rows: list, schema: str) -> pd.DataFrame:
    kinds = {"string": object, "boolean": object, "long": "Int64"}
    names, types = zip(*(c.split(" ", 1) for c in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pd.DataFrame({n: pd.array(c, dtype="Int64") if t == "long" else pd.Series(c, dtype=kinds.get(t, object)) for n, c, t in zip(names, columns, types)})


class FirstVotes(StatefulProcessor):
    """Voters of a bucket of a poll, each with the option and number of its earliest vote; held by parts, as each call of the state has its cost."""

    def __init__(self, config: Config, keep_ms: int):
        self.config, self.keep_ms = config, keep_ms

    def init(self, handle):
        self.handle = handle
        self.voted = handle.getMapState("voted", "part int", "fingerprints array<string>, options array<long>, seqs array<long>")
        self.ends = handle.getValueState("ends", "ends_ms long")

    def handleInputRows(self, key, rows, timerValues):
        poll, news, pdf = key[0], [], pd.concat(list(rows))
        ends = int(pdf["ends_ms"].iloc[0])
        if not self.ends.exists():
            self.ends.update((ends,))
            self.handle.registerTimer(ends + int(self.config.hard_timeout * 1000) + self.keep_ms)
        first = pdf[pdf["fingerprint"].notna()].sort_values("seq").drop_duplicates("fingerprint")
        added: dict[int, int] = {}
        known = self.voted.exists()
        parts = np.fromiter((crc32(f.encode()) % PARTS for f in first["fingerprint"]), np.int64, len(first))
        for part, votes in first.groupby(parts):
            at = (int(part),)
            held = self.voted.getValue(at) if known and self.voted.containsKey(at) else ([], [], [])
            voters = {f: (o, s) for f, o, s in zip(*held)}
            for voter, option, seq in zip(votes["fingerprint"], votes["option_id"], votes["seq"]):
                was = voters.get(voter)
                if was is not None and was[1] <= seq:
                    continue
                voters[voter] = (int(option), int(seq))
                added[int(option)] = added.get(int(option), 0) + 1
                if was is not None:
                    added[was[0]] = added.get(was[0], 0) - 1
            self.voted.updateValue(at, (list(voters), [o for o, _ in voters.values()], [s for _, s in voters.values()]))
        news += [(poll, "vote", o, n, None, None, ends) for o, n in sorted(added.items()) if n]
        named = pdf[pdf["worker_id"].fillna("") != ""].groupby("worker_id")["done"].any()
        news += [(poll, "worker", None, None, w, bool(d), ends) for w, d in named.items()]
        yield _frame(news, NEWS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.voted.clear()
        self.ends.clear()
        yield _frame([], NEWS)

    def close(self):
        pass


class Ranges(StatefulProcessor):
    """Sums up a batch's messages of a consumer and range of numbers; keeps nothing."""

    def init(self, handle):
        pass

    def handleInputRows(self, key, rows, timerValues):
        codes, names, ends, seqs = {}, [], [], []
        for pdf in rows:  # numbers and codes in place of texts, batch by batch
            for poll, end in zip(pdf["poll_id"], pdf["ends_ms"]):
                if poll not in codes:
                    codes[poll] = len(codes)
                    ends.append(int(end))
            names.append(pdf["poll_id"].map(codes).to_numpy(np.int32))
            seqs.append(pdf["seq"].to_numpy(np.int64))
        code = np.concatenate(names)[np.argsort(np.concatenate(seqs), kind="stable")]
        at = pd.DataFrame({"poll": code, "n": np.arange(len(code))}).groupby("poll")["n"].agg(["first", "last", "size"])
        polls = list(codes)
        yield _frame([(key[0], key[1], len(code), polls[c], int(f), int(l), int(n), ends[c]) for c, f, l, n in at.itertuples()], SPANS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield _frame([], SPANS)

    def close(self):
        pass


class Silence(StatefulProcessor):
    """Messages of a consumer, and of each of its polls the first, the last and how many they are."""

    def __init__(self, config: Config, keep_ms: int):
        self.config, self.keep_ms = config, keep_ms

    def init(self, handle):
        self.total = handle.getValueState("total", "n long")
        self.polls = handle.getMapState("polls", "poll_id string", "first long, last long, own long, ends_ms long, told boolean")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows))
        total = self.total.get()[0] if self.total.exists() else 0
        sizes = pdf.drop_duplicates("span").set_index("span")["total"].sort_index()
        start = pdf["span"].map(sizes.cumsum() - sizes) + total
        at = pd.DataFrame({"poll": pdf["poll_id"], "first": pdf["first"] + start, "last": pdf["last"] + start, "own": pdf["own"], "ends": pdf["ends_ms"]})
        total += int(sizes.sum())
        self.total.update((total,))
        for poll, new_first, new_last, more, end in at.groupby("poll").agg({"first": "min", "last": "max", "own": "sum", "ends": "first"}).itertuples():
            first, _, own, ends, told = self.polls.getValue((poll,)) if self.polls.containsKey((poll,)) else (int(new_first), 0, 0, int(end), False)
            self.polls.updateValue((poll,), (first, int(new_last), own + int(more), ends, told))
        now, news = timerValues.getCurrentProcessingTimeInMs(), []
        for (poll,), (first, last, own, ends, told) in list(self.polls.iterator()):
            if now > ends + int(self.config.hard_timeout * 1000) + self.keep_ms:
                self.polls.removeKey((poll,))
            silent = (total - 1 - first - (own - 1) if self.config.stale_mode == "code" else total - 1 - last) >= self.config.stale_messages
            if silent != told:
                if self.polls.containsKey((poll,)):
                    self.polls.updateValue((poll,), (first, last, own, ends, silent))
                news.append((poll, "silence", None, int(silent), None, None, ends))
        yield _frame(news, NEWS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield _frame([], NEWS)

    def close(self):
        pass


class Poll(StatefulProcessor):
    """Counts and workers of a poll; emits its result once, then what comes late."""

    def __init__(self, config: Config, keep_ms: int):
        self.config, self.keep_ms = config, keep_ms

    def init(self, handle):
        self.handle = handle
        self.counts = handle.getMapState("counts", "option_id long", "n long")
        self.workers = handle.getMapState("workers", "worker_id string", "done boolean")
        self.info = handle.getValueState("info", "ends_ms long, silent boolean")
        self.tombstone = handle.getValueState("tombstone", "reason string", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows))
        news = pdf[pdf["kind"] == "vote"]
        if self.tombstone.exists():
            late = int(news.loc[news["n"] > 0, "n"].sum())
            yield _frame([(key[0], None, late, None, None, None, "late")] if late else [], OUTPUT)
            return
        ends, silent = self.info.get() if self.info.exists() else (int(pdf["ends_ms"].iloc[0]), False)
        if not self.info.exists():
            for after in (self.config.close_grace, self.config.hard_timeout):
                self.handle.registerTimer(ends + int(after * 1000))
        for option, n in news.groupby("option_id")["n"].sum().items():
            held = self.counts.getValue((int(option),))[0] if self.counts.containsKey((int(option),)) else 0
            self.counts.updateValue((int(option),), (held + int(n),))
        for worker, done in pdf[pdf["kind"] == "worker"].groupby("worker_id")["done"].any().items():
            was = self.workers.containsKey((worker,)) and self.workers.getValue((worker,))[0]
            self.workers.updateValue((worker,), (bool(was or done),))
        told = pdf[pdf["kind"] == "silence"]
        if len(told):
            silent = bool(told["n"].iloc[-1])
        self.info.update((ends, silent))
        yield self._settled(key[0], timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.info.exists():
            yield self._settled(key[0], max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()))
        else:
            yield _frame([], OUTPUT)

    def _settled(self, poll: str, now: int) -> pd.DataFrame:
        ends, silent = self.info.get()
        done = [d for _, (d,) in self.workers.iterator()]
        enough = bool(done) and sum(done) >= max((len(done) * self.config.done_percent + 99) // 100, 1)
        reason = "hard_timeout" if now >= ends + self.config.hard_timeout * 1000 else "stale" if silent and not enough else "quorum" if enough else None
        if reason is None or now < ends + self.config.close_grace * 1000:
            return _frame([], OUTPUT)
        counts = sorted((o, n) for (o,), (n,) in self.counts.iterator() if n)
        total = sum(n for _, n in counts)
        for state in (self.counts, self.workers, self.info):
            state.clear()
        self.tombstone.update((reason,))
        return _frame([(poll, o, n, total, len(done), sum(done), reason) for o, n in counts or [(None, 0)]], OUTPUT)

    def close(self):
        pass


def final_results(votes: DataFrame, config: Config, messages: DataFrame | None = None, keep_ms: int = KEEP_MS, span: int = SPAN) -> DataFrame:
    """Results of a stream of votes: poll_id, fingerprint, option_id, worker_id, done, seq, ends_ms.

    Rows with a null fingerprint only tell of a worker.  ``messages`` (consumer, poll_id, seq, ends_ms), the same stream with a row for
    each well-formed message, is what silence is counted on; without it no poll ends by silence.  A poll without votes
    has one row without an option.  Messages are first summed up by ranges of ``span`` numbers, so that none of them are ordered in
    one task but those of a range; a stream whose numbers have gaps wants a wider one.
    """
    bucket = F.when(F.col("fingerprint").isNull(), 0).otherwise(F.pmod(F.xxhash64("fingerprint"), F.lit(BUCKETS))).cast("int")
    own = ["poll_id", "fingerprint", "option_id", "worker_id", "done", "seq", "ends_ms"]
    news = votes.select(*own, bucket.alias("bucket")).groupBy("poll_id", "bucket").transformWithStateInPandas(FirstVotes(config, keep_ms), NEWS, "append", "processingtime")
    if messages is not None:
        own = ["consumer", "poll_id", "seq", "ends_ms"]
        spans = messages.select(*own, F.floor(F.col("seq") / F.lit(span)).alias("span")).groupBy("consumer", "span").transformWithStateInPandas(Ranges(), SPANS, "append", "processingtime")
        silence = spans.groupBy("consumer").transformWithStateInPandas(Silence(config, keep_ms), NEWS, "append", "processingtime")
        news = news.unionByName(silence)
    return news.groupBy("poll_id").transformWithStateInPandas(Poll(config, keep_ms), OUTPUT, "append", "processingtime")


class Batcher(StatefulProcessor):
    """Votes of a poll and worker that wait for a full batch."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", "fingerprint string, option_id long")
        self.info = handle.getValueState("info", "batch long, ends_ms long, closed boolean")

    def _rows(self, key, batch: int, done: bool, votes: list) -> tuple:
        return (*key, batch, done, [{"fingerprint": f, "option_id": o} for f, o in votes])

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        batch, ends, closed = self.info.get() if self.info.exists() else (0, int(pdf["ends_ms"].iloc[0]), False)
        if closed:  # what comes after the last word is refused
            yield _frame([], BATCHES)
            return
        if not self.info.exists():
            self.handle.registerTimer(ends)
        waiting = [(f, int(o)) for f, o in self.waiting.get()] if self.waiting.exists() else []
        waiting += [(f, int(o)) for f, o in zip(pdf["fingerprint"], pdf["option_id"])]
        out = []
        while len(waiting) >= self.size:
            out.append(self._rows(key, batch, False, waiting[: self.size]))
            waiting, batch = waiting[self.size :], batch + 1
        self.waiting.clear()
        if waiting:
            self.waiting.put(waiting)
        self.info.update((batch, ends, False))
        yield _frame(out, BATCHES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        batch, ends, closed = self.info.get()
        out = []
        if not closed:
            if self.waiting.exists():
                out.append(self._rows(key, batch, False, [(f, int(o)) for f, o in self.waiting.get()]))
                batch += 1
            out.append(self._rows(key, batch, True, []))
            self.waiting.clear()
            self.info.update((batch, ends, True))
        yield _frame(out, BATCHES)

    def close(self):
        pass


def batches(votes: DataFrame, size: int) -> DataFrame:
    """Batches of a stream of admitted votes (poll_id, worker_id, fingerprint, option_id, seq, ends_ms), as ``pack`` makes them of a table."""
    own = votes.select("poll_id", "worker_id", "fingerprint", "option_id", "seq", "ends_ms")
    return own.groupBy("poll_id", "worker_id").transformWithStateInPandas(Batcher(size), BATCHES, "append", "processingtime")


def state_rows(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A state variable of a query out of its checkpoint, as its last batch left it."""
    found = None
    for r in spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorProperties").distinct().collect():
        if f'"{variable}"' in (r.operatorProperties or "").replace("\\", ""):
            found = r.operatorId
    if found is None:
        raise ValueError(f"no state called {variable} in {checkpoint}")
    return spark.read.format("statestore").option("path", checkpoint).option("operatorId", found).option("stateVarName", variable).load()


def open_polls(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(poll_id, total, workers_seen, workers_done) of polls that haven't ended, read from the state of a running or stopped query."""
    counts = state_rows(spark, checkpoint, "counts").groupBy(F.col("key.poll_id").alias("poll_id")).agg(F.sum("user_map_value.n").alias("total"))
    done = F.col("user_map_value.done")
    shown = state_rows(spark, checkpoint, "workers").groupBy(F.col("key.poll_id").alias("poll_id")).agg(F.count("*").alias("workers_seen"), F.count_if(done).alias("workers_done"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts.join(shown, "poll_id", "full").select("poll_id", zero("total"), zero("workers_seen"), zero("workers_done"))
