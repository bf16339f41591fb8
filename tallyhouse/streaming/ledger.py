"""Streaming by a ledger of partial results, one micro-batch at a time.

A micro-batch leaves its own first votes (one row for each poll and voter), what it shows of workers, and how
many messages it held.  A trigger reads the last compacted state of open polls and the batches since;
history isn't read again.  Every ``compact_every`` batches the state is written anew without settled polls.

Everything is written before it counts: a batch counts by the name of a file made last, a state by the
newest version of a log, a result by the newest version of another.  What a crash leaves without such
a file is never read.  Results are settled by compare and swap: a version of the log can be
published once, and a writer that comes second looks again which polls are still open.  So
several ledgers may settle into one folder, and each poll has one result.

A batch without input doesn't call ``on_batch``; a heartbeat, a stream of its own united with the messages, makes
batches at an interval, so that polls end without new messages.
"""

from __future__ import annotations

import time
import uuid
from datetime import datetime
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.completion import deadlines, judge, numbered, silence
from ..operators.settle import new_finals, outcomes
from ..operators.tally import first_votes, tally, workers
from ..schemas import BATCH, FINAL
from ..sources.messages import decode, votes_of
from ..sources.store import VersionLog, create_if_absent, delete, exists, names, read_parquet

_LEDGER = f"partition int, offset bigint, {BATCH}, malformed boolean, arrived timestamp, batch_id bigint"
_VOTES = "poll_id string, fingerprint string, option_id bigint, seq bigint"
_WORKERS = "poll_id string, worker_id string, done boolean, own bigint, first bigint, last bigint, arrived timestamp"
_TOLD = "poll_id string, outcome string"
#: Folders of results that are read apart, at most; then they are put together.
MOST_FOLDERS = 16


class Finals:
    """Results of polls in a folder that several writers share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log, self._told = spark, folder, VersionLog(spark, f"{folder}/versions"), ""

    def read(self, folders: list[str] | None = None) -> DataFrame:
        live = self.log.latest()[1].get("folders", []) if folders is None else folders
        return read_parquet(self.spark, FINAL, [f"{self.folder}/{f}" for f in live])

    def waiting(self, polls: DataFrame) -> DataFrame:
        """Ids of ``polls`` that have no result yet."""
        return polls.select(F.col("id").alias("poll_id")).distinct().join(self.read().select("poll_id"), "poll_id", "left_anti")

    def watch(self, polls: DataFrame, seconds: float, every: float = 0.5) -> DataFrame:
        """Waits until all of ``polls`` have results, or for so many seconds; those still without one.

        Only the newest version's number is asked for while nothing is published.
        """
        until, seen = time.monotonic() + seconds, -1
        while True:
            version = self.log.latest()[0]
            if version != seen and self.waiting(polls).isEmpty() or time.monotonic() >= until:
                return self.waiting(polls)
            seen = version
            time.sleep(every)

    def _write(self, rows: DataFrame) -> str:
        name = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def settle(self, rows: DataFrame, polls: DataFrame) -> DataFrame:
        """Publishes the rows of polls without a result; (poll_id, outcome): written, already_completed or not_found.

        ``rows`` are results as they would be; those of polls that don't exist are never written.  What it returns can be
        read until this object settles again.
        """
        base = f"{self.folder}/{self._write(rows)}"
        proposed = read_parquet(self.spark, FINAL, [base])
        if proposed.isEmpty():
            delete(self.spark, base)
            return self.spark.createDataFrame([], _TOLD)
        wanted = proposed.join(polls.select(F.col("id").alias("poll_id")).distinct(), "poll_id", "left_semi")
        while True:
            version, record = self.log.latest()
            folders = record.get("folders", [])
            told = self._write(outcomes(proposed, polls, self.read(folders)))
            fresh = self._write(new_finals(wanted, self.read(folders)).select(*proposed.columns))
            if self.read([fresh]).isEmpty():
                delete(self.spark, f"{self.folder}/{fresh}")
                break
            live, old = [*folders, fresh], record.get("old", [])
            if merged := len(live) > MOST_FOLDERS:
                live, old = [self._write(self.read(live))], live
            if self.log.publish(version + 1, {"folders": live, "old": old}):
                if merged:  # what was just put together may still be read; what was put together the time before goes
                    for name in record.get("old", []):
                        delete(self.spark, f"{self.folder}/{name}")
                    self.log.forget_before(version)
                break
            for name in {told, fresh, live[-1]}:  # another writer was first: look again which polls are open
                delete(self.spark, f"{self.folder}/{name}")
        for name in (base, self._told):
            if name:
                delete(self.spark, name)
        self._told = f"{self.folder}/{told}"
        return read_parquet(self.spark, _TOLD, [self._told])


class Ledger:
    """One consumer's state below ``folder``, with results in ``finals`` below it or in a folder shared with others."""

    def __init__(self, spark: SparkSession, folder: str, polls: DataFrame, config: Config | None = None, finals: str | None = None, compact_every: int = 20):
        self.spark, self.folder, self.polls, self.config, self.compact_every = spark, folder, polls, config or Config(), compact_every
        self.results = Finals(spark, finals or f"{folder}/finals")
        self.states = VersionLog(spark, f"{folder}/states")
        self._writing = RLock()

    def messages(self) -> DataFrame:
        """All messages ever, for audits; triggers don't read them."""
        path = f"{self.folder}/messages"
        return read_parquet(self.spark, _LEDGER, [path] if exists(self.spark, path) else [])

    def finals(self) -> DataFrame:
        return self.results.read()

    # -- what batches leave

    def _batches(self) -> dict[int, int]:
        """Messages of each batch that is complete and not yet in the state, by the names of their files."""
        return {int(b): int(n) for b, n in (x.split("-") for x in names(self.spark, f"{self.folder}/batches"))}

    def _through(self) -> tuple[int, int, dict]:
        """Last batch in the state, messages up to it, and the state's folders."""
        record = self.states.latest()[1]
        return record.get("through", -1), record.get("messages", 0), record

    def append(self, batch: DataFrame, batch_id: int, arrived: datetime) -> None:
        """Leaves what a batch holds; the same batch again leaves the same, and one that is in the state nothing."""
        with self._writing:
            through, before, _ = self._through()
            if batch_id <= through:
                return
            log = f"{self.folder}/messages/batch_id={batch_id}"
            decode(batch.select("partition", "offset", "value")).drop("value").withColumn("arrived", F.lit(arrived)).write.mode("overwrite").parquet(log)
            rows = read_parquet(self.spark, _LEDGER.rpartition(",")[0], [log]).where("not malformed")
            number = rows.count()
            before += sum(n for b, n in self._batches().items() if through < b < batch_id)
            seen = numbered(rows, "offset", "partition").withColumn("seq", F.col("seq") + before)
            shown = seen.groupBy("poll_id", "worker_id").agg(F.max("done").alias("done"), F.count("*").alias("own"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.min("arrived").alias("arrived"))
            votes = first_votes(votes_of(rows), keep_seq=True)
            votes.write.mode("overwrite").parquet(f"{self.folder}/votes/{batch_id}")
            shown.write.mode("overwrite").parquet(f"{self.folder}/workers/{batch_id}")
            create_if_absent(self.spark, f"{self.folder}/batches/{batch_id:012d}-{number}", "")

    def _held(self, what: str, schema: str) -> DataFrame:
        """Rows of the state and of the batches since."""
        through, _, record = self._through()
        since = [f"{self.folder}/{what}/{b}" for b in sorted(self._batches()) if b > through]
        return read_parquet(self.spark, schema, ([f"{self.folder}/{record[what]}"] if what in record else []) + since)

    def _open(self, what: str, schema: str) -> DataFrame:
        return self._held(what, schema).join(self.finals().select("poll_id").distinct(), "poll_id", "left_anti")

    def open_votes(self) -> DataFrame:
        """First votes of open polls, one row for each state or batch that has one: all votes that a trigger reads."""
        return self._open("votes", _VOTES)

    def open_workers(self) -> DataFrame:
        return self._open("workers", _WORKERS)

    def message_count(self) -> int:
        """Well-formed messages so far."""
        through, before, _ = self._through()
        return before + sum(n for b, n in self._batches().items() if b > through)

    # -- settling

    def _due(self, now: datetime) -> DataFrame:
        """Polls that are final by now, with what tells it; settled ones among them until the state is compacted."""
        shown = self._held("workers", _WORKERS)
        went_by = shown.groupBy("poll_id").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("own").alias("own"))
        # what counts as silence are all messages of the consumer, those of settled polls too
        stale = went_by.select("poll_id", silence(F.lit(self.message_count()), self.config.stale_mode).alias("stale"))
        return judge(workers(shown).join(stale, "poll_id"), deadlines(shown, self.polls, self.config), F.lit(now), self.config).where("reason is not null")

    def settle(self, now: datetime) -> DataFrame:
        """Settles polls that became final: (poll_id, outcome)."""
        with self._writing:
            ready = self._due(now)
            counts = tally(self.open_votes().join(ready.select("poll_id"), "poll_id", "left_semi"))
            total = counts.groupBy("poll_id").agg(F.sum("count").alias("total"))
            rows = ready.join(counts, "poll_id", "left").join(total, "poll_id", "left")
            rows = rows.select("poll_id", "option_id", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("total", F.lit(0)).alias("total"), "workers_seen", "workers_done", "reason")
            return self.results.settle(rows, self.polls)

    def settle_due(self, now: datetime) -> int:
        """Settles, and tells how many rows of results that added."""
        before = self.finals().count()
        self.settle(now)
        return self.finals().count() - before

    def not_found(self) -> DataFrame:
        """(poll_id, messages): well-formed messages for polls that don't exist; they are never settled."""
        known = self.polls.select(F.col("id").alias("poll_id"))
        return self.open_workers().join(known, "poll_id", "left_anti").groupBy("poll_id").agg(F.sum("own").alias("messages"))

    def compact(self, now: datetime) -> None:
        """Writes the state of open polls anew and publishes it; then the batches in it, and older states, go.

        Polls that don't exist lose their votes once they would have ended; how many messages they had stays.
        """
        with self._writing:
            through, _, record = self._through()
            batches = [b for b in self._batches() if b > through]
            if not batches:
                return
            lost = self._due(now).join(self.polls.select(F.col("id").alias("poll_id")), "poll_id", "left_anti").select("poll_id")
            name = uuid.uuid4().hex
            votes = first_votes(self.open_votes().join(lost, "poll_id", "left_anti"), keep_seq=True)
            shown = self.open_workers().groupBy("poll_id", "worker_id").agg(F.max("done").alias("done"), F.sum("own").alias("own"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("arrived").alias("arrived"))
            votes.write.parquet(f"{self.folder}/state-{name}/votes")
            shown.write.parquet(f"{self.folder}/state-{name}/workers")
            version = self.states.latest()[0] + 1
            mine = {"through": max(batches), "messages": self.message_count(), "votes": f"state-{name}/votes", "workers": f"state-{name}/workers"}
            if not self.states.publish(version, mine):
                return
            for b in batches:
                for what in ("votes", "workers"):
                    delete(self.spark, f"{self.folder}/{what}/{b}")
            for n in names(self.spark, f"{self.folder}/batches"):
                if int(n.split("-")[0]) <= max(batches):
                    delete(self.spark, f"{self.folder}/batches/{n}")
            self.states.forget_before(version)
            if "votes" in record:
                delete(self.spark, f"{self.folder}/{record['votes'].split('/')[0]}")

    # -- as a stream

    def on_batch(self, clock):
        def run(batch: DataFrame, batch_id: int) -> None:
            now = clock()
            if "beat" in batch.columns:
                batch = batch.where("not beat")
            self.append(batch, batch_id, now)
            self.settle(now)
            if len(self._batches()) >= self.compact_every:
                self.compact(now)

        return run

    def start(self, stream: DataFrame, checkpoint: str, clock=datetime.now, heartbeat: bool = False, **trigger):
        """A streaming query over messages; the checkpoint keeps offsets, so a restart repeats nothing that was done.

        With ``heartbeat`` every trigger has a batch, with or without messages.
        """
        if heartbeat:
            beats = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
            beats = beats.select(F.lit(None).cast("int").alias("partition"), F.lit(None).cast("bigint").alias("offset"), F.lit(None).cast("binary").alias("value"), F.lit(True).alias("beat"))
            stream = stream.select("partition", "offset", "value", F.lit(False).alias("beat")).unionByName(beats)
        writer = stream.writeStream.foreachBatch(self.on_batch(clock)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
