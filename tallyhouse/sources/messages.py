"""Vote batches as messages: reading, decoding, encoding, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import placed
from ..schemas import BATCH, MESSAGE
from .store import exists

#: Bytes of a message or request body that are read at most.
MOST_BODY = 1 << 20


def read_kafka(spark: SparkSession, servers: str, topic: str = "votes", streaming: bool = True, **options) -> DataFrame:
    """Messages from the earliest offset.  Needs Spark's Kafka connector on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    return reader.option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("fetch.max.bytes", 10 << 20).options(**options).load()


def read_json_folder(spark: SparkSession, path: str, streaming: bool = False, per_trigger: int | None = None) -> DataFrame:
    """Messages from a folder of JSON lines (value and key in base64): the source that works without a connector."""
    reader = (spark.readStream if streaming else spark.read).schema(MESSAGE)
    if streaming and per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(path)


def encode_value() -> Column:
    """JSON of a batch; empty votes are left out, as are nulls."""
    body = F.struct("poll_id", "worker_id", "done", F.when(F.size("votes") > 0, F.col("votes")).alias("votes"))
    return F.to_json(body).cast("binary")


def encode(batches: DataFrame) -> DataFrame:
    """(key, value) of batches."""
    return batches.select(F.col("poll_id").cast("binary").alias("key"), encode_value().alias("value"))


def write_kafka(batches: DataFrame, servers: str, topic: str = "votes") -> None:
    """Batches keyed by poll, acknowledged by all replicas.  Needs the Kafka connector."""
    out = encode(batches).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    out.option("kafka.acks", "all").option("kafka.compression.type", "lz4").option("kafka.linger.ms", 10).option("kafka.request.timeout.ms", 30_000).save()


def partition_of(poll: Column, partitions: int) -> Column:
    """Partition of a poll's messages: all in one, so that offsets order them."""
    return F.pmod(F.xxhash64(poll), F.lit(partitions)).cast("int")


def write_json_folder(batches: DataFrame, path: str, order: str = "batch", partitions: int = 8, topic: str = "votes") -> None:
    """Batches (poll_id, worker_id, done, votes) as messages in a folder of JSON lines that ``read_json_folder`` reads.

    Messages of a partition have offsets without gaps, by ``order``, then poll and worker; they go on after those that are
    there.  Offsets are counted in parallel: places in ranges of the order, and counts of the ranges before.
    """
    spark = batches.sparkSession
    rows = placed(batches.withColumn("partition", partition_of(F.col("poll_id"), partitions)), ["partition"], order, "poll_id", "worker_id", place="_place")
    if exists(spark, path):
        taken = read_json_folder(spark, path).groupBy("partition").agg((F.max("offset") + 1).alias("_from"))
        rows = rows.join(F.broadcast(taken), "partition", "left")  # a row for each partition
    else:
        rows = rows.withColumn("_from", F.lit(0))
    offset = (F.coalesce("_from", F.lit(0)) + F.col("_place")).cast("bigint")
    out = rows.select(F.lit(topic).alias("topic"), "partition", offset.alias("offset"), F.col("poll_id").cast("binary").alias("key"), encode_value().alias("value"))
    out.write.mode("append").json(path)


#: How JSON is read: no more than its standard allows.
STRICT = {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def whole_json(text: Column) -> Column:
    """Whether a text is one JSON value with nothing behind it.

    A parser that stops at the end of a value can't see what follows.  Inside brackets what follows must be one, inside braces the
    other; only a comma fits both, and then there are two elements.
    """
    one = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.coalesce(one & (F.size(F.json_object_keys(F.concat(F.lit('{"x":'), text, F.lit("}")))) == 1), F.lit(False))


def folded(text: Column, *names: str) -> Column:
    """``text`` with these field names in lower case, whatever their case was; a name is what stands in quotes before a colon.

    Texts that have them in lower case, which are nearly all, are only looked at.
    """
    lower, any_case = "|".join(names), f"(?iu:{'|'.join(names)})"
    out = text
    for name in names:
        out = F.regexp_replace(out, f'"(?iu:{name})"(\\s*:)', f'"{name}"$1')
    return F.when(text.rlike(f'"(?!(?:{lower})"){any_case}"\\s*:'), out).otherwise(text)


_TYPES = "poll_id variant, worker_id variant, votes array<struct<fingerprint:variant>>"


def _is_text(value: Column) -> Column:
    """A text, null or nothing at all."""
    return F.coalesce(F.schema_of_variant(value).isin("STRING", "VOID"), F.lit(True))


def decode(messages: DataFrame, strict: bool = False) -> DataFrame:
    """``messages`` with poll_id, worker_id, done, votes and malformed.

    Missing fields become '', false and no votes; names of fields count in any case.  Malformed are messages that are not one JSON
    object of the right types with nothing behind it, empty ones, and those without a poll.  ``strict`` also rejects
    numbers in place of texts.
    """
    text = F.col("value").cast("string")
    text = F.when(whole_json(text), folded(text, "poll_id", "worker_id", "done", "votes", "fingerprint", "option_id"))
    rows = messages.withColumn("_text", text)
    rows = rows.withColumn("_m", F.from_json("_text", f"{BATCH}, _bad string", STRICT))
    bad = F.col("_m").isNull() | F.col("_m._bad").isNotNull() | (F.coalesce(F.col("_m.poll_id"), F.lit("")) == "")
    if strict:
        rows = rows.withColumn("_types", F.from_json("_text", _TYPES))
        bad = bad | ~(_is_text(F.col("_types.poll_id")) & _is_text(F.col("_types.worker_id")) & F.coalesce(F.forall("_types.votes", lambda v: _is_text(v["fingerprint"])), F.lit(True)))
    fields = {
        "malformed": F.coalesce(bad, F.lit(True)),
        "poll_id": F.coalesce("_m.poll_id", F.lit("")),
        "worker_id": F.coalesce("_m.worker_id", F.lit("")),
        "done": F.coalesce("_m.done", F.lit(False)),
        "votes": F.coalesce("_m.votes", F.array().cast("array<struct<fingerprint:string,option_id:bigint>>")),
    }
    return rows.select(*messages.columns, *[c.alias(k) for k, c in fields.items()])


def votes_of(decoded: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Votes of well-formed messages, with one number that keeps the order of offset and place.

    ``width`` is more than the most votes of a message.  A poll lies in one partition, so that offset and
    place order its votes.
    """
    rows = decoded.where("not malformed").select("poll_id", "worker_id", "offset", F.posexplode("votes").alias("place", "vote"))
    seq = F.col("offset") * width + F.col("place")
    return rows.select("poll_id", F.coalesce("vote.fingerprint", F.lit("")).alias("fingerprint"), F.coalesce("vote.option_id", F.lit(0)).alias("option_id"), "worker_id", seq.alias("seq"))
