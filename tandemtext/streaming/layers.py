"""Runtime memory layers as a stream: each committed batch is upserted and visible to later lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tandemtext.operators import memory
from tandemtext.sources.sinks import BucketedTable

ENTRY = "entry_id bigint, source string, target string, context string, file string"
KEY = ["source", "context"]


def memory_table(spark: SparkSession, store: str) -> BucketedTable:
    return BucketedTable(spark, store, KEY)


def follow_layers(spark: SparkSession, incoming: str, store: str, checkpoint: str, replace: bool = True) -> StreamingQuery:
    """Merges every micro-batch of new entries (parquet files in a folder) into the memory, which is stored in buckets by key.

    Only the buckets that a batch has keys in are read and written anew. A micro-batch that is run again after a failure is
    known by its number, which is stored with the version, and changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table = memory_table(spark, store)
        state = table.last()["state"]
        if batch.isEmpty() or number <= state.get("batch", -1):
            return
        new = batch.select(*[c.split()[0] for c in ENTRY.split(", ")])
        touched, last = table.touched(new), state.get("last", 0)
        old = table.read_buckets(touched, ENTRY)
        merged = memory.upsert(spark.createDataFrame([], ENTRY) if old is None else old, new, replace, last)
        highest = new.agg(F.max("entry_id")).first()[0] or 0
        table.commit_buckets(merged, touched, {"batch": number, "last": last + highest})

    stream = spark.readStream.schema(ENTRY).parquet(incoming)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
