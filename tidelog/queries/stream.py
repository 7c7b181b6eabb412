"""Streaming queries, run over what there is now, and reads through the log source; the SQL is that of the same in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.plans.common import scratch, table
from tidelog.queries.log import _A
from tidelog.sources import changelog
from tidelog.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _main(spark, sf_dir, name):
    s = streams.Streams(spark, scratch(spark, "streams"))
    source = spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")
    s.take_in(source)
    return s


def stream_tail(spark, sf_dir):
    """The log taken in as a stream, and a stream of its deletes derived by SQL."""
    s = _main(spark, sf_dir, "change_records")
    s.job("deletes", [streams.MAIN], streams.sql_job("select delivery_id, log_offset, row_key from s1 where rec_type = 2"))
    return s.read("deletes")


def stream_chained(spark, sf_dir):
    """A stream derived from a derived stream."""
    s = _main(spark, sf_dir, "change_records")
    s.job("changes", [streams.MAIN], streams.sql_job("select delivery_id, rec_type, table_meta_id from s1 where rec_type in (0, 1, 2, 3)"))
    s.job("counts", ["changes"], lambda c: c.groupBy("rec_type").agg(F.count(F.lit(1)).alias("n")), mode="complete")
    return s.read("counts")


def stream_windows(spark, sf_dir):
    s = _main(spark, sf_dir, "events")

    def define(events):
        hours = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
        return hours.select(F.col("window.start").alias("starts"), F.col("window.end").alias("ends"), "event_type", "n", "total")

    s.job("hours", [streams.MAIN], define, mode="complete")
    return s.read("hours")


def stream_transactions(spark, sf_dir):
    """Whole transactions only, over three micro-batches of the log, laid out in twelve files in the order of delivery."""
    root = scratch(spark, "transactions")
    columns = ["delivery_id", "log_offset", "txn_id", "rec_type"]
    log = table(spark, sf_dir, "change_records").select(*columns)
    log.repartitionByRange(12, "delivery_id").write.parquet(f"{root}/log")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/log")
    source.writeStream.foreachBatch(streams.transaction_sink(spark, root)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/done").select(*columns)


def stream_heartbeat(spark, sf_dir):
    """Changes of definition by hour as a stream, with heartbeats: the last hours close only because heartbeats go on after them."""
    root = scratch(spark, "heartbeat")
    log = table(spark, sf_dir, "change_records").filter("rec_type in (4, 16) and ts is not null").select("delivery_id", "ts", "rec_type")
    for place, kind in enumerate((4, 16)):  # one micro-batch of changes, then one of heartbeats alone
        log.filter(F.col("rec_type") == kind).coalesce(1).write.parquet(f"{root}/log/{place}")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{root}/log/*")
    timed = streams.with_heartbeat(source, delay="1 hour")
    hours = timed.groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("starts"), "n")
    hours.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(hours.schema).parquet(f"{root}/out")


def stream_count_windows(spark, sf_dir):
    """Full windows of 50 events of each type, in the order they come: how many there are."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = _main(spark, sf_dir, "events")
        s.job("fifties", [streams.MAIN], lambda e: streams.count_windows(e.select("event_type", F.col("value").cast("decimal(18,4)").alias("value")), "event_type", "value", 50))
        return s.read("fifties").groupBy("key").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n_rows"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def source_scan(spark, sf_dir):
    """The log source with a range of positions and a type pushed down to it."""
    changelog.register(spark)
    wanted = "delivery_id bigint, log_offset bigint, rec_type int, row_key string"
    rows = spark.read.format("tidelog").schema(wanted).option("path", f"{sf_dir}/change_records.parquet").option("startingOffset", 35184372088832).load()
    return rows.filter("log_offset < 387028092977152 and rec_type = 2").select("delivery_id", "log_offset", "row_key")


def source_stream(spark, sf_dir):
    """The log source followed as a stream, file by file."""
    changelog.register(spark)
    root = scratch(spark, "source")
    rows = spark.readStream.format("tidelog").schema("delivery_id bigint, log_offset bigint, rec_type int").option("path", f"{sf_dir}/change_records.parquet").load()
    rows.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/out").trigger(once=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


for _f in (stream_tail, stream_chained, stream_windows, stream_transactions, stream_heartbeat, stream_count_windows, source_scan, source_stream):
    QUERIES[_f.__name__] = _f
SQL["stream_tail"] = "select delivery_id, log_offset, row_key from change_records where rec_type = 2"
SQL["stream_chained"] = "select rec_type, count(*) as n from change_records where rec_type in (0, 1, 2, 3) group by 1"
SQL["stream_windows"] = f"select time_bucket(interval 1 hour, ts) as starts, time_bucket(interval 1 hour, ts) + interval 1 hour as ends, event_type, {_A} from events group by 1, 2, 3"
SQL["stream_transactions"] = "select delivery_id, log_offset, txn_id, rec_type from change_records where txn_id is null or txn_id in (select txn_id from change_records where rec_type in (6, 7))"
SQL["stream_heartbeat"] = """with t as (select ts, rec_type from change_records where rec_type in (4, 16) and ts is not null)
select time_bucket(interval 1 hour, ts) as starts, count(*) as n from t where rec_type = 4 and time_bucket(interval 1 hour, ts) + interval 1 hour <= (select max(ts) from t) - interval 1 hour group by 1"""
SQL["stream_count_windows"] = "select event_type as key, count(*) // 50 as n_windows, count(*) // 50 * 50 as n_rows from events group by 1"
SQL["source_scan"] = "select delivery_id, log_offset, row_key from change_records where log_offset >= 35184372088832 and log_offset < 387028092977152 and rec_type = 2"
SQL["source_stream"] = "select delivery_id, log_offset, rec_type from change_records"
