"""Processing only what is new: offsets, write-ahead plans and an idempotent sink."""

from __future__ import annotations

import json
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.plans.common import is_small, scratch
from tidelog.plans.files import list_names, numbered_json, put_once, read_text

#: Deliveries in one bucket of the range join.
BUCKET_ROWS = 4_096
_RANGE = ["consumer_id", "part", "lo", "hi"]


def finished_runs(runs: DataFrame) -> DataFrame:
    """The ranges of runs that succeeded: consumer_id, first_delivery_id, last_delivery_id.

    The latest report of a run decides (ties: the larger status text); letter case and outer blanks of the status don't matter.
    Reports without time come before all others; a range lacking an end, or with ends the wrong way round, covers nothing.
    """
    told = F.struct(F.coalesce(F.unix_micros(F.col("reported_at").cast("timestamp")), F.lit(-(2**63))).alias("at"), F.lower(F.trim("status")).alias("status"), "first_delivery_id", "last_delivery_id")
    last = runs.filter(F.col("consumer_id").isNotNull() & F.col("run_id").isNotNull()).groupBy("consumer_id", "run_id").agg(F.max(told).alias("r"))
    good = last.filter((F.col("r.status") == "succeeded") & (F.col("r.first_delivery_id") <= F.col("r.last_delivery_id")))
    return good.select("consumer_id", "r.first_delivery_id", "r.last_delivery_id")


def open_ranges(done: DataFrame, spans: DataFrame) -> DataFrame:
    """What ``done`` (consumer_id, part, lo, hi) leaves uncovered of ``spans`` (the same columns), as disjoint ranges. Ranges outside the span of their part cover nothing."""
    span = spans.select("consumer_id", "part", F.col("lo").alias("_lowest"), F.col("hi").alias("_highest"))
    order = W.partitionBy("consumer_id", "part").orderBy("lo", "hi")
    end = F.col("_highest") + 1
    marks = done.select(*_RANGE).join(span, ["consumer_id", "part"]).filter("hi >= _lowest and lo <= _highest").unionByName(span.withColumns({"lo": end, "hi": end}))
    reached = F.coalesce(F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1)), F.col("_lowest") - 1)
    gaps = marks.withColumn("_from", F.greatest(reached, F.col("_lowest") - 1) + 1)
    return gaps.filter(F.col("lo") > F.col("_from")).select("consumer_id", "part", F.col("_from").alias("lo"), (F.col("lo") - 1).alias("hi"))


def in_ranges(rows: DataFrame, ranges: DataFrame, position: str, lowest: int, highest: int, n_rows: int) -> DataFrame:
    """``rows`` (with their ``part``) joined to the ranges [lo, hi] of that part their ``position`` lies in: an equi-join on buckets of positions,
    then the exact test. The span of all ranges reaches the scan as a filter.

    The bucket width follows the density of positions, so ranges are cut into about one piece for each BUCKET_ROWS rows they hold.
    """
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    width = max(1, -(-(highest - lowest + 1) // buckets))
    bucket = lambda c: F.floor((F.col(c) - lowest) / width).cast("long")
    ranges = ranges.filter((F.col("lo") <= highest) & (F.col("hi") >= lowest)).withColumns({"lo": F.greatest("lo", F.lit(lowest)), "hi": F.least("hi", F.lit(highest))})
    cut = ranges.withColumn("_bucket", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    if is_small(cut):
        cut = F.broadcast(cut)
    rows = rows.filter(F.col(position).between(lowest, highest)).withColumn("_bucket", bucket(position))
    return rows.join(cut, ["part", "_bucket"]).filter(F.col(position).between(F.col("lo"), F.col("hi"))).drop("_bucket", "lo", "hi")


class IncrementalRun:
    """Runs that each process what was added since the last one, without skipping or repeating under failures.

    ``position`` is the place a record was appended at in its source partition (``partition``; None: one partition). It only grows with arrival, so
    the offset reached in each partition says what was taken, and a record that lands late, below an earlier log offset, still gets a new
    position and comes in the next batch. Records without position aren't appended yet and are left out.

    A run first writes its plan ahead: ranges of positions for each consumer and partition. A plan without its commit mark is replayed as it stands
    before a new one is made, however much has arrived since. The sink keeps one row for each consumer and ``keys``: copies within a
    batch fall to the first position (nulls in keys are equal), and rows that a committed batch has written, or a run of adopt() processed, are not
    written again; only the ``bucket``s of the sink that a batch touches are read for that. Every attempt writes a folder of its own,
    which its commit mark names, so nothing of a lost attempt is ever read. One driver at a time runs the batches of a root; a second one
    fails on the mark.
    """

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...] = ("record_id", "log_offset"), position: str = "delivery_id", partition: Column | None = None, bucket: Column | None = None):
        self.spark, self.root, self.keys, self.position = spark, root.rstrip("/"), list(keys), position
        self.part = F.lit("") if partition is None else F.coalesce(partition.cast("string"), F.lit(""))
        self.bucket = F.lit("0") if bucket is None else F.coalesce(F.nullif(bucket.cast("string"), F.lit("")), F.lit("none"))

    def adopt(self, ranges: DataFrame, consumers: DataFrame) -> None:
        """Take over consumers (consumer_id) with the ranges their earlier runs have processed (consumer_id, lo, hi and, with several partitions, part).

        Done once, before the first plan. Without it there is one consumer, 0, that has processed nothing.
        """
        path = f"adopted/{uuid.uuid4().hex}"
        if "part" not in ranges.columns:
            ranges = ranges.withColumn("part", F.lit(""))
        nothing = consumers.filter(F.col("consumer_id").isNotNull()).select("consumer_id").distinct().select("consumer_id", *(F.lit(None).cast(t).alias(c) for c, t in (("part", "string"), ("lo", "long"), ("hi", "long"))))
        ranges.select(*_RANGE).unionByName(nothing).write.parquet(f"{self.root}/{path}")
        lo, hi = self.spark.read.parquet(f"{self.root}/{path}").agg(F.min("lo"), F.max("hi")).first()
        _, number = numbered_json(self.spark, f"{self.root}/adopted")
        put_once(self.spark, f"{self.root}/adopted/{number}.json", json.dumps({"ranges": path, "lo": lo, "hi": hi}))

    def _adopted(self) -> tuple[DataFrame | None, dict]:
        told, _ = numbered_json(self.spark, f"{self.root}/adopted")
        return (self.spark.read.parquet(f"{self.root}/{told['ranges']}"), told) if told else (None, {})

    def _commits(self) -> dict[int, dict]:
        found = {}
        for name in list_names(self.spark, f"{self.root}/commits"):
            if name.endswith(".json"):
                try:
                    found[int(name.split(".")[0])] = json.loads(read_text(self.spark, f"{self.root}/commits/{name}"))
                except ValueError:
                    continue  # its writer was lost: not committed
        return dict(sorted(found.items()))

    def _told(self, source: DataFrame) -> DataFrame:
        return source.filter(F.col(self.position).isNotNull()).withColumn("part", self.part)

    def committed(self) -> dict[str, int]:
        """The position each source partition was processed to by committed batches."""
        done = self._commits()
        return max(done.values(), key=lambda c: c["batch"])["until"] if done else {}

    def plan(self, source: DataFrame) -> dict | None:
        """The batch to process: an uncommitted plan as written, else a new one written ahead; None when nothing is new."""
        last, number = numbered_json(self.spark, f"{self.root}/plans")
        if last and last["batch"] not in {c["batch"] for c in self._commits().values()}:
            return last
        since = last["until"] if last else {}
        rows = self._told(source)
        if since:  # reaches the scan: only what was appended later is read
            past = reduce(lambda a, b: a | b, ((F.col("part") == p) & (F.col(self.position) > at) for p, at in since.items()))
            rows = rows.filter(past | ~F.col("part").isin(*since))
        ends = rows.groupBy("part").agg(F.min(self.position).alias("lo"), F.max(self.position).alias("hi"), F.count(F.lit(1)).alias("n")).collect()  # one row for each source partition
        if not ends:
            return None
        spans = self._spans({r.part: (since[r.part] + 1 if r.part in since else r.lo, r.hi) for r in ends})
        adopted, _ = self._adopted()
        if adopted is not None and not since:
            spans = open_ranges(adopted.filter("lo is not null"), spans)
        path = f"ranges/{number}-{uuid.uuid4().hex}"
        spans.write.parquet(f"{self.root}/{path}")
        batch = {"batch": number, "ranges": path, "since": since, "until": {**since, **{r.part: r.hi for r in ends}}, "lo": min(r.lo for r in ends), "hi": max(r.hi for r in ends), "n": sum(r.n for r in ends)}
        put_once(self.spark, f"{self.root}/plans/{number}.json", json.dumps(batch))
        return batch

    def _spans(self, ends: dict[str, tuple[int, int]]) -> DataFrame:
        """The same ranges for every consumer."""
        adopted, _ = self._adopted()
        consumers = self.spark.range(1).select(F.lit(0).cast("long").alias("consumer_id")) if adopted is None else adopted.select("consumer_id").distinct()
        parts = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for p, (lo, hi) in sorted(ends.items())))
        return consumers.select("consumer_id", F.inline(parts))

    def rows_of(self, source: DataFrame, batch: dict) -> DataFrame:
        """What a batch takes: the rows of its ranges, with consumer_id and part."""
        ranges = self.spark.read.parquet(f"{self.root}/{batch['ranges']}")
        return in_ranges(self._told(source), ranges, self.position, batch["lo"], batch["hi"], batch["n"])

    def _same(self, a: DataFrame, b: DataFrame, how: str, on: list[str]) -> DataFrame:
        a, b = a.alias("a"), b.alias("b")
        return a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on], how)

    def _seen(self, fresh: DataFrame, source: DataFrame, batch: dict) -> DataFrame | None:
        """consumer_id and keys that need no writing again, among those that a batch touches."""
        known = ["consumer_id", *self.keys]
        frames = []
        done = self._commits()
        if done:
            touched = {r._bucket for r in fresh.select("_bucket").distinct().collect()}  # names of buckets
            paths = [f"{self.root}/{c['sink']}/_bucket={b}" for c in done.values() for b in c["buckets"] if unquote(b) in touched]
            if paths:
                frames.append(self.spark.read.schema(fresh.select(*known).schema).parquet(*paths))
        adopted, ends = self._adopted()
        if adopted is not None and ends["lo"] is not None:
            # copies of this batch's rows among what earlier runs have processed
            hits = self._same(self._told(source), fresh.select(*self.keys).distinct(), "left_semi", self.keys)
            frames.append(in_ranges(hits, adopted.filter("lo is not null"), self.position, ends["lo"], min(ends["hi"], batch["hi"]), batch["n"]).select(*known).distinct())
        return reduce(DataFrame.unionByName, frames) if frames else None

    def run(self, source: DataFrame, process=lambda df: df, fail_after: str | None = None) -> int | None:
        """Process one batch: its number, or None when nothing was new. ``process`` may change rows but must keep consumer_id and the keys.
        ``fail_after`` ("plan" or "sink") is for tests of recovery."""
        batch = self.plan(source)
        if batch is None:
            return None
        if fail_after == "plan":
            raise RuntimeError("stopped after the plan")
        attempt = f"{batch['batch']}-{uuid.uuid4().hex}"
        rows = self.rows_of(source, batch).drop("part")
        first = F.min(F.struct(self.position, *(c for c in rows.columns if c not in (self.position, "consumer_id", *self.keys)))).alias("_first")
        own = rows.groupBy("consumer_id", *self.keys).agg(first)
        fresh = own.select("consumer_id", *self.keys, "_first.*").withColumn("_bucket", self.bucket)
        fresh.write.parquet(f"{self.root}/work/{attempt}")
        fresh = self.spark.read.schema(fresh.schema).parquet(f"{self.root}/work/{attempt}")
        seen = self._seen(fresh, source, batch)
        new = fresh if seen is None else self._same(fresh, seen, "left_anti", ["consumer_id", *self.keys])
        out = process(new.drop("_bucket")).withColumns({"batch": F.lit(batch["batch"]), "_bucket": self.bucket})
        sink = f"sink/{attempt}"
        out.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{sink}")  # whole files for each bucket, hot ones split
        if fail_after == "sink":
            raise RuntimeError("stopped before the commit mark")
        buckets = [n.split("=", 1)[1] for n in list_names(self.spark, f"{self.root}/{sink}") if n.startswith("_bucket=")]
        mark = {"batch": batch["batch"], "sink": sink, "buckets": buckets, "until": batch["until"], "schema": json.loads(out.drop("_bucket").schema.json())}
        _, number = numbered_json(self.spark, f"{self.root}/commits")
        put_once(self.spark, f"{self.root}/commits/{number}.json", json.dumps(mark))
        return batch["batch"]

    def sink(self) -> DataFrame | None:
        """What committed batches have written: one row for each consumer and keys, with its batch. None before the first commit."""
        done = list(self._commits().values())
        if not done:
            return None
        schema = StructType.fromJson(done[-1]["schema"])
        paths = [f"{self.root}/{c['sink']}/_bucket={b}" for c in done for b in c["buckets"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def pending_messages(changes: DataFrame, runs: DataFrame, root: str | None = None, position: str = "delivery_id", key: str = "log_offset") -> DataFrame:
    """Messages each consumer still has to process: consumer_id, ``key``.

    The consumers' finished runs are adopted by an IncrementalRun under ``root``, whose first batch takes what they left: a message is pending when
    none of its deliveries lies in a finished run. Null keys and null positions are no deliveries; an empty log gives no rows.
    """
    spark = changes.sparkSession
    run = IncrementalRun(spark, root or scratch(spark, "pending"), (key,), position, bucket=F.shiftright(key, 44))
    done = finished_runs(runs).select("consumer_id", F.col("first_delivery_id").alias("lo"), F.col("last_delivery_id").alias("hi"))
    run.adopt(done, runs)
    rows = changes.select(key, position).filter(F.col(key).isNotNull())
    if run.run(rows) is None:
        return spark.createDataFrame([], StructType([runs.schema["consumer_id"], changes.schema[key]]))
    return run.sink().select("consumer_id", key)


__all__ = ["IncrementalRun", "finished_runs", "in_ranges", "open_ranges", "pending_messages"]
