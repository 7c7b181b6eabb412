"""Exactly one copy of every message delivered at least once."""

from __future__ import annotations

import json
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.plans.common import is_small, lookup_join
from tidelog.plans.files import list_names, numbered_json, put_once, remove

#: Fragments of an index bucket above which a merge writes them as one.
FRAGMENTS = 8


class DeliveryStore:
    """Messages kept once each in partitions of a table, with an index from identifier to partition.

    merge() looks up which stored partitions hold identifiers of the incoming deliveries, combines those partitions with the incoming rows, recomputes
    the winner of each identifier and replaces only those partitions. The index lies in ``bucket``s of identifiers, of which only those that the
    incoming rows touch are read. Every merge writes a folder of its own and then publishes one manifest naming the folders of each partition and
    bucket, so readers see either the state before or the one after, also when executors or the driver are lost in between: what a lost merge left
    is never read, is in nobody's way, and goes with vacuum(). One driver at a time merges; a second one fails on the manifest.

    The winner of an identifier is the delivery with the smallest ``order`` (ties: the smallest remaining columns). Rows with a null identifier or
    null order are no deliveries and are left out. A partition value of null or "" is a partition of its own. ``partition`` may depend on anything in a
    row: an identifier stays in the partition where it was first stored. ``bucket`` must depend on the identifier only.
    """

    def __init__(self, spark: SparkSession, root: str, partition: Column, key: str = "log_offset", order: str = "delivery_id", bucket: Column | None = None):
        self.spark, self.root, self.key, self.order = spark, root.rstrip("/"), key, order
        named = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("none"))
        self.partition, self.bucket = named(partition), named(F.pmod(F.xxhash64(key), F.lit(64)) if bucket is None else bucket)

    def manifest(self) -> dict:
        told, following = numbered_json(self.spark, f"{self.root}/manifests")
        return {**(told or {"parts": {}, "index": {}, "schema": None}), "next": following}

    def _read(self, folders: dict[str, str] | list[tuple[str, str]], schema: StructType) -> DataFrame | None:
        """Rows of (partition, folder) pairs, with _part: one scan for all folders of a merge."""
        bases: dict[str, list[str]] = {}
        for _, folder in folders.items() if isinstance(folders, dict) else folders:
            bases.setdefault(folder.rsplit("/", 1)[0], []).append(f"{self.root}/{folder}")
        frames = [self.spark.read.schema(schema).option("basePath", f"{self.root}/{base}").parquet(*own) for base, own in bases.items()]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def rows(self, parts: list[str] | None = None) -> DataFrame | None:
        """The winners stored in ``parts`` (all if None), with their partition in ``_part``."""
        m = self.manifest()
        chosen = {p: folder for p, folder in m["parts"].items() if parts is None or p in parts}
        return self._read(chosen, StructType.fromJson(m["schema"])) if chosen else None

    def index(self, buckets: list[str] | None = None) -> DataFrame | None:
        """The index of ``buckets`` (all if None): key and ``_stored``, the partition it lies in."""
        m = self.manifest()
        fragments = [("", f) for b, own in m["index"].items() if buckets is None or b in buckets for f in own]
        schema = StructType().add(StructType.fromJson(m["schema"])[self.key]) if m["schema"] else StructType()
        found = self._read(fragments, schema.add("_stored", "string").add("_part", "string")) if fragments else None
        return found.drop("_part") if found is not None else None

    def merge(self, incoming: DataFrame) -> DataFrame:
        """Take in deliveries; returns the losers among them and the stored rows that lost to them: ``order``."""
        key, order = self.key, self.order
        columns = [c for c in incoming.columns if c not in (key, order)]
        incoming = incoming.filter(F.col(key).isNotNull() & F.col(order).isNotNull()).withColumns({"_at": self.partition, "_bucket": self.bucket})
        m, affected = self.manifest(), []
        if m["index"]:
            touched = [r._bucket for r in incoming.select("_bucket").distinct().collect()]  # names of buckets
            index = self.index(touched)
            if index is not None:
                index = F.broadcast(index) if is_small(index) else index.hint("merge")  # by a count: its compressed files look small for their rows
                known = incoming.select(key).join(index, key).select("_stored").distinct()  # copies of one message: the streamed side, which AQE splits
                affected = sorted(r._stored for r in known.collect() if r._stored in m["parts"])  # names of partitions
        rows = incoming.withColumn("_stored", F.lit(None).cast("string"))
        stored = self.rows(affected) if affected else None
        if stored is not None:
            rows = rows.unionByName(stored.withColumn("_stored", F.col("_part")).withColumns({"_at": F.col("_part"), "_bucket": self.bucket}).drop("_part"))
        # combined map-side: a message delivered a million times enters the shuffle once a task
        best = rows.groupBy(key).agg(
            F.min(F.struct(order, "_at", *columns)).alias("w"), F.max("_stored").alias("_stored"), F.max("_bucket").alias("_bucket"),
            F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_stored").isNotNull(), F.col(order))).alias("was"),
        )
        place = F.coalesce("_stored", "w._at")
        nothing = {c: F.lit(None).cast(incoming.schema[c].dataType) for c in columns}
        shape = lambda kind, part, at, to=None, own=None: F.struct(F.lit(kind).alias("_kind"), part.alias("_part"), at.cast(incoming.schema[order].dataType).alias(order), (to if to is not None else F.lit(None).cast("string")).alias("_stored"), *((own or nothing)[c].alias(c) for c in columns))
        all_ = F.array(
            shape("data", place, F.col(f"w.{order}"), own={c: F.col(f"w.{c}") for c in columns}),
            F.when(F.col("_stored").isNull(), shape("index", F.col("_bucket"), F.lit(None), place)),
            F.when(F.col("n") > 1, shape("repeated", F.lit("all"), F.col(f"w.{order}"))),
            F.when(F.col("was") != F.col(f"w.{order}"), shape("beaten", F.lit("all"), F.col("was"))),
        )
        out = best.select(key, F.inline(F.array_compact(all_))).hint("rebalance", "_kind", "_part")  # whole files for each folder, hot ones split
        folder = f"merges/{m['next']}-{uuid.uuid4().hex}"
        out.write.partitionBy("_kind", "_part").parquet(f"{self.root}/{folder}")
        schema = StructType([incoming.schema[c] for c in (key, order, *columns)]).add("_part", "string")
        parts = self._folders(folder, "data")
        index = {**m["index"]}
        for b, f in self._folders(folder, "index").items():
            index[b] = [*index.get(b, []), f]
        self._publish(m["next"], {"parts": m["parts"] | parts, "index": index, "schema": json.loads(schema.json())})
        if long := [b for b, own in index.items() if len(own) > FRAGMENTS]:
            self._compact_index(long)
        return self._losers(incoming.select(key, order), folder, schema)

    def _folders(self, folder: str, kind: str) -> dict[str, str]:
        names = [n for n in list_names(self.spark, f"{self.root}/{folder}/_kind={kind}") if n.startswith("_part=")]
        return {unquote(n.removeprefix("_part=")): f"{folder}/_kind={kind}/{n}" for n in names}

    def _publish(self, number: int, state: dict) -> None:
        put_once(self.spark, f"{self.root}/manifests/{number}.json", json.dumps({"version": number, **state}))

    def _losers(self, incoming: DataFrame, folder: str, schema: StructType) -> DataFrame:
        """Orders are unique, so losers are found by them, and only among messages with copies: no group of one identifier is gathered."""
        key, order = self.key, self.order
        none = self.spark.createDataFrame([], schema).select(order)
        pairs = self._folders(folder, "repeated")
        if not pairs:
            return none
        repeated = self._read(pairs, schema).select(key, F.col(order).alias("_won"))
        lost = lookup_join(incoming, repeated, [key], "inner", F.col(order)).filter(F.col(order) != F.col("_won")).select(order)
        beaten = self._folders(folder, "beaten")
        return (lost.unionAll(self._read(beaten, schema).select(order)) if beaten else lost).distinct()

    def _compact_index(self, buckets: list[str]) -> None:
        """The fragments of each of these buckets as one."""
        m = self.manifest()
        folder = f"merges/{m['next']}-{uuid.uuid4().hex}"
        rows = self.index(buckets).withColumns({"_kind": F.lit("index"), "_part": self.bucket})
        rows.hint("rebalance", "_part").write.partitionBy("_kind", "_part").parquet(f"{self.root}/{folder}")
        merged = self._folders(folder, "index")
        self._publish(m["next"], {"parts": m["parts"], "index": m["index"] | {b: [f] for b, f in merged.items()}, "schema": m["schema"]})

    def vacuum(self) -> int:
        """Remove the folders that the current manifest doesn't name: replaced partitions, merged fragments and what lost merges left. Not while others read older states or merge."""
        m, gone = self.manifest(), 0
        named = {*m["parts"].values(), *(f for own in m["index"].values() for f in own)}
        for name in list_names(self.spark, f"{self.root}/merges"):
            for kind in list_names(self.spark, f"{self.root}/merges/{name}"):
                for part in list_names(self.spark, f"{self.root}/merges/{name}/{kind}") if kind.startswith("_kind=") else ():
                    if part.startswith("_part=") and f"merges/{name}/{kind}/{part}" not in named:
                        remove(self.spark, f"{self.root}/merges/{name}/{kind}/{part}")
                        gone += 1
            if not any(f.startswith(f"merges/{name}/") for f in named):
                remove(self.spark, f"{self.root}/merges/{name}")
        return gone


def duplicates(changes: DataFrame, root: str, partition: Column, identity: list[str], arrival: str = "batch_id", order: str = "delivery_id", key: str = "log_offset") -> DataFrame:
    """Deliveries other than the counting one of their message: ``order`` bigint.

    The deliveries enter a DeliveryStore in two loads, the later half of the ``arrival`` numbers against the store of the earlier half; ``identity``
    columns are stored beside key and order. A message is what one ``key`` stands for: record and transaction ids are
    kept and reported, but a redelivery may lack or change them. Null arrivals belong to the earlier load; an empty log gives no rows.
    The index buckets are the source's log files.
    """
    spark = changes.sparkSession
    ends = changes.agg(F.min(arrival), F.max(arrival)).first()
    middle = (ends[0] + ends[1]) // 2 if ends[0] is not None else 0
    store = DeliveryStore(spark, root, partition, key, order, F.shiftright(key, 44))
    rows = changes.select(order, key, arrival, *identity, *[c for c in ["arrived_at"] if c in changes.columns and c not in identity])
    first = store.merge(rows.filter(F.col(arrival).isNull() | (F.col(arrival) <= middle)))
    second = store.merge(rows.filter(F.col(arrival) > middle))
    return first.select(order).unionAll(second.select(order))
