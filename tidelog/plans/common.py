"""Session helpers and join plans shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans.files import remove, remove_at_exit

#: Rows below which one side of a join may be broadcast. It is compared with a real count, never assumed.
BROADCAST_ROWS = 50_000

DML = (0, 1, 2, 3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that all executors see: spark.checkpoint.dir. Where it is unset a session on one machine gets a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder. All paths of an application lie in one folder, which goes when the application ends, or before with clear()."""
    root = f"{shared_dir(spark)}/tidelog/{spark.sparkContext.applicationId}"
    remove_at_exit(spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; no result that reads them may be needed any more."""
    remove(spark, f"{shared_dir(spark)}/tidelog/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in enough partitions for every core, for costly work on each row: shuffled only where its files give fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that many and one."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str, salt: Column, salts: int = 16, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join rows to a lookup side whose keys are unique or nearly so.

    The lookup is broadcast when a count proves it small. Otherwise both sides are shuffled, the left spread over
    ``salts`` by ``salt`` and the lookup repeated for each, so that a key with a third of all rows keeps no task busy.
    The hint keeps Spark from broadcasting it all the same: it estimates from the size of compressed files and doesn't count the repetitions.
    """
    if is_small(right, rows):
        return left.join(F.broadcast(right), on, how)
    left = left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


def counting_messages(changes: DataFrame, columns: list[str], key: str = "log_offset", order: str = "delivery_id") -> DataFrame:
    """One row for each message: its delivery with the smallest ``order``.

    A null key is no position and is left out; deliveries without ``order`` come last; ties fall to the smallest
    values of ``columns``. The minimum is combined map-side, so repeated deliveries of one message never meet in one task.
    """
    columns = [c for c in columns if c != key]
    late = F.coalesce(F.col(order), F.lit(2**63 - 1))
    first = F.min(F.struct(late.alias("_order"), *columns)).alias("_first")
    rows = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(first)
    return rows.select(key, *(F.col(f"_first.{c}").alias(c) for c in columns))
