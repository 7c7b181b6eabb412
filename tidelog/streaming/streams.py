"""Streams over a change log: the main stream, streams generated from it, and stateful windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelog.plans.common import materialize

MAIN, GENERATED = "main", "generated"


class Streams:
    """Streams kept under one folder: main/ holds what is taken in, generated/<name> what jobs derive from other streams.

    A job is a function from its source streams to a DataFrame. Each has its own checkpoint, so it goes on where it stopped and every
    batch counts once.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{MAIN}" if name == MAIN else f"{self.root}/{GENERATED}/{name}"

    def follow(self, name: str, max_files: int = 1_000) -> DataFrame:
        """A stream as it grows."""
        schema = self.spark.read.parquet(self.path(name)).schema
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(self.path(name))

    def take_in(self, source: DataFrame, name: str = MAIN) -> None:
        """Run what ``source`` has so far into a stream."""
        query = source.writeStream.format("parquet").option("checkpointLocation", f"{self.root}/checkpoints/{name}").option("path", self.path(name)).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    def job(self, name: str, sources: list[str], define: Callable[..., DataFrame], mode: str = "append") -> None:
        """Derive a stream from others, up to what they hold now. In ``complete`` mode the result replaces the one before."""
        result = define(*(self.follow(s) for s in sources))
        writer = result.writeStream.option("checkpointLocation", f"{self.root}/checkpoints/{name}").trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").option("path", self.path(name)).outputMode("append").start()
        else:
            path = self.path(name)
            query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
        query.awaitTermination()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def sql_job(text: str) -> Callable[..., DataFrame]:
    """A job defined by SQL over its sources, named s1, s2, ..."""

    def define(*sources: DataFrame) -> DataFrame:
        for k, s in enumerate(sources, 1):
            s.createOrReplaceTempView(f"s{k}")
        return sources[0].sparkSession.sql(text)

    return define


def with_heartbeat(stream: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Event time with a bound on lateness; heartbeat records (type 16) move it on while nothing else comes, and are dropped.

    A filter on the type alone would be pushed below the watermark, which would then see no heartbeats; this one looks at the time too and stays
    above. Rows without type are kept; rows without time move nothing.
    """
    beat = F.col("rec_type").eqNullSafe(16)
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).filter(~beat | F.col(time).isNotNull())
    return timed.withWatermark(time, delay).filter(~beat | F.col(time).isNull())


class CountWindow(StatefulProcessor):
    """Windows of a number of rows of a key, as rows come; a window is put out when it is full. Only count and total of the open one are kept.

    Values are whole numbers (of the smallest unit) and are summed by window for a whole Arrow batch at once, in two halves that don't overflow.
    """

    HALF = 10**9

    def __init__(self, rows: int, value: str):
        self.rows, self.value = rows, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "number long, n long, high long, low long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        number, n, high, low = self.state.get() if self.state.exists() else (0, 0, 0, 0)
        for frame in rows:
            values = frame[self.value].fillna(0).to_numpy(np.int64)
            if not len(values):
                continue
            starts = np.concatenate([[0], np.arange(self.rows - n, len(values), self.rows)])
            highs, lows = np.add.reduceat(values // self.HALF, starts), np.add.reduceat(values % self.HALF, starts)
            highs[0], lows[0] = highs[0] + high, lows[0] + low
            counts = np.diff(np.append(starts, len(values)))
            counts[0] += n
            full = int(counts[-1] == self.rows) + len(counts) - 1
            if full:
                yield pd.DataFrame({"key": key[0], "number": np.arange(number, number + full), "n": self.rows, "high": highs[:full], "low": lows[:full]})
            number += full
            n, high, low = (int(counts[-1]), int(highs[-1]), int(lows[-1])) if full < len(counts) else (0, 0, 0)
        self.state.update((number, n, high, low))

    def close(self) -> None:
        """Nothing is held outside the state."""


def count_windows(stream: DataFrame, key: str, value: str, rows: int) -> DataFrame:
    """Full windows of ``rows`` rows for each key: key, number, n, total (to four places; a null value adds nothing). Needs the RocksDB state store."""
    units = stream.select(F.col(key).cast("string").alias("window_key"), (F.col(value).cast("decimal(18,4)") * 10_000).cast("bigint").alias("units"))
    full = units.groupBy("window_key").transformWithStateInPandas(CountWindow(rows, "units"), "key string, number bigint, n bigint, high bigint, low bigint", "Append", "None")
    whole = F.col("high").cast("decimal(24,0)") * F.lit(CountWindow.HALF) + F.col("low")
    return full.select("key", "number", "n", (whole.cast("decimal(34,0)") * F.expr("0.0001BD")).cast("decimal(38,4)").alias("total"))


def _ended(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("rec_type").isin(6, 7) & F.col("txn_id").isNotNull()).select("txn_id")


def whole_transactions(batch: DataFrame, held: DataFrame | None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages of transactions that have ended, messages still held back) of a batch and what was held before.

    ``known`` holds the txn_id of those that ended in earlier batches: a message that comes after the end of its transaction goes out at once.
    """
    rows = batch if held is None else held.unionByName(batch)
    ended = (_ended(rows) if known is None else _ended(rows).unionAll(known)).distinct()
    free = rows.filter(F.col("txn_id").isNull())
    own = rows.filter(F.col("txn_id").isNotNull())
    done = own.join(ended, "txn_id", "left_semi").select(rows.columns)
    return done.unionByName(free), own.join(ended, "txn_id", "left_anti").select(rows.columns)


def transaction_sink(spark: SparkSession, root: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that publishes whole transactions only: done/batch=N, with the open ones in held/N for the next batch.

    Transactions that ended in an earlier batch are known by ended/batch=N, one number for each, so messages that land later are published too.
    A repeated batch reads what batch N - 1 held and those before it ended, and writes the same again.
    """

    def take(batch: DataFrame, number: int) -> None:
        from tidelog.plans.files import exists

        before = f"{root}/held/{number - 1}"
        held = spark.read.schema(batch.schema).parquet(before) if exists(spark, before) else None
        known = None
        if number and exists(spark, f"{root}/ended"):
            known = spark.read.schema(batch.select("txn_id").schema.add("batch", "long")).parquet(f"{root}/ended").filter(F.col("batch") < number).select("txn_id")
        _ended(batch).distinct().write.mode("overwrite").parquet(f"{root}/ended/batch={number}")
        done, rest = whole_transactions(batch, held, known)
        rest.write.mode("overwrite").parquet(f"{root}/held/{number}")
        done.write.mode("overwrite").parquet(f"{root}/done/batch={number}")

    return take


#: Errors of the target after which a transaction is tried again, and those that are passed over (what is there already, or gone already, as a definition).
RETRY_ERRORS = frozenset({1040, 1205, 1213, 2002, 2003, 2006, 2013})
PASS_ERRORS = frozenset({1007, 1008, 1050, 1051, 1146})
#: Fixed value: the error of a key that is there already.
DUPLICATE = 1062


def _code(error: Exception):
    return error.args[0] if error.args else None


class Applier:
    """Applies transactions to a target through ``connect()``, which gives an object with execute(text), commit(), rollback() and close().

    A transaction is applied whole, in the order of positions, and with it goes a row of its number and position in the ``positions`` table, in the same commit
    (``batch_commit`` transactions to a commit). That row tells what was applied: a transaction whose row is there already, from a run that was
    lost after its commit, is rolled back and left out. A key that is there already is an error anywhere else. ``dry_run`` executes nothing; ``print_sql`` shows the
    statements. An error in RETRY_ERRORS reconnects and repeats the uncommitted part, at most ``retries`` times; one in PASS_ERRORS is passed over.
    """

    def __init__(self, connect: Callable, batch_commit: int = 1, dry_run: bool = False, print_sql: bool = False, retries: int = 3, positions: str = "apply_state"):
        self.connect, self.batch_commit, self.dry_run, self.print_sql, self.retries, self.positions = connect, batch_commit, dry_run, print_sql, retries, positions

    def apply(self, rows: Iterator) -> int:
        """Apply rows with txn_id, log_offset and statement, those of a transaction side by side in order; the number of statements executed."""
        done, pending, target = 0, [], None
        for row in rows:
            if self.print_sql:
                print(row.statement)
            if not pending or pending[-1][0] != row.txn_id:
                if len(pending) == self.batch_commit:
                    target, n = self._send(target, pending)
                    done, pending = done + n, []
                pending.append((row.txn_id, []))
            pending[-1][1].append((row.log_offset, row.statement))
        if pending:
            target, n = self._send(target, pending)
            done += n
        if target is not None:
            target.close()
        return done

    def _send(self, target, transactions: list[tuple]):
        if self.dry_run:
            return None, 0
        for left in range(self.retries, -1, -1):
            try:
                target = target or self.connect()
                done = 0
                try:
                    for txn, statements in transactions:
                        self._mark(target, txn, statements[-1][0])
                        for _, text in statements:
                            self._execute(target, text)
                            done += 1
                    target.commit()
                    return target, done
                except _Applied:
                    target.rollback()
                    if len(transactions) == 1:
                        return target, 0
                # one of several was applied before: each by itself
                done = 0
                for one in transactions:
                    target, n = self._send(target, [one])
                    done += n
                return target, done
            except Exception as e:
                if not left or _code(e) not in RETRY_ERRORS:
                    raise
                target = None

    def _mark(self, target, txn, position: int) -> None:
        try:
            target.execute(f"INSERT INTO {self.positions} (`txn`, `position`) VALUES ({'NULL' if txn is None else txn}, {position})")
        except Exception as e:
            if _code(e) == DUPLICATE:
                raise _Applied from e
            raise

    def _execute(self, target, text: str) -> None:
        try:
            target.execute(text)
        except Exception as e:
            if _code(e) not in PASS_ERRORS:
                raise

    def apply_levels(self, statements: DataFrame, levels: DataFrame) -> int:
        """Apply statements (log_offset, txn_id, statement) in the order conflict_levels() gives (txn_id, segment, level): the transactions of a level side by side, each
        whole in one task, and a level only after the one before it is committed. The number of steps.

        The driver holds the numbers of the steps, not their transactions. A lost task or driver repeats its level: what was committed is told by its row.
        """
        rows = materialize(statements.join(levels, "txn_id"), "apply")
        applier = self
        steps = [tuple(r) for r in rows.select("segment", "level").distinct().orderBy("segment", "level").collect()]
        for segment, level in steps:
            step = rows.filter((F.col("segment") == segment) & (F.col("level") == level)).select("txn_id", "log_offset", "statement")
            step.repartition("txn_id").sortWithinPartitions("txn_id", "log_offset").foreachPartition(lambda part: applier.apply(part))
        return len(steps)

    def sink(self, conflicts: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function over statements of whole transactions; ``conflicts`` gives conflict_levels() of a batch."""

        def take(batch: DataFrame, _: int) -> None:
            self.apply_levels(batch, conflicts(batch))

        return take


class _Applied(Exception):
    """A transaction is in the target already."""
