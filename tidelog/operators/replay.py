"""Transactional replay of a change log into current state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.plans.common import DML, counting_messages, materialize

INSERT, UPDATE, DELETE, REPLACE, DDL, BEGIN, COMMIT, ROLLBACK = range(8)
_COLUMNS = ["record_id", "txn_id", "rec_type", "table_meta_id", "row_key", "old_key"]


def transactions(messages: DataFrame) -> DataFrame:
    """One row for each transaction: first_offset, last_offset, n_changes, commit_offset and rollback_offset (null while absent)."""
    at = lambda kind: F.min(F.when(F.col("rec_type") == kind, F.col("log_offset")))
    return (
        messages.filter(F.col("txn_id").isNotNull())
        .groupBy("txn_id")
        .agg(
            F.min("log_offset").alias("first_offset"),
            F.max("log_offset").alias("last_offset"),
            F.count_if(F.col("rec_type").isin(*DML)).alias("n_changes"),
            at(COMMIT).alias("commit_offset"),
            at(ROLLBACK).alias("rollback_offset"),
        )
    )


def first_gap(messages: DataFrame, sequence: str = "record_id", bucket_rows: int = 32_768) -> DataFrame:
    """The offset of the last message before the first missing number of a dense ``sequence``, as one row (held_after); no row where nothing is missing.

    Numbers are counted as bits of buckets (of at most 32,768), combined map-side, so that only the earliest bucket that lacks one is looked into: no number is
    shuffled but those of that bucket, and nothing grows with the width of a gap.
    """
    numbered = messages.filter(F.col(sequence).isNotNull()).select(F.col(sequence).alias("_n"), "log_offset", F.floor(F.col(sequence) / bucket_rows).cast("long").alias("_bucket"))
    bits = F.bitmap_count(F.bitmap_construct_agg(F.col("_n") - F.col("_bucket") * bucket_rows))
    per = numbered.groupBy("_bucket").agg(bits.alias("have"), F.min("_n").alias("lo"), F.max("_n").alias("hi"))
    per = materialize(per, "sequence")  # one row for each bucket, read twice
    following = per.select((F.col("_bucket") - 1).alias("_bucket"), F.col("lo").alias("next_lo"))
    # a bucket lacks a number inside, or the one after its last; the very last number lacks its successor too, and is told by _greatest
    lacks = (F.col("hi") - F.col("lo") + 1 > F.col("have")) | F.col("next_lo").isNull() | (F.col("next_lo") > F.col("hi") + 1)
    near = per.join(following, "_bucket", "left").agg(F.min(F.when(lacks, F.col("_bucket"))).alias("_bucket"), F.max("hi").alias("_greatest"))
    local = numbered.join(F.broadcast(near), "_bucket").groupBy("_n", "_greatest").agg(F.max("log_offset").alias("_at"))
    local = materialize(local, "bucket")  # one row is broadcast, one bucket is left, read twice
    successor = local.select((F.col("_n") - 1).alias("_n"), F.lit(True).alias("_next"))
    held = local.join(successor, "_n", "left").filter(F.col("_next").isNull() & F.col("_greatest").isNotNull())
    return held.agg(F.min_by("_at", "_n").alias("held_after"), F.min("_n").alias("_n"), F.max("_greatest").alias("_greatest")).filter("_n < _greatest").select("held_after")


def watermark(changes: DataFrame, sequence: str | None = "record_id", log_ended: bool = False) -> DataFrame:
    """The contiguous committed watermark as one row (through bigint).

    State may be exposed up to and with ``through``: below it every transaction has ended and no number of ``sequence`` (dense at the source and growing
    with log_offset; None: not checked) is missing. With ``log_ended`` nothing more will come: what is missing or open then stays so, holds nothing any longer,
    and the last watermark is the end of the log. An empty log gives a null.
    """
    return _watermark(counting_messages(changes, _COLUMNS), sequence, log_ended)


def _watermark(messages: DataFrame, sequence: str | None, log_ended: bool) -> DataFrame:
    txns = transactions(messages)
    open_from = txns.filter(F.col("commit_offset").isNull() & F.col("rollback_offset").isNull()).agg((F.min("first_offset") - 1).alias("at"))
    bounds = open_from.unionAll(messages.agg(F.max("log_offset").alias("at")))
    if sequence:
        bounds = bounds.unionAll(first_gap(messages, sequence).select(F.col("held_after").alias("at")))
    held = bounds.agg(F.min("at").alias("through"), F.max("at").alias("end"))
    return held.select((F.greatest("through", "end") if log_ended else F.col("through")).alias("through"))


def replay_state(changes: DataFrame, log_ended: bool = False, sequence: str | None = "record_id", through: int | None = None) -> DataFrame:
    """The rows each table holds after all whole committed transactions: table_id bigint, row_key string, log_offset bigint.

    Messages count once (smallest delivery_id). Transactions are assembled whole, each counting with its COMMIT; their changes apply by log_offset
    whatever the order of delivery. Only transactions whose COMMIT lies at or below watermark() are exposed: those behind a missing number of
    ``sequence`` or an open transaction are held. With ``log_ended`` the end of the log is the last watermark and releases what was held.
    ``through`` bounds the COMMITs further (time travel).

    Null transaction ids belong to no transaction; null keys and null table ids name no row; an empty old_key counts as not filled; an
    empty log gives no rows; further columns are ignored. Keys never conflict across (table, key), so each is folded on its own:
    the last touch wins, by a map-side combined maximum of ``log_offset * 2 + is_set``.
    """
    messages = materialize(counting_messages(changes, _COLUMNS), "messages")
    limit = _watermark(messages, sequence, log_ended).select(F.col("through").alias("_through"))  # one row
    ended = messages.filter((F.col("rec_type") == COMMIT) & F.col("txn_id").isNotNull())
    ended = ended.join(F.broadcast(limit), F.col("log_offset") <= F.col("_through"))
    if through is not None:
        ended = ended.filter(F.col("log_offset") <= through)
    committed = ended.select("txn_id").distinct()
    changed = messages.filter(F.col("rec_type").isin(*DML) & F.col("txn_id").isNotNull())
    changed = changed.select("txn_id", "rec_type", "log_offset", "row_key", "old_key", F.shiftright("table_meta_id", 16).alias("table_id"))
    applied = changed.join(committed, "txn_id", "left_semi")  # a hot transaction is split by AQE: it is the streamed side
    moved = (F.col("rec_type") == UPDATE) & (F.length("old_key") > 0) & ~F.col("old_key").eqNullSafe(F.col("row_key"))
    gone = F.when(moved, F.struct(F.col("old_key").alias("key"), F.lit(0).alias("is_set")))
    own = F.struct(F.col("row_key").alias("key"), F.when(F.col("rec_type") == DELETE, 0).otherwise(1).alias("is_set"))
    touches = applied.select("table_id", "log_offset", F.explode(F.array_compact(F.array(own, gone))).alias("t"))
    touches = touches.filter(F.col("t.key").isNotNull() & F.col("table_id").isNotNull())
    last = touches.groupBy("table_id", F.col("t.key").alias("row_key")).agg(F.max(F.col("log_offset") * 2 + F.col("t.is_set")).alias("last"))
    return last.filter(F.col("last") % 2 == 1).select("table_id", "row_key", F.shiftright("last", 1).alias("log_offset"))


def transaction_report(changes: DataFrame) -> DataFrame:
    """transactions() of a delivered log with ``outcome``: committed, rolled_back or open."""
    txns = transactions(counting_messages(changes, _COLUMNS))
    outcome = F.when(F.col("commit_offset").isNotNull(), "committed").when(F.col("rollback_offset").isNotNull(), "rolled_back").otherwise("open")
    return txns.withColumn("outcome", outcome)


__all__ = ["first_gap", "replay_state", "transaction_report", "transactions", "watermark"]
