"""Attributes as known at the position of an event: ASOF joins inside hash partitions of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.plans.common import lookup_join, materialize

#: Events of one bucket; bounds what one embedded join holds.
BUCKET_EVENTS = 150_000

_SQL = """
with versions as (  -- what was current as soon as each revision was both valid and entered; prior ties are resolved
    select table_id, available, max(state) over (partition by table_id order by available) as state
    from (select table_id, greatest(start_offset, known_offset) as available, max({{'s': start_offset, 'k': known_offset, 'r': revision_id}}) as state
          from attrs group by table_id, available)
), restated as (
    select table_id, start_offset, max({{'k': known_offset, 'r': revision_id}}) as state from attrs group by table_id, start_offset
)
select e.log_offset, v.state.r as known_revision, s.state.r as restated_revision
from events e
asof left join versions v on e.table_id = v.table_id and e.log_offset >= v.available
asof left join restated s on e.table_id = s.table_id and e.log_offset >= s.start_offset
{where}
"""


def _joined(where: str):
    def run(events, attrs):
        import shutil
        import tempfile

        import duckdb

        spill = tempfile.mkdtemp(prefix="asof-")  # private to this task and gone with it
        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": spill})
        try:
            con.register("events", events)
            con.register("attrs", attrs)
            found = con.sql(_SQL.format(where=where)).arrow()
            return found.read_all() if hasattr(found, "read_all") else found
        finally:
            con.close()
            shutil.rmtree(spill, ignore_errors=True)

    return run


def attributes_at(events: DataFrame, revisions: DataFrame, only_restated: bool = False, bucket_events: int = BUCKET_EVENTS) -> DataFrame:
    """Each event (table_id, log_offset; one row for each log_offset) with the revision known at its position and the one restated since:
    log_offset, known_revision, restated_revision.

    A revision is valid from start_offset and entered at known_offset. Known at an event is the revision with the greatest (start_offset,
    known_offset) of those valid and entered by then; restated is the same over all those valid by then. Ties on both offsets fall to the greater
    revision_id; repeated rows count once. Revisions with a null table or offset say nothing; an event without a revision keeps
    nulls, one without table_id too. ``only_restated`` keeps the events for which the two differ.

    Entities are hashed to buckets of about ``bucket_events`` events; an entity with more is spread over several, each with a copy of its revisions.
    """
    events = materialize(events.select("table_id", "log_offset").filter(F.col("log_offset").isNotNull()), "events")  # two narrow columns, read twice
    revisions = revisions.select("table_id", "start_offset", "known_offset", "revision_id").dropna(subset=["table_id", "start_offset", "known_offset"]).distinct()
    per = materialize(events.groupBy("table_id").agg(F.count(F.lit(1)).alias("n")), "entities")
    total = per.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_events))
    spread = per.filter(F.col("n") > bucket_events).select("table_id", F.ceil(F.col("n") / bucket_events).cast("int").alias("parts"))
    own = F.coalesce("parts", F.lit(1))
    bucket = F.pmod(F.xxhash64("table_id", "part"), F.lit(n_buckets)).cast("int")
    left = lookup_join(events, spread, ["table_id"], "left", F.col("log_offset"))
    left = left.withColumn("part", F.pmod(F.xxhash64("log_offset"), own.cast("long")).cast("int")).select("table_id", "log_offset", bucket.alias("bucket"))
    right = lookup_join(revisions, spread, ["table_id"], "left", F.col("start_offset")).withColumn("part", F.explode(F.sequence(F.lit(0), own - 1)))
    right = right.select("table_id", "start_offset", "known_offset", "revision_id", bucket.alias("bucket")).distinct()
    where = "where known_revision is distinct from restated_revision" if only_restated else ""
    joined = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(_joined(where), "log_offset bigint, known_revision bigint, restated_revision bigint")
    return joined
