"""Retention, debounced batches, latest state and budgeted sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retention, sections, tables
from ..sources import corpus
from ..sources.corpus import table, with_views
from ..streaming.changes import debounced
from .catalog import query

_QUOTA = 10_000


@query(
    f"""WITH u AS (SELECT user_id AS key, max(ts) AS last_access, sum(length(props))::BIGINT AS bytes FROM events GROUP BY 1),
 r AS (SELECT *, sum(bytes) OVER (ORDER BY last_access, key) AS running, sum(bytes) OVER () AS total FROM u)
SELECT key, bytes, running::BIGINT AS running, total > {_QUOTA} AND total - (running - bytes) > {int(_QUOTA * 0.9)} AS evict FROM r"""
)
def retention_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which users' rows go so that the rest fits a quota, oldest access first."""
    usage = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("last_access"), F.sum(F.length("props")).alias("bytes"))
    return retention.evictions(usage, _QUOTA, 0.9, bucket=F.to_date("last_access")).select("key", "bytes", "running", "evict")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS batch FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS n_events, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS changed FROM s GROUP BY user_id, batch"""
)
def debounce_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events without a gap of ten minutes."""
    rows = debounced(table(spark, sf_dir, "events"), "user_id", "ts", "10 minutes", "event_type")
    return rows.withColumn("changed", F.array_join("changed", ","))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user: upsert semantics."""
    return tables.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value", "event_id"])


_ROWS = 40


@query(
    with_views("symbols")
    + f""", f AS (SELECT *, split_part(path, '/', 1) AS source FROM symbols WHERE kind = 'module'),
 c AS (SELECT source, size, 1.0::DOUBLE + size % 3 AS priority, size - 1 AS lacks FROM (SELECT source, count(*) AS size FROM f GROUP BY 1)),
 claims AS (SELECT source, priority, unnest(range(1, least(lacks, {_ROWS}) + 1)) AS k, lacks FROM c),
 met AS (SELECT source, row_number() OVER (ORDER BY k / (priority * lacks), priority DESC, source, k) AS place FROM claims),
 got AS (SELECT source, 1 + count(met.place) AS shown FROM c LEFT JOIN met USING (source) WHERE met.place IS NULL OR met.place <= {_ROWS} - (SELECT count(*) FROM c) GROUP BY 1),
 ranked AS (SELECT source, path, name, row_number() OVER (PARTITION BY source ORDER BY path) AS place FROM f)
SELECT ranked.source, path, name FROM ranked LEFT JOIN got USING (source) WHERE place <= coalesce(shown, 1)"""
)
def budget_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty rows dealt over sources by priority, one row of each at least."""
    s = corpus.symbols(table(spark, sf_dir, "documents")).filter("kind = 'module'").withColumn("source", F.substring_index("path", "/", 1))
    sizes = s.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("size"))
    shown = sections.allotted(sizes.withColumns({"priority": F.lit(1) + F.col("size") % 3, "min_keep": F.lit(1)}), _ROWS)
    return sections.take_sections(s.select("source", "path", "name"), "source", ["path"], shown)
