"""Append-only intake of quality issues.

Error events become issue rows: status is forced to ``open``, category and
severity come from the event payload, the issue id is the event id (the
ingest offset — no max+1 race between writers).  Rows whose site is unknown
or whose values are out of range go to a quarantine table with a reason.

The same ``intake_rows`` runs as a batch query and inside a Structured
Streaming ``foreachBatch``; each micro-batch is written to its own
``batch_id=N`` partition with overwrite, so a replayed batch (after a failure)
replaces its earlier output instead of duplicating it.

An event that comes again, in the same or a later batch, is taken once: the ids taken so far are kept beside the issues, and a
batch is checked against those of earlier batches.  Only ids no older than the watermark (the latest event time of earlier batches
less ``DELAY``) are read for it, so the state in use is bounded by the delay; an event older than
the watermark can no longer be told from a repeat and goes to quarantine as late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from headroom.functions.period import q_index_of_date, q_label

col = F.col

# Issue categories and the severity range.
CATEGORIES = ["facility", "equipment", "safety", "supply"]
SEVERITY_MIN, SEVERITY_MAX = 1, 5

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


#: How long after the latest event seen an event may still come.
DELAY = "INTERVAL 7 DAYS"


def intake_rows(events: DataFrame, sites: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Candidate issue rows with ``reason`` (null when valid); ``keep`` names event columns to carry along."""
    k = F.get_json_object("props", "$.k").cast("int")
    cat = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.pmod(k, F.lit(len(CATEGORIES))) + 1))
    cand = (events.where(col("event_type") == "error")
            .select(col("event_id").alias("issue_id"), col("user_id").alias("site_id"),
                    q_label(q_index_of_date("ts")).alias("quarter"), cat.alias("category"),
                    (F.pmod(k, F.lit(SEVERITY_MAX)) + SEVERITY_MIN).alias("severity"),
                    F.lit("open").alias("status"), F.to_date("ts").alias("reported_date"),
                    F.concat(F.lit("event "), col("event_id").cast("string"), F.lit(": "), col("props"))
                    .alias("description"), *keep))
    known = sites.select("site_id", F.lit(True).alias("_known"))
    df = cand.join(known, "site_id", "left")
    reason = (F.when(col("_known").isNull(), F.concat(F.lit("unknown site "), col("site_id").cast("string")))
              .when(col("category").isNull(), F.lit("missing category"))
              .when(~col("severity").between(SEVERITY_MIN, SEVERITY_MAX), F.lit("severity out of range")))
    return df.select("issue_id", "site_id", "quarter", "category", "severity", "status", "reported_date",
                     "description", reason.alias("reason"), *keep)


def valid_issues(rows: DataFrame) -> DataFrame:
    return rows.where(col("reason").isNull()).drop("reason")


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.where(col("reason").isNotNull()).select(
        col("issue_id").alias("event_id"), F.lit("events").alias("source"),
        F.to_json(F.struct("issue_id", "site_id", "quarter", "category", "severity", "description"),
                  {"ignoreNullFields": "false"}).alias("raw_row"), "reason")


def _seen_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """Ids and times taken by batches before this one (a replayed batch does not see itself)."""
    schema = "issue_id bigint, ts timestamp_ntz, batch_id bigint"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(col("batch_id") < batch_id)


def once(rows: DataFrame, seen: DataFrame, delay: str = DELAY) -> DataFrame:
    """``rows`` with ``repeat`` (of an event in ``seen``; further rows of one event in ``rows`` are dropped, the earliest stays)
    and ``late`` (older than the latest time in ``seen`` less ``delay``)."""
    mark = seen.agg((F.max("ts") - F.expr(delay)).cast("string")).first()[0]
    names = rows.columns
    first = (rows.where(col("issue_id").isNotNull()).groupBy("issue_id")
             .agg(F.min_by(F.struct(*names), F.struct("ts", "reported_date", "description")).alias("r"))
             .select("r.*").unionByName(rows.where(col("issue_id").isNull())))       # without an id no row repeats another
    if mark is None:
        return first.select("*", F.lit(False).alias("repeat"), F.lit(False).alias("late"))
    horizon = F.lit(mark).cast("timestamp_ntz")
    known = seen.where(col("ts") >= horizon).select("issue_id", F.lit(True).alias("repeat")).distinct()
    return first.join(known, "issue_id", "left").select(*names, F.coalesce("repeat", F.lit(False)).alias("repeat"),
                                                        F.coalesce(col("ts") < horizon, F.lit(False)).alias("late"))


def start_intake(spark: SparkSession, source_dir: str, sites: DataFrame, issues_path: str,
                 quarantine_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Stream the event directory into the issue and quarantine tables, each event once.  ``<issues_path>_seen`` holds
    the ids taken with their times, by batch."""
    stream = spark.readStream.schema(EVENTS_SCHEMA).parquet(source_dir)
    rows = intake_rows(stream, sites, keep=("ts",))
    seen_path = f"{issues_path.rstrip('/')}_seen"

    def write(batch: DataFrame, batch_id: int) -> None:
        sorted_out = once(batch, _seen_before(spark, seen_path, batch_id))
        sorted_out.persist()
        fresh = sorted_out.where(~col("repeat") & ~col("late"))
        late = sorted_out.where(col("late") & ~col("repeat")).withColumn("reason", F.lit("late: older than the watermark"))
        valid_issues(fresh.drop("ts", "repeat", "late")).write.mode("overwrite").parquet(f"{issues_path}/batch_id={batch_id}")
        quarantined(fresh.unionByName(late)).write.mode("overwrite").parquet(f"{quarantine_path}/batch_id={batch_id}")
        fresh.select("issue_id", "ts").write.mode("overwrite").parquet(f"{seen_path}/batch_id={batch_id}")
        sorted_out.unpersist()

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
