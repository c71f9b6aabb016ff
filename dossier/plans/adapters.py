"""The test tables as documents, labels, events and steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to tasks: a table of a few MB with costly rows would else be one task's or two tasks' work."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind, value): language and sender of documents, quality and toxicity as topics."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(F.struct(F.lit("language").alias("kind"), F.col("lang").alias("value")), F.struct(F.lit("sender").alias("kind"), F.col("source").alias("value")))))
    some = table(spark, sf_dir, "labels").select("doc_id", F.inline(F.array(*[F.struct(F.lit("topic").alias("kind"), F.concat(F.lit(f"{c}:"), F.col(c).cast("string")).alias("value")) for c in ("quality", "toxic")])))
    return docs.unionByName(some).where("value IS NOT NULL")


LABELS_SQL = """labelled AS (
  SELECT doc_id, 'language' AS kind, lang AS value FROM documents WHERE lang IS NOT NULL
  UNION ALL SELECT doc_id, 'sender', source FROM documents WHERE source IS NOT NULL
  UNION ALL SELECT doc_id, 'topic', 'quality:' || quality FROM labels WHERE quality IS NOT NULL
  UNION ALL SELECT doc_id, 'topic', 'toxic:' || toxic FROM labels WHERE toxic IS NOT NULL)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trace steps: a user's events are a trace, the type is the stage."""
    events = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 20, "warn").otherwise("ok")
    return events.select(F.col("event_id"), F.col("user_id").alias("trace_id"), F.col("event_type").alias("stage"), status.alias("status"), F.col("value").alias("duration_ms"), F.col("ts").cast("timestamp").alias("at"))


STEPS_SQL = """steps AS (SELECT event_id, user_id AS trace_id, event_type AS stage,
  CASE WHEN event_type = 'error' THEN 'error' WHEN value > 20 THEN 'warn' ELSE 'ok' END AS status, value AS duration_ms, ts AS at FROM events)"""
