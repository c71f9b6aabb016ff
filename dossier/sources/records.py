"""Record files and snapshots: writing, reading and rebuilding the index (SNK3-SNK6, PIP7, PIP20)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import decoded
from dossier.sources.files import read_files


def rendered(fields: dict[str, Column], body: Column) -> Column:
    """SNK4, SNK5: Markdown with front matter; fields that are null are left out."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.coalesce(body, F.lit("")))


def write_records(docs: DataFrame, month: Column, text: Column, path: str) -> None:
    """SNK4: rendered records by month; a repeated write replaces the months that it holds."""
    docs.select(month.alias("month"), text.alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").text(path)


def read_records(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """SRC17 natively: (path, fields map<string,string>, body) of Markdown files with simple front matter."""
    text = decoded(F.col("content"))["text"]
    parts = read_files(spark, path, pattern).select("path", text.alias("text"))
    head = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---\n?", 1)
    pairs = F.filter(F.split(head, "\n"), lambda line: line.rlike(r"^[\w-]+:"))
    fields = F.map_from_entries(F.transform(pairs, lambda line: F.struct(F.regexp_extract(line, r"^([\w-]+):", 1).alias("k"), F.trim(F.regexp_replace(line, r"^[\w-]+:\s*", "")).alias("v"))))
    return parts.select("path", fields.alias("fields"), F.regexp_replace("text", r"(?s)^---\n.*?\n---\n?", "").alias("body"))


def rebuild(spark: SparkSession, records: str, state: Callable[[], object], replace: Callable[[DataFrame], None], attempts: int = 3) -> bool:
    """PIP7, PIP20: reads the records and replaces the index, unless its state changed meanwhile; then once more."""
    for _ in range(attempts):
        before = state()
        found = read_records(spark, records).cache()
        found.count()
        if state() == before:
            replace(found)
            found.unpersist()
            return True
        found.unpersist()
    return False
