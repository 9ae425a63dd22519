"""Reading requests from JSON and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ingest


def read_requests(spark: SparkSession, path: str, max_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """Add requests from JSON lines: (valid ones, rejected ones with their error). Lines of more than max_bytes are rejected as body."""
    rows = spark.read.text(path).withColumnRenamed("value", "payload")
    rows = rows.withColumn("payload", F.when(F.octet_length("payload") <= max_bytes, F.col("payload")).otherwise(""))
    checked = ingest.validate_add(rows)
    return checked.where("error IS NULL").drop("error", "payload"), checked.where("error IS NOT NULL").select("payload", "error")


def evidence_json(rows: DataFrame, provenance: bool = False) -> DataFrame:
    """One JSON text per hit, without null fields."""
    fields = [F.col("doc_id").alias("id"), "content", "score", "view", F.col("source_ids").alias("source_message_ids"), "evidence_flags", "channel_ranks", *(["provenance"] if provenance else [])]
    return rows.select("query_id", "position", F.to_json(F.struct(*fields)).alias("value"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The same table as JSON and CSV."""
    metrics.write.mode("overwrite").json(f"{path}/json")
    metrics.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def markdown(metrics: DataFrame, rows: int = 200) -> str:
    """A small table of metrics as text; the report shows at most rows rows."""
    lines = [metrics.columns, ["-"] * len(metrics.columns), *[["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in metrics.limit(rows).collect()]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
