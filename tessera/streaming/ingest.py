"""Streaming twins of ingestion: micro-batches through the ledger, and segmentation as state per session."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import ids
from tessera.operators import ingest, views
from tessera.operators.cut import folder

STATE = "seg_index long, seg_start long, seg_count long, last_ts_ms long, next_seq long"
SEGMENT = "user_id string, session_id string, id string, seq long, segment long, role string, content string, ts_ms long"


def segment_rows(key: tuple, rows: pd.DataFrame, state: tuple | None, config: Config) -> tuple[list[tuple], tuple]:
    """The rows of a session that follow what state has seen, with their segments; and the state after them."""
    number, start, count, last, following = state or (0, 0, 0, None, 0)
    gap_ms, out = max(0, config.segment_max_gap_seconds) * 1000, []
    for r in rows.sort_values("seq").itertuples():
        ts = None if pd.isna(r.ts_ms) else int(r.ts_ms)
        late = bool(gap_ms) and last is not None and ts is not None and ts - last > gap_ms
        if count and (count >= config.segment_max_messages or late):
            number, start, count = number + 1, int(r.seq), 0
        count += 1
        last = ts if ts is not None else last
        following = int(r.seq) + 1
        out.append((*key, r.id, int(r.seq), number, r.role, r.content, ts))
    return out, (number, start, count, last, following)


def stream_segmented(messages: DataFrame, config: Config) -> DataFrame:
    """A stream of numbered messages with their segments; state per session, kept without bound, since a session may go on at any time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        out, after = segment_rows(key, rows, state.get if state.exists else None, config)
        state.update(after)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENT.split(", ")])

    return messages.groupBy("user_id", "session_id").applyInPandasWithState(step, SEGMENT, STATE, "append", "NoTimeout")


def segments_of(rows: DataFrame) -> DataFrame:
    """Segment views of rows that have a segment number."""
    made = views._collected(rows.groupBy("user_id", "session_id", "segment"))
    return made.select(ids.segment_id(F.col("user_id"), F.col("session_id"), F.col("segment")).alias("view_id"), "user_id", "session_id", "content", "source_ids", "start_seq", "end_seq")


def scratch(spark: SparkSession) -> str:
    return f"{folder(spark)}/stream-{uuid.uuid4().hex}"


def replay(messages: DataFrame, config: Config, batches: int = 2) -> DataFrame:
    """messages as a file stream in the order of seq, a batch after the other, and the segment views that its state made."""
    spark, root = messages.sparkSession, scratch(messages.sparkSession)
    schema = messages.schema
    cut = messages.withColumn("_b", F.least(F.floor(F.col("seq") / 4), F.lit(batches - 1)))
    for b in range(batches):
        cut.where(F.col("_b") == b).drop("_b").write.mode("append").parquet(f"{root}/in")
        stream = stream_segmented(spark.readStream.schema(schema).parquet(f"{root}/in"), config)
        q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return segments_of(spark.read.parquet(f"{root}/out"))


def add_stream(requests: DataFrame, tables: str, config: Config, checkpoint: str):
    """A streaming query that adds each micro-batch of requests (request_id, user_id, session_id, messages, arrival) to the tables under a path: ledger, messages, conflicts.

    A batch is written under its number and read back by number, so a batch that runs twice writes the same rows once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def before(name: str, schema: str) -> DataFrame:
            try:
                return spark.read.option("basePath", f"{tables}/{name}").parquet(f"{tables}/{name}").where(F.col("batch") < number).drop("batch")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
                return spark.createDataFrame([], schema)

        ledger = before("ledger", "request_id string, user_id string, payload_hash string")
        held = before("messages", "user_id string, session_id string, seq long")
        counts = held.groupBy("user_id", "session_id").agg((F.max("seq") + 1).alias("msg_count"))
        judged = ingest.judge(batch, ledger).persist()
        new = judged.where("verdict = 'new'")
        put = lambda rows, name: rows.write.mode("overwrite").parquet(f"{tables}/{name}/batch={number}")
        put(ingest.numbered(new, counts), "messages")
        put(judged.where("verdict = 'conflict'").select("request_id", "user_id"), "conflicts")
        put(new.select("request_id", "user_id", "payload_hash"), "ledger")
        judged.unpersist()

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
