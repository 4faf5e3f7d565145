"""Usage logs as a stream: running cost per folder and windowed token counts (an extension of ours)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "ts timestamp, model string, prompt_tokens bigint, completion_tokens bigint, cost_usd double, deal_folder string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines that arrive in a folder; broken lines come out as nulls and are dropped."""
    return spark.readStream.schema(LOG).json(path).filter("ts is not null")


def cost_by_folder(logs: DataFrame) -> DataFrame:
    return logs.filter("cost_usd is not null and trim(deal_folder) <> ''").groupBy(F.trim("deal_folder").alias("deal_folder")).agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count(F.lit(1)).alias("lines"))


def tokens_by_window(logs: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows; lines later than the watermark are dropped and closed windows leave the state."""
    g = logs.withWatermark("ts", late).groupBy(F.window("ts", length), "model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return g.select(F.col("window.start").alias("start"), "model", "prompt_tokens", "completion_tokens")


def run_available(frame: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Process what is there, then stop; the checkpoint makes reruns continue."""
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
