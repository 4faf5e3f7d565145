"""Usage and cost accounting over JSON-lines logs and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Dollars per million tokens (in, out) by model prefix; the first prefix that fits wins.
PRICES = [
    ("gpt-5.4-mini", 0.75, 4.50), ("gpt-5.4", 2.50, 15.00), ("gpt-4o-mini", 0.15, 0.60), ("gpt-4.1-mini", 0.40, 1.60), ("gpt-4.1-nano", 0.10, 0.40),
    ("gpt-4.1", 2.00, 8.00), ("gpt-4o", 2.50, 10.00), ("gpt-4-turbo", 10.00, 30.00), ("gpt-3.5-turbo", 0.50, 1.50),
]


def usage_counts(body: Column) -> Column:
    """Struct of prompt, completion and total tokens of a JSON answer, under either spelling."""
    get = lambda *names: F.coalesce(*[F.get_json_object(body, f"$.usage.{n}").try_cast("bigint") for n in names])
    p, c = get("prompt_tokens", "input_tokens"), get("completion_tokens", "output_tokens")
    return F.struct(p.alias("prompt"), c.alias("completion"), F.coalesce(get("total_tokens"), p + c).alias("total"))


def price(model: Column, prices: list[tuple[str, float, float]] = PRICES) -> Column:
    """Struct ``inp, out`` of the first prefix that the model name starts with; null if none does."""
    m = F.lower(F.trim(model))
    found = F.filter(F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(i).alias("inp"), F.lit(o).alias("out")) for p, i, o in prices]), lambda e: F.startswith(m, e["prefix"]))
    return F.try_element_at(found, F.lit(1))


def estimate_cost(model: Column, prompt: Column, completion: Column, rates: tuple[float, float] | None = None) -> Column:
    """Struct ``cost, note``: given rates win over the table; unknown models and missing counts cost nothing known."""
    p = F.struct(F.lit(rates[0]).alias("inp"), F.lit(rates[1]).alias("out")) if rates else price(model)
    cost = F.round((prompt * p["inp"] + completion * p["out"]) / 1_000_000, 6)
    note = F.when(prompt.isNull() | completion.isNull(), "missing_token_counts").when(cost.isNull(), "unknown_model").otherwise("given_rates" if rates else "table_rates")
    return F.struct(cost.alias("cost"), note.alias("note"))


def summary(logs: DataFrame) -> DataFrame:
    """Lines, token sums, cost sum and lines that carry a cost."""
    return logs.agg(F.count(F.lit(1)).alias("lines"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count("cost_usd").alias("lines_with_cost"))


def cost_by_folder(logs: DataFrame, folder: str = "deal_folder", cost: str = "cost_usd") -> DataFrame:
    d = logs.filter(F.col(cost).isNotNull() & (F.trim(folder) != ""))
    return d.groupBy(F.trim(folder).alias(folder)).agg(F.round(F.sum(cost), 6).alias(cost))


def latest_run_cost(logs: DataFrame, order: list[str], stream: list[str], folder: str = "deal_folder", cost: str = "cost_usd") -> DataFrame:
    """Cost of each folder's last contiguous run of lines within its log stream.

    Lines without cost or folder don't break a run. The order is that of one
    log; ``stream`` names the columns that tell logs apart, so the window is
    bounded by a log and not by the table.
    """
    d = logs.filter(F.col(cost).isNotNull() & (F.trim(folder) != "")).withColumn(folder, F.trim(folder))
    w = Window.partitionBy(*stream).orderBy(*order)
    starts = F.when(F.lag(folder).over(w) == F.col(folder), 0).otherwise(1)
    d = d.withColumn("__new", starts).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.groupBy(*stream, folder, "__run").agg(F.round(F.sum(cost), 6).alias(cost))
    return runs.groupBy(*stream, folder).agg(F.max_by(cost, "__run").alias(cost))


def _json(schema: str, broken: str) -> Column:
    """The struct of a text ``value``, with the text itself in ``broken`` where it is no such object."""
    return F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken})


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """``batch_id, source, finished_at, costs, folder_names`` of manifests, a JSON object a file.

    Folder names lose spaces at the ends; costs that are no number and empty
    names are left out; of names that become equal the last stays. A file
    that is no JSON object is dropped.
    """
    schema = "batch_id string, source string, finished_at string, costs map<string, string>, folder_names array<string>, _corrupt_record string"
    d = spark.read.text(path, wholetext=True).select(_json(schema, "_corrupt_record").alias("m")).select("m.*").filter("_corrupt_record is null")
    pairs = F.transform(F.map_entries(F.coalesce("costs", F.create_map().cast("map<string, string>"))), lambda e: F.struct(F.trim(e["key"]).alias("key"), e["value"].try_cast("double").alias("value")))
    pairs = F.filter(pairs, lambda e: (e["key"] != "") & e["value"].isNotNull())
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda x: x["key"] == e["key"]))
    return d.withColumn("costs", F.map_from_entries(last)).drop("_corrupt_record")


def latest_manifests(manifests: DataFrame, source: str | None = None) -> DataFrame:
    """The manifest that finished last of each source, or of one; of equal times the greatest batch."""
    d = manifests if source is None else manifests.filter(F.col("source") == source)
    row = F.struct(*manifests.columns)
    return d.groupBy("source").agg(F.max_by(row, F.struct("finished_at", "batch_id")).alias("m")).select("m.*")


def manifest_costs(manifests: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """``batch_id, deal_folder, cost_usd`` of manifests, limited to the asked folders."""
    d = manifests.select("batch_id", F.explode("costs").alias("deal_folder", "cost_usd"))
    return d if folders is None else d.join(folders.select("deal_folder"), "deal_folder", "left_semi")


def filled_costs(manifest: DataFrame, logs: DataFrame) -> DataFrame:
    """Costs of the manifest, filled from the latest log run where it has none."""
    d = manifest.select("deal_folder", F.col("cost_usd").alias("m")).join(logs.select("deal_folder", F.col("cost_usd").alias("l")), "deal_folder", "full")
    return d.select("deal_folder", F.coalesce("m", "l").alias("cost_usd"), F.when(F.col("m").isNotNull(), "manifest").otherwise("log").alias("origin"))


def pipeline_label(folder: Column, in_agent_costs: Column, in_model_costs: Column, batch_source: Column) -> Column:
    """Which pipeline made a folder: by suffix, by which costs list it, by the batch."""
    name = F.lower(folder)
    return F.when(name.endswith("_sdk"), "SDK").when(name.endswith("_llm"), "LLM").when(in_agent_costs & ~in_model_costs, "SDK").when(in_model_costs & ~in_agent_costs, "LLM").otherwise(F.upper(F.coalesce(batch_source, F.lit(""))))


LOG_SCHEMA = "ts string, model string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, cost_usd double, pricing_note string, deal_folder string, draft_target string, mode string"


def read_logs(spark: SparkSession, path: str, tag: bool = False) -> DataFrame:
    """Usage lines. Broken ones are dropped, or with ``tag`` kept whole in ``bad_line`` (null for good ones)."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    d = lines.select(_json(LOG_SCHEMA + ", bad_line string", "bad_line").alias("m")).select("m.*")
    return d if tag else d.filter("bad_line is null").drop("bad_line")
