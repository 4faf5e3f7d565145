"""Match rates, statuses and picks over reconciled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.scalars import percent_of


def match_rates(diffs: DataFrame, key: str = "deal_key", total: str = "TOTAL") -> DataFrame:
    """``key, field, compared, matched, rate`` per deal, and over all deals under ``total``.

    ``diffs`` is long: key, ``field``, ``diff``. Empty differences were not
    compared and count nowhere. One grouping-sets pass gives both levels.
    """
    name = F.when(F.grouping(key) == 1, total).otherwise(F.col(key).cast("string"))
    g = diffs.groupingSets([[F.col(key), F.col("field")], [F.col("field")]], F.col(key), F.col("field")).agg(
        name.alias("__name"), F.count_if(F.col("diff") != "").alias("compared"), F.count_if(F.col("diff") == "match").alias("matched")
    )
    g = g.select(F.col("__name").alias(key), "field", "compared", "matched")
    return g.withColumn("rate", percent_of(F.col("matched"), F.col("compared")))


def map_rates(resolved: DataFrame, key: str = "deal_key") -> DataFrame:
    """``key, class_rows, mapped_ok, unmapped, ambiguous, rate, status`` per deal."""
    n = lambda s: F.count_if(F.col("status") == s)
    g = resolved.groupBy(key).agg(F.count(F.lit(1)).alias("class_rows"), n("ok").alias("mapped_ok"), n("unmapped").alias("unmapped"), n("ambiguous").alias("ambiguous"))
    status = F.when(F.col("mapped_ok") == 0, "missing").when(F.col("mapped_ok") < F.col("class_rows"), "partial").otherwise("ok")
    return g.withColumns({"rate": percent_of(F.col("mapped_ok"), F.col("class_rows")), "status": status})


def pick_first(rows: DataFrame, key: list[str], tiers: list[Column], order: list[str]) -> DataFrame:
    """One row per key: of the first tier that any row meets, the first in order; rows of no tier come last."""
    tier = None
    for i, test in enumerate(tiers):
        tier = F.when(test, i) if tier is None else tier.when(test, i)
    w = Window.partitionBy(*key).orderBy(tier.otherwise(len(tiers)), *order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def pick_reports(reports: DataFrame) -> DataFrame:
    """Primary and waterfall path of each deal from ``deal_key, seq, report_type, path``.

    Note-valuation reports come first, then others that are no waterfall,
    then any; the waterfall path is the first waterfall report unless it is
    the primary one.
    """
    kind = F.lower(F.trim(F.coalesce("report_type", F.lit(""))))
    d = reports.withColumn("wf", F.contains(kind, F.lit("waterfall"))).withColumn("nv", F.contains(kind, F.lit("note")) & F.contains(kind, F.lit("valuation")))
    tier = F.when(F.col("nv"), 0).when(~F.col("wf"), 1).otherwise(2)
    g = d.groupBy("deal_key").agg(F.min_by("path", F.struct(tier, "seq")).alias("pdf_path"), F.min_by(F.when(F.col("wf"), F.col("path")), F.when(F.col("wf"), F.col("seq"))).alias("waterfall_path"))
    return g.withColumn("waterfall_path", F.when(F.col("waterfall_path") != F.col("pdf_path"), F.col("waterfall_path")))


def distinct_messages(messages: DataFrame, key: list[str], most: int, order: list[str]) -> DataFrame:
    """Messages distinct in their first 120 normalised characters, at most ``most`` per key."""
    norm = F.substring(F.regexp_replace(F.lower("message"), r"\s+", " "), 1, 120)
    d = messages.withColumn("__k", norm).filter("__k <> ''")
    d = d.withColumn("__n", F.row_number().over(Window.partitionBy(*key, "__k").orderBy(*order))).filter("__n = 1")
    return d.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("__n") <= most).drop("__n", "__k")


def carry_forward(rows: DataFrame, key: list[str], order: list[str], value: Column, name: str, after: bool = False) -> DataFrame:
    """Last non-null ``value`` up to each row of its key; with ``after``, from earlier rows only."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if after else 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def label_distance(amounts: DataFrame, labels: DataFrame, before: int = 3, after: int = 1) -> DataFrame:
    """Amounts with labels near by: ``line`` of the label within [-before, +after] of the amount's.

    A range join turned into an equi join: each amount asks for the few lines of its window.
    """
    d = amounts.withColumn("near", F.explode(F.sequence(F.col("line") - before, F.col("line") + after)))
    return d.join(labels.withColumnRenamed("line", "near"), ["deal_key", "near"]).withColumn("distance", F.col("near") - F.col("line")).drop("near")
