"""Printed layouts mapped to fields, sums checked against printed totals, and the six-band fee taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S

#: Of each layout: printed header, field, rank (of a field's headers the lowest rank that is printed counts).
LAYOUTS: dict[str, list[tuple[str, str, int]]] = {
    "deutsche": [
        ("Original Face Value", "original_balance", 0), ("Prior Principal Balance", "beginning_balance", 0), ("Interest Paid", "interest_payment", 0), ("Principal Paid", "principal_payment", 0),
        ("Current Principal Balance", "ending_balance", 0), ("Total Payment", "total_payment", 0),
    ],
    "us_bank": [
        ("Original Face Value", "original_balance", 0), ("Beginning Principal Balance", "beginning_balance", 0), ("Principal Paid", "principal_payment", 0), ("Interest Paid", "interest_payment", 0),
        ("Ending Principal Balance", "ending_balance", 0), ("Current Principal Balance", "ending_balance", 0), ("Ending/Current Principal Balance", "ending_balance", 0), ("Current Coupon", "interest_rate", 0), ("Total Payment", "total_payment", 0),
    ],
    "notes_information": [
        ("Original Principal Outstanding", "original_balance", 0), ("Beginning Principal Outstanding", "beginning_balance", 0), ("All In Rate", "interest_rate", 0), ("Interest Due", "interest_payable", 0),
        ("Deferred Interest Paid", "deferred_interest", 0), ("Deferred Interest Due", "deferred_interest", 0), ("Interest Paid", "interest_payment", 0), ("Principal Paid", "principal_payment", 0), ("Ending Principal Outstanding", "ending_balance", 0),
    ],
    "computershare": [
        ("Original Face", "original_balance", 0), ("Period Beginning Balance", "beginning_balance", 0), ("Principal Distribution", "principal_payment", 0), ("Deferred Interest", "deferred_interest", 0),
        ("Ending Balance", "ending_balance", 0), ("Coupon Rate", "interest_rate", 0),
    ],
    "opening_closing": [
        ("Original Face Value", "original_balance", 0), ("Opening Balance", "beginning_balance", 0), ("Repayment of Principal", "principal_payment", 0), ("Closing Balance", "ending_balance", 0),
        ("Accrued Interest Due", "interest_payable", 0), ("Deferred Interest", "deferred_interest", 0),
    ],
    "note_details": [
        ("Original Commitment Amount of Notes", "original_balance", 0), ("Aggregate Amount of Notes at the beginning of the Due Period", "beginning_balance", 0),
        ("Amount of Interest Payments made to the Notes", "interest_payment", 0), ("From Interest Proceeds", "interest_payment", 1),
        ("Amount of Principal Payments to be made to the Notes", "principal_payment", 0), ("From Principal Proceeds", "principal_payment", 1),
        ("Aggregate Outstanding Amount of Notes after giving effect to Principal Payments", "ending_balance", 0),
    ],
}
FIELDS = ["original_balance", "beginning_balance", "interest_rate", "interest_payment", "interest_payable", "principal_payment", "deferred_interest", "ending_balance", "total_payment"]

#: Band of each warehouse fee code.
FEE_BANDS: dict[str, list[str]] = {
    "management": [
        "management_fees", "senior_management_fees", "senior_management_fees_2", "subordinate_management_fees", "subordinate_management_fees_2", "incentive_management_fees", "incentive_management_fees_2",
        "successor_management_fees", "management_fees_rebate", "deferred_management_fees", "deferred_senior_management_fees", "deferred_senior_management_fees_2", "deferred_subordinate_management_fees",
        "deferred_subordinate_management_fees_2", "deferred_incentive_management_fees", "deferred_incentive_management_fees_2", "deferred_successor_management_fees", "deferred_management_fees_rebate",
    ],
    "retention": ["RETENTION_FEE_A1", "RETENTION_FEE_A2", "RETENTION_FEE_B1", "RETENTION_FEE_B2", "retention_fees", "retention_fees_2", "retention_fees_3", "deferred_retention_fees", "deferred_retention_fees_2"],
    "reserve": [
        "interest_reserve_account", "replenishment_reserve_account", "reinvestment_account", "expense_reserve_account", "expense_reimbursement_account", "liquidity_facility", "loss_replenishment_account", "apex_revolver",
        "interest_diversion_cure", "overcollateralization_cure",
    ],
    "administrative": [
        "trustee_expenses", "deferred_trustee_expenses", "administrator_expenses", "deferred_administrator_expenses", "collateral_admin_fees", "coissuer_fees", "deferred_coissuer_fees", "preference_share_agent_fees",
        "tax_gross_amounts", "deferred_tax_gross_amounts",
    ],
    "hedge": ["fees_to_hedge_counterparty", "deferred_fees_to_hedge_counterparty", "hedge_fees"],
    "other": ["other_fees_01", "other_fees_02", "other_fees_03"],
}


def header_key(c: Column) -> Column:
    """Letters and digits of a printed header, in lower case; wrapped and jammed headers get equal keys."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def rename_columns(cells: DataFrame, key: tuple[str, ...] = ("deal_key", "row")) -> DataFrame:
    """``key, layout`` and one amount per field from ``key, layout, seq, header, value``.

    A row is a class of one exhibit; of the stacked summary, whose labels
    stand below each other, ``header`` is the row label and ``row`` the
    class. Where a field has several headers, the lowest rank counts; of one
    rank a filled cell before a zero one, then the order of the map, then
    that of the page. A dash or blank ending balance of the stacked summary
    is zero. Rows without a known header keep a row of nulls.
    """
    printed = [(layout, i, header, field, rank) for layout, columns in LAYOUTS.items() for i, (header, field, rank) in enumerate(columns)]
    dim = cells.sparkSession.createDataFrame(printed, "layout string, place int, printed string, field string, rank int").withColumn("__k", header_key(F.col("printed")))
    d = cells.withColumn("__k", header_key(F.col("header"))).join(F.broadcast(dim), ["layout", "__k"], "left")
    blank = F.coalesce(F.col("value"), F.lit("")).rlike(r"^[\s\-–—]*$")
    amount = F.when((F.col("layout") == "note_details") & (F.col("field") == "ending_balance") & blank, 0.0).otherwise(S.parse_number(F.col("value")))
    d = d.withColumn("__v", amount)
    order = F.struct("rank", F.coalesce(F.col("__v") == 0, F.lit(True)), "place", "seq")
    return d.groupBy(*key, "layout").agg(*[F.min_by("__v", F.when(F.col("field") == f, order)).alias(f) for f in FIELDS])


def sums_tie(detail: DataFrame, stated: DataFrame, key: list[str], amount: str = "amount") -> DataFrame:
    """``key, lines, total, stated, match`` for every key of either side: the sum of the detail against the stated amount.

    The match is Y or N, partial without a stated amount or without amounts
    to sum, and N/A without detail.
    """
    a = detail.groupBy(*key).agg(F.count(F.lit(1)).alias("lines"), F.sum(amount).alias("total"))
    b = stated.groupBy(*key).agg(F.max(amount).alias("stated"), F.min(amount).alias("__least"))
    d = a.join(b, key, "full")
    tied = S.close(F.col("total"), F.col("stated"), 0.02, 1e-8) & S.close(F.col("total"), F.col("__least"), 0.02, 1e-8)
    match = F.when(F.col("lines").isNull(), "N/A").when(F.col("total").isNull() | F.col("stated").isNull(), "partial").when(tied, "Y").otherwise("N")
    return d.select(*key, F.coalesce("lines", F.lit(0)).alias("lines"), "total", "stated", match.alias("match"))


def section_sums(securities: DataFrame, subtotals: DataFrame) -> DataFrame:
    """Beginning balances of a section's securities against its Sub Totals; ``class_beginning`` is the printed aggregate, or the sum without one."""
    d = sums_tie(securities, subtotals, ["deal_key", "section"], "beginning_balance")
    return d.withColumn("class_beginning", F.coalesce("stated", "total"))


def band_counts(lines: DataFrame) -> DataFrame:
    """Class labels against Sub Totals bands of each page of ``deal_key, page, kind`` (label or band)."""
    g = lines.groupBy("deal_key", "page").agg(F.count_if(F.col("kind") == "label").alias("labels"), F.count_if(F.col("kind") == "band").alias("bands"))
    return g.withColumn("match", F.when(F.col("labels") == F.col("bands"), "Y").otherwise("N"))


def listing_sums(listing: DataFrame, primary: DataFrame, printed: DataFrame) -> DataFrame:
    """The sum of a class's listing against its primary amount, or else its printed total (each ``deal_key, economic, amount``)."""
    key = ["deal_key", "economic"]
    a = sums_tie(listing, primary, key)
    b = sums_tie(listing, printed, key).select(*key, F.col("stated").alias("printed"), F.col("match").alias("__m"))
    d = a.join(b, key, "full")
    match = F.when((F.col("match") == "Y") | (F.col("__m") == "Y"), "Y").when((F.col("match") == "N") | (F.col("__m") == "N"), "N").otherwise(F.coalesce("match", "__m"))
    return d.select(*key, F.coalesce("lines", F.lit(0)).alias("lines"), "total", F.col("stated").alias("primary"), "printed", match.alias("match"))


def totals_rows(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``deal_key, field`` and the sum of detail rows against the totals row (``is_total``), for each of ``fields``; principal paid among them."""
    pairs = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("amount")) for f in fields]))
    long = rows.select("deal_key", "is_total", pairs)
    return sums_tie(long.filter("not is_total"), long.filter("is_total"), ["deal_key", "field"])


def fee_bands(spark: SparkSession) -> DataFrame:
    """The taxonomy as ``code, band``."""
    return spark.createDataFrame([(code, band) for band, codes in FEE_BANDS.items() for code in codes], "code string, band string")


def band_fees(lines: DataFrame, code: str = "fee_type") -> DataFrame:
    """Lines with the band of their fee code, in any case; null for codes outside the taxonomy."""
    dim = fee_bands(lines.sparkSession).select(F.lower("code").alias("__code"), "band")
    return lines.withColumn("__code", F.lower(F.trim(code))).join(F.broadcast(dim), "__code", "left").drop("__code")
