"""The export document as nested rows: built, written and read with Spark's XML support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.functions import tables as T

SCHEMA_VERSION = "4"
#: Default names of a document and of the attribute that holds a class's resolved id.
ROOT = "payment_report"
ID_ATTRIBUTE = "_tranche_id"
#: Measures of a class element.
MEASURES = ["original_balance", "beginning_balance", "interest_rate", "interest_payment", "interest_payable", "principal_payment", "principal_payable", "deferred_interest", "dividend", "ending_balance"]
SCHEMA = (
    "_schema_version string, _source_folder string, metadata struct<deal_id:string,deal_name:string,report_title:string,payment_date:struct<_VALUE:string,_date_source:string>,determination_date:string,record_date:string,currency:string,trustee:string>, "
    f"classes struct<class:array<struct<_name:string,_map_class:string,{ID_ATTRIBUTE}:string,_map_tier:string,_map_status:string,{','.join(f'{m}:string' for m in MEASURES)},identifiers:struct<line:array<struct<_isin:string,_cusip:string>>>>>>, "
    "valuation_fees struct<administrative_expenses_grid_total:string,fee:array<struct<_main_category:string,_sub_category:string,_priority:string,_amount_paid:string>>>"
)


def listing_lines(prepared: DataFrame) -> DataFrame:
    """``deal_key, seq, class, isin, cusip``: rows of the security listing."""
    exact = lambda n: lambda h: T.column_exact(h, n)
    d = prepared.withColumn("listing", T.first_table(F.col("tables02"), "listing"))
    d = T.typed_rows(d, "listing", lambda t: t["rows"], {"class": exact("Economic class"), "isin": exact("ISIN"), "cusip": exact("CUSIP")})
    return d.select("deal_key", "seq", F.coalesce("class", F.lit("")).alias("class"), "isin", "cusip")


def geometry_override(lines: DataFrame, geometry: DataFrame, primary: DataFrame) -> DataFrame:
    """Listing lines with their class, replaced by the geometry's where the listing names a class that is none.

    ``geometry``: ``deal_key, cusip, class`` as read by position; ``primary``:
    ``deal_key, class`` of the class table. A line's class is replaced if it
    is not blank and not among the primary ones, and the geometry's is. A
    blank class is meant to be none and stays. A deal without primary
    classes is left alone. Adds ``overridden``; of several classes for a code the smallest counts.
    """
    have = primary.select("deal_key", F.col("class").alias("__p")).distinct()
    g = geometry.select("deal_key", F.upper("cusip").alias("__code"), F.col("class").alias("__p"))
    g = g.join(have, ["deal_key", "__p"], "left_semi").groupBy("deal_key", "__code").agg(F.min("__p").alias("__geometry"))
    d = lines.withColumn("__code", F.upper("cusip")).join(g, ["deal_key", "__code"], "left")
    d = d.join(have.select("deal_key", F.col("__p").alias("class"), F.lit(True).alias("__known")), ["deal_key", "class"], "left")
    wrong = F.col("__geometry").isNotNull() & (F.col("class") != "") & F.col("__known").isNull()
    return d.select(*[F.when(wrong, F.col("__geometry")).otherwise(F.col("class")).alias("class") if c == "class" else F.col(c) for c in lines.columns], wrong.alias("overridden"))


def listing_codes(prepared: DataFrame, geometry: DataFrame | None = None, primary: DataFrame | None = None) -> DataFrame:
    """``deal_key, class_key, lines``: security ids of the listing rows of each economic class."""
    d = listing_lines(prepared)
    if geometry is not None and primary is not None:
        d = geometry_override(d, geometry, primary)
    d = d.withColumn("class_key", F.lower("class"))
    return d.groupBy("deal_key", "class_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "isin", "cusip"))), lambda x: F.struct(x["isin"].alias("_isin"), x["cusip"].alias("_cusip"))).alias("lines"))


def class_elements(prepared: DataFrame, resolved: DataFrame | None = None, geometry: DataFrame | None = None) -> DataFrame:
    """``deal_key, classes``: one array of class elements per deal, in table order."""
    places = {m: lambda h, m=m: T.interest_payment(h) if m == "interest_payment" else T.column_exact(h, m.replace("_", " ").capitalize()) for m in MEASURES}
    d = T.typed_rows(prepared, "class_balance", T.class_rows, places | {"class": lambda h: F.lit(1)}).drop("header", "row")
    codes = listing_codes(prepared, geometry, d.select("deal_key", "class"))
    d = d.withColumn("class_key", F.lower("class")).join(codes, ["deal_key", "class_key"], "left")
    if resolved is not None:
        d = d.join(resolved.select("deal_key", "class", "norm", "tranche_id", "tier", "status"), ["deal_key", "class"], "left")
    else:
        d = d.withColumns({c: F.lit(None).cast("string") for c in ("norm", "tranche_id", "tier", "status")})
    one = F.struct(
        F.col("class").alias("_name"), F.col("norm").alias("_map_class"), F.col("tranche_id").cast("string").alias(ID_ATTRIBUTE), F.col("tier").alias("_map_tier"), F.col("status").alias("_map_status"),
        *MEASURES, F.struct(F.col("lines").alias("line")).alias("identifiers"),
    )
    return d.groupBy("deal_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", one.alias("x")))), lambda s: s["x"]).alias("classes"))


def export_rows(prepared: DataFrame, metadata: DataFrame, fees: DataFrame, resolved: DataFrame | None = None, geometry: DataFrame | None = None) -> DataFrame:
    """One nested row per deal with the schema of the export document."""
    fee = F.struct(F.col("main_category").alias("_main_category"), F.col("sub_category").alias("_sub_category"), F.col("priority").alias("_priority"), F.col("amount_paid").alias("_amount_paid"))
    f = fees.groupBy("deal_key").agg(F.sort_array(F.collect_list(fee)).alias("fee"))
    grid = T.admin_total(T.first_table(F.col("tables03"), "admin_grid"))
    d = prepared.select("deal_key", grid.alias("grid")).join(metadata, "deal_key", "left").join(class_elements(prepared, resolved, geometry), "deal_key", "left").join(f, "deal_key", "left")
    parts = S.folder_parts(F.col("deal_key"))
    return d.select(
        F.lit(SCHEMA_VERSION).alias("_schema_version"), F.col("deal_key").alias("_source_folder"),
        F.struct(parts["deal_id"].alias("deal_id"), "deal_name", "report_title", F.struct(F.col("payment_date").alias("_VALUE"), F.col("date_source").alias("_date_source")).alias("payment_date"), "determination_date", "record_date", "currency", "trustee").alias("metadata"),
        F.struct(F.col("classes").alias("class")).alias("classes"), F.struct(F.col("grid").alias("administrative_expenses_grid_total"), "fee").alias("valuation_fees"),
    )


def to_xml(row: Column, root: str = ROOT) -> Column:
    return F.to_xml(row, {"rowTag": root})


def from_xml(text: Column, root: str = ROOT) -> Column:
    return F.from_xml(text, SCHEMA, {"rowTag": root})


def write_xml(rows: DataFrame, path: str, root: str = ROOT) -> None:
    rows.write.format("xml").option("rowTag", root).option("rootTag", f"{root}s").mode("overwrite").save(path)


def read_xml(spark: SparkSession, path: str, root: str = ROOT) -> DataFrame:
    return spark.read.format("xml").option("rowTag", root).schema(SCHEMA).load(path)


def class_lines(exported: DataFrame) -> DataFrame:
    """``source_folder, deal_id, payment_date, class, ..., codes``: one row per class element."""
    d = exported.select(F.col("_source_folder").alias("source_folder"), F.col("metadata.deal_id").alias("deal_id"), F.col("metadata.payment_date._VALUE").alias("payment_date"), F.posexplode("classes.class").alias("seq", "c"))
    codes = F.array_compact(F.transform(F.coalesce("c.identifiers.line", F.array().cast("array<struct<_isin:string,_cusip:string>>")), lambda x: S.security_id(x["_cusip"])))
    return d.select("source_folder", "deal_id", "payment_date", "seq", F.col("c._name").alias("class"), F.col("c._map_class").alias("map_class"), F.col(f"c.{ID_ATTRIBUTE}").alias("xml_id"), F.col("c._map_status").alias("xml_status"), codes.alias("codes"), *[F.col(f"c.{m}").alias(m) for m in MEASURES])
