"""Readers. All of them go through Spark's own sources, so any file system works."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.functions import tables as T

INDEX_ROW = r"^\|\s*(\d+)\s*\|\s*(.*?)\s*\|$"
TOTAL_PAGES = r"(?i)total pages\D*(\d+)"
CHUNK_ROW = r"^\|\s*`([^`]+)`\s*\|\s*(\d+)\s*-\s*(\d+)\s*\|"
CHUNK_FILE = r"pages_(\d+)_(\d+)\.txt$"
FILE_COLUMNS = {"text01": "01_", "text02": "02_", "text03": "03_", "text04": "04_", "text05": "05_"}


def lower_columns(df: DataFrame) -> DataFrame:
    """Column names in lower case without spaces at the ends."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def csv_requests(spark: SparkSession, path: str, required: tuple[str, ...] = ("deal_id", "payment_date")) -> DataFrame:
    """CSV with case-insensitive headers; missing required columns raise."""
    d = lower_columns(spark.read.option("header", True).csv(path))
    if lacking := [c for c in required if c not in d.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return d


def deal_paths(spark: SparkSession, path: str) -> DataFrame:
    """Deal list with the path under its first known alias and ids and paths cleaned."""
    d = csv_requests(spark, path)
    alias = next((c for c in ("pdf_path", "file_path", "filepath") if c in d.columns), None)
    if alias is None:
        raise ValueError("one of pdf_path, file_path, filepath is needed")
    other = F.col("waterfall_path") if "waterfall_path" in d.columns else F.lit(None).cast("string")
    return d.withColumns({"deal_id": S.deal_id(F.col("deal_id")), "pdf_path": S.clean_path(F.col(alias)), "waterfall_path": S.clean_path(other), "folder": S.folder_name(F.col("deal_id"), F.col("payment_date"), F.lit(None).cast("string"))})


def xml_requests(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Requests that name an XML file, or a deal and date from which its name follows."""
    d = csv_requests(spark, path, ())
    have = lambda c: F.col(c) if c in d.columns else F.lit(None).cast("string")
    named = F.nullif(S.clean_path(have("xml_file")), F.lit(""))
    built = F.concat(S.deal_id(have("deal_id")), F.lit("_"), S.yyyymmdd(S.folder_date(have("payment_date"))), F.lit(".xml"))
    name = F.coalesce(named, built)
    return d.withColumn("xml_path", F.when(name.rlike(r"^(/|[a-zA-Z][a-zA-Z0-9+.-]*:)"), name).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), name)))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, folder, name, text`` of text files, one row a file."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return d.withColumns({"name": F.element_at(F.split("path", "/"), -1), "folder": F.element_at(F.split("path", "/"), -2)})


def deal_files(texts: DataFrame) -> DataFrame:
    """One row per deal folder with its numbered markdown files."""
    pick = [F.max(F.when(F.startswith("name", F.lit(p)), F.col("text"))).alias(c) for c, p in FILE_COLUMNS.items()]
    return texts.groupBy(F.col("folder").alias("deal_key")).agg(*pick)


def page_index(text: Column) -> Column:
    """Array of ``page, preview`` rows of an index file."""
    rows = F.filter(F.transform(S.lines(text), S.strip), lambda x: x.rlike(INDEX_ROW))
    return F.transform(rows, lambda x: F.struct(F.regexp_extract(x, INDEX_ROW, 1).cast("int").alias("page"), F.regexp_extract(x, INDEX_ROW, 2).alias("preview")))


def total_pages(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, TOTAL_PAGES, 1), F.lit("")).try_cast("int")


def manifest_chunks(text: Column, prefix: str) -> Column:
    """Array of ``rel, first, last`` rows of a manifest under one chunk folder."""
    rows = F.filter(F.transform(S.lines(text), S.strip), lambda x: x.rlike(CHUNK_ROW))
    spans = F.transform(rows, lambda x: F.struct(F.translate(F.regexp_extract(x, CHUNK_ROW, 1), "\\", "/").alias("rel"), F.regexp_extract(x, CHUNK_ROW, 2).cast("int").alias("first"), F.regexp_extract(x, CHUNK_ROW, 3).cast("int").alias("last")))
    return F.filter(spans, lambda s: F.startswith(s["rel"], F.lit(prefix + "/")))


def chunk_files(paths: DataFrame) -> DataFrame:
    """Chunk spans from file names."""
    d = paths.filter(F.col("path").rlike(CHUNK_FILE))
    return d.select("path", F.regexp_extract("path", CHUNK_FILE, 1).cast("int").alias("first"), F.regexp_extract("path", CHUNK_FILE, 2).cast("int").alias("last"))


def deal_folders(paths: DataFrame, source: str | None = None, most: int = 0) -> DataFrame:
    """Distinct deal folders of a listing (``path``), by source suffix, in order, at most ``most`` (0: all)."""
    d = paths.select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct().withColumn("p", S.folder_parts(F.col("folder"))).filter("p.deal_id is not null")
    if source:
        d = d.filter(F.coalesce("p.source", F.lit("")) == source)
    d = d.select("folder", "p.*").orderBy(F.lower("folder"))
    return d.limit(most) if most else d


def tail_lines(lines: DataFrame, order: str, n: int, most_bytes: int | None = None, text: str = "value") -> DataFrame:
    """The last ``n`` lines of a log frame; with ``most_bytes`` only the whole ones among its last so many bytes.

    A line counts its UTF-8 bytes and its line end. The running sum sees these ``n`` lines alone.
    """
    d = lines.orderBy(F.desc(order)).limit(n)
    if most_bytes is None:
        return d
    used = F.sum(F.octet_length(F.coalesce(text, F.lit(""))) + 1).over(Window.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("__used", used).filter(F.col("__used") <= most_bytes).drop("__used")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of a database; predicates and projections are pushed down by the source."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def wanted_report(now: Column | None = None) -> Column:
    """Whether a row of reports ``r`` left joined with deals ``ad`` is a payable, unsent report that may be sent, as in the source query.

    Text is compared without case and spaces at the end, as the database
    does. A test of a missing value does not hold, so that a row without a
    report type is never wanted.
    """
    low = lambda c: F.rtrim(F.lower(F.col(c).cast("string")))
    kind, file, trustee = low("r.report_type"), low("r.trustee_file_name"), low("r.trustee")
    has = lambda c, patterns: functools.reduce(lambda x, y: x | y, [c.like(p) for p in patterns])
    pdf = (low("r.report_format") == "pdf") & has(kind, ["quarterly%", "note%", "%waterfall%", "%payment%", "%noteval%"])
    by_file = (trustee == "cdomonitoring") & has(file, ["%quarterly%", "%note%", "%waterfall%", "%payment%"]) & ~file.like("%notice%")
    summary = (kind == "investor report - summary") & (trustee == "bony")
    day = F.col("r.payment_date").cast("timestamp")
    return (
        (F.col("r.sent").try_cast("int") == 0) & (F.col("ad.send_dm").try_cast("int") == 1) & (pdf | by_file | summary)
        & ~kind.like("%notice%") & (kind != "noteholder updates") & day.isNotNull() & (day <= (F.current_timestamp() if now is None else now))
    )


def reports_of_deals(reports: DataFrame, deals: DataFrame, date: Column | None = None, deal: Column | None = None, now: Column | None = None) -> DataFrame:
    """S3: reports left joined with their deals, those that ``wanted_report`` takes, of one date and one deal if given."""
    d = reports.alias("r").join(deals.alias("ad"), "deal_id", "left").filter(wanted_report(now))
    if deal is not None:
        d = d.filter(F.col("deal_id") == deal)
    return d if date is None else d.filter(F.col("r.payment_date").cast("date") == date)


def unpivot_ids(master: DataFrame, id_col: str, codes: list[str]) -> DataFrame:
    """``deal_key, code, tranche_id`` from the id columns of a master table."""
    d = master.select("deal_key", F.col(id_col).alias("tranche_id"), F.explode(F.array(*[F.col(c).cast("string") for c in codes])).alias("code"))
    return d.withColumn("code", S.security_id(F.col("code"))).filter("code is not null").distinct()


def metadata(deals: DataFrame) -> DataFrame:
    """Report metadata from file 01: deal name and dates, payment preferred to distribution date."""
    kv = T.key_values(T.parse_tables(F.coalesce("text01", F.lit(""))))
    get = lambda k: F.nullif(F.try_element_at(F.col("kv"), F.lit(k)), F.lit("N/A"))
    d = deals.select("deal_key", kv.alias("kv"))
    pay, dist = get("payment date"), get("distribution date")
    return d.select(
        "deal_key", get("deal / trust / series name").alias("deal_name"), get("report title").alias("report_title"), S.iso_date(S.us_date(F.coalesce(pay, dist))).alias("payment_date"),
        F.when(pay.isNotNull(), "payment date").when(dist.isNotNull(), "distribution date").alias("date_source"), F.coalesce(pay != dist, F.lit(False)).alias("dates_differ"),
        S.iso_date(S.us_date(get("determination date"))).alias("determination_date"), S.iso_date(S.us_date(get("record date"))).alias("record_date"), get("currency").alias("currency"), get("trustee").alias("trustee"),
    )
