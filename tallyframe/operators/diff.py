"""Original and revised reports side by side: changes with severities.

Every comparison is a full outer join of two long frames on the deal and the
label, then one severity expression. Output rows: ``deal_key, category,
label, field, original, revised, change, change_pct, severity``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.functions import tables as T
from tallyframe.functions.predicates import severity_of_change

# --- Fixed values: compared fields with their percent thresholds (high, critical) ---
CLASS_FIELDS = {"beginning balance": 0.5, "interest rate": 0.1, "interest payment": 0.5, "interest payable": 0.5, "principal payment": 0.5, "deferred interest": 0.5, "ending balance": 0.5}
DATE_FIELDS = ["determination date", "payment date", "distribution date"]
TEST_HEADERS = ["test", "ratio", "result", "pass", "fail", "coverage"]
TEST_COLUMNS = {
    "name": ["test name", "test", "description", "item", "name"], "current ratio": ["current ratio", "current", "ratio", "actual"],
    "pass/fail": ["pass", "result", "status", "p/f"], "numerator": ["numerator", "num"], "denominator": ["denominator", "den"],
}
ACCOUNT_THRESHOLD, VALUE_THRESHOLD, FEE_STEP = 1.0, 0.1, 1000.0
CHANGE = ["deal_key", "category", "label", "field", "original", "revised", "change", "change_pct", "severity"]


def _signed(c: Column, places: int, commas: bool = True) -> Column:
    digits = F.format_number(F.abs(c), places)
    digits = digits if commas else F.replace(digits, F.lit(","), F.lit(""))
    return F.concat(F.when(c < 0, "-").otherwise("+"), digits)


def _row(d: DataFrame, category: str | Column, field: Column, original: Column, revised: Column, change: Column, pct: Column, severity: Column) -> DataFrame:
    out = d.select("deal_key", (F.lit(category) if isinstance(category, str) else category).alias("category"), F.col("label"), field.alias("field"), original.alias("original"), revised.alias("revised"), change.alias("change"), pct.alias("change_pct"), severity.alias("severity"))
    return out.filter(F.col("severity") != "NO CHANGE").select(*CHANGE)


def numeric_changes(old: DataFrame, new: DataFrame, category: str, thresholds: dict[str, float], critical: dict[str, float] | None = None) -> DataFrame:
    """Changes of long frames ``deal_key, label, field, value (text)`` whose labels exist on both sides."""
    a = old.select("deal_key", "label", "field", F.col("value").alias("o"))
    b = new.select("deal_key", "label", "field", F.col("value").alias("r"))
    both = old.select("deal_key", "label").distinct().join(new.select("deal_key", "label").distinct(), ["deal_key", "label"])
    d = a.join(b, ["deal_key", "label", "field"], "full").join(both, ["deal_key", "label"], "left_semi")
    d = d.withColumns({"ov": S.parse_number(F.col("o")), "rv": S.parse_number(F.col("r"))})
    severity = None
    for field, high in thresholds.items():
        s = severity_of_change(F.col("ov"), F.col("rv"), high, (critical or {}).get(field))
        severity = F.when(F.col("field") == field, s) if severity is None else severity.when(F.col("field") == field, s)
    delta = F.coalesce("rv", F.lit(0.0)) - F.coalesce("ov", F.lit(0.0))
    pct = F.when(F.col("ov") != 0, F.concat(_signed(delta / F.nullif(F.abs(F.col("ov")), F.lit(0.0)) * 100, 4, False), F.lit("%"))).otherwise("")
    na = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("N/A"))
    return _row(d, category, F.col("field"), na("o"), na("r"), _signed(delta, 2), pct, severity.otherwise("NO CHANGE"))


def membership_changes(old: DataFrame, new: DataFrame, category: str, field: str, severity: str) -> DataFrame:
    """Labels that exist on one side only."""
    a = old.select("deal_key", "label").distinct().withColumn("o", F.lit(True))
    b = new.select("deal_key", "label").distinct().withColumn("r", F.lit(True))
    d = a.join(b, ["deal_key", "label"], "full").filter("o is null or r is null")
    gone = F.col("r").isNull()
    return _row(d, category, F.lit(field), F.when(gone, "(present)").otherwise("(not present)"), F.when(gone, "(removed in revised)").otherwise("(added in revised)"), F.when(gone, "removed").otherwise("added"), F.lit("—"), F.lit(severity))


def date_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Key dates: a changed payment date is CRITICAL, others are HIGH."""
    def long(d: DataFrame, name: str) -> DataFrame:
        kv = T.key_values(T.parse_tables(F.coalesce("text01", F.lit(""))))
        items = F.array(*[F.struct(F.lit(f).alias("label"), F.try_element_at(kv, F.lit(f)).alias(name)) for f in DATE_FIELDS])
        return d.select("deal_key", F.inline(items))

    d = long(old, "o").join(long(new, "r"), ["deal_key", "label"])
    known = ~F.lower(F.coalesce("o", F.lit(""))).isin("", "n/a") & ~F.lower(F.coalesce("r", F.lit(""))).isin("", "n/a")
    changed = known & (F.lower("o") != F.lower("r"))
    severity = F.when(~changed, "NO CHANGE").when(F.col("label") == "payment date", "CRITICAL").otherwise("HIGH")
    return _row(d, "Key dates", F.col("label"), F.col("o"), F.col("r"), F.lit("date changed"), F.lit("—"), severity)


def class_fields(deals: DataFrame) -> DataFrame:
    """Long fields of the class table: of equal classes the last row stays."""
    text = F.coalesce("text02", F.lit(""))
    part = T.section(text, "Class balance table (primary)")
    tables = T.parse_tables(F.when(part != "", part).otherwise(text))
    fit = F.filter(tables, lambda t: F.contains(T.header_text(t), F.lit("class")) & F.contains(T.header_text(t), F.lit("beginning balance")))
    d = deals.select("deal_key", F.posexplode(fit).alias("t", "tbl"))
    places = {f: lambda h, f=f: T.column_exact(h, f) for f in CLASS_FIELDS} | {"label": lambda h: F.coalesce(T.column_exact(h, "class"), T.column_containing(h, "class"))}
    d = T.typed_rows(d, "tbl", lambda t: t["rows"], places, ("deal_key", "t")).withColumnRenamed("seq", "n")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in CLASS_FIELDS])
    d = d.filter((F.col("label") != "") & (F.lower("label") != "class"))
    last = d.groupBy("deal_key", "label").agg(F.max_by(fields, F.struct("t", "n")).alias("fields"))
    return last.select("deal_key", "label", F.inline("fields"))


def test_fields(deals: DataFrame, text: str = "text03") -> DataFrame:
    """Long fields of coverage tests: name, current ratio, pass/fail, numerator, denominator."""
    tables = F.filter(T.parse_tables(F.coalesce(text, F.lit(""))), lambda t: S.any_of(T.header_text(t), TEST_HEADERS))
    d = deals.select("deal_key", F.posexplode(tables).alias("t", "tbl"))
    places = {f: lambda h, f=f: T.column_containing(h, *TEST_COLUMNS[f]) for f in TEST_COLUMNS}
    d = T.typed_rows(d, "tbl", lambda t: t["rows"], places, ("deal_key", "t")).withColumnRenamed("seq", "n")
    label = F.lower(F.regexp_replace(F.col("name"), r"\s+", " "))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in TEST_COLUMNS if f != "name"])
    d = d.withColumn("label", label).filter(~F.col("label").isin("", "test name", "test", "description"))
    return d.groupBy("deal_key", "label").agg(F.max_by(fields, F.struct("t", "n")).alias("fields")).select("deal_key", "label", F.inline("fields"))


def test_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Coverage tests: a flip is CRITICAL, a ratio over half a point HIGH, parts by 0.1 percent."""
    members = membership_changes(old, new, "IC/OC Tests", "(test)", "HIGH")
    wide = lambda d, p: d.groupBy("deal_key", "label").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(p + f) for f in ("pass/fail", "current ratio")])
    d = wide(old, "o_").join(wide(new, "r_"), ["deal_key", "label"])
    o, r = F.col("`o_pass/fail`"), F.col("`r_pass/fail`")
    flip = F.when((o != "") & (r != "") & (F.lower(o) != F.lower(r)), "CRITICAL").otherwise("NO CHANGE")
    flips = _row(d, "IC/OC Tests", F.lit("pass/fail"), o, r, F.concat_ws(" → ", o, r), F.lit("—"), flip)
    ov, rv = S.parse_number(F.col("`o_current ratio`")), S.parse_number(F.col("`r_current ratio`"))
    delta = F.coalesce(rv, F.lit(0.0)) - F.coalesce(ov, F.lit(0.0))
    level = F.when(ov.isNull() & rv.isNull(), "NO CHANGE").when(F.abs(delta) <= 0.01, "NO CHANGE").when(F.abs(delta) > 0.5, "HIGH").otherwise("LOW")
    ratios = _row(d, "IC/OC Tests", F.lit("current ratio"), F.col("`o_current ratio`"), F.col("`r_current ratio`"), _signed(delta, 4, False), F.concat(_signed(delta, 4, False), F.lit(" pp")), level)
    parts = [x.filter(F.col("field").isin("numerator", "denominator")) for x in (old, new)]
    return reduce(DataFrame.unionByName, [members, flips, ratios, numeric_changes(parts[0], parts[1], "IC/OC Tests", {"numerator": 0.1, "denominator": 0.1})])


#: Header words of the field and amount columns of account tables, and what
#: names an account, a labelled amount, a note value and a class's value in running text.
ACCOUNTS = {
    "ICA (Interest Collection Account)": r"interest\s+collection\s+account|ica\b|interest\s+account",
    "PCA (Principal Collection Account)": r"principal\s+collection\s+account|pca\b|principal\s+account",
}
ACCOUNT_FIELD = ["field", "description", "item", "account"]
ACCOUNT_AMOUNT = ["amount", "balance", "value", "revised", "original"]
LABELLED_AMOUNT = r"(opening|beginning|prior|closing|ending|total\s+deposit|total\s+disbursement|total\s+paid|collection|received)\s*[:\-]?\s*([\d,]+\.\d{2})"
VALUE_HEADING = r"note\s+valuation|nvr|present\s+value|calculated\s+value|note\s+value"
VALUE_HEADERS = ["note value", "pv", "present value", "calculated value", "nvr", "valuation"]
VALUE_CLASS = ["class", "notes", "tranche", "name"]
VALUE_AMOUNT = ["note value", "pv", "present value", "calculated value", "value"]
CLASS_VALUE = r"(?im)^([a-z0-9\-.]+\s*(?:notes?|class|tranche)?)\s+([\d,]+\.\d{2})"


def _first_found(deals: DataFrame, files: list[str], gate: str, wanted: Callable[[Column], Column], name: list[str], amount: list[str], labelled: str, lower: bool) -> DataFrame:
    """``deal_key, k, v`` from the first text of a deal that matches ``gate`` and yields entries; of equal names the last stays.

    Texts are the files in order, then the page chunks (``chunks``, an array,
    if there is such a column). Entries are the rows of the wanted tables with
    a name and a number; a text without any gives the two groups of
    ``labelled`` instead. Each text is parsed once.
    """
    chunks = [F.coalesce(F.col("chunks"), F.array().cast("array<string>"))] if "chunks" in deals.columns else []
    texts = F.concat(F.array(*[F.coalesce(F.col(f), F.lit("")) for f in files]), *chunks)
    d = deals.select("deal_key", F.posexplode(texts).alias("part", "text")).filter(F.col("text").rlike("(?i)" + gate))
    name_of = lambda c: S.strip(F.lower(c) if lower else c)
    tables = d.select("deal_key", "part", F.posexplode_outer(F.filter(T.parse_tables(F.col("text")), wanted)).alias("t", "tbl"))
    places = {"k": lambda h: T.column_containing(h, *name), "v": lambda h: T.column_containing(h, *amount)}
    cells = T.typed_rows(tables, "tbl", lambda t: t["rows"], places, ("deal_key", "part", "t"))
    cells = cells.select("deal_key", "part", F.lit(0).alias("source"), "t", "seq", name_of(F.col("k")).alias("k"), "v").filter("k is not null and v is not null")
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(labelled), F.lit(1)).alias("k"), F.regexp_extract_all("text", F.lit(labelled), F.lit(2)).alias("v"))
    lines = d.select("deal_key", "part", F.posexplode(both).alias("seq", "x"))
    lines = lines.select("deal_key", "part", F.lit(1).alias("source"), F.lit(0).alias("t"), "seq", name_of(F.col("x.k")).alias("k"), F.col("x.v").alias("v"))
    found = cells.unionByName(lines).withColumn("v", S.parse_number(F.col("v"))).filter("k <> '' and v is not null")
    found = found.groupBy("deal_key", "part", "source", "k").agg(F.max_by("v", F.struct("t", "seq")).alias("v"))
    kept = found.groupBy("deal_key").agg(F.min(F.struct("part", "source")).alias("f")).select("deal_key", "f.part", "f.source")
    return found.join(kept, ["deal_key", "part", "source"]).select("deal_key", "k", "v")


def account_fields(deals: DataFrame) -> DataFrame:
    """``deal_key, category, k, v``: amounts of the interest and principal collection accounts.

    From tables whose header names the account; where a text has none, from labelled amounts in it.
    """
    def of(account: str) -> DataFrame:
        named = lambda t: T.header_text(t).rlike("(?i)" + ACCOUNTS[account])
        return _first_found(deals, ["text03", "text04"], ACCOUNTS[account], named, ACCOUNT_FIELD, ACCOUNT_AMOUNT, "(?i)" + LABELLED_AMOUNT, True).withColumn("category", F.lit(account))

    return reduce(DataFrame.unionByName, [of(a) for a in ACCOUNTS])


def note_values(deals: DataFrame) -> DataFrame:
    """``deal_key, category, k, v``: note value or present value of each class, from tables, else from lines."""
    named = lambda t: S.any_of(T.header_text(t), VALUE_HEADERS)
    found = _first_found(deals, ["text03", "text01", "text02", "text04"], VALUE_HEADING, named, VALUE_CLASS, VALUE_AMOUNT, CLASS_VALUE, False)
    return found.withColumn("category", F.lit("Note Valuation (PV)"))


def amount_changes(old: DataFrame, new: DataFrame, high: float, critical: float | None, label: Column, field: Column) -> DataFrame:
    """Changes of ``deal_key, category, k, v``, also of names that one side lacks."""
    key = ["deal_key", "category", "k"]
    d = old.select(*key, F.col("v").alias("ov")).join(new.select(*key, F.col("v").alias("rv")), key, "full")
    delta = F.coalesce("rv", F.lit(0.0)) - F.coalesce("ov", F.lit(0.0))
    pct = F.when(F.col("ov") != 0, F.concat(_signed(delta / F.nullif(F.abs(F.col("ov")), F.lit(0.0)) * 100, 4, False), F.lit("%"))).otherwise("")
    show = lambda c: F.coalesce(F.format_number(F.col(c), 2), F.lit("N/A"))
    severity = severity_of_change(F.col("ov"), F.col("rv"), high, critical)
    return _row(d.withColumn("label", label), F.col("category"), field, show("ov"), show("rv"), _signed(delta, 2), pct, severity)


def account_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Collection accounts of two sets of deals, by one percent."""
    return amount_changes(account_fields(old), account_fields(new), ACCOUNT_THRESHOLD, None, F.initcap("k"), F.col("k"))


def value_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Note values of two sets of deals: anything over 0.1 percent is CRITICAL."""
    return amount_changes(note_values(old), note_values(new), VALUE_THRESHOLD, VALUE_THRESHOLD, F.col("k"), F.lit("note value / PV"))


def fee_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fees ``deal_key, label, amount`` summed by label; over 1,000 is HIGH, a missing side counts as zero."""
    total = lambda d, n: d.groupBy("deal_key", "label").agg(F.sum("amount").alias(n))
    d = total(old, "o").join(total(new, "r"), ["deal_key", "label"], "full")
    delta = F.coalesce("r", F.lit(0.0)) - F.coalesce("o", F.lit(0.0))
    severity = F.when(F.abs(delta) <= 0.01, "NO CHANGE").when(F.abs(delta) > FEE_STEP, "HIGH").otherwise("LOW")
    show = lambda c: S.format_amount(F.coalesce(c, F.lit(0.0)))
    return _row(d, "Fees", F.lit("amount paid"), show("o"), show("r"), _signed(delta, 2), F.lit(""), severity)


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Dates, classes, tests, collection accounts, note values and fees of deals given as markdown files."""
    a, b = class_fields(old), class_fields(new)
    classes = membership_changes(a, b, "Class balances", "(class)", "CRITICAL").unionByName(numeric_changes(a, b, "Class balances", CLASS_FIELDS))

    def fees(d: DataFrame) -> DataFrame:
        d = d.withColumn("tables05", T.parse_tables(F.coalesce("text05", F.lit("")))).withColumn("fees", T.first_table(F.col("tables05"), "fees"))
        places = {"label": lambda h: F.coalesce(T.column_exact(h, "Sub category"), T.column_containing(h, "fee_type", "standard fee type")), "amount": lambda h: T.column_exact(h, "Amount paid")}
        return T.typed_rows(d, "fees", T.fee_rows, places).select("deal_key", F.lower("label").alias("label"), S.parse_number(F.col("amount")).alias("amount"))

    return reduce(DataFrame.unionByName, [date_changes(old, new), classes, test_changes(test_fields(old), test_fields(new)), account_changes(old, new), value_changes(old, new), fee_changes(fees(old), fees(new))])


def severity_counts(changes: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s)
    return changes.groupBy("deal_key").agg(count("CRITICAL").alias("critical"), count("HIGH").alias("high"), count("LOW").alias("low"), F.count(F.lit(1)).alias("total_changed"))
