"""Every operator applied to whole driver tables that stand in for reports.

The driver's tables hold no trustee reports, so each query renders rows as
the text or the columns that its operator reads and runs the operator on
them. ``TWINS`` has DuckDB SQL that computes the same result another way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import labels as L
from tallyframe.functions import predicates as P
from tallyframe.functions import scalars as S
from tallyframe.functions import tables as T
from tallyframe.operators import diff, fees, layouts, pages, reconcile, resolve, rules, usage
from tallyframe.session import materialize
from tallyframe.sources import xml_export
from tallyframe.sources.writers import comparison_report, table_line

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            TWINS[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column) -> Column:
    return F.format_number(c, 2)


def pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_pick(index: str, values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({index}) + 1]"


# --- scalar functions -------------------------------------------------------------------


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE c_acctbal END AS number_a,
  CASE c_custkey % 5 WHEN 1 THEN c_acctbal / 100 WHEN 2 THEN (CASE WHEN c_acctbal < 0 THEN c_acctbal ELSE -c_acctbal END) WHEN 3 THEN NULL ELSE c_acctbal END AS number_b,
  CASE WHEN c_custkey % 5 IN (0, 4) THEN printf('%.2f', c_acctbal) END AS money_text
FROM customer""")
def parse_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts rendered in five ways and read back."""
    m = money(F.col("c_acctbal"))
    kind = F.col("c_custkey") % 5
    text = F.when(kind == 0, F.concat(F.lit("$"), m)).when(kind == 1, F.concat(m, F.lit("%"))).when(kind == 2, F.concat(F.lit("("), m, F.lit(")"))).when(kind == 3, "N/A").otherwise(m)
    d = read(spark, sf_dir, "customer").select("c_custkey", text.alias("t"))
    return d.select("c_custkey", S.parse_number(F.col("t")).alias("number_a"), S.to_float(F.col("t")).alias("number_b"), S.money_cell(F.col("t")).alias("money_text"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y%m%d') AS ymd FROM orders")
def parse_dates_multiformat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dates rendered in six formats and read back."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = None
    for i, f in enumerate(["MM/dd/yyyy", "M/d/yy", "yyyy-MM-dd", "d-MMM-yyyy", "dd-MMMM-yyyy", "d-MMM-yy"]):
        v = F.date_format(d, f)
        text = F.when(k == i, v) if text is None else text.when(k == i, v)
    out = read(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return out.select("o_orderkey", S.us_date(F.col("t")).alias("day"), S.any_date_yyyymmdd(F.col("t")).alias("ymd"))


@query("""
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || '_' || strftime(o_orderdate, '%Y%m%d') AS folder, CAST(o_custkey AS VARCHAR) AS deal_id, CAST(o_orderdate AS DATE) AS payment_date,
  CASE o_orderkey % 3 WHEN 0 THEN 'sdk' WHEN 1 THEN 'llm' END AS source FROM orders""")
def folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """folder names from float-like ids and dates, and back."""
    o = read(spark, sf_dir, "orders")
    name = S.folder_name(F.concat(F.col("o_custkey").cast("string"), F.lit(".0")), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("stem"))
    d = o.select("o_orderkey", name.alias("folder"), F.when(F.col("o_orderkey") % 3 == 0, "_sdk").when(F.col("o_orderkey") % 3 == 1, "_LLM").otherwise("").alias("suffix"))
    return d.withColumn("p", S.folder_parts(F.concat("folder", "suffix"))).select("o_orderkey", "folder", "p.deal_id", "p.payment_date", "p.source")


@query("SELECT c_custkey, CASE WHEN abs(c_acctbal) < 1e-9 THEN '0.00' ELSE format('{:,.2f}', c_acctbal) END AS amount FROM customer")
def format_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two decimals with thousands commas."""
    return read(spark, sf_dir, "customer").select("c_custkey", S.format_amount(F.col("c_acctbal")).alias("amount"))


@query("SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS code, regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS name_key FROM supplier")
def security_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """codes with stray spaces and hyphens, and compact names."""
    k = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    text = F.concat(F.lit(" "), F.substring(k, 1, 3), F.lit("-"), F.substring(k, 4, 3), F.lit(" "), F.substring(k, 7, 3))
    return read(spark, sf_dir, "supplier").select("s_suppkey", S.security_id(text).alias("code"), S.name_key(F.col("s_name")).alias("name_key"))


PRIORITIES = ["(A)(1)(i)", "—", "n/a", "Clause 4 b", "(b)(2)"]


@query(f"""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '(a)(1)(i)' WHEN 3 THEN 'clause4b' WHEN 4 THEN '(b)(2)' ELSE '' END AS priority_key,
  regexp_replace(lower(p_name), '\\s+', ' ', 'g') AS fee_key, p_name AS bare FROM part""")
def fee_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: priority keys, description keys, clause prefixes."""
    p = read(spark, sf_dir, "part")
    pri = pick(F.col("p_partkey") % 5, PRIORITIES)
    return p.select("p_partkey", S.priority_key(pri).alias("priority_key"), S.fee_key(F.concat(F.lit("Payment of the "), F.col("p_name"))).alias("fee_key"), S.without_priority(F.concat(F.lit("(B)(ii) "), F.col("p_name"))).alias("bare"))


RATES = ["Floating", "5.25%", "N/A", "SOFR + 1.20", "—", "fixed rate", "3"]


@query("""
SELECT p_partkey, (p_partkey % 7) IN (0, 5) AS is_type, (p_partkey % 7) IN (1, 3, 6) AS is_filled, CAST(p_size AS DOUBLE) AS unpaid,
  CASE p_partkey % 4 WHEN 0 THEN 'A-R' WHEN 1 THEN 'B' WHEN 2 THEN 'C-1' END AS economic FROM part""")
def rate_and_slice_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kinds of rate cells, unpaid amounts, program slices."""
    rate, label = pick(F.col("p_partkey") % 7, RATES), pick(F.col("p_partkey") % 4, ["A-R-144A", "B REGS", "C-1-ai", "D-R"])
    return read(spark, sf_dir, "part").select("p_partkey", S.rate_is_type(rate).alias("is_type"), S.rate_is_filled(rate).alias("is_filled"), S.unpaid_amount(F.concat(F.lit("x Unpaid "), F.col("p_size").cast("string"))).alias("unpaid"), S.economic_class(label).alias("economic"))


@query("""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')), lambda x: x <> '') AS ls FROM documents)
SELECT doc_id, CASE WHEN len(ls) = 0 THEN '(no text)' ELSE replace(array_to_string(list_transform(ls[1:2], lambda x: CASE WHEN length(x) > 120 THEN rtrim(x[1:119]) || '…' ELSE x END), ' / '), '|', '¦') END AS preview FROM l""")
def page_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first two lines of every document."""
    return read(spark, sf_dir, "documents").select("doc_id", S.preview_lines(F.coalesce("text", F.lit(""))).alias("preview"))


@query()
def page_index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index lines with section and class hints."""
    return read(spark, sf_dir, "documents").select("doc_id", S.page_preview(F.coalesce("text", F.lit(""))).alias("preview"))


# --- tables in text -------------------------------------------------------------------------


def _markdown(rows: DataFrame, key: str, order: str, headers: list[str], cells: list[Column]) -> DataFrame:
    """One text per key that holds the rows as a pipe table between other lines."""
    head = "# Report\n| stray |\n\n| " + " | ".join(headers) + " |\n|" + " --- |" * len(headers) + "\n"
    g = rows.groupBy(F.col(key).alias("deal_key")).agg(F.sort_array(F.collect_list(F.struct(order, table_line(*cells).alias("line")))).alias("ls"))
    return g.select("deal_key", F.concat(F.lit(head), F.array_join(F.col("ls.line"), "\n"), F.lit("\n\nend | of text\n")).alias("text"))


@query("SELECT n_regionkey AS deal_key, CAST(n_nationkey AS VARCHAR) AS code, n_name AS name FROM nation")
def pipe_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as one table per region, parsed back by header."""
    md = _markdown(read(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", ["Code", "Nation name"], [F.col("n_nationkey"), F.col("n_name")])
    md = md.withColumn("t", F.try_element_at(T.parse_tables(F.col("text")), F.lit(1)))
    d = T.typed_rows(md, "t", lambda t: t["rows"], {"code": lambda h: T.column_exact(h, "code"), "name": lambda h: T.column_containing(h, "name")})
    return d.select("deal_key", "code", "name")


@query("SELECT n_regionkey AS deal_key, max(CASE WHEN n_nationkey % 5 = 0 THEN n_name END) AS first_name, max(CASE WHEN n_nationkey % 5 = 1 THEN n_name END) AS second_name, count(DISTINCT n_nationkey % 5) AS fields FROM nation GROUP BY 1")
def kv_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field/Value tables as maps."""
    n = read(spark, sf_dir, "nation").groupBy("n_regionkey", (F.col("n_nationkey") % 5).alias("f")).agg(F.max("n_name").alias("n_name"))
    md = _markdown(n, "n_regionkey", "f", ["Field", "Value"], [F.concat(F.lit("Name "), F.col("f").cast("string")), F.col("n_name")])
    kv = T.key_values(T.parse_tables(F.col("text")))
    return md.select("deal_key", F.try_element_at(kv, F.lit("name 0")).alias("first_name"), F.try_element_at(kv, F.lit("name 1")).alias("second_name"), F.size(kv).cast("long").alias("fields"))


@query("""SELECT o_orderkey AS deal_key, '## B' || chr(10) || o_orderstatus || chr(10) || '### C' || chr(10) || o_orderpriority AS part, o_orderpriority AS inner_part FROM orders""")
def section_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: a section up to the next heading of its level."""
    nl = F.lit("\n")
    text = F.concat(F.lit("# A\nx\n## B\n"), F.col("o_orderstatus"), nl, F.lit("### C\n"), F.col("o_orderpriority"), nl, F.lit("## D\ny"))
    d = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deal_key"), text.alias("t"))
    return d.select("deal_key", T.section(F.col("t"), "B").alias("part"), F.regexp_replace(T.section(F.col("t"), "C"), r"^.*\n", "").alias("inner_part"))


@query("""
SELECT l_orderkey AS deal_key, arg_max(printf('%.2f', l_extendedprice), {'n': l_linenumber, 's': format('{:,.2f}', l_extendedprice)}) FILTER (l_linenumber % 2 = 1) AS total FROM lineitem GROUP BY 1""")
def admin_grid_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-most total row of an expense grid, sub totals aside."""
    li = read(spark, sf_dir, "lineitem").withColumn("kind", F.when(F.col("l_linenumber") % 2 == 1, "Grand Total").otherwise("Sub Total of fees"))
    md = _markdown(li, "l_orderkey", "l_linenumber", ["Expense / fee type", "Due from current period", "Paid during the period"], [F.col("kind"), F.lit("1.00"), F.concat(F.lit("$"), money(F.col("l_extendedprice")))])
    md = md.withColumn("tables", T.parse_tables(F.col("text")))
    return md.select("deal_key", T.admin_total(T.first_table(F.col("tables"), "admin_grid")).alias("total"))


# --- rules ------------------------------------------------------------------------------------


CLASS_HEADERS = ["Class", "Original balance", "Beginning balance", "Interest rate", "Interest payment", "Interest payable", "Principal payment", "Principal payable", "Deferred interest", "Dividend", "Ending balance", "Notes"]


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a deal: its lines are classes, with faults planted by line number.

    Beginning is the price; principal a tenth on lines 1 and 5; deferred the
    quantity on line 2; ending follows, but is ten too high on line 4 and the
    beginning on line 6, whose principal is all of it. Line 7 is negative.
    """
    n, beg = F.col("l_linenumber"), F.col("l_extendedprice")
    prin = F.when(n.isin(1, 5), F.floor(beg / 10)).when(n == 6, beg).otherwise(0.0)
    deferred = F.when(n == 2, F.col("l_quantity")).otherwise(0.0)
    end = F.when(n == 6, beg).otherwise(beg + deferred - prin + F.when(n == 4, 10.0).otherwise(0.0))
    li = read(spark, sf_dir, "lineitem").withColumns({"prin": prin, "def": deferred, "end": end, "label": F.concat(F.lit("C-"), n.cast("string"))})
    zero = F.lit("0.00")
    cells = [F.col("label"), money(beg), money(beg), F.lit("5.1%"), money(F.when(n == 7, -beg).otherwise(F.lit(1.0))), zero, money(F.col("prin")), zero, money(F.col("def")), zero, money(F.col("end")), F.lit("")]
    md = _markdown(li, "l_orderkey", "l_linenumber", CLASS_HEADERS, cells)
    text = lambda s: F.lit(s)
    return md.select("deal_key", text("x").alias("text01"), F.col("text").alias("text02"), F.lit(None).cast("string").alias("text03"), text("x").alias("text04"), F.lit(None).cast("string").alias("text05"))


@query("SELECT l_orderkey AS deal_key, 'C-' || l_linenumber AS label, 'V5' AS rule FROM lineitem WHERE l_linenumber = 4 UNION ALL SELECT l_orderkey, 'C-' || l_linenumber, 'V5b' FROM lineitem WHERE l_linenumber = 6")
def rollforward_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 and V5b from markdown: balances that don't roll forward."""
    return rules.balances(materialize(rules.class_rows(rules.prepare(deals(spark, sf_dir))), "classes")).select("deal_key", "label", "rule")


@query("SELECT l_orderkey AS deal_key, 'C-' || l_linenumber AS label FROM lineitem WHERE l_linenumber = 7")
def negative_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 from markdown: negative cells under amount headers."""
    p = rules.prepare(deals(spark, sf_dir))
    return rules.negatives(p, rules.class_rows(p), rules.waterfall_rows(p)).select("deal_key", "label")


@query("SELECT l_orderkey AS deal_key, CAST(0 AS BIGINT) AS errors, CAST(count_if(l_linenumber IN (4, 6, 7)) + 1 AS BIGINT) AS warnings, 'WARN' AS status FROM lineitem GROUP BY 1")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over all deals, and the status of each deal."""
    d = deals(spark, sf_dir)
    return rules.deal_status(d, rules.validate(d))


def _class_row(name: str = "A", original: str = "100.00", beginning: str = "100.00", rate: str = "5%", interest: str = "2.00", payable: str = "", principal: str = "10.00", ending: str = "90.00") -> str:
    return f"| {name} | {original} | {beginning} | {rate} | {interest} | {payable} | {principal} | | | | {ending} | |\n"


def _class_table(*rows: str, source: str = "") -> str:
    return "## Extracted Data\n### Class balance table (primary)\n| " + " | ".join(CLASS_HEADERS) + " |\n|" + "---|" * len(CLASS_HEADERS) + "\n" + "".join(rows) + f"\n## Source Text\n{source}\n"


def _waterfall(*rows: str, more: str = "") -> str:
    return "| Priority | Item / payee description | Amount paid | Amount payable | Amount available / running | Other amount columns | Notes |\n|---|---|---|---|---|---|---|\n" + "".join(f"| {r} | |\n" for r in rows) + more


_GRID = "\n| Class | Prior Principal | Interest Rate | Principal Paid | Interest Paid | Current Principal |\n|---|---|---|---|---|---|\n"
_TAXES, _FEES = "(a) | Taxes | 10.00 | 10.00 | 1,000.00 |", "| Main category | Sub category | Priority | Amount paid |\n|---|---|---|---|\n| Tax | tax_gross_amounts | (a) | 10.00 |\n"
_GOOD = {"text01": "x", "text02": _class_table(_class_row()), "text03": _waterfall(_TAXES), "text04": "x", "text05": _FEES}
#: A deal's files that differ from a faultless deal's, and the messages (rule, count) that they must give.
SCENARIOS: list[tuple[dict[str, str | None], dict[str, int]]] = [
    ({}, {}),
    ({"text01": None}, {"V0": 1}),
    ({"text02": None, "text04": None}, {"V0": 2}),
    ({"text02": "no table"}, {"V1": 1}),
    ({"text02": _class_table(_class_row(interest="0.00"), _class_row("B", interest="-"))}, {"V2": 1}),
    ({"text02": _class_table(_class_row(original="", beginning="", principal="", ending=""), _class_row("B", original="0.00", beginning="0.00", principal="", ending="0.00"))}, {"V4": 1}),
    ({"text02": _class_table(_class_row(ending="95.00"), _class_row("B"))}, {"V5": 1}),
    ({"text02": _class_table(_class_row(principal="100.00", ending="100.00"))}, {"V5b": 1}),
    ({"text02": _class_table(_class_row(interest="-2.00")), "text03": _waterfall(_TAXES, "(b) | Rent | -5.00 | | |")}, {"V6": 2}),
    ({"text03": _waterfall(_TAXES, "(b) | Rent | 30.00 | 40.00 | 30.00 |", "(c) | Rent | 20.00 | 20.00 | 900.00 | Unpaid 3.00")}, {"V6b": 1, "V6b_due": 1}),
    ({"text03": _waterfall(_TAXES, more="\n### Column mapping\n- Available for disbursements -> Amount paid\n")}, {"V6c": 1}),
    ({"text02": _class_table(_class_row(), *[_class_row(c, beginning="", rate="", interest="", principal="", ending="") for c in "BC"]) + "Distribution in US$\n"}, {"V6d": 1}),
    ({"text02": _class_table(_class_row(), _class_row("E-144A"), _class_row("E-REGS"))}, {"V6e": 1}),
    ({"text02": _class_table(_class_row(rate="")) + _GRID + "| A | 100.00 | 5.1% | 10.00 | 2.00 | 90.00 |\n"}, {"V7": 1}),
    ({"text02": _class_table(_class_row(rate="Floating"), source="Coupon 5.25%")}, {"V7b": 1}),
    ({"text02": _class_table(_class_row(interest="", payable="5.00"), _class_row("B")), "text03": _waterfall(_TAXES, "(d) | interest on the Class A Notes | 99.00 | 99.00 | 500.00 |")}, {"V8": 1, "V8b": 1}),
    ({"text05": None, "text03": _waterfall("(c) | Senior Management Fee | 30.00 | 30.00 | 500.00 |")}, {"V9": 1}),
    ({"text02": _class_table(_class_row(), source="> A\n> B-R\n> C")}, {"V10": 1}),
    ({"text03": "nothing", "text05": None}, {"V11": 1}),
    ({"text03": None, "text05": None}, {"V13": 1}),
    ({"text02": _class_table(_class_row()) + _GRID + "| A | 70.00 | 5.1% | 10.00 | 10.00 | 90.00 |\nDistribution in US$\n"}, {"V5c": 1, "V5d": 1}),
    ({"text03": _waterfall(_TAXES, more="\n## Source Text\n--- Page 3 of 9 ---\n> x\n")}, {"V12": 1}),
]


def _scenario_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a deal of one of the scenarios."""
    k = F.col("c_custkey") % len(SCENARIOS)
    files = [(_GOOD | changed) for changed, _ in SCENARIOS]
    texts = [F.element_at(F.array(*[F.lit(f[t]) for f in files]), (k + 1).cast("int")).alias(t) for t in _GOOD]
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("deal_key"), *texts)


_EXPECTED = ", ".join(f"({i}, '{rule}', {n})" for i, (_, wants) in enumerate(SCENARIOS) for rule, n in wants.items())


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS deal_key, rule, CAST(n AS BIGINT) AS n FROM customer JOIN (VALUES {_EXPECTED}) v(k, rule, n) ON c_custkey % {len(SCENARIOS)} = k")
def rule_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rule catalogue over deals with one planted fault each."""
    d = _scenario_deals(spark, sf_dir)
    pages = d.filter(F.col("text03").contains("--- Page 3")).select("deal_key", F.explode(F.array(F.lit(3), F.lit(4))).alias("page"))
    return rules.validate(d, pages).groupBy("deal_key", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey AS deal_key, bool_and(l_tax = 0) AS no_tax, bool_and(l_discount = 0) AS no_discount FROM lineitem GROUP BY 1""")
def all_zero_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 and V4: nothing in a column for a whole deal."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("deal_key")).agg(F.bool_and(P.nothing(F.col("l_tax"))).alias("no_tax"), F.bool_and(P.nothing(F.col("l_discount"))).alias("no_discount"))


@query("""
WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS q FROM lineitem GROUP BY 1)
SELECT o_orderkey, abs(q - floor(o_totalprice / 5000)) > greatest(0.02, 1e-8 * greatest(abs(q), abs(floor(o_totalprice / 5000)), 1)) AS differs FROM orders JOIN s ON o_orderkey = l_orderkey""")
def prior_current_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5d and J8: two views of one balance."""
    s = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    return read(spark, sf_dir, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", P.pair_differs(F.col("q"), F.floor(F.col("o_totalprice") / 5000).cast("double")).alias("differs"))


@query("""
WITH g AS (SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) * 1000 AS paid, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) * 1000 + l_suppkey % 3 * 100 AS cur FROM lineitem GROUP BY 1)
SELECT l_suppkey, cur > 1e6 AND abs(paid - cur) <= greatest(100, 1e-6 * greatest(abs(paid), abs(cur), 1)) AS same FROM g""")
def sum_vs_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column sums that agree."""
    g = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.sum("l_quantity") * 1000).alias("paid"))
    return g.select("l_suppkey", P.sums_match(F.col("paid"), F.col("paid") + F.col("l_suppkey") % 3 * 100).alias("same"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity > 0 AND l_linenumber % 3 = 0 AS paid_is_available, l_linenumber % 2 = 0 AND l_quantity % 5 > 0 AS due_is_paid FROM lineitem""")
def paid_column_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available or due amounts taken for paid."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.paid_is_available(q, F.when(n % 3 == 0, q).otherwise(q + 1)).alias("paid_is_available"), P.due_taken_for_paid(q, F.when(n % 2 == 0, q).otherwise(q + 1), q % 5).alias("due_is_paid"))


@query("SELECT source, count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY 1")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one side that the other lacks."""
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("missing"))


@query("""
SELECT DISTINCT a.p_brand AS deal_key, a.p_type AS label, b.p_type || '-R' AS long FROM part a JOIN part b ON a.p_brand = b.p_brand AND starts_with(b.p_type || '-R', a.p_type)""")
def prefix_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are strict prefixes of others of the same deal."""
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("deal_key"), F.col("p_type").alias("label")).distinct()
    longer = p.select("deal_key", F.concat("label", F.lit("-R")).alias("long"))
    return p.join(longer, "deal_key").filter(F.startswith("long", "label"))


@query("""
SELECT p_brand AS deal_key, p_type AS economic, count(*) AS slices FROM part WHERE p_partkey % 5 < 3 GROUP BY 1, 2""")
def slice_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6e: program slices under their economic class."""
    label = F.concat(F.col("p_type"), pick(F.col("p_partkey") % 5, ["-144A", " REGS", "-AI", "-X", ""]))
    d = read(spark, sf_dir, "part").select(F.col("p_brand").alias("deal_key"), S.economic_class(label).alias("economic")).filter("economic is not null")
    return d.groupBy("deal_key", "economic").agg(F.count(F.lit(1)).alias("slices"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 AND l_quantity > 0 THEN l_quantity END AS paydown,
  CASE WHEN l_linenumber % 3 = 0 AND l_quantity > 0 THEN l_quantity END AS subordinated, CASE WHEN l_linenumber % 4 = 0 THEN l_quantity ELSE 5.0 END AS interest FROM lineitem""")
def suggested_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts suggested, never merged."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    zero = F.lit(0.0)
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", P.suggested_paydown(zero, q, zero, F.when(n % 2 == 0, q).otherwise(q + 50)).alias("paydown"),
        P.subordinated_principal(zero, q, F.when(n % 3 == 0, zero).otherwise(q)).alias("subordinated"), P.interest_from_dividend(F.when(n % 4 == 0, zero).otherwise(F.lit(5.0)), q).alias("interest"),
    )


@query("""
SELECT l_orderkey, l_linenumber, max(l_quantity) AS principal, max(l_tax) AS interest, abs(max(l_quantity + l_tax + CASE WHEN l_linenumber = 3 THEN 1.0 ELSE 0.0 END) - (max(l_quantity) + max(l_tax))) > 0.02 AS total_is_off FROM lineitem GROUP BY 1, 2""")
def layout_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed headers mapped to fields by layout, pivoted, and totals checked."""
    printed = spark.createDataFrame([("A", "Principal Paid", "principal"), ("A", "Interest Paid", "interest"), ("A", "Total Payment", "total"), ("B", "Prin Distr", "principal"), ("B", "Int Distr", "interest"), ("B", "Total Distr", "total")], "layout string, header string, field string")
    li = read(spark, sf_dir, "lineitem").withColumn("layout", F.when(F.col("l_orderkey") % 2 == 0, "A").otherwise("B"))
    total = F.col("l_quantity") + F.col("l_tax") + F.when(F.col("l_linenumber") == 3, 1.0).otherwise(0.0)
    a = F.array(*[F.struct(F.when(F.col("layout") == "A", x).otherwise(y).alias("header"), v.alias("value")) for x, y, v in (("Principal Paid", "Prin Distr", F.col("l_quantity")), ("Interest Paid", "Int Distr", F.col("l_tax")), ("Total Payment", "Total Distr", total))])
    long = li.select("l_orderkey", "l_linenumber", "layout", F.inline(a)).join(F.broadcast(printed), ["layout", "header"])
    wide = long.groupBy("l_orderkey", "l_linenumber").pivot("field", ["principal", "interest", "total"]).agg(F.max("value"))
    return wide.select("l_orderkey", "l_linenumber", "principal", "interest", P.total_payment_off(F.col("total"), F.col("principal"), F.col("interest")).alias("total_is_off"))


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that occur more than once in a document."""
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


_LAYOUT_NAMES = list(layouts.LAYOUTS)


@query("""
SELECT o_custkey AS deal_key, o_orderkey AS "row", k AS layout, o_totalprice AS original_balance, o_totalprice + 1 AS beginning_balance,
  CASE WHEN k IN ('us_bank', 'notes_information', 'computershare') THEN CAST(o_orderkey % 50 AS DOUBLE) END AS interest_rate, CASE WHEN k IN ('deutsche', 'us_bank', 'notes_information', 'note_details') THEN o_totalprice + 2 END AS interest_payment,
  CASE WHEN k IN ('notes_information', 'opening_closing') THEN o_totalprice + 3 END AS interest_payable, o_totalprice + 4 AS principal_payment,
  CASE WHEN k = 'notes_information' THEN CASE WHEN o_custkey % 2 = 0 THEN o_totalprice + 5 ELSE o_totalprice + 6 END WHEN k IN ('computershare', 'opening_closing') THEN o_totalprice + 5 END AS deferred_interest,
  CASE WHEN k = 'note_details' THEN 0.0 ELSE o_totalprice + 7 END AS ending_balance, CASE WHEN k IN ('deutsche', 'us_bank') THEN o_totalprice + 8 END AS total_payment
FROM (SELECT *, ['deutsche', 'us_bank', 'notes_information', 'computershare', 'opening_closing', 'note_details'][CAST(o_orderkey % 6 AS INTEGER) + 1] AS k FROM orders)""")
def layout_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed headers of six layouts mapped to fields."""
    step = {"original_balance": 0, "beginning_balance": 1, "interest_payment": 2, "interest_payable": 3, "principal_payment": 4, "deferred_interest": 5, "ending_balance": 7, "total_payment": 8}
    arms = None
    for layout in _LAYOUT_NAMES:
        cells = []
        for header, field, rank in layouts.LAYOUTS[layout]:
            if header in ("Current Principal Balance", "Ending/Current Principal Balance") and layout == "us_bank":
                continue
            value = money(F.col("o_orderkey") % 50 if field == "interest_rate" else F.col("o_totalprice") + step[field] + 1000 * rank)
            if header == "Deferred Interest Paid":
                value = F.when(F.col("o_custkey") % 2 == 0, value).otherwise("0.00")
            elif header == "Deferred Interest Due":
                value = money(F.col("o_totalprice") + 6)
            elif layout == "note_details" and field == "ending_balance":
                value = F.lit(" - ")
            cells.append(F.struct(F.lit(len(cells)).alias("seq"), F.lit(header.upper().replace(" ", "\n", 1)).alias("header"), value.alias("value")))
        arms = F.when(F.col("layout") == layout, F.array(*cells)) if arms is None else arms.when(F.col("layout") == layout, F.array(*cells))
    d = read(spark, sf_dir, "orders").withColumn("layout", pick(F.col("o_orderkey") % 6, _LAYOUT_NAMES))
    return layouts.rename_columns(d.select(F.col("o_custkey").alias("deal_key"), F.col("o_orderkey").alias("row"), "layout", F.inline(arms)))


@query("""
SELECT l_orderkey AS deal_key, l_linenumber % 2 AS "section", count(*) AS lines, CASE WHEN l_orderkey % 3 = 0 THEN 'N' WHEN l_orderkey % 3 = 1 THEN 'partial' ELSE 'Y' END AS "match" FROM lineitem GROUP BY 1, 2""")
def section_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of sections against their Sub Totals, of which every third order lacks them and every third is off."""
    d = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deal_key"), (F.col("l_linenumber") % 2).alias("section"), F.col("l_extendedprice").alias("beginning_balance"))
    stated = d.filter("deal_key % 3 <> 1").groupBy("deal_key", "section").agg((F.sum("beginning_balance") + F.when(F.col("deal_key") % 3 == 0, 1.0).otherwise(0.0)).alias("beginning_balance"))
    return layouts.section_sums(d, stated).select("deal_key", "section", "lines", "match")


@query("""
SELECT l_orderkey AS deal_key, l_partkey % 3 AS page, count(*) AS labels, count_if(l_linenumber <> 3) AS bands, CASE WHEN count_if(l_linenumber = 3) > 0 THEN 'N' ELSE 'Y' END AS "match" FROM lineitem GROUP BY 1, 2""")
def label_band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against bands of a page, the third line without a band."""
    d = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deal_key"), (F.col("l_partkey") % 3).alias("page"), F.explode(F.when(F.col("l_linenumber") == 3, F.array(F.lit("label"))).otherwise(F.array(F.lit("label"), F.lit("band")))).alias("kind"))
    return layouts.band_counts(d)


@query("""
SELECT l_orderkey AS deal_key, l_returnflag AS economic, count(*) AS lines, CASE l_orderkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'Y' WHEN 2 THEN 'N' ELSE 'partial' END AS "match" FROM lineitem GROUP BY 1, 2""")
def listing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings against primary rows (off by one in two orders of four, missing in one) and printed totals (right in one of those)."""
    d = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deal_key"), F.col("l_returnflag").alias("economic"), F.col("l_extendedprice").alias("amount"))
    sums, k = d.groupBy("deal_key", "economic").agg(F.sum("amount").alias("amount")), F.col("deal_key") % 4
    primary = sums.filter(k != 3).withColumn("amount", F.col("amount") + F.when(k == 0, 0.0).otherwise(1.0))
    return layouts.listing_sums(d, primary, sums.filter(k == 1)).select("deal_key", "economic", "lines", "match")


@query("""
SELECT l_orderkey AS deal_key, f.field, count(*) AS lines, CASE WHEN f.field = 'principal_payment' AND l_orderkey % 2 = 0 THEN 'N' ELSE 'Y' END AS "match" FROM lineitem, (VALUES ('principal_payment'), ('interest_payment')) f(field) GROUP BY 1, 2""")
def totals_row_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals rows against their detail, principal off in even orders."""
    d = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deal_key"), F.lit(False).alias("is_total"), F.col("l_extendedprice").alias("principal_payment"), F.col("l_quantity").alias("interest_payment"))
    off = F.when(F.col("deal_key") % 2 == 0, 1.0).otherwise(0.0)
    total = d.groupBy("deal_key").agg(F.lit(True).alias("is_total"), (F.sum("principal_payment") + F.first(off)).alias("principal_payment"), F.sum("interest_payment").alias("interest_payment"))
    return layouts.totals_rows(d.unionByName(total), ["principal_payment", "interest_payment"]).select("deal_key", "field", "lines", "match")


_FEE_CODES = ["DEFERRED_SENIOR_MANAGEMENT_FEES_2", "retention_fee_b1", "retention_fees_3", "apex_revolver", "interest_diversion_cure", " tax_gross_amounts ", "hedge_fees", "other_fees_02", "unheard_of_fees"]
_BANDS_SQL = "['management', 'retention', 'retention', 'reserve', 'reserve', 'administrative', 'hedge', 'other', NULL]"


@query(f"SELECT {_BANDS_SQL}[CAST(p_partkey % 9 AS INTEGER) + 1] AS band, count(*) AS lines FROM part GROUP BY 1")
def fee_band_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fee codes by the six bands."""
    d = read(spark, sf_dir, "part").select(pick(F.col("p_partkey") % len(_FEE_CODES), _FEE_CODES).alias("fee_type"))
    return layouts.band_fees(d).groupBy("band").agg(F.count(F.lit(1)).alias("lines"))


# --- fees -------------------------------------------------------------------------------------


DESCRIPTIONS = [
    "Taxes", "payment of taxes of the issuer", "to the Trustee", "Senior Management Fee", "Subordinated Management Fee", "Hedge Counterparty payments", "Something unlabelled", "Expense Reserve Account",
    "Ernst & Young", "independent accountants and counsel", "Co-Issuer admin expense", "any other person", "issuer fee", "trustee and collateral administrator", "additional collateral management fee",
    "payable to the collateral manager", "incentive management fee", "performance fee of the manager", "collateral administrator", "collateral management expenses", "administrative expense to the bank",
    "administrative expense cap", "servicing fee", "annual fee", "rating agency", "note payment sequence", "interest on the Class A Notes", "collateral manager",
]


def classify_sql(d: str) -> str:
    """The ordered class table as one SQL CASE."""
    test = lambda p: f"regexp_matches({d}, '{p.replace(chr(39), chr(39) * 2)}')"
    arms = []
    for need, never, main, sub in fees.CLASSES:
        parts = [test(p) for p in need] + ["NOT (" + " AND ".join(test(q) for q in ([p] if isinstance(p, str) else p)) + ")" for p in never]
        arms.append(f"WHEN {' AND '.join(parts)} THEN '{main}|{sub}'")
    return f"CASE {' '.join(arms)} ELSE '{'|'.join(fees.CATCH_ALL)}' END"


_DESC = f"{sql_pick(f'p_partkey % {len(DESCRIPTIONS)}', DESCRIPTIONS)}"
_CLASSED = f"(SELECT p_partkey, p_brand, p_size, d, CASE WHEN c LIKE 'Other|%' THEN 'Administrative expense|administrator_expenses' ELSE c END AS c FROM (SELECT *, {classify_sql('lower(d)')} AS c FROM (SELECT *, {_DESC} AS d FROM part)))"


@query(f"SELECT p_partkey, string_split(c, '|')[1] AS main, string_split(c, '|')[2] AS sub FROM {_CLASSED}")
def fee_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered classifier."""
    c = fees.downstream(pick(F.col("p_partkey") % len(DESCRIPTIONS), DESCRIPTIONS))
    return read(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.main", "c.sub")


@query(f"SELECT p_brand, count_if(regexp_matches({_DESC}, '{fees.FEE_KEYWORDS}')) AS hits FROM part GROUP BY 1")
def fee_keyword_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with fee wording."""
    d = pick(F.col("p_partkey") % len(DESCRIPTIONS), DESCRIPTIONS)
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(d.rlike(fees.FEE_KEYWORDS)).alias("hits"))


def _fee_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pick(F.col("p_partkey") % len(DESCRIPTIONS), DESCRIPTIONS)
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("deal_key"), F.lit("waterfall").alias("source"), F.col("p_partkey").alias("seq"), d.alias("description"), F.concat(F.lit("("), F.col("p_partkey").cast("string"), F.lit(")")).alias("priority"), F.col("p_size").cast("double").alias("amount"))


@query(f"SELECT p_brand AS deal_key, string_split(c, '|')[1] AS main_category, string_split(c, '|')[2] AS sub_category, format('{{:,.2f}}', CAST(sum(p_size) AS DOUBLE)) AS amount_paid, CASE WHEN count(*) = 1 THEN '(' || max(p_partkey) || ')' ELSE '—' END AS priority, count(*) AS lines FROM {_CLASSED} GROUP BY 1, 2, 3")
def fee_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified lines summed by sub category."""
    return fees.roll_up(fees.map_lines(_fee_lines(spark, sf_dir))).select("deal_key", "main_category", "sub_category", "amount_paid", "priority", "lines")


@query("SELECT l_orderkey AS deal_key, CAST(min(l_linenumber) AS INTEGER) AS seq, l_quantity AS amount FROM lineitem GROUP BY l_orderkey, l_quantity")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate per payment key, the first one."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deal_key"), F.lit("waterfall").alias("source"), F.col("l_linenumber").alias("seq"), F.lit("to the Trustee").alias("description"), F.lit("(a)").alias("priority"), F.col("l_quantity").alias("amount"))
    return fees.first_wins(li).select("deal_key", "seq", "amount")


@query("""
SELECT l_orderkey AS deal_key, l_quantity AS amount, CAST(min(l_linenumber) FILTER (n = m) AS INTEGER) AS seq FROM (
  SELECT *, length(repeat('x', CAST(l_linenumber % 3 AS INTEGER))) AS n, max(l_linenumber % 3) OVER (PARTITION BY l_orderkey, l_quantity) AS m FROM lineitem) GROUP BY 1, 2""")
def dedupe_best_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal amounts the most specific description, the first of equals."""
    text = F.concat(F.lit("to the Trustee"), F.repeat(F.lit("x"), (F.col("l_linenumber") % 3).cast("int")))
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deal_key"), F.lit("waterfall").alias("source"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("trustee "), text).alias("description"), F.lit("").alias("priority"), F.col("l_quantity").alias("amount"))
    return fees.map_lines(li).select("deal_key", "amount", "seq")


@query("""
SELECT l_orderkey AS deal_key, l_linenumber AS seq FROM lineitem s WHERE l_linenumber % 2 = 0 AND NOT EXISTS (
  SELECT 1 FROM lineitem p WHERE p.l_linenumber % 2 = 1 AND p.l_orderkey = s.l_orderkey AND p.l_quantity = s.l_quantity AND p.l_partkey % 3 = s.l_partkey % 3)""")
def supplemental_anti_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplements that repeat no primary fee."""
    d = pick(F.col("l_partkey") % 3, ["to the Trustee", "Senior Management Fee", "Hedge Counterparty payments"])
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deal_key"), F.lit("waterfall").alias("source"), F.col("l_linenumber").alias("seq"), d.alias("description"), F.lit("").alias("priority"), F.col("l_quantity").alias("amount"))
    return fees.without_repeats(li.filter("seq % 2 = 0"), li.filter("seq % 2 = 1")).select("deal_key", "seq")


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity END AS paid, CASE l_linenumber % 3 WHEN 0 THEN l_quantity WHEN 1 THEN 0.0 END AS payable,
  CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 1 THEN 1000.0 END AS avail, CASE CAST(l_partkey % 4 AS INTEGER) WHEN 0 THEN l_quantity WHEN 1 THEN 7.5 WHEN 2 THEN 0.0 END AS src FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE
  WHEN paid IS NULL THEN (CASE WHEN src > 0 THEN src END)
  WHEN src > 0 AND paid > 0 AND abs(paid - src) > 0.01 THEN (CASE WHEN payable > 0 AND abs(payable - paid) <= 0.01 THEN paid WHEN abs(avail - paid) <= 0.01 THEN src ELSE paid END)
  WHEN payable > 0 AND abs(payable - avail) <= 0.01 AND abs(paid - payable) < 0.01 THEN payable
  WHEN abs(avail - paid) <= 0.01 AND paid > 0 THEN (CASE WHEN (payable > 0 AND abs(payable - paid) <= 0.01) OR (src > 0 AND abs(src - paid) <= 0.01) THEN paid END)
  WHEN src = 0 AND paid > 0 AND coalesce(payable, 0) = 0 THEN NULL
  WHEN src IS NULL AND paid > 0 AND coalesce(payable, 0) = 0 AND coalesce(avail, 0) = 0 THEN NULL ELSE paid END AS cash FROM v""")
def effective_paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered decision on cash paid."""
    q, n, k = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_partkey") % 4
    cash = fees.effective_paid(F.when(n != 6, q), F.when(n % 3 == 0, q).when(n % 3 == 1, 0.0), F.when(n % 4 == 0, q).when(n % 4 == 1, 1000.0), F.when(k == 0, q).when(k == 1, 7.5).when(k == 2, 0.0))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cash.alias("cash"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 2 THEN 0.0 WHEN 3 THEN NULL ELSE l_extendedprice END AS paid, CASE WHEN l_linenumber % 4 < 3 THEN 'to the Trustee' END AS description FROM lineitem""")
def source_paid_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paid amounts from the tails of source lines."""
    m, n = money(F.col("l_extendedprice")), F.col("l_linenumber") % 4
    four = F.concat(F.lit("to the Trustee 9.00 8.00 "), m, F.lit(" 0.00"))
    dollars = F.concat(F.lit("to the Trustee $9.00 $"), m, F.lit(" $8.00 $0.00"))
    pool = F.concat(F.lit("to the Trustee $0.00 $"), m, F.lit(" $0.00"))
    line = F.when(n == 0, four).when(n == 1, dollars).when(n == 2, pool).otherwise("no amounts here")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fees.source_paid(line).alias("r")).select("l_orderkey", "l_linenumber", "r.paid", "r.description")


WATERFALL_HEADERS = ["Priority", "Item / payee description", "Amount paid", "Amount payable", "Amount available / running", "Other amount columns", "Notes"]


def waterfall_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a waterfall: fee lines, class cash on every third line."""
    n = F.col("l_linenumber")
    d = F.when(n % 3 == 0, "interest on the Class A Notes").otherwise(pick(n % 5, ["to the Trustee", "Senior Management Fee", "Taxes", "Hedge Counterparty payments", "Something unlabelled"]))
    li = read(spark, sf_dir, "lineitem").withColumns({"d": d, "pri": F.concat(F.lit("("), n.cast("string"), F.lit(")"))})
    m = money(F.col("l_quantity"))
    md = _markdown(li, "l_orderkey", "l_linenumber", WATERFALL_HEADERS, [F.col("pri"), F.col("d"), m, m, F.lit("999,999.00"), F.lit(""), F.lit("")])
    none = F.lit(None).cast("string")
    return md.select("deal_key", none.alias("text01"), none.alias("text02"), F.col("text").alias("text03"), none.alias("text04"), none.alias("text05"))


@query("""
SELECT l_orderkey AS deal_key, CASE l_linenumber % 5 WHEN 0 THEN 'trustee_expenses' WHEN 1 THEN 'senior_management_fees' WHEN 2 THEN 'tax_gross_amounts' WHEN 3 THEN 'fees_to_hedge_counterparty' ELSE 'administrator_expenses' END AS sub_category,
  format('{:,.2f}', CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)) AS amount_paid FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber % 3 <> 0) GROUP BY 1, 2""")
def fee_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 to P12 from markdown: waterfall to roll-up."""
    return fees.map_fees(rules.prepare(waterfall_deals(spark, sf_dir)))[1].select("deal_key", "sub_category", "amount_paid")


@query("SELECT l_orderkey AS deal_key, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS cash FROM (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber % 3 = 0) GROUP BY 1")
def class_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class cash with either-key dedup (equal descriptions, so by amount)."""
    return rules.class_cash(rules.prepare(waterfall_deals(spark, sf_dir)))


# --- resolution and reconciliation -----------------------------------------------------------


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = read(spark, sf_dir, "supplier").withColumns({"deal_key": F.col("s_nationkey"), "letter": F.substring(F.lit("ABCDE"), (F.col("s_suppkey") % 5 + 1).cast("int"), F.lit(1)), "n": (F.col("s_suppkey") % 7).cast("string")})
    code = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    label = F.concat(F.lit("Class "), F.col("letter"), F.lit("-"), F.col("n"), F.lit(" Senior Secured Notes due "), F.col("s_suppkey").cast("string"))
    classes = s.select("deal_key", label.alias("class"), F.lit("Deal One").alias("deal_name"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("bad"), code)).otherwise(F.array().cast("array<string>")).alias("codes"))
    codes = s.filter("s_suppkey % 6 = 0").select("deal_key", code.alias("code"), F.col("s_suppkey").alias("tranche_id"))
    codes = codes.unionByName(codes.filter("tranche_id % 12 = 0").withColumn("tranche_id", F.col("tranche_id") + 100_000))
    names = s.filter("s_suppkey % 2 = 1").select("deal_key", F.concat("letter", "n").alias("name"), F.col("s_suppkey").alias("tranche_id"))
    return classes, codes, names


@query("""
WITH s AS (SELECT s_suppkey, s_nationkey AS deal_key, substr('ABCDE', CAST(s_suppkey % 5 + 1 AS INTEGER), 1) || (s_suppkey % 7) AS norm FROM supplier),
n AS (SELECT deal_key, norm, count(DISTINCT s_suppkey) AS k, min(s_suppkey) AS id FROM s WHERE s_suppkey % 2 = 1 GROUP BY 1, 2)
SELECT s.deal_key, s.s_suppkey AS supplier, s.norm, CASE WHEN s_suppkey % 12 = 0 THEN NULL WHEN s_suppkey % 6 = 0 THEN s_suppkey WHEN k = 1 THEN n.id END AS tranche_id,
  CASE WHEN s_suppkey % 12 = 0 THEN 'ambiguous' WHEN s_suppkey % 6 = 0 THEN 'ok' WHEN k = 1 THEN 'ok' WHEN s_suppkey % 3 = 0 THEN 'unmapped' WHEN k > 1 THEN 'ambiguous' ELSE 'unmapped' END AS status,
  CASE WHEN s_suppkey % 6 = 0 THEN 'cusip' WHEN k = 1 AND s_suppkey % 3 = 0 THEN 'cusip+name' WHEN s_suppkey % 3 = 0 THEN 'cusip' ELSE 'name' END AS tier
FROM s LEFT JOIN n USING (deal_key, norm)""")
def two_tier_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes resolved by code, then by name."""
    r = resolve.resolve(*_classes(spark, sf_dir))
    return r.select("deal_key", F.regexp_extract("class", r"(\d+)$", 1).cast("long").alias("supplier"), "norm", "tranche_id", "status", "tier")


@query("""
WITH s AS (SELECT s_suppkey, s_nationkey AS deal_key, substr('ABCDE', CAST(s_suppkey % 5 + 1 AS INTEGER), 1) || (s_suppkey % 7) AS norm FROM supplier),
n AS (SELECT deal_key, norm, count(DISTINCT s_suppkey) AS k, min(s_suppkey) AS id FROM s WHERE s_suppkey % 2 = 1 GROUP BY 1, 2),
r AS (SELECT s.*, s_suppkey % 3 > 0 AND s_suppkey % 4 = 0 AS own, CASE WHEN s_suppkey % 12 = 0 THEN 'ambiguous' WHEN s_suppkey % 6 = 0 THEN 'ok' WHEN k = 1 THEN 'ok' WHEN s_suppkey % 3 = 0 THEN 'unmapped' WHEN k > 1 THEN 'ambiguous' ELSE 'unmapped' END AS st,
  CASE WHEN s_suppkey % 12 = 0 THEN NULL WHEN s_suppkey % 6 = 0 THEN s_suppkey WHEN k = 1 THEN n.id END AS id FROM s LEFT JOIN n USING (deal_key, norm)),
t AS (SELECT deal_key, s_suppkey AS supplier, own, CASE WHEN own THEN 'ok' ELSE st END AS status, CASE WHEN own THEN CAST(s_suppkey AS VARCHAR) ELSE CAST(id AS VARCHAR) END AS tranche_id FROM r)
SELECT deal_key, supplier, status, tranche_id, own OR (supplier % 6 = 0 AND supplier % 12 > 0 AND supplier % 4 > 0 AND supplier % 5 = 0) AS already,
  CASE WHEN tranche_id IS NULL THEN 'no_data' WHEN CAST(tranche_id AS BIGINT) % 2 = 0 THEN 'ok' ELSE 'no_match' END AS tm_status,
  CASE WHEN CAST(tranche_id AS BIGINT) % 2 = 0 THEN CASE WHEN CAST(tranche_id AS BIGINT) = supplier AND supplier % 4 = 0 THEN 'match' ELSE '+2.00' END ELSE '' END AS diff_original_balance FROM t""")
def export_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class rows of exports, their own ids trusted or resolved anew, beside the master's balances."""
    classes, codes, names = _classes(spark, sf_dir)
    k = F.regexp_extract("class", r"(\d+)$", 1).cast("long")
    d = classes.withColumns({"supplier": k, "xml_id": F.when((k % 4 == 0) | (k % 5 == 0), k.cast("string")), "xml_status": F.when((k % 4 == 0) | ((k % 5 == 0) & (k % 3 == 0)), "ok").otherwise("unmapped"), "xml_tier": F.lit(""), "payment_date": F.lit("2024-01-01")})
    d = d.withColumn("original_balance", money(k + F.when(k % 4 == 0, 0).otherwise(2)))
    master = read(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("deal_key"), F.col("s_suppkey").alias("tranche_id"), F.col("s_suppkey").alias("orig_balance"))
    r = resolve.process_export(d, codes, names, master=master)
    return r.select("deal_key", "supplier", "status", "tranche_id", "already", "tm_status", "diff_original_balance")


LABELS = ["Class A-1 R Notes", "A-1-R_Loan", "Subordinated Notes B", "Class M-1 Subordinated Notes", "Preferred Shares", "Income Notes", "Series II Combination Securities", "Performance Notes", "Class A CP Notes", "DEAL 2018-70A SUB A", "Combo Notes", "PSA", "A 1 Floating Rate Notes"]
LABEL_KEYS = ["A1R", "A1RL", "SUBB", "M1", "PS2", "INC", "SERIES2", "P", "ACP", "SUBA", "COMB", "SUBA", "A1"]


@query(f"SELECT p_partkey, {sql_pick(f'p_partkey % {len(LABELS)}', LABEL_KEYS)} AS key FROM part")
def class_label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 to M3: printed labels and their keys."""
    return read(spark, sf_dir, "part").select("p_partkey", L.class_key(pick(F.col("p_partkey") % len(LABELS), LABELS), F.lit(None).cast("string"), F.lit(0), F.lit(True)).alias("key"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items beside a copy that is perturbed by line number."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    d = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("deal_key"), "l_orderkey", n.alias("n"), q.alias("e_balance"), F.when(n == 1, q + 0.5).when(n == 2, q - 2).when(n == 3, F.lit(None)).otherwise(q).alias("d_balance"))
    return d.withColumns({"e_rate": F.when(F.col("n") == 4, 0.05).otherwise(5.0), "d_rate": F.lit(5.0)})


@query("""
SELECT l_orderkey, l_linenumber AS n, 'balance' AS field, CASE l_linenumber WHEN 1 THEN '-0.5000' WHEN 2 THEN '+2.00' WHEN 3 THEN '' ELSE 'match' END AS diff FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'rate', 'match' FROM lineitem""")
def field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 and M8: signed differences of extracted and stored fields."""
    return resolve.field_differences(_facts(spark, sf_dir), ["l_orderkey", "n"], ["balance", "rate"], text=False)


@query("""
WITH d AS (SELECT l_returnflag AS deal_key, count_if(l_linenumber <> 3) AS compared, count_if(l_linenumber > 3) AS matched, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ()))
SELECT coalesce(deal_key, 'TOTAL') AS deal_key, 'balance' AS field, compared, matched, round(100.0 * matched / compared, 1) AS rate FROM d
UNION ALL SELECT coalesce(deal_key, 'TOTAL'), 'rate', n, n, 100.0 FROM d""")
def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: match rates per deal and in total."""
    return reconcile.match_rates(resolve.field_differences(_facts(spark, sf_dir), ["deal_key"], ["balance", "rate"], text=False))


@query("""
WITH s AS (SELECT s_nationkey AS deal_key, s_suppkey % 12 AS t FROM supplier WHERE s_suppkey % 12 > 3)
SELECT deal_key, t AS tranche_id, count(*) AS classes FROM s GROUP BY 1, 2 HAVING count(*) > 1""")
def id_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids shared by several classes."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("deal_key"), F.col("s_name").alias("class"), F.when(F.col("s_suppkey") % 12 > 3, F.col("s_suppkey") % 12).alias("tranche_id"))
    return resolve.id_conflicts(s).select("deal_key", "tranche_id", F.size("classes").cast("long").alias("classes"))


@query("""
SELECT s_nationkey AS deal_key, count(*) AS class_rows, count_if(s_suppkey % 3 = 0) AS mapped_ok, count_if(s_suppkey % 3 = 1) AS unmapped, count_if(s_suppkey % 3 = 2) AS ambiguous, round(100.0 * count_if(s_suppkey % 3 = 0) / count(*), 1) AS rate,
  CASE WHEN count_if(s_suppkey % 3 = 0) = 0 THEN 'missing' WHEN count_if(s_suppkey % 3 = 0) < count(*) THEN 'partial' ELSE 'ok' END AS status FROM supplier GROUP BY 1""")
def deal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping counts and status per deal."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("deal_key"), pick(F.col("s_suppkey") % 3, ["ok", "unmapped", "ambiguous"]).alias("status"))
    return reconcile.map_rates(s)


# --- revised reports -------------------------------------------------------------------------


def _long(d: DataFrame, factor: Column) -> DataFrame:
    return d.select(F.col("o_custkey").alias("deal_key"), F.col("o_orderkey").cast("string").alias("label"), F.lit("ending balance").alias("field"), money(F.floor("o_totalprice") * factor).alias("value"))


@query("""
SELECT o_custkey AS deal_key, CAST(o_orderkey AS VARCHAR) AS label, CASE WHEN o_orderkey % 4 = 1 OR floor(o_totalprice) = 0 THEN 'LOW' ELSE 'HIGH' END AS severity FROM orders WHERE o_orderkey % 4 IN (1, 2) AND o_orderkey % 5 > 1
UNION ALL SELECT o_custkey, CAST(o_orderkey AS VARCHAR), 'CRITICAL' FROM orders WHERE o_orderkey % 5 <= 1""")
def revised_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and changed balances with severities."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    old = _long(o.filter("o_orderkey % 5 <> 0"), F.lit(1.0))
    new = _long(o.filter("o_orderkey % 5 <> 1"), F.when(k == 1, 1.001).when(k == 2, 1.5).otherwise(1.0))
    return diff.membership_changes(old, new, "Class balances", "(class)", "CRITICAL").unionByName(diff.numeric_changes(old, new, "Class balances", diff.CLASS_FIELDS)).select("deal_key", "label", "severity")


@query("""
WITH f AS (SELECT o_custkey AS deal_key, o_orderpriority AS label, CAST(count_if(o_orderkey % 3 = 0) AS DOUBLE) * 600 AS d FROM orders GROUP BY 1, 2)
SELECT deal_key, label, CASE WHEN d > 1000 THEN 'HIGH' ELSE 'LOW' END AS severity FROM f WHERE d > 0.01""")
def fee_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees summed by type and compared."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("deal_key"), F.col("o_orderpriority").alias("label"), F.lit(1000.0).alias("amount"), "o_orderkey")
    new = o.withColumn("amount", F.when(F.col("o_orderkey") % 3 == 0, 1600.0).otherwise(1000.0))
    return diff.fee_changes(o, new).select("deal_key", "label", "severity")


@query("""
SELECT CASE WHEN v = 0 THEN 'NO CHANGE' WHEN k = 1 AND v * 0.001 > 0.01 THEN 'LOW' WHEN k = 2 AND v * 0.5 > 0.01 THEN 'HIGH' ELSE 'NO CHANGE' END AS severity, count(*) AS n
FROM (SELECT o_orderkey % 4 AS k, floor(o_totalprice) AS v FROM orders) GROUP BY 1""")
def numeric_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities by percent of change."""
    k, v = F.col("o_orderkey") % 4, F.floor("o_totalprice").cast("double")
    s = P.severity_of_change(v, F.when(k == 1, v * 1.001).when(k == 2, v * 1.5).otherwise(v), 0.5)
    return read(spark, sf_dir, "orders").groupBy(s.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def _reports(spark: SparkSession, sf_dir: str, revised: bool) -> DataFrame:
    """Each order as a report with account tables or labelled amounts, and note values."""
    n = F.col("o_orderkey")
    v = F.floor("o_totalprice").cast("double")
    now = v * F.when((n % 4 == 1) & F.lit(revised), 2.0).otherwise(1.0)
    table = F.concat(F.lit("| Interest Collection Account | Amount |\n|---|---|\n| Opening Balance | "), money(now), F.lit(" |\n| Received | 5.00 |\n| Opening balance | "), money(now + 1), F.lit(" |\n"))
    lines = F.concat(F.lit("Principal account\nOpening: "), money(now), F.lit("\nclosing 7.00\n"))
    note = F.concat(F.lit("| Class | Note value |\n|---|---|\n| A | "), money(now), F.lit(" |\n"), F.when((n % 5 == 2) & F.lit(revised), "").otherwise("| B | 10.00 |\n"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("deal_key"), F.lit("x").alias("text01"), F.lit("").alias("text02"), F.when(n % 3 == 0, table).when(n % 3 == 1, lines).otherwise(F.lit("none")).alias("text03"),
        note.alias("text04"), F.lit(None).cast("string").alias("text05"),
    )


@query("""
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS deal_key, o_orderkey % 3 AS k, o_orderkey % 4 = 1 AS twice, o_orderkey % 5 = 2 AS gone FROM orders)
SELECT deal_key, 'ICA (Interest Collection Account)' AS category, 'Opening Balance' AS label, 'HIGH' AS severity FROM o WHERE k = 0 AND twice
UNION ALL SELECT deal_key, 'PCA (Principal Collection Account)', 'Opening', 'HIGH' FROM o WHERE k = 1 AND twice
UNION ALL SELECT deal_key, 'Note Valuation (PV)', 'A', 'CRITICAL' FROM o WHERE twice
UNION ALL SELECT deal_key, 'Note Valuation (PV)', 'B', 'HIGH' FROM o WHERE gone""")
def account_and_note_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts and note values read from the files and compared."""
    old, new = _reports(spark, sf_dir, False), _reports(spark, sf_dir, True)
    return diff.account_changes(old, new).unionByName(diff.value_changes(old, new)).select("deal_key", "category", "label", "severity")


@query("""
WITH c AS (SELECT o_orderkey AS deal_key, o_orderkey % 3 AS k FROM orders)
SELECT deal_key, '# Revised Report Comparison' || chr(10) || chr(10) || '## Summary' || chr(10) || '| Metric | Value |' || chr(10) || '|---|---|' || chr(10) || '| Deal | ' || deal_key || ' |' || chr(10)
  || '| CRITICAL changes | ' || CASE k WHEN 1 THEN 1 ELSE 0 END || ' |' || chr(10) || '| HIGH changes | ' || CASE k WHEN 2 THEN 1 ELSE 0 END || ' |' || chr(10) || '| LOW changes | 0 |' || chr(10) || '| Total changed fields | ' || CASE WHEN k > 0 THEN 1 ELSE 0 END || ' |'
  || chr(10) || chr(10) || '**Summary narrative:** ' || CASE k WHEN 0 THEN 'No material changes found between the original and revised report.' WHEN 1 THEN 'CRITICAL class changes: A ending balance.' ELSE '1 HIGH-severity field(s) changed.' END AS head,
  CASE WHEN k = 1 THEN '| A | ending balance | 1.00 | 3.00 | +2.00 | +200.0000% | CRITICAL |' ELSE '_No changes detected (or data not available in this report type)._' END AS classes FROM c""")
def comparison_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: the text of the comparison report, its head and its class section."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deal_key"))
    k, text = F.col("deal_key") % 3, lambda a, b: F.when(F.col("deal_key") % 3 == 1, a).otherwise(b)
    changes = o.filter(k > 0).select("deal_key", text("Class balances", "Key dates").alias("category"), text("A", "record date").alias("label"), text("ending balance", "record date").alias("field"), F.lit("1.00").alias("original"), F.lit("3.00").alias("revised"), F.lit("+2.00").alias("change"), F.lit("+200.0000%").alias("change_pct"), text("CRITICAL", "HIGH").alias("severity"))
    part = F.element_at(F.split(F.regexp_extract("text", r"(?s)## Class balances\n(.*?)\n\n## Fees", 1), "\n"), -1)
    return comparison_report(o, changes).select("deal_key", F.regexp_replace(F.regexp_extract("text", r"(?s)\A(.*?)\n## Note", 1), r"\n+\z", "").alias("head"), part.alias("classes"))


# --- pages ------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT page_id // 100 AS deal_key, page_id % 100 + 1 AS page, coalesce(html, '') AS html FROM pages)
SELECT deal_key, (page - 1) // 30 AS chunk, min(page) AS "first", max(page) AS "last", CAST(sum(length(html) + length(printf('--- Page %d of %d ---', page, 100)) + 1) + 2 * (count(*) - 1) AS BIGINT) AS chars FROM p GROUP BY 1, 2""")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in chunks of thirty."""
    p = read(spark, sf_dir, "pages").select(F.expr("page_id div 100").alias("deal_key"), F.lit("primary").alias("tree"), (F.col("page_id") % 100 + 1).alias("page"), F.lit(100).alias("total"), F.col("html").alias("text"))
    return pages.chunk_pages(p).select("deal_key", "chunk", "first", "last", F.length("text").cast("long").alias("chars"))


@query("""
WITH p AS (SELECT page_id // 30 AS deal_key, page_id % 30 + 1 AS page, coalesce(html, '') AS html FROM pages)
SELECT deal_key, CASE WHEN count_if(page % 3 = 0) > 0 THEN CAST(sum(CASE WHEN page % 3 = 0 THEN length(regexp_replace(printf('--- Page %d of %d ---', page, 30) || chr(10) || html, '\\s+$', '')) ELSE 0 END) + 2 * (count_if(page % 3 = 0) - 1) + 37 + 1 AS BIGINT)
  ELSE CAST(sum(length(html) + length(printf('--- Page %d of %d ---', page, 30)) + 1) + 2 * (count(*) - 1) AS BIGINT) END AS chars FROM p GROUP BY 1""")
def filter_chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page of a chunk; the whole chunk where there is none."""
    p = read(spark, sf_dir, "pages").select(F.expr("page_id div 30").alias("deal_key"), F.lit("primary").alias("tree"), (F.col("page_id") % 30 + 1).alias("page"), F.lit(30).alias("total"), F.col("html").alias("text"))
    wanted = F.filter(F.sequence(F.lit(1), F.lit(30)), lambda x: x % 3 == 0)
    return pages.chunk_pages(p).select("deal_key", F.length(pages.only_pages(F.col("text"), wanted)).cast("long").alias("chars"))


INDEX_LINES = ["Interest Proceeds waterfall", "Distribution in US$", "Payment Date Report", "CUSIP Coupon", "Administrative Cap and Expenses", "nothing here", "Principal Distribution Detail", "Interest Distribution Detail", "Notes Information", "Distribution Report"]


def _sql_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _sql_score(target: str, b: str, page: str) -> str:
    points = lambda test, n: f"(CASE WHEN {test} THEN {float(n)} ELSE 0.0 END)"
    one = f"regexp_replace({b}, '\\s+', ' ', 'g')"
    if target == "02":
        dense = f"replace({b}, ' ', '')"
        return " + ".join([points(_sql_any(b, ["distribution in us"]), 6), points(_sql_any(b, ["interest detail"]), 3), points(_sql_any(b, ["factor per 1000", "factor information per 1000"]), -2), points(_sql_any(dense, pages.DIST_US_WEAK), 4), points(_sql_any(b, pages.CLASS_WORDS), 3), points(f"{page} <= 5", 1), points(f"contains({b}, 'administrative expenses') AND NOT contains({b}, 'section 11.1')", 0.5)])
    first = f"(CASE WHEN contains({one}, 'administrative cap and expenses') THEN 5.0 WHEN contains({one}, 'administrative expenses cap') AND contains({one}, 'administrative expenses') AND NOT contains({one}, 'distribution of interest proceeds') THEN 3.0 ELSE 0.0 END)"
    return " + ".join([first, points(_sql_any(b, pages.WATERFALL_WORDS), 3), points(_sql_any(b, ["interest proceeds $", "principal proceeds"]), 4), points(_sql_any(one, pages.INTEREST_ANCHORS + pages.PRINCIPAL_ANCHORS), 3)])


_INDEX = f"(SELECT doc_id, doc_id // 20 AS deal_key, CAST(doc_id % 20 + 1 AS INTEGER) AS page, {sql_pick('(doc_id * 7 + doc_id // 20) % 10', INDEX_LINES)} AS preview FROM documents)"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index lines dealt over the documents, twenty pages a deal."""
    i = F.col("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 20").alias("deal_key"), F.lit("primary").alias("tree"), (i % 20 + 1).cast("int").alias("page"), pick((i * 7 + F.expr("doc_id div 20")) % 10, INDEX_LINES).alias("preview"))


@query(f"SELECT doc_id, CAST({_sql_score('02', 'lower(preview)', 'page')} AS DOUBLE) AS classes, CAST({_sql_score('03', 'lower(preview)', 'page')} AS DOUBLE) AS waterfall FROM {_INDEX}")
def page_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: keyword scores of index lines."""
    score = lambda t: pages.score_page(t, F.col("preview"), F.col("page"))
    return _index(spark, sf_dir).select("doc_id", score("02").alias("classes"), score("03").alias("waterfall"))


@query(f"""
WITH g AS (SELECT deal_key, bool_or({_sql_any('lower(preview)', pages.PDD)}) AS pdd, bool_or({_sql_any('lower(preview)', pages.IDD)}) AS idd, bool_or({_sql_any('lower(preview)', pages.CONSOLIDATED)} AND (page > 1 OR {_sql_any('lower(preview)', pages.CONSOLIDATED_FIRST)})) AS grid, bool_or({_sql_any('lower(preview)', pages.DISTRIBUTION)}) AS dist FROM {_INDEX} GROUP BY 1)
SELECT deal_key, CASE WHEN pdd AND idd THEN 'dual_pdd_idd' WHEN grid THEN 'consolidated' WHEN dist AND NOT pdd AND NOT idd THEN 'distribution_report' WHEN pdd OR idd THEN 'dual_pdd_idd' ELSE 'unknown' END AS family FROM g""")
def layout_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout family of each deal."""
    return pages.detect_layout(_index(spark, sf_dir)).select("deal_key", "family")


@query(f"""
WITH i AS (SELECT deal_key, page, {_sql_any('lower(preview)', pages.INTEREST_ANCHORS)} AS ia, {_sql_any('lower(preview)', pages.PRINCIPAL_ANCHORS)} AS pa, {_sql_any('lower(preview)', pages.INTEREST_ANCHORS + pages.PRINCIPAL_ANCHORS + pages.WEAK_ANCHORS)} OR ({_sql_score('03', 'lower(preview)', 'page')}) >= 2 AS a FROM {_INDEX}),
g AS (SELECT deal_key, CASE WHEN bool_or(ia) AND bool_or(pa) THEN least(min(page) FILTER (ia), min(page) FILTER (pa)) ELSE min(page) FILTER (a) END AS lo, CASE WHEN bool_or(ia) AND bool_or(pa) THEN greatest(max(page) FILTER (ia), max(page) FILTER (pa)) ELSE max(page) FILTER (a) END AS hi FROM i GROUP BY 1)
SELECT deal_key, CAST(coalesce(hi - lo + 1, 0) AS INTEGER) AS n FROM g""")
def waterfall_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span of waterfall pages."""
    return pages.select_pages(_index(spark, sf_dir), "03").select("deal_key", F.size("pages").alias("n"))


@query("""
WITH i AS (SELECT doc_id // 20 AS deal_key, CAST(doc_id % 20 + 1 AS INTEGER) AS page, (doc_id * 7 + doc_id // 20) % 10 AS k FROM documents),
-- lines 0 and 4 of the ten name the waterfall and the grid of administrative expenses; the second report has line 0 alone, two pages on
p AS (SELECT deal_key, page FROM i WHERE k IN (0, 4)), w AS (SELECT deal_key, page + 2 AS page FROM i WHERE k = 0),
lo AS (SELECT deal_key, min(page) AS a, max(page) AS b FROM p GROUP BY 1 UNION ALL SELECT deal_key, min(page), max(page) FROM w GROUP BY 1)
SELECT DISTINCT deal_key, CAST(unnest(range(a, b + 1)) AS INTEGER) AS page FROM lo""")
def mandatory_waterfall_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that file 03 must be read from, of a deal's two reports."""
    own = _index(spark, sf_dir).withColumn("preview", F.when(F.col("preview").isin(INDEX_LINES[0], INDEX_LINES[4]), F.col("preview")).otherwise("nothing here"))
    other = _index(spark, sf_dir).withColumns({"page": F.col("page") + 2, "preview": F.when(F.col("preview") == INDEX_LINES[0], F.col("preview")).otherwise("nothing here")})
    return pages.mandatory_pages(own, other)


@query()
def class_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the class tables by layout."""
    return pages.select_pages(_index(spark, sf_dir), "02")


@query(f"""
WITH g AS (SELECT deal_key, string_agg(lower(preview), chr(10) ORDER BY page) AS b FROM {_INDEX} WHERE page <= 16 GROUP BY 1),
t AS (SELECT deal_key, {_sql_any('b', pages.DATE_MARKERS)} AS d, {_sql_any('b', pages.TRANCHE_MARKERS)} AS t, {_sql_any('b', pages.WATERFALL_MARKERS)} AS w FROM g)
SELECT deal_key, d AND (t OR w) AS passed, CASE WHEN d AND t AND w THEN 'full' WHEN d AND w THEN 'waterfall_only' WHEN d AND t THEN 'tranche_only' END AS profile FROM t""")
def page_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that hold a date and a section."""
    return pages.gate(_index(spark, sf_dir).withColumnRenamed("preview", "text")).select("deal_key", "passed", "profile")


@query("WITH g AS (SELECT user_id, min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events GROUP BY 1) SELECT user_id, CAST(unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM g")
def span_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day between a user's first and last."""
    g = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi"))
    return g.select("user_id", F.explode(F.sequence("lo", "hi")).alias("day"))


@query("SELECT DISTINCT user_id, p FROM (SELECT user_id, unnest([k - 1, k, k + 1]) AS p FROM (SELECT user_id, CAST(datediff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS INTEGER) AS k FROM events)) WHERE p >= 1")
def neighbour_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with its neighbours."""
    g = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date"))).alias("ks"))
    return g.select("user_id", F.explode(pages.neighbours(F.col("ks"))).alias("p"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events")
def carry_forward_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last label above each row."""
    e = read(spark, sf_dir, "events")
    return reconcile.carry_forward(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "carried").select("event_id", "carried")


@query("""
WITH l AS (SELECT user_id AS deal_key, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events)
SELECT a.deal_key, a.line, b.line - a.line AS distance FROM l a JOIN l b ON a.deal_key = b.deal_key AND b.line BETWEEN a.line - 3 AND a.line + 1 WHERE a.event_type = 'purchase' AND b.event_type = 'signup'""")
def amount_near_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with labels from three lines above to one below."""
    from pyspark.sql import Window

    l = read(spark, sf_dir, "events").select(F.col("user_id").alias("deal_key"), "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("line"))
    return reconcile.label_distance(l.filter("event_type = 'purchase'").select("deal_key", "line"), l.filter("event_type = 'signup'").select("deal_key", "line"))


# --- picks, usage and cost --------------------------------------------------------------------


@query("""
WITH r AS (SELECT l_orderkey AS deal_key, l_linenumber AS seq, CAST(l_linenumber AS VARCHAR) AS path, CAST(l_partkey % 3 AS INTEGER) AS k FROM lineitem)
SELECT deal_key, arg_min(path, CASE k WHEN 0 THEN 0 WHEN 2 THEN 100 ELSE 1000 END + seq) AS pdf_path,
  nullif(arg_min(path, seq) FILTER (k = 1), arg_min(path, CASE k WHEN 0 THEN 0 WHEN 2 THEN 100 ELSE 1000 END + seq)) AS waterfall_path FROM r GROUP BY 1""")
def pick_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary and waterfall report of each deal."""
    r = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deal_key"), F.col("l_linenumber").alias("seq"), pick(F.col("l_partkey") % 3, ["Note Valuation Report", "Waterfall Calculations", "Other"]).alias("report_type"), F.col("l_linenumber").cast("string").alias("path"))
    return reconcile.pick_reports(r)


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id"), F.col("event_type").alias("deal_folder"), k.alias("prompt_tokens"), (k + 1).alias("completion_tokens"), F.when(F.col("event_id") % 4 > 0, F.floor("value").cast("double")).alias("cost_usd"))


@query("SELECT count(*) AS lines, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(CAST(props->>'$.k' AS BIGINT) + 1) AS BIGINT) AS completion_tokens, CAST(sum(CAST(floor(value) AS BIGINT)) FILTER (event_id % 4 > 0) AS DOUBLE) AS cost_usd, count(value) FILTER (event_id % 4 > 0) AS lines_with_cost FROM events")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: token and cost sums."""
    return usage.summary(_logs(spark, sf_dir))


@query("SELECT event_type AS deal_folder, CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) AS cost_usd FROM events WHERE event_id % 4 > 0 GROUP BY 1")
def cost_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: cost by folder."""
    return usage.cost_by_folder(_logs(spark, sf_dir))


@query("""
WITH l AS (SELECT user_id, event_type, floor(value) AS v, ts, event_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS s FROM events WHERE event_id % 4 > 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
g AS (SELECT user_id, event_type, run, CAST(sum(CAST(v AS BIGINT)) AS DOUBLE) AS c FROM r GROUP BY 1, 2, 3)
SELECT user_id, event_type AS deal_folder, arg_max(c, run) AS cost_usd FROM g GROUP BY 1, 2""")
def latest_run_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: cost of each folder's latest contiguous run in its log."""
    return usage.latest_run_cost(_logs(spark, sf_dir), ["ts", "event_id"], ["user_id"])


@query("SELECT event_type AS source, max(event_id) AS batch_id FROM events GROUP BY 1")
def latest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last manifest of each source."""
    d = read(spark, sf_dir, "events").select(F.col("event_id").alias("batch_id"), F.col("event_type").alias("source"), F.format_string("%020d", F.expr("event_id div 2")).alias("finished_at"))
    return usage.latest_manifests(d).select("source", "batch_id")


MODELS = ["gpt-5.4-mini-x", "gpt-5.4", "gpt-4o-mini", "gpt-4o-2024", "GPT-4.1-nano", "gpt-4.1", "gpt-3.5-turbo", "other-model"]
_PRICE = "CASE " + " ".join(f"WHEN starts_with(lower(m), '{p}') THEN {{}}".format(f"k * {i} + k * {o}") for p, i, o in usage.PRICES) + " END"


@query(f"SELECT event_id, CAST(round(({_PRICE}) / 1000000.0, 6) AS DOUBLE) AS cost, CASE WHEN m = 'other-model' THEN 'unknown_model' ELSE 'table_rates' END AS note FROM (SELECT event_id, CAST(props->>'$.k' AS BIGINT) * 1000000 AS k, {sql_pick('event_id % 8', MODELS)} AS m FROM events)")
def model_price_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by the first model prefix."""
    k = F.col("prompt_tokens") * 1_000_000
    d = _logs(spark, sf_dir).select("event_id", usage.estimate_cost(pick(F.col("event_id") % 8, MODELS), k, k).alias("c"))
    return d.select("event_id", "c.cost", "c.note")


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS balance FROM nation")
def xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested rows to XML and back."""
    n = read(spark, sf_dir, "nation")
    cls = F.struct(F.col("n_name").alias("_name"), F.col("n_regionkey").cast("string").alias("ending_balance"))
    row = F.struct(F.lit("4").alias("_schema_version"), F.concat(F.col("n_nationkey").cast("string"), F.lit("_20240105")).alias("_source_folder"), F.struct(F.array(cls).alias("class")).alias("classes"))
    d = n.select(xml_export.from_xml(xml_export.to_xml(row)).alias("x")).select("x.*")
    lines = xml_export.class_lines(d)
    return lines.select(F.substring_index("source_folder", "_", 1).cast("int").alias("n_nationkey"), F.col("class").alias("n_name"), F.col("ending_balance").alias("balance"))


@query("""
SELECT CAST(s_nationkey AS VARCHAR) AS deal_key, s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 'A' WHEN s_suppkey % 3 = 2 THEN '' WHEN s_suppkey % 2 = 0 THEN 'B' ELSE 'ghost' END AS class,
  s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 AS overridden FROM supplier""")
def listing_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing's class gives way to the geometry's only if it is no primary class and the other is one."""
    s = read(spark, sf_dir, "supplier")
    deal, k = F.col("s_nationkey").cast("string").alias("deal_key"), F.col("s_suppkey")
    lines = s.select(deal, k, F.when(k % 3 == 1, "A").when(k % 3 == 2, "").otherwise("ghost").alias("class"), F.concat(F.lit("x"), k).alias("cusip"))
    geometry = s.select(deal, F.concat(F.lit("X"), k).alias("cusip"), F.when(k % 2 == 0, "B").otherwise("nowhere").alias("class"))
    primary = s.select(deal, F.explode(F.array(F.lit("A"), F.lit("B"))).alias("class")).distinct()
    return xml_export.geometry_override(lines, geometry, primary).select("deal_key", "s_suppkey", "class", "overridden")
