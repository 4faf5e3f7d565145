import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import labels as L
from tallyframe.functions import predicates as P
from tallyframe.functions import scalars as S
from tallyframe.functions import tables as T


def values(spark, fn, inputs):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, c string")
    return [r["v"] for r in d.select("i", fn(F.col("c")).alias("v")).orderBy("i").collect()]


def test_numbers(spark):
    inputs = ["$1,234.50", "5.25%", "(1,000.00)", "N/A", "—", "", "54.42; 2,343.73", "12f", "nan", " 7 ", None, "1_000", "-3.5"]
    assert values(spark, S.parse_number, inputs) == [1234.5, 5.25, None, None, None, None, None, None, None, 7.0, None, None, -3.5]
    assert values(spark, S.to_float, inputs) == [1234.5, 0.0525, -1000.0, None, None, None, 54.42, 12.0, None, 7.0, None, 1.0, -3.5]
    assert values(spark, S.money_cell, ["€1,000.00", "1.", "x", None, " 5 "]) == ["1000.00", None, None, None, "5"]
    assert values(spark, S.browser_number, ["$(5.50)", "(5.50)", "7 apples", "x"]) == [-5.5, -5.5, 7.0, None]


def test_dates(spark):
    inputs = ["1/5/2024", "01/05/69", "2024-3-4", "5-Mar-2024", "5-March-2024", "x", None]
    d = dt.date
    assert values(spark, S.us_date, inputs) == [d(2024, 1, 5), d(1969, 1, 5), d(2024, 3, 4), d(2024, 3, 5), d(2024, 3, 5), None, None]
    assert values(spark, S.folder_date, ["2024-03-04 10:00:00", "13/01/2024", "1-2-2024"]) == [d(2024, 3, 4), d(2024, 1, 13), d(2024, 1, 2)]
    assert values(spark, S.any_date_yyyymmdd, ["20240305", "March 5, 2024", "2024 03 05", "x", ""]) == ["20240305", "20240305", "20240305", "", ""]


def test_ids_and_names(spark):
    assert values(spark, S.deal_id, [" 867.0", "x1", "nan", None]) == ["867", "x1", "", ""]
    assert values(spark, S.clean_path, ["nan", " a ", None, "<NA>"]) == ["", "a", "", ""]
    assert values(spark, S.security_id, ["12 345-abc7", "short", "N/A"]) == ["12345ABC7", None, None]
    assert values(spark, S.economic_class, ["A-R-144A", "B REGS", "AI", "-144A", "C-1-ai"]) == ["A-R", "B", None, None, "C-1"]
    assert values(spark, S.priority_key, ["(a)(ii) x", "—", " Clause 4 ", None]) == ["(a)(ii)", "", "clause4", ""]
    assert values(spark, S.without_priority, ["(A)(2)(i) Fees", "(iv) Tax", "x"]) == ["Fees", "Tax", "x"]
    assert values(spark, S.fee_key, ["Payment of the  Trustee  fee"]) == ["trustee fee"]


def test_previews(spark):
    text = "Distribution in US$\n\n  Class A-1  | x\nincome notes Class B total class balance"
    assert values(spark, S.page_preview, [text, ""]) == ["Distribution in US$ / Distribution in US$ / Class A-1 ¦ x [also: Income Notes, Class A-1, Class B]", "(no text)"]
    assert values(spark, S.preview_lines, ["a" * 200 + "\r\nb", "\x0b\n c \x85d"]) == ["a" * 119 + "… / b", "c / d"]


MD = """# T
| not | a table |
text
| stray |
| Class | Beginning balance | Interest payment | Ending balance |
| --- | --- | ---: | --- |
| A-1 | $1,000.00 | 5.00 | 900.00 |
| Total | 1 | 2 | 3 |
| B | |

## Source Text
> hello | x
### deeper
y
## Next
z
"""


def test_tables(spark):
    d = spark.createDataFrame([("k", MD)], "deal_key string, text string").withColumn("t", T.parse_tables(F.col("text")))
    d = d.withColumn("cb", T.first_table(F.col("t"), "class_balance"))
    rows = T.typed_rows(d, "cb", T.class_rows, {"class": lambda h: F.lit(1), "end": lambda h: T.column_exact(h, "ending balance"), "pay": T.interest_payment, "none": lambda h: T.column_exact(h, "x")}).orderBy("seq").collect()
    assert [(r["class"], r["end"], r["pay"], r["none"]) for r in rows] == [("A-1", "900.00", "5.00", None), ("B", None, None, None)]
    r = d.select(F.size("t"), T.section(F.col("text"), "Source Text"), T.section(F.col("text"), "absent"), T.first_table(F.col("t"), "fees")).first()
    assert (r[0], r[1], r[2], r[3]) == (1, "## Source Text\n> hello | x\n### deeper\ny", "", None)


cells = st.text(alphabet="abz019 .,$%()-é", min_size=1, max_size=8).map(str.strip).filter(bool)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(cells, min_size=3, max_size=3), min_size=1, max_size=5))
def test_table_round_trip(spark, body):
    text = "\n".join("| " + " | ".join(r) + " |" for r in [["h1", "h2", "h3"]]) + "\n|---|---|---|\n" + "\n".join("| " + " | ".join(r) + " |" for r in body)
    t = spark.createDataFrame([(text,)], "text string").select(T.parse_tables(F.col("text")).alias("t")).first()["t"]
    assert len(t) == 1 and t[0]["header"] == ["h1", "h2", "h3"] and t[0]["rows"] == body


def test_key_values_and_admin_total(spark):
    text = "| Field | Value |\n|---|---|\n| Payment Date | a |\n| payment date | b |\n\n| Expense / fee type | Paid during the period |\n|---|---|\n| Total A | 1.00 |\n| Sub Total | 9 |\n| Totals | $2,000.50 |\n| Grand total | N/A |"
    r = spark.createDataFrame([(text,)], "text string").withColumn("t", T.parse_tables(F.col("text"))).select(T.key_values(F.col("t")), T.admin_total(T.first_table(F.col("t"), "admin_grid"))).first()
    assert r[0] == {"payment date": "b"} and r[1] == "2000.50"


def test_widening(spark):
    for kind, old, new in (("class_balance", 11, 13), ("listing", 12, 14), ("distribution_grid", 9, 11)):
        d = spark.createDataFrame([([str(i) for i in range(old)],), ([str(i) for i in range(new)],)], "r array<string>")
        assert [len(x[0]) for x in d.select(T.widen(F.col("r"), kind)).collect()] == [new, new]


LABELS = {
    "Class A-1 Senior Secured Floating Rate Notes": "A1", "A - 1": "A1", "A 1": "A1", "D-R": "DR", "A-1 R": "A1R", "A-1 AV": "A1AV", "Class A-1 Loan": "A1L", "A1-R_Loan": "A1RL", "Class M-1 Subordinated Notes": "M1",
    "Subordinated Notes": "SUB", "Subordinated Notes A": "SUBA", "PSB": "SUBB", "Combo Notes": "COMB", "Combination Notes": "COMBINATION", "Series 1 Combination Securities": "SERIES1", "Series I Combination Securities": "SERIES1", "S-1": "SERIES1",
    "Performance Notes": "P", "Income Notes": "INC", "Class A CP Notes": "ACP", "A-LT": "ALT", "Preference Shares": "PS2", "DRX 2018-70A SUB A": "SUBA", "": "",
}


@pytest.mark.parametrize("label,key", LABELS.items())
def test_class_keys(spark, label, key):
    assert values(spark, lambda c: L.class_key(c, F.lit(None).cast("string"), F.lit(0), F.lit(True)), [label]) == [key]


def test_shared_prefixes_and_variants(spark):
    d = spark.createDataFrame([(["ABCD 2020-78A A-1-R", "ABCD 2020-78 Sub"],), (["A-1", "A-2"],), (["ABCD A"],)], "p array<string>")
    assert [r[0] for r in d.select(L.shared_tokens(F.col("p"))).collect()] == [2, 0, 0]
    got = values(spark, lambda c: L.lookup_variants(c, F.lit(True)), ["SUB", "A1R", "A1RL", "SUBA", "SERIES2", "INC", "X9", ""])
    assert got == [["PS", "SUB", "PS1"], ["A1R", "A1R2"], ["A1RL", "A1LR"], ["SUBA", "PSA"], ["SERIES2", "S2", "SERIESII"], ["INC", "INCOME", "PS"], ["X9"], []]
    assert values(spark, lambda c: L.class_key(c, F.lit("Deal One, Ltd."), F.lit(0), F.lit(True)), ["Deal One, Ltd. - Class B", "Deal One Class C"]) == ["B", "C"]


def test_differences(spark):
    rows = [(100.0, 100.0), (100.5, 100.0), (98.0, 100.0), (None, 0.0), (None, 5.0), (0.005, None), (1234.5, 0.0)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a double, b double")
    got = [r[1] for r in d.select("i", P.amount_difference(F.col("a"), F.col("b"))).orderBy("i").collect()]
    assert got == ["match", "+0.5000", "-2.00", "match", "", "match", "+1234.50"]
    r = spark.createDataFrame([(0.0506802, 5.06802), (5.0, 0.05), (5.0, 5.1)], "a double, b double").select(P.amount_difference(F.col("a"), F.col("b"), rate=True)).collect()
    assert [x[0] for x in r] == ["match", "match", "-0.1000"]


def test_severities(spark):
    rows = [(None, None), (None, 1.0), (1.0, 1.005), (0.0, 5.0), (100.0, 100.4), (100.0, 101.0)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a double, b double")
    got = [tuple(r)[1:] for r in d.select("i", P.severity_of_change(F.col("a"), F.col("b"), 0.5), P.severity_of_change(F.col("a"), F.col("b"), 0.1, 0.1)).orderBy("i").collect()]
    assert got == [("NO CHANGE", "NO CHANGE"), ("HIGH", "HIGH"), ("NO CHANGE", "NO CHANGE"), ("HIGH", "CRITICAL"), ("LOW", "CRITICAL"), ("HIGH", "CRITICAL")]
