import json

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import diff, fees, pages, reconcile, resolve, rules, usage
from tallyframe.sources import readers, writers, xml_export
from tallyframe.streaming import usage_stream

CB = """## Extracted Data
### Class balance table (primary)
| Class | Original balance | Beginning balance | Interest rate | Interest payment | Interest payable | Principal payment | Principal payable | Deferred interest | Dividend | Ending balance | Notes |
|---|---|---|---|---|---|---|---|---|---|---|---|
| A-1 | 1,000.00 | 1,000.00 | 5.1% | 10.00 | | 100.00 | | 0.00 | | 900.00 | |
| B | 500.00 | 500.00 | Floating | 5.00 | | 0.00 | | 5.00 | | 505.00 | |
| C | 500.00 | 500.00 | 5% | 5.00 | | 10.00 | | | | 500.00 | |
| D | 2,000.00 | 2,000.00 | 5% | 5.00 | | 2,000.00 | | | | 2,000.00 | |
| E-144A | 10.00 | 10.00 | 5% | -1.00 | | N/A | | | | 10.00 | |
| Total | 4,010.00 | 4,010.00 | | | | | | | | | |

## Source Text
> A-1
> D-R
Coupon 5.25%
"""
WF = """| Priority | Item / payee description | Amount paid | Amount payable | Amount available / running | Other amount columns | Notes |
|---|---|---|---|---|---|---|
| (a) | Taxes | 10.00 | 10.00 | 1,000.00 | | |
| (b)(1) | to the Trustee | 20.00 | 20.00 | 900.00 | Unpaid 3.00 | |
| (b)(2) | to the Trustee | 5.00 | 5.00 | 880.00 | | |
| (c) | Senior Management Fee | 30.00 | 30.00 | 30.00 | | |
| (d) | interest on the Class A Notes | 99.00 | 99.00 | 500.00 | | |
| (e) | Something unlabelled | 60.00 | 60.00 | 400.00 | | |
| (f) | uncorroborated fee | 7.00 | | | | |

### Disbursement ladder
| Clause / step | Item description | Amount | Notes |
|---|---|---|---|
| (a) | Taxes | 10.00 | |
| (z) | Hedge Counterparty agreement fee | 50.00 | |

## Source Text
--- Page 3 of 9 ---
> Payment of the Subordinated Management Fee $40.00 $900.00
> to the Trustee 100.00 20.00 20.00 0.00
"""


def deal(spark, **texts):
    row = {"deal_key": "d1", "text01": "x", "text02": CB, "text03": WF, "text04": "x", "text05": None} | texts
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))


def test_rules(spark):
    mandatory = spark.createDataFrame([("d1", 3), ("d1", 4)], "deal_key string, page int")
    got = {(r["rule"], r["label"]) for r in rules.validate(deal(spark), mandatory).collect()}
    assert {("V5", "C"), ("V5b", "D"), ("V6", "E-144A"), ("V6b", "Senior Management Fee"), ("V6b_due", "to the Trustee"), ("V6e", "E"), ("V7b", "B"), ("V9", ""), ("V10", "D-R"), ("V12", "4")} <= got
    assert not {x for x in got if x[0] in ("V0", "V1", "V2", "V4", "V11", "V13") or x in (("V5", "D"), ("V5", "A-1"), ("V5", "B"))}
    bare = rules.validate(deal(spark, text02=None, text03=None))
    assert {(r["rule"], r["severity"]) for r in bare.collect()} == {("V0", "error"), ("V13", "warn")}
    assert rules.deal_status(deal(spark, text02=None), bare).first()["status"] == "FAIL"
    report = writers.validation_report(rules.validate(deal(spark))).first()["text"]
    assert report.startswith("| rule | severity | label | detail |\n| --- |") and "| V5 | warn | C |" in report


STACKED = CB.replace("| A-1 | 1,000.00", "| CR | 58,050,000.00 | 58,050,000.00 | 5% | 7,000.00 | | | | | | 58,050,000.00 | |\n| SUB | 9.00 | 9.00 | 0% | 0.00 | | | | | | 9.00 | |\n| A-1 | 1,000.00").split("## Source Text")[0] + """## Source Text
> CRR
> 58,050,000.00
Interest Distribution Detail
123456AB1 5.00 10.00 0.00000 7.00
98765ZZ12 0.00000 5,000,000.00 5,000,000.00 2,500.00
> B
> CRR
> SUB
...
10.00 5,000.00 0.00 0.00 0.00
20.00 7,000.00 0.00 0.00 0.00
30.00 0.00 0.00 0.00 0.00
> CR
"""


def test_label_stacks(spark):
    from tallyframe.operators.exhibits import label_stack

    assert label_stack(STACKED.split("## Source Text")[1]) == [("B", 10.0, 5000.0), ("CRR", 20.0, 7000.0), ("SUB", 30.0, 2500.0)]
    assert label_stack("") == [] and label_stack("Interest Distribution Detail\nA\nB") == []
    got = {(r["rule"], r["label"], r["detail"]) for r in rules.validate(deal(spark, text02=STACKED)).collect()}
    assert ("V2b", "SUB", "source interest 2,500.00") in got and ("V10", "CRR", "a label of the exhibit's stack is missing") in got
    assert ("V10", "CR", "interest belongs to CRR") in got and ("V10", "CR", "amount stands under CRR") in got


def test_fees(spark):
    lines, rolled, coverage = fees.map_fees(rules.prepare(deal(spark)))
    got = {r["sub_category"]: (r["main_category"], r["amount_paid"], r["priority"]) for r in rolled.collect()}
    assert got == {
        "tax_gross_amounts": ("Tax", "10.00", "(a)"), "trustee_expenses": ("Administrative expense", "25.00", "—"), "senior_management_fees": ("Management fees", "30.00", "(c)"),
        "administrator_expenses": ("Administrative expense", "60.00", "(e)"), "fees_to_hedge_counterparty": ("Hedge", "50.00", "(z)"), "subordinate_management_fees": ("Management fees", "40.00", "—"),
    }
    assert abs(coverage.first()["delta"]) < 1e-9 and lines.count() == 7


def test_fee_joins_broadcast_nothing_that_grows_with_the_deals(spark, monkeypatch, tmp_path):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = [("d1", "waterfall", 0, "to the Trustee", "", 5.0), ("d1", "ladder", 0, "to the Trustee", "", 5.0), ("d1", "ladder", 1, "Taxes", "", 9.0), ("d2", "ladder", 0, "to the Trustee", "", 5.0)]
    rows += [("d2", "continuations", 0, "to the Trustee", "", 5.0), ("d1", "continuations", 0, "Senior Management Fee", "", 7.0), ("d3", "source_text", 0, "Senior Management Fee", "", 7.0), ("d1", "source_text", 0, "Senior Management Fee", "", 7.0)]
    spark.createDataFrame(rows, "deal_key string, source string, seq int, description string, priority string, amount double").write.parquet(f"{tmp_path}/found")
    found = spark.read.parquet(f"{tmp_path}/found")  # files have a small estimate
    merged = fees.merge(*[found.filter(F.col("source") == x) for x in fees.SOURCE_RANK])
    assert "Broadcast" not in plan(merged)
    want = [("d1", "continuations", 0), ("d1", "ladder", 1), ("d1", "waterfall", 0), ("d2", "ladder", 0), ("d3", "source_text", 0)]
    assert sorted((r["deal_key"], r["source"], r["seq"]) for r in merged.collect()) == want
    grid = "| Expense | Fee type | Paid during period |\n|---|---|---|\n| x | y | 1.00 |\n"
    text = "\n## Source Text\nSenior Management Fee and Trustee Fee $4.00 $9.00\nSenior Management Fee $3.00 $9.00\n"
    deals = rules.prepare(deal(spark, text03=text).union(deal(spark, deal_key="d2", text03=grid + text)))
    source = fees.from_source_text(deals)
    assert "Join" not in plan(source)
    assert sorted((r["deal_key"], r["amount"]) for r in source.collect()) == [("d1", 3.0), ("d1", 4.0), ("d2", 3.0)]
    lookup, lines = fees.source_lookup(rules.prepare(deal(spark))), spark.createDataFrame([("d1", "to the Trustee"), ("d2", "to the Trustee")], "deal_key string, description string")
    small = fees.with_source(lines, lookup)
    monkeypatch.setattr(fees, "BROADCAST_ROWS", 0)
    large = fees.with_source(lines, lookup)
    assert "Broadcast" in plan(small) and "Broadcast" not in plan(large)
    assert sorted(small.collect()) == sorted(large.collect()) == [("d1", "to the Trustee", 20.0), ("d2", "to the Trustee", None)]


def test_class_cash(spark):
    assert rules.class_cash(rules.prepare(deal(spark))).first()["cash"] == 99.0


def test_resolution(spark):
    classes = spark.createDataFrame([("d", "Class A-1 Notes", None, ["123456789"]), ("d", "Class B", None, ["bad", "999999999"]), ("d", "Subordinated Notes", None, []), ("d", "Class C", None, ["111111111"]), ("d", "Class Z", None, [])], "deal_key string, class string, deal_name string, codes array<string>")
    codes = spark.createDataFrame([("d", "123 456-789", 1), ("d", "111111111", 4), ("d", "111111111", 5)], "deal_key string, code string, tranche_id long")
    names = spark.createDataFrame([("d", "B", 2), ("d", "PS", 3), ("d", "SUB", 33)], "deal_key string, name string, tranche_id long")
    got = {r["class"]: (r["tranche_id"], r["tier"], r["status"]) for r in resolve.resolve(classes, codes, names).collect()}
    assert got == {"Class A-1 Notes": (1, "cusip", "ok"), "Class B": (2, "cusip+name", "ok"), "Subordinated Notes": (3, "name", "ok"), "Class C": (None, "cusip", "ambiguous"), "Class Z": (None, "name", "unmapped")}
    facts = spark.createDataFrame([("d", "B", 7.0), ("d", "3", 8.0)], "deal_key string, tranche_name string, ending_balance double")
    found = {r["tranche_id"]: r["ending_balance"] for r in resolve.fact_rows(resolve.resolve(classes, codes, names), names, facts).collect()}
    assert found == {2: 7.0, 3: 8.0}


def test_revised_reports(spark):
    meta = "| Field | Value |\n|---|---|\n| Payment date | {} |\n| Determination date | {} |\n"
    tests = "| Test name | Current ratio | Pass / Fail | Numerator |\n|---|---|---|---|\n| OC A | 120.00 | {} | 1,000.00 |\n"
    fee = "| Main category | Sub category | Priority | Amount paid |\n|---|---|---|---|\n| Tax | tax | | {} |\n"
    old = deal(spark, text01=meta.format("1/15/2026", "1/10/2026"), text03=tests.format("Pass"), text05=fee.format("10.00"))
    new = deal(spark, text01=meta.format("1/16/2026", "1/11/2026"), text02=CB.replace("| 900.00 |", "| 950.00 |").replace("| C |", "| C-R |"), text03=tests.format("Fail").replace("120.00", "119.00"), text05=fee.format("5,000.00"))
    got = {(r["category"], r["label"], r["field"], r["severity"]) for r in diff.compare(old, new).collect()}
    assert got == {
        ("Key dates", "payment date", "payment date", "CRITICAL"), ("Key dates", "determination date", "determination date", "HIGH"), ("Class balances", "A-1", "ending balance", "HIGH"), ("Class balances", "C", "(class)", "CRITICAL"),
        ("Class balances", "C-R", "(class)", "CRITICAL"), ("IC/OC Tests", "oc a", "pass/fail", "CRITICAL"), ("IC/OC Tests", "oc a", "current ratio", "HIGH"), ("Fees", "tax", "amount paid", "HIGH"),
    }
    assert diff.severity_counts(diff.compare(old, new)).first()["critical"] == 4
    assert diff.compare(old, old).count() == 0


def test_pages(spark):
    texts = ["Note Valuation Report\nPayment Date 1/1/2026", "Distribution in US$ CUSIP", "nothing", "Interest Proceeds $ waterfall", "more", "Principal Proceeds", "end", "x"]
    p = spark.createDataFrame([("d", "primary", i + 1, len(texts), t) for i, t in enumerate(texts)], "deal_key string, tree string, page int, total int, text string")
    index = pages.page_index(p)
    total = spark.createDataFrame([("d", 8)], "deal_key string, total int")
    assert pages.select_pages(index, "03", total).first()["pages"] == [4, 5, 6, 7, 8]
    lay = pages.detect_layout(index).first()
    assert (lay["family"], lay["confidence"], lay["us_pages"]) == ("unknown", "low", [2])  # a cover page alone is no grid
    assert pages.gate(p).first()["profile"] == "full"
    chunks = pages.chunk_pages(p, 3)
    assert chunks.count() == 3 and "pages_001_003.txt" in chunks.orderBy("first").first()["rel"]
    wanted = spark.createDataFrame([("d", [3, 4])], "deal_key string, pages array<int>")
    assert {r["first"] for r in pages.chunks_for(chunks, wanted).collect()} == {1, 4}
    one = chunks.orderBy("first").select(pages.only_pages(F.col("text"), F.array(F.lit(2))), pages.only_pages(F.col("text"), F.array(F.lit(99))) == F.col("text")).first()
    assert one[0] == "[Index filter: selected pages only]\n\n--- Page 2 of 8 ---\nDistribution in US$ CUSIP\n" and one[1]
    refined = pages.refine_layout(pages.detect_layout(index), spark.createDataFrame([("d", "distribution in us$")], "deal_key string, text string"))
    assert refined.first()["family"] == "consolidated"
    assert "`_chunks/pages_001_003.txt` | 1-3" in writers.manifest_text(chunks).first()["text"]


def test_usage(spark, tmp_path):
    lines = [{"deal_folder": f, "cost_usd": c, "ts": f"2026-01-01T00:0{i}:00", "prompt_tokens": 1, "model": "gpt-4o"} for i, (f, c) in enumerate([("a", 1.0), ("a", 2.0), ("b", 4.0), ("a", 8.0)])]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n" + json.dumps({"deal_folder": "b", "ts": "2026-01-01T00:09:00"}))
    logs = usage.read_logs(spark, str(tmp_path / "log.jsonl")).withColumn("log", F.lit(1))
    assert {r["deal_folder"]: r["cost_usd"] for r in usage.latest_run_cost(logs, ["ts"], ["log"]).collect()} == {"a": 8.0, "b": 4.0}
    assert {r["deal_folder"]: r["cost_usd"] for r in usage.cost_by_folder(logs).collect()} == {"a": 11.0, "b": 4.0}
    body = spark.createDataFrame([('{"usage": {"input_tokens": 3, "output_tokens": "4"}}',)], "b string").select(usage.usage_counts(F.col("b"))).first()[0]
    assert tuple(body) == (3, 4, 7)
    writers.write_manifest(usage.cost_by_folder(logs), str(tmp_path / "m"), "b1", "sdk")
    m = spark.read.schema("batch_id string, costs map<string,double>").json(str(tmp_path / "m"))
    assert {r["deal_folder"]: r["cost_usd"] for r in usage.manifest_costs(m).collect()} == {"a": 11.0, "b": 4.0}
    filled = usage.filled_costs(usage.manifest_costs(m).filter("deal_folder = 'a'"), usage.cost_by_folder(logs))
    assert {r["deal_folder"]: r["origin"] for r in filled.collect()} == {"a": "manifest", "b": "log"}


def test_stream_matches_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"ts": f"2026-01-01T0{i}:00:00Z", "model": "m", "prompt_tokens": i, "completion_tokens": 1, "cost_usd": 1.5, "deal_folder": "ab"[k]}) for k in range(2)))
    stream = usage_stream.cost_by_folder(usage_stream.read(spark, str(tmp_path / "in")))
    usage_stream.run_available(stream, "costs", str(tmp_path / "cp"))
    assert {(r["deal_folder"], r["cost_usd"], r["lines"]) for r in spark.table("costs").collect()} == {("a", 4.5, 3), ("b", 4.5, 3)}


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Deal_ID,Payment_Date,File_Path,waterfall_path\n100001.0,1/15/26,/data/a.pdf,nan\n')
    r = readers.deal_paths(spark, str(tmp_path / "p.csv")).first()
    assert (r["deal_id"], r["pdf_path"], r["waterfall_path"], r["folder"]) == ("100001", "/data/a.pdf", "", "100001_20260115")
    with pytest.raises(ValueError):
        readers.csv_requests(spark, str(tmp_path / "p.csv"), ("absent",))
    x = readers.xml_requests(spark, str(tmp_path / "p.csv"), "/base").first()
    assert x["xml_path"] == "/base/100001_20260115.xml"
    folder = tmp_path / "100001_20260115_sdk"
    folder.mkdir()
    (folder / "01_report_metadata.md").write_text("| Field | Value |\n|---|---|\n| Distribution date | 1/15/2026 |\n| Deal / trust / series name | Deal One |\n")
    (folder / "02_tranche_class_balances.md").write_text(CB)
    d = readers.deal_files(readers.whole_texts(spark, str(tmp_path / "*" / "*.md")))
    m = readers.metadata(d).first()
    assert (m["deal_key"], m["deal_name"], m["payment_date"], m["date_source"]) == ("100001_20260115_sdk", "Deal One", "2026-01-15", "distribution date")
    assert readers.deal_folders(readers.whole_texts(spark, str(tmp_path / "*" / "*.md")), "sdk").first()["deal_id"] == "100001"
    index = "Total pages: 12\n| Page | Preview |\n| 1 | first |\n| 2 | second |\n| `_chunks/pages_001_012.txt` | 1-12 |"
    t = spark.createDataFrame([(index,)], "t string").select(readers.page_index(F.col("t")), readers.total_pages(F.col("t")), readers.manifest_chunks(F.col("t"), "_chunks")).first()
    assert [tuple(x) for x in t[0]] == [(1, "first"), (2, "second")] and t[1] == 12 and [tuple(x) for x in t[2]] == [("_chunks/pages_001_012.txt", 1, 12)]


def test_xml_export(spark, tmp_path):
    listing = "\n| CUSIP line id | Economic class | ISIN | CUSIP |\n|---|---|---|---|\n| A-1-144A | A-1 | X | 123456789 |\n"
    d = deal(spark, deal_key="100001_20260115", text02=CB.replace("\n## Source", listing + "\n## Source"))
    p = rules.prepare(d)
    rows = xml_export.export_rows(p, readers.metadata(d), fees.map_fees(p)[1])
    xml_export.write_xml(rows, str(tmp_path / "x"))
    back = xml_export.read_xml(spark, str(tmp_path / "x"))
    got = xml_export.class_lines(back).orderBy("seq").collect()
    assert [r["class"] for r in got] == ["A-1", "B", "C", "D", "E-144A"] and got[0]["codes"] == ["123456789"] and got[0]["deal_id"] == "100001" and got[0]["ending_balance"] == "900.00"


def test_picks_and_messages(spark):
    r = spark.createDataFrame([("d", 1, "Waterfall Report", "w"), ("d", 2, "Note Valuation", "n"), ("e", 1, "Waterfall", "w")], "deal_key string, seq int, report_type string, path string")
    assert {x["deal_key"]: (x["pdf_path"], x["waterfall_path"]) for x in reconcile.pick_reports(r).collect()} == {"d": ("n", "w"), "e": ("w", None)}
    m = spark.createDataFrame([("d", i, t) for i, t in enumerate(["a  b", "A b", "", "c", "d"])], "deal_key string, seq int, message string")
    assert [x["message"] for x in reconcile.distinct_messages(m, ["deal_key"], 2, ["seq"]).orderBy("seq").collect()] == ["a  b", "c"]
    assert reconcile.pick_first(m, ["deal_key"], [F.col("message") == "d", F.col("message") == "c"], ["seq"]).first()["message"] == "d"
