import json

from tallyframe.operators import pages, resolve, usage
from tallyframe.sources import readers, writers


def texts(d):
    return {r[0]: r[1] for r in d.collect()}


def test_expense_pages_and_chunks(spark):
    rows = [
        ("d", 1, "Schedule G"), ("d", 2, "Administrative  Cap and Expenses"), ("d", 3, "Administrative Expenses Cap Section 11.1"), ("d", 4, "administrative expenses"),
        ("d", 5, "administrative expenses Available Optimal Paid"), ("d", 6, "schedule g"), ("e", 1, None),
    ]
    index = spark.createDataFrame(rows, "deal_key string, page int, preview string")
    assert texts(pages.expense_pages(index)) == {"d": [1, 2, 4], "e": []}
    wf = spark.createDataFrame([("e", 3, "Interest Proceeds waterfall")], index.schema)
    got = sorted(map(tuple, pages.mandatory_pages(index, wf).collect()))
    assert ("e", 3) in got and {p for k, p in got if k == "d"} >= {1, 2, 4}
    assert [tuple(r) for r in pages.mandatory_pages(index, wf, "waterfall").collect()] == [("e", 3)]
    spans = spark.createDataFrame([("e", "primary", 1, 30), ("e", "waterfall", 1, 30), ("e", "waterfall", 31, 60)], "deal_key string, tree string, first int, last int")
    assert [tuple(r) for r in pages.waterfall_chunks(spans, index, wf).collect()] == [("e", "waterfall", 1, 30)]
    assert len(pages.waterfall_chunks(spans, index, wf, "waterfall").collect()) == 2


def test_manifests_and_logs(spark, tmp_path):
    for name, body in {"a": {"batch_id": "1", "source": "x", "finished_at": "2024-01-01", "costs": {" f ": 1, "g": "bad", "": 2}}, "b": {"batch_id": "2", "source": "x", "finished_at": "2024-01-02", "costs": {}}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "c.json").write_text("{nonsense")
    m = usage.read_manifests(spark, str(tmp_path))
    assert {r["batch_id"]: r["costs"] for r in m.collect()} == {"1": {"f": 1.0}, "2": {}}
    assert [r["batch_id"] for r in usage.latest_manifests(m).collect()] == ["2"] and usage.latest_manifests(m, "y").count() == 0
    (tmp_path / "log.jsonl").write_text('{"model": "m", "cost_usd": 1.5}\n{broken\n')
    assert usage.read_logs(spark, str(tmp_path / "log.jsonl")).count() == 1
    assert sorted(r["bad_line"] or "" for r in usage.read_logs(spark, str(tmp_path / "log.jsonl"), tag=True).collect()) == ["", "{broken"]
    lines = spark.createDataFrame([(1, "aaaa"), (2, "é"), (3, None)], "n int, value string")
    take = lambda *a: sorted(r["n"] for r in readers.tail_lines(lines, "n", *a).collect())
    assert take(2) == [2, 3] and take(3, 4) == [2, 3] and take(3, 3) == [3] and take(3, 9) == [1, 2, 3] and take(3, 0) == []


def test_classes_beside_facts_and_master(spark):
    classes = spark.createDataFrame(
        [("d", "A", None, ["111111111"], "2024", "10", "100", "5", "n"), ("d", "B", None, [], "2024", "1", "7", "6", "ok"), ("d", "C", None, ["N/A"], "", "1", "7", None, None)],
        "deal_key string, class string, deal_name string, codes array<string>, payment_date string, beginning_balance string, original_balance string, xml_id string, xml_status string",
    ).withColumnRenamed("class", "class")
    classes = classes.selectExpr("*", "'' as xml_tier", "'' as code")
    codes = spark.createDataFrame([("d", "111111111", "5")], "deal_key string, code string, tranche_id string")
    names = spark.createDataFrame([("d", "A", "5")], "deal_key string, name string, tranche_id string")
    facts = spark.createDataFrame([("d", "A", 10.0)], "deal_key string, tranche_name string, beginning_balance double")
    master = spark.createDataFrame([("d", "6", 9.0)], "deal_key string, tranche_id string, orig_balance double")
    p = resolve.process_export(classes, codes, names, facts, master)
    got = {r["class"]: r for r in p.collect()}
    assert len(got) == 3
    a, b, c = (got[k] for k in "ABC")
    assert (a["tranche_id"], a["status"], a["code"], a["already"], a["db_status"], a["diff_beginning_balance"], a["tm_status"]) == ("5", "ok", "111111111", False, "ok", "match", "no_match")
    assert (b["tranche_id"], b["tier"], b["already"], b["db_status"], b["tm_status"], b["diff_original_balance"]) == ("6", "xml", True, "no_match", "ok", "-2.00")
    assert (c["tranche_id"], c["status"], c["already"], c["db_status"], c["tm_status"], c["diff_original_balance"]) == (None, "unmapped", False, "no_data", "no_data", "")
    e = {r["class"]: r for r in resolve.enrich(classes.filter("class <> 'B'"), codes, names, facts).collect()}
    assert e["A"]["matched_code"] == "111111111" and e["C"]["status"] == "unmapped"
    deals = spark.createDataFrame([("d",), ("e",)], "deal_key string")
    s = {r["deal_key"]: r for r in resolve.export_summary(deals, p).collect()}
    assert (s["d"]["class_rows"], s["d"]["mapped_ok"], s["d"]["already"], s["d"]["status"], s["e"]["status"]) == (3, 2, 1, "partial", "missing")
    diffs = spark.createDataFrame([("d", "A", "f", "match"), ("d", "B", "f", "+1")], "deal_key string, class string, field string, diff string")
    sheets = writers.reconciliation_frames(p, diffs)
    assert sheets["mismatches"].count() == 1 and sheets["summary"].first()["mapped_ok"] == 2 and sheets["match_rates"].count() == 2


def test_report_texts(spark):
    deals = spark.createDataFrame([("d",), ("e",)], "deal_key string")
    lines = spark.createDataFrame([("d", "Administrative expense", "administrator_expenses", float(i), "waterfall", "(a)", i, f"fee | {i}") for i in range(1, 4)], "deal_key string, main_category string, sub_category string, amount double, source string, priority string, seq int, description string")
    coverage = spark.createDataFrame([("d", 6.0, 5.0, 1.0)], "deal_key string, candidates double, aggregated double, delta double")
    t = texts(writers.fee_report(deals, lines, coverage, excluded=lines.limit(0), dropped=lines, caps={"mapped": 2}))
    assert "**Mapped rows:** 3" in t["d"] and "> Review" in t["d"] and "… and 1 more." in t["d"] and t["d"].count("\n- paid=") == 3 and "Excluded" not in t["d"]
    assert "**Mapped rows:** 0" in t["e"] and "## Mapped" not in t["e"] and "> Review" not in t["e"]
    assert t["d"].index("## Coverage") < t["d"].index("## Catch-all") < t["d"].index("## Mapped") < t["d"].index("## Supplemental")
    status = spark.createDataFrame([(f"d{i:02}", 1 if i == 3 else 0, 2, "FAIL" if i == 3 else "WARN") for i in range(5)], "deal_key string, errors int, warnings int, status string")
    costs = spark.createDataFrame([("d01", 0.25)], "deal_key string, cost_usd double")
    rows = [r["text"] for r in writers.batch_report(status, costs, pages=2).orderBy("page").collect()]
    assert "**Subtotal errors:** 1  **Subtotal warnings:** 10" in rows[0] and "STATUS: FAIL" in rows[0] and "$0.2500" in rows[0]
    shown = [x for text in rows[1:] for x in text.splitlines() if x.startswith("| d")]
    assert [x.split(" | ")[0] for x in shown] == [f"| d{i:02}" for i in range(5)] and shown[1].endswith("| $0.2500 |") and max(text.count("\n| d") for text in rows) <= 2
    assert "STATUS: N/A" in writers.batch_report(status.limit(0)).first()["text"]
