from tallyframe.operators import layouts


def test_printed_headers_of_each_layout(spark):
    for layout, columns in layouts.LAYOUTS.items():
        cells = [("d", 1, layout, i, h, "7.00") for i, (h, _, _) in enumerate(columns)] + [("d", 2, layout, 0, "unknown", "1")]
        got = {r["row"]: r for r in layouts.rename_columns(spark.createDataFrame(cells, "deal_key string, row int, layout string, seq int, header string, value string")).collect()}
        assert {f for f in layouts.FIELDS if got[1][f] == 7.0} == {f for _, f, _ in columns}
        assert all(got[2][f] is None for f in layouts.FIELDS)


def test_stacked_summary_and_deferred_interest(spark):
    paid, proceeds = "Amount of Principal Payments to be made to the Notes", "From Principal Proceeds"
    ending = "Aggregate Outstanding Amount of Notes after giving effect to Principal Payments"
    cells = [
        ("A", "note_details", 0, proceeds, "9.00"), ("A", "note_details", 1, paid, "5.00"), ("A", "note_details", 2, ending, "-"),
        ("B", "note_details", 0, proceeds, "-"), ("B", "note_details", 1, proceeds, "6.00"), ("B", "note_details", 2, ending, "3.00"),
        ("C", "notes_information", 0, "Deferred Interest Due", "4.00"), ("C", "notes_information", 1, "Deferred Interest Paid", "0.00"),
    ]
    d = spark.createDataFrame([("d", *c) for c in cells], "deal_key string, row string, layout string, seq int, header string, value string")
    got = {r["row"]: r for r in layouts.rename_columns(d).collect()}
    assert (got["A"]["principal_payment"], got["A"]["ending_balance"]) == (5.0, 0.0)
    assert (got["B"]["principal_payment"], got["B"]["ending_balance"]) == (6.0, 3.0)
    assert got["C"]["deferred_interest"] == 4.0


def test_sums_counts_and_bands(spark):
    cusips = spark.createDataFrame([("d", "A", 1.0), ("d", "A", 2.0), ("d", "B", 5.0), ("d", "C", 1.0)], "deal_key string, section string, beginning_balance double")
    bands = spark.createDataFrame([("d", "A", 3.0), ("d", "B", 4.0), ("d", "D", 1.0)], "deal_key string, section string, beginning_balance double")
    got = {r["section"]: r for r in layouts.section_sums(cusips, bands).collect()}
    assert {k: r["match"] for k, r in got.items()} == {"A": "Y", "B": "N", "C": "partial", "D": "N/A"}
    assert got["B"]["class_beginning"] == 4.0 and got["C"]["class_beginning"] == 1.0
    lines = spark.createDataFrame([("d", 1, "label"), ("d", 1, "band"), ("d", 2, "label"), ("d", 3, "band")], "deal_key string, page int, kind string")
    assert {r["page"]: r["match"] for r in layouts.band_counts(lines).collect()} == {1: "Y", 2: "N", 3: "N"}
    assert layouts.fee_bands(spark).count() == 53 and layouts.fee_bands(spark).select("band").distinct().count() == 6
    got = layouts.band_fees(spark.createDataFrame([("Retention_Fee_A1",), ("nothing",)], "fee_type string")).collect()
    assert {r["fee_type"]: r["band"] for r in got} == {"Retention_Fee_A1": "retention", "nothing": None}
