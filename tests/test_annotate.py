from pyspark.sql import functions as F

from tallyframe.operators import pages, resolve

HINTS = {k: f"> {k}\n\n" for k in pages.HINTS_02}


def annotated(spark, text, previews=None):
    d = spark.createDataFrame([(text, previews)], "t string, p array<struct<page int, preview string>>")
    return d.select(pages.annotate_02(F.col("t"), HINTS, F.col("p"))).first()[0], d.select(pages.annotate_03(F.col("t"), "> admin\n\n")).first()[0]


def test_hints_follow_page_markers(spark):
    text = "front\n--- Page 1 of 4 ---\n\n  Deutsche Bank\nDistribution in US$\n--- Page 2 of 4 ---\nplain\n--- Page 3 of 4 ---\nInterest Detail\nInterest Paid\n--- Page 4 of 4 ---\nInterest payable to Class A Notes\nFactor Information per 1000"
    assert annotated(spark, text)[0] == (
        "--- Page 1 of 4 ---\n\n> distribution_us\n\n> deutsche_rate\n\n  Deutsche Bank\nDistribution in US$\n\n\n--- Page 2 of 4 ---\nplain\n\n\n--- Page 3 of 4 ---\n\n> deutsche_interest_detail\n\nInterest Detail\nInterest Paid\n\n\n"
        "--- Page 4 of 4 ---\n\n> interest_payable_to\n\n> deutsche_factor\n\nInterest payable to Class A Notes\nFactor Information per 1000"
    )
    assert annotated(spark, "--- Page 7 of 9 ---\nx", [(7, "old"), (7, "Face Value Face Value Balance")])[0] == "--- Page 7 of 9 ---\n\n> distribution_us\n\nx"
    assert annotated(spark, "prior principal, current principal")[0] == "> distribution_us\n\nprior principal, current principal"
    assert annotated(spark, "nothing") == ("nothing", "nothing") and annotated(spark, "") == ("", "")


def test_hint_of_the_expense_grid(spark):
    text = "--- Page 1 of 2 ---\nAdministrative Expenses\n(i)  Trustee\n--- Page 2 of 2 ---\nAdministrative Cap and Expenses\nDistribution of Interest Proceeds"
    assert annotated(spark, text)[1] == "--- Page 1 of 2 ---\n\n> admin\n\nAdministrative Expenses\n(i)  Trustee\n\n\n--- Page 2 of 2 ---\nAdministrative Cap and Expenses\nDistribution of Interest Proceeds"


def test_master_row_by_id(spark):
    classes = spark.createDataFrame([("d", "A", " 7 "), ("d", "B", None), ("d", "C", ""), ("e", "D", "7"), ("d", "E", "8")], "deal_key string, label string, tranche_id string")
    master = spark.createDataFrame([("d", 7, "old", 1), ("d", 7, "new", 2), ("d", None, "none", 3)], "deal_key string, tranche_id long, name string, seq int")
    got = {r["label"]: r for r in resolve.master_rows(classes, master, "seq").collect()}
    assert len(got) == 5 and (got["A"]["master"]["name"], got["A"]["master_id"]) == ("new", "7")
    assert all(got[k]["master"] is None and got[k]["master_id"] == "" for k in "BCDE")
