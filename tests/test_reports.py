import pytest
from pyspark.sql import functions as F

from tallyframe.sources import readers

REPORT = {"deal_id": 1, "sent": "0", "report_format": "PDF", "report_type": "Note Valuation", "trustee": "US Bank", "trustee_file_name": None, "payment_date": "2026-03-16"}
CDO = {"report_format": "XLS", "report_type": "Other", "trustee": "CDOMonitoring"}
WANTED = [
    {}, {"report_type": "Quarterly Report"}, {"report_type": "Note"}, {"report_type": "Interest Waterfall"}, {"report_type": "Payment Date Report"}, {"report_type": "The NOTEVAL"},
    CDO | {"trustee_file_name": "x_Quarterly.xls"}, CDO | {"trustee_file_name": "Note.xls"}, CDO | {"trustee_file_name": "a waterfall"}, CDO | {"trustee_file_name": "payment.csv"},
    {"report_format": None, "report_type": "Investor Report - Summary", "trustee": "BONY"},
]
UNWANTED = [
    {"sent": "1"}, {"sent": None}, {"deal_id": 2}, {"deal_id": 3}, {"deal_id": 4}, {"report_format": "XLS"}, {"report_format": None}, {"report_type": "Payment Notice"}, {"report_type": "Noteholder Updates"},
    {"report_type": "My Quarterly"}, {"report_type": "Trustee Report"}, {"report_type": None}, {"payment_date": None}, {"payment_date": "2026-03-18"},
    CDO | {"trustee_file_name": "payment notice"}, CDO | {"trustee_file_name": "other"}, CDO, CDO | {"trustee_file_name": "Note", "trustee": "BONY"}, CDO | {"trustee_file_name": "Note", "report_type": None},
    {"report_type": "Investor Report - Summary"}, {"report_format": None, "report_type": "Investor Report", "trustee": "BONY"},
]


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(i, *(REPORT | r).values()) for i, r in enumerate(WANTED + UNWANTED)]
    reports = spark.createDataFrame(rows, "seq int, deal_id long, sent string, report_format string, report_type string, trustee string, trustee_file_name string, payment_date string")
    # deal 2 may not be sent, deal 3 does not say, deal 4 is unknown
    return reports, spark.createDataFrame([(1, "One", 1), (2, "Two", 0), (3, "Three", None)], "deal_id long, deal_name string, send_dm int")


def test_every_branch_of_the_source_query(frames):
    got = readers.reports_of_deals(*frames, now=F.lit("2026-03-17").cast("timestamp")).collect()
    assert sorted(r["seq"] for r in got) == list(range(len(WANTED)))
    assert {r["deal_name"] for r in got} == {"One"}


def test_one_date_and_one_deal(frames):
    now = F.lit("2026-03-17").cast("timestamp")
    day = lambda x: F.lit(x).cast("date")
    assert readers.reports_of_deals(*frames, day("2026-03-16"), F.lit(1), now).count() == len(WANTED)
    assert readers.reports_of_deals(*frames, day("2026-03-15"), F.lit(1), now).count() == 0
    assert readers.reports_of_deals(*frames, day("2026-03-16"), F.lit(5), now).count() == 0
