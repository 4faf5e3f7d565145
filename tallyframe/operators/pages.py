"""Pages: chunking, scoring, layout families, page selection and the report gate."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S

CHUNK_PAGES = 30
PAGE_MARK = r"(?m)^--- Page (\d+) of \d+ ---"

# --- Fixed values: words that score pages, name layouts and open the gate ---
METADATA_WORDS = ["payment date", "determination date", "collection period", "record date", "note valuation", "valuation report", "compiled in accordance", "schedule g", "trustee report", "distribution date", "closing date", "report covers"]
CLASS_WORDS = [
    "distribution in us", "principal distribution", "interest distribution", "principal distribution detail", "interest distribution detail", "notes information", "payment date factor", "payment date report", "class balance",
    "class original principal", "beginning principal", "ending principal", "all in rate", "interest due", "interest paid", "cusip", "isin", "accrued interest", "accrued dividends", "subordinated note", "reinvesting holder",
    "reinvesting", "holder note", "income note", "income notes", "m note", "m notes", "preferred return", "principal balance", "coupon", "note interest", "distribution grid", "per unit", "orig prin", "trustee report to note",
    "trustee report", "compiled in accordance",
]
WATERFALL_WORDS = [
    "section 11.1", "disbursement", "interest proceeds", "principal proceeds", "waterfall", "due paid", "running balance", "schedule of payments", "priority of interest", "priority of principal", "application of interest",
    "application of principal", "administrative expenses", "payment account", "proceeds available", "wf distro", "settle date principal",
]
INTEREST_ANCHORS = ["interest proceeds", "proceeds available", "wf distro", "priority of interest", "distribution of interest proceeds", "application of interest"]
PRINCIPAL_ANCHORS = ["principal proceeds", "settle date principal", "priority of principal", "distribution of principal proceeds", "application of principal"]
WEAK_ANCHORS = ["section 11.1", "schedule of payments", "running balance", "disbursement", "waterfall", "due paid", "payment account"]
PDD = ["principal distribution detail", "principal and interest distribution"]
IDD = ["interest distribution detail"]
CONSOLIDATED = ["notes information", "note valuation report", "class original principal", "beginning principal", "all in rate", "interest due", "ending principal"]
CONSOLIDATED_FIRST = ["notes information", "class", "principal", "cusip"]
DISTRIBUTION = ["distribution report", "redemption report"]
FACTORS = ["payment date factor", "payment date factors", "factor information per 1000", "factor per 1000", "coupon only — not balances", "coupon only"]
DIST_US = ["distribution in us$"]
DIST_US_WEAK = ["facevaluefacevaluebalance", "facevaluebalanceinterest"]
INTEREST_DETAIL = ["interest detail"]
DATE_MARKERS = ["payment date", "next payment", "distribution date", "payment date report", "as of payment", "payable on", "determination date"]
TRANCHE_MARKERS = [
    "note valuation report", "principal distribution detail", "interest distribution detail", "distribution in us$", "distribution in u.s.", "class balance", "note class", "tranche detail", "notes information",
    "beginning principal", "current principal balance", "prior principal balance",
]
WATERFALL_MARKERS = [
    "waterfall", "application of interest", "application of principal", "interest proceeds", "principal proceeds", "section 11.1", "distribution of interest proceeds", "distribution of principal proceeds",
    "payment date waterfall", "disbursement ladder", "redemption report", "distribution report", "payment report", "administrative cap and expenses", "administrative expenses cap", "interest payment/distribution",
]
GATE_PAGES, GATE_PROBE_PAGES, GATE_PROBE_CHARS = 100, 16, 120_000


def chunk_pages(pages: DataFrame, size: int = CHUNK_PAGES) -> DataFrame:
    """``deal_key, tree, chunk, first, last, rel, text``: consecutive pages under page marks."""
    head = F.format_string("--- Page %d of %d ---\n", "page", "total")
    g = pages.withColumn("chunk", F.floor((F.col("page") - 1) / size)).groupBy("deal_key", "tree", "chunk").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.sort_array(F.collect_list(F.struct("page", F.concat(head, F.coalesce("text", F.lit(""))).alias("t")))).alias("ps"))
    folder = F.when(F.col("tree") == "waterfall", "_chunks_waterfall").otherwise("_chunks")
    return g.withColumn("rel", F.concat(folder, F.format_string("/pages_%03d_%03d.txt", "first", "last"))).withColumn("text", F.array_join(F.col("ps.t"), "\n\n")).drop("ps")


def page_index(pages: DataFrame) -> DataFrame:
    """``deal_key, tree, page, preview`` of the index."""
    return pages.select("deal_key", "tree", "page", S.page_preview(F.coalesce("text", F.lit(""))).alias("preview"))


def split_pages(text: Column) -> Column:
    """Array of ``page, text`` of a chunk, from its page marks."""
    parts = F.filter(F.split(text, r"(?m)(?=^--- Page \d+ of \d+ ---)"), lambda x: x.rlike(PAGE_MARK))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, PAGE_MARK, 1).cast("int").alias("page"), F.rtrim(F.regexp_replace(x, r"\s+\z", "")).alias("text")))


def only_pages(text: Column, pages: Column) -> Column:
    """Sections of the wanted pages; the whole text where none is wanted, marked or found."""
    kept = F.filter(split_pages(text), lambda p: F.array_contains(pages, p["page"]))
    return F.when(F.size(pages) <= 0, text).otherwise(S.let(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("[Index filter: selected pages only]\n\n"), F.array_join(F.transform(k, lambda p: p["text"]), "\n\n"), F.lit("\n"))).otherwise(text)))


MARK_LINE = r"(?mdU)^--- Page \d+ of \d+ ---\s*$"
#: Hints of deliverable 02; their texts are the caller's.
HINTS_02 = ["interest_payable_to", "distribution_us", "deutsche_rate", "deutsche_factor", "deutsche_interest_detail"]


def _annotated(text: Column, hint: Callable[[Column, Column], Column]) -> Column:
    """Hints after the marker line of each page that has any; in front of a text without markers."""
    sections = F.filter(F.split(text, r"(?mdU)(?=^--- Page \d+ of \d+ ---\s*$)"), lambda x: x.rlike(r"\A" + MARK_LINE))

    def one(x: Column) -> Column:
        page = F.regexp_extract(x, PAGE_MARK, 1).try_cast("int")
        body = F.regexp_replace(x, r"\A" + MARK_LINE, "")
        marked = lambda h: F.concat(F.regexp_extract(x, r"\A(--- Page \d+ of \d+ ---)", 1), F.lit("\n\n"), h, F.regexp_replace(body, r"\A\n+", ""))
        return S.let(hint(body, page), lambda h: F.when(h == "", x).otherwise(marked(h)))

    return S.let(sections, lambda found: F.when(F.size(found) > 0, F.array_join(F.transform(found, one), "\n\n")).otherwise(F.concat(hint(text, F.lit(None).cast("int")), text)))


def annotate_02(text: Column, hints: dict[str, str], previews: Column | None = None) -> Column:
    """a chunk with the hints of ``HINTS_02`` after the markers of the pages they are for.

    ``previews`` (``page, preview`` rows of the index) also tell pages of the
    distribution exhibit; of several previews of a page the last counts.
    """
    low = F.lower(text)
    deutsche = F.contains(low, F.lit("deutsche bank")) & S.any_of(low, ["distribution in us$", "interest detail", "factor information per 1000", "distribution of interest proceeds"])
    says = lambda key: F.lit(hints[key])

    def hint(body: Column, page: Column) -> Column:
        b = F.lower(body)
        dense = F.regexp_replace(b, r"(?U)\s+", "")
        every = lambda c, *words: functools.reduce(lambda x, y: x & y, [F.contains(c, F.lit(w)) for w in words])
        dist = F.contains(b, F.lit("distribution in us")) | every(b, "prior principal", "current principal") | every(dense, "priorprincipalbalance", "currentprincipalbalance")
        if previews is not None:
            p = F.lower(F.coalesce(F.try_element_at(F.filter(previews, lambda x: x["page"] == page), F.lit(-1))["preview"], F.lit("")))
            dist = dist | F.contains(p, F.lit("distribution in us")) | S.any_of(F.replace(p, F.lit(" "), F.lit("")), ["facevaluefacevaluebalance", "facevaluebalanceinterest"])
        payable = F.contains(b, F.lit("interest payable to")) & S.any_of(b, ["notes"])
        other = F.when(F.contains(b, F.lit("factor information per 1000")) | every(b, "coupon rates", "class cusip"), says("deutsche_factor")).when(every(dense, "interestdetail", "interestpaid"), says("deutsche_interest_detail")).otherwise("")
        main = F.when(dist, F.concat(says("distribution_us"), F.when(deutsche, says("deutsche_rate")).otherwise(""))).when(deutsche, other).otherwise("")
        return F.concat(F.when(payable, says("interest_payable_to")).otherwise(""), main)

    return _annotated(text, hint)


def annotate_03(text: Column, hint: str) -> Column:
    """a chunk with the hint after the markers of pages that hold the grid of administrative expenses."""

    def grid(body: Column, _: Column) -> Column:
        b = F.lower(body)
        lead = b.rlike(r"(?U)\(i\)\s+trustee")
        has = F.contains(b, F.lit("administrative cap and expenses")) | (lead & (F.contains(b, F.lit("administrative expenses cap")) | b.rlike(r"(?U)\badministrative\s+expenses\b")))
        return F.when(has & ~S.any_of(b, ["distribution of interest proceeds", "available optimal paid"]), hint).otherwise("")

    return _annotated(text, grid)


def score_page(target: str, preview: Column, page: Column) -> Column:
    """Additive keyword score of an index line for one deliverable; pages from 2.0 are read."""
    b = F.lower(preview)
    one = F.regexp_replace(b, r"\s+", " ")
    points = lambda test, n: F.when(test, float(n)).otherwise(0.0)
    has = lambda *w: S.any_of(b, list(w))
    if target == "01":
        return points(S.any_of(b, METADATA_WORDS), 3) + points(page <= 3, 2)
    if target == "02":
        dense = F.replace(b, F.lit(" "), F.lit(""))
        total = points(has("distribution in us"), 6) + points(has("interest detail"), 3) - points(has("factor per 1000", "factor information per 1000"), 2) + points(S.any_of(dense, DIST_US_WEAK), 4)
        return total + points(S.any_of(b, CLASS_WORDS), 3) + points(page <= 5, 1) + points(has("administrative expenses") & ~has("section 11.1"), 0.5)
    if target == "03":
        cap = S.any_of(one, ["administrative cap and expenses"])
        weak = S.any_of(one, ["administrative expenses cap"]) & S.any_of(one, ["administrative expenses"]) & ~S.any_of(one, ["distribution of interest proceeds"])
        anchors = S.any_of(one, INTEREST_ANCHORS) | S.any_of(one, PRINCIPAL_ANCHORS)
        return F.when(cap, 5.0).when(weak, 3.0).otherwise(0.0) + points(S.any_of(b, WATERFALL_WORDS), 3) + points(has("interest proceeds $", "principal proceeds"), 4) + points(anchors, 3)
    if target == "04":
        return points(page <= 2, 2)
    raise ValueError(target)


def _pages_where(test: Column) -> Column:
    return F.sort_array(F.collect_set(F.when(test, F.col("page"))))


def detect_layout(index: DataFrame) -> DataFrame:
    """Layout family of each deal's class tables with the pages that show it.

    One aggregation collects page sets per exhibit; the family is a CASE over
    them: dual exhibits, consolidated grid, distribution report, one exhibit
    alone, unknown.
    """
    b = F.lower("preview")
    dense = F.replace(b, F.lit(" "), F.lit(""))
    hit = lambda words: S.any_of(b, words)
    d = index.withColumns({"us": hit(DIST_US) | S.any_of(dense, DIST_US_WEAK)})
    g = d.groupBy("deal_key").agg(
        _pages_where(hit(PDD)).alias("pdd_pages"), _pages_where(hit(IDD)).alias("idd_pages"),
        _pages_where(hit(CONSOLIDATED) & ((F.col("page") > 1) | hit(CONSOLIDATED_FIRST))).alias("consolidated_pages"),
        _pages_where(hit(DISTRIBUTION)).alias("distribution_pages"), _pages_where(F.col("us")).alias("us_pages"), _pages_where(hit(INTEREST_DETAIL)).alias("interest_pages"),
        _pages_where(hit(FACTORS)).alias("sure_factors"), _pages_where(hit(["note valuation report"]) & (hit(["class cusip"]) | S.any_of(dense, ["factor per 1000"]))).alias("late_factors"),
        _pages_where(hit(["notes information"])).alias("notes_pages"),
    )
    late = F.filter("late_factors", lambda p: (F.size("us_pages") > 0) & (p > F.array_min("us_pages")))
    g = g.withColumn("factor_pages", F.sort_array(F.array_union("sure_factors", late)))
    pdd, idd, grid, dist = (F.size(c) > 0 for c in ("pdd_pages", "idd_pages", "consolidated_pages", "distribution_pages"))
    family = F.when(pdd & idd, "dual_pdd_idd").when(grid, "consolidated").when(dist & ~pdd & ~idd, "distribution_report").when(pdd | idd, "dual_pdd_idd").otherwise("unknown")
    core = F.array_union("us_pages", "interest_pages")
    both = F.array_union(F.array_union(core, F.col("pdd_pages")), F.col("idd_pages"))
    grids = F.array_union(core, F.array_except("consolidated_pages", "factor_pages"))
    none = F.array().cast("array<int>")
    primary = F.when(F.col("family") == "dual_pdd_idd", both).when(F.col("family") == "consolidated", grids).when(F.col("family") == "distribution_report", F.array_union("distribution_pages", "us_pages")).otherwise(none)
    strong = (F.size("us_pages") > 0) | F.arrays_overlap("notes_pages", grids)
    confidence = F.when(pdd & idd, "high").when(F.col("family") == "consolidated", F.when(F.coalesce(strong, F.lit(False)), "high").otherwise("medium")).when(F.col("family") == "unknown", "low").otherwise("medium")
    g = g.withColumn("family", family).withColumn("primary_pages", F.sort_array(primary)).withColumn("confidence", confidence)
    return g.select("deal_key", "family", "confidence", "pdd_pages", "idd_pages", "consolidated_pages", "distribution_pages", "factor_pages", "us_pages", "interest_pages", "primary_pages")


def refine_layout(layout: DataFrame, texts: DataFrame) -> DataFrame:
    """Correct the family where the chunk text (``deal_key, text``) shows what the index hides."""
    low = F.substring(F.lower("text"), 1, 400_000)
    has = lambda w: F.contains(low, F.lit(w))
    t = texts.select("deal_key", has("distribution in us$").alias("t_us"), (has("principal distribution detail") & has("interest distribution detail")).alias("t_dual"), (has("notes information") & (has("beginning principal") | has("all in rate") | has("interest due"))).alias("t_notes"))
    d = layout.join(t, "deal_key", "left")
    us = F.coalesce("t_us", F.lit(False)) | (F.size("us_pages") > 0)
    family = (
        F.when(F.col("family").isin("consolidated", "unknown") & us, "consolidated")
        .when(F.coalesce("t_dual", F.lit(False)), "dual_pdd_idd")
        .when((F.col("family") == "unknown") & F.coalesce("t_notes", F.lit(False)), "consolidated")
        .otherwise(F.col("family"))
    )
    return d.withColumn("confidence", F.when(family != F.col("family"), "high").otherwise(F.col("confidence"))).withColumn("family", family).drop("t_us", "t_dual", "t_notes")


def neighbours(pages: Column) -> Column:
    """Pages with the one before and the one after each."""
    return F.sort_array(F.array_distinct(F.filter(F.flatten(F.transform(pages, lambda p: F.array(p - 1, p, p + 1))), lambda p: p >= 1)))


def span(low: Column, high: Column) -> Column:
    """All pages from low to high; empty where there is none."""
    return F.when(low.isNotNull() & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def select_pages(index: DataFrame, target: str, total: DataFrame | None = None) -> DataFrame:
    """``deal_key, pages`` to read for a deliverable: scored pages, widened as the target needs."""
    score = score_page(target, F.col("preview"), F.col("page"))
    g = index.withColumn("score", score).groupBy("deal_key").agg(_pages_where(F.col("score") >= 2.0).alias("scored"), F.count(F.lit(1)).alias("n"))
    none = F.array().cast("array<int>")
    if target == "02":
        lay = detect_layout(index)
        d = g.join(lay, "deal_key")
        dual = F.array_union(F.array_union("pdd_pages", "idd_pages"), F.array_union("us_pages", "interest_pages"))
        filled = lambda p: span(F.greatest(F.lit(1), F.array_min(p) - 1), F.array_max(p))
        grids = F.array_union(F.array_union("us_pages", "interest_pages"), F.col("primary_pages"))
        generic = F.array_union("scored", span(F.least(F.array_min("scored"), F.lit(2)), F.array_max("scored")))
        pages = F.when(F.col("family") == "dual_pdd_idd", filled(dual)).when((F.col("family") == "consolidated") & (F.size(grids) > 0), neighbours(grids)).when(F.col("family") == "distribution_report", filled(F.array_union("distribution_pages", "us_pages"))).otherwise(generic)
    elif target == "03":
        one = F.regexp_replace(F.lower("preview"), r"\s+", " ")
        a = index.withColumn("score", score).groupBy("deal_key").agg(
            _pages_where(S.any_of(one, INTEREST_ANCHORS)).alias("ia"), _pages_where(S.any_of(one, PRINCIPAL_ANCHORS)).alias("pa"), _pages_where((F.col("score") >= 2.0) | S.any_of(one, INTEREST_ANCHORS + PRINCIPAL_ANCHORS + WEAK_ANCHORS)).alias("any")
        )
        d = g.join(a, "deal_key")
        d = d.join(total, "deal_key", "left") if total is not None else d.withColumn("total", F.lit(None).cast("int"))
        two = (F.size("ia") > 0) & (F.size("pa") > 0)
        low = F.when(two, F.least(F.array_min("ia"), F.array_min("pa"))).otherwise(F.array_min("any"))
        high = F.when(two, F.greatest(F.array_max("ia"), F.array_max("pa"))).otherwise(F.array_max("any"))
        tail = (F.size("pa") > 0) & (F.col("total") > high) & (F.col("total") - high <= 4)
        lone = ~two & (F.size("any") == 1) & (low <= 5)
        high = F.when(F.coalesce(tail | (lone & F.col("total").isNotNull()), F.lit(False)), F.col("total")).otherwise(high)
        pages = F.array_union("scored", span(low.cast("int"), high.cast("int")))
    else:
        d, pages = g, F.col("scored")
    pages = F.coalesce(pages, none)
    if target in ("01", "02"):
        pages = F.when(F.size(pages) == 0, span(F.lit(1), F.least(F.lit(5), F.col("n")).cast("int"))).otherwise(pages)
    return d.select("deal_key", F.sort_array(F.array_distinct(pages)).alias("pages"))


def expense_pages(index: DataFrame) -> DataFrame:
    """``deal_key, extra``: pages of the primary report whose index line shows the grid of administrative expenses."""
    b = F.lower(F.coalesce("preview", F.lit("")))
    one = F.regexp_replace(b, r"\s+", " ")
    in_waterfall = S.any_of(b, ["section 11.1", "distribution of interest proceeds", "available optimal paid"])
    cap = F.contains(one, F.lit("administrative expenses cap"))
    schedule = F.contains(b, F.lit("schedule g")) & (F.col("page") <= 4)
    grid = (
        F.when(F.contains(one, F.lit("administrative cap and expenses")), True)
        .when(cap, ~S.any_of(one, ["section 11.1", "distribution of interest proceeds"]))
        .otherwise((F.contains(b, F.lit("administrative expenses")) & ~in_waterfall) | schedule)
    )
    return index.groupBy("deal_key").agg(_pages_where(grid).alias("extra"))


def _pages_by_report(primary: DataFrame, waterfall: DataFrame, tree: str, total: DataFrame | None, waterfall_total: DataFrame | None) -> DataFrame:
    """``deal_key, own, wf``: pages of file 03 in the primary report, with its expense pages, and in the waterfall report."""
    if tree not in ("primary", "waterfall", "both"):
        raise ValueError(tree)
    none = F.array().cast("array<int>")
    own = select_pages(primary, "03", total).join(expense_pages(primary), "deal_key").select("deal_key", F.sort_array(F.array_union("pages", "extra")).alias("own"))
    wf = select_pages(waterfall, "03", waterfall_total).withColumnRenamed("pages", "wf")
    d = own.join(wf, "deal_key", "full")
    keep = lambda c, use: F.coalesce(F.col(c), none) if use else none
    return d.select("deal_key", keep("own", tree != "waterfall").alias("own"), keep("wf", tree != "primary").alias("wf"))


def mandatory_pages(primary: DataFrame, waterfall: DataFrame, tree: str = "both", total: DataFrame | None = None, waterfall_total: DataFrame | None = None) -> DataFrame:
    """``deal_key, page``: pages that file 03 must be read from, as rule V12 wants them.

    ``primary`` and ``waterfall`` are index rows (``deal_key, page, preview``)
    of a deal's two reports; ``tree`` says which of them count. Deals without
    a waterfall page give no row.
    """
    d = _pages_by_report(primary, waterfall, tree, total, waterfall_total)
    return d.select("deal_key", F.explode(F.sort_array(F.array_union("own", "wf"))).alias("page"))


def waterfall_chunks(spans: DataFrame, primary: DataFrame, waterfall: DataFrame, tree: str = "both", total: DataFrame | None = None, waterfall_total: DataFrame | None = None) -> DataFrame:
    """Chunks (``deal_key, tree, first, last, ...``) of either report that hold a page of file 03.

    With the waterfall report alone its pages are looked up in the primary
    report's chunks too.
    """
    d = _pages_by_report(primary, waterfall, tree, total, waterfall_total)
    primary_pages = F.col("wf") if tree == "waterfall" else F.col("own")
    wanted = d.select("deal_key", F.inline(F.array(F.struct(F.lit("primary").alias("tree"), primary_pages.alias("pages")), F.struct(F.lit("waterfall").alias("tree"), F.col("wf").alias("pages")))))
    hit = F.exists("pages", lambda p: p.between(F.col("first"), F.col("last")))
    return spans.join(wanted, ["deal_key", "tree"]).filter(hit).select(*spans.columns)


def chunks_for(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks (``deal_key, first, last``) that hold a wanted page: an overlap test on one deal row."""
    d = spans.join(pages, "deal_key")
    return d.filter(F.exists("pages", lambda p: p.between(F.col("first"), F.col("last")))).select(*spans.columns)


def gate(pages: DataFrame, max_pages: int = GATE_PAGES) -> DataFrame:
    """``deal_key, passed, profile, reason`` from the first pages of each report."""
    probe = F.when(F.col("page") <= GATE_PROBE_PAGES, F.lower(F.coalesce("text", F.lit(""))))
    g = pages.groupBy("deal_key").agg(F.max("page").alias("n"), F.sort_array(F.collect_list(F.when(probe.isNotNull(), F.struct("page", probe.alias("t"))))).alias("ps"))
    blob = F.substring(F.array_join(F.col("ps.t"), "\n"), 1, GATE_PROBE_CHARS)
    d = g.withColumn("blob", blob)
    date, tranche, waterfall = (S.any_of(F.col("blob"), w) for w in (DATE_MARKERS, TRANCHE_MARKERS, WATERFALL_MARKERS))
    reason = F.when(F.col("n") > max_pages, "too many pages").when(~date, "no payment date").when(~tranche & ~waterfall, "no tranche or waterfall section").otherwise("ok")
    profile = F.when(tranche & waterfall, "full").when(waterfall, "waterfall_only").when(tranche, "tranche_only")
    return d.withColumn("reason", reason).select("deal_key", (F.col("reason") == "ok").alias("passed"), F.when(F.col("reason") == "ok", profile).alias("profile"), "reason")
