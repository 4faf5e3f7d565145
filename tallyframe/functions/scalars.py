"""Lenient casts and text helpers as Column functions.

All are built from native expressions, so they stay inside code generation
and are pushed next to the scan. Null in gives null out unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a number may look like before it is cast; shuts out inf, nan and suffixes.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: The tokens that stand for "no amount".
BLANKS_B = ["", "N/A", "NA", "—", "-", "--"]
#: Date formats, in the order in which they are tried.
US_DATES = ["M/d/yyyy", "M/d/yy", "yyyy-M-d", "d-MMM-yyyy", "d-MMMM-yyyy", "d-MMM-yy"]
FOLDER_DATES = ["yyyy-M-d", "M/d/yyyy", "M/d/yy", "M-d-yyyy", "d/M/yyyy"]
REQUEST_DATES = ["M/d/yyyy", "M/d/yy", "yyyy-M-d", "M-d-yyyy", "d/M/yyyy"]
LONG_DATES = ["MMMM d, yyyy", "MMM d, yyyy"]
#: Suffixes of program slices of one economic class.
SLICE_SUFFIXES = ["144A", "REGS", "REGA", "AI"]
RATE_TYPE_ONLY = r"(?i)^(floating|variable|fixed|float|var|fixed\s+rate|floating\s+rate|variable\s+rate)$"
RATE_TYPE_WORD = r"(?i)\b(floating|variable|fixed)\b"
UNPAID = r"(?i)unpaid\s+([\d,]+\.?\d*)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(" \t\n\r\f\x0b"))


def _number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def parse_number(c: Column) -> Column:
    """Lenient number A: drops ``$``, ``,`` and ``%``; no negative brackets, no scaling of percents."""
    return F.when(F.upper(c) != "N/A", _number(strip(F.translate(c, "$,%", ""))))


def to_float(c: Column) -> Column:
    """Lenient number B: ``(x)`` is negative, ``x%`` is a hundredth, else the first number inside."""

    def read(t: Column) -> Column:
        bare = F.regexp_replace(t, r"\s*%$", "")
        signed = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
        v = let(signed, lambda n: F.coalesce(_number(n), _number(F.regexp_extract(n, r"-?\d+(?:\.\d+)?", 0))))
        return F.when(t.endswith("%"), v / 100).otherwise(v)

    return let(strip(c), lambda s: F.when(F.upper(s).isin(BLANKS_B), F.lit(None)).otherwise(let(strip(F.translate(s, ",$", "")), read)))


def money_cell(c: Column) -> Column:
    """Strict money text: currency signs, commas and spaces dropped; null unless a plain number."""
    t = F.regexp_replace(c, r"[\s$€£,]", "")
    return F.when(t.rlike(r"^-?\d+(\.\d+)?$"), t)


def browser_number(c: Column) -> Column:
    """Number as a lenient viewer reads it: signs dropped, ``(x)`` negative, trailing text ignored."""
    t = strip(F.translate(c, ",$€£", ""))
    t = F.when(t.startswith("(") & t.endswith(")"), F.concat(F.lit("-"), F.regexp_replace(t, r"^\(|\)$", ""))).otherwise(t)
    return _number(F.regexp_extract(t, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1))


def first_date(c: Column, formats: list[str]) -> Column:
    """The first format that fits wins; two-digit years from 69 lie in the last century."""
    found = []
    for f in formats:
        d = F.try_to_date(c, f)
        short = f.endswith("yy") and not f.endswith("yyyy")
        found.append(let(d, lambda x: F.when(F.year(x) >= 2069, F.add_months(x, -1200)).otherwise(x)) if short else d)
    return F.coalesce(*found)


def us_date(c: Column) -> Column:
    return first_date(strip(c), US_DATES)


def folder_date(c: Column) -> Column:
    """Date of a folder name: an ISO date may carry a time, others must fit whole."""
    s = strip(c)
    iso = F.when(s.rlike(r"^\d{4}-"), F.try_to_date(F.substring(s, 1, 10), "yyyy-M-d"))
    return F.coalesce(iso, first_date(s, FOLDER_DATES[1:]))


def request_date(c: Column) -> Column:
    return first_date(strip(c), REQUEST_DATES)


def yyyymmdd(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd")


def iso_date(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def any_date_yyyymmdd(c: Column) -> Column:
    """``yyyymmdd`` of eight digits, of a US or long date, or of text that holds eight digits."""
    s = strip(c)
    digits = F.regexp_replace(s, r"\D", "")
    d = F.coalesce(us_date(s), first_date(s, LONG_DATES))
    return F.when(s.rlike(r"^\d{8}$"), s).when(d.isNotNull(), yyyymmdd(d)).when(F.length(digits) == 8, digits).otherwise("")


def clean_path(c: Column) -> Column:
    """Path text; null and the spellings of "no value" become empty."""
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(F.lower(s).isin("nan", "none", "<na>"), "").otherwise(s)


def deal_id(c: Column) -> Column:
    """Id without the ``.0`` that a float column leaves."""
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(F.lower(s) == "nan", "").otherwise(F.regexp_replace(s, r"^(\d+)\.0$", "$1"))


def folder_name(id_: Column, date: Column, stem: Column) -> Column:
    """``{deal}_{yyyymmdd}`` where both are known, else the file's stem."""
    did, ymd = deal_id(id_), yyyymmdd(folder_date(date))
    return F.when((did != "") & ymd.isNotNull(), F.concat_ws("_", did, ymd)).otherwise(stem)


def folder_parts(c: Column) -> Column:
    """Struct of deal id, payment date and source from ``{deal}_{yyyymmdd}[_sdk|_llm]``."""
    pattern = r"(?i)^(.+?)_(\d{8})(?:_(sdk|llm))?$"
    part = lambda i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    return F.struct(part(1).alias("deal_id"), F.try_to_date(part(2), "yyyyMMdd").alias("payment_date"), F.lower(part(3)).alias("source"))


def format_amount(c: Column) -> Column:
    """Two decimals with thousands commas; amounts next to nothing are ``0.00``; null is empty."""
    return F.when(c.isNull(), "").when(F.abs(c) < 1e-9, "0.00").otherwise(F.format_number(c, 2))


def fee_key(c: Column) -> Column:
    """Fee description in lower case, without a leading "payment of (the)", spaces collapsed."""
    s = F.regexp_replace(strip(F.lower(c)), r"^payment of\s+(the\s+)?", "")
    return F.regexp_replace(s, r"\s+", " ")


def without_priority(c: Column) -> Column:
    """Description without a leading clause such as ``(A)(2)(i)``."""
    s = F.regexp_replace(strip(c), r"(?i)^\([A-Z]\)(?:\([0-9ivx]+\))*\s*", "")
    return strip(F.regexp_replace(s, r"(?i)^\([0-9ivx]+\)\s*", ""))


def priority_key(c: Column) -> Column:
    """The bracketed parts of a priority joined, or the text without spaces; blanks are empty."""
    s = strip(F.lower(F.coalesce(c, F.lit(""))))
    parts = F.array_join(F.regexp_extract_all(s, F.lit(r"\([^)]+\)"), F.lit(0)), "")
    return F.when(s.isin("", "—", "-", "n/a"), "").when(parts != "", parts).otherwise(F.regexp_replace(s, r"\s+", ""))


def clause_steps(priority: Column, description: Column) -> Column:
    """Distinct steps such as ``b(a)`` in priority and description."""
    blob = F.lower(F.concat_ws(" ", priority, description))
    return F.array_distinct(F.regexp_extract_all(blob, F.lit(r"\b[a-z]\([a-z0-9]+\)"), F.lit(0)))


def rate_is_type(c: Column) -> Column:
    """True where a rate cell only names a kind of rate."""
    t = strip(F.coalesce(c, F.lit("")))
    return (t != "") & (F.upper(t) != "N/A") & (t.rlike(RATE_TYPE_ONLY) | (t.rlike(RATE_TYPE_WORD) & ~t.rlike(r"\d")))


def rate_is_filled(c: Column) -> Column:
    """True where a rate cell holds digits, a percent or a point and is no type label."""
    t = strip(F.coalesce(c, F.lit("")))
    return ~t.isin("", "—", "-", "–") & (F.upper(t) != "N/A") & ~rate_is_type(c) & t.rlike(r"[\d%.]")


def unpaid_amount(c: Column) -> Column:
    """The number after "unpaid"."""
    return parse_number(F.nullif(F.regexp_extract(c, UNPAID, 1), F.lit("")))


def economic_class(c: Column) -> Column:
    """The class before a program-slice suffix; null where there is none."""
    s = strip(c)
    base = F.regexp_extract(s, rf"(?is)^(.+)[- ](?:{'|'.join(SLICE_SUFFIXES)})$", 1)
    return F.nullif(strip(F.regexp_replace(base, r"[- ]+$", "")), F.lit(""))


def security_id(c: Column) -> Column:
    """Nine letters or digits in upper case, without spaces and hyphens; else null."""
    s = F.upper(F.regexp_replace(c, r"[\s\-]", ""))
    return F.when(s.rlike(r"^[0-9A-Z]{9}$"), s)


def name_key(c: Column) -> Column:
    """Letters and digits of a name in upper case."""
    return F.regexp_replace(F.upper(c), r"[^A-Z0-9]", "")


def amounts(c: Column) -> Column:
    """All amounts with two decimals in a text, as doubles, in order."""
    raw = F.regexp_extract_all(c, F.lit(r"\$?\s*[\d,]+\.\d{2}"), F.lit(0))
    return F.filter(F.transform(raw, parse_number), lambda v: v.isNotNull())


def table_cell(c: Column) -> Column:
    """Text that is safe in a pipe table."""
    return strip(F.regexp_replace(F.replace(c, F.lit("|"), F.lit("¦")), r"\s*\n\s*", " "))


def percent_of(part: Column, whole: Column) -> Column:
    """100 * part / whole rounded to one decimal; null where there is no whole."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 1))


def close(a: Column, b: Column, absolute: float, relative: float, least: float = 1.0) -> Column:
    """abs(a - b) <= max(absolute, relative * max(abs a, abs b, least))."""
    scale = F.greatest(F.abs(a), F.abs(b), F.lit(least))
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * scale)


def lines(text: Column) -> Column:
    """Lines of a text, whatever the kind of line end."""
    return F.split(F.regexp_replace(text, r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85  ]", "\n"), "\n")


def preview_lines(text: Column, max_lines: int = 2, max_len: int = 120) -> Column:
    """The first non-empty lines, spaces collapsed, cut, joined by " / "; pipes are broken bars."""
    full = F.filter(F.transform(lines(text), lambda x: F.regexp_replace(strip(x), r"\s+", " ")), lambda x: x != "")
    cut = F.transform(F.slice(full, 1, max_lines), lambda x: F.when(F.length(x) > max_len, F.concat(F.rtrim(F.substring(x, 1, max_len - 1)), F.lit("…"))).otherwise(x))
    return F.when(F.size(full) == 0, "(no text)").otherwise(F.replace(F.array_join(cut, " / "), F.lit("|"), F.lit("¦")))


#: Labels that are looked for anywhere on a page, in this order.
CLASS_HINTS = [
    ("Reinvesting Holder", r"(?i)reinvesting\s+holder(?:\s+note)?s?"),
    ("Income Notes", r"(?i)income\s+notes?"),
    ("M Notes", r"(?i)\bclass\s+m\s+notes?\b|\bm\s+notes?\b"),
    ("Subordinated Notes", r"(?i)subordinated\s+notes?"),
    ("Preferred", r"(?i)preferred\s+(?:return|stock|shares?)"),
]
SECTION_HINTS = [
    ("Distribution in US$", r"(?i)distribution\s+in\s+us\$?"),
    ("Interest Detail", r"(?i)\binterest\s+detail\b"),
    ("Factor per 1000 (coupon only — not balances)", r"(?i)factor\s+information\s+per\s+1000"),
    ("Administrative Cap and Expenses (admin grid under Administrative Expenses only)", r"(?i)administrative\s+cap\s+and\s+expenses"),
]
CLASS_WORD = r"(?i)\bclass\s+([a-z][a-z0-9\-\.]{0,12}(?:\s*-\s*[a-z])?)\b"
NOT_A_CLASS = ["balance", "total", "name", "type", "notes"]
SCAN_CHARS = 24_000


def _found(text: Column, hints: list[tuple[str, str]]) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in hints]), lambda x: x.isNotNull())


def class_labels(text: Column, most: int = 5) -> Column:
    """Class labels on a page: known kinds first, then "Class X" in order of appearance."""

    def distinct(found: Column) -> Column:
        return let(F.transform(found, lambda x: F.lower(x)), lambda keys: F.slice(F.filter(found, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1), 1, most))

    def search(scan: Column) -> Column:
        tokens = F.filter(F.regexp_extract_all(scan, F.lit(CLASS_WORD), F.lit(1)), lambda t: ~F.lower(F.regexp_replace(t, r"\s+", "")).isin(NOT_A_CLASS))
        return F.concat(_found(scan, CLASS_HINTS), F.transform(tokens, lambda t: F.concat(F.lit("Class "), strip(t))))

    return let(let(F.substring(text, 1, SCAN_CHARS), search), distinct)


def page_preview(text: Column, max_len: int = 200) -> Column:
    """Index line of a page: first lines, the lead section in front, other sections and classes behind."""
    lead, label = SECTION_HINTS[0][1], SECTION_HINTS[0][0]
    scan = F.substring(text, 1, SCAN_CHARS)
    base = let(preview_lines(text), lambda b: F.when(scan.rlike(lead), F.concat(F.lit(label + " / "), b)).otherwise(b))
    also = let(_found(scan, SECTION_HINTS[1:]), lambda s: F.concat(s, F.filter(class_labels(text), lambda x: ~F.array_contains(s, x))))
    line = let(also, lambda a: F.when(F.size(a) > 0, F.concat(base, F.lit(" [also: "), F.array_join(a, ", "), F.lit("]"))).otherwise(base))
    cut = let(line, lambda x: F.when(F.length(x) > max_len, F.concat(F.rtrim(F.substring(x, 1, max_len - 1)), F.lit("…"))).otherwise(x))
    return F.replace(cut, F.lit("|"), F.lit("¦"))


def any_of(text: Column, words: list[str]) -> Column:
    """True where the text contains one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
