"""Class labels brought to the compact keys under which they are registered.

Native expressions in a fixed order of attempts: preferred shares, tiers,
tranche tokens before "subordinated", subordinated, combination, series,
performance, income, CP/LT/ST, leading token, compact text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.scalars import let, name_key, strip

# --- Fixed values: prefixes, words, aliases and variants of class labels ---
PREFIXES = ["CLASS ", "CLASSES ", "NOTE CLASS ", "NOTES CLASS ", "NOTE ", "NOTES ", "HOLDERS OF THE ", "THE ", "TRANCHE "]
DESCRIPTORS = "SENIOR MEZZANINE JUNIOR SUBORDINATED PREFERRED PREFERENCE SECURED UNSECURED DEFERRABLE DEFERRED FLOATING FIXED".split()
STOP_SUFFIXES = DESCRIPTORS + "NOTE NOTES LOAN LOANS HOLDERS SHARE SHARES STOCK EQUITY CP LT ST MEZZ RATE".split()
ALIASES = {
    "SUBORDINATEDNOTES": "SUB", "SUBORDINATEDNOTE": "SUB", "SUBNOTES": "SUB", "SUBNOTE": "SUB", "INCOME": "INC",
    "COMBONOTES": "COMB", "COMBONOTE": "COMB", "COMBO": "COMB", "PERFORMANCE": "P", "PERFORMANCENOTES": "P", "PERFORMANCENOTE": "P", "PERF": "P",
}
ROMAN = {"I": "1", "II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6", "VII": "7", "VIII": "8", "IX": "9", "X": "10"}
SUB_KEYS = ["PS", "SUB", "PS1"]
PREF_KEYS = ["PS2", "PREFERENCESHARES", "PREFERENCESHARE", "PREFERREDSHARES", "PREFERREDSHARE", "PREF", "PS"]
VARIANTS = {
    "PS": ["PS", "SUB", "PS1", "PREFERENCESHARES", "PREFERENCESHARE", "PREFERREDSHARES", "PREFERREDSHARE", "PS2", "PREF"],
    "PS1": SUB_KEYS, "SUB": SUB_KEYS, "PS2": PREF_KEYS, "PREF": PREF_KEYS, "PREFERENCESHARES": PREF_KEYS, "PREFERENCESHARE": PREF_KEYS,
    "PREFERREDSHARES": PREF_KEYS, "PREFERREDSHARE": PREF_KEYS, "COMB": ["COMB", "COMBO"], "COMBO": ["COMB", "COMBO"],
    "P": ["P", "PERF", "PERFORMANCE"], "PERF": ["P", "PERF", "PERFORMANCE"], "PERFORMANCE": ["P", "PERF", "PERFORMANCE"],
    "INC": ["INC", "INCOME"], "INCOME": ["INC", "INCOME"],
}
NOT_SERIES = "CLASS CLASSES NOTE NOTES HOLDERS THE TRANCHE SUB INC PS PS1 PS2 PREF MEZZ CLO".split()
SERIES_PREFIX = r"(?i)^[A-Z][A-Z0-9-]{0,12}\s+\d{4}\s*[-/]\s*\d+[A-Z0-9]*\s+"
VINTAGE_PREFIX = r"(?i)^\d{4}\s*[-/]\s*\d+[A-Z0-9]*\s+"
ANCHOR = r"(?i)(\bSUBORDINATED\s+(?:NOTE|NOTES)\b|\b(?:NOTE\s+)?CLASS\s+|\b(?:PREFERENCE|PREFERRED)\s+|\bINCOME\s+|\bSUB\s+[A-Z]\b|\bSUB\b)"
LEAD = r"^([A-Z0-9]+(?:\s*[-/]\s*[A-Z0-9]+)*)(?=\s|$|[,/])"
SPACED_SUFFIX = r"^\s+(RR|[A-Z]{2,4}|[A-Z]\d{0,2})\b"
JUNK = r"^\d{7,}$"


def tidy(c: Column) -> Column:
    """Underscores as spaces, trimmed."""
    return strip(F.regexp_replace(c, "_+", " "))


def series_token(c: Column) -> Column:
    """Whether a token is an issuer code or a vintage, no tranche."""
    return let(F.upper(c), lambda t: ~t.isin(NOT_SERIES) & (t.rlike(r"^\d{4}[-/]\d+[A-Z0-9]*$") | t.rlike(r"^[A-Z]{4,12}$")))


def series_key(c: Column) -> Column:
    """Vintages compare without their letter."""
    return F.regexp_replace(F.upper(c), r"^(\d{4})[-/](\d+)[A-Z0-9]*$", "$1-$2")


def shared_tokens(peers: Column) -> Column:
    """Number of leading series tokens that all labels of a deal share; 0 for fewer than two labels."""
    lists = F.transform(F.filter(peers, lambda p: strip(p) != ""), lambda p: F.split(strip(p), r"\s+"))

    def count(ls: Column) -> Column:
        first = F.try_element_at(ls, F.lit(1))
        same = F.transform(first, lambda tok, i: series_token(tok) & F.forall(ls, lambda one: F.coalesce(series_key(F.get(one, i)) == series_key(tok), F.lit(False))))
        stop = F.array_position(same, F.lit(False)).cast("int")
        return F.when(F.size(ls) < 2, 0).when(stop > 0, stop - 1).otherwise(F.size(first))

    return F.coalesce(let(lists, count), F.lit(0))


def strip_deal(label: Column, deal_name: Column, shared: Column) -> Column:
    """Label without a leading deal name, shared series tokens or series id, from its class anchor on."""
    name = strip(F.coalesce(deal_name, F.lit("")))
    out = tidy(label)
    short = strip(F.regexp_replace(name, r"(?s)\s*\*\*.*$", ""))

    def without(p: Column):
        def cut(s: Column) -> Column:
            rest = F.regexp_replace(F.substring(s, F.length(p) + 1, F.length(s)), r"^[ \-–—/:;,]+", "")
            return F.when((p != "") & F.startswith(F.upper(s), F.upper(p)) & (rest != ""), rest).otherwise(s)

        return cut

    for candidate in (name, strip(F.substring_index(name, ",", 1)), short, strip(F.substring_index(short, ",", 1))):
        out = let(out, without(candidate))

    def tokens(s: Column) -> Column:
        parts = F.split(s, r"\s+")
        return F.when((shared > 0) & (F.size(parts) > shared), F.array_join(F.slice(parts, shared + 1, F.size(parts)), " ")).otherwise(s)

    def series(s: Column) -> Column:
        rest = F.when(s.rlike(SERIES_PREFIX), F.regexp_replace(s, SERIES_PREFIX, "")).otherwise(F.regexp_replace(s, VINTAGE_PREFIX, ""))
        return F.when(rest != "", rest).otherwise(s)

    def anchor(s: Column) -> Column:
        at = F.regexp_instr(s, F.lit(ANCHOR))
        return F.when(at > 1, strip(F.substring(s, at, F.length(s)))).otherwise(s)

    return let(let(let(out, tokens), series), anchor)


def _without_prefix(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"\s+", " "), f"^(?:{'|'.join(PREFIXES)})", ""))


def _alias(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def _lead_key(text: Column) -> Column:
    """Key of the leading tranche token with spaced digits and revisions glued on; null if there is none."""

    def glue(lead: Column) -> Column:
        rest = F.substring(text, F.length(lead) + 1, F.length(text))
        digit = F.when(F.regexp_replace(lead, r"\s", "").rlike("^[A-Z]$"), F.regexp_extract(rest, r"^\s+(\d+)", 1)).otherwise("")
        after = F.when(digit != "", F.regexp_replace(rest, r"^\s+\d+", "")).otherwise(rest)
        suffix = F.regexp_extract(after, SPACED_SUFFIX, 1)
        token = F.concat(lead, digit, F.when(suffix.isin(STOP_SUFFIXES), "").otherwise(suffix))
        return F.when((lead != "") & ~F.regexp_replace(token, r"\s", "").isin(DESCRIPTORS), F.nullif(name_key(token), F.lit("")))

    return let(F.regexp_extract(text, LEAD, 1), glue)


def is_preferred(c: Column) -> Column:
    return c.rlike("PREFERRED|PREFERENCE") & c.rlike("SHARE|STOCK|EQUITY")


def sub_key(t: Column) -> Column:
    """``SUB`` or ``SUBA`` of a label without prefix; null for others."""
    tier = F.nullif(F.regexp_extract(t, r"^(?:SUBORDINATED (?:NOTE|NOTES)|SUB) ([A-Z])\b", 1), F.lit(""))
    plain = (F.contains(t, F.lit("SUBORDINATED")) & t.rlike("NOTE|S")) | t.isin("SUB NOTES", "SUB NOTE", "SUB")
    return F.when(tier.isNotNull(), F.concat(F.lit("SUB"), tier)).when(plain, "SUB")


def tier_key(t: Column) -> Column:
    letter = F.regexp_extract(name_key(t), "^PS([A-Z])$", 1)
    return F.when(letter != "", F.concat(F.lit("SUB"), letter))


def _over_sub(t: Column) -> Column:
    before = strip(F.regexp_extract(t, r"^(.*?)\bSUBORDINATED\b", 1))
    core = _lead_key(before)
    bare = t.rlike(r"^SUBORDINATED (?:NOTE|NOTES) [A-Z]\b|^SUB [A-Z]\b")
    return let(core, lambda k: F.when(~bare & (before != "") & ~k.isin([*DESCRIPTORS, "SUB", "SUBORDINATEDNOTES", "SUBORDINATEDNOTE"]) & ~k.rlike(JUNK), _alias(k)))


def _series(t: Column) -> Column:
    number = F.regexp_extract(t, r"^SERIES ([IVXLCDM]+|\d+) COMBINATION SECURIT", 1)
    short = F.regexp_extract(t, r"^S\s*[-/]\s*(\d+)$", 1)
    roman = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    arabic = lambda n: F.coalesce(F.try_element_at(roman, n), F.regexp_replace(n, "^0+(?=.)", ""))
    return F.when(number != "", F.concat(F.lit("SERIES"), arabic(number))).when(short != "", F.concat(F.lit("SERIES"), arabic(short)))


def _combination(t: Column) -> Column:
    named = t.isin("COMB", "COMBO", "COMBINATION NOTES", "COMBINATION NOTE") | (F.contains(t, F.lit("COMBO")) & t.rlike("NOTE|S"))
    return F.when(named | name_key(t).isin("COMB", "COMBO", "COMBONOTES", "COMBONOTE"), "COMB")


def _performance(t: Column) -> Column:
    named = F.contains(t, F.lit("PERFORMANCE")) & t.rlike("NOTE|S")
    return F.when(named | name_key(t).isin("P", "PERFORMANCE", "PERFORMANCENOTES", "PERFORMANCENOTE", "PERF"), "P")


def income_key(t: Column) -> Column:
    return F.when((t == "INC") | t.rlike(r"\bINCOME NOTE|^INCOME(?:[\s\-/]|$)"), "INC")


def _letter_kind(t: Column) -> Column:
    clean = strip(F.regexp_replace(F.regexp_replace(t, "[;,.]", " "), r"\s+", " "))
    a = r"^(?:CLASS )?([A-Z]) (CP|LT|ST)\b"
    b = r"^([A-Z])\s*[-/]\s*(CP|LT|ST)\b"
    both = lambda p: F.nullif(F.concat(F.regexp_extract(clean, p, 1), F.regexp_extract(clean, p, 2)), F.lit(""))
    return F.coalesce(both(a), both(b))


def class_key(label: Column, deal_name: Column, shared: Column, has_sub: Column) -> Column:
    """Compact key of a class label; null or blank gives the empty key.

    ``shared`` is :func:`shared_tokens` of the deal's labels, ``has_sub``
    whether the deal has subordinated notes beside preferred shares.
    """

    def keys(raw: Column) -> Column:
        loan = raw.rlike(r"\bLOANS?\b")
        work = strip(F.regexp_replace(raw, r"\s+(?:NOTE|NOTES|LOAN|LOANS)\s*$", ""))
        bare = work
        for prefix in PREFIXES:
            bare = strip(F.regexp_replace(bare, f"^{prefix}", ""))

        def with_loan(k: Column) -> Column:
            fixed = k.rlike("^(?:SUB|PS)[A-Z]$") | k.isin("PS", "PS1", "PS2", "SUB", "PREF", "P") | k.rlike("[A-Z0-9]L$")
            return F.when(~loan | fixed | (k == ""), k).when(k.isin("COMB", "COMBO"), "COMB").otherwise(F.concat(k, F.lit("L")))

        def attempts(t: Column) -> Column:
            return F.coalesce(
                F.when(is_preferred(work), F.when(has_sub, "PS2").otherwise("PS")),
                tier_key(t), let(_over_sub(t), with_loan), sub_key(t), _combination(t), _series(t), _performance(t), income_key(work), _letter_kind(work),
                let(bare, lambda s: let(F.coalesce(_lead_key(s), name_key(s)), lambda k: with_loan(_alias(k)))),
            )

        return let(_without_prefix(work), attempts)

    upper = F.upper(F.regexp_replace(tidy(strip_deal(label, deal_name, shared)), r"\s+", " "))
    return F.coalesce(let(upper, keys), F.lit(""))


def full_preferred_key(name: Column) -> Column:
    """Key of the whole printed label of preferred shares; null for others."""
    u = F.upper(strip(name))
    return F.when(is_preferred(u), name_key(_without_prefix(u)))


def lookup_variants(key: Column, income_as_ps: Column) -> Column:
    """Keys under which a class may be registered, in order of preference."""
    table = F.create_map(*[x for k, v in VARIANTS.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    letter = F.regexp_extract(key, "^(?:SUB|PS)([A-Z])$", 1)
    number = F.regexp_extract(key, r"^S(?:ERIES)?(\d+)$", 1)
    romans = F.create_map(*[F.lit(x) for k, v in ROMAN.items() for x in (v, k)])
    roman = F.try_element_at(romans, number)
    series = F.array_compact(F.array(key, F.concat(F.lit("SERIES"), number), F.concat(F.lit("S"), number), F.concat(F.lit("SERIES"), roman)))
    plain = F.coalesce(F.try_element_at(table, key), F.when(letter != "", F.array(F.concat(F.lit("SUB"), letter), F.concat(F.lit("PS"), letter))).otherwise(F.array(key)))
    income = F.when(key.isin("INC", "INCOME") & income_as_ps, F.concat(plain, F.array(F.lit("PS")))).otherwise(plain)
    more = lambda v: F.concat(v, F.transform(F.filter(v, lambda k: k.rlike(r"^[A-Z]\d+R$")), lambda k: F.concat(k, F.lit("2"))), F.transform(F.filter(v, lambda k: k.rlike(r"^[A-Z]\d+RL$")), lambda k: F.regexp_replace(k, "RL$", "LR")))
    return F.when(key == "", F.array().cast("array<string>")).when(number != "", F.array_distinct(series)).otherwise(F.array_distinct(let(income, more)))
