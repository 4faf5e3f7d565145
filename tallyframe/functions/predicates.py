"""The tests behind the data-quality rules, as Column functions over typed amounts.

Tolerances differ from rule to rule and are part of each rule. Every test is
false, not null, where an amount that it needs is missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.scalars import close, parse_number


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def nothing(c: Column) -> Column:
    """Null or next to zero."""
    return F.coalesce(F.abs(c) <= 1e-9, F.lit(True))


def balance_is_off(beginning: Column, principal: Column, deferred: Column, ending: Column, principal_payable: Column) -> Column:
    """Ending is not beginning + deferred - principal, and no principal is still payable."""
    expected = beginning + F.coalesce(deferred, F.lit(0.0)) - F.coalesce(principal, F.lit(0.0))
    owed = F.abs(F.coalesce(principal_payable, F.lit(0.0))) > 0.02
    return _sure(~owed & ~close(ending, expected, 0.02, 1e-9))


def principal_looks_like_balance(beginning: Column, principal: Column, ending: Column) -> Column:
    """A flat balance beside a principal payment that equals it, or that is a factor per thousand."""
    flat = close(beginning, ending, 0.02, 1e-9)
    equals = close(principal, beginning, 1.0, 1e-8) | close(principal, ending, 1.0, 1e-8)
    factor = F.abs(principal).between(100, 5000) & (F.greatest(F.abs(beginning), F.abs(ending)) >= 1e6)
    return _sure((F.abs(principal) > 0.02) & flat & (equals | factor))


def pair_differs(a: Column, b: Column) -> Column:
    """Two views of one balance differ."""
    return _sure(~close(a, b, 0.02, 1e-8))


def paid_is_available(paid: Column, available: Column) -> Column:
    return _sure((paid > 0) & (F.abs(paid - available) <= 0.01))


def due_taken_for_paid(paid: Column, payable: Column, unpaid: Column) -> Column:
    return _sure((paid > 0) & (F.abs(paid - payable) <= 0.01) & (unpaid > 0.01))


def negative(c: Column) -> Column:
    return _sure(c < -1e-6)


def only_original(original: Column, *others: Column) -> Column:
    """An original balance and nothing else."""
    out = ~nothing(original)
    for c in others:
        out = out & nothing(c)
    return out


def zero_interest_paid(payment: Column, estimate: Column) -> Column:
    """No interest payment where the source shows at least a thousand."""
    return F.coalesce(F.abs(payment) <= 1e-6, F.lit(True)) & _sure(estimate >= 1000)


def sums_match(paid: Column, current: Column) -> Column:
    """Column sums that agree though they should not (above a million)."""
    return _sure((current > 1e6) & close(paid, current, 100.0, 1e-6))


def total_payment_off(total: Column, principal: Column, interest: Column) -> Column:
    """Total payment is not principal plus interest."""
    return _sure(~close(total, F.coalesce(principal, F.lit(0.0)) + F.coalesce(interest, F.lit(0.0)), 0.02, 1e-8))


def suggested_paydown(principal: Column, beginning: Column, ending: Column, cash: Column) -> Column:
    """Waterfall cash as principal payment of a class that ends at zero without one; else null."""
    return F.when(nothing(principal) & (beginning > 0) & (F.abs(ending) <= 0.02) & close(cash, beginning, 0.02, 1e-8), cash)


def subordinated_principal(dividend: Column, beginning: Column, ending: Column) -> Column:
    """Principal of a subordinated class without dividend whose balance fell; else null."""
    return F.when(nothing(dividend) & (ending < beginning), beginning - ending)


def interest_from_dividend(interest: Column, dividend: Column) -> Column:
    return F.when(nothing(interest) & ~nothing(dividend), dividend).otherwise(interest)


def severity_of_change(old: Column, new: Column, high: float, critical: float | None = None) -> Column:
    """Severity of a numeric change by percent of the old value (100 % of zero); a missing side is HIGH."""
    diff = F.abs(new - old)
    percent = F.when(old == 0, 100.0).otherwise(diff / F.nullif(F.abs(old), F.lit(0.0)) * 100.0)
    out = F.when(old.isNull() & new.isNull(), "NO CHANGE").when(old.isNull() | new.isNull(), "HIGH").when(diff <= 0.01, "NO CHANGE")
    if critical is not None:
        out = out.when(percent > critical, "CRITICAL")
    return out.when(percent > high, "HIGH").otherwise("LOW")


def amount_difference(extracted: Column, stored: Column, tolerance: float = 0.01, rate: bool = False) -> Column:
    """"match", a signed difference, or empty where a side is missing.

    A missing side matches a zero. Rates of different scale (below and above
    1.5) are brought to percent first.
    """
    e, d = extracted, stored
    if rate:
        tolerance = max(tolerance, 0.001)
        e2 = F.when((F.abs(e) < 1.5) & (F.abs(d) > 1.5), e * 100.0).otherwise(e)
        d2 = F.when((F.abs(d) < 1.5) & (F.abs(e) > 1.5), d * 100.0).otherwise(d)
        delta = e2 - d2
    else:
        delta = e - d
    sign = F.when(delta < 0, "-").otherwise("+")
    places = lambda n: F.concat(sign, F.replace(F.format_number(F.abs(delta), n), F.lit(","), F.lit("")))
    lone = (e.isNull() & (F.abs(d) <= tolerance)) | (d.isNull() & (F.abs(e) <= tolerance))
    return F.when(_sure(lone), "match").when(e.isNull() | d.isNull(), "").when(F.abs(delta) <= tolerance, "match").when(F.abs(delta) < 1, places(4)).otherwise(places(2))


def number_cell(row: Column, place: Column) -> Column:
    """Amount in a cell; null where the column is missing."""
    from tallyframe.functions.tables import cell

    return parse_number(cell(row, place))
