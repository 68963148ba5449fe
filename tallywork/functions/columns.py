"""Guards, identifiers, dates and display forms as Columns: no UDF, so they fold into the scan's generated code."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT, TOTAL, MONEY = "decimal(28,10)", "decimal(38,10)", "decimal(18,2)"

#: Check weights of Australian identifiers (fixed values).
ABN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
ABN_MODULUS = 89
TFN_WEIGHTS = (1, 4, 3, 7, 5, 8, 6, 9, 10)
ACN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 1)
MEDICARE_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- guards: a refusal code or null ------------------------------------------------------------------------------------


def accounting_number(raw: Column | str, kind: str = AMOUNT) -> Column:
    """Optional sign, dollar sign and three-digit comma groups; null if the spelling or the size doesn't fit. Exponents are refused."""
    raw = col(raw)
    return F.when(raw.rlike(r"^[+-]?\$?(\d+|\d{1,3}(,\d{3})+)(\.\d+)?$"), F.regexp_replace(raw, r"[$,+]", "").try_cast(kind))


def exact_money(raw: Column | str, places: int = 2, whole: int = 16) -> Column:
    """Non-negative money with at most `places` places and `whole` digits before them, else null."""
    raw = col(raw)
    return F.when(raw.rlike(rf"^\d{{1,{whole}}}(\.\d{{1,{places}}})?$"), raw.try_cast(f"decimal({whole + places},{places})"))


def turnover_bounds(raw: Column | str) -> tuple[Column, Column]:
    """(lower, upper) of a range like `$500k-$1m`, each an amount with a k or m after it; null if the spelling doesn't fit."""
    raw = F.lower(col(raw))
    ok = raw.rlike(r"^\$?\d{1,9}(\.\d{1,4})?[km]-\$?\d{1,9}(\.\d{1,4})?[km]$")

    def bound(i: int) -> Column:
        part = F.translate(F.split(raw, "-", 2)[i], "$", "")
        size = F.regexp_extract(part, r"^[0-9.]+", 0).try_cast("decimal(14,4)")
        return F.when(ok, (size * F.when(part.endswith("k"), 1000).otherwise(1000000)).cast("decimal(20,0)"))

    return bound(0), bound(1)


def iso_date(raw: Column | str) -> Column:
    raw = col(raw)
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))


def long_date(raw: Column | str) -> Column:
    """`30 June 2026`, else null."""
    raw = col(raw)
    return F.when(raw.rlike(r"^\d{1,2} [A-Z][a-z]+ \d{4}$"), F.try_to_date(raw, "d MMMM yyyy"))


def clean_text(raw: Column | str) -> Column:
    """The text if it is trimmed, not empty and free of control and format characters, else null."""
    raw = col(raw)
    return F.when((raw != "") & (F.trim(raw) == raw) & ~raw.rlike(r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"), raw)


def yes_no(raw: Column | str) -> Column:
    return F.when(col(raw) == "yes", F.lit(True)).when(col(raw) == "no", F.lit(False))


def currency_fits(code: Column | str, declared: Column | str) -> Column:
    return F.coalesce(col(code).rlike("^[A-Z]{3}$") & (col(code) == col(declared)), F.lit(False))


def one_side(debit: Column | str, credit: Column | str) -> Column:
    """Exactly one of the two is positive and none is negative."""
    d, c = col(debit), col(credit)
    return F.coalesce(((d > 0) != (c > 0)) & (d >= 0) & (c >= 0), F.lit(False))


# -- identifiers -------------------------------------------------------------------------------------------------------


def _digit(text: Column, i: int) -> Column:
    return F.substring(text, i + 1, 1).try_cast("int")


def _weighted(text: Column, weights: tuple[int, ...], first_less: int = 0) -> Column:
    out = F.lit(0)
    for i, w in enumerate(weights):
        out = out + (_digit(text, i) - (first_less if i == 0 else 0)) * w
    return out


def abn_valid(raw: Column | str, separators: str = " ", leading_zero: bool = True) -> Column:
    """Eleven digits, written with `separators` at most, whose check holds; leading_zero: whether the first digit may be 0."""
    digits = F.translate(col(raw), separators, "")
    shape = digits.rlike(r"^\d{11}$" if leading_zero else r"^[1-9]\d{10}$")
    return F.coalesce(F.when(shape, F.pmod(_weighted(digits, ABN_WEIGHTS, 1), F.lit(ABN_MODULUS)) == 0), F.lit(False))


def tfn_valid(digits: Column | str) -> Column:
    d = col(digits)
    return F.coalesce(F.when(d.rlike(r"^\d{9}$"), _weighted(d, TFN_WEIGHTS) % 11 == 0), F.lit(False))


def acn_valid(digits: Column | str) -> Column:
    d = col(digits)
    return F.coalesce(F.when(d.rlike(r"^\d{9}$"), (10 - _weighted(d, ACN_WEIGHTS) % 10) % 10 == _digit(d, 8)), F.lit(False))


def medicare_valid(digits: Column | str) -> Column:
    d = col(digits)
    return F.coalesce(F.when(d.rlike(r"^[2-6]\d{9,10}$"), _weighted(d, MEDICARE_WEIGHTS) % 10 == _digit(d, 8)), F.lit(False))


def bsb_shape(raw: Column | str) -> Column:
    return F.coalesce(col(raw).rlike(r"^\d{3}[- ]?\d{3}$"), F.lit(False))


def account_parts(raw: Column | str) -> tuple[Column, Column]:
    """(name, code) of `Name (090)` or `090 - Name`; the code holds a digit, else the whole text is the name and the code is null."""
    raw = F.trim(col(raw))
    behind, before = r"^(.*) \(([A-Za-z0-9]{1,10})\)$", r"^([A-Za-z0-9]{1,10}) - (.*)$"
    b, f = F.regexp_extract(raw, behind, 2), F.regexp_extract(raw, before, 1)
    code = F.when(b.rlike(r"\d"), b).when(f.rlike(r"\d"), f)
    return F.when(b.rlike(r"\d"), F.regexp_extract(raw, behind, 1)).when(f.rlike(r"\d"), F.regexp_extract(raw, before, 2)).otherwise(raw), code


# -- dates -------------------------------------------------------------------------------------------------------------


def financial_year(d: Column | str, first_month: int = 7) -> Column:
    """The year in which the date's financial year ends."""
    return F.year(col(d)) + (F.month(col(d)) >= first_month).cast("int") * (1 if first_month > 1 else 0)


def financial_year_start(d: Column | str, first_month: int = 7) -> Column:
    return F.make_date(financial_year(d, first_month) - (1 if first_month > 1 else 0), F.lit(first_month), F.lit(1))


def financial_year_end(d: Column | str, first_month: int = 7) -> Column:
    return F.date_sub(F.add_months(financial_year_start(d, first_month), 12), 1)


def financial_year_label(d: Column | str, first_month: int = 7) -> Column:
    fy = financial_year(d, first_month)
    return F.concat(F.lit("FY"), F.lpad((fy % 100).cast("string"), 2, "0"))


# -- display -----------------------------------------------------------------------------------------------------------


def formula_safe(text: Column | str, numbers: bool = False) -> Column:
    """Text that a spreadsheet doesn't run: an apostrophe before a leading = + - @; numbers: leave plain negative numbers."""
    t = col(text)
    risky = F.ltrim(t).rlike(r"^[=+\-@]")
    return F.when(risky & ~t.rlike(r"^-\d+(\.\d+)?$") if numbers else risky, F.concat(F.lit("'"), t)).otherwise(t)


def money_text(amount: Column | str) -> Column:
    """Canonical decimal text: no exponent, at least two places, nothing rounded."""
    bare = F.regexp_replace(col(amount).cast(TOTAL).cast("string"), r"(\.\d*?)0+$", "$1")
    whole, part = F.regexp_extract(bare, r"^(-?\d+)", 1), F.regexp_extract(bare, r"\.(\d*)$", 1)
    return F.concat(whole, F.lit("."), F.when(F.length(part) < 2, F.rpad(part, 2, "0")).otherwise(part))


def money_display(amount: Column | str) -> Column:
    """Grouped, two places, brackets for negative amounts."""
    text = F.format_number(F.abs(col(amount)), 2)
    return F.when(col(amount) < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def fraction_units(fraction: str) -> int:
    """A fraction of at most one in units of 10^-8; more places are refused, so that products with amounts stay exact."""
    units = Decimal(fraction).scaleb(8)
    if units != int(units):
        raise ValueError(f"a fraction has at most eight places: {fraction}")
    return int(units)


def times(amount: Column, units: int) -> Column:
    """amount x units, exactly: an amount of up to 17 digits before its ten places, and units of up to nine digits."""
    return amount.cast("decimal(27,10)") * F.lit(units).cast("decimal(9,0)")


def percent(current: Column, prior: Column, places: int = 4) -> Column:
    """(current - prior) / |prior| in per cent, half up; null where prior is zero or missing."""
    return F.when(prior != 0, F.round((current - prior) * 100 / F.abs(prior), places))


def listed(names: list[tuple[str, Column]], sep: str = ", ") -> Column:
    """The names whose condition holds, in order, joined."""
    return F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in names]), lambda x: x.isNotNull()), sep)
