"""Numbers, units and periods of reported values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that scale a number, in order of size.
SCALES = {
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "crs": 1e7,
    "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5,
    "million": 1e6, "millions": 1e6, "mn": 1e6, "m": 1e6,
    "billion": 1e9, "billions": 1e9, "bn": 1e9, "b": 1e9,
    "trillion": 1e12, "trillions": 1e12, "tn": 1e12,
    "thousand": 1e3, "thousands": 1e3, "k": 1e3,
}
# Unit patterns; the first that matches names the unit.
UNITS = [
    (r"\b(rs\.?|rupees?|inr)\b|[₹]", "INR"),
    (r"\b(usd|dollars?)\b|[\$]", "USD"),
    (r"\b(eur|euros?)\b|[€]", "EUR"),
    (r"\b(gbp|pounds?)\b|[£]", "GBP"),
    (r"\b(percent|percentage|per\s*cent)\b|[%]", "PERCENT"),
    (r"\b(bps|basis\s*points?)\b", "BPS"),
    (r"\b(days?|nwc\s*days?)\b", "DAYS"),
    (r"\b(hours?|hrs?)\b", "HOURS"),
    (r"\b(months?|mos?)\b", "MONTHS"),
    (r"\b(years?|yrs?)\b", "YEARS"),
    (r"\b(metric\s*tons?|tonnes?|tons?)\b", "METRIC_TON"),
    (r"\b(kg|kilograms?)\b", "KILOGRAM"),
    (r"\b(shares?|equity\s*shares?)\b", "SHARES"),
    (r"\b(parcels?|packages?|shipments?)\b", "PARCELS"),
]
# What a value's text is searched for.
PARENTHESIS = r"\([^)]*\d+[^)]*\)"
CURRENCY_WORDS = r"[₹\$€£]|Rs\.?|INR|USD|EUR"
NUMBER = r"[-+]?\d{1,3}(?:,\d{2,3})*(?:\.\d+)?|\d+(?:\.\d+)?"
# What a period's text is searched for, the first that matches decides (a date needs the names of the months).
QUARTER = r"(?i)\bQ([1-4])\s*(?:FY)?\s*(\d{2,4})\b"
TWO_YEARS = r"(?i)(?:FY\s*)?(\d{4})[-/](\d{2,4})"
FISCAL_YEAR = r"(?i)\bFY\s*(\d{2,4})\b"
DATE = r"(?i)(%s)\s+(\d{1,2}),?\s*(\d{4})"
CALENDAR_YEAR = r"(?i)\b(?:CY\s*)?(\d{4})\b"
# White space of any kind, as (?U)\s has it.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MONTHS = "january february march april may june july august september october november december".split()


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(BLANKS))


def nonblank(text: Column) -> Column:
    """Null instead of an empty text."""
    return F.when(text != "", text)


def parse_number(text: Column) -> tuple[Column, Column]:
    """(value, is_negative): a parenthesis with a digit or a leading minus makes a number negative;
    of parentheses only the first is read. Null and empty texts give null and false."""
    t = strip(F.coalesce(text, F.lit("")))
    bracket = t.rlike(PARENTHESIS)
    minus = ~bracket & t.rlike("^[-−]")
    body = F.when(bracket, F.regexp_extract(t, r"\(([^)]+)\)", 1)).when(minus, strip(F.substring(t, 2, 1 << 30))).otherwise(t)
    found = F.regexp_substr(strip(F.regexp_replace(body, f"(?i){CURRENCY_WORDS}", "")), F.lit(NUMBER))
    value = F.regexp_replace(found, ",", "").try_cast("double")
    negative = bracket | minus
    return F.when(negative, 0.0 - F.abs(value)).otherwise(value), negative


def scale_multiplier(text: Column) -> Column:
    """The factor of the first scale word; compounds such as lakh crore go first; 1 without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    table = F.create_map(*[x for k, v in SCALES.items() for x in (F.lit(k), F.lit(v))])
    words = F.filter(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), lambda w: w.isin(*SCALES))
    return (
        F.when(low.rlike(r"\b(lakh|lac|lakhs|lacs)\s*(crore|crores|cr|crs)\b"), 1e12)
        .when(low.rlike(r"\b(thousand|thousands|k)\s*(crore|crores|cr|crs)\b"), 1e10)
        .otherwise(F.coalesce(F.try_element_at(table, F.try_element_at(words, F.lit(1))), F.lit(1.0)))
    )


def scalar_and_factor(value: Column, raw: Column, unit: Column) -> tuple[Column, Column]:
    """The given value, else the parsed one, with the text's sign; and its scale."""
    parsed, negative = parse_number(raw)
    scalar = F.when(value.isNull(), parsed).when((value > 0) & negative, -value).otherwise(value).cast("double")
    return scalar, scale_multiplier(F.concat(F.coalesce(unit, F.lit("")), F.lit(" "), F.coalesce(raw, F.lit(""))))


def scaled(scalar: Column, factor: Column) -> Column:
    """Scaled only below 1e9."""
    return F.when((factor > 1) & (F.abs(scalar) < 1e9), scalar * factor).otherwise(scalar)


def normalize_number(value: Column, raw: Column, unit: Column) -> Column:
    """The given value, else the parsed one, with the text's sign and scale; scaled only below 1e9."""
    return scaled(*scalar_and_factor(value, raw, unit))


def normalize_unit(unit: Column, raw: Column) -> Column:
    """The canonical unit of the first pattern found, else the unit in capitals, else null."""
    both = strip(F.concat(F.coalesce(unit, F.lit("")), F.lit(" "), F.coalesce(raw, F.lit(""))))
    out = F.when(both == "", F.lit(None).cast("string"))
    for pattern, name in UNITS:
        out = out.when(both.rlike(f"(?iu)({pattern})"), name)
    return out.otherwise(nonblank(F.upper(strip(F.regexp_replace(F.coalesce(unit, F.lit("")), "[^A-Za-z0-9_ ]", "")))))


def _year(text: Column) -> Column:
    n = text.try_cast("int")
    return F.when(n < 70, n + 2000).when(n < 100, n + 1900).otherwise(n)


def _day(year: Column, month: Column | int, day: Column | int) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    digits = lambda x, n: F.lpad(as_col(x).cast("string"), n, "0")
    return F.try_to_date(F.concat_ws("-", digits(year, 4), digits(month, 2), digits(day, 2)), "yyyy-MM-dd")


def normalize_period(text: Column) -> tuple[Column, Column]:
    """(start, end) of `period_of`."""
    found = period_of(text)
    return found["start"], found["end"]


def period_of(text: Column) -> Column:
    """struct<start, end> of a quarter, a fiscal year (April to March), a date or a calendar year; the first
    rule that matches decides. Dates that do not exist are null."""
    t = strip(F.coalesce(text, F.lit("")))
    quarter, hyphen, single, day, calendar = QUARTER, TWO_YEARS, FISCAL_YEAR, DATE % "|".join(MONTHS), CALENDAR_YEAR
    group = lambda p, i: F.regexp_extract(t, p, i)
    q, qy = group(quarter, 1).try_cast("int"), _year(group(quarter, 2))
    hy, he = group(hyphen, 1).try_cast("int"), _year(group(hyphen, 2))
    sy = _year(group(single, 1))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(group(day, 1))).cast("int")
    exact = _day(group(day, 3).try_cast("int"), month, group(day, 2).try_cast("int"))
    cy = group(calendar, 1).try_cast("int")
    in_next = q == 4
    both = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    return (
        F.when(t.rlike(quarter), both(F.when(in_next, _day(qy, 1, 1)).otherwise(_day(qy - 1, q * 3 + 1, 1)), F.last_day(F.when(in_next, _day(qy, 3, 1)).otherwise(_day(qy - 1, q * 3 + 3, 1)))))
        .when(t.rlike(hyphen), both(_day(hy, 4, 1), _day(he, 3, 31))).when(t.rlike(single), both(_day(sy - 1, 4, 1), _day(sy, 3, 31)))
        .when(t.rlike(day), both(exact, exact)).when(t.rlike(calendar), both(_day(cy, 1, 1), _day(cy, 12, 31)))
    )
