"""The fiscal calendar as column expressions. Fiscal years start in April unless told otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import col

#: Month names as they stand in labels.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
MONTH_WORDS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"


def _yy(year: Column) -> Column:
    return F.lpad(F.pmod(year, F.lit(100)).cast("string"), 2, "0")


def month_number(name: Column) -> Column:
    """1 to 12 from a month's name, else null."""
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(F.substring(name, 1, 3)))
    return F.when(at > 0, at.cast("int"))


def fiscal_year(date: Column, start_month: int = 4) -> Column:
    return F.year(date) + F.when(F.month(date) >= start_month, 1).otherwise(0) if start_month > 1 else F.year(date)


def fiscal_quarter(date: Column, start_month: int = 4) -> Column:
    return F.floor(F.pmod(F.month(date) - start_month, F.lit(12)) / 3).cast("int") + 1


def fiscal_period(date: Column | str, annual: bool, start_month: int = 4) -> Column:
    """FYyy or Qn_FYyy."""
    d = col(date)
    year = F.concat(F.lit("FY"), _yy(fiscal_year(d, start_month)))
    return year if annual else F.concat(F.lit("Q"), fiscal_quarter(d, start_month).cast("string"), F.lit("_"), year)


def calendar_period(date: Column | str, annual: bool) -> Column:
    """CYyy or Qn_CYyy."""
    d = col(date)
    year = F.concat(F.lit("CY"), _yy(F.year(d)))
    return year if annual else F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit("_"), year)


def fiscal_window(period: Column | str, lookback: int = 1) -> Column:
    """The recent fiscal years of a period label; calendar years span two fiscal ones; else null."""
    p = col(period)
    fy = F.regexp_extract(p, r"FY(\d{2})", 1)
    cy = F.regexp_extract(p, r"CY(\d{2})", 1)
    label = lambda y: F.concat(F.lit("FY"), _yy(y))
    down = lambda top, n: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: label(top.try_cast("int") - i))
    return F.when(fy != "", down(fy, lookback)).when(cy != "", down((cy.try_cast("int") + 1).cast("string"), lookback + 1))


def fiscal_years_spanned(start: Column | str, end: Column | str) -> Column:
    """All FY labels from one date to a later one, in order; none if the dates are reversed."""
    a, b = fiscal_year(col(start)), fiscal_year(col(end))
    none = F.array().cast("array<string>")
    return F.when(b >= a, F.transform(F.sequence(a, F.greatest(a, b)), lambda y: F.concat(F.lit("FY"), _yy(y)))).otherwise(none)


def _full_year(text: Column) -> Column:
    y = text.try_cast("int")
    return F.when(y < 100, 2000 + y).otherwise(y)


def financial_yyyymm(text: Column | str) -> Column:
    """A sortable month from a loose date: fiscal year and quarter, month and year, or a year; else 0."""
    t = F.regexp_replace(F.upper(col(text)), " ", "")
    fy, q = F.regexp_extract(t, r"FY(\d{2,4})", 1), F.regexp_extract(t, r"Q([1-4])", 1)
    y = _full_year(fy)
    by_quarter = F.when(q == "1", (y - 1) * 100 + 6).when(q == "2", (y - 1) * 100 + 9).when(q == "3", (y - 1) * 100 + 12).otherwise(y * 100 + 3)
    named = [F.when((part := F.regexp_extract(t, rf"{m}[^0-9]*(\d{{2,4}})", 1)) != "", _full_year(part) * 100 + k + 1) for k, m in enumerate(MONTHS)]
    bare = F.regexp_extract(t, r"(20\d{2})", 1)
    return F.coalesce(F.when(fy != "", by_quarter), *named, F.when(bare != "", bare.try_cast("int") * 100 + 12), F.lit(0)).cast("int")


def chronology_ok(cause: Column | str, effect: Column | str) -> Column:
    """Whether the cause is no later than the effect; what is empty, N/A or unreadable passes."""
    c, e = F.coalesce(col(cause), F.lit("")), F.coalesce(col(effect), F.lit(""))
    a, b = financial_yyyymm(c), financial_yyyymm(e)
    return F.upper(c).isin("", "N/A") | F.upper(e).isin("", "N/A") | (a == 0) | (b == 0) | (a <= b)


def fy_to_column(label: Column | str) -> Column:
    """FY24 -> Mar 2024."""
    yy = F.regexp_extract(col(label), r"FY(\d{2})", 1)
    return F.when(yy != "", F.concat(F.lit("Mar 20"), yy))


def quarter_key(label: Column | str) -> Column:
    """Sort key of a quarter label such as Mar 2024: unreadable ones first, then by date, then by text."""
    d = F.try_to_timestamp(col(label), F.lit("MMM yyyy")).cast("date")
    return F.struct(d.isNotNull().cast("int").alias("known"), d.alias("d"), col(label).alias("label"))


def quarter_end(fy: Column, q: Column) -> Column:
    """Last day of a fiscal quarter."""
    month = F.when(q == 4, 3).otherwise(q * 3 + 3)
    return F.last_day(F.make_date(F.when(q == 4, fy).otherwise(fy - 1), month, F.lit(1)))


def fiscal_quarter_of(text: Column | str) -> Column:
    """(q, fy) from `Q3 FY26`, `Q3FY26` or `FY26 Q3`; the last digits of a range of years win; else null."""
    t = F.upper(col(text))
    tail = lambda a, b: F.when(b != "", b).otherwise(a)
    p1, p2 = r"Q([1-4])[\s_-]*FY\s*(\d{2,4})(?:\s*[-/]\s*(\d{2,4}))?", r"FY\s*(\d{2,4})(?:\s*[-/]\s*(\d{2,4}))?[\s_-]*Q([1-4])"
    g = lambda p, k: F.regexp_extract(t, p, k)
    make = lambda q, y: F.struct(q.try_cast("int").alias("q"), _full_year(y).alias("fy"))
    return F.when(g(p1, 1) != "", make(g(p1, 1), tail(g(p1, 2), g(p1, 3)))).when(g(p2, 3) != "", make(g(p2, 3), tail(g(p2, 1), g(p2, 2))))


def published_date(text: Column | str) -> Column:
    """ISO, d-m-y, `d Mon y`, `Mon y` (its last day) or a fiscal quarter's end; else null."""
    t = col(text)
    iso = F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1)
    dmy = F.regexp_extract(t, r"(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})", 1)
    day = F.regexp_extract(t, rf"(?i)(\d{{1,2}})\s+(?:{MONTH_WORDS})[\s,]+\d{{4}}", 1)
    name = F.regexp_extract(t, rf"(?i)({MONTH_WORDS})[\s,'-]+\d{{4}}", 1)
    year = F.regexp_extract(t, rf"(?i)(?:{MONTH_WORDS})[\s,'-]+(\d{{4}})", 1).try_cast("int")
    first = F.make_date(year, month_number(name), F.lit(1))
    q = fiscal_quarter_of(t)
    return F.coalesce(
        F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-MM-dd")).cast("date"),
        F.try_to_timestamp(F.nullif(F.regexp_replace(dmy, "[/.]", "-"), F.lit("")), F.lit("d-M-yyyy")).cast("date"),
        F.when(day != "", F.date_add(first, F.least(day.try_cast("int"), F.dayofmonth(F.last_day(first))) - 1)),
        F.last_day(first),
        quarter_end(q["fy"], q["q"]),
    )


def stamp_period(file_name: Column | str, head: Column | str) -> Column:
    """Seven rules in order over a file name and the first 3000 letters of its text.

    (fiscal_year, fiscal_quarter, fiscal_period, calendar_year, calendar_month, rule, confidence).
    """
    name, text = F.coalesce(col(file_name), F.lit("")), F.regexp_replace(F.substring(F.coalesce(col(head), F.lit("")), 1, 3000), "\u00a0", " ")

    def stamp(found: Column, rule: str, confidence: str, fy: Column, q: Column | None, year: Column, month: Column) -> Column:
        label = F.concat(F.lit("FY"), _yy(fy))
        quarter = F.lit("") if q is None else F.concat(F.lit("Q"), q.cast("string"))
        period = label if q is None else F.concat(quarter, F.lit("_"), label)
        parts = [label.alias("fiscal_year"), quarter.alias("fiscal_quarter"), period.alias("fiscal_period"), year.cast("int").alias("calendar_year"), month.cast("int").alias("calendar_month"), F.lit(rule).alias("rule"), F.lit(confidence).alias("confidence")]
        return F.when(found, F.struct(*parts))

    def dated(source: Column, pattern: str) -> tuple[Column, Column, Column]:
        month, year = month_number(F.regexp_extract(source, pattern, 1)), F.regexp_extract(source, pattern, 2).try_cast("int")
        return month, year, month.isNotNull() & year.isNotNull()

    by_month = lambda y, m: y + F.when(m >= 4, 1).otherwise(0)
    by_quarter = lambda m: F.floor(F.pmod(m - 4, F.lit(12)) / 3).cast("int") + 1
    m1, y1, ok1 = dated(text, rf"(?i)(?:quarter|period)\s+ended\s+({MONTH_WORDS})\s+\d{{1,2}}\s*,?\s*(\d{{4}})")
    m2, y2, ok2 = dated(text, rf"(?i)year\s+ended\s+({MONTH_WORDS})\s+\d{{1,2}}\s*,?\s*(\d{{4}})")
    p3 = r"(?i)Q([1-4])\s*[_\s-]*FY\s*(\d{2,4})"
    q3, y3 = F.regexp_extract(name, p3, 1).try_cast("int"), _full_year(F.regexp_extract(name, p3, 2))
    y4 = _full_year(F.regexp_extract(name, r"(?i)(?:FY|Financial[_\s]Year)[_\s]*(\d{2,4})", 1))
    q5, y5 = F.regexp_extract(name, r"(?i)Q([1-4])[_\s-]+(\d{4})", 1).try_cast("int"), F.regexp_extract(name, r"(?i)Q([1-4])[_\s-]+(\d{4})", 2).try_cast("int")
    m6, y6, ok6 = dated(name, rf"(?i)({MONTH_WORDS})[_\s-]*(\d{{4}})")
    y7 = F.regexp_extract(name, r"(20\d{2})", 1).try_cast("int")
    none = F.lit(None).cast("int")
    return F.coalesce(
        stamp(ok1, "content_quarter_ended", "high", by_month(y1, m1), by_quarter(m1), y1, m1),
        stamp(ok2, "content_year_ended", "high", by_month(y2, m2), None, y2, m2),
        stamp(q3.isNotNull() & y3.isNotNull(), "filename_q_fy", "high", y3, q3, F.when(q3 == 4, y3).otherwise(y3 - 1), F.when(q3 == 4, 3).otherwise(q3 * 3 + 3)),
        stamp(y4.isNotNull(), "filename_fy", "high", y4, None, y4 - 1, F.lit(3)),
        stamp(q5.isNotNull() & y5.isNotNull(), "filename_q_year", "medium", by_month(y5, q5 * 3), by_quarter(q5 * 3), y5, q5 * 3),
        stamp(ok6, "filename_month_year", "medium", by_month(y6, m6), by_quarter(m6), y6, m6),
        stamp(y7.isNotNull(), "filename_year", "low", y7, None, y7, none),
        F.struct(F.lit("").alias("fiscal_year"), F.lit("").alias("fiscal_quarter"), F.lit("UNKNOWN").alias("fiscal_period"), none.alias("calendar_year"), none.alias("calendar_month"), F.lit("none").alias("rule"), F.lit("none").alias("confidence")),
    )
