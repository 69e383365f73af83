"""Column expressions that many operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text of a figure that cannot be given.
NOT_AVAILABLE = "DATA_NOT_AVAILABLE"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r(x: Column, n: int) -> Column:
    """Rounded by its decimal digits, first to five more places, so that engines agree on ties."""
    return F.round(F.round(x.cast("decimal(30,12)"), n + 5), n).cast("double")


def clean_label(label: Column | str, mode: str = "statement") -> Column:
    """Plain spaces, trimmed; one trailing plus goes in statements, all of them in lookups."""
    out = F.trim(F.regexp_replace(col(label), "\u00a0", " "))
    plus = r"\+$" if mode == "statement" else r"\++$"
    if mode == "archive":
        out = F.regexp_replace(out, r"\s+%", "%")
    return F.trim(F.regexp_replace(out, plus, ""))


def to_number(raw: Column | str, variant: str = "statement") -> Column:
    """A figure from a cell. statement: commas, percent, x and rupee signs go; quarterly keeps x;
    archive turns what is missing or bad into 0."""
    strip = r"[,%₹\u00a0 ]" if variant == "quarterly" else r"[,%x₹\u00a0 ]"
    text = F.trim(F.regexp_replace(col(raw), strip, ""))
    value = F.when(F.lower(text).isin("", "-", "nan", "inf", "+inf", "-inf", "infinity"), None).otherwise(text).try_cast("double")
    return F.coalesce(value, F.lit(0.0)) if variant == "archive" else value


def first_match(text: Column | str, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The result of the first keyword that the lower-cased text holds."""
    low = F.lower(col(text))
    out = reduce(lambda acc, rule: acc.when(low.contains(rule[0].lower()), F.lit(rule[1])), rules[1:], F.when(low.contains(rules[0][0].lower()), F.lit(rules[0][1])))
    return out.otherwise(F.lit(default))


def count_of(text: Column, phrase: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def safe_ratio(num: Column, den: Column, n: int = 4) -> Column:
    """num / den to n places; null where either is null or the denominator is 0."""
    return r(F.try_divide(num, F.nullif(den, F.lit(0.0))), n)


def gap(num: Column, den: Column, metric: str, year: Column, num_name: str, den_name: str) -> Column:
    """Why a ratio was refused: (metric, reason, year, action), null if it was not."""
    reason = F.when(num.isNull(), F.lit(f"{num_name} is null")).when(den.isNull(), F.lit(f"{den_name} is null")).when(den == 0, F.lit(f"{den_name} is zero"))
    return F.when(reason.isNotNull(), F.struct(F.lit(metric).alias("metric"), reason.alias("reason"), year.cast("string").alias("year"), F.lit("SKIP").alias("action")))
