"""Month and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of(d) -> Column:
    return F.date_format(d, "yyyy-MM")


def month_start(month_text) -> Column:
    return F.to_date(F.concat(month_text, F.lit("-01")))


def month_ord(month_text) -> Column:
    """Months counted from year 0, so that differences are plain subtraction."""
    return F.substring(month_text, 1, 4).cast("int") * 12 + F.substring(month_text, 6, 2).cast("int") - 1


def month_from_ord(o) -> Column:
    return F.format_string("%04d-%02d", F.floor(o / 12).cast("int"), (o % 12 + 1).cast("int"))


def bucket(d, grain: str) -> Column:
    unit = {"Day": "day", "Month": "month", "Quarter": "quarter", "Year": "year"}[grain]
    return F.to_date(F.date_trunc(unit, d))


def weekdays(start, end) -> Column:
    """Monday-Friday days in [start, end], by arithmetic: no day list is built."""
    def upto(d):
        # days since a Monday (1899-01-02); five per full week plus the rest
        n = F.datediff(d, F.lit("1899-01-02").cast("date")) + 1
        return F.floor(n / 7) * 5 + F.least(n % 7, F.lit(5))
    return (upto(end) - upto(F.date_sub(start, 1))).cast("int")


def month_completion(d) -> Column:
    """Share of the month's weekdays elapsed on date d, in [0, 1]."""
    first = F.trunc(d, "month")
    total = F.greatest(weekdays(first, F.last_day(d)), F.lit(1))
    return F.least(F.lit(1.0), weekdays(first, d) / total)


def month_is_complete(d) -> Column:
    return d >= F.last_day(d)


def completed_cutoff(d, requested_end: Column | None = None) -> Column:
    """Latest complete month of a source that ends on d; an earlier requested end wins."""
    own = F.when(month_is_complete(d), month_of(d)).otherwise(month_of(F.add_months(d, -1)))
    if requested_end is None:
        return own
    req = month_of(requested_end)
    return F.when(req < month_of(d), req).otherwise(own)


def number_date(num: Column) -> Column:
    """Date from a whole number: yyyymmdd, yyyymm, yyyy or a spreadsheet serial. Plain arithmetic, so a number that is none costs little."""
    n = num.cast("bigint")
    part = lambda at, size: (F.floor(n / at) % size).cast("int")                                 # noqa: E731
    day = lambda y, m, d: F.when(m.between(1, 12), F.when(                                       # noqa: E731
        d.between(1, F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1))))), F.make_date(y, m, d)))
    one = F.lit(1)
    return F.when(num.between(1900, 21001232) & (F.abs(num % 1) < 1e-9),
                  F.when(n.between(19000101, 21001231), day(part(10000, 10000), part(100, 100), part(1, 100)))
                  .when(n.between(190001, 210012), day(part(100, 10000), part(1, 100), one))
                  .when(n.between(1900, 2100), F.make_date(n.cast("int"), one, one))
                  .when(n.between(20000, 80000), F.date_add(F.lit("1899-12-30").cast("date"), n.cast("int"))))


def written_date(t: Column) -> Column:
    """Date from trimmed text that is no number."""
    written = F.coalesce(*[
        F.try_to_timestamp(t, F.lit(fmt)).cast("date")
        for fmt in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyy-MM", "MM/dd/yyyy", "M/d/yyyy",
                    "d MMM yyyy", "MMM d, yyyy", "MMM yyyy")
    ])
    return F.when(t.rlike("[0-9]{4}"), F.when(F.year(written).between(1900, 2100), written))         # each form has a year of four digits


def mixed_date(value: Column) -> Column:
    """Date from text that may hold yyyymmdd, yyyymm, yyyy, a spreadsheet serial, or a written date."""
    t = F.trim(value.cast("string"))
    num = t.try_cast("double")
    return F.when(num.isNotNull(), number_date(num)).otherwise(written_date(t))
