"""Numeric, month and publication-date rules as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Publication calendar.
MF_DISCLOSURE_DAYS = 10
FILING_DAYS = 21
QUARTER_END_DAYS = ("03-31", "06-30", "09-30", "12-31")
UNOBSERVED_TEXT = ("", "nan", "None")
MAX_TRADING_GAP_DAYS = 10
MAX_HISTORY_SNAPSHOTS = 25
REPORT_MONTH_PATTERN = r"^\d{4}-(0[1-9]|1[0-2])$"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# -- numbers -------------------------------------------------------------------

def finite(value: Column | str) -> Column:
    """Numeric or unknown: unparsable, NaN and infinite cells become NULL."""
    number = as_col(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def non_negative(value: Column | str) -> Column:
    """finite() that also treats a negative number as unknown."""
    number = finite(value)
    return F.when(number >= 0, number)


def strict_sum(value: Column | str, where: Column | None = None) -> Column:
    """Group sum that is NULL when any contributor (of the rows in ``where``) is NULL."""
    value = as_col(value)
    if where is None:
        return F.when(F.count(F.lit(1)) == F.count(value), F.sum(value))
    kept = F.when(where, value)
    return F.when(F.count_if(where) == F.count(kept), F.sum(kept))


def flag_count(condition: Column) -> Column:
    """count_if as BIGINT, NULL conditions counting as false."""
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


SNAP_OFFSET = 0.3217


def snap(value: Column, places: int) -> Column:
    """Value on a decimal grid; the offset keeps grid edges away from exact halves.

    Sums differ in their last bits with the order of addition, and amounts in
    hundredths divided by share counts often end in an exact half. Snapping
    with this offset gives the same grid value in every engine.
    """
    scale = float(10 ** places)
    return F.floor(value * scale + SNAP_OFFSET).cast("double") / scale


def rounded(df: DataFrame, places: int = 6, **override: int) -> DataFrame:
    """Snap every DOUBLE column; used where results are compared across engines."""
    def one(field):
        if field.dataType.simpleString() != "double":
            return F.col(field.name)
        return snap(F.col(field.name), override.get(field.name, places)).alias(field.name)
    return df.select(*[one(field) for field in df.schema.fields])


# -- months --------------------------------------------------------------------

def is_report_month(month: Column | str) -> Column:
    return as_col(month).rlike(REPORT_MONTH_PATTERN)


def month_start(month: Column | str) -> Column:
    return F.to_date(F.concat(as_col(month), F.lit("-01")), "yyyy-MM-dd")


def month_end(month: Column | str) -> Column:
    return F.last_day(month_start(month))


def shift_month(month: Column | str, by: int) -> Column:
    return F.date_format(F.add_months(month_start(month), by), "yyyy-MM")


def prev_month(month: Column | str) -> Column:
    return shift_month(month, -1)


def next_month(month: Column | str) -> Column:
    return shift_month(month, 1)


def month_index(month: Column | str) -> Column:
    month = as_col(month)
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1


def is_adjacent(previous: Column | str, current: Column | str) -> Column:
    return next_month(previous) == as_col(current)


def month_list(start: str, end: str) -> list[str]:
    """Inclusive months of a history request; at most 25 snapshots."""
    first, last = (int(m[:4]) * 12 + int(m[5:7]) - 1 for m in (start, end))
    if not 0 <= last - first < MAX_HISTORY_SNAPSHOTS:
        raise ValueError("a history covers 1 to 25 ordered months")
    return [f"{n // 12:04d}-{n % 12 + 1:02d}" for n in range(first, last + 1)]


# -- publication dates -----------------------------------------------------------

def mf_deadline(month: Column | str) -> Column:
    return F.date_add(month_end(month), MF_DISCLOSURE_DAYS)


def mf_entry_date(month: Column | str) -> Column:
    return F.date_add(month_end(month), MF_DISCLOSURE_DAYS + 1)


def filing_deadline(quarter_end: Column | str) -> Column:
    return F.date_add(as_col(quarter_end).cast("date"), FILING_DAYS)


def _observed(published_at: Column | str) -> Column:
    text = F.trim(as_col(published_at).cast("string"))
    return F.coalesce(~text.isin(*UNOBSERVED_TEXT), F.lit(False))


def filing_published(quarter_end: Column | str, published_at: Column | str) -> Column:
    """Observed broadcast date when recorded, else the regulatory deadline."""
    day = F.substring(F.trim(as_col(published_at).cast("string")), 1, 10).cast("date")
    return F.when(_observed(published_at), day).otherwise(filing_deadline(quarter_end))


def filing_basis(published_at: Column | str) -> Column:
    return F.when(_observed(published_at), F.lit("observed")).otherwise(F.lit("regulatory_deadline"))


def first_tradable(published: Column | str) -> Column:
    return F.date_add(as_col(published).cast("date"), 1)


def is_quarter_end(day: Column | str) -> Column:
    return F.substring(as_col(day).cast("string"), 6, 5).isin(*QUARTER_END_DAYS)


def filing_type_of(quarter_end: Column | str) -> Column:
    return F.when(is_quarter_end(quarter_end), F.lit("quarterly")).otherwise(F.lit("interim"))


def is_quarterly_filing(quarter_end: Column | str, filing_type: Column | str) -> Column:
    kind = as_col(filing_type)
    return F.coalesce(kind == "quarterly", is_quarter_end(quarter_end))


def shift_quarter(quarter_end: Column | str, by: int) -> Column:
    return F.last_day(F.add_months(as_col(quarter_end), 3 * by))


def decision_date(quarter_end: Column | str, lag_days: int = 30) -> Column:
    return F.date_add(as_col(quarter_end), lag_days)
