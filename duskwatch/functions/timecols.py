"""Time columns: hours, calendar ranges, tolerant date parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import fixed_values as fixed
from duskwatch.functions.predicates import col, moment


def hour_text(ts: str | Column) -> Column:
    """Hour of day as two digits."""
    return F.date_format(col(ts), "HH")


def back_from(as_of, value: Column | int, unit: str | Column) -> Column:
    """``as_of`` minus ``value`` hours, days, weeks of 7 days or calendar months.

    ``value`` and ``unit`` may be columns.
    """
    value = F.lit(value) if isinstance(value, int) else value
    unit = F.lit(unit) if isinstance(unit, str) else unit
    zero = F.lit(0)

    def amount(name: str, factor: int = 1) -> Column:
        return F.when(unit == name, value * factor).otherwise(zero).cast("int")

    step = F.make_interval(
        months=amount("month"),
        weeks=zero,
        days=amount("day") + amount("week", 7),
        hours=amount("hour"),
    )
    return moment(as_of) - step


def calendar_range(phrase: Column, as_of) -> Column:
    """Start and end of 今天, 昨天, 本周, 上周, 本月 or 上个月, weeks from Monday.

    Running periods end at ``as_of``, closed ones at the last second of their last day.
    """
    now = moment(as_of)
    day = F.date_trunc("DAY", now).cast("timestamp_ntz")
    week = F.date_trunc("WEEK", now).cast("timestamp_ntz")
    month = F.date_trunc("MONTH", now).cast("timestamp_ntz")
    second, one_day, one_week = (
        F.expr("INTERVAL '1' SECOND"),
        F.expr("INTERVAL '1' DAY"),
        F.expr("INTERVAL '7' DAY"),
    )
    last_month = F.add_months(month.cast("date"), -1).cast("timestamp_ntz")
    ranges = {
        "今天": (day, day + one_day - second),
        "昨天": (day - one_day, day - second),
        "本周": (week, now),
        "上周": (week - one_week, week - second),
        "本月": (month, now),
        "上个月": (last_month, month - second),
    }
    out = None
    for name, (start, end) in ranges.items():
        pair = F.struct(start.alias("start"), end.alias("end"))
        out = F.when(phrase == name, pair) if out is None else out.when(phrase == name, pair)
    return out


def parse_date(text: str | Column, default_year: int = 1900) -> Column:
    """First of the ten accepted date formats that parses, else null."""
    text = F.trim(col(text))
    ntz = [
        F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz") for fmt in fixed.DATE_FORMATS
    ]
    yearless = F.try_to_timestamp(
        F.concat(F.lit(f"{default_year}年"), text), F.lit("yyyy年" + fixed.YEARLESS_DATE_FORMAT)
    ).cast("timestamp_ntz")
    return F.coalesce(*ntz, yearless)


def micros(rows: DataFrame, ts: str) -> Column:
    """Microseconds since 1970, without regard to the session zone for zone-free times."""
    column = F.col(ts)
    if rows.schema[ts].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(column.cast("timestamp"))
    since_epoch = column - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    days, hours, minutes, seconds = (
        F.extract(F.lit(unit), since_epoch) for unit in ("DAY", "HOUR", "MINUTE", "SECOND")
    )
    whole_minutes = (days.cast("long") * 24 + hours) * 60 + minutes
    return whole_minutes * 60_000_000 + (seconds * 1_000_000).cast("long")


def as_instant(rows: DataFrame, ts: str) -> Column:
    """A zone-free time read as UTC, as the TIMESTAMP that streams need."""
    column = F.col(ts)
    if rows.schema[ts].dataType.typeName() != "timestamp_ntz":
        return column.cast("timestamp")
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), column).cast("timestamp")


def as_wall_clock(ts: str | Column) -> Column:
    """The UTC wall clock of a TIMESTAMP."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col(ts).cast("timestamp_ntz"))
