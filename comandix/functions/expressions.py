"""Column expressions: dates, money, labels, result codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comandix import model


def money(column: Column | str, precision: int = 12) -> Column:
    """Cents as an exact decimal."""
    return _col(column).cast(T.DecimalType(precision, 2))


def total(column: Column | str) -> Column:
    """Sum of an exact decimal, in one result type on every engine."""
    return F.sum(_col(column)).cast(T.DecimalType(18, 2))


def hour_of(ts: Column | str) -> Column:
    return F.hour(_col(ts)).cast("int")


def day_of(ts: Column | str) -> Column:
    return F.to_date(_col(ts))


def day_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd")


def day_label(ts: Column | str) -> Column:
    """Day such as 2019-Nov-13."""
    return F.date_format(_col(ts), "yyyy-MMM-dd")


def parse_day_label(text: Column | str) -> Column:
    return F.to_date(_col(text), "yyyy-MMM-dd")


def clock_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "HH:mm")


def within_days(ts: Column | str, first: Column | str, last: Column | str, inclusive_end: bool = False) -> Column:
    """Instants from ``first`` to ``last``, both dates at midnight.

    As stored reports do it, the last day ends at its own midnight; ``inclusive_end`` takes the
    whole last day. Both forms are plain ranges on the column, so they reach the scan.
    """
    ts = _col(ts)
    low, high = _midnight(first), _midnight(last)
    if inclusive_end:
        return (ts >= low) & (ts < high + F.expr("INTERVAL 1 DAY"))
    return (ts >= low) & (ts <= high)


def on_day(ts: Column | str, day: Column | str) -> Column:
    """Instants of one calendar day, as a range."""
    return within_days(ts, day, day, inclusive_end=True)


def stock_status(on_hand: Column | str, minimum: Column | str) -> Column:
    """Traffic light of a level; red wins when the level and the minimum are both zero."""
    on_hand, minimum = _col(on_hand), _col(minimum)
    return (
        F.when(on_hand <= minimum, model.RED)
        .when(on_hand < minimum * F.lit("1.3").cast("decimal(2,1)"), model.AMBER)
        .otherwise(model.GREEN)
    )


def direction(amount: Column | str) -> Column:
    """IN for money received, OUT for money paid, NULL for nothing."""
    amount = _col(amount)
    return F.when(amount > 0, "IN").when(amount < 0, "OUT")


def fixed2(amount: Column | str) -> Column:
    return F.format_number(_col(amount), 2)


def to_number(text: Column | str, precision: int = 12) -> Column:
    """Text to decimal; text that is no number becomes NULL."""
    return _col(text).try_cast(f"decimal({precision},2)")


def table_label(table_no: Column | str) -> Column:
    return F.coalesce(F.concat(F.lit("Mesa "), _col(table_no).cast("string")), F.lit(model.TAKE_AWAY_TEXT))


def payment_text(table_no: Column | str) -> Column:
    """Note of a table payment; NULL for no table."""
    return F.concat(F.lit(model.TABLE_PAYMENT_TEXT), _col(table_no).cast("string"))


def message_for(kind: str, code: Column | str) -> Column:
    """Message of a result code."""
    pairs = [F.lit(item) for pair in model.MESSAGES[kind].items() for item in pair]
    return F.create_map(*pairs)[_col(code)]


def first_failure(*checks: tuple[Column, int]) -> Column:
    """Code of the first check that holds, 1 when none does. A NULL check counts as not holding."""
    chain = F
    for failed, code in checks:
        chain = chain.when(F.coalesce(failed, F.lit(False)), code)
    return chain.otherwise(1).cast("int")


def clean_strings(df: DataFrame) -> DataFrame:
    """Trim white space of every text column and turn empty text into NULL."""
    blanks = F.lit(" \t\n\r\0\x0b")
    return df.select(
        *[
            F.nullif(F.trim(F.col(f.name), blanks), F.lit("")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def hide_sensitive(df: DataFrame) -> DataFrame:
    return df.drop(*model.SENSITIVE_COLUMNS)


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _midnight(day: Column | str) -> Column:
    day = F.lit(day) if isinstance(day, str) else day
    return day.cast("date").cast("timestamp_ntz")
