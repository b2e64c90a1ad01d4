"""Column expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = "decimal(28,6)"


def month_start(when: Column) -> Column:
    """The first of the month, as a date.

    ``date_trunc`` would turn a ``timestamp_ntz`` into an instant of the session
    time zone. Cast the date to ``timestamp_ntz`` only after grouping by it: done
    row by row, that cast is a quarter of the time of the whole query.
    """
    return F.trunc(when.cast("date"), "month")


def exact_units(quantity: Column) -> Column:
    """A quantity as a decimal of up to 22 whole digits and 6 places, so sums are exact in any order.

    Further places are rounded half up. Nulls stay null; NaN, infinities and quantities of more
    digits have no decimal and count as null, so that one of them does not end a job or a stream.
    """
    return quantity.try_cast(UNITS)
