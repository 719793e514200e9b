"""Dates in the formats the sources use."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from hedgerow.rules import documents as D
from hedgerow.rules import policies as P


def parse_date(text: Column) -> Column:
    """First layout that fits; null where none does."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_date(trimmed, layout) for layout in D.DATE_LAYOUTS])


def date_to_int(day: Column) -> Column:
    """YYYYMMDD, an open end is 99991231."""
    number = F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)
    return F.coalesce(number, F.lit(P.OPEN_END))


def int_to_date(number: Column) -> Column:
    day = F.make_date(F.floor(number / 10000).cast("int"),
                      F.floor(number % 10000 / 100).cast("int"),
                      (number % 100).cast("int"))
    return F.when(number != P.OPEN_END, day)


def in_force(day: Column, start: Column, end: Column) -> Column:
    """Closed interval; an end of null never passes."""
    return (start <= day) & (end.isNull() | (end >= day))
