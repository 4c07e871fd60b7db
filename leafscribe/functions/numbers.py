"""Number helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column) -> Column:
    """Rounds .5 towards plus infinity, -2.5 gives -2."""
    return F.floor(value + 0.5)


def three_digits(value: Column) -> Column:
    """Three digits, by the exact value of the double: 1.0005, which is a little less, gives 1.000; exact halves go up."""
    size = F.abs(value)
    whole = F.floor(size)
    # Both halves of the fraction are so short that their products with 1000 are exact.
    fraction = size - whole
    high = F.floor(fraction * 2.0**26) / 2.0**26
    thousandths, rest = high * 1000, (fraction - high) * 1000
    up = (thousandths - F.floor(thousandths) - 0.5) + rest >= 0
    total = whole * 1000 + F.floor(thousandths) + up.cast("long")
    sign = F.when((value < 0) & (total > 0), "-").otherwise("")
    digits = F.format_string("%d.%03d", F.floor(total / 1000).cast("long"), F.pmod(total, F.lit(1000)).cast("long"))
    return F.when(size < 1e12, F.concat(sign, digits)).otherwise(F.format_string("%.3f", value))


def plain_number(value: Column) -> Column:
    """Whole doubles without a trailing `.0`."""
    whole = value.cast("long")
    return F.when(
        (F.abs(value) < 1e15) & (whole.cast("double") == value), whole.cast("string")
    ).otherwise(value.cast("string"))


def duration_text(seconds: Column) -> Column:
    """`Xm Ys`, or `Ys` below a minute."""
    minutes = F.floor(seconds / 60)
    rest = seconds - minutes * 60
    tail = F.concat(rest.cast("string"), F.lit("s"))
    return F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), tail)).otherwise(tail)
