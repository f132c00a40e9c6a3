"""Numbers out of text: fixed point, so that sums are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType, StringType

# What figures are read as, and money is summed as.
WIDE = "decimal(38,8)"
# Two figures of this type have an exact product in ``WIDE``.
AMOUNT = "decimal(18,4)"


def _or_error(number: Column, source: Column, message: Column) -> Column:
    """``number``; where it is null and its source is not, the query fails whatever the ANSI setting."""
    return F.coalesce(number, F.when(source.isNotNull(), F.raise_error(message).cast(WIDE)))


#: Digits of whole numbers by type.
_INTEGERS = {"byte": 3, "short": 5, "integer": 10, "long": 19}


def _fits(kind: DataType, digits: int, decimals: int) -> bool:
    """Whether all values of a type have at most so many digits before the point and decimals."""
    if isinstance(kind, DecimalType):
        return kind.scale <= decimals and kind.precision - kind.scale <= digits
    return _INTEGERS.get(kind.typeName(), digits + 1) <= digits


def _read(df: DataFrame, name: str, column: Column, message: Column) -> Column:
    """``column`` in eight decimals; a number that is too large, or not 0 but less than any of them, fails the query."""
    kind = df.schema[name].dataType
    number = _or_error(column.try_cast(WIDE), column, message)
    if isinstance(kind, IntegralType) or (isinstance(kind, DecimalType) and kind.scale <= 8):
        return number
    tiny = F.concat(F.lit(f"column {name} holds a number of too many decimals: "), column.cast("string"))
    lost = (number == 0) & (column.try_cast("double") != 0)
    return F.when(lost, F.raise_error(tiny).cast(WIDE)).otherwise(number)


def strict_number(df: DataFrame, name: str) -> Column:
    """``name`` as a number of eight decimals; what is none, too large or too small fails the query."""
    column = F.col(name)
    message = F.concat(
        F.lit(f"column {name} holds text that is no number: "), column.cast("string")
    )
    return _read(df, name, column, message)


def lenient_number(df: DataFrame, name: str) -> Column:
    """``name`` as a number of eight decimals, 0 for anything that is none.

    Text is cast to decimal, not double: a double would let "nan" and "infinity" through.
    A number of more than 30 digits before the point, or one that eight decimals would make 0,
    fails the query.
    """
    column = F.col(name)
    if isinstance(df.schema[name].dataType, StringType):
        text = F.trim(column)
        digits = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
        column = F.when(digits, text)
    else:
        column = F.when(~F.isnan(column.cast("double")), column)
    message = F.concat(F.lit(f"column {name} holds too large a number: "), column.cast("string"))
    return F.coalesce(_read(df, name, column, message), F.lit(0).cast(WIDE))


def line_value(df: DataFrame, lenient: bool = False) -> Column:
    """Unit price times quantity of one line.

    Exact where both have four decimals and fourteen digits before the point, as money and
    counts do; else as a binary product, of eight decimals. Columns whose type has no more than
    that are just multiplied.
    """
    names = ("unitprice", "quantity")
    if all(_fits(df.schema[c].dataType, 14, 4) for c in names):
        product = (F.col("unitprice").cast(AMOUNT) * F.col("quantity").cast(AMOUNT)).cast(WIDE)
        return F.coalesce(product, F.lit(0).cast(WIDE)) if lenient else product
    number = lenient_number if lenient else strict_number
    price, quantity = number(df, "unitprice"), number(df, "quantity")
    p, q = price.try_cast(AMOUNT), quantity.try_cast(AMOUNT)
    binary = (price.cast("double") * quantity.cast("double")).try_cast(WIDE)
    message = F.lit("unit price times quantity is too large a number")
    product = F.when((p == price) & (q == quantity), (p * q).cast(WIDE)).otherwise(binary)
    return _or_error(product, price + quantity, message)


def exact(name: str) -> Column:
    """A money column at the edge, back as a decimal: its sums do not depend on their order."""
    return F.col(name).cast("decimal(30,8)")
