"""Roman numerals and identifiers of chapters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
VALUES = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman_to_int(text: Column) -> Column:
    """Value of a numeral of the letters I V X L C D M; 0 for anything else and for empty text."""
    up = F.upper(text)
    digit = F.create_map(*[F.lit(x) for v, s in VALUES if len(s) == 1 for x in (s, v)])
    values = F.transform(F.filter(F.split(up, ""), lambda c: c != ""), lambda c: digit[c])
    total = F.aggregate(
        values,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, v: F.struct(
            (a["sum"] + v - F.when(v > a["last"], a["last"] * 2).otherwise(0)).alias("sum"), v.alias("last")
        ),
    )["sum"]
    return F.when(up.rlike("^[IVXLCDM]+$"), total).otherwise(0)


def int_to_roman(n: Column) -> Column:
    """Numeral of a number from 1; '' below."""
    state = F.struct(n.cast("int").alias("left"), F.lit("").alias("out"))
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in VALUES])
    return F.aggregate(
        table,
        state,
        lambda a, d: F.struct(
            F.pmod(a["left"], d["v"]).alias("left"), F.concat(a["out"], F.repeat(d["s"], F.floor(a["left"] / d["v"]).cast("int"))).alias("out")
        ),
        lambda a: F.when(n >= 1, a["out"]).otherwise(""),
    )


def number_of(identifier: Column) -> Column:
    """The number an identifier stands for, arabic or roman; null if neither."""
    plain = F.when(identifier.rlike(r"^\d{1,9}$"), identifier.cast("int"))
    return F.coalesce(plain, F.nullif(roman_to_int(identifier), F.lit(0)))


def sequence_of(first: Column, last: Column) -> Column:
    """Identifiers from first to last: arabic or roman numbers; the first alone if they are neither;
    none if the last comes before the first."""
    arabic = first.rlike(r"^\d{1,9}$") & last.rlike(r"^\d{1,9}$")
    a, b = number_of(first), number_of(last)
    both = a.isNotNull() & b.isNotNull()
    numbers = F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    return (
        F.when(arabic, F.transform(numbers, lambda x: x.cast("string")))
        .when(both & ~first.rlike(r"\d") & ~last.rlike(r"\d"), F.transform(numbers, int_to_roman))
        .otherwise(F.array(first))
    )
