"""Check digits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digit(s: Column, at: int) -> Column:
    """The digit at a place counted from 1."""
    return F.substring(s, at, 1).cast("int")


def luhn(s: Column) -> Column:
    return F.call_function("luhn_check", s)


def aba(s: Column) -> Column:
    """Bank routing numbers: weights 3, 7, 1 repeating, a multiple of 10."""
    return sum((digit(s, i + 1) * (3, 7, 1)[i % 3] for i in range(9)), F.lit(0)) % 10 == 0


def iban(s: Column) -> Column:
    """Mod 97 of the number with its first four characters last and letters as 10 to 35."""
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    code = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + code(c)) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def npi(s: Column) -> Column:
    return luhn(F.concat(F.lit("80840"), s))


def dea(s: Column) -> Column:
    """Two letters and seven digits: the odd places plus twice the even ones end in the last digit."""
    d = [digit(s, i) for i in range(3, 10)]
    return (d[0] + d[2] + d[4] + 2 * (d[1] + d[3] + d[5])) % 10 == d[6]


#: The letters of a vehicle number in the order of their numbers, and the places' weights.
VIN_LETTERS, VIN_NUMBERS = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)


def vin(s: Column) -> Column:
    """The ninth of 17 upper-case characters is the weighted sum modulo 11, X for 10."""
    n = F.translate(s, VIN_LETTERS, VIN_NUMBERS)
    rest = sum((digit(n, i + 1) * w for i, w in enumerate(VIN_WEIGHTS) if w), F.lit(0)) % 11
    return F.substring(s, 9, 1) == F.when(rest == 10, F.lit("X")).otherwise(rest.cast("string"))


def entropy(s: Column, kind: str | None = None) -> Column:
    """Shannon entropy of a string in bits for each character, over the characters that fit ``kind`` (by default all);
    0 of an empty one.  A character's share is of the whole string."""
    size = F.char_length(s).cast("double")
    bare = s if kind is None else F.regexp_replace(s, kind.replace("[", "[^", 1), "")
    chars = F.filter(F.split(bare, ""), lambda c: c != "")
    sorted_runs = F.regexp_extract_all(F.array_join(F.sort_array(chars), ""), F.lit(r"((?s).)\1*"), F.lit(0))
    return F.aggregate(sorted_runs, F.lit(0.0), lambda acc, r: acc - F.char_length(r) / size * F.log2(F.char_length(r) / size))
