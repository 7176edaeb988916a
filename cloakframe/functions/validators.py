"""Checks that confirm a pattern match: check digits and ranges, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """The Luhn checksum of the digits holds, for 12 to 19 of them."""
    d = digits(text)
    places = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    total = F.aggregate(places, F.lit(0), lambda a, x: a + x)
    return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(False)


def iban(text: Column) -> Column:
    """ISO 7064 mod 97 of the rearranged account number is 1."""
    compact = F.upper(F.regexp_replace(text, r"\s", ""))
    moved = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.when(moved.rlike("^[A-Z0-9]{15,34}$"), rest == 1).otherwise(False)


def ipv4(text: Column) -> Column:
    """Four numbers of at most 255."""
    return F.forall(F.split(text, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(999)) <= 255)


def ssn(text: Column) -> Column:
    """Area, group and serial number are ones that are issued."""
    d = digits(text)
    area = F.substring(d, 1, 3)
    return (F.length(d) == 9) & ~area.isin("000", "666") & (area < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")
