"""Column functions on addresses, coordinates and house numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a house without a number where a layout needs one.
NO_NUMBER = 1000


def first_number(c: Column) -> Column:
    """The first run of digits: ``3 Maja 14`` is 3."""
    return F.expr("CAST(NULL AS DOUBLE)") if c is None else F.regexp_extract(c, r"(\d+)", 1).try_cast("double")


def last_token_number(c: Column) -> Column:
    """The last word as a whole number: null for ``3 Maja``."""
    return F.element_at(F.split(F.trim(c), r"(?U)\s+"), -1).try_cast("int")


def street_and_number(c: Column) -> Column:
    """struct(street, number) around trailing digits; without them the text and null.
    Leading blanks are no part of the street."""
    t = F.trim(c)
    digits = F.regexp_extract(t, r"(\d+)$", 1)
    return F.struct(F.trim(F.substring(t, F.lit(1), F.length(t) - F.length(digits))).alias("street"), digits.try_cast("int").alias("number"))


def number_in_street(c: Column, street: str) -> Column:
    """The last word's number where the address begins with the street and goes on, otherwise ``NO_NUMBER``."""
    t = F.trim(c)
    goes_on = F.startswith(t, F.lit(street)) & (t != street)
    return F.when(goes_on, F.coalesce(last_token_number(c), F.lit(NO_NUMBER))).otherwise(NO_NUMBER)


def first_two_tokens(c: Column) -> Column:
    """struct(street, number): the first word, and the second as a number (null where it is none)."""
    words = F.split(F.trim(c), r"(?U)\s+")
    return F.struct(F.element_at(words, 1).alias("street"), F.try_element_at(words, F.lit(2)).try_cast("int").alias("number"))


def is_even(n: Column) -> Column:
    return F.pmod(n, F.lit(2)) == 0


def dms_degrees(c: Column) -> Column:
    """Decimal degrees of a text such as 51°12'57.70"N: south and west are negative; null where it is none."""
    shape = r"""^\s*(\d+(?:\.\d+)?)\s*°\s*(\d+(?:\.\d+)?)\s*['’′]\s*(\d+(?:\.\d+)?)\s*["”″]\s*([NSEWnsew]?)\s*$"""
    part = lambda i: F.regexp_extract(c, shape, i).try_cast("double")
    sign = F.when(F.upper(F.regexp_extract(c, shape, 4)).isin("S", "W"), -1.0).otherwise(1.0)
    return sign * (part(1) + part(2) / 60 + part(3) / 3600)


def scaled(c: Column, least: Column, greatest: Column) -> Column:
    """Min-max scaling; 0 where all values are equal."""
    return F.when(greatest > least, (c - least) / (greatest - least)).when(c.isNotNull(), 0.0)


def projected(x: Column, y: Column, z: Column, heading: Column, pitch: Column, field_of_view: float = 60.0, aspect: float = 1.5) -> Column:
    """struct(u, v, visible): a point relative to the camera, turned by heading and
    pitch (degrees) and divided by its distance ahead. Points less than 1e-4 ahead have no place."""
    h, p = F.radians(heading), F.radians(pitch)
    right = x * F.cos(h) - y * F.sin(h)
    level = x * F.sin(h) + y * F.cos(h)
    ahead = level * F.cos(p) + z * F.sin(p)
    up = z * F.cos(p) - level * F.sin(p)
    half = F.tan(F.radians(F.lit(field_of_view / 2)))
    u = F.when(ahead > 1e-4, right / (ahead * half * aspect))
    v = F.when(ahead > 1e-4, up / (ahead * half))
    return F.struct(u.alias("u"), v.alias("v"), F.coalesce((F.abs(u) <= 1) & (F.abs(v) <= 1), F.lit(False)).alias("visible"))


def bearing(dx: Column, dy: Column, heading: Column) -> Column:
    """Angle from the heading (radians) to a point, from -pi to pi."""
    angle = F.atan2(dx, dy) - heading
    return angle - 2 * F.pi() * F.floor((angle + F.pi()) / (2 * F.pi()))


def elevation(dx: Column, dy: Column, dz: Column) -> Column:
    return F.atan2(dz, F.hypot(dx, dy))
