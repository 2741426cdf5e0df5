"""Phones and websites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import let, squeeze, truthy


def phone_norm(c: Column) -> Column:
    """International form, or null where none can be told."""
    def dialled(v):
        local = F.when(v.startswith("0") & (F.length(v) >= 10), F.concat(F.lit("+92"), F.substr(v, F.lit(2))))
        return F.when(v.startswith("+"), v).when(v.startswith("0092"), F.concat(F.lit("+92"), F.substr(v, F.lit(5)))).when(v.startswith("92"), F.concat(F.lit("+"), v)).otherwise(local)

    return let(F.regexp_replace(c, r"[^0-9+]", ""), dialled)


def phone_national(c: Column) -> Column:
    return let(phone_norm(c), lambda v: F.when(v.startswith("+92"), F.concat(F.lit("0"), F.substr(v, F.lit(4)))).otherwise(v))


def phone_legacy(c: Column) -> Column:
    """Digits only, local form; null if nothing is left."""
    v = F.regexp_replace(c, r"[^0-9]", "")
    v = F.when(v.startswith("92") & (F.length(v) > 10), F.concat(F.lit("0"), F.substr(v, F.lit(3)))).otherwise(v)
    return F.when(truthy(v), v)


def phone_valid(c: Column) -> Column:
    return F.coalesce(phone_norm(c).rlike(r"^\+923[0-9]{9}$|^\+92[0-9]{9,10}$"), F.lit(False))


def phones_all(*columns: Column, arrays: tuple[Column, ...] = ()) -> Column:
    """Ordered distinct international forms of scalar columns and arrays; what can't be normalised drops out."""
    every = F.concat(F.array(*columns), *[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    return F.array_distinct(F.filter(F.transform(every, phone_norm), lambda x: x.isNotNull()))


def website_norm(c: Column) -> Column:
    return let(F.nullif(F.trim(c), F.lit("")), lambda v: F.when(v.rlike("(?i)^https?://"), v).otherwise(F.concat(F.lit("https://"), v)))


def website_domain(c: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^https?://", ""), r"^www\.", "")
    return F.nullif(F.substring_index(F.substring_index(v, "/", 1), "?", 1), F.lit(""))


def website_canonical(c: Column) -> Column:
    v = website_domain(c)
    for prefix in ("m", "www", "maps", "local"):
        v = F.regexp_replace(v, rf"^{prefix}\.", "")
    return v


def websites_all(*columns: Column, arrays: tuple[Column, ...] = ()) -> Column:
    every = F.concat(F.array(*columns), *[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    return F.array_distinct(F.filter(F.transform(every, website_canonical), truthy))


def website_legacy(c: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^https?://", ""), r"^www\.", "")
    return F.nullif(F.substring_index(F.regexp_replace(v, "/$", ""), "?", 1), F.lit(""))


def set_compare(a: Column, b: Column) -> Column:
    """-1 if either set is empty, 1 if they overlap, else 0."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), -1).when(F.arrays_overlap(a, b), 1).otherwise(0)


text_norm = squeeze
