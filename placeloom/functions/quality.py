"""Completeness and quality of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import half_up, nonzero, truthy


def _points(*rules: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for test, points in rules:
        total = total + F.when(test, points).otherwise(0)
    return total


def coordinates(lat: Column, lng: Column) -> Column:
    return lat.isNotNull() & lng.isNotNull()


def completeness_class(name: Column, phone: Column, website: Column, address: Column, lat: Column, lng: Column) -> Column:
    n = _points((truthy(name), 1), (truthy(phone), 1), (truthy(website), 1), (truthy(address), 1), (coordinates(lat, lng), 1))
    return F.when(n >= 4, "FULL").when(n >= 1, "PARTIAL").otherwise("NAME_ONLY")


def quality_score(place_id, phone, website, address, lat, lng, rating, reviews) -> Column:
    return _points(
        (truthy(place_id), 15), (truthy(phone), 25), (truthy(website), 25), (truthy(address), 15), (coordinates(lat, lng), 10),
        (nonzero(rating), 5), (F.coalesce(reviews > 0, F.lit(False)), 5),
    )


def record_quality(name, phone, phones, website, websites, address, area, city, lat, lng, place_id, rating, reviews, category) -> Column:
    return _points(
        (truthy(name), 10), (truthy(phone), 20), (F.size(phones) > 0, 5), (truthy(website), 20), (F.size(websites) > 0, 5), (truthy(address), 15), (truthy(area), 5), (truthy(city), 5),
        (coordinates(lat, lng), 10), (truthy(place_id), 10), (nonzero(rating), 5), (nonzero(reviews), 5), (truthy(category), 5),
    )


def completeness_pct(*filled: Column) -> Column:
    return half_up(_points(*[(f, 1) for f in filled]) / float(len(filled)) * 100).cast("long")
