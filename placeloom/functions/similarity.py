"""String similarities from 0 to 100.  Jaro is the only one without a built-in form: one Arrow UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import half_up


def _one(c: Column, of) -> Column:
    """``of`` applied to a value bound to a lambda variable, so that it is computed once."""
    return F.element_at(F.transform(F.array(c), of), 1)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(half_up((1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1))) * 100).cast("double"))


def jaro_value(s: str, t: str) -> float:
    if s == t:
        return 1.0
    if not s or not t:
        return 0.0
    reach = max(max(len(s), len(t)) // 2 - 1, 0)
    free = [True] * len(t)
    matched = []
    for i, ch in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if free[j] and t[j] == ch:
                free[j] = False
                matched.append(ch)
                break
    m = len(matched)
    if not m:
        return 0.0
    other = [ch for j, ch in enumerate(t) if not free[j]]
    swaps = sum(x != y for x, y in zip(matched, other, strict=True)) / 2
    return (m / len(s) + m / len(t) + (m - swaps) / m) / 3


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro plus 0.1 for each of up to four equal leading characters, whatever the Jaro value."""

    @F.pandas_udf("double")
    def jaro(s, t):
        import pandas as pd

        seen: dict = {}
        return pd.Series([None if x is None or y is None else seen.get((x, y)) if (x, y) in seen else seen.setdefault((x, y), jaro_value(x, y)) for x, y in zip(s, t, strict=True)])

    j = jaro(a, b)
    # Columns of the caller are plain, so the UDF runs once for each pair.
    same = [F.substr(a, F.lit(1), F.lit(k)) == F.substr(b, F.lit(1), F.lit(k)) for k in range(1, 5)]
    fits = [(F.length(a) >= k) & (F.length(b) >= k) & c for k, c in zip(range(1, 5), same, strict=True)]
    prefix = sum((F.when(f, 1).otherwise(0) for f in fits[1:]), F.when(fits[0], 1).otherwise(0))
    return half_up((j + prefix * 0.1 * (1 - j)) * 100).cast("double")


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda t: t != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    return words_jaccard(tokens(a), tokens(b))


def words_jaccard(x: Column, y: Column) -> Column:
    """``token_jaccard`` of two arrays of different words."""
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 100.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(
        half_up(shared / (F.size(x) + F.size(y) - shared) * 100).cast("double")
    )


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda t: t != "")), " ")


def token_sort_similarity(a: Column, b: Column) -> Column:
    return levenshtein_similarity(sorted_tokens(a), sorted_tokens(b))


def bigrams(c: Column) -> Column:
    """All character bigrams of the space-padded text."""
    return _one(F.concat(F.lit(" "), c, F.lit(" ")), lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2))))


def bigram_dice(a: Column, b: Column, clamp: bool = False) -> Column:
    """Multiset overlap over the counts of *distinct* bigrams, so repeated bigrams can lift it above 100 unless clamped."""
    both = F.struct(bigrams(a).alias("x"), bigrams(b).alias("y"))

    def dice(v):
        shared = F.aggregate(F.array_distinct(v["x"]), F.lit(0), lambda n, g: n + F.least(F.size(F.filter(v["x"], lambda k: k == g)), F.size(F.filter(v["y"], lambda k: k == g))))
        return 2.0 * shared / (F.size(F.array_distinct(v["x"])) + F.size(F.array_distinct(v["y"])))

    d = half_up(_one(both, dice) * 100).cast("double")
    d = F.least(d, F.lit(100.0)) if clamp else d
    return F.when(a == b, 100.0).when((a == "") | (b == ""), 0.0).otherwise(d)


def name_similarity(a: Column, b: Column, clamp: bool = False, needed: Column | None = None) -> Column:
    """Weighted mean of five measures of normalised names; equal names have 100.

    Only names that differ (and pairs that are ``needed``, else null) reach the
    measures: the others pass nulls, also to the Arrow UDF.
    """
    wanted = F.lit(True) if needed is None else needed
    differ = wanted & (a != b) & (a != "") & (b != "")
    x, y = F.when(differ, a), F.when(differ, b)
    mean = levenshtein_similarity(x, y) * 0.15 + jaro_winkler(x, y) * 0.25 + token_jaccard(x, y) * 0.2 + token_sort_similarity(x, y) * 0.25 + bigram_dice(x, y, clamp) * 0.15
    return F.when(~wanted, None).when(a == b, 100.0).when((a == "") | (b == ""), 0.0).when(differ, half_up(F.round(mean, 9)).cast("double"))


def category_similarity(a: Column, b: Column, norm_a: Column, norm_b: Column, group_a: Column, group_b: Column, words: tuple[Column, Column] | None = None) -> Column:
    """``words``: the ``tokens`` of both normalised categories, where they are at hand."""
    missing_a, missing_b = a.isNull() | (a == ""), b.isNull() | (b == "")
    j = (token_jaccard(norm_a, norm_b) if words is None else words_jaccard(*words)) / 100.0
    return (
        F.when(missing_a & missing_b, 100.0).when(missing_a | missing_b, 0.0).when(norm_a == norm_b, 100.0).when((norm_a == "") | (norm_b == ""), 0.0).when(F.coalesce(group_a == group_b, F.lit(False)), 80.0)
        .when(norm_a.contains(norm_b) | norm_b.contains(norm_a), 60.0).when(j >= 0.5, half_up(60 * j).cast("double")).otherwise(0.0)
    )
