"""Business names, addresses and areas."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import B0, B1, WS, let, lookup, squeeze

# Fixed values that the results depend on.
ABBREVIATIONS = {
    "rd": "road", "rd.": "road", "st": "street", "st.": "street", "mkt": "market", "ctr": "centre", "center": "centre", "chowk.": "chowk", "ph.": "phase",
    "blk": "block", "blk.": "block", "sec.": "sector", "sec": "sector", "dist": "district", "dist.": "district", "teh": "tehsil", "teh.": "tehsil",
    "prov": "province", "prov.": "province", "apt": "apartment", "apt.": "apartment", "bldg": "building", "bldg.": "building", "flr": "floor", "flr.": "floor",
    "no.": "number", "no": "number", "p.o.": "post office", "po": "post office",
}
CITY_CODES = {
    "lhr": "lahore", "isb": "islamabad", "rwp": "rawalpindi", "khi": "karachi", "pew": "peshawar", "fsd": "faisalabad", "mux": "multan", "gjr": "gujranwala",
    "sial": "sialkot", "hyb": "hyderabad", "qta": "quetta",
}
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10", "xi": "11", "xii": "12"}
SUFFIXES = ["pvt", "pvt.", "ltd", "ltd.", "limited", "private", "inc", "inc.", "co", "co.", "company", "group", "(pvt) ltd", "(pvt.) ltd.", "private limited"]
AREA_KEYWORDS = [
    "gulberg", "dha", "johar town", "model town", "bahria town", "gardentown", "township", "wapda town", "valencia", "askari", "cantt", "anarkali", "ichhra", "mazang",
    "lahore", "blue area", "f-10", "f-11", "f-6", "f-7", "f-8", "g-9", "g-10", "g-11", "i-8", "i-9", "phase 5", "phase 2", "phase 1", "phase 8", "satellite town",
    "bahria phase", "rawalpindi", "islamabad", "clifton", "dha karachi", "garden", "saddar", "korangi", "landhi", "north nazimabad", "south nazimabad", "karachi",
    "main boulevard", "main road", "cantonment", "mall road",
]
CLEANED_WORDS = ["pvt", "ltd", "limited", "private", "inc", "co", "company", "group", "restaurant", "cafe", "school", "hotel", "agency", "realtors"]
AREA_PATTERNS = [
    r"dha\s*(?:phase\s*\d+)?", r"gulberg\s*(?:[ivx]+|\d+)?", r"bahria\s*(?:town|phase\s*\d+)?", r"model\s+town", r"johar\s+town", r"garden\s+town", r"wapda\s+town",
    r"f-\d+", r"g-\d+", r"i-\d+", r"sector\s*\d+", r"block\s*\w+", r"phase\s*\d+", r"cantt\.?",
]
NAME_MARKS = r"""['`´,;:!?()\-–—\[\]{}./\\|@#$%^&*+=<>~]"""
ADDRESS_MARKS = r"""[.,/#!$%^&*;:{}=\-_`~()]"""


def resolved(table: dict[str, str]) -> dict[str, str]:
    """A table in which a token also finds the entry of the token with a full stop."""
    return {t: table[t] for t in table} | {k[:-1]: table[k] for k in table if k.endswith(".") and k[:-1] not in table}


def expand(c: Column, table: dict[str, str]) -> Column:
    """Whitespace-separated tokens replaced by the table."""
    table = resolved(table)
    return F.array_join(F.transform(F.split(c, WS + "+"), lambda t: F.coalesce(lookup(table, F.lower(t)), t)), " ")


def nfkd(c: Column) -> Column:
    """Compatibility decomposition; only non-ASCII values go through Python, in Arrow batches."""

    @F.pandas_udf("string")
    def decompose(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))

    return F.when(c.rlike(r"[^\x00-\x7F]"), decompose(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


def name_norm(c: Column, ascii_only: bool = False) -> Column:
    """Full business-name normalisation; empty for null.  ``ascii_only`` promises ASCII input and skips decomposition."""
    s = F.lower(c if ascii_only else nfkd(c))
    s = F.regexp_replace(s, NAME_MARKS, " ")
    s = expand(expand(s, ABBREVIATIONS), CITY_CODES)
    cut = F.transform(F.array(s), _without_suffixes)
    s = F.regexp_replace(F.element_at(cut, 1), B0 + "mc" + WS + "+([A-Za-z0-9_])", "mc$1")
    return F.coalesce(squeeze(s), F.lit(""))


def _without_suffixes(s: Column) -> Column:
    """Each suffix is tried once at the end, in the declared order: a fold, so that no expression is repeated."""
    ends = F.array(*[F.lit(" " + x) for x in SUFFIXES])
    return F.aggregate(ends, s, lambda a, e: F.when(a.endswith(e), F.substr(a, F.lit(1), F.length(a) - F.length(e))).otherwise(a))


def name_clean(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), ADDRESS_MARKS, ""), WS + "+", " ")
    return F.trim(F.regexp_replace(s, f"{B0}(?:{'|'.join(CLEANED_WORDS)}){B1}", ""))


def branch_split(norm: Column) -> Column:
    """struct(core, qualifier) of a normalised name: cut before the first token from which on the rest starts with an area keyword."""
    def of(words):
        starts = F.sequence(F.lit(1), F.size(words))
        rest = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))
        at = F.array_position(F.transform(rest, lambda r: r.rlike("^(?:" + "|".join(AREA_KEYWORDS) + ")")), True)
        return F.when(at > 1, F.struct(F.array_join(F.slice(words, F.lit(1), (at - 1).cast("int")), " ").alias("core"), F.element_at(rest, at.cast("int")).alias("qualifier"))).otherwise(
            F.struct(F.array_join(words, " ").alias("core"), F.lit("").alias("qualifier"))
        )

    return F.element_at(F.transform(F.array(F.split(norm, " ")), of), 1)


def roman_digits(c: Column) -> Column:
    for numeral, digit in ROMAN.items():
        c = F.regexp_replace(c, B0 + numeral + B1, digit)
    return c


def _phase(c: Column) -> Column:
    return F.regexp_replace(c, rf"{B0}phase{WS}*[-.]?{WS}*([0-9]+){B1}", "phase $1")


def address_norm(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), ADDRESS_MARKS, " ")
    s = _phase(roman_digits(expand(expand(s, ABBREVIATIONS), CITY_CODES)))
    return F.coalesce(squeeze(s), F.lit(""))


def area_canonical(c: Column) -> Column:
    s = _phase(roman_digits(F.regexp_replace(F.lower(F.trim(c)), r"[.\-]", " ")))
    return F.coalesce(squeeze(expand(s, ABBREVIATIONS)), F.lit(""))


def area_tokens(address: Column) -> Column:
    """Ordered distinct locality tokens of an address."""
    found = let(address_norm(address), lambda a: F.flatten(F.array(*[F.regexp_extract_all(a, F.lit(p), F.lit(0)) for p in AREA_PATTERNS])))
    return F.array_distinct(F.transform(found, squeeze))


def area_extract(address: Column) -> Column:
    """Third part from the last of a comma-separated address of three parts or more."""
    parts = F.filter(F.transform(F.split(address, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(-3)))


def full_address(*parts: Column) -> Column:
    """Parts joined by commas; one is added only where no earlier one contains it (ignoring case)."""
    def add(acc, p):
        return F.when(F.exists(acc, lambda x: F.lower(x).contains(F.lower(p))), acc).otherwise(F.concat(acc, F.array(p)))

    given = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(F.aggregate(given, F.array().cast("array<string>"), add), ", ")


# ------------------------------------------------------------------ categories
PLURALS = ["restaurants", "shops", "schools", "clinics", "hotels", "pharmacies", "salons", "gyms"]
SYNONYMS = {
    "school": ["schools", "private schools", "sakool", "skool", "academy", "academies"], "college": ["colleges", "private colleges", "institute"], "university": ["universities"],
    "hotel": ["hotels", "hotle", "hotal", "lodging", "inn", "motel", "guest house"], "hospital": ["hospitals", "medical center"],
    "restaurant": ["restaurants", "resturent", "resuturant", "resturants", "restrant", "food place", "food places", "dining", "dining place", "fast food", "pizza place"],
    "cafe": ["cafes", "coffee shops", "kafe", "cafi", "coffee"], "pharmacy": ["pharmacies", "medical stores", "pharmacy", "chemist", "drugstore"], "shop": ["shops", "stores"],
    "business": ["businesses"], "gym": ["gyms", "fitness centers", "fitness"], "salon": ["salons", "beauty parlors", "barber", "barbershop", "hair salon", "beauty salon"],
    "clinic": ["clinics", "medical clinics"], "dentist": ["dentists", "dental clinics", "dental clinic", "dental"], "doctor": ["doctors", "physicians", "physician"], "bank": ["banks"],
    "supermarket": ["supermarkets", "grocery stores", "grocery", "groceries", "store"], "bakery": ["bakeries"], "mosque": ["mosques", "masjids", "masjid"], "church": ["churches"],
    "software house": ["software house", "software company", "software companies", "it company", "tech company", "software firm", "software houses"],
}


def category_norm(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), f"{B0}({'|'.join(p[:-1] for p in PLURALS)})s{B1}", "$1")
    s = F.trim(F.regexp_replace(s, f"{B0}(?:food|and|the|a){B1}", ""))
    return F.coalesce(F.regexp_replace(s, WS + "+", " "), F.lit(""))


def _plain_category(s: str) -> str:
    import re

    s = re.sub(rf"\b({'|'.join(p[:-1] for p in PLURALS)})s\b", r"\1", s.lower().strip())
    return re.sub(r"\s+", " ", re.sub(r"\b(food|and|the|a)\b", "", s).strip())


def group_table() -> dict[str, str]:
    """Normalised category -> synonym group; the first group in the declared order wins."""
    out: dict[str, str] = {}
    for group, names in SYNONYMS.items():
        for n in (group, *names):
            out.setdefault(_plain_category(n), group)
    return {k: v for k, v in out.items() if k}


def category_group(norm: Column) -> Column:
    return lookup(group_table(), norm)
