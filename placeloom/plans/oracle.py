"""SQL forms of the functions and of entity resolution, for the oracle engine."""

from __future__ import annotations

from ..functions import text as t
from ..sources.places import FUZZY_SQL, PLACES_SQL

PLACES = f"places AS ({PLACES_SQL})"
FUZZY = f"{PLACES}, fuzzy AS ({FUZZY_SQL})"


def sub(x: str, pattern: str, to: str = "") -> str:
    return "regexp_replace({}, '{}', '{}', 'g')".format(x, pattern.replace("'", "''"), to)


def _case(key: str, table: dict[str, str], other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


def phone(x: str) -> str:
    v = sub(x, "[^0-9+]")
    v = f"CASE WHEN starts_with({v}, '0092') THEN '+92' || substr({v}, 5) WHEN starts_with({v}, '92') THEN '+' || {v} WHEN starts_with({v}, '0') AND length({v}) >= 10 THEN '+92' || substr({v}, 2) ELSE {v} END"
    return f"nullif(regexp_extract({v}, '^[+].*'), '')"


def national(x: str) -> str:
    return f"CASE WHEN starts_with({phone(x)}, '+92') THEN '0' || substr({phone(x)}, 4) ELSE {phone(x)} END"


def phone_legacy(x: str) -> str:
    v = sub(x, "[^0-9]")
    return f"nullif(CASE WHEN starts_with({v}, '92') AND length({v}) > 10 THEN '0' || substr({v}, 3) ELSE {v} END, '')"


def domain(x: str) -> str:
    return f"nullif(split_part(split_part({sub(sub(f'lower(trim({x}))', '^https?://'), '^www[.]')}, '/', 1), '?', 1), '')"


def canonical(x: str) -> str:
    x = domain(x)
    for p in ("m", "www", "maps", "local"):
        x = sub(x, f"^{p}[.]")
    return x


def website_legacy(x: str) -> str:
    return f"nullif(split_part({sub(sub(sub(f'lower(trim({x}))', '^https?://'), '^www[.]'), '/$')}, '?', 1), '')"


def website_norm(x: str) -> str:
    return f"CASE WHEN trim({x}) = '' THEN NULL WHEN regexp_matches(lower(trim({x})), '^https?://') THEN trim({x}) ELSE 'https://' || trim({x}) END"


def squeeze(x: str) -> str:
    return f"trim({sub(x, '[[:space:]]+', ' ')})"


def expand(x: str, table: dict[str, str]) -> str:
    return f"array_to_string(list_transform(string_split_regex({x}, '[[:space:]]+'), lambda w: {_case('lower(w)', t.resolved(table), 'w')}), ' ')"


def name(x: str) -> str:
    s = sub(f"lower({x})", r"""['`´,;:!?()\-–—\[\]{}./\\|@#$%^&*+=<>~]""", " ")
    s = expand(expand(s, t.ABBREVIATIONS), t.CITY_CODES)
    for suffix in t.SUFFIXES:
        if suffix.replace(" ", "").isalpha():
            s = sub(s, f" {suffix}$")
    return f"coalesce({squeeze(sub(s, r'\bmc[[:space:]]+([A-Za-z0-9_])', r'mc\1'))}, '')"


def name_clean(x: str) -> str:
    s = sub(sub(f"lower({x})", r"[.,/#!$%^&*;:{}=\-_`~()]"), "[[:space:]]+", " ")
    return f"trim({sub(s, rf'\b(?:{"|".join(t.CLEANED_WORDS)})\b')})"


def roman(x: str) -> str:
    for k, v in t.ROMAN.items():
        x = sub(x, rf"\b{k}\b", v)
    return x


def _phase(x: str) -> str:
    return sub(x, r"\bphase[[:space:]]*[-.]?[[:space:]]*([0-9]+)\b", r"phase \1")


def address(x: str) -> str:
    s = expand(expand(sub(f"lower({x})", r"[.,/#!$%^&*;:{}=\-_`~()]", " "), t.ABBREVIATIONS), t.CITY_CODES)
    return f"coalesce({squeeze(_phase(roman(s)))}, '')"


def area(x: str) -> str:
    return f"coalesce({squeeze(expand(_phase(roman(sub(f'lower(trim({x}))', r'[.\-]', ' '))), t.ABBREVIATIONS))}, '')"


def area_tokens(x: str) -> str:
    every = "flatten([" + ", ".join(f"regexp_extract_all({address(x)}, '{p}')" for p in t.AREA_PATTERNS) + "])"
    every = f"list_transform({every}, lambda x: trim(x))"
    return f"array_to_string(list_filter({every}, lambda x, i: list_position({every}, x) = i), '|')"


def category(x: str) -> str:
    s = sub(f"lower(trim({x}))", rf"\b({'|'.join(p[:-1] for p in t.PLURALS)})s\b", r"\1")
    return f"coalesce({sub(f'trim({sub(s, r"\b(?:food|and|the|a)\b")})', '[[:space:]]+', ' ')}, '')"


def group(norm: str) -> str:
    return _case(norm, t.group_table(), "NULL")


def lev(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 100.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE floor((1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))) * 100 + 0.5) END::DOUBLE"


def jaro(a: str, b: str) -> str:
    """Jaro with half transpositions counted as halves (the engine's own function rounds them down): a fold over the first text's characters."""
    reach = f"greatest(greatest(length({a}), length({b})) // 2 - 1, 0)"
    chars = f"list_transform(range(1, length({a}) + 1), lambda i: {{'i': i, 'c': substr({a}, i, 1), 'used': '', 'm': ''}})"
    start = f"{{'i': 0::BIGINT, 'c': '', 'used': repeat('0', length({b})), 'm': ''}}"
    free = f"list_filter(range(greatest(1, x.i - {reach}), least(length({b}), x.i + {reach}) + 1), lambda j: substr(acc.used, j, 1) = '0' AND substr({b}, j, 1) = x.c)[1]"
    step = f"{{'i': x.i, 'c': x.c, 'used': CASE WHEN {free} IS NULL THEN acc.used ELSE substr(acc.used, 1, {free} - 1) || '1' || substr(acc.used, {free} + 1) END, 'm': CASE WHEN {free} IS NULL THEN acc.m ELSE acc.m || x.c END}}"
    state = f"list_reduce({chars}, lambda acc, x: {step}, {start})"
    other = f"array_to_string(list_transform(list_filter(range(1, length({b}) + 1), lambda j: substr(st.used, j, 1) = '1'), lambda j: substr({b}, j, 1)), '')"
    swaps = f"len(list_filter(range(1, length(st.m) + 1), lambda k: substr(st.m, k, 1) <> substr({other}, k, 1))) / 2.0::DOUBLE"
    n = "length(st.m)::DOUBLE"
    return f"list_transform([{state}], lambda st: CASE WHEN {n} = 0 THEN 0 ELSE ({n} / length({a}) + {n} / length({b}) + ({n} - {swaps}) / {n}) / 3 END)[1]"


def winkler(a: str, b: str) -> str:
    prefix = "CASE " + " ".join(f"WHEN length({a}) >= {k} AND length({b}) >= {k} AND substr({a}, 1, {k}) = substr({b}, 1, {k}) THEN {k}" for k in (4, 3, 2, 1)) + " ELSE 0 END"
    return f"CASE WHEN {a} = {b} THEN 100.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE list_transform([{jaro(a, b)}], lambda v: floor((v + {prefix} * 0.1::DOUBLE * (1 - v)) * 100 + 0.5))[1] END::DOUBLE"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[[:space:]]+'), lambda w: w <> '')"


def jaccard(a: str, b: str) -> str:
    x, y = f"list_distinct({_words(a)})", f"list_distinct({_words(b)})"
    i = f"len(list_intersect({x}, {y}))"
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 100.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE floor({i}::DOUBLE / (len({x}) + len({y}) - {i}) * 100 + 0.5) END::DOUBLE"


def token_sort(a: str, b: str) -> str:
    x, y = (f"array_to_string(list_sort({_words(z)}), ' ')" for z in (a, b))
    return lev(x, y)


def dice(a: str, b: str) -> str:
    grams = lambda x: f"list_transform(range(1, length({x}) + 2), lambda i: substr(' ' || {x} || ' ', i, 2))"
    x, y = grams(a), grams(b)
    shared = f"list_sum(list_transform(list_distinct({x}), lambda g: least(len(list_filter({x}, lambda k: k = g)), len(list_filter({y}, lambda k: k = g)))))"
    return f"CASE WHEN {a} = {b} THEN 100.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE floor(2.0::DOUBLE * {shared} / (len(list_distinct({x})) + len(list_distinct({y}))) * 100 + 0.5) END::DOUBLE"


def name_sim(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} = {b} THEN 100.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE floor(round({lev(a, b)} * 0.15::DOUBLE + {winkler(a, b)} * 0.25::DOUBLE + {jaccard(a, b)} * 0.2::DOUBLE "
        f"+ {token_sort(a, b)} * 0.25::DOUBLE + {dice(a, b)} * 0.15::DOUBLE, 9) + 0.5) END::DOUBLE"
    )


def category_sim(a: str, b: str, na: str, nb: str) -> str:
    j = jaccard(na, nb)
    return (
        f"CASE WHEN coalesce({a}, '') = '' AND coalesce({b}, '') = '' THEN 100.0 WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.0 WHEN {na} = {nb} THEN 100.0 WHEN {na} = '' OR {nb} = '' THEN 0.0 "
        f"WHEN {group(na)} = {group(nb)} THEN 80.0 WHEN contains({na}, {nb}) OR contains({nb}, {na}) THEN 60.0 WHEN {j} >= 50 THEN floor(0.6::DOUBLE * {j} + 0.5) ELSE 0.0 END::DOUBLE"
    )


def km(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(6371.0::DOUBLE * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"


def points(*rules: tuple[str, int]) -> str:
    return "(" + " + ".join(f"CASE WHEN {test} THEN {n} ELSE 0 END" for test, n in rules) + ")"


def truthy(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> '')"


def num(x: str) -> str:
    """A number as text, without a fraction of zero."""
    return f"CASE WHEN {x} = floor({x}) THEN {x}::BIGINT::VARCHAR ELSE {x}::VARCHAR END"


def shown(x: str) -> str:
    return f"coalesce(CASE WHEN {x} <> 0 THEN {num(x)} END, '')"


KEYWORDS = "|".join(t.AREA_KEYWORDS)


def branch_at(words: str) -> str:
    """1-based index of the first token from which on the rest starts with an area keyword (null: none)."""
    return f"list_filter(range(1, len({words}) + 1), lambda i: regexp_matches(array_to_string({words}[i:], ' '), '^(?:{KEYWORDS})'))[1]"


#: All five key families, cities of at most 200 rows.
PARITY_SQL = f"""WITH {FUZZY}, n AS (SELECT *, {name('business_name')} AS name FROM fuzzy
), r AS (
  SELECT rec_no, {phone('phone')} AS ph, {canonical('website')} AS web, floor(latitude / 2) AS x, floor(longitude / 2) AS y,
    nullif(array_to_string(list_sort(list_filter(string_split(name, ' '), lambda x: x <> '')[1:2]), '|'), '') AS nk, nullif(lower(trim(city)), '') AS ck FROM n
), c AS (SELECT ck FROM r GROUP BY ck HAVING count(*) <= 200
), k AS (
  SELECT rec_no, 0 AS key_type, ph AS key FROM r WHERE ph IS NOT NULL UNION ALL SELECT rec_no, 1, web FROM r WHERE web IS NOT NULL
  UNION ALL SELECT rec_no, 2, x || '_' || y FROM r WHERE x IS NOT NULL AND y IS NOT NULL UNION ALL SELECT rec_no, 3, nk FROM r WHERE nk IS NOT NULL
  UNION ALL SELECT rec_no, 4, ck FROM r WHERE ck IN (SELECT ck FROM c)
) SELECT a.rec_no AS i, b.rec_no AS j, min(a.key_type) AS key_type FROM k a JOIN k b ON a.key_type = b.key_type AND a.key = b.key AND a.rec_no < b.rec_no GROUP BY 1, 2"""

#: Records with everything that scoring needs, candidate pairs, signals, scores, edges and components.
def er(source: str, head: str) -> str:
    """Resolution of the records of a CTE ``source`` that ``head`` defines."""
    return f"""WITH RECURSIVE {head}, r0 AS (
  SELECT *, {name('business_name')} AS name, {phone('phone')} AS ph, {canonical('website')} AS web, {address('address')} AS addr, {area('area')} AS area_c, {category('category')} AS cat FROM {source}
), r1 AS (SELECT *, string_split(name, ' ') AS w FROM r0), r2 AS (SELECT *, {branch_at('w')} AS cut FROM r1
), rec AS (
  SELECT *, CASE WHEN cut > 1 THEN array_to_string(w[1:cut - 1], ' ') ELSE name END AS core, CASE WHEN cut > 1 THEN array_to_string(w[cut:], ' ') ELSE '' END AS qual FROM r2
), rec2 AS (SELECT *, {area('qual')} AS qual_c, CASE WHEN area_c <> '' THEN area_c ELSE {area('qual')} END AS area_any FROM rec
), pairs AS (
  SELECT i, j, min(key_type) AS key_type FROM (
    SELECT a.rec_no AS i, b.rec_no AS j, 0 AS key_type FROM rec2 a JOIN rec2 b ON a.ph = b.ph AND a.rec_no < b.rec_no
    UNION ALL SELECT a.rec_no, b.rec_no, 1 FROM rec2 a JOIN rec2 b ON a.web = b.web AND a.rec_no < b.rec_no
    UNION ALL SELECT a.rec_no, b.rec_no, 2 FROM rec2 a JOIN rec2 b ON a.rec_no < b.rec_no AND abs(a.latitude - b.latitude) < 0.002 AND {km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} * 1000 <= 150
  ) GROUP BY i, j
), s0 AS (
  SELECT p.i, p.j, p.key_type, a.city AS ca, b.city AS cb, a.qual AS qa, b.qual AS qb, a.qual_c AS qca, b.qual_c AS qcb, a.area_c AS aa, b.area_c AS ab, a.area_any AS xa, b.area_any AS xb,
    {name_sim('a.name', 'b.name')} AS name_sim, CASE WHEN a.ph = b.ph THEN 1 ELSE 0 END AS phone_sim, CASE WHEN a.web = b.web THEN 1 ELSE 0 END AS website_sim, {lev('a.addr', 'b.addr')} AS address_sim,
    {km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} * 1000 AS d, {category_sim('a.category', 'b.category', 'a.cat', 'b.cat')} AS category_sim, {name_sim('a.core', 'b.core')} AS core_sim
  FROM pairs p JOIN rec2 a ON a.rec_no = p.i JOIN rec2 b ON b.rec_no = p.j
), s1 AS (
  SELECT *, CASE WHEN d IS NULL THEN -1 WHEN d < 20 THEN 100 WHEN d <= 50 THEN 80 WHEN d <= 150 THEN 50 ELSE 10 END AS geo_score, coalesce(ca <> '' AND cb <> '' AND lower(ca) <> lower(cb), false) AS other_city,
    CASE WHEN qa <> '' AND qb <> '' AND qa <> qb AND core_sim >= 70 AND xa <> xb AND NOT coalesce(d <= 50, false) THEN 40.0
      WHEN core_sim >= 70 AND ((qa <> '' AND qb = '' AND ab <> '' AND NOT contains(qca, ab) AND NOT contains(ab, qca)) OR (qb <> '' AND qa = '' AND aa <> '' AND NOT contains(qcb, aa) AND NOT contains(aa, qcb))) THEN 45.0 END AS cap FROM s0
), s2 AS (
  SELECT *, floor(round(0.30::DOUBLE * name_sim + 0.25::DOUBLE * phone_sim + 0.15::DOUBLE * website_sim + 0.15::DOUBLE * address_sim + 0.15::DOUBLE * greatest(geo_score, 0) + 0.10::DOUBLE * category_sim, 9) + 0.5) AS base,
    phone_sim = 1 AND name_sim >= 85 AND (d IS NULL OR d <= 100) AS by_phone, website_sim = 1 AND name_sim >= 85 AND address_sim >= 70 AS by_web, coalesce(d <= 20, false) AND name_sim >= 80 AND category_sim >= 60 AS by_place FROM s1
), s3 AS (
  SELECT *, least(least(base, CASE WHEN other_city THEN 30.0 ELSE 100.0 END), coalesce(cap, 100.0)) AS capped FROM s2
), sc AS (
  SELECT *, greatest(capped, CASE WHEN by_phone THEN 90.0 ELSE 0 END, CASE WHEN by_web THEN 85.0 ELSE 0 END, CASE WHEN by_place THEN 88.0 ELSE 0 END)::DOUBLE AS score FROM s3
), e AS (SELECT i, j, key_type, score FROM sc WHERE score >= 60), both_ways AS (SELECT i AS a, j AS b FROM e UNION SELECT j, i FROM e
), reach(n, m) AS (SELECT a, a FROM both_ways UNION SELECT reach.n, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.m
), comp AS (SELECT n AS node, min(m) AS component FROM reach GROUP BY n
), mem AS (
  SELECT f.*, comp.component, {points((truthy('business_name'), 10), (truthy('phone'), 20), (f"{phone('phone')} IS NOT NULL", 5), (truthy('website'), 20), (f"{canonical('website')} IS NOT NULL", 5), (truthy('address'), 15), (truthy('area'), 5), (truthy('city'), 5), ('latitude IS NOT NULL AND longitude IS NOT NULL', 10), (truthy('place_id'), 10), ('rating <> 0', 5), ('review_count <> 0', 5), (truthy('category'), 5))} AS quality
  FROM {source} f JOIN comp ON comp.node = f.rec_no
), grp AS (
  SELECT m.component, count(*) AS n_members, arg_max(m.rec_no, m.quality * 10000000 - m.rec_no) AS master, max(m.quality) AS master_quality,
    (SELECT floor(avg(e.score) + 0.5) FROM e JOIN comp c ON c.node = e.i WHERE c.component = m.component) AS group_score, 'DG-' || lpad((row_number() OVER (ORDER BY m.component))::VARCHAR, 4, '0') AS group_id
  FROM mem m GROUP BY m.component
)"""


ER = er("fuzzy", FUZZY)

#: First-wins replay in the order of the records that share an id or key: a row for each, with the ids and keys kept so far.
EXACT = f"""{PLACES}, k0 AS (
  SELECT rec_no, nullif(place_id, '') AS i, {name('business_name')} AS a, coalesce({phone('phone')}, '') AS b, coalesce({domain('website')}, '') AS c, {address('address')} AS d FROM places
), k1 AS (
  SELECT rec_no, i, CASE WHEN (a <> '')::INTEGER + (b <> '')::INTEGER + (c <> '')::INTEGER + (d <> '')::INTEGER >= 2 THEN concat(a, '|', b, '|', c, '|', d) END AS k FROM k0
), k2 AS (
  SELECT *, (i IS NOT NULL AND count(*) OVER (PARTITION BY i) > 1) OR (k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1) AS shared FROM k1
), k3 AS (SELECT rec_no, i, k, row_number() OVER (ORDER BY rec_no) AS n FROM k2 WHERE shared
), replay(n, ids, keys, kept) AS (
  SELECT 0::BIGINT, MAP([]::VARCHAR[], []::BOOLEAN[]), MAP([]::VARCHAR[], []::BOOLEAN[]), NULL::BIGINT
  UNION ALL
  SELECT x.n, CASE WHEN ok AND i IS NOT NULL THEN map_concat(ids, MAP([i], [true])) ELSE ids END, CASE WHEN ok AND k IS NOT NULL THEN map_concat(keys, MAP([k], [true])) ELSE keys END, CASE WHEN ok THEN rec_no END
  FROM (SELECT y.n, y.rec_no, y.i, y.k, r.ids, r.keys, NOT (y.i IS NOT NULL AND map_contains(r.ids, y.i)) AND NOT (y.k IS NOT NULL AND map_contains(r.keys, y.k)) AS ok FROM replay r JOIN k3 y ON y.n = r.n + 1) x
), exact AS (SELECT p.* FROM places p WHERE rec_no IN (SELECT rec_no FROM k2 WHERE NOT shared) OR rec_no IN (SELECT kept FROM replay WHERE kept IS NOT NULL))"""
