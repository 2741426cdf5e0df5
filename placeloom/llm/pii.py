r"""PII surrogates.

Personal data in whole texts is replaced by keyed surrogates of the same type:
e-mail addresses, phone numbers, payment card numbers, social security
numbers, IPv4 addresses and names after a form of address (initials, hyphens,
apostrophes, particles and up to 31 capitalised parts), as well as bare mentions
of these names' words in the same text.  Digits keep their
layout and letters their class; card numbers keep a valid check digit;
given names keep gender and script, surnames their script and capitals.

A surrogate is a function of (secret, type, canonical form, attempt), so one
entity gets the same surrogate wherever and however it is written (a phone
number with or without dashes, a North American one with or without +1, ``Mrs. Smith`` and ``Mrs. Jane Smith``, ``Dr. Jane
Smith`` and ``Mrs. Jane Smith``).  The table of
distinct entities is checked: where two entities would share a surrogate, or a
surrogate is itself an entity of the corpus, the later ones get the next
attempt, until nothing collides.  Built-in functions only; entities meet their
surrogates in a join, so no table is broadcast and no driver loop sees data.

Defined cases: null texts stay null, with no entity; empty texts stay empty;
entities that overlap are read from left to right; 13 to 19 digits that fail the
card check digit are left alone unless another type fits, but for 16 digits, the
usual length: a mistyped card number is personal data too, at the price of
order numbers of that length; equal rows get equal
texts; initials get keyed initials (those of a bare name only between two of its
words); a bare word that was seen as given name and as surname is the given name
in front of another word, else the surname; an empty table gives an empty result; extra columns pass through
``pseudonymise`` unless they are called like its outputs.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, read

EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,6}[A-Za-z]{1,24}(?![A-Za-z0-9@])"
_GAP = r"(?:[ .\-/]|[ .\-]?\(|\)[ .\-]?)"
#: North American phones without a +.
AMERICAN = r"(?:1[ .\-]?)?\(\d{3}\) ?\d{3}[\-. ]\d{4}|(?:1[ .\-])?\d{3}[ .\-]\d{3}[ .\-]\d{4}"
#: Phones: international with + or 00 (7 to 15 digits in groups of any size, or the short groups of small
#: networks), national in North American form, and national with a trunk zero as area code and number or as pairs.
PHONE = "|".join(
    [
        rf"(?<![\w+])\+1(?:{_GAP}?\d){{10}}(?!\d)",
        rf"(?<![\w+])\+[1-9](?:{_GAP}?\d){{6,14}}(?!\d|\.\d)",
        r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,4}){1,4}(?!\d)",
        rf"(?<![\w+.\-/])(?!\d{{16}}(?!\d)|(?:\d{{4}}[ \-]){{3}}\d{{4}}(?!\d))00[1-9](?:{_GAP}?\d){{7,14}}(?![\w\-])",
        r"(?<![\w+.])(?:1[ .\-]?)?\(\d{3}\) ?\d{3}[\-. ]\d{4}(?!\d)",
        r"(?<![\w+.\-])(?:1[ .\-])?\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\d\-])",
        r"(?<![\w+.\-/])(?!\d{5}-\d{4}(?!\d))(?=(?:[ \-/()]{0,2}\d){9,13}(?!\d))(?:\(0[1-9]\d{0,4}\) ?|0[1-9]\d{0,4}[ \-/])\d{3,8}(?:[ \-]\d{2,5}){0,3}(?![\w\-])",
        r"(?<![\w+.\-/])0[1-9](?:[ .\-]\d\d){4}(?![\w\-]|\.\d)",
        r"(?<![\w+.\-/])0[1-9]\d{8,9}(?![\w\-]|\.\d)",
    ]
)
CARD = r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w\-])"
SSN = r"(?<![\w.\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"
MALE = r"Mr|Sir|Herr|Monsieur|Señor|Sr|Don|Господин|г-н"
FEMALE = r"Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|Sra|Doña|Госпожа|г-жа"
NEUTRAL = r"Dr|Prof"
#: Titles that follow another title, and words that end a name.
CHAIN = r"Dr|Prof|Mr|Mrs|Ms|Herr|Frau"
STOP = (
    rf"(?:{CHAIN}|Madame|Mme|Monsieur|Señor|Señora|Sra|Господин|Госпожа|Jr|Sr|Junior|Senior|II|III|IV|VI|VII|VIII|PhD|MD|Esq|"
    r"The|Then|This|That|These|Those|There|They|And|But|When|While|After|Before|Because|However|Also|His|Their|With|From|Where|What|"
    r"Und|Aber|Nach|Wenn|Dann|Les|Des|Avec|Dans|Pour|Mais|Los|Las|Pero|Para|Это|Она|Они|Затем|Потом|Для|При|Как|Что)(?!\p{L})"
)
PARTICLE = r"van|von|vom|der|den|de|del|della|di|da|dos|du|la|le|bin|ibn|al|el|ter|ten|zu|zur"
#: A word of a name: a capital and more letters, with inner apostrophes (O'Brien) but no possessive or contraction.
WORD = r"(?<![\p{L}\p{M}\p{N}_])(?=\p{Lu}['’]?\p{L})\p{Lu}[\p{L}\p{M}]*+(?:['’](?!(?i:s|d|ll|re|ve|m)(?!\p{L}))\p{L}[\p{L}\p{M}]*+)*+"
_INITIALS = r"(?:(?:\p{Lu}\.){1,6} ?|\p{Lu} )"
_PART = rf"(?:(?:{PARTICLE}) ){{0,3}}(?:\p{{Ll}}{{1,2}}['’])?{WORD}(?:-{WORD}){{0,5}}"
TITLES = rf"(?:{MALE}|{FEMALE}|{NEUTRAL})\.? (?:(?:{CHAIN})\.? ){{0,4}}"
NAME = rf"(?<![\p{{L}}]){TITLES}(?:{_INITIALS}{{1,6}}(?!{STOP}))?(?!(?:{CHAIN})(?!\p{{L}})){_PART}(?: {_INITIALS}{{0,6}}(?!{STOP}){_PART}){{0,30}}"
#: What stands between two words of one name.
BETWEEN = rf"^(?:-| {_INITIALS}{{0,6}}(?:(?:{PARTICLE}) ){{0,3}})$"
#: What a phone keeps: the trunk zero or one, or the country code by its first digits: one digit, two digits, else three.
COUNTRY = r"^0|^1(?=[0-9]{10}$)|^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
TRUNK = r"(?<=^\+.{1,5})\(0\)"
#: What every match holds; texts without it skip the pattern itself.
HINT = rf"[0-9]{{2}}|[0-9]\.[0-9]|\+[0-9]|@|(?<![\p{{L}}])(?:{MALE}|{FEMALE}|{NEUTRAL})\.? \p{{Lu}}"
PATTERN = f"(?:{EMAIL})|(?:{PHONE})|(?:{SSN})|(?:{CARD})|(?:{IP})|(?:{NAME})"

#: Given names by gender and script; after these the syllable rule goes on.
GIVEN = {
    ("m", "latin"): "James Robert Daniel Thomas Peter Martin Simon Victor Oscar Hugo Felix Leon Paul Andre Marco Diego Carlos Jorge Bruno Emil",
    ("f", "latin"): "Anna Maria Laura Julia Clara Emma Sofia Elena Nora Alice Helen Diana Lucia Carmen Rosa Marta Paula Ines Greta Irene",
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Павел Андрей Борис Виктор",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Вера Нина Софья Дарья",
}
_SYLLABLES = {"latin": "ba be bi bo da de di do fa fe fi fo ga ge la le li lo ma me mi mo na ne ni no ra re ri ro sa".split(), "cyrillic": "ба бе би бо да де ди до га ге ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те".split()}
_ENDS = {("m", "latin"): "n", ("f", "latin"): "lia", ("m", "cyrillic"): "н", ("f", "cyrillic"): "лия", ("s", "latin"): "rton", ("s", "cyrillic"): "ров"}


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _woven(gaps: Column, words: Column) -> Column:
    """Gaps and the words between them as one string."""
    return F.array_join(F.zip_with(gaps, F.concat(words, F.array(F.lit(""))), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def _capitals(name: Column, like: Column) -> Column:
    return F.when(like == F.upper(like), F.upper(name)).otherwise(name)


def _new_initials(gap: Column, secret: str) -> Column:
    """Every capital becomes the next one in a keyed cycle of its alphabet."""
    for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"):
        cycle = "".join(sorted(letters, key=lambda c: sha256(f"{secret}|initial|{c}".encode()).digest()))
        gap = F.translate(gap, cycle, cycle[1:] + cycle[0])
    return gap


def _number(hexes: Column, at: int, digits: int = 7) -> Column:
    return F.conv(F.substring(hexes, at, digits), 16, 10).cast("long")


def _digits_of(hexes: Column) -> Column:
    """A string of 64 keyed decimal digits, one from every two hex digits of two hashes."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (F.conv(F.substr(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("int") % 10).cast("string")), "")


def _luhn_rest(digits: Column) -> Column:
    """Sum of a digit string under the card check, mod 10."""
    n = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda a, i: a + F.when((n - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(F.element_at(_lit_array([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), F.substr(digits, i, F.lit(1)).cast("int") + 1)),
        lambda a: a % 10,
    )


def _fill(layout: Column, digits: Column) -> Column:
    """``layout`` with its k-th digit replaced by the k-th of ``digits``."""
    start = F.struct(F.lit(1).alias("p"), F.lit("").alias("o"))
    return F.aggregate(
        F.split(layout, ""), start,
        lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct((a["p"] + 1).alias("p"), F.concat(a["o"], F.substr(digits, a["p"], F.lit(1))).alias("o"))).otherwise(F.struct(a["p"].alias("p"), F.concat(a["o"], c).alias("o"))),
        lambda a: a["o"],
    )


def _same_class(text: Column, hexes: Column) -> Column:
    """Letters become keyed letters of the same case, digits keyed digits; the rest stays."""
    def one(a, c):
        k = F.conv(F.substr(hexes, (a["p"] % 31) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        new = F.when(c.rlike("^[a-z]$"), F.char(k % 26 + 97)).when(c.rlike("^[A-Z]$"), F.char(k % 26 + 65)).when(c.rlike("^[0-9]$"), (k % 10).cast("string")).otherwise(c)
        return F.struct((a["p"] + 1).alias("p"), F.concat(a["o"], new).alias("o"))

    return F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("p"), F.lit("").alias("o")), one, lambda a: a["o"])


def _syllables(script: Column, hexes: Column, at: int, n: int) -> Column:
    def of(s):
        return F.concat(*[F.element_at(_lit_array(_SYLLABLES[s]), (_number(hexes, at + 2 * i, 2) % len(_SYLLABLES[s]) + 1).cast("int")) for i in range(n)])

    return F.when(script == "cyrillic", of("cyrillic")).otherwise(of("latin"))


def parts_of(surface: Column) -> Column:
    """Array of (part, type, canon): what of a surface form is replaced, and the entity behind it."""
    digits = F.regexp_replace(surface, "[^0-9]", "")
    # 00 is written for +, and a trunk zero in brackets after a country code is not dialled.
    dialled = F.regexp_replace(F.regexp_replace(surface, r"^00", "+"), TRUNK, "")
    american = surface.rlike(f"^(?:{AMERICAN})$")
    code = F.when(dialled.startswith("+"), "+").when(american & (F.length(digits) == 10), "+1").when(american, "+").otherwise("")
    phone = F.concat(code, F.regexp_replace(dialled, "[^0-9]", ""))
    title = F.regexp_extract(surface, f"^{TITLES}", 0)
    rest = F.regexp_replace(surface, f"^{TITLES}", "")
    gender = F.when(title.rlike(rf"(?:^| )(?:{MALE})[. ]"), "m").when(title.rlike(rf"(?:^| )(?:{FEMALE})[. ]"), "f").otherwise("n")
    script = F.when(surface.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")

    def entity(part, kind, canon):
        return F.struct(F.lit(part).alias("part"), kind.alias("type"), canon.alias("canon"))

    # The words behind the last space are the surname, those before it given names.
    n_given = F.size(_words(F.regexp_replace(rest, "(?:^| )[^ ]*$", "")))
    name = _let(n_given, lambda n: F.transform(_words(rest), lambda w, i: F.struct(i.alias("part"), F.when(i < n, F.concat_ws("_", F.lit("given"), gender, script)).otherwise(F.concat_ws("_", F.lit("surname"), script)).alias("type"), F.lower(w).alias("canon"))))
    return (
        F.when(surface.contains("@"), F.array(entity(0, F.lit("email"), F.lower(surface))))
        .when(surface.rlike(r"^\p{L}"), name)
        .when(surface.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.array(entity(0, F.lit("ssn"), digits)))
        .when(surface.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), F.array(entity(0, F.lit("ip"), surface)))
        .when(surface.rlike(f"^(?:{PHONE})$"), F.array(entity(0, F.lit("phone"), phone)))
        .otherwise(F.array(entity(0, F.lit("card"), digits)))
    )


def surrogate_of(kind: Column, canon: Column, attempt: Column, secret: str) -> Column:
    """The keyed surrogate of a canonical form."""
    seed = F.concat_ws("|", F.lit(secret), kind, canon, attempt.cast("string"))
    h = F.sha2(seed, 256)
    digits = _digits_of(h)
    n = F.length(canon)
    # A card keeps its length; its last digit is chosen so that the check still holds (or still fails by as much).
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(digits, F.lit(1), n - 2))
    card = F.transform(F.array(body), lambda b: F.concat(b, ((F.lit(20) + _luhn_rest(canon) - _luhn_rest(F.concat(b, F.lit("0")))) % 10).cast("string")))
    tld = F.regexp_extract(canon, r"\.([a-z]+)$", 1)
    email = F.concat(_same_class(F.substring_index(canon, "@", 1), h), F.lit("@"), F.substring(h, 50, 8), F.lit(".example."), F.when(tld.isin("com", "net", "org"), tld).otherwise(F.lit("com")))
    # Private addresses first, then the reserved ones from 240 up.
    ip = F.concat_ws(".", F.when(attempt < 6, 10).otherwise(_number(h, 20, 4) % 15 + 240).cast("string"), *[(_number(h, 1 + 4 * i, 4) % 254 + 1).cast("string") for i in range(3)])
    # International numbers keep their country code, so that distinct surrogates stay distinct when written out.
    code = F.regexp_extract(canon, COUNTRY, 0)
    phone = F.concat(code, F.substr(digits, F.lit(1), n - F.length(code)))
    script = F.substring_index(kind, "_", -1)
    gender = F.get(F.split(kind, "_"), F.lit(1))
    gender = F.when(gender == "n", F.when(_number(h, 60, 1) % 2 == 0, "m").otherwise("f")).otherwise(gender)

    def given_of(g, s):
        pool = GIVEN[g, s].split()
        return F.when(attempt < 3, F.element_at(_lit_array(pool), (_number(h, 1) % len(pool) + 1).cast("int"))).otherwise(F.initcap(F.concat(_syllables(F.lit(s), h, 10, 3), F.when(attempt > 5, _syllables(F.lit(s), h, 20, 2)).otherwise(F.lit("")), F.lit(_ENDS[g, s]))))

    given = F.when((gender == "m") & (script == "cyrillic"), given_of("m", "cyrillic")).when(script == "cyrillic", given_of("f", "cyrillic")).when(gender == "m", given_of("m", "latin")).otherwise(given_of("f", "latin"))
    longer = F.when(attempt > 2, _syllables(script, h, 30, 2)).otherwise(F.lit(""))
    surname = F.initcap(F.concat(_syllables(script, h, 10, 3), longer, F.when(script == "cyrillic", _ENDS["s", "cyrillic"]).otherwise(_ENDS["s", "latin"])))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", F.element_at(card, 1)).when(kind == "ssn", F.concat(F.lit("9"), F.substr(digits, F.lit(1), F.lit(8))))
        .when(kind == "phone", phone).when(kind.startswith("given"), given).otherwise(surname)
    )


def _spaces(todo: DataFrame) -> DataFrame:
    """(space, n, capacity): how many entities share a space of surrogates, and how many it has; names and e-mails have no end."""
    code = F.length(F.regexp_replace(F.regexp_extract("canon", COUNTRY, 0), r"\+", ""))
    free = F.length(F.regexp_replace("canon", "[^0-9]", "")) - F.when(F.col("type") == "phone", code).when(F.col("type") == "card", 2).otherwise(1)
    space = F.concat_ws("|", "type", F.when(F.col("type") == "phone", F.regexp_extract("canon", COUNTRY, 0)), F.when(F.col("type") != "ip", F.length("canon").cast("string")))
    capacity = F.when(F.col("type") == "ip", 16.0 * 254**3).otherwise(F.pow(F.lit(10.0), free))
    return todo.where(F.col("type").isin("phone", "card", "ssn", "ip")).groupBy(space.alias("space")).agg(F.count("*").alias("n"), F.max(capacity).alias("capacity"))


def surrogates(entities: DataFrame, secret: str, most_rounds: int = 60) -> DataFrame:
    """(type, canon, surrogate) for distinct (type, canon), with distinct surrogates within each family of types, none of which is an entity itself.

    Each round settles the entities without a collision; the rest (halved at
    least, as attempts are independent) tries again.  Raises before the first
    round where a space of numbers (those of a country code and length, card
    numbers of a length, addresses) is more than half full of entities.
    """
    family = F.substring_index("type", "_", 1)
    todo = materialize(entities.select("type", "canon").distinct(), "entities")
    full = _spaces(todo).where("2 * n > capacity").first()
    if full:
        raise ValueError(f"{full['n']} entities share the space {full['space']} of {full['capacity']:.0f} surrogates")
    taken = todo.select(family.alias("family"), F.lower("canon").alias("form"))
    done = None
    for attempt in range(most_rounds):
        new = todo.withColumn("surrogate", surrogate_of(F.col("type"), F.col("canon"), F.lit(attempt), secret)).withColumn("family", family).withColumn("form", F.lower("surrogate"))
        new = new.withColumn("rank", F.row_number().over(W.partitionBy("family", "form").orderBy("type", "canon")))
        bad = new.select("family", "form").distinct().join(taken, ["family", "form"], "left_semi").withColumn("hit", F.lit(True))
        new = materialize(new.join(bad, ["family", "form"], "left").withColumn("ok", (F.col("rank") == 1) & F.col("hit").isNull()), "surrogates")
        won = new.where("ok")
        done = won.select("type", "canon", "surrogate") if done is None else done.unionByName(won.select("type", "canon", "surrogate"))
        left = new.where("not ok")
        if left.isEmpty():
            return done
        taken = taken.unionByName(won.select("family", "form"))
        todo = left.select("type", "canon")
    raise ValueError("entities are left without a surrogate of their own")


def _neutral_resolved(parts: DataFrame) -> DataFrame:
    """Given names after a neutral title are the entity of the one gender that the name has elsewhere in the corpus, if it has one."""
    is_neutral = F.col("type").startswith("given_n_")
    script = F.substring_index("type", "_", -1)
    known = parts.where(F.col("type").startswith("given_") & ~is_neutral).select(script.alias("_script"), F.col("canon").alias("_canon"), "type").distinct()
    known = known.groupBy("_script", "_canon").agg(F.min("type").alias("_one"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    neutral = parts.where(is_neutral).join(known, (script == F.col("_script")) & (F.col("canon") == F.col("_canon")), "left")
    return parts.where(~is_neutral).unionByName(neutral.withColumn("type", F.coalesce("_one", "type")).select(parts.columns))


def _bare_renamed(piece: Column, names: Column, secret: str) -> Column:
    """(text, n): a piece of text with the capitalised words that ``names`` has ('g:' or 's:' and the word) replaced, and the number of mentions."""

    def of(words, gaps):
        def surrogate(w, i):
            given, surname = F.try_element_at(names, F.concat(F.lit("g:"), F.lower(w))), F.try_element_at(names, F.concat(F.lit("s:"), F.lower(w)))
            leads = (i + 1 < F.size(words)) & F.get(gaps, i + 1).rlike(BETWEEN)
            return _capitals(F.when(leads, F.coalesce(given, surname)).otherwise(F.coalesce(surname, given)), w)

        def built(new):
            def inside(i):
                return (i > 0) & F.get(new, i - 1).isNotNull() & F.get(new, i).isNotNull() & F.get(gaps, i).rlike(BETWEEN)

            kept = F.transform(gaps, lambda g, i: F.when(F.coalesce(inside(i), F.lit(False)), _new_initials(g, secret)).otherwise(g))
            n = F.size(F.filter(new, lambda x, i: x.isNotNull() & ~F.coalesce(inside(i), F.lit(False))))
            return F.struct(_woven(kept, F.zip_with(new, words, lambda a, b: F.coalesce(a, b))).alias("text"), n.alias("n"))

        return _let(F.transform(words, surrogate), built)

    return _let(F.struct(_words(piece).alias("w"), F.split(piece, WORD, -1).alias("g")), lambda x: of(x["w"], x["g"]))


def pseudonymise(docs: DataFrame, secret: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with the text rewritten, and ``n_entities`` (occurrences replaced).

    ``secret`` keys the surrogates; being part of native expressions it appears
    in query plans, so event logs of the job need the protection it has.
    """
    found = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_entities",)]
    d = docs.select(*kept, F.coalesce(found, F.array().cast("array<string>")).alias("_found"))
    row = F.sha2(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text)), 256)
    hits = materialize(d.where("size(_found) > 0").withColumn("_row", row), "hits")
    surface = materialize(hits.select("_row", F.explode(F.array_distinct("_found")).alias("surface")).distinct(), "surfaces")
    parts = surface.select("_row", "surface", F.explode(parts_of(F.col("surface"))).alias("e")).select("_row", "surface", "e.part", "e.type", "e.canon")
    # Digit runs of other lengths that fail the card check are no cards.
    parts = parts.where((F.col("type") != "card") | (_luhn_rest(F.col("canon")) == 0) | (F.length("canon") == 16))
    parts = _neutral_resolved(parts)
    table = surrogates(parts, secret)
    named = parts.join(table, ["type", "canon"])
    is_name = F.col("type").rlike("^(?:given|surname)_")
    key_of = F.concat(F.substring("type", 1, 1), F.lit(":"), F.col("canon"))
    per = named.groupBy("_row", "surface").agg(
        F.map_from_entries(F.collect_list(F.struct("part", "surrogate"))).alias("s"),
        F.max(F.struct("part", "type"))["type"].alias("type"),
        F.collect_list(F.when(is_name, F.struct(key_of.alias("key"), "type", "surrogate"))).alias("names"),
    )
    digits = F.try_element_at("s", F.lit(0))
    number = F.regexp_replace(digits, r"\+", "")
    # Digits that belong to no canonical form (00, a bracketed trunk zero) stand aside while the others are filled in.
    layout = F.regexp_replace(F.regexp_replace("surface", r"^00", "+"), TRUNK, "(o)")
    number = F.right(number, F.length(F.regexp_replace(layout, "[^0-9]", "")))  # a country code that isn't written stays away
    dialled = F.regexp_replace(F.regexp_replace(_fill(layout, number), r"\(o\)", "(0)"), r"^\+", F.when(F.col("surface").startswith("+"), "+").otherwise("00"))
    filled = F.when(F.col("type") == "phone", dialled).when(F.col("type").isin("card", "ssn"), _fill(F.col("surface"), number))
    filled = filled.when(F.col("type").isin("email", "ip"), digits)

    rest = F.regexp_replace("surface", f"^{TITLES}", "")
    gaps = F.transform(F.split(rest, WORD, -1), lambda g: _new_initials(g, secret))
    renamed = F.transform(_words(rest), lambda w, i: _capitals(F.try_element_at("s", i), w))
    filled = filled.otherwise(F.concat(F.regexp_extract("surface", f"^{TITLES}", 0), _woven(gaps, renamed)))
    # Words of names by role; one that has several genders in a text is the entity of the first type.
    first = _let(F.array_sort(F.flatten(F.collect_list("names"))), lambda a: F.filter(a, lambda x, i: (i == 0) | (x["key"] != F.get(a, i - 1)["key"])))
    names = F.map_from_entries(F.transform(first, lambda x: F.struct(x["key"].alias("key"), x["surrogate"].alias("surrogate"))))
    maps = per.select("_row", "surface", filled.alias("new"), "names").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("surface", "new"))).alias("_map"), names.alias("_names"))
    joined = hits.join(maps.withColumnRenamed("_row", "_r"), F.col("_row") == F.col("_r"), "left")
    between = F.transform(F.split(F.col(text), PATTERN, -1), lambda p: F.when(F.size("_names") > 0, _bare_renamed(p, F.col("_names"), secret)).otherwise(F.struct(p.alias("text"), F.lit(0).alias("n"))))
    new = F.transform("_found", lambda s: F.coalesce(F.try_element_at("_map", s), s))
    rewritten = _let(between, lambda b: F.struct(_woven(b["text"], new).alias("text"), F.aggregate(b["n"], F.lit(0), lambda x, y: x + y).alias("n")))
    joined = joined.withColumn("_new", rewritten)
    count = F.when(F.col("_map").isNull(), 0).otherwise(F.size(F.filter("_found", lambda s: F.map_contains_key("_map", s))) + F.col("_new")["n"])
    columns = [F.col("_new")["text"].alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != "n_entities"]
    out = joined.select(*columns, count.cast("long").alias("n_entities"))
    return out.unionByName(d.where("size(_found) = 0").select(*kept, F.lit(0).cast("long").alias("n_entities")))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key comes from ``spark.placeloom.surrogateSecret``; a session without it, as in tests, gets a fixed one."""
    secret = spark.conf.get("spark.placeloom.surrogateSecret", "surrogate-key-1")
    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), secret).select("doc_id", "text", "n_entities")
