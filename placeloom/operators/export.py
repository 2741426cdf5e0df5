"""Export scope, filters, summaries and the rows of the export files."""

from __future__ import annotations

import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.basics import truthy

DETAIL_GROUPS = 50


def area_match(area: Column, address: Column, wanted: list[str]) -> Column:
    """Canonical area equal to or containing a wanted one, either way; else the lower-case address contains it."""
    mine, test = text.area_canonical(area), F.lit(False)
    for w in {re.sub(r"\s+", " ", w.strip().lower()) for w in wanted}:
        w = text.area_canonical(F.lit(w))
        test = test | ((mine != "") & (mine.contains(w) | w.contains(mine))) | F.coalesce(F.lower(address).contains(w), F.lit(False))
    return test


def scope(df: DataFrame, kind: str = "all", areas: list[str] | None = None, selected: DataFrame | None = None, current: DataFrame | None = None, key: str = "rec_no") -> DataFrame:
    """Rows of an export scope; no areas means all, an empty selection none, an unknown kind all."""
    if kind == "current" and current is not None:
        return current
    if kind in ("area", "multiple_areas") and areas:
        return df.where(area_match(F.col("area"), F.col("address"), areas))
    if kind == "selected":
        return df.join(selected.select(key), key, "left_semi") if selected is not None else df.limit(0)
    return df


def export_filter(df: DataFrame, category: str | None = None, min_rating: float = 0, has_phone: bool = False, has_website: bool = False) -> DataFrame:
    """A row without a category passes the category filter; containment counts either way."""
    if category:
        c = F.coalesce(F.lower("category"), F.lit(""))
        df = df.where(c.contains(category.lower()) | F.lit(category.lower()).contains(c))
    if min_rating > 0:
        df = df.where(F.col("rating") >= min_rating)
    for on, one, many in ((has_phone, "phone", "phones"), (has_website, "website", "websites")):
        if on:
            df = df.where(truthy(F.col(one)) | (F.size(many) > 0) if many in df.columns else truthy(F.col(one)))
    return df


def summary(raw: int | DataFrame, unique: DataFrame, filtered: DataFrame, labels: list[str]) -> DataFrame:
    """The one row of totals; ``raw`` is a number or a frame of one row with the column ``raw``."""
    u, f = unique.agg(F.count("*").alias("unique")), filtered.agg(F.count("*").alias("filtered"))  # one row each
    t = u.crossJoin(f)
    t = t.withColumn("raw", F.lit(raw)) if isinstance(raw, int) else t.crossJoin(raw.select("raw"))
    return t.select(F.col("raw").cast("long").alias("raw"), (F.col("raw") - F.col("unique")).cast("long").alias("removed"), "unique", "filtered", F.lit(", ".join(labels) or "None").alias("filters"))


def _blank(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(""))


def number_text(c: Column) -> Column:
    """A number as the exports print it: without a fraction of zero."""
    d = c.cast("double")
    return F.when(d == F.floor(d), d.cast("long").cast("string")).otherwise(d.cast("string"))


def _shown(c: Column) -> Column:
    """A number, or nothing for null and zero."""
    return F.coalesce(F.when(c != 0, number_text(c)), F.lit(""))


def _percent(c: Column) -> Column:
    return F.coalesce(F.concat(c.cast("string"), F.lit("%")), F.lit(""))


def fixed_text(c: Column, places: int) -> Column:
    """A number with a fixed number of decimals; null stays null."""
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f", F.round(c.cast("double"), places)))


def _has(df: DataFrame):
    """Columns by name; those that a table lacks are null."""
    return lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")


def _full_address(get) -> Column:
    return text.full_address(*[get(c) for c in ("address", "area", "city", "district", "province")], F.coalesce(get("country"), F.lit(None).cast("string")))


def to_export(df: DataFrame) -> DataFrame:
    """Stored rows -> export records: empty text as null, the city as district, a default country."""
    get = _has(df)
    texts = [F.nullif(get(c), F.lit("")).alias(c) for c in ("category", "address", "area", "city", "phone", "website", "place_id", "maps_url")]
    rest = [get(c).alias(c) for c in ("latitude", "longitude", "rating", "review_count", "source")]
    country = F.coalesce(F.nullif(get("country"), F.lit("")), F.lit("Pakistan"))
    return df.select("rec_no", "business_name", *texts, F.nullif(get("city"), F.lit("")).alias("district"), country.alias("country"), *rest)


def business_rows(df: DataFrame) -> DataFrame:
    """The 21 columns of the businesses sheet; ``df`` has ``row_no`` and the (merged) record's columns."""
    get = _has(df)
    rest = lambda many, one: F.coalesce(F.array_join(F.filter(get(many), lambda x: ~x.eqNullSafe(get(one))), ", ") if many in df.columns else F.lit(None), F.lit(""))
    plain = lambda c: _blank(get(c)).alias(c)
    count = lambda c, name: F.coalesce(number_text(get(c)), F.lit("")).alias(name)
    return df.select(
        "row_no", plain("business_name"), plain("category"), _blank(_full_address(get)).alias("full_address"), *[plain(c) for c in ("address", "area", "city", "district", "province", "phone")],
        rest("phones", "phone").alias("more_phones"), plain("website"), rest("websites", "website").alias("more_websites"), *[count(c, c) for c in ("rating", "review_count", "latitude", "longitude")],
        _percent(get("completeness_pct")).alias("completeness"), _percent(get("confidence")).alias("confidence"), plain("group_id"), count("merged_record_count", "merged_records"),
    )


def csv_line(*columns: Column) -> Column:
    """One CSV line, byte for byte: blanks for null and empty, quotes doubled, quoted where needed."""
    def field(c):
        v = _blank(c)
        return F.when(v.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.concat_ws(",", *[field(c) for c in columns])


CSV_HEADER = "#,Name,Category,Address,Area,City,Country,Phone,Phone National,Email,Website,Google Maps URL,Rating,Review Count,Business Status,Price,Opening Hours,Data Completeness,Source,Latitude,Longitude"


def _stored(df: DataFrame) -> dict[str, Column]:
    """The 21 columns of the stored row's exports, as text; zero counts as missing."""
    get = _has(df)
    numbers = ("rating", "review_count", "latitude", "longitude")
    names = (
        "business_name", "category", "address", "area", "city", "country", "phone", "phone_national", "email", "website", "rating", "review_count", "business_status", "maps_url",
        "price", "opening_hours", "data_completeness", "source", "latitude", "longitude",
    )
    return {"row_no": F.col("row_no"), **{c: _shown(get(c)) if c in numbers else _blank(get(c)) for c in names}}


def csv_rows(df: DataFrame) -> DataFrame:
    """(row_no, line): the lines of the CSV export below ``CSV_HEADER``."""
    c = _stored(df)
    order = (
        "row_no", "business_name", "category", "address", "area", "city", "country", "phone", "phone_national", "email", "website", "maps_url", "rating", "review_count", "business_status",
        "price", "opening_hours", "data_completeness", "source", "latitude", "longitude",
    )
    return df.select("row_no", csv_line(*[c[x] for x in order]).alias("line"))


def legacy_rows(df: DataFrame) -> DataFrame:
    """The 21 columns of the single sheet."""
    return df.select(*[v.alias(k) for k, v in _stored(df).items()])


def table_rows(df: DataFrame) -> DataFrame:
    """The 10 columns of the single table: a dash for a missing rating or number of reviews."""
    c = _stored(df)
    dash = lambda x: F.when(c[x] == "", F.lit("-")).otherwise(c[x]).alias(x)
    plain = [c[x].alias(x) for x in ("row_no", "business_name", "category", "city", "phone", "website")]
    return df.select(*plain, dash("rating"), dash("review_count"), c["address"].alias("address"), c["maps_url"].alias("maps_url"))


def report_rows(df: DataFrame) -> DataFrame:
    """The 7 columns of the report's table: full address, rating with one decimal."""
    get = _has(df)
    rating = F.coalesce(fixed_text(get("rating"), 1), F.lit("-"))
    return df.select("row_no", *[_blank(get(c)).alias(c) for c in ("business_name", "category")], _blank(_full_address(get)).alias("full_address"), *[_blank(get(c)).alias(c) for c in ("phone", "website")], rating.alias("rating"))


def group_rows(groups: DataFrame, members: DataFrame, report: bool = False) -> DataFrame:
    """The 5 columns of the groups sheet, or of the report's table of groups."""
    own = members.select("component", "rec_no", "business_name")
    g = groups.join(own, (groups["component"] == own["component"]) & (groups["master"] == own["rec_no"])).drop(own["component"])
    size, score = F.col("n_members").cast("string"), number_text(F.col("group_score"))
    if report:
        size, score = F.concat(size, F.lit(" records")), F.concat(score, F.lit("%"))
    return g.select("group_id", _blank(F.col("business_name")).alias("master_business"), size.alias("merged_records"), score.alias("score"), F.array_join("reasons", "; ").alias("reason"))


def _members_of(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Members with their group's columns and the master's name."""
    g = groups.select("component", "group_id", "master", "group_score", "reasons")
    master = members.select(F.col("component").alias("_c"), F.col("rec_no").alias("_m"), F.col("business_name").alias("master_business"))
    g = g.join(master, (F.col("component") == F.col("_c")) & (F.col("master") == F.col("_m"))).drop("_c", "_m")
    return members.join(g, "component")


def merged_rows(groups: DataFrame, members: DataFrame) -> DataFrame:
    """The 13 columns of the merged records sheet, with ``rec_no`` for the order in a group."""
    m = _members_of(groups, members)
    get = _has(m)
    count = lambda c: F.coalesce(number_text(get(c)), F.lit(""))
    return m.select(
        "group_id", "rec_no", _blank(F.col("master_business")).alias("master_business"), _blank(get("business_name")).alias("business_name"), _blank(_full_address(get)).alias("full_address"),
        *[_blank(get(c)).alias(c) for c in ("address", "phone", "website", "category")], count("latitude").alias("latitude"), count("longitude").alias("longitude"),
        number_text(F.col("group_score")).alias("score"), F.array_join("reasons", "; ").alias("reason"), _blank(get("source")).alias("source"),
    )


def relevant_groups(groups: DataFrame, members: DataFrame, filtered: DataFrame, key: str = "rec_no") -> DataFrame:
    """Groups of which a member is among the filtered rows."""
    return groups.join(members.join(filtered.select(key), key, "left_semi").select("component").distinct(), "component", "left_semi")


def pdf_detail(groups: DataFrame, members: DataFrame) -> DataFrame:
    """The 8 columns of the detail pages: the members of the first ``DETAIL_GROUPS`` groups, numbered in each."""
    first = groups.orderBy(F.length("group_id"), "group_id").limit(DETAIL_GROUPS)
    m = _members_of(first, members)
    get = _has(m)
    place = F.row_number().over(W.partitionBy("group_id").orderBy("rec_no"))
    at = lambda c: F.coalesce(fixed_text(get(c), 5), F.lit(""))
    return m.select(
        "group_id", place.alias("no"), *[_blank(get(c)).alias(c) for c in ("business_name",)], _blank(_full_address(get)).alias("full_address"),
        *[_blank(get(c)).alias(c) for c in ("phone", "website", "area")], at("latitude").alias("latitude"), at("longitude").alias("longitude"),
    )


def report_summary(totals: DataFrame, request: str, kind: str, areas: list[str], groups: DataFrame) -> DataFrame:
    """(ord, line): the lines on top of the report, from the one row of ``summary``; the filters' line only if there are any."""
    n = groups.agg(F.count("*").alias("groups"))  # one row
    say = lambda label, v: F.concat(F.lit(f"{label}: "), v.cast("string"))
    lines = [
        say("Search Query", F.lit(f'"{request or "N/A"}"')), say("Export Scope", F.lit(kind)), say("Area(s)", F.lit(", ".join(areas) or "All")), say("Total Raw Results", F.col("raw")),
        say("Duplicates Removed", F.col("removed")), say("Unique Businesses", F.col("unique")), say("Exported", F.col("filtered")), say("Duplicate Groups", F.col("groups")),
        F.when(F.col("filters") != "None", say("Filters", F.col("filters"))),
    ]
    return totals.crossJoin(n).select(F.posexplode(F.array_compact(F.array(*lines))).alias("ord", "line"))


def file_name(category: str, areas: list[str] | None = None, prefix: str = "places", extension: str = "xlsx") -> str:
    """Prefix, the areas (none: ``All``) and the category, if there is one; other characters become underscores."""
    clean = lambda s: re.sub(r"[^A-Za-z0-9_]", "_", s)
    return "_".join([prefix, clean("_".join(areas)) if areas else "All", *([clean(category)] if category else [])]) + f".{extension}"


def file_name_column(category: Column, areas: Column, prefix: str = "places", extension: str = "xlsx") -> Column:
    """``file_name`` over columns; ``areas`` is an array."""
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    named = F.when(F.size(areas) > 0, clean(F.array_join(areas, "_"))).otherwise(F.lit("All"))
    return F.concat(F.concat_ws("_", F.lit(prefix), named, clean(F.nullif(category, F.lit("")))), F.lit(f".{extension}"))


def info_rows(totals: DataFrame, request: str, kind: str, areas: list[str], groups: DataFrame, when: Column | None = None) -> DataFrame:
    """Rows (ord, field, value) of the info sheet from the one row of ``summary``."""
    g = groups.agg(F.count("*").alias("groups"))  # one row
    value = {
        "Search Query": F.lit(request), "Export Scope": F.lit(kind), "Selected Area(s)": F.lit(", ".join(areas) or "All"), "Export Date": F.current_timestamp() if when is None else when,
        "Raw Result Count": F.col("raw"), "Duplicates Removed": F.col("removed"), "Unique Result Count": F.col("unique"), "Final Export Count": F.col("filtered"), "Duplicate Groups": F.col("groups"), "Filters Applied": F.col("filters"),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("field"), v.cast("string").alias("value")) for i, (k, v) in enumerate(value.items(), 1)])
    return totals.crossJoin(g).select(F.explode(rows).alias("x")).select("x.*")


def legacy_file_name(query: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(query), "[^a-z0-9]", "_"), 1, 40)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(csv_line(*[F.col(c) for c in columns]).alias("value")).write.mode("overwrite").text(path)


def write_json_document(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_xlsx(path: str, sheets: dict[str, DataFrame]) -> None:
    """Workbook with inline strings; rows stream to the driver one partition at a time (an export file, not a sink for tables)."""
    def cell(v):
        if v is None:
            return "<c/>"
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
        return f"<c><v>{v}</v></c>"

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {ns}><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, df in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<?xml version="1.0"?><worksheet {ns}><sheetData><row>{"".join(map(cell, df.columns))}</row>'.encode())
                for r in df.toLocalIterator():
                    f.write(f"<row>{''.join(map(cell, r))}</row>".encode())
                f.write(b"</sheetData></worksheet>")
