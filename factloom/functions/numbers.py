"""Numbers, dates, money and arrays as Column builders; what can't be parsed is null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Month names, million marks, critical fields and tolerances.
MONTHS = {
    "ינואר": 1, "פברואר": 2, "מרץ": 3, "מרס": 3, "אפריל": 4, "מאי": 5, "יוני": 6, "יולי": 7,
    "אוגוסט": 8, "ספטמבר": 9, "אוקטובר": 10, "נובמבר": 11, "דצמבר": 12,
}
MILLION = "(מ׳|מ'|מיליון|מליון)"
CRITICAL = {
    "transaction_price": ("price", "area", "transaction_date", "city"),
    "appraised_value": ("price", "area", "valuation_date", "city"),
    "asking_price": ("price", "area", "city"),
    "adjusted_comparable": ("price", "area", "city"),
}
CONFLICT_TOLERANCE = "0.005"
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"


def parse_decimal(raw: Column, kind: str = "decimal(18,4)") -> Column:
    """The first number; commas only as separators of thousands."""
    grouped = r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"
    number = lambda t: F.when((t != "") & (~t.contains(",") | t.rlike(grouped)), F.regexp_replace(t, ",", "").try_cast(kind))
    return let(F.regexp_extract(F.regexp_replace(raw, "[‎‏]", ""), f"({NUMBER})", 1), number)


def parse_money(raw: Column) -> Column:
    grown = lambda v: F.when(raw.rlike(MILLION) & (v < 1000), (v * 1_000_000).cast("decimal(18,2)")).otherwise(v.cast("decimal(18,2)"))
    return let(parse_decimal(raw, "decimal(16,4)"), grown)


def parse_date(raw: Column) -> Column:
    """Day, month, year by points, strokes or slashes (two-digit years pivot at 70); else a month's name and a year."""
    numeric = r"(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})"
    part = lambda k: F.regexp_extract(raw, numeric, k).try_cast("int")
    year = F.when(part(3) >= 100, part(3)).when(part(3) < 70, part(3) + 2000).otherwise(part(3) + 1900)
    iso = F.format_string("%04d-%02d-%02d", year, part(2), part(1))
    named = r"([א-ת]+)\s+(\d{4})"
    months = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    month = F.try_element_at(months, F.regexp_extract(raw, named, 1))
    by_name = F.when(month.isNotNull(), F.format_string("%s-%02d-01", F.regexp_extract(raw, named, 2), month))
    return F.try_to_date(F.when(raw.rlike(numeric), iso).when(raw.rlike(named), by_name), "yyyy-MM-dd")


def area_with_type(raw: Column) -> Column:
    """struct(area, area_type) of a text like ``95 sqm net``; either part may be null."""
    from .text import area_type_code

    return F.struct(parse_decimal(raw).alias("area"), area_type_code(raw).alias("area_type"))


def price_per_area(price: Column, area: Column) -> Column:
    """Half up to cents; null without a positive area."""
    return F.when(area > 0, F.round(price.cast("decimal(18,2)") / area.cast("decimal(12,2)"), 2)).cast("decimal(14,2)")


def price_conflict(stated: Column, computed: Column) -> Column:
    """Whether the stated value is off by more than the tolerance."""
    s, c = stated.cast("decimal(14,2)"), computed.cast("decimal(14,2)")
    return F.coalesce((c > 0) & (F.abs(s - c) / F.nullif(c, F.lit(0).cast("decimal(14,2)")) > F.lit(CONFLICT_TOLERANCE).cast("decimal(4,3)")), F.lit(False))


def calculation_text(price: Column, area: Column) -> Column:
    return F.when(area > 0, F.concat(F.lit("price / area = "), price.cast("string"), F.lit(" / "), area.cast("string")))


def missing_critical(kind: Column, value_of=F.col) -> Column:
    """Names of the kind's critical fields that are null."""
    out = F.array().cast("array<string>")
    for name, fields in CRITICAL.items():
        own = F.filter(F.array(*(F.when(value_of(f).isNull(), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
        out = F.when(kind == name, own).otherwise(out)
    return out


def year_range(text: Column) -> Column:
    """struct(year_from, year_to): the two ends of a range, else the first year alone."""
    year = r"19[5-9]\d|20\d{2}"
    span = rf"(?<!\d)({year})\s*(?:-|–|עד|ל-?|ול-?)\s*({year})(?!\d)"
    a, b = (F.regexp_extract(text, span, k).try_cast("int") for k in (1, 2))
    one = F.regexp_extract(text, rf"(?<!\d)({year})(?!\d)", 1).try_cast("int")
    return F.struct(F.when(text.rlike(span), F.least(a, b)).otherwise(one).alias("year_from"), F.when(text.rlike(span), F.greatest(a, b)).alias("year_to"))


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(300), 5 * F.pow(F.lit(2), F.greatest(F.lit(0), attempts - 1))).cast("int")


def idf(total: Column, frequency: Column) -> Column:
    return F.log((F.greatest(total, F.lit(1)) + 1) / (frequency + 0.5))


def page_list(page: Column) -> Column:
    """Aggregate: distinct sorted pages, null for none."""
    pages = F.array_sort(F.collect_set(page))
    return F.when(F.size(pages) > 0, pages)


def unit_vector(vector: Column) -> Column:
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    x, y = a.cast("array<double>"), b.cast("array<double>")
    return dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0))


def stored_vector(vector: Column) -> Column:
    """Six decimals, as vectors are stored and queried."""
    return F.transform(vector.cast("array<double>"), lambda x: F.round(x, 6))


def parse_correction(field: str, value: Column) -> Column:
    """A reviewer's text under the rules of its field; negative numbers are null."""
    from .text import normalize_place, property_type_code

    if field in ("price", "price_per_sqm_stated"):
        v = parse_money(value)
        return F.when(v >= 0, v)
    if field in ("area", "rooms"):
        v = parse_decimal(value)
        return F.when(v >= 0, v)
    if field.endswith("_date"):
        return parse_date(value)
    return property_type_code(value) if field == "property_type" else normalize_place(value)
