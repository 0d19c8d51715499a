"""Golden values of single functions."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factloom.functions import hebrew as H
from factloom.functions import numbers as N
from factloom.functions import text as T


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw, want", [("1,250,000", "1250000"), ("₪1,250,000", "1250000"), ("1.25 מ׳ ₪", "1250000"), ('1.25 מיליון ש"ח', "1250000"), ("2,500,000.50", "2500000.50"), ("1,25", None), ("-", None), (None, None), ("2000 מיליון", "2000")])
def test_money(spark, raw, want):
    assert one(spark, raw, N.parse_money) == (want and Decimal(want))


@pytest.mark.parametrize("raw, want", [("15/03/2024", date(2024, 3, 15)), ("15.03.24", date(2024, 3, 15)), ("5-1-2023", date(2023, 1, 5)), ("מרץ 2024", date(2024, 3, 1)), ("31/02/2024", None), ("1/1/69", date(2069, 1, 1)), ("1/1/70", date(1970, 1, 1)), ("soon", None), (None, None)])
def test_date(spark, raw, want):
    assert one(spark, raw, N.parse_date) == want


def test_area_and_types(spark):
    assert one(spark, "95 מ״ר נטו", N.parse_decimal) == 95 and one(spark, "95 מ״ר נטו", T.area_type_code) == "net"
    assert one(spark, "80", N.parse_decimal) == 80 and one(spark, "80", T.area_type_code) is None
    assert one(spark, "דירת גן", T.property_type_code) == "garden_apartment" and one(spark, "דירה", T.property_type_code) == "apartment" and one(spark, "Castle.", T.property_type_code) == "castle"
    assert one(spark, "לא כולל מע״מ", T.vat_basis_code) == "excluded" and one(spark, "כולל מע״מ", T.vat_basis_code) == "included"


@pytest.mark.parametrize("raw, want", [("6158/42/7", ("6158", "42", "7")), ("גוש 6158 חלקה 42 תת חלקה 7", ("6158", "42", "7")), ("גוש: 6158, חלקה: 42", ("6158", "42", None)), ("-", (None, None, None))])
def test_block_parcel(spark, raw, want):
    assert tuple(one(spark, raw, T.block_parcel)) == want


def test_normalize(spark):
    assert one(spark, "1,250,000 ₪ ו-3.5 חדרים", T.base_normalize) == "1250000 ₪ ו 3.5 חדרים"
    assert one(spark, "Ａ  B\n1,25", T.base_normalize) == "a b 1,25"
    assert one(spark, "ברמת גן", T.normalize_for_search) == "ברמת גן רמת"
    assert one(spark, "מה המחיר ברמת גן 2024?", T.query_tokens) == ["המחיר", "מחיר", "ברמת", "רמת", "גן", "2024"]


def test_phrases_and_numbers(spark):
    tokens = ["מחיר", "ברמת", "גן"]
    assert one(spark, tokens, lambda c: T.contains_phrase(c, "רמת גן"), "array<string>") and not one(spark, tokens, lambda c: T.contains_phrase(c, "רמת השרון"), "array<string>")
    assert one(spark, "1. cost 1,250.50 and 007 [E1] 3.0 x2", T.numbers_in) == ["1250.5", "7", "3"]
    assert one(spark, "20,000 in 2021", N.year_range)["year_from"] == 2021
    assert tuple(one(spark, "2024 עד 2022", N.year_range)) == (2022, 2024)


def test_price_checks(spark):
    d = spark.createDataFrame([(Decimal("1000000"), Decimal("50"), Decimal("21000")), (Decimal("3000000"), Decimal("100"), Decimal("30050")), (Decimal("1"), Decimal("0"), None)], "p decimal(16,2), a decimal(12,2), s decimal(14,2)")
    d = d.withColumn("c", N.price_per_area(F.col("p"), F.col("a")))
    rows = d.select("c", N.price_conflict(F.col("s"), F.col("c")).alias("x"), N.calculation_text(F.col("p"), F.col("a")).alias("t")).collect()
    assert [r.c for r in rows] == [Decimal("20000.00"), Decimal("30000.00"), None] and [r.x for r in rows] == [True, False, False]
    assert rows[0].t == "price / area = 1000000.00 / 50.00" and rows[2].t is None


def test_money_text(spark):
    d = spark.createDataFrame([(Decimal("1234567.00"),), (Decimal("1234.50"),), (None,)], "x decimal(16,2)")
    assert [r[0] for r in d.select(T.format_money(F.col("x"))).collect()] == ["1,234,567", "1,234.50", "—"]


def test_hebrew_order(spark):
    visual, logical = "14 ןפגה :סכנה תבותכ", "כתובת הנכס: הגפן 14"
    turned = {visual: logical, ")5( Tel Aviv םולש": "שלום Tel Aviv (5)", "12.5% A1 B2 7 :ךס": "סך: 7 A1 B2 12.5%", "[א) ב": "ב )א[", "": "", None: None}
    assert {v: one(spark, v, H.to_logical) for v in turned} == turned
    assert [one(spark, v, H.balanced, "string") for v in ("", "(a)[b]", ")(", "((", "([)]")] == [True, True, False, False, True]
    assert one(spark, visual, H.looks_visual) is True and one(spark, logical, H.looks_visual) is False and one(spark, "abc", H.looks_visual) is None
    d = spark.createDataFrame([(visual, visual), ("1,480,000 ₪", visual), ("plain text", visual), (logical, logical)], "line string, page string")
    assert [r[0] for r in d.select(H.fix_lines(F.col("line"), F.col("page"))).collect()] == [logical, "₪ 1,480,000", "plain text", logical]


def test_quality(spark):
    assert one(spark, "כתובת הנכס: הגפן 14, תל אביב", H.quality) == 1.0
    assert one(spark, "", H.quality) == 0.0 and one(spark, "אב", H.quality) == pytest.approx(2 / 15, abs=1e-3) and one(spark, "�" * 30, H.quality) == 0.0


def test_headers(spark):
    row = ["כתובת", "גוש/חלקה", "מחיר (₪)", ""]
    assert one(spark, row, T.is_header_row, "array<string>") and not one(spark, ["הגפן 14", "6158/42"], T.is_header_row, "array<string>")
    assert one(spark, row, T.units_for, "array<string>") == [None, None, "₪", None]
    snap = H.snap_headers(T.CANONICAL_HEADERS)
    assert one(spark, "שטח (מ'\"ר)", snap) == "שטח (מ״ר)" and one(spark, "אחר לגמרי", snap) == "אחר לגמרי"


def test_snippets_and_urls(spark):
    d = spark.createDataFrame([("First one. The price is here! Last", ["price"])], "t string, k array<string>")
    assert d.select(T.snippet(F.col("t"), F.col("k"))).first()[0] == "The price is here!"
    assert d.select(T.snippet(F.col("t"), F.col("k"), 5)).first()[0] == "The p…"
    assert spark.range(1).select(T.content_key(F.lit("a" * 64)), T.content_key(F.lit("../x"))).first()[1] is None


def test_keyed_digest(spark):
    import hashlib
    import hmac

    for key in (b"k", b"x" * 64, b"y" * 100):
        assert one(spark, "שלום", lambda c, key=key: T.hmac_sha256(c, key)) == hmac.new(key, "שלום".encode(), hashlib.sha256).hexdigest()


def test_area_with_type(spark):
    assert [tuple(one(spark, raw, N.area_with_type)) for raw in ("95 מ״ר נטו", "80", "ברוטו")] == [(Decimal("95"), "net"), (Decimal("80"), None), (None, "gross")]
