"""Text functions as Column builders; only NFKC needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Hebrew prefixes, stop words, dictionaries and patterns of the domain.
PREFIXES = "והבלמשכ"
TWO_LETTER_PREFIXES = ("וה", "וב", "ול", "ומ", "וש", "שה", "מה", "בה", "לה", "כש", "שב", "של", "שמ")
STOPWORDS = tuple(
    "מה מי איך למה מדוע האם על של את עם זה זו זאת אלה כל או גם אם כי לא יש אין הוא היא הם הן היה היו "
    "בין עד כמה איזה איזו אילו לגבי נכתב נאמר כתוב אני אנחנו יותר פחות כמו רק עוד אותו אותה שם פה "
    "ומה ועל ושל ואת וגם ואם במה בזה לזה מזה כך כן בכ כ- "
    "מסמך מסמכים במסמך במסמכים בשומות שומות המסמכים במאגר מאגר נכתבו נכתבה הוזכר הוזכרו מופיע".split()
)
PROPERTY_TYPES = (
    ("דירת גן", "garden_apartment"), ("פנטהאוז", "penthouse"), ("פנטהאוס", "penthouse"), ("דופלקס", "duplex"),
    ("קוטג׳", "cottage"), ("קוטג'", "cottage"), ("בית פרטי", "house"), ("דירה", "apartment"),
    ("משרד", "office"), ("חנות", "retail"), ("מגרש", "land"),
)
AREA_TYPES = (
    ("נטו", "net"), ("ברוטו", "gross"), ("רשום", "registered"), ("רשומה", "registered"),
    ("אקוויוולנטי", "equivalent"), ("אקויוולנטי", "equivalent"), ("אקוולנטי", "equivalent"),
)
HEADER_VOCABULARY = ("כתובת", "גוש", "חלקה", "תאריך", "שטח", "מחיר", "סוג", "חדרים", "קומה", "רחוב", "עסקה", "שווי", "יחידה")
CANONICAL_HEADERS = ("כתובת", "גוש/חלקה", "תאריך עסקה", "סוג נכס", "חדרים", "שטח (מ״ר)", "סוג שטח", "מחיר (₪)", "מחיר למ״ר (₪)", "קומה", "שווי (₪)")
HEBREW_LETTER = "[א-ת]"
HEBREW_WORD = "[א-ת][א-ת״׳]*"
BIDI_CONTROLS = "[‎‏‪-‮⁦-⁩؜]"
HEADING = r"^\s*\d{1,2}\.\s+\S"
FOOTER = r"(^|\|)\s*עמוד\s+\d+(\s+מתוך\s+\d+)?\s*$"
PAGE_NUMBER_ONLY = r"^[\s\-–—]*\d{1,4}[\s\-–—]*$"
PLACE_TRIM = " .,:;"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition; plain ASCII passes through."""
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def contains_any(text: Column, words) -> Column:
    """Whether any of the words occurs in the text."""
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))


def first_code(text: Column, table) -> Column:
    """The code of the first table entry whose word occurs in the text; order matters."""
    out = F.lit(None).cast("string")
    for word, code in reversed(list(table)):
        out = F.when(F.contains(text, F.lit(word)), F.lit(code)).otherwise(out)
    return F.when(text.isNotNull(), out)


def base_normalize(text: Column, compose: bool = True) -> Column:
    """Shared comparison form: composed, without vowel points, unified quotes, plain numbers, single blanks, lower case."""
    # Only texts beyond ASCII cross to Python. The patterns are fixed values: equal texts must have equal forms.
    t = F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text) if compose else text
    t = F.regexp_replace(t, "[֑-ׇ]", "")
    t = F.regexp_replace(t, "(?<=[א-ת])[\"“”״](?=[א-ת])", "״")
    t = F.regexp_replace(t, "(?<=[א-ת])['`’‘]", "׳")
    t = F.regexp_replace(t, "₪", " ₪ ")
    t = F.regexp_replace(t, r"(?<=[א-ת])-(?=\d)", " ")
    # A separator goes if exactly three digits follow; all of a number's separators go in one pass.
    t = F.regexp_replace(t, r"(?<=\d)[,٬](?=\d{3}(?!\d)|\d{3}(?:[,٬]\d{3})+(?!\d))", "")
    return F.lower(F.trim(F.regexp_replace(t, r"[\s ]+", " ")))


def prefix_variants(word: Column) -> Column:
    """The word without each two-letter prefix that leaves two letters, and without a one-letter prefix of a word of four."""
    two = F.filter(F.array(*(F.lit(p) for p in TWO_LETTER_PREFIXES)), lambda p: F.startswith(word, p) & (F.length(word) >= 4))
    one = F.when(F.substring(word, 1, 1).isin(*PREFIXES) & (F.length(word) >= 4), F.array(F.substring(word, 2, 1_000_000))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(two, lambda p: F.substring(word, F.lit(3), F.length(word))), one)


def normalize_for_search(text: Column) -> Column:
    """Index form: the normalized text and the prefix variants of its Hebrew words."""
    base = base_normalize(text)
    extra = F.flatten(F.transform(F.regexp_extract_all(base, F.lit(HEBREW_WORD), F.lit(0)), prefix_variants))
    return F.when(F.size(extra) > 0, F.concat_ws(" ", base, F.array_join(extra, " "))).otherwise(base)


def query_tokens(query: Column) -> Column:
    """Search terms in order of first appearance: words that carry a signal, each followed by its prefix variants."""
    words = F.transform(F.regexp_extract_all(base_normalize(query), F.lit(r"[\p{L}\p{N}_״׳./]+"), F.lit(0)), lambda w: F.regexp_replace(w, r"^[./\-׳״]+|[./\-׳״]+$", ""))
    letters = lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", ""))
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    kept = F.filter(words, lambda w: ~F.array_contains(stop, w) & ((letters(w) >= 2) | w.rlike(r"\d")))
    grown = F.transform(kept, lambda w: F.concat(F.array(w), F.when(w.rlike(f"^{HEBREW_WORD}$"), prefix_variants(w)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.flatten(grown))


def normalize_place(raw: Column, compose: bool = True) -> Column:
    return F.nullif(F.btrim(base_normalize(raw, compose), F.lit(PLACE_TRIM)), F.lit(""))


def property_type_code(raw: Column) -> Column:
    """A stable code, or the normalized text of an unknown type."""
    return let(normalize_place(raw), lambda p: F.coalesce(first_code(p, PROPERTY_TYPES), p))


def vat_basis_code(raw: Column) -> Column:
    """Excluded is looked for first, because its phrase holds the other."""
    return let(normalize_place(raw), lambda p: F.coalesce(first_code(p, (("לא כולל", "excluded"), ("כולל", "included"))), p))


def area_type_code(raw: Column) -> Column:
    return first_code(raw, AREA_TYPES)


def block_parcel(raw: Column) -> Column:
    """struct(block, parcel, sub_parcel) of a labelled or a slashed form."""
    labelled = r"גוש\D*(\d+)\D+חלקה\D*(\d+)(?:\D+תת[ -]?חלקה\D*(\d+))?"
    slashed = r"(\d+)\s*/\s*(\d+)(?:\s*/\s*(\d+))?"
    pick = lambda k: F.nullif(F.when(raw.rlike(labelled), F.regexp_extract(raw, labelled, k)).otherwise(F.regexp_extract(raw, slashed, k)), F.lit(""))
    return F.struct(pick(1).alias("block"), pick(2).alias("parcel"), pick(3).alias("sub_parcel"))


def strip_bidi_controls(text: Column) -> Column:
    return F.regexp_replace(text, BIDI_CONTROLS, "")


def is_heading(line: Column) -> Column:
    s = F.trim(line)
    return s.rlike(HEADING) & s.rlike(HEBREW_LETTER) & (F.length(s) <= 80) & ~s.rlike("[.:,]$") & (F.size(F.split(s, r"\s+")) <= 9)


def is_footer(line: Column) -> Column:
    s = F.trim(line)
    return (s != "") & (((F.length(s) <= 80) & s.rlike(FOOTER)) | s.rlike(PAGE_NUMBER_ONLY))


def clean_cell(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def is_header_row(cells: Column) -> Column:
    """At least two filled cells, and half of them (two at least) without digits and with a known header word."""
    filled = F.filter(F.transform(cells, clean_cell), lambda c: c != "")
    hits = F.filter(filled, lambda c: ~c.rlike(r"\d") & contains_any(c, HEADER_VOCABULARY))
    return (F.size(filled) >= 2) & (F.size(hits) >= F.greatest(F.lit(2), F.ceil(F.size(filled) / 2)))


def units_for(headers: Column) -> Column:
    return F.transform(headers, lambda h: F.nullif(F.trim(F.regexp_extract(F.coalesce(h, F.lit("")), r"\(([^()]+)\)", 1)), F.lit("")))


def render_row(headers: Column, cells: Column) -> Column:
    """``header: value`` pairs of the filled cells; without headers, the values alone."""
    named = F.transform(cells, lambda c, i: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.coalesce(F.nullif(F.get(headers, i), F.lit("")), F.concat(F.lit("עמודה "), (i + 1).cast("string"))), F.lit(": "), c)))
    bare = F.filter(cells, lambda c: F.coalesce(c, F.lit("")) != "")
    return F.when(F.coalesce(F.size(headers), F.lit(0)) < 1, F.array_join(bare, " | ")).otherwise(F.array_join(F.filter(named, lambda c: c.isNotNull()), " | "))


def escape_like(text: str) -> str:
    """A literal for LIKE: the reader's wildcards stand for themselves."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def substring_filter(column: Column, wanted: str | None) -> Column | None:
    """Case-insensitive substring test, or nothing where nothing is asked."""
    return None if wanted is None else column.ilike(f"%{escape_like(wanted)}%")


def source_url(document_id: Column, version_id: Column, page: Column) -> Column:
    base = F.concat(F.lit("/api/documents/"), document_id, F.lit("/versions/"), version_id, F.lit("/file"))
    return F.when(page.isNull(), base).otherwise(F.concat(base, F.lit("#page="), page.cast("string")))


def contains_phrase(tokens: Column, phrase: str) -> Column:
    """Whether the words stand in a row among the tokens, the first one possibly behind a prefix."""
    words = phrase.split()
    n = len(words)
    head = F.lit(words[0])

    def opens(token: Column) -> Column:
        glued = (F.length(token) > 1) & F.substring(token, 1, 1).isin(*"בלמהושכ") & (F.substring(token, F.lit(2), F.length(token)) == head)
        return (token == head) | glued | F.array_contains(prefix_variants(token), head)

    tail = F.array(*(F.lit(w) for w in words[1:])).cast("array<string>")
    places = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.exists(places, lambda i: opens(F.element_at(tokens, i)) & (F.slice(tokens, i + 1, n - 1) == tail))


def numbers_in(text: Column) -> Column:
    """Distinct numbers of a text in canonical decimal form; citations and list ordinals don't count."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\[E\d+\]", " "), r"(?m)^\s*\d{1,2}[.)]\s", " ")
    found = F.regexp_extract_all(plain, F.lit(r"(?<![\p{L}\p{N}_])\d[\d,]*(?:\.\d+)?"), F.lit(0))
    bare = F.transform(found, lambda n: F.regexp_replace(F.regexp_replace(n, ",", ""), r"^0+(?=\d)", ""))
    return F.array_distinct(F.transform(bare, lambda n: F.when(n.contains("."), F.regexp_replace(n, r"\.?0+$", "")).otherwise(n)))


def snippet(text: Column, tokens: Column, width: int = 280) -> Column:
    """The sentence whose normalized form has most of the tokens (the first of equals), cut at width."""
    cut = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n"), lambda s: F.trim(s)), lambda s: s != "")
    plain = lambda s: base_normalize(s, compose=False)
    score = lambda s: let(plain(s), lambda n: F.size(F.filter(tokens, lambda t: F.contains(n, t))))
    none = F.struct(F.lit(-1).alias("n"), F.lit("").alias("s"))
    best = F.aggregate(cut, none, lambda a, s: F.when(score(s) > a["n"], F.struct(score(s).alias("n"), s.alias("s"))).otherwise(a))["s"]
    chosen = F.when(F.size(cut) == 0, F.substring(text, 1, width)).otherwise(best)
    return F.when((F.size(cut) > 0) & (F.length(chosen) > width), F.concat(F.substring(chosen, 1, width), F.lit("…"))).otherwise(chosen)


def format_money(value: Column) -> Column:
    """Grouped digits, two decimals only where they aren't zero, a dash for null."""
    return F.when(value.isNull(), F.lit("—")).when(value == F.round(value, 0), F.format_number(value, 0)).otherwise(F.format_number(value, 2))


def forbidden_markup(text: Column) -> Column:
    return text.rlike(r"(https?://|www\.|!\[|\]\(|<[a-zA-Z/])")


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Keyed digest in lowercase hex, for tokens that are stored but never shown."""
    import hashlib

    own = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in own))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def content_key(sha256: Column) -> Column:
    """Storage key of a blob, null for what is no sha-256 digest."""
    return F.when(sha256.rlike("^[0-9a-f]{64}$"), F.concat_ws("/", F.substring(sha256, 1, 2), F.substring(sha256, 3, 2), sha256))
