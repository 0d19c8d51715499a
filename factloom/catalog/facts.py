"""Identity, extraction, chunking and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import documents as D
from ..operators import identity as I
from ..operators import review as V
from .registry import query

FACTS = """facts AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS id, 'b' || l_partkey AS block, CAST(l_suppkey % 5 AS VARCHAR) AS parcel,
  CASE WHEN l_linenumber > 3 THEN CAST(l_linenumber AS VARCHAR) END AS sub_parcel, CASE WHEN l_returnflag = 'R' THEN 'appraised_value' ELSE 'transaction_price' END AS data_kind,
  CAST(l_shipdate AS DATE) AS transaction_date, CAST(l_extendedprice AS DECIMAL(16,2)) AS price, CAST(l_quantity AS DECIMAL(12,2)) AS area, l_linestatus AS area_type FROM lineitem)"""


def _facts(t):
    """Records of the line items; a number follows from the whole row's order."""
    c = F.col
    rows = t.lineitem.select(
        F.concat(F.lit("b"), c("l_partkey").cast("string")).alias("block"), (c("l_suppkey") % 5).cast("string").alias("parcel"),
        F.when(c("l_linenumber") > 3, c("l_linenumber").cast("string")).alias("sub_parcel"), F.lit(None).cast("string").alias("address"),
        F.when(c("l_returnflag") == "R", "appraised_value").otherwise("transaction_price").alias("data_kind"), c("l_shipdate").cast("date").alias("transaction_date"),
        c("l_extendedprice").cast("decimal(16,2)").alias("price"), c("l_quantity").cast("decimal(12,2)").alias("area"), c("l_linestatus").alias("area_type"),
    )
    return rows


@query(f"""WITH {FACTS} SELECT key, count(*) AS occurrences FROM (SELECT 'bp:' || block || '/' || parcel || '/' || coalesce(sub_parcel, '-') || '|' || data_kind || '|' || CAST(transaction_date AS VARCHAR) || '|' ||
  CAST(price AS VARCHAR) || '|' || CAST(area AS VARCHAR) || '|' || area_type AS key FROM facts WHERE data_kind <> 'appraised_value') GROUP BY key""")
def certain_match_dedup(t):
    """Facts by their match key; kinds that aren't matched have none."""
    keyed = _facts(t).withColumn("key", I.match_key(I.location_key())).where("key IS NOT NULL")
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("occurrences"))


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey AS place, o_orderpriority AS data_kind, CAST(o_orderdate AS DATE) AS transaction_date, CAST(o_totalprice AS DECIMAL(16,2)) AS price, o_orderstatus AS area_type FROM orders)
  SELECT x.id AS a, y.id AS b, 'אותו מיקום; שונה: ' || coalesce(nullif(array_to_string(list_filter([CASE WHEN x.transaction_date IS DISTINCT FROM y.transaction_date THEN 'תאריך' END, CASE WHEN x.price IS DISTINCT FROM y.price THEN 'מחיר' END,
    CASE WHEN x.area_type IS DISTINCT FROM y.area_type THEN 'סוג שטח' END], lambda v: v IS NOT NULL), ', '), ''), 'פרטים חסרים') AS reason
  FROM f x JOIN f y ON x.place = y.place AND x.id < y.id AND (x.transaction_date = y.transaction_date OR x.price = y.price) AND x.data_kind = y.data_kind""")
def lookalike_pairs(t):
    """Pairs at one place that share the date or the price, with what differs."""
    c = F.col
    f = t.orders.select(c("o_orderkey").alias("id"), c("o_custkey").alias("place"), c("o_orderpriority").alias("data_kind"), c("o_orderdate").cast("date").alias("transaction_date"), c("o_totalprice").cast("decimal(16,2)").alias("price"), F.lit(None).cast("decimal(12,2)").alias("area"), c("o_orderstatus").alias("area_type"))
    return I.look_alikes(f, ["place"], "id")


@query("""SELECT o_orderkey AS occurrence_id, CASE WHEN o_shippriority IS NULL OR o_shippriority = ruling THEN first_id ELSE o_orderkey END AS transaction_id,
  CASE WHEN o_shippriority IS NOT NULL AND o_shippriority <> ruling THEN first_id END AS differs_from
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS o_shippriority, first_value(o_orderkey) OVER w AS first_id,
    first_value(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END IGNORE NULLS) OVER w AS ruling FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""")
def attach_occurrences(t):
    """Occurrences of one key join its first transaction unless they state another property type."""
    c = F.col
    occ = t.orders.select(c("o_orderkey").alias("occurrence_id"), c("o_custkey").cast("string").alias("match_key"), F.when(c("o_orderkey") % 4 != 0, c("o_orderstatus")).alias("property_type"))
    return I.attach(occ, ["occurrence_id"]).select("occurrence_id", "transaction_id", "differs_from")


@query("""SELECT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT CAST(l_partkey AS VARCHAR) AS x, CAST(l_suppkey AS VARCHAR) AS y FROM lineitem) WHERE x <> y GROUP BY ALL""")
def candidate_pairs(t):
    """Each unordered pair once, the ends in string order."""
    pairs = t.lineitem.select(F.col("l_partkey").cast("string").alias("a"), F.col("l_suppkey").cast("string").alias("b"))
    return I.ordered_pairs(pairs)


@query("""WITH RECURSIVE m AS (SELECT s_suppkey AS loser, s_suppkey - 1 AS survivor FROM supplier WHERE s_suppkey % 8 <> 0 AND s_suppkey > 0),
  chain AS (SELECT loser, survivor FROM m UNION ALL SELECT c.loser, m.survivor FROM chain c JOIN m ON c.survivor = m.loser),
  final AS (SELECT loser, min(survivor) AS survivor FROM chain GROUP BY loser)
  SELECT coalesce(survivor, l_suppkey) AS transaction_id, count(*) AS n FROM lineitem LEFT JOIN final ON loser = l_suppkey GROUP BY 1""")
def merged_transactions(t):
    """Occurrences under the survivors of merges, chains followed to their ends."""
    merges = t.supplier.where("s_suppkey % 8 != 0 AND s_suppkey > 0").select(F.col("s_suppkey").alias("loser"), (F.col("s_suppkey") - 1).alias("survivor"))
    occ = t.lineitem.select(F.col("l_suppkey").alias("transaction_id"))
    return I.apply_merges(occ, I.resolve_merges(merges)).groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"))


RECORDS = """r AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS address, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(16,2)) AS price FROM orders),
  fix AS (SELECT l_orderkey AS id, arg_max(CAST(l_extendedprice AS DECIMAL(16,2)), (l_linenumber, l_extendedprice)) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
  f AS (SELECT r.id, address, day, coalesce(fix.price, r.price) AS price, CASE WHEN fix.price IS NULL THEN 'auto_extracted' ELSE 'corrected' END AS status FROM r LEFT JOIN fix USING (id))"""


@query(f"WITH {RECORDS} SELECT id AS occurrence_id, price, round(CAST(price / 40 AS DECIMAL(18,4)), 2) AS computed, status, min(id) OVER (PARTITION BY address, day, price) AS transaction_id FROM f")
def corrected_records(t):
    """Corrections overlaid, prices per area computed anew, and every record identified by its present values."""
    c = F.col
    none = lambda kind: F.lit(None).cast(kind)
    records = t.orders.select(
        c("o_orderkey").alias("occurrence_id"), F.lit("transaction_price").alias("data_kind"), c("o_custkey").cast("string").alias("address"), *(none("string").alias(n) for n in ("block", "parcel", "sub_parcel", "property_type")),
        c("o_orderdate").cast("date").alias("transaction_date"), c("o_totalprice").cast("decimal(16,2)").alias("price"), F.lit(40).cast("decimal(12,2)").alias("area"), F.lit("net").alias("area_type"),
        none("decimal(14,2)").alias("stated"), F.lit(False).alias("ocr"), F.lit("auto_extracted").alias("status"),
    )
    fixes = t.lineitem.where("l_returnflag = 'R'").select(c("l_orderkey").alias("occurrence_id"), F.lit("price").alias("field"), c("l_extendedprice").cast("decimal(16,2)").cast("string").alias("value"), F.struct("l_linenumber", "l_extendedprice").alias("at"))
    return V.reidentify(V.correct(records, fixes), ["occurrence_id"]).select("occurrence_id", "price", c("computed").cast("decimal(18,2)").alias("computed"), "status", "transaction_id")


@query("""SELECT l_partkey AS transaction_id, CAST(min(l_extendedprice) AS DECIMAL(16,2)) AS price, count(*) AS sources, count(DISTINCT l_returnflag) AS kinds, arg_min(l_orderkey, (l_suppkey, l_orderkey, l_linenumber)) AS first FROM lineitem GROUP BY 1""")
def fact_summaries(t):
    """Facts nested with their sources."""
    c = F.col
    rows = t.lineitem.select(c("l_partkey").alias("transaction_id"), c("l_extendedprice").cast("decimal(16,2)").alias("price"), c("l_quantity").cast("decimal(12,2)").alias("area"), c("l_returnflag").alias("property_type"), c("l_suppkey").alias("document_id"), c("l_orderkey").alias("version_id"), c("l_linenumber").alias("page_no"), F.lit(0).alias("row_index"), F.lit(0).alias("occurrence_id"))
    return I.summaries(rows).select("transaction_id", "price", F.size("sources").cast("long").alias("sources"), F.size("property_types").cast("long").alias("kinds"), c("sources")[0]["version_id"].alias("first"))


@query("SELECT DISTINCT l_orderkey AS version_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def touched_versions(t):
    """Versions that a set of facts touches."""
    rows = t.lineitem.select(F.col("l_partkey").alias("transaction_id"), F.col("l_orderkey").alias("version_id"))
    return I.versions_of(rows, t.part.where("p_size > 45").select(F.col("p_partkey").alias("transaction_id")))


MERGES = "m AS (SELECT s_suppkey AS loser, s_suppkey - s_suppkey % 8 AS survivor FROM supplier WHERE s_suppkey % 8 <> 0), pairs AS (SELECT l_suppkey AS a, l_partkey AS b, l_returnflag AS reason FROM lineitem WHERE l_quantity > 45)"


@query(f"""WITH {MERGES}, p AS (SELECT coalesce(x.survivor, a) AS a, coalesce(y.survivor, b) AS b, reason FROM pairs LEFT JOIN m x ON x.loser = a LEFT JOIN m y ON y.loser = b)
  SELECT CASE WHEN CAST(a AS VARCHAR) > CAST(b AS VARCHAR) THEN b ELSE a END AS a, CASE WHEN CAST(a AS VARCHAR) > CAST(b AS VARCHAR) THEN a ELSE b END AS b, min(reason) AS reason FROM p WHERE a <> b GROUP BY 1, 2""")
def repointed_candidates(t):
    """Look-alike pairs of merged facts concern the survivors."""
    c = F.col
    merges = t.supplier.where("s_suppkey % 8 != 0").select(c("s_suppkey").alias("loser"), (c("s_suppkey") - c("s_suppkey") % 8).alias("survivor"))
    pairs = t.lineitem.where("l_quantity > 45").select(c("l_suppkey").alias("a"), c("l_partkey").alias("b"), c("l_returnflag").alias("reason"))
    return I.repoint(pairs, merges)


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity > 45),
  d AS (SELECT l_suppkey AS a, l_partkey AS b, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_returnflag)) AS action FROM lineitem WHERE l_quantity > 40 AND l_returnflag <> 'N' GROUP BY 1, 2)
  SELECT p.a, p.b, CASE action WHEN 'A' THEN 'merged' WHEN 'R' THEN 'kept_separate' ELSE 'open' END AS status FROM p LEFT JOIN d USING (a, b)""")
def decided_candidates(t):
    """Pairs with their status after the reviewer's last decision."""
    c = F.col
    pairs = t.lineitem.where("l_quantity > 45").select(c("l_suppkey").alias("a"), c("l_partkey").alias("b")).distinct()
    events = t.lineitem.where("l_quantity > 40 AND l_returnflag != 'N'").select(c("l_suppkey").alias("a"), c("l_partkey").alias("b"), F.when(c("l_returnflag") == "A", "merge").otherwise("keep_separate").alias("action"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag").alias("at"))
    return I.decided(pairs, events)


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def without_orphans(t):
    parts = t.part.select("p_partkey")
    return I.without_orphans(parts, t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_doc_dups(t):
    """Contents that occur more than once, by digest."""
    return t.documents.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(16,2)) END AS price, array_to_string(list_filter([CASE WHEN p_size % 3 = 0 THEN 'price' END, CASE WHEN p_size % 5 = 0 THEN 'area' END, CASE WHEN p_size % 7 = 0 THEN 'city' END], lambda x: x IS NOT NULL), ',') AS missing,
  CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 OR p_size % 7 = 0 THEN 'needs_review' ELSE 'auto_extracted' END AS status FROM part""")
def missing_critical(t):
    """Critical fields that are missing, and the status that follows."""
    c = F.col
    r = t.part.select(c("p_partkey").alias("k"), F.lit("asking_price").alias("data_kind"), F.when(c("p_size") % 3 != 0, c("p_retailprice").cast("decimal(16,2)")).alias("price"), F.when(c("p_size") % 5 != 0, F.lit(10).cast("decimal(12,2)")).alias("area"), F.when(c("p_size") % 7 != 0, c("p_brand")).alias("city"), F.lit(None).cast("decimal(14,2)").alias("stated"), F.lit(False).alias("ocr"))
    return D.validate(r).select("k", "price", F.array_join("missing", ",").alias("missing"), "status")


@query("""SELECT k, field, value FROM (SELECT p_partkey AS k, unnest(['brand', 'size', 'type']) AS field, unnest([p_brand, CAST(p_size AS VARCHAR), CASE WHEN p_size > 20 THEN p_type END]) AS value FROM part) WHERE value IS NOT NULL""")
def field_rows(t):
    """A row per stated field."""
    c = F.col
    r = t.part.select(c("p_partkey").alias("k"), c("p_brand").alias("brand"), c("p_size").alias("size"), F.when(c("p_size") > 20, c("p_type")).alias("type"))
    return D.field_facts(r, ["k"], ["brand", "size", "type"])


@query("""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS heading, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang,
  len(regexp_extract_all(html, '<a href="')) AS links, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages""")
def html_fields(t):
    """Labelled values of semi-structured pages by pattern."""
    one = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return t.pages.select("page_id", one("<title>([^<]*)</title>").alias("title"), one("<h1>([^<]*)</h1>").alias("heading"), one('<html lang="([a-z]+)"').alias("lang"), F.regexp_count("html", F.lit('<a href="')).cast("long").alias("links"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  SELECT doc_id, i - 1 AS line_no, last_value(CASE WHEN length(line) < 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM l WHERE trim(line, ' ') <> ''""")
def section_carry_forward(t):
    """Each line with the last heading (here: short line) at or before it."""
    from pyspark.sql import Window

    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("trim(line) != ''")
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.last(F.when(F.length("line") < 40, F.col("line")), ignorenulls=True).over(order).alias("section"))


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^[\s\-–—]*\d{1,4}[\s\-–—]*$')) AS a FROM documents),
  w AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM l),
  p AS (SELECT doc_id, i, 0 AS part, length(x) + 1 AS size FROM w WHERE i = 1
    UNION ALL SELECT w.doc_id, w.i, CASE WHEN size + length(x) + 1 > 1200 THEN part + 1 ELSE part END, CASE WHEN size + length(x) + 1 > 1200 THEN length(x) + 1 ELSE size + length(x) + 1 END FROM p JOIN w ON w.doc_id = p.doc_id AND w.i = p.i + 1)
  SELECT doc_id AS version_id, CAST(0 AS BIGINT) AS section_no, part, CAST(length(string_agg(x, chr(10) ORDER BY i)) AS INTEGER) AS chars, md5(string_agg(x, chr(10) ORDER BY i)) AS digest FROM p JOIN w USING (doc_id, i) GROUP BY doc_id, part""")
def chunk_packing(t):
    """Lines packed into chunks of bounded size, section by section."""
    pages = t.documents.select(F.col("doc_id").alias("version_id"), F.lit(1).alias("page_no"), "text")
    chunks = D.pack_lines(D.with_sections(D.lines_of(pages)))
    return chunks.select("version_id", "section_no", "part", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN round(o_totalprice, 2) WHEN 3 THEN NULL ELSE CAST(day(CAST(o_orderdate AS DATE)) AS DOUBLE) END AS money, CASE WHEN o_orderkey % 4 IN (1, 2) THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def parse_values(t):
    """Money and dates out of the texts of every order's total and date; what can't be parsed is null."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    texts = F.when(k % 4 == 0, F.format_number("o_totalprice", 2)).when(k % 4 == 1, F.date_format(day, "dd/MM/yyyy")).when(k % 4 == 2, F.date_format(day, "d-M-yyyy")).otherwise(F.concat((k % 10).cast("string"), F.lit(",25")))
    return t.orders.select(k.alias("k"), texts.alias("x")).select("k", F.round(N.parse_money(F.col("x")).cast("double"), 2).alias("money"), N.parse_date(F.col("x")).alias("day"))


GROUPED = "text"
for _ in range(4):  # a comma goes if exactly three digits follow; what a pass consumes, the next one sees
    GROUPED = f"regexp_replace({GROUPED}, '(\\d),(\\d\\d\\d)([^0-9]|$)', '\\1\\2\\3', 'g')"


@query(f"SELECT doc_id, lower(trim(regexp_replace({GROUPED}, '[\\s\\x{{00A0}}]+', ' ', 'g'))) AS plain FROM documents")
def normalize_text(t):
    """The comparison form of every text."""
    return t.documents.select("doc_id", T.base_normalize(F.col("text")).alias("plain"))


@query(r"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\[E\d+\]', ' ', 'g'), '(?m)^\s*\d{1,2}[.)]\s', ' ', 'g') AS x FROM documents),
  n AS (SELECT doc_id, regexp_replace(replace(unnest(regexp_extract_all(x, '(^|[^\p{L}\p{N}_])(\d[\d,]*(\.\d+)?)', 2)), ',', ''), '^0+(\d)', '\1') AS v FROM p)
  SELECT doc_id, string_agg(DISTINCT CASE WHEN contains(v, '.') THEN regexp_replace(v, '\.?0+$', '') ELSE v END, ' ' ORDER BY CASE WHEN contains(v, '.') THEN regexp_replace(v, '\.?0+$', '') ELSE v END) AS numbers FROM n GROUP BY doc_id""")
def numbers_in_texts(t):
    """Distinct numbers of every text in canonical form."""
    found = t.documents.select("doc_id", T.numbers_in(F.col("text")).alias("n")).where(F.size("n") > 0)
    return found.select("doc_id", F.array_join(F.array_sort("n"), " ").alias("numbers"))


@query("""SELECT o_orderkey AS k, CAST(least(300, 5 * pow(2, greatest(0, o_orderkey % 9 - 1))) AS INTEGER) AS backoff, round(ln((1000 + 1) / (o_orderkey % 50 + 0.5)), 9) AS idf FROM orders""")
def backoff_and_idf(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), N.backoff_seconds(F.col("o_orderkey") % 9).alias("backoff"), F.round(N.idf(F.lit(1000), F.col("o_orderkey") % 50), 9).alias("idf"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS squared, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS first FROM embeddings""")
def unit_vectors(t):
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"), F.round(N.unit_vector(F.col("embedding"))[0], 6).alias("first"))


@query("""SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref FROM events""")
def json_fields(t):
    """Typed access to JSON; what isn't there is null."""
    p = F.from_json("props", "page string, ref string")
    return t.events.select("event_id", p["page"].alias("page"), p["ref"].alias("ref"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS version_id, 'הגפן ' || l_linenumber AS address, CAST(l_partkey AS VARCHAR) AS block, CAST(l_suppkey AS VARCHAR) AS parcel, CAST(l_shipdate AS DATE) AS transaction_date, CAST(l_quantity AS DOUBLE) AS area, round(l_extendedprice, 2) AS price,
  lower(n_name) AS city, 'included' AS vat_basis, CAST(o_orderdate AS DATE) AS report_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def hebrew_records(t):
    """Every order as a report in Hebrew: header facts from its page, comparables from its table, put into records."""
    c, day = F.col, lambda n: F.date_format(F.col(n).cast("date"), "dd/MM/yyyy")
    orders = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey")).select(c("o_orderkey").cast("string").alias("version_id"), day("o_orderdate").alias("day"), "n_name")
    text = F.concat(F.lit("עיר העסקאות: "), F.lower("n_name"), F.lit("\nתאריך עריכת השומה: "), c("day"), F.lit("\nבסיס מע״מ: כולל מע״מ"))
    pages = orders.select("version_id", F.lit(1).alias("page_no"), text.alias("text"))
    head = F.array(*(F.lit(x) for x in ("כתובת", "גוש/חלקה", "תאריך עסקה", "סוג נכס", "שטח (מ״ר)", "סוג שטח", "מחיר (₪)")))
    cells = F.array(F.concat(F.lit("הגפן "), c("l_linenumber").cast("string")), F.concat_ws("/", c("l_partkey").cast("string"), c("l_suppkey").cast("string")), day("l_shipdate"), F.lit("דירה"), c("l_quantity").cast("decimal(12,2)").cast("string"), F.lit("נטו"), F.format_number(c("l_extendedprice").cast("decimal(16,2)"), 2))
    lines = t.lineitem.select(c("l_orderkey").cast("string").alias("version_id"), F.struct(c("l_linenumber").alias("line"), cells.alias("cells")).alias("r")).groupBy("version_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    grids = lines.select("version_id", F.lit(0).alias("seq"), F.lit(1).alias("page"), F.concat(F.array(head), F.transform("r", lambda r: r["cells"])).alias("rows"), F.lit(True).alias("first_on_page"), F.lit(False).alias("ocr"), F.lit(None).cast("string").alias("section"))
    facts = D.header_facts(pages, {**D.HEADER_LABELS, **D.SECTION_LABELS}).groupBy("version_id").pivot("field", ["city", "neighborhood", "vat_basis", "valuation_date", "report_date"]).agg(F.first("original"))
    context = facts.select("version_id", T.normalize_place(c("city")).alias("city"), T.normalize_place(c("neighborhood")).alias("neighborhood"), T.vat_basis_code(c("vat_basis")).alias("vat_basis"), N.parse_date(c("valuation_date")).alias("valuation_date"), N.parse_date(c("report_date")).alias("report_date"))
    found = D.normalize_records(D.records_of(D.assemble_tables(grids)), context)
    return found.select("version_id", "address", "block", "parcel", "transaction_date", c("area").cast("double").alias("area"), c("price").cast("double").alias("price"), "city", "vat_basis", "report_date")
