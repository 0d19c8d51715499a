"""Statistics over unique facts, counts, sets, top lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..context import TenantContext, fully_visible, secure
from ..operators import stats
from ..operators.adapters import occurrences, transactions
from ..plans.conditions import half_open
from .registry import query

KEYS = ["order_key", "line"]
#: Exact integer cents: price and area in hundredths, price per area half up.
CENTS = "CAST(round(l_extendedprice * 100) AS HUGEINT) AS p, CAST(round(l_quantity * 100) AS HUGEINT) AS a"
TXN = f"""txn AS (SELECT order_key, line, p, a FROM (SELECT l_orderkey AS order_key, l_linenumber AS line, {CENTS},
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_quantity, l_partkey, l_suppkey) AS nth FROM lineitem) WHERE nth = 1)"""
OCC = """occ AS (SELECT l_orderkey AS order_key, l_linenumber AS line, l_returnflag AS data_kind, l_linestatus AS verification,
  CAST(l_shipdate AS DATE) AS transaction_date, CAST(o_orderdate AS DATE) AS valuation_date, n_name AS city, r_name AS office_id, c_mktsegment AS neighborhood,
  p_type AS property_type, p_brand AS area_type, o_orderpriority AS vat_basis
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
STATS = """count(*) AS n, CAST((2 * sum(v) + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS mean,
  CAST((200 * sum(p) + sum(a)) // (2 * sum(a)) AS DOUBLE) / 100 AS weighted, floor(quantile_cont(CAST(v AS DOUBLE), 0.5) + 0.5) / 100 AS median,
  CAST(min(v) AS DOUBLE) / 100 AS least, CAST(max(v) AS DOUBLE) / 100 AS most"""


def _question():
    c = F.col
    return (c("verification") == "F") & (c("data_kind") == "R") & half_open("transaction_date", F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("1998-01-01"))) & (c("vat_basis") == "1-URGENT")


QUESTION = "verification = 'F' AND data_kind = 'R' AND transaction_date >= DATE '1996-01-01' AND transaction_date < DATE '1998-01-01' AND vat_basis = '1-URGENT'"


@query(f"""WITH {OCC}, {TXN}, chosen AS (SELECT DISTINCT order_key, line FROM occ WHERE {QUESTION} AND office_id = 'ASIA'),
  each AS (SELECT p, a, (200 * p + a) // (2 * a) AS v FROM txn JOIN chosen USING (order_key, line) WHERE a > 0)
  SELECT {STATS} FROM each""")
def stats_flagship(t):
    """A scoped question: filter, semi-join on tenant dimensions, unique facts, exact statistics."""
    own = secure(occurrences(t), TenantContext(office_id="ASIA"))
    chosen = stats.eligible(own, _question(), KEYS)
    return stats.statistics(transactions(t).join(chosen, KEYS))


@query(f"WITH {OCC} SELECT DISTINCT order_key, line FROM occ WHERE {QUESTION}")
def eligible_ids(t):
    """Unlike the statistics, without a condition on price or area."""
    return stats.eligible(occurrences(t), _question(), KEYS)


@query(f"""WITH {OCC}, {TXN}, chosen AS (SELECT DISTINCT order_key, line, city FROM occ WHERE verification = 'F'),
  each AS (SELECT city, p, a, (200 * p + a) // (2 * a) AS v FROM txn JOIN chosen USING (order_key, line) WHERE a > 0)
  SELECT city, {STATS} FROM each GROUP BY city""")
def stats_by_city(t):
    chosen = stats.eligible(occurrences(t), F.col("verification") == "F", [*KEYS, "city"])
    return stats.statistics(transactions(t).join(chosen, KEYS), "city")


@query(f"""WITH {TXN}, each AS (SELECT CAST(order_key % 97 AS BIGINT) AS g, p, a, (200 * p + a) // (2 * a) AS v FROM txn WHERE a > 0)
  SELECT g, {STATS} FROM each GROUP BY g""")
def weighted_vs_simple_mean(t):
    return stats.statistics(transactions(t).withColumn("g", F.col("order_key") % 97), "g")


@query(f"WITH {OCC} SELECT value, count(*) AS n FROM (SELECT DISTINCT area_type AS value, order_key, line FROM occ WHERE data_kind = 'A' AND area_type IS NOT NULL) GROUP BY value")
def distinct_values_mixed(t):
    """How many facts each value of a mixed attribute has: more than one value needs a clarification."""
    return stats.distinct_values(occurrences(t).where("data_kind = 'A'"), "area_type", KEYS)


@query(f"""WITH {OCC}, names AS (SELECT 'area_type' AS attribute, count(DISTINCT area_type) AS kinds FROM occ WHERE {QUESTION} UNION ALL
  SELECT 'property_type', count(DISTINCT property_type) FROM occ WHERE {QUESTION} UNION ALL SELECT 'vat_basis', count(DISTINCT vat_basis) FROM occ WHERE {QUESTION})
  SELECT attribute, kinds, kinds > 1 AS mixed FROM names""")
def mixed_attributes(t):
    """Attributes to ask about, from one pass over long rows."""
    names = ["area_type", "property_type", "vat_basis"]
    long = occurrences(t).where(_question()).select(*names).unpivot([], names, "attribute", "value")
    return long.where("value IS NOT NULL").distinct().groupBy("attribute").agg(F.count(F.lit(1)).alias("kinds")).withColumn("mixed", F.col("kinds") > 1)


@query(f"""WITH {OCC} SELECT order_key, line FROM (SELECT DISTINCT order_key, line FROM occ WHERE verification = 'O' EXCEPT SELECT DISTINCT order_key, line FROM occ WHERE verification = 'F')""")
def coverage_gap(t):
    return stats.coverage_gap(occurrences(t), F.col("verification") == "F", F.col("verification") == "O", KEYS)


@query("""SELECT c_mktsegment AS segment, count(*) AS customers, count(*) FILTER (WHERE c_acctbal < 0) AS negative, count(*) FILTER (WHERE c_acctbal > 5000) AS rich,
  count(*) FILTER (WHERE c_nationkey IN (1, 2, 3)) AS near FROM customer GROUP BY c_mktsegment""")
def filtered_counts(t):
    """Several filtered counts in one aggregation."""
    c = F.col
    return t.customer.groupBy(c("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("customers"), F.count_if(c("c_acctbal") < 0).alias("negative"), F.count_if(c("c_acctbal") > 5000).alias("rich"), F.count_if(c("c_nationkey").isin(1, 2, 3)).alias("near"))


@query("""SELECT r_name AS region, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_name < 'M' GROUP BY r_name""")
def users_groups_array(t):
    """Left join and ordered array of the members; no member gives an empty array."""
    members = t.nation.where("n_name < 'M'")
    out = t.region.join(members, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy(F.col("r_name").alias("region")).agg(F.array_sort(F.collect_set("n_name")).alias("names"))
    return out.select("region", F.when(F.size("names") > 0, F.array_join("names", ",")).alias("nations"))


@query("""SELECT n_name AS nation, count(c_custkey) AS customers, count(c_custkey) FILTER (WHERE c_acctbal > 0) AS positive FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def left_join_counts(t):
    joined = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy(F.col("n_name").alias("nation")).agg(F.count("c_custkey").alias("customers"), F.count(F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))).alias("positive"))


@query("""SELECT a, b FROM (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier) WHERE a IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50)
  AND b IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50)""")
def open_pairs_both_ends(t):
    from ..operators.identity import both_ends

    pairs = t.supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return both_ends(pairs, t.lineitem.where("l_returnflag = 'R' AND l_quantity = 50"), "l_suppkey")


@query("""SELECT id, bool_and(hit) AS every_end FROM (SELECT s_suppkey AS id, EXISTS (SELECT 1 FROM customer WHERE c_custkey = k AND c_acctbal > 0) AS hit
  FROM (SELECT s_suppkey, unnest([s_suppkey, s_suppkey + 1]) AS k FROM supplier)) GROUP BY id""")
def bool_and_exists(t):
    """Whether every element of an array has a match: explode, left join, bool_and."""
    each = t.supplier.select(F.col("s_suppkey").alias("id"), F.explode(F.array("s_suppkey", F.col("s_suppkey") + 1)).alias("k"))
    hits = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.lit(True).alias("hit"))
    return each.join(hits, "k", "left").groupBy("id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("every_end"))


@query("SELECT c_custkey AS document_id, coalesce(max(k), 0) + 1 AS next_version FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey GROUP BY c_custkey")
def next_version(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    return t.customer.join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("document_id"), (F.coalesce("k", F.lit(0)) + 1).alias("next_version"))


@query(f"""WITH each AS (SELECT l_orderkey, l_linenumber, {CENTS}, CAST(round(l_extendedprice * (1 + l_tax / 20) * 100) AS HUGEINT) AS s FROM lineitem),
  calc AS (SELECT *, (200 * p + a) // (2 * a) AS c, (200 * s + a) // (2 * a) AS st FROM each WHERE a > 0)
  SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS conflicts FROM calc WHERE abs(st - c) * 1000 > 5 * c""")
def conflict_tolerance(t):
    """Facts whose stated price per area is off by more than half a percent."""
    from ..functions.numbers import price_conflict, price_per_area

    c = F.col
    price, area = c("l_extendedprice").cast("decimal(16,2)"), c("l_quantity").cast("decimal(12,2)")
    stated = F.round(c("l_extendedprice") * (1 + c("l_tax") / 20) * 100).cast("decimal(20,0)")
    rows = t.lineitem.select(c("l_orderkey").alias("order_key"), c("l_linenumber").alias("line"), price_per_area(price, area).alias("computed"), price_per_area((stated / 100).cast("decimal(18,2)"), area).alias("stated"))
    return stats.conflict_count(rows, price_conflict(c("stated"), c("computed")), KEYS)


@query("""SELECT k, n FROM (SELECT c_mktsegment || '/' || c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, k LIMIT 1)""")
def largest_partition(t):
    keyed = t.customer.select(F.concat("c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string")).alias("k"))
    return stats.largest_partition(keyed, ["k"])


@query("""SELECT n_name AS nation, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000 GROUP BY 1) ON c_nationkey = n_nationkey""")
def per_question_counts(t):
    """Counts of visible sources per question, with zero for none."""
    counts = t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return t.nation.join(counts, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("nation"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT lang, count(*) AS n, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS clean_rate, round(avg(CAST(quality AS DOUBLE)), 6) AS quality_rate FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def label_metrics(t):
    """Rates by category."""
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    return joined.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("toxic") == 0).cast("double")), 6).alias("clean_rate"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("quality_rate"))


@query("""WITH r AS (SELECT lang, source, n_chars, toxic = 0 AS clean, CASE WHEN toxic = 0 THEN quality = 1 END AS good FROM documents JOIN labels USING (doc_id))
  SELECT CAST(grouping(lang) * 2 + grouping(source) AS BIGINT) AS level, lang, source, count(*) AS results, round(count(*) FILTER (WHERE clean) / CAST(nullif(count(clean), 0) AS DOUBLE), 6) AS clean_rate, count(clean) AS clean_of,
    round(count(*) FILTER (WHERE good) / CAST(nullif(count(good), 0) AS DOUBLE), 6) AS good_rate, count(good) AS good_of, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.95), 6) AS p95
  FROM r GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())""")
def evaluation_summary(t):
    """Rates and percentiles by category and kind, by either and overall."""
    joined = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id")
    clean = F.col("toxic") == 0
    return stats.evaluation_summary(joined, [["lang", "source"], ["lang"], ["source"], []], {"clean": clean, "good": F.when(clean, F.col("quality") == 1)}, "n_chars")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most FROM events GROUP BY event_type")
def latency_percentiles(t):
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    out = t.events.groupBy("event_type").agg(p.alias("p"), F.max("value").alias("most"))
    return out.select("event_type", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"), "most")


@query("""WITH a AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
  b AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark)
  SELECT item_id, count(*) AS cells, count(*) FILTER (WHERE a.w IS NOT DISTINCT FROM b.w) AS correct FROM b LEFT JOIN a ON a.doc_id = b.item_id AND a.i = b.i GROUP BY item_id""")
def table_accuracy(t):
    """Cell accuracy against an answer key: both sides exploded by position, null-safe comparison."""
    cells = lambda df, key: df.select(F.col(key).alias("k"), F.posexplode(F.split("text", " ")).alias("i", "w"))
    truth, got = cells(t.benchmark, "item_id"), cells(t.documents, "doc_id").withColumnRenamed("w", "g")
    joined = truth.join(got, ["k", "i"], "left")
    return joined.groupBy(F.col("k").alias("item_id")).agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("w").eqNullSafe(F.col("g"))).alias("correct"))


@query("""WITH truth AS (SELECT p_partkey AS k, unnest(['brand', 'type', 'size']) AS field, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS v FROM part),
  got AS (SELECT p_partkey AS k, unnest(['brand', 'type', 'size']) AS field, unnest([upper(p_brand), CASE WHEN p_size > 10 THEN p_type END, CAST(p_size AS VARCHAR)]) AS g FROM part WHERE p_partkey % 7 <> 0)
  SELECT field, count(*) AS n, count(*) FILTER (WHERE got.k IS NOT NULL AND v IS NOT DISTINCT FROM g) AS correct, count(*) FILTER (WHERE got.k IS NULL) AS absent FROM truth LEFT JOIN got USING (k, field) GROUP BY field""")
def field_accuracy(t):
    """Field accuracy where a missing record misses all its fields."""
    c = F.col
    fields = ["brand", "type", "size"]
    long = lambda df, v: df.unpivot(["k"], fields, "field", v)
    truth = long(t.part.select(c("p_partkey").alias("k"), c("p_brand").alias("brand"), c("p_type").alias("type"), c("p_size").cast("string").alias("size")), "v")
    part = t.part.where("p_partkey % 7 <> 0")
    got = long(part.select(c("p_partkey").alias("k"), F.upper("p_brand").alias("brand"), F.when(c("p_size") > 10, c("p_type")).alias("type"), c("p_size").cast("string").alias("size")), "g").withColumn("there", F.lit(True))
    joined = truth.join(got, ["k", "field"], "left")
    return joined.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("there") & c("v").eqNullSafe(c("g"))).alias("correct"), F.count_if(c("there").isNull()).alias("absent"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans_anti(t):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_name = 'EUROPE' AND c_mktsegment IN ('BUILDING', 'MACHINERY'))""")
def secure_semi(t):
    """Row security: the office is a pushed filter, the groups a semi-join, content follows its documents."""
    from ..context import secure_content, secure_documents

    ctx = TenantContext(office_id="EUROPE", user_id="u1")
    regions = t.region.select("r_regionkey", F.col("r_name").alias("office_id"))
    docs = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("group_id"), "office_id")
    mine = t.spark.createDataFrame([("u1", "BUILDING"), ("u1", "MACHINERY"), ("u2", "HOUSEHOLD")], "user_id string, group_id string")
    content = t.orders.select("o_orderkey", F.col("o_custkey").alias("document_id"), F.lit("EUROPE").alias("office_id"))
    return secure_content(content, secure_documents(docs, mine, ctx), ctx).select("o_orderkey")


@query("""SELECT DISTINCT l_orderkey AS key FROM lineitem EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')""")
def subset_of_groups(t):
    """Keys all of whose groups belong to the caller (division by an anti-join)."""
    ctx = TenantContext(office_id="x", groups=frozenset({"A", "N"}))
    return fully_visible(t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("group_id")), ctx)


@query("""SELECT answer_id, bool_and(seen) AS authorized FROM (SELECT DISTINCT l_suppkey AS answer_id, l_partkey AS version_id, p_size <= 45 AS seen FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45) GROUP BY answer_id""")
def reauthorized_answers(t):
    from ..context import still_authorized

    cited = t.lineitem.where("l_quantity > 45").select(F.col("l_suppkey").alias("answer_id"), F.col("l_partkey").alias("version_id"))
    return still_authorized(cited, t.part.where("p_size <= 45").select(F.col("p_partkey").alias("version_id")))


@query("""SELECT n_name AS nation, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') AS before, count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM 'O') AS other
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name ILIKE '%an%' GROUP BY n_name""")
def filters_and_star_join(t):
    """Substring filter with escaped wildcards, null-safe inequality, star join."""
    from ..functions.text import substring_filter

    nations = t.nation.where(substring_filter(F.col("n_name"), "an"))
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("nation")).agg(F.count_if(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).alias("before"), F.count_if(~F.col("o_orderstatus").eqNullSafe(F.lit("O"))).alias("other"))


@query("SELECT p_name AS name, count(*) AS n FROM part WHERE p_name ILIKE '%\\_%' ESCAPE '\\' OR p_name ILIKE '%a%' GROUP BY p_name")
def ilike_escaped(t):
    """Wildcards in the reader's text stand for themselves."""
    from ..functions.text import substring_filter

    name = F.col("p_name")
    return t.part.where(substring_filter(name, "_") | substring_filter(name, "a")).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s.s_suppkey AS a, c.c_custkey AS b FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey AND (round(s.s_acctbal) = round(c.c_acctbal) OR c.c_custkey = s.s_suppkey)""")
def disjunctive_match(t):
    """A disjunction on one place as two equi-joins: pairs of equal amounts, then those of equal ids that the first ones lack."""
    c = F.col
    suppliers = t.supplier.select(c("s_suppkey").alias("a"), c("s_nationkey").alias("place"), F.round("s_acctbal").alias("x"))
    customers = t.customer.select(c("c_custkey").alias("b"), c("c_nationkey").alias("place"), F.round("c_acctbal").alias("y"))
    equal = suppliers.join(customers.withColumn("x", c("y")), ["place", "x"]).select("a", "b")
    same = suppliers.join(customers.withColumn("a", c("b")), ["place", "a"]).where(~F.coalesce(c("x") == c("y"), F.lit(False)))
    return equal.unionByName(same.select("a", "b"))


@query("""SELECT a.r_name AS office, b.n_name AS nation FROM region a LEFT JOIN nation b ON CASE WHEN a.r_regionkey = 0 THEN NULL ELSE a.r_regionkey END IS NOT DISTINCT FROM CASE WHEN b.n_regionkey = 0 THEN NULL ELSE b.n_regionkey END""")
def null_safe_join(t):
    """A lookup whose key may be null on both sides."""
    key = lambda c: F.when(F.col(c) != 0, F.col(c))
    a = t.region.select(F.col("r_name").alias("office"), key("r_regionkey").alias("x"))
    b = t.nation.select(F.col("n_name").alias("nation"), key("n_regionkey").alias("y"))
    return a.join(b, F.col("x").eqNullSafe(F.col("y")), "left").select("office", "nation")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM (SELECT *, (o_orderstatus = 'P') AS first FROM orders) ORDER BY first DESC, o_orderdate DESC, o_orderkey LIMIT 50")
def review_queue_order(t):
    """The most urgent first, then the most recent, then by id; at most 50, as the list shows."""
    return t.orders.orderBy((F.col("o_orderstatus") == "P").desc(), F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""SELECT 'record' AS kind, o_orderkey AS id, o_orderpriority AS detail FROM orders WHERE o_orderstatus = 'P' UNION ALL
  SELECT 'pair', s_suppkey, s_name FROM supplier WHERE s_acctbal < 0""")
def review_queue_union(t):
    """Records and pairs in one shape."""
    records = t.orders.where("o_orderstatus = 'P'").select(F.lit("record").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("detail"))
    pairs = t.supplier.where("s_acctbal < 0").select(F.lit("pair").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("detail"))
    return records.unionByName(pairs)


@query(f"""WITH {OCC} SELECT order_key, line, CAST(count(*) AS BIGINT) AS sources, min(transaction_date) AS first, max(transaction_date) AS last FROM occ GROUP BY order_key, line""")
def fact_sources(t):
    """A fact's occurrences nested under it."""
    nested = occurrences(t).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("transaction_date", "part", "supplier"))).alias("s"))
    return nested.select(*KEYS, F.size("s").cast("long").alias("sources"), F.col("s")[0]["transaction_date"].alias("first"), F.element_at("s", -1)["transaction_date"].alias("last"))


@query("""SELECT conv_id, max(turn) AS last_turn, count(*) AS turns FROM conversations GROUP BY conv_id ORDER BY turns DESC, conv_id LIMIT 50""")
def recent_conversations(t):
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("turns")).orderBy(F.desc("turns"), "conv_id").limit(50)


@query("SELECT n_name AS phrase, o.r_name AS region FROM region o JOIN nation ON n_regionkey = o.r_regionkey QUALIFY row_number() OVER (PARTITION BY o.r_name ORDER BY length(n_name) DESC, n_name) = 1")
def longest_match_first(t):
    """The longest name of each group, the least of equals."""
    w = Window.partitionBy("r_name").orderBy(F.length("n_name").desc(), "n_name")
    joined = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("nth", F.row_number().over(w))
    return joined.where("nth = 1").select(F.col("n_name").alias("phrase"), F.col("r_name").alias("region"))


@query("""SELECT r_regionkey AS k, n FROM (SELECT r_regionkey, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region)""")
def correlated_count(t):
    """A correlated scalar count, which the optimizer turns into an aggregate and a left join."""
    t.region.createOrReplaceTempView("region")
    t.nation.createOrReplaceTempView("nation")
    return t.spark.sql("SELECT r_regionkey AS k, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels WHERE toxic = 1) AS flagged, (SELECT count(DISTINCT source) FROM documents) AS sources")
def scalar_subqueries(t):
    """Independent aggregates side by side, each a single row."""
    a = t.documents.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("sources"))
    return a.crossJoin(t.labels.where("toxic = 1").agg(F.count(F.lit(1)).alias("flagged"))).select("documents", "flagged", "sources")
