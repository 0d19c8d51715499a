"""Questions of many conversations, read as one table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.adapters import occurrences
from ..plans import question
from ..plans.batch import answer_questions
from .numeric import CENTS, TXN
from .registry import query

#: What is asked at an order of each priority, with %s for the place and %d for the year.
ASKED = {
    "1-URGENT": "מה ממוצע מחירי עסקאות למ״ר ב%s ב-%d לפי תאריך עסקה?",
    "2-HIGH": "ומה לגבי %s ב-%d?",
    "3-MEDIUM": "ומה עם שטח נטו?",
    "4-NOT SPECIFIED": "למה נקבע שווי בשכונת old %s?",
    "5-LOW": "מחירים מבוקשים בעיר חיפה ב-%d",
}

#: What each kind of question says, stated by hand; then the turns of a conversation, where a follow-up keeps what it doesn't state.
SQL = """
WITH q AS (SELECT o_custkey AS c, o_orderkey AS t, o_orderpriority[1] AS k, lower(n_name) AS place, CAST(year(CAST(o_orderdate AS DATE)) AS INTEGER) AS y FROM orders JOIN nation ON n_nationkey = o_orderkey % 25),
s AS (SELECT c, t, k IN ('2', '3') AND row_number() OVER (PARTITION BY c ORDER BY t) > 1 AS carries,
  CASE k WHEN '4' THEN 'explanation' ELSE 'calculation' END AS intent, CASE k WHEN '1' THEN 'transaction_price' WHEN '4' THEN 'appraised_value' WHEN '5' THEN 'asking_price' END AS data_kind,
  CASE k WHEN '1' THEN 'transaction_date' END AS date_field, CASE WHEN k IN ('1', '2', '5') THEN y END AS y, CASE WHEN k IN ('1', '2', '4') THEN place END AS city, CASE k WHEN '4' THEN 'old ' || place END AS hood,
  CASE k WHEN '3' THEN 'net' END AS area, CASE k WHEN '5' THEN 'חיפה' END AS unknown_place FROM q),
h AS (SELECT c, t, carries, unknown_place,
  last_value(CASE WHEN NOT carries OR y IS NOT NULL THEN {'v': y} END IGNORE NULLS) OVER w AS y, last_value(CASE WHEN NOT carries OR city IS NOT NULL THEN {'v': city} END IGNORE NULLS) OVER w AS city,
  last_value(CASE WHEN NOT carries OR city IS NOT NULL THEN {'v': hood} END IGNORE NULLS) OVER w AS hood, last_value(CASE WHEN NOT carries OR area IS NOT NULL THEN {'v': area} END IGNORE NULLS) OVER w AS area,
  last_value(CASE WHEN NOT carries THEN {'i': intent, 'k': data_kind, 'd': date_field} END IGNORE NULLS) OVER w AS r FROM s WINDOW w AS (PARTITION BY c ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT c AS conversation_id, t AS turn, r.i AS intent, r.k AS data_kind, r.d AS date_field, y.v AS year_from, city.v AS city, hood.v AS neighborhood, area.v AS area_type, CASE WHEN carries THEN 'followup' ELSE 'rules' END AS route, unknown_place,
  CASE WHEN r.i = 'explanation' THEN '' ELSE concat_ws(',', CASE WHEN r.k IS NULL THEN 'data_kind' END, CASE WHEN y.v IS NOT NULL AND r.d IS NULL THEN 'date_field' END) END AS missing FROM h"""


@query(SQL)
def read_questions(t):
    """A customer's orders as the turns of a conversation; nations are the known places."""
    c = F.col
    nations = t.nation.select("n_nationkey", F.lower("n_name").alias("city"))
    asked = t.orders.join(nations, c("o_orderkey") % 25 == c("n_nationkey"))
    text = F.lit(None).cast("string")
    for priority, said in ASKED.items():
        filled = [x for mark, x in (("%s", c("city")), ("%d", F.year(c("o_orderdate").cast("date")))) if mark in said]
        text = F.when(c("o_orderpriority") == priority, F.format_string(said, *filled)).otherwise(text)
    questions = asked.select(c("o_custkey").alias("conversation_id"), c("o_orderkey").alias("turn"), text.alias("question"))
    places = nations.select("city", F.concat(F.lit("old "), c("city")).alias("neighborhood"))
    out = question.read_questions(questions, places)
    names = ("conversation_id", "turn", "intent", "data_kind", "date_field", "year_from", "city", "neighborhood", "area_type", "route", "unknown_place")
    return out.select(*names, F.array_join("missing", ",").alias("missing"))


#: Records with fewer kinds of attributes, so that some questions meet one kind only; every order's lines are facts, of which neighbours are undecided pairs.
ANSWERS = f"""
WITH {TXN},
o AS (SELECT l_orderkey AS order_key, l_linenumber AS line, {CENTS}, l_returnflag AS kind, l_linestatus = 'F' AS sure, CAST(l_shipdate AS DATE) AS day, n_name AS city, c_mktsegment AS hood,
  split_part(p_type, ' ', 1) AS prop, substr(p_brand, 1, 7) AS area, o_orderpriority AS vat, o_custkey AS c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
q AS (SELECT c, CASE WHEN c % 13 <> 0 THEN kind END AS kind, CASE WHEN c % 2 = 0 THEN city END AS city, CASE WHEN c % 3 <> 1 THEN hood END AS hood, CASE WHEN c % 5 <> 0 THEN prop END AS prop, CASE WHEN c % 7 <> 0 THEN area END AS area,
  CASE WHEN c % 11 <> 0 THEN vat END AS vat, CASE WHEN c % 3 = 0 THEN year(day) END AS y, CASE WHEN c % 3 = 0 AND c % 4 <> 1 THEN 'transaction_date' END AS field
  FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY order_key, line, p, a, prop, area, kind) AS nth FROM o) WHERE nth = 1),
m AS (SELECT q.c, q.kind AS k, q.prop AS qp, q.area AS qa, q.vat AS qv, o.* EXCLUDE (c, kind) FROM q JOIN o ON q.kind = o.kind AND (q.city IS NULL OR q.city = o.city) AND (q.hood IS NULL OR q.hood = o.hood) AND (q.prop IS NULL OR q.prop = o.prop)
  AND (q.area IS NULL OR q.area = o.area) AND (q.vat IS NULL OR q.vat = o.vat) AND (q.y IS NULL OR year(o.day) BETWEEN q.y AND q.y + 1) WHERE q.y IS NULL OR q.field IS NOT NULL),
vals AS (SELECT c, nth, name, value, count(*) AS n FROM (SELECT DISTINCT c, 0 AS nth, 'area_type' AS name, area AS value, order_key, line FROM m WHERE sure AND qa IS NULL UNION ALL SELECT DISTINCT c, 1, 'property_type', prop, order_key, line FROM m WHERE sure AND qp IS NULL
  UNION ALL SELECT DISTINCT c, 2, 'vat_basis', vat, order_key, line FROM m WHERE sure AND qv IS NULL) GROUP BY ALL),
mixed AS (SELECT c, name, kinds FROM (SELECT c, nth, name, string_agg(value || '=' || n, ',' ORDER BY n DESC, value) AS kinds FROM vals GROUP BY c, nth, name HAVING count(*) > 1) QUALIFY row_number() OVER (PARTITION BY c ORDER BY nth) = 1),
f AS (SELECT c, order_key, line, bool_or(sure) AS sure FROM m GROUP BY c, order_key, line),
s AS (SELECT f.c, count(*) FILTER (WHERE t.a > 0) AS n, CAST((2 * sum((200 * t.p + t.a) // (2 * t.a)) + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS mean, CAST((200 * sum(t.p) + sum(t.a)) // (2 * sum(t.a)) AS DOUBLE) / 100 AS weighted,
  CASE WHEN count(*) >= 3 THEN floor(quantile_cont(CAST((200 * t.p + t.a) // (2 * t.a) AS DOUBLE), 0.5) + 0.5) / 100 END AS median, min((200 * t.p + t.a) // (2 * t.a)) / 100.0 AS least, max((200 * t.p + t.a) // (2 * t.a)) / 100.0 AS most
  FROM f JOIN txn t USING (order_key, line) WHERE f.sure GROUP BY f.c),
w AS (SELECT c, count(*) FILTER (WHERE NOT sure) AS awaiting FROM f GROUP BY c),
u AS (SELECT x.c, count(*) AS uncertain FROM f x JOIN f y ON x.c = y.c AND x.order_key = y.order_key AND y.line = x.line + 1 AND x.sure AND y.sure GROUP BY x.c),
d AS (SELECT f.c, count(*) AS conflicts FROM f WHERE sure AND line = 3 GROUP BY f.c),
z AS (SELECT q.c, CASE WHEN q.kind IS NULL THEN 'data_kind' WHEN q.y IS NOT NULL AND q.field IS NULL THEN 'date_field' END AS lacks FROM q),
r AS (SELECT *, CASE WHEN lacks IS NOT NULL OR mixed.name IS NOT NULL THEN 'clarification' WHEN coalesce(n, 0) = 0 THEN 'abstain' ELSE 'numeric' END AS outcome FROM z LEFT JOIN mixed USING (c) LEFT JOIN s USING (c) LEFT JOIN w USING (c) LEFT JOIN u USING (c) LEFT JOIN d USING (c))
SELECT c AS question_id, outcome, coalesce(lacks, name) AS ask, kinds, {', '.join(f"CASE WHEN outcome = 'numeric' THEN CAST({x} AS DOUBLE) END AS {x}" for x in ('n', 'mean', 'weighted', 'median', 'least', 'most'))},
  CASE WHEN outcome <> 'clarification' THEN coalesce(awaiting, 0) END AS awaiting, CASE WHEN outcome = 'numeric' THEN coalesce(uncertain, 0) END AS uncertain, CASE WHEN outcome = 'numeric' THEN coalesce(conflicts, 0) END AS conflicts FROM r"""


@query(ANSWERS)
def question_table(t):
    """A question of each customer, made of its first record with some conditions left open, all answered in one job."""
    c = F.col
    fact = F.concat_ws("-", c("order_key").cast("string"), c("line").cast("string"))
    rows = occurrences(t).withColumns({"property_type": F.split_part("property_type", F.lit(" "), F.lit(1)), "fact_area_type": F.substring("area_type", 1, 7), "transaction_id": fact})
    none = F.lit(None)
    # Lines of a fact lie together once they have met their order, so the fact's agreed price and area need no further shuffle.
    agreed = F.min(F.struct("price", "area", "part", "supplier")).over(Window.partitionBy("order_key", "line"))
    rows = rows.withColumn("agreed", agreed).withColumns({"fact_price": c("agreed.price"), "fact_area": c("agreed.area")}).drop("agreed")
    records = rows.withColumns({
        "verification_status": F.when(c("verification") == "F", "human_verified").otherwise("auto_extracted"), "is_current": F.lit(True), "deleted_at": none.cast("timestamp"), "report_date": none.cast("date"),
        "version_id": c("order_key").cast("string"), "stated": F.when(c("line") == 3, F.lit(1)).cast("decimal(14,2)"),
    })
    # The least record of each customer by the columns that order it.
    parts = ("order_key", "line", "price", "area", "property_type", "fact_area_type", "data_kind", "city", "neighborhood", "vat_basis", "transaction_date")
    own = records.groupBy("o_custkey").agg(F.min(F.struct(*parts)).alias("r")).select("o_custkey", "r.*")
    keep = lambda test, name: F.when(test, c(name))
    k, dated = c("o_custkey"), c("o_custkey") % 3 == 0
    questions = own.select(
        k.alias("question_id"), keep(k % 13 != 0, "data_kind").alias("data_kind"), keep(k % 2 == 0, "city").alias("city"), keep(k % 3 != 1, "neighborhood").alias("neighborhood"), keep(k % 5 != 0, "property_type").alias("property_type"),
        keep(k % 7 != 0, "fact_area_type").alias("area_type"), keep(k % 11 != 0, "vat_basis").alias("vat_basis"), F.when(dated & (k % 4 != 1), "transaction_date").alias("date_field"),
        F.when(dated, F.year("transaction_date")).alias("year_from"), F.when(dated, F.year("transaction_date") + 1).alias("year_to"),
    )
    # A fact and the next one of its order, if their numbers follow one another.
    ids = t.lineitem.select(c("l_orderkey").alias("order_key"), c("l_linenumber").alias("line")).repartition("order_key").distinct()
    pairs = ids.withColumn("next", F.lead("line").over(Window.partitionBy("order_key").orderBy("line"))).where(c("next") == c("line") + 1)
    name = lambda line: F.concat_ws("-", c("order_key").cast("string"), c(line).cast("string"))
    answers, _ = answer_questions(questions, records, pairs.select(name("line").alias("a"), name("next").alias("b")))
    kinds = F.array_join(F.transform("options", lambda o: F.concat(o["value"], F.lit("="), o["n"].cast("string"))), ",")
    return answers.withColumns({"kinds": F.when(c("options").isNotNull(), kinds), "n": c("n").cast("double")}).drop("options")
