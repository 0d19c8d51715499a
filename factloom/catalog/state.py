"""Versions, mutations as logs, windows, event folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import context
from ..operators import versions as v
from ..operators.adapters import versions
from ..streaming import jobs
from ..streaming.uploads import judge_uploads
from .registry import query

VERSIONS = """ver AS (SELECT o_custkey AS document_id, o_orderkey AS version_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_no,
  o_orderstatus AS status, o_totalprice AS amount, o_orderdate AS created_at FROM orders)"""
JOBS = """ev AS (SELECT user_id AS job_id, ts, CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'heartbeat' WHEN 'purchase' THEN 'done' ELSE 'fail' END AS action FROM events)"""


@query(f"WITH {VERSIONS} SELECT document_id, version_id, version_no, status FROM ver QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY version_no DESC) = 1")
def latest_version(t):
    return v.latest(versions(t), "document_id", F.desc("version_no")).select("document_id", "version_id", "version_no", "status")


@query(f"WITH {VERSIONS}, l AS (SELECT * FROM ver QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY version_no DESC) = 1) SELECT status, count(*) AS n FROM l GROUP BY status")
def latest_status_counts(t):
    """The latest version's status by aggregation alone: max_by needs no sort."""
    return v.latest_value(versions(t), "document_id", F.col("version_no"), "status").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey AS document_id, o_orderkey AS version_id, o_orderstatus AS status, coalesce(k, 0) AS versions FROM customer
  LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey
  LEFT JOIN (SELECT o_custkey AS ck, count(*) AS k FROM orders GROUP BY 1) ON ck = c_custkey""")
def lateral_latest(t):
    """The document list: latest version and number of versions, also for documents without any."""
    best = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey"))
    per = t.orders.groupBy("o_custkey").agg(best.alias("b"), F.count(F.lit(1)).alias("k"))
    joined = t.customer.join(per, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select(F.col("c_custkey").alias("document_id"), F.col("b.o_orderkey").alias("version_id"), F.col("b.o_orderstatus").alias("status"), F.coalesce("k", F.lit(0)).alias("versions"))


@query(f"""WITH {VERSIONS} SELECT version_id, published AND version_no = top AS is_current, CASE WHEN published AND version_no = top THEN 'current' WHEN published THEN 'superseded' ELSE 'pending' END AS state
  FROM (SELECT *, status = 'F' AS published, max(CASE WHEN status = 'F' THEN version_no END) OVER (PARTITION BY document_id) AS top FROM ver)""")
def late_version_rule(t):
    """A version that finishes late never replaces a newer one."""
    return v.mark_current(versions(t), F.col("status") == "F").select("version_id", "is_current", "state")


@query("""SELECT event_id AS session_id, user_id, event_type AS office_id, u.role FROM (SELECT event_id, user_id, ts, event_type FROM events WHERE ts + INTERVAL 15 DAY > TIMESTAMP '2024-01-20') JOIN (SELECT c_custkey AS user_id, c_mktsegment AS role FROM customer WHERE c_acctbal > 0) u USING (user_id)""")
def live_sessions(t):
    """Unexpired sessions with their active users."""
    c = F.col
    sessions = t.events.select(c("event_id").alias("session_id"), "user_id", "event_type", (c("ts") + F.expr("INTERVAL 15 DAYS")).alias("expires_at"))
    users = t.customer.select(c("c_custkey").alias("user_id"), F.lit("o").alias("office_id"), c("c_mktsegment").alias("role"), (c("c_acctbal") > 0).alias("active"))
    return context.live_sessions(sessions, users, F.lit("2024-01-20").cast("timestamp")).select("session_id", "user_id", c("event_type").alias("office_id"), "role")


@query("""SELECT user_id, value AS last_value, event_type AS last_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def upsert_latest(t):
    e = t.events.select("user_id", F.col("value").alias("last_value"), F.col("event_type").alias("last_type"), F.struct("ts", "event_id").alias("at"))
    return v.latest_value(e, "user_id", F.col("at"), "last_value", "last_type")


@query("""SELECT DISTINCT l_suppkey AS key FROM lineitem WHERE l_quantity = 50 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def insert_if_absent(t):
    new = t.lineitem.where("l_quantity = 50").select(F.col("l_suppkey").alias("key"))
    return v.insert_absent(t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("key")), new, "key")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def soft_delete(t):
    gone = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return v.without_deleted(t.orders, gone, "o_custkey").select("o_orderkey")


@query("""WITH c AS (SELECT l_orderkey AS k, l_extendedprice AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_extendedprice DESC) AS nth, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'R')
  SELECT o_orderkey AS k, coalesce(value, o_totalprice) AS value, coalesce(n, 0) AS edits FROM orders LEFT JOIN c ON k = o_orderkey AND nth = 1""")
def corrections_overlay(t):
    """Corrections overlay what was extracted and keep the history."""
    facts = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value"))
    edits = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("value"), F.struct("l_shipdate", "l_extendedprice").alias("at"))
    return v.apply_corrections(facts, edits, ["k"]).select("k", "value", F.size("previous").cast("long").alias("edits"))


@query("""SELECT o_orderkey AS occurrence_id, coalesce(s, 'auto_extracted') AS status FROM orders LEFT JOIN (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'human_verified' WHEN 'R' THEN 'rejected' ELSE 'corrected' END AS s
  FROM lineitem WHERE l_quantity > 25 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_extendedprice DESC) = 1) ON l_orderkey = o_orderkey""")
def review_events(t):
    action = F.when(F.col("l_returnflag") == "A", "approve").when(F.col("l_returnflag") == "R", "reject").otherwise("correct")
    events = t.lineitem.where("l_quantity > 25").select(F.col("l_orderkey").alias("occurrence_id"), action.alias("action"), F.struct("l_shipdate", "l_extendedprice").alias("at"))
    return v.review_status(t.orders.select(F.col("o_orderkey").alias("occurrence_id"), F.lit("auto_extracted").alias("status")), events)


@query("""WITH occ AS (SELECT l_orderkey AS k, l_returnflag = 'R' AS bad FROM lineitem) SELECT o_orderkey AS version_id, count(k) AS total, count(*) FILTER (WHERE bad) AS review,
  CASE WHEN count(*) FILTER (WHERE bad) > 0 OR any_value(o_orderstatus) = 'P' OR any_value(o_custkey) % 10 = 0 THEN 'needs_review' ELSE 'ready' END AS status FROM orders LEFT JOIN occ ON k = o_orderkey GROUP BY o_orderkey""")
def version_status(t):
    occ = t.lineitem.select(F.col("l_orderkey").alias("version_id"), F.when(F.col("l_returnflag") == "R", "needs_review").otherwise("auto_extracted").alias("status"))
    vers = t.orders.select(F.col("o_orderkey").alias("version_id"), (F.col("o_orderstatus") == "P").alias("pages_incomplete"))
    pairs = t.orders.where("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("version_id"))
    return v.version_status(occ, vers, pairs)


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error'""")
def rolling_failures(t):
    return jobs.rolling_failures(t.events.where("event_type = 'error'"), "user_id").select("event_id", "recent")


@query("""WITH w AS (SELECT user_id, unnest(generate_series(date_trunc('minute', ts) + INTERVAL 1 MINUTE, date_trunc('minute', ts) + INTERVAL 15 MINUTE, INTERVAL 1 MINUTE)) AS until FROM events WHERE event_type = 'error')
  SELECT until, user_id, count(*) AS failures FROM w GROUP BY ALL""")
def sliding_windows(t):
    """The streaming form of the lockout, over a batch of event time."""
    return jobs.streaming_failures(t.events.where("event_type = 'error'"), "user_id").select("until", "user_id", "failures")


@query(f"""WITH {JOBS}, f AS (SELECT job_id, count(*) FILTER (WHERE action = 'claim') AS attempts, bool_or(action = 'done') AS done, max(ts) AS ended, arg_max(action, (ts, action)) AS last FROM ev
  WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY job_id)
  SELECT job_id, attempts, CASE WHEN done THEN 'done' WHEN last = 'fail' AND attempts >= 3 THEN 'failed'
    WHEN last = 'fail' AND ended + to_seconds(least(300, 5 * CAST(pow(2, greatest(0, attempts - 1)) AS BIGINT))) > TIMESTAMP '2024-01-15 12:00:00' THEN 'waiting' WHEN last = 'fail' THEN 'queued'
    WHEN ended + INTERVAL 120 SECOND > TIMESTAMP '2024-01-15 12:00:00' THEN 'running' WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END AS state FROM f""")
def job_states(t):
    """Leases, retries with backoff and the poison cutoff, folded from events."""
    kind = F.create_map(*(F.lit(x) for p in {"click": "claim", "view": "heartbeat", "purchase": "done"}.items() for x in p))
    action = F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("fail"))
    return jobs.job_state(t.events.select(F.col("user_id").alias("job_id"), "ts", action.alias("action")), "2024-01-15 12:00:00")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER w AS asked, last_value(CASE WHEN role = 'system' THEN length(text) END IGNORE NULLS) OVER w AS system
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def conversation_carry_forward(t):
    """A turn's own conditions, else those confirmed before it."""
    own = lambda role: F.when(F.col("role") == role, F.length("text"))
    return jobs.carry_forward(t.conversations.select("conv_id", "turn", own("user").alias("asked"), own("system").alias("system")), ["asked", "system"])


@query("""SELECT role, min(text) FILTER (WHERE nth = 1) AS first_text FROM (SELECT role, text, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS nth FROM conversations) GROUP BY role""")
def first_occurrence_wins(t):
    return t.conversations.groupBy("role").agg(F.min_by("text", F.struct("conv_id", "turn")).alias("first_text"))


@query("""SELECT conv_id, turn, 'E' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS evidence_id FROM conversations WHERE role <> 'system'""")
def evidence_numbering(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.where("role != 'system'").select("conv_id", "turn", F.concat(F.lit("E"), F.row_number().over(w).cast("string")).alias("evidence_id"))


@query("""SELECT c_custkey AS job_id, o_orderdate AS created_at FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def oldest_claimable(t):
    queued = t.orders.where("o_orderstatus = 'O'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return queued.orderBy("o_orderdate", "o_orderkey").limit(1).select(F.col("c_custkey").alias("job_id"), F.col("o_orderdate").alias("created_at"))


@query("""SELECT l_suppkey, count(*) AS n, sum(CASE WHEN p_size BETWEEN l_quantity - 2 AND l_quantity + 2 THEN 1 ELSE 0 END) AS inside FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey""")
def containment_counts(t):
    c = F.col
    joined = t.lineitem.join(t.part, c("p_partkey") == c("l_partkey"))
    return joined.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(c("p_size").between(c("l_quantity") - 2, c("l_quantity") + 2), 1).otherwise(0)).alias("inside"))


@query("""WITH w AS (SELECT doc_id % 10 AS page_id, doc_id AS word, (doc_id * 37) % 600 AS x, (doc_id * 91) % 800 AS y FROM documents),
  b AS (SELECT p AS page_id, r AS row_no, c AS col_no, c * 120 AS x0, c * 120 + 110 AS x1, r * 90 AS y0, r * 90 + 80 AS y1 FROM range(10) a(p), range(9) d(r), range(5) e(c))
  SELECT page_id, row_no, col_no, string_agg(CAST(word AS VARCHAR), ' ' ORDER BY x DESC, word) AS text FROM w JOIN b USING (page_id) WHERE x + 5 >= x0 AND x + 5 < x1 AND y + 4 >= y0 AND y + 4 < y1 GROUP BY ALL""")
def words_in_cells(t):
    """Words to the grid cells that hold their centres: a range join in bands."""
    from ..sources.ocr import words_in_cells as place

    c = F.col
    words = t.documents.select((c("doc_id") % 10).alias("page_id"), c("doc_id").alias("w"), ((c("doc_id") * 37) % 600).alias("left"), ((c("doc_id") * 91) % 800).alias("top"))
    words = words.select("page_id", c("w").alias("word"), "left", "top", F.lit(10).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("line_no"))
    grid = t.spark.range(10).select(c("id").alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("row_no")).select("page_id", "row_no", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("col_no"))
    boxes = grid.select("page_id", c("row_no").cast("long").alias("row_no"), c("col_no").cast("long").alias("col_no"), (c("col_no") * 120).alias("x0"), (c("col_no") * 120 + 110).alias("x1"), (c("row_no") * 90).alias("y0"), (c("row_no") * 90 + 80).alias("y1"))
    return place(words, boxes)


@query("""SELECT user_id, min(event_id) AS "start", max(event_id) + 1 AS "end" FROM (SELECT user_id, event_id, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events WHERE event_type <> 'view') GROUP BY user_id, run""")
def runs_of_positions(t):
    """Gaps and islands."""
    from ..sources.ocr import islands

    return islands(t.events.withColumn("flag", F.col("event_type") != "view"), ["user_id"], "event_id", "flag")


@query("""SELECT page_id, word, sum(opens) OVER (PARTITION BY page_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS col_no FROM (SELECT doc_id % 50 AS page_id, doc_id AS word, x,
  CASE WHEN x - max(x + 10) OVER (PARTITION BY doc_id % 50 ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 40 THEN 1 ELSE 0 END AS opens FROM (SELECT doc_id, (doc_id * 7919) % 100003 % 3000 AS x FROM documents))""")
def borderless_columns(t):
    """Columns without rules: a wide gap opens the next one."""
    from ..sources.ocr import borderless_columns as columns

    c = F.col
    words = t.documents.select((c("doc_id") % 50).alias("page_id"), c("doc_id").alias("word"), ((c("doc_id") * 7919) % 100003 % 3000).alias("left"), F.lit(10).alias("width"), F.lit(1).alias("line_no"))
    return columns(words, 40).select("page_id", "word", c("col_no").cast("decimal(38,0)").alias("col_no"))


@query("""WITH u AS (SELECT doc_id AS upload_id, coalesce(lang, 'und') AS office_id, sha256(coalesce(text, '')) AS sha256, length(coalesce(text, '')) AS length FROM documents WHERE doc_id % 3 <> 0),
  held AS (SELECT coalesce(lang, 'und') AS office_id, sha256(coalesce(text, '')) AS sha256, min(doc_id) AS v FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 > 1 AND doc_id % 7 <> 2 GROUP BY ALL),
  f AS (SELECT office_id, sha256, min(upload_id) AS first FROM u WHERE length > 0 GROUP BY ALL)
  SELECT u.upload_id, CASE WHEN length = 0 THEN 'rejected' WHEN v IS NULL AND upload_id = first THEN 'accepted' ELSE 'duplicate' END AS outcome, CASE WHEN length = 0 THEN 'empty' END AS reason, CASE WHEN length > 0 THEN coalesce('v' || v, 'v-' || first) END AS version_id
  FROM u LEFT JOIN f USING (office_id, sha256) LEFT JOIN held USING (office_id, sha256)""")
def upload_outcomes(t):
    """Two thirds of the documents are uploaded where the others are versions, some of them failed, superseded or deleted."""
    c = F.col
    docs = t.documents.select("doc_id", F.coalesce("lang", F.lit("und")).alias("office_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sha256", F.sha2("text", 256))
    at = F.timestamp_micros(c("doc_id"))
    uploads = docs.where("doc_id % 3 != 0").select(c("doc_id").alias("upload_id"), "office_id", "sha256", F.length("text").alias("length"), F.lit("pdf").alias("format"), at.alias("uploaded_at"))
    known = docs.where("doc_id % 3 = 0")
    status = F.when(c("doc_id") % 5 == 0, "failed").when(c("doc_id") % 5 == 1, "superseded").otherwise("ready")
    versions = known.select(F.concat(F.lit("v"), "doc_id").alias("version_id"), "office_id", c("doc_id").alias("document_id"), "sha256", status.alias("status"), at.alias("uploaded_at"))
    return judge_uploads(uploads, versions, known.where("doc_id % 7 = 2").select(c("doc_id").alias("document_id")))

