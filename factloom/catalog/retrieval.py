"""Retrieval over documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import embedding
from ..operators.index import SearchIndex
from ..rounds import scratch_folder
from .registry import query

TERMS = ["idiot", "thonin", "stupid", "reer", "and"]
QUERY = "stupid idiot thonin"
TOK = r"tok AS (SELECT doc_id AS chunk_id, text, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS tokens, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS every FROM documents)"
LEX = f"""df AS (SELECT count(*) AS n, {", ".join(f"count(*) FILTER (WHERE list_contains(tokens, '{w}')) AS d{i}" for i, w in enumerate(TERMS))} FROM tok),
  lex AS (SELECT chunk_id, round({" + ".join(f"CASE WHEN list_contains(tokens, '{w}') THEN ln((greatest(n, 1) + 1) / (d{i} + 0.5)) ELSE 0 END" for i, w in enumerate(TERMS))}, 9) AS score,
    round(0.1 * len(list_filter(every, lambda w: list_contains([{", ".join(f"'{w}'" for w in TERMS)}], w))), 6) AS cover FROM tok, df WHERE list_has_any(tokens, [{", ".join(f"'{w}'" for w in TERMS)}]) ORDER BY score DESC, cover DESC, chunk_id LIMIT 40)"""
GRAMS = "flatten(list_transform(list_filter(string_split_regex(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substring('  ' || w || ' ', i, 3))))"
#: Every run of a text's trigrams that begins and ends with one of the query's; 100 trigrams are more than a run above the threshold has.
#: A trigram is new in a run if its occurrence before lies ahead of the run.
EXTENTS = """asked AS (SELECT unnest(list_distinct({q})) AS gram), k AS (SELECT count(*) AS k FROM asked), g AS (SELECT id, {g} AS g FROM {t}),
  p AS (SELECT id, unnest(g) AS gram, generate_subscripts(g, 1) AS i FROM g), near AS (SELECT id FROM p SEMI JOIN asked USING (gram) GROUP BY id HAVING count(DISTINCT gram) > {least} * (SELECT k FROM k)),
  o AS (SELECT id, i, gram IN (SELECT gram FROM asked) AS own, coalesce(lag(i) OVER (PARTITION BY id, gram ORDER BY i), 0) AS before FROM p SEMI JOIN near USING (id)),
  e AS (SELECT o.id, o.own, count(*) FILTER (WHERE o.own AND o.before < x.i) OVER w AS common, count(*) FILTER (WHERE NOT o.own AND o.before < x.i) OVER w AS other FROM o x JOIN o ON x.own AND o.id = x.id AND o.i BETWEEN x.i AND x.i + 99 WINDOW w AS (PARTITION BY x.id, x.i ORDER BY o.i)),
  word_sim AS (SELECT id, max(common / CAST(k + other AS DOUBLE)) AS s FROM e, k WHERE own GROUP BY id)"""
TRI = EXTENTS.format(q=GRAMS.format(t=f"'{QUERY}'"), g=GRAMS.format(t="text"), t="(SELECT chunk_id AS id, text FROM tok)", least=0.35) + ", tri AS (SELECT id AS chunk_id, round(s, 9) AS score FROM word_sim WHERE round(s, 9) > 0.35 ORDER BY score DESC, chunk_id LIMIT 40)"
SEM = """sem AS (SELECT e.vec_id AS chunk_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY score DESC, chunk_id LIMIT 40)"""
FUSED = """ranks AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank, 'lexical' AS list FROM lex UNION ALL SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id), 'trigram' FROM tri
  UNION ALL SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id), 'semantic' FROM sem),
  fused AS (SELECT chunk_id, round(sum(CASE list WHEN 'lexical' THEN 2.0 ELSE 1.0 END / CAST(60 + rank AS DOUBLE)), 9) AS score, min(CASE WHEN list = 'lexical' THEN rank END) AS lexical_rank, bool_or(list <> 'semantic') AS lexical_support FROM ranks GROUP BY chunk_id),
  placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS f FROM fused),
  head AS (SELECT list(chunk_id ORDER BY f) FILTER (WHERE f <= 8) AS top, min(chunk_id) FILTER (WHERE lexical_rank = 1) AS l1, min(chunk_id) FILTER (WHERE lexical_rank = 2) AS l2 FROM placed),
  one AS (SELECT CASE WHEN l1 IS NULL OR list_contains(top, l1) THEN top ELSE list_prepend(l1, top) END AS top, l2 FROM head),
  two AS (SELECT CASE WHEN l2 IS NULL OR list_contains(top, l2) THEN top ELSE list_concat(list_append(top[1:1], l2), top[2:]) END AS top FROM one),
  best AS (SELECT placed.*, list_position(top, chunk_id) AS place FROM placed, two WHERE list_contains(top, chunk_id))"""


def _chunks(t):
    return t.documents.select(F.col("doc_id").alias("chunk_id"), "text", R.padded(F.col("text")).alias("padded"))


def _tokens(t):
    return t.documents.select(F.col("doc_id").alias("chunk_id"), F.array_distinct(R.words(F.col("text"))).alias("tokens"))


def _vector(t):
    return [float(x) for x in t.embeddings.where("vec_id = 7").first()["embedding"]]


def _semantic(t):
    return R.semantic(t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding"), _vector(t))


@query(f"WITH {TOK}, {LEX} SELECT chunk_id, score FROM lex")
def lexical_top40(t):
    return R.lexical(_chunks(t), TERMS)


@query(f"WITH {TOK}, {LEX} SELECT n, {', '.join(f'd{i}' for i in range(len(TERMS)))} FROM df")
def doc_frequency_one_pass(t):
    return R.frequencies(_chunks(t), TERMS)


def _index(t, vectors: bool = False) -> SearchIndex:
    """A search index over all documents, each a chunk of a version of its own."""
    index = SearchIndex(t.spark, scratch_folder(t.spark, "search"), "long")
    index.apply("all", _versions(t.documents, t.embeddings if vectors else None))
    return index


def _versions(documents, embeddings=None):
    chunks = documents.select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("v"), F.col("doc_id")).alias("version_id"), F.col("text").alias("normalized_text"))
    if embeddings is None:
        return chunks
    return chunks.join(embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit("m1").alias("embedding_model")), "chunk_id", "left")


def _seen(documents):
    return documents.select(F.concat(F.lit("v"), F.col("doc_id")).alias("version_id"))


@query(f"WITH {TOK}, {LEX} SELECT chunk_id, score FROM lex")
def lexical_by_postings(t):
    """The same list from the search index."""
    return _index(t).lexical(_seen(t.documents), TERMS)


PHRASES = ["of the", "stupid idiot", "moron", "thonin the and"]
NUMBERED = [p.split() for p in PHRASES]
ASKED = sorted({w for p in NUMBERED for w in p})


@query(f"""WITH t AS (SELECT doc_id AS chunk_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
  o AS (SELECT * FROM (SELECT chunk_id, unnest(w) AS w, unnest(range(len(w))) AS p FROM t) WHERE w IN ({", ".join(f"'{w}'" for w in ASKED)})),
  n AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY p) AS nth FROM o),
  ends AS (SELECT chunk_id, p, nth, {", ".join(f"max(CASE WHEN w = '{w}' THEN nth END) OVER (PARTITION BY chunk_id ORDER BY p) AS l{i}" for i, w in enumerate(ASKED))}, w FROM n),
  shortest AS (SELECT chunk_id, p AS q, nth AS b, greatest({", ".join(f"CASE WHEN w IN ({', '.join(repr(w) for w in p)}) THEN {' + 0 * '.join([f'least({chr(44).join(f"l{ASKED.index(w)}" for w in p)})' if len(p) > 1 else f'l{ASKED.index(p[0])}', *(f'l{ASKED.index(w)}' for w in p)])} END" for p in NUMBERED)}) AS a FROM ends),
  covers AS (SELECT * FROM (SELECT *, max(a) OVER (PARTITION BY chunk_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM shortest WHERE a IS NOT NULL) WHERE before IS NULL OR a > before)
  SELECT c.chunk_id, round(sum(0.1 / (1 + (q - n.p) - (b - a))), 6) AS cover FROM covers c JOIN n ON n.chunk_id = c.chunk_id AND n.nth = c.a GROUP BY c.chunk_id""")
def lexical_cover(t):
    """Cover density of every text for any of four terms, three of them of several words."""
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), R.occurrences_of(F.col("text"), ASKED).alias("seen"))
    rank = R.cover_rank(F.col("seen"), [[ASKED.index(w) for w in p] for p in NUMBERED], len(ASKED))
    return chunks.select("chunk_id", rank.alias("cover")).where("cover > 0")


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN replace(text, 'the', 'thus') || ' changed once more' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 2),
  w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM d)
  SELECT term, count(DISTINCT doc_id) AS chunks, count(*) AS occurrences FROM w GROUP BY term""")
def search_index_after_changes(t):
    """Every word of an index in which some versions were replaced and others withdrawn."""
    index, docs = _index(t), t.documents
    changed = docs.where("doc_id % 4 = 0").withColumn("text", F.concat(F.replace("text", F.lit("the"), F.lit("thus")), F.lit(" changed once more")))
    index.apply("changed", _versions(changed))
    index.apply("withdrawn", _versions(docs.where("false")), gone=_seen(docs.where("doc_id % 5 = 2")))
    index.apply("changed", _versions(docs.where("doc_id % 4 = 0")))  # a batch that comes again changes nothing
    return index.store.read("terms").groupBy("term").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size("positions")).alias("occurrences"))


@query("""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score
    FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id % 7 = 3)
  SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 40""")
def vector_index_in_scope(t):
    """Lists are looked into until nothing nearer can be left, among a seventh of the versions."""
    index, every = _vector_index(t)
    queries = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return index.nearest(queries, every.where("chunk_id % 7 = 3"), 40, exact=True)


@query("SELECT count(*) AS queries, count(*) * least(40, (SELECT count(*) FROM embeddings)) AS wanted, true AS recalled FROM embeddings WHERE vec_id % 20 = 0")
def vector_index_recall(t):
    """Whether lists that are looked into by nearness alone give nine tenths of the true 40 nearest."""
    index, every = _vector_index(t)
    queries = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = index.nearest(queries, every, 40).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    true = index.nearest(queries, every, 40, exact=True).select("query_id", "chunk_id")
    per = true.join(found, ["query_id", "chunk_id"], "left").agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("hits"))
    return per.select("queries", "wanted", (F.col("hits") >= 0.9 * F.col("wanted")).alias("recalled"))


def _vector_index(t):
    index = SearchIndex(t.spark, scratch_folder(t.spark, "vectors"), "long")
    every = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("v"), F.col("vec_id")).alias("version_id"), F.lit("").alias("normalized_text"), "embedding", F.lit("").alias("embedding_model"))
    index.apply("all", every)
    return index, every


@query(f"WITH {TOK}, {TRI} SELECT chunk_id, score FROM tri")
def trigram_top40(t):
    return R.trigram(_chunks(t), QUERY)


@query(f"WITH {SEM} SELECT chunk_id, score FROM sem")
def vector_top40(t):
    return _semantic(t)


@query(f"WITH {TOK}, {LEX}, {TRI}, {SEM}, {FUSED} SELECT chunk_id, score, lexical_support, place FROM best WHERE place <= 8")
def rrf_fusion(t):
    """Three lists fused by reciprocal ranks, two places guaranteed to the best lexical hits."""
    chunks = _chunks(t)
    fused = R.fuse({"lexical": R.lexical(chunks, TERMS), "trigram": R.trigram(chunks, QUERY), "semantic": _semantic(t)})
    return fused.select("chunk_id", "score", "lexical_support", F.col("place").cast("long").alias("place"))


@query(f"WITH {TOK}, {LEX}, {TRI}, {SEM}, {FUSED} SELECT 'E' || row_number() OVER (ORDER BY place) AS evidence_id, chunk_id FROM best WHERE place <= 8 AND lexical_support QUALIFY row_number() OVER (ORDER BY place) <= 6")
def supported_evidence(t):
    chunks = _chunks(t)
    fused = R.fuse({"lexical": R.lexical(chunks, TERMS), "trigram": R.trigram(chunks, QUERY), "semantic": _semantic(t)})
    return R.evidence(fused).select("evidence_id", "chunk_id")


@query(f"WITH {TOK}, {LEX}, {TRI} SELECT chunk_id, count(*) AS lists FROM (SELECT chunk_id FROM lex UNION ALL SELECT chunk_id FROM tri) GROUP BY chunk_id")
def union_supported(t):
    chunks = _chunks(t)
    both = R.lexical(chunks, TERMS).select("chunk_id").unionByName(R.trigram(chunks, QUERY).select("chunk_id"))
    return both.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("lists"))


@query(f"WITH {TOK} SELECT chunk_id FROM tok WHERE list_has_any(tokens, [{', '.join(repr(w) for w in TERMS[:3])}])")
def or_terms(t):
    return _tokens(t).where(F.arrays_overlap("tokens", F.array(*(F.lit(w) for w in TERMS[:3])))).select("chunk_id")


@query(f"WITH {TOK} SELECT chunk_id, len(list_filter(tokens, lambda w: NOT list_contains(['the', 'of', 'and', 'is'], w))) AS others FROM tok")
def array_difference(t):
    return _tokens(t).select("chunk_id", F.size(F.array_except("tokens", F.array(*(F.lit(w) for w in ("the", "of", "and", "is"))))).cast("long").alias("others"))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), k AS (SELECT doc_id, i, trim(x) AS x FROM s WHERE trim(x) <> '')
  SELECT doc_id, arg_max(x, (len(list_filter(['the', 'and', 'thon'], lambda t: contains(lower(x), t))), -i)) AS best FROM k GROUP BY doc_id""")
def best_sentence(t):
    """The line of each document with most query terms, the first of equals."""
    asked = F.array(*(F.lit(w) for w in ("the", "and", "thon")))
    each = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).select("doc_id", "i", F.trim("x").alias("x")).where("x != ''")
    hits = F.size(F.filter(asked, lambda w: F.contains(F.lower("x"), w)))
    return each.groupBy("doc_id").agg(F.max_by("x", F.struct(hits, F.negative("i"))).alias("best"))


@query("""SELECT o_orderkey AS answer, CASE o_orderkey % 5 WHEN 0 THEN 'unknown_citation' WHEN 1 THEN 'unsupported_number' WHEN 2 THEN 'links_or_markup' WHEN 3 THEN 'no_citations' END AS problem FROM orders""")
def verify_numbers(t):
    """Problems of a written answer to each order: markup, citations, numbers without support."""
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    price = F.when(k % 5 == 1, n + 1).otherwise(n).cast("string")
    cited = F.when(k % 5 == 0, " [E9]").when(k % 5 == 2, " [E1], see http://x").when(k % 5 == 3, "").otherwise(" [E1]")
    d = t.orders.select(k.alias("answer"), F.concat(F.lit("Price "), price, cited).alias("text"), F.array().cast("array<string>").alias("used"), F.array(F.lit("E1"), F.lit("E2")).alias("allowed_ids"), F.array(n.cast("string")).alias("allowed_numbers"))
    return R.verify(d).select("answer", F.explode_outer("problems").alias("problem"))


OWN = SEM.replace("FROM embeddings e", "FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) e")


@query(f"WITH {TOK}, {LEX}, {TRI}, {OWN}, {FUSED} SELECT chunk_id, score, lexical_support, place FROM best WHERE place <= 8")
def hybrid_search(t):
    """The whole search, joined back to the documents."""
    chunks = _chunks(t).join(t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit("m1").alias("embedding_model")), "chunk_id", "left")
    return R.hybrid_search(chunks, TERMS, QUERY, _vector(t), "m1").select("chunk_id", "score", "lexical_support", F.col("place").cast("long").alias("place"))


@query(f"WITH {EXTENTS.format(q=GRAMS.format(t=repr(QUERY)), g=GRAMS.format(t='text'), t='(SELECT item_id AS id, text FROM benchmark)', least=-1)} SELECT item_id, round(coalesce(s, 0), 6) AS similarity FROM benchmark LEFT JOIN word_sim ON id = item_id")
def word_similarity(t):
    """The extent form of trigram similarity."""
    return t.benchmark.select("item_id", F.round(R.word_similarity(QUERY)(F.col("text")), 6).alias("similarity"))


@query(f"WITH {TOK}, {LEX}, {TRI}, {OWN}, {FUSED} SELECT chunk_id, score, lexical_support, place FROM best WHERE place <= 8")
def hybrid_search_by_index(t):
    """The whole search from the index: no text is read but of what trigrams lead to."""
    index, visible, vector = _index(t, True), _seen(t.documents), _vector(t)
    one = t.spark.createDataFrame([(0, vector)], "query_id int, vector array<double>")
    semantic = index.nearest(one, visible, R.CANDIDATES, "m1", exact=True).select("chunk_id", "score")
    fused = R.fuse({"lexical": index.lexical(visible, TERMS), "trigram": index.trigram(visible, QUERY), "semantic": semantic})
    return fused.select("chunk_id", "score", "lexical_support", F.col("place").cast("long").alias("place"))


@query("""WITH c AS (SELECT doc_id AS chunk_id, replace(text, 'th', 'TH') AS normalized, replace(text, 'th', 'xx') AS shown FROM documents),
  """ + EXTENTS.format(q=GRAMS.format(t="'thonin thereal'"), g=GRAMS.format(t="text"), t="(SELECT chunk_id AS id, normalized AS text FROM c)", least=0.35) + """
  SELECT id AS chunk_id, round(s, 9) AS score FROM word_sim WHERE round(s, 9) > 0.35 ORDER BY score DESC, chunk_id LIMIT 40""")
def trigram_of_normalized_text(t):
    """What is shown differs from what is searched."""
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.replace("text", F.lit("th"), F.lit("xx")).alias("text"), F.replace("text", F.lit("th"), F.lit("TH")).alias("normalized_text"))
    return R.trigram(chunks.withColumn("padded", R.padded(F.col("normalized_text"))), "thonin thereal")


def _letters():
    """A model that counts: characters, and how many of them are blanks and the letter e."""
    return lambda texts: [[float(len(x)), float(x.count(" ")), float(x.count("e"))] for x in texts]


@query("SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS blanks, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS e, (SELECT count(DISTINCT text) FROM documents) AS made FROM documents")
def embeddings_in_two_runs(t):
    """Vectors of half of the documents, then of all: the second run makes those that are missing."""
    path = scratch_folder(t.spark, "vectors")
    made = [embedding.embed_pending(docs, path, _letters, "letters") for docs in (t.documents.where("doc_id % 2 = 0"), t.documents, t.documents)]
    v = F.col("embedding").cast("array<double>")
    found = embedding.with_vectors(t.documents.select("doc_id", "text"), embedding.vectors_at(t.spark, path), "letters")
    return found.select("doc_id", v[0].alias("chars"), v[1].alias("blanks"), v[2].alias("e"), F.lit(sum(made)).cast("long").alias("made"))
