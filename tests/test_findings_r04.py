"""Findings of round 4: queries on odd and larger inputs."""

import datetime
from collections import Counter
from decimal import Decimal

import numpy as np

from factloom.catalog import QUERIES
from factloom.operators import index as I
from factloom.sources import ocr


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_words_at_one_place_are_ordered_as_their_column(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 0, 100, 0, 100)], "page_id int, row_no int, col_no int, x0 int, x1 int, y0 int, y1 int")
    words = lambda kind, own: spark.createDataFrame([(1, w, 10, 10, 4, 4, 1) for w in own] + [(1, own[0], 40, 10, 4, 4, 1)], f"page_id int, word {kind}, left int, top int, width int, height int, line_no int")
    assert ocr.words_in_cells(words("long", [9, 100, 20]), boxes).first()["text"] == "9 9 20 100"
    assert ocr.words_in_cells(words("string", ["9", "100", "20"]), boxes).first()["text"] == "9 100 20 9"


def test_disjunction_is_two_equi_joins(spark, tmp_path):
    suppliers = [(1, 1, 10.4), (2, 1, -0.2), (3, 1, None), (4, 2, 7.0), (4, 2, 7.0), (5, None, 7.0), (None, 1, 10.0), (6, 1, float("nan"))]
    customers = [(1, 1, 9.6), (2, 1, 0.3), (3, 1, 10.0), (4, 2, 7.0), (5, 1, 7.0), (8, 2, 6.6), (None, 1, 10.0), (9, 1, float("nan")), (3, 1, None)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = QUERIES["disjunctive_match"](spark, str(tmp_path))
    same = lambda x, y: x is not None and y is not None and (x != x and y != y or round(x) == round(y) if x == x and y == y else x != x and y != y)
    want = Counter((a, b) for a, n, x in suppliers for b, m, y in customers if n is not None and n == m and (same(x, y) or (a is not None and a == b)))
    assert rows_of(got) == want and want[(4, 4)] == 2
    # Neither join compares all pairs of a place.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert " OR " not in plan and plan.count("Join Inner") == 2


def test_nearest_holds_no_row_for_each_query_and_list(spark, tmp_path, monkeypatch):
    """Vectors in many small tiles, equal ones and ones without length among them, against all pairs."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-3, 4, size=(300, 6)).astype(float)  # many are equal or score equally
    vectors[50:90] = vectors[50]
    vectors[7] = 0.0
    rows = [(f"c{i:03d}", f"v{i % 20}", "", [float(x) for x in v], "h") for i, v in enumerate(vectors)]
    own = I.SearchIndex(spark, f"file://{tmp_path}")
    own.apply("all", spark.createDataFrame(rows, "chunk_id string, version_id string, normalized_text string, embedding array<float>, embedding_model string"))
    asked = [0, 7, 50, 51, 120]
    queries = spark.createDataFrame([(q, [float(x) for x in vectors[q]]) for q in asked], "query_id int, vector array<double>")
    visible = spark.createDataFrame([(f"v{i}",) for i in range(0, 20, 3)], "version_id string")
    monkeypatch.setattr(I, "TILE", 128)
    monkeypatch.setattr(I, "SLICE", 64)
    held = []
    monkeypatch.setattr(I, "checkpointed", lambda df, real=I.checkpointed: held.append((out := real(df)).count()) or out)
    got = {}
    for r in own.nearest(queries, visible, 8, "h", exact=True).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score))
    few = [i for i in range(300) if i % 20 % 3 == 0]
    for q in asked:
        cosine = {i: round(float(vectors[q] @ vectors[i]) / n, 9) if (n := float(np.linalg.norm(vectors[q]) * np.linalg.norm(vectors[i]))) else None for i in few}
        want = sorted(few, key=lambda i: (cosine[i] is None, -(cosine[i] or 0.0), i))[:8]
        assert [(k, c) for k, c, _ in sorted(got[q])] == [(k, f"c{i:03d}") for k, i in enumerate(want, 1)]
        assert all((s is None) == (cosine[i] is None) and (s is None or abs(s - cosine[i]) < 2e-9) for (_, _, s), i in zip(sorted(got[q]), want, strict=True))
    assert max(held) <= len(asked) * 8


def test_a_scope_is_joined_to_rows_once(spark, tmp_path):
    """The scope narrows the manifest; rows themselves are joined with nothing else."""
    own = I.SearchIndex(spark, f"file://{tmp_path}", "int")
    own.apply("all", spark.createDataFrame([(i, f"v{i}", "", [1.0, float(i)], "h") for i in range(9)], "chunk_id int, version_id string, normalized_text string, embedding array<float>, embedding_model string"))
    visible = spark.createDataFrame([("v1",), ("v1",), ("v4",), (None,)], "version_id string")
    rows = own._scoped("vectors", visible)
    assert {r.chunk_id for r in rows.collect()} == {1, 4}
    above = rows._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert above.count("Join LeftSemi") == 1


def test_index_shuffles_no_words_and_reads_rows_in_place(spark, tmp_path, monkeypatch):
    plans = {}
    real = I.VersionStore.stage

    def stage(self, batch, name, rows, **more):
        plans[name] = rows._jdf.queryExecution().executedPlan().toString(), more
        real(self, batch, name, rows, **more)

    monkeypatch.setattr(I.VersionStore, "stage", stage)
    own = I.SearchIndex(spark, f"file://{tmp_path}", "int")
    shape = "chunk_id int, version_id string, normalized_text string"
    own.apply("one", spark.createDataFrame([(1, "v1", "a b a"), (1, "v1", "b"), (2, "v2", "b ab"), (3, "v3", None)], shape))
    own.apply("two", spark.createDataFrame([(2, "v2", "c")], shape))
    assert all("hashpartitioning(term" not in plans[n][0] and plans[n][1] == {"deal": False} for n in ("terms", "grams"))
    rows = own.store.read("terms")
    assert sorted((r.term, r.chunk_id, list(r.positions)) for r in rows.collect()) == [("a", 1, [0, 2]), ("b", 1, [0, 1]), ("c", 2, [0])]
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    # Beyond the bound the rows go to the versions, with the same result.
    monkeypatch.setattr("factloom.sources.store.SENT", -1)
    assert sorted((r.term, r.chunk_id) for r in own.store.read("terms").collect()) == [("a", 1), ("b", 1), ("c", 2)]


def _index(spark, tmp_path):
    own = I.SearchIndex(spark, f"file://{tmp_path}", "int")
    own.apply("one", spark.createDataFrame([(i, f"v{i}", "stupid idiot" if i % 3 else "river") for i in range(9)], "chunk_id int, version_id string, normalized_text string"))
    return own, spark.createDataFrame([(f"v{i}",) for i in range(6)], "version_id string")


def test_postings_of_a_scope_are_not_shuffled(spark, tmp_path):
    own, visible = _index(spark, tmp_path)
    rows = own._scoped("terms", visible)
    assert "hashpartitioning(version_id" not in rows.where("term = 'idiot'")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert [r.chunk_id for r in own.lexical(visible, ["idiot"]).collect()] == [1, 2, 4, 5]


def test_texts_stay_where_they_are_in_a_trigram_search(spark, tmp_path, monkeypatch):
    own, visible = _index(spark, tmp_path)
    seen = []
    monkeypatch.setattr(I.R, "similar_texts", lambda texts, *a, real=I.R.similar_texts: seen.append(texts._jdf.queryExecution().executedPlan().toString()) or real(texts, *a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [r.chunk_id for r in own.trigram(visible, "stupid idiot").collect()] == [1, 2, 4, 5]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert seen and "SortMergeJoin" not in seen[0] and "hashpartitioning" not in seen[0]


def test_questions_meet_kinds_of_facts(spark):
    """Copies of facts add no rows to what questions meet, and a fact of several records counts once."""
    from factloom.plans import batch

    shape = "transaction_id string, data_kind string, city string, neighborhood string, property_type string, fact_area_type string, vat_basis string, transaction_date date, valuation_date date, report_date date, verification_status string, is_current boolean, deleted_at timestamp, version_id string, price decimal(16,2), area decimal(12,2), fact_price decimal(16,2), fact_area decimal(12,2), stated decimal(14,2)"
    d = datetime.date
    rows = []
    for i in range(6):  # fact a twice in one city, once waiting elsewhere; b has no type; c waits; d is elsewhere
        for name, kinds in (("a", (("x", "flat", True), ("x", "flat", True), ("y", "flat", False))), ("b", (("x", None, True),)), ("c", (("x", "flat", False),)), ("d", (("y", "shop", True), ("y", None, True)))):
            for city, kind, sure in kinds:
                price, area = Decimal(100 * (i + 1)), Decimal(10)
                rows.append((f"{name}{i}", "sale", city, "h", kind, "net", "vat", d(2020 + i % 2, 5, 1), None, None, "human_verified" if sure else "needs_review", True, None, f"v{i}", price, area, price, area, None))
    records = spark.createDataFrame(rows, shape)
    asked = [(1, "x", None, None), (2, None, None, None), (3, "y", None, None), (4, "x", "flat", 2020), (5, "z", None, None)]
    questions = spark.createDataFrame([(q, "sale", city, None, kind, None, None, year and "transaction_date", year, year) for q, city, kind, year in asked], "question_id int, data_kind string, city string, neighborhood string, property_type string, area_type string, vat_basis string, date_field string, year_from int, year_to int")
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(6)] + [("a0", "a2"), ("a0", "a1"), ("c1", "c2")], "a string, b string")
    answers, cited = batch.answer_questions(questions, records, pairs)
    got = {r.question_id: r for r in answers.collect()}
    assert (got[1].outcome, got[1].n, got[1].awaiting, got[1].uncertain, got[1].mean, got[1].median) == ("numeric", 12, 6, 8, 35.0, 35.0)
    assert (got[2].outcome, got[2].ask, [tuple(o) for o in got[2].options]) == ("clarification", "property_type", [("flat", 6), ("shop", 6)])
    assert (got[3].outcome, got[3].n, got[3].awaiting) == ("numeric", 6, 6)
    assert (got[4].n, got[4].awaiting, got[4].uncertain, got[4].least, got[4].most) == (3, 3, 1, 10.0, 50.0) and got[5].outcome == "abstain"
    assert {r.version_id for r in cited.where("question_id = 4").collect()} == {"v0", "v2", "v4"}
    cells = batch.alike(records)[0]
    assert cells.count() == batch.alike(records.where("substr(transaction_id, 2) < '2'"))[0].count() == 2 * (2 + 1 + 1 + 2)
