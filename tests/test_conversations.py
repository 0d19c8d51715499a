"""Conversations as a stream: late turns, repeated batches, answers to what was asked back."""

import random
from datetime import datetime, timedelta

from factloom.plans.question import read_questions
from factloom.streaming.conversations import Conversations, read_turns

SHAPE = "conversation_id string, turn long, question string, asked_at timestamp, clarifies string, value string"
START = datetime(2024, 5, 1, 12)
ASKED = ["מה ממוצע מחירי עסקאות למ״ר בחיפה ב-2023 לפי תאריך עסקה?", "ומה לגבי רמת גן?", "ומה עם שטח נטו?", "מה ממוצע המחירים בחיפה?", "מחירי עסקאות ברמת גן ב-2022", "ומה לגבי 2021?", "למה נקבע שווי בחיפה?", None, ""]


def row(conversation, turn, question, clarifies=None, value=None):
    return (conversation, turn, question, START + timedelta(minutes=turn), clarifies, value)


def places(spark):
    return spark.createDataFrame([("חיפה", "הדר"), ("רמת גן", None)], "city string, neighborhood string")


def plain(df, *names):
    return sorted(str(tuple(r)) for r in df.select(*names).collect())


def test_stream_equals_one_table(spark, tmp_path):
    """Turns in any order over four batches, one of which comes twice."""
    rng = random.Random(7)
    rows = [row(f"c{k}", t, rng.choice(ASKED)) for k in range(12) for t in range(1, rng.randrange(3, 9))]
    rng.shuffle(rows)
    talks = Conversations(spark, f"file://{tmp_path}/talks")
    sink = talks.sink(places(spark))
    for n in range(4):
        part = [*rows[n::4], *rows[:2]]
        sink(spark.createDataFrame(part, SHAPE), n)
    sink(spark.createDataFrame([row("c1", 99, ASKED[0])], SHAPE), 3)
    names = ("turn", "intent", "data_kind", "date_field", "year_from", "year_to", "city", "neighborhood", "area_type", "property_type", "vat_basis", "route", "unknown_place", "missing")
    whole = read_questions(spark.createDataFrame(rows, SHAPE), places(spark))
    assert plain(talks.readings(), "version_id", *names) == plain(whole, "conversation_id", *names)
    assert "followup" in str(plain(whole, "route"))


def test_what_was_asked_back_is_resumed(spark, tmp_path):
    rows = [
        row("a", 1, ASKED[4]), row("a", 2, None, "date_field", "transaction_date"), row("a", 3, "ומה לגבי חיפה?"),
        row("b", 1, ASKED[3]), row("b", 2, None, "data_kind", "nonsense"), row("b", 3, None, "date_field", "valuation_date"), row("b", 4, None, "data_kind", "asking_price"),
        row("c", 1, ASKED[4]), row("c", 2, None, "date_field", "valuation_date"), row("c", 3, ASKED[4]),
        row("d", 1, None, "data_kind", "asking_price"), row("e", 5, ASKED[4]),
    ]
    talks = Conversations(spark, f"file://{tmp_path}/talks")
    sink = talks.sink(places(spark))
    # The answers come before the questions that they belong to.
    sink(spark.createDataFrame(rows[1::2], SHAPE), 0)
    sink(spark.createDataFrame(rows[0::2], SHAPE), 1)
    got = {(r.version_id, r.turn): (r.data_kind, r.date_field, r.city, r.route, r.missing) for r in talks.readings().collect()}
    assert got["a", 1] == ("transaction_price", None, "רמת גן", "rules", ["date_field"])
    assert got["a", 2] == ("transaction_price", "transaction_date", "רמת גן", "rules+clarification", [])
    assert got["a", 3] == ("transaction_price", "transaction_date", "חיפה", "followup", [])
    assert [got["b", t][0] for t in (1, 2, 3, 4)] == [None, None, None, "asking_price"] and got["b", 4][4] == [] and got["b", 4][1] is None
    assert got["c", 3][1] is None and got["c", 3][4] == ["date_field"]  # a new question begins anew
    assert ("d", 1) not in got
    waiting = {r.version_id: (r.turn, r.ask) for r in talks.pending(START + timedelta(minutes=10)).collect()}
    assert waiting == {"c": (3, "date_field"), "e": (5, "date_field")}
    assert {r.version_id for r in talks.pending(START + timedelta(minutes=34)).collect()} == {"e"}
    whole = spark.createDataFrame([(r[0], *r[1:]) for r in rows], SHAPE.replace("conversation_id", "version_id"))
    assert plain(read_turns(whole, places(spark)), *talks.readings().columns) == plain(talks.readings(), *talks.readings().columns)


def test_a_live_stream_of_turns(spark, tmp_path):
    talks, given = Conversations(spark, f"file://{tmp_path}/talks"), tmp_path / "in"

    def run(rows):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(str(given))
        stream = spark.readStream.schema(SHAPE).parquet(str(given))
        stream.writeStream.foreachBatch(talks.sink(places(spark))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return {(r.version_id, r.turn): r.city for r in talks.readings().collect()}

    assert run([row("a", 1, ASKED[0]), row("a", 3, ASKED[2])]) == {("a", 1): "חיפה", ("a", 3): "חיפה"}
    # A turn between the two comes late; what follows it carries it on.
    assert run([row("a", 2, ASKED[1])]) == {("a", 1): "חיפה", ("a", 2): "רמת גן", ("a", 3): "רמת גן"}
