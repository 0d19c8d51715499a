"""A table of questions answered in one job, and their answers kept as a table.

Equal conditions are answered once. Conditions are joined to records by equality
on those columns that they set: a condition that isn't set takes no part in the
join, so there is one equi-join for each set of columns that occurs (at most 32),
and never a comparison of all questions with all records. Facts whose records
state the same are counted first, so that the join meets each kind of fact once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import price_conflict, price_per_area
from ..operators import stats
from ..rounds import checkpointed, written
from ..sources.store import VersionStore
from .conditions import AWAITING, DATE_FIELDS, VERIFIED

#: Conditions that are equal or absent, with the records' columns; the kind is always set.
EQUAL = {"city": "city", "neighborhood": "neighborhood", "property_type": "property_type", "area_type": "fact_area_type", "vat_basis": "vat_basis"}
SPAN = ("date_field", "year_from", "year_to")
CONDITIONS = ("data_kind", *EQUAL, *SPAN)
#: What is asked about first, and from how many facts on there is a median.
MIXED, MEDIAN_FROM = ("area_type", "property_type", "vat_basis"), 3
#: Up to so many conditions of one kind are sent to the records; beyond that both are shuffled.
SENT = 200_000


def _missing() -> Column:
    return F.when(F.col("data_kind").isNull(), "data_kind").when(F.col("year_from").isNotNull() & F.col("date_field").isNull(), "date_field")


def _in_span(own=F.col) -> Column:
    """Whether a record's chosen date lies in the years; a question without years takes all."""
    date = F.coalesce(*(F.when(F.col("q_date_field") == name, own(name)) for name in DATE_FIELDS))
    first, after = F.make_date("q_year_from", F.lit(1), F.lit(1)), F.make_date(F.coalesce("q_year_to", "q_year_from") + 1, F.lit(1), F.lit(1))
    return F.col("q_year_from").isNull() | F.coalesce((date >= first) & (date < after), F.lit(False))


def _meets(cell: Column) -> Column:
    """Whether a cell beside a joined row meets the row's conditions too."""
    equal = reduce(lambda a, b: a & b, (F.col(f"q_{n}").isNull() | (cell[column] == F.col(f"q_{n}")) for n, column in EQUAL.items()))
    return F.coalesce((cell["data_kind"] == F.col("q_data_kind")) & equal & _in_span(lambda n: cell[n]), F.lit(False))


def matched(conditions: DataFrame, records: DataFrame, *also: Column) -> DataFrame:
    """Live records (verified or waiting) with the condition_id of each set of conditions that they meet.

    also may name further columns made of a record and the conditions (q_ and the condition's name).
    """
    live = records.where(F.col("is_current") & F.col("deleted_at").isNull() & F.col("verification_status").isin(*VERIFIED, *AWAITING))
    asked = conditions.select("condition_id", *(F.col(n).alias(f"q_{n}") for n in CONDITIONS))
    shape = F.concat(*(F.col(f"q_{n}").isNotNull().cast("int").cast("string") for n in EQUAL))
    asked = asked.withColumn("shape", shape)
    parts = []
    for mask, n in sorted(tuple(r) for r in asked.groupBy("shape").count().collect()):  # at most 2^5
        on = [F.col("data_kind") == F.col("q_data_kind")] + [F.col(column) == F.col(f"q_{name}") for (name, column), bit in zip(EQUAL.items(), mask, strict=True) if bit == "1"]
        own = asked.where(F.col("shape") == mask)
        parts.append(live.join(F.broadcast(own) if n <= SENT else own, on).where(_in_span()).select("condition_id", *live.columns, *also))
    if parts:
        return reduce(DataFrame.unionByName, parts)
    return live.crossJoin(asked).where("false").select("condition_id", *live.columns, *also)


def alike(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cells, groups, members, kinds): facts whose records state the same, up to the year of a date, meet the same questions.

    cells has a row for each different record of each likeness, as matched takes
    records, with the number of its facts and of the disputed ones, and with the
    likeness' cells before it, verified ones first: the first cell that meets a
    question stands for the likeness, so none is counted twice; groups counts
    a likeness' facts by price and area; members tells each fact's likeness, kinds
    each likeness' cells. So
    questions meet kinds of facts, however many facts there are of each.
    """
    c = F.col
    live = records.where(c("is_current") & c("deleted_at").isNull())
    status = c("verification_status")
    cell = F.struct((~status.isin(*VERIFIED)).alias("waits"), "data_kind", *EQUAL.values(), *(F.trunc(n, "year").alias(n) for n in DATE_FIELDS), F.when(status.isin(*VERIFIED), VERIFIED[0]).otherwise(AWAITING[0]).alias("verification_status"))
    counted = status.isin(*VERIFIED, *AWAITING)
    facts = live.groupBy("transaction_id").agg(
        F.array_sort(F.collect_set(F.when(counted, cell))).alias("cells"), F.min(F.when(counted, c("fact_price"))).alias("price"), F.min(F.when(counted, c("fact_area"))).alias("area"),
        F.bool_or(price_conflict(c("stated"), price_per_area(c("price"), c("area")))).alias("disputed"),
    ).where(F.size("cells") > 0)
    facts = written(facts.withColumn("likeness", F.unhex(F.sha2(F.to_json("cells"), 256))), "facts")
    counts = facts.groupBy("likeness").agg(F.first("cells").alias("cells"), F.count(F.lit(1)).alias("facts"), F.count_if("disputed").alias("disputed"))
    # Short numbers instead of digests, for what is shuffled later; they are written, so they stay as they are.
    counts = written(counts.withColumnRenamed("likeness", "digest").withColumn("likeness", F.monotonically_increasing_id()), "kinds")
    numbered = counts.select(c("digest").alias("of"), c("likeness").alias("number"))
    with_number = lambda df: df.join(numbered, c("likeness") == c("of")).withColumn("likeness", c("number")).drop("of", "number")
    each = counts.select("likeness", "facts", "disputed", "cells", F.posexplode("cells").alias("at", "cell"))
    each = each.select("likeness", "facts", "disputed", F.slice("cells", F.lit(1), c("at")).alias("earlier"), "cell.*", F.lit(True).alias("is_current"), F.lit(None).cast("timestamp").alias("deleted_at"))
    cells = written(each, "cells")
    groups = written(with_number(facts.groupBy("likeness", "price", "area").agg(F.count(F.lit(1)).alias("facts"))), "groups")
    return cells, groups, with_number(facts.select("transaction_id", "likeness")), counts.select("likeness", "cells")


def answer_questions(questions: DataFrame, records: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, cited) of questions (question_id and the columns of conditions).

    answers: question_id, outcome (clarification, abstain or numeric), ask,
    options, the numbers, awaiting, uncertain and conflicts. cited: (question_id,
    version_id) of every version that a numeric answer rests on. records are the
    caller's occurrences with their version's and document's state and their
    fact's agreed fact_price, fact_area and fact_area_type; pairs (a, b) are open
    pairs of facts.
    """
    c = F.col
    given = questions.select("question_id", *(c(n) for n in CONDITIONS)).withColumn("condition_id", F.sha2(F.to_json(F.struct(*(F.coalesce(c(n).cast("string"), F.lit("\0")) for n in CONDITIONS))), 256)).withColumn("lacks", _missing())
    distinct = given.where("lacks is null").select("condition_id", *CONDITIONS).distinct()
    cells, groups, members, kinds_of = alike(records)
    # Conditions have short numbers too, which are checkpointed.
    distinct = checkpointed(distinct.withColumnRenamed("condition_id", "digest").withColumn("condition_id", F.monotonically_increasing_id()))
    given = given.withColumnRenamed("condition_id", "digest").join(distinct.select("digest", "condition_id"), "digest", "left").drop("digest")
    sure = c("verification_status").isin(*VERIFIED)

    # Mixed attributes: the first of them with several values is what is asked. A likeness counts once for each value.
    def stated(n: str) -> Column:
        new = ~F.exists("earlier", lambda e: e[EQUAL[n]].eqNullSafe(c(EQUAL[n])) & _meets(e))
        return F.when(c(f"q_{n}").isNull() & c(EQUAL[n]).isNotNull() & new, c(EQUAL[n]))

    kinds = F.array(*(F.struct(F.lit(k).alias("nth"), F.lit(n).alias("attribute"), stated(n).alias("value")) for k, n in enumerate(MIXED)))
    values = matched(distinct, cells.where(sure), F.filter(kinds, lambda k: k["value"].isNotNull()).alias("kinds")).select("condition_id", "facts", F.explode("kinds").alias("k"))
    values = values.groupBy("condition_id", "k.nth", "k.attribute", "k.value").agg(F.sum("facts").alias("count"))
    option = F.struct((-c("count")).alias("order"), c("value").alias("value"), c("count").alias("n"))
    mixed = values.groupBy("condition_id", "nth", "attribute").agg(F.array_sort(F.collect_list(option)).alias("options")).where(F.size("options") > 1)
    options = F.transform("options", lambda o: F.struct(o["value"].alias("value"), o["n"].alias("n")))
    mixed = checkpointed(mixed.select("condition_id", "nth", "attribute", options.alias("options")).groupBy("condition_id").agg(F.min_by(F.struct("attribute", "options"), "nth").alias("mixed")))

    # What is mixed is asked back, so only the others are counted.
    unmixed = checkpointed(distinct.join(mixed.select("condition_id"), "condition_id", "left_anti"))
    plain = matched(unmixed, cells, (~F.exists("earlier", _meets)).alias("first")).where("first")
    plain = written(plain.select("condition_id", "likeness", sure.alias("sure"), "facts", "disputed"), "met")
    ends = plain.where("sure").select("condition_id", "likeness", "disputed")
    # Rows are dealt before they are summed up: the states of a median are larger than they are.
    numbers = stats.statistics(ends.join(groups, "likeness").repartition("condition_id"), "condition_id", weight="facts").withColumn("median", F.when(c("n") >= MEDIAN_FROM, c("median")))
    counts = plain.groupBy("condition_id").agg(F.coalesce(F.sum(F.when(~c("sure"), c("facts"))), F.lit(0)).alias("awaiting"))
    side = lambda x: members.select(c("transaction_id").alias(x), c("likeness").alias(f"of_{x}"))
    beside = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").groupBy("of_a", "of_b").agg(F.count(F.lit(1)).alias("pairs"))
    # A pair counts if both facts meet: a cell of the first one is joined, those of the other one stand beside it.
    known = lambda x: kinds_of.select(c("likeness").alias(f"of_{x}"), F.filter("cells", lambda e: ~e["waits"]).alias(x))
    beside = beside.join(known("a"), "of_a").join(known("b"), "of_b").select("pairs", "a", "b", F.posexplode("a").alias("at", "cell"))
    beside = written(beside.select("pairs", F.slice("a", F.lit(1), c("at")).alias("earlier"), c("b").alias("other"), "cell.*", F.lit(True).alias("is_current"), F.lit(None).cast("timestamp").alias("deleted_at")), "beside")
    both = ~F.exists("earlier", _meets) & F.exists("other", _meets)
    uncertain = matched(unmixed, beside, both.alias("both")).where("both").groupBy("condition_id").agg(F.sum("pairs").alias("uncertain"))
    conflicts = ends.where("disputed > 0").groupBy("condition_id").agg(F.sum("disputed").alias("conflicts"))

    joined = given.select("question_id", "condition_id", "lacks")
    for part in (mixed, numbers, counts, uncertain, conflicts):
        joined = joined.join(part, "condition_id", "left")
    # No condition, mixed or missing, is answered by numbers.
    outcome = F.when(c("lacks").isNotNull() | c("mixed").isNotNull(), "clarification").when(F.coalesce("n", F.lit(0)) == 0, "abstain").otherwise("numeric")
    joined = checkpointed(joined.withColumn("outcome", outcome))
    numeric = lambda n: F.when(c("outcome") == "numeric", c(n)).alias(n)
    count = lambda n: F.when(c("outcome") == "numeric", F.coalesce(n, F.lit(0).cast("long"))).alias(n)
    waiting = F.when(c("outcome") != "clarification", F.coalesce("awaiting", F.lit(0).cast("long"))).alias("awaiting")
    answers = joined.select(
        "question_id", "outcome", F.coalesce("lacks", "mixed.attribute").alias("ask"), c("mixed.options").alias("options"),
        *(numeric(n) for n in ("n", "mean", "weighted", "median", "least", "most")), waiting, count("uncertain"), count("conflicts"),
    )
    told = joined.where("outcome = 'numeric'").select("question_id", "condition_id")
    live = records.where(c("is_current") & c("deleted_at").isNull())
    facts = ends.select("condition_id", "likeness").join(members, "likeness")
    versions = facts.join(live.select("transaction_id", "version_id").distinct(), "transaction_id").select("condition_id", "version_id").distinct()
    return answers, told.join(versions, "condition_id").select("question_id", "version_id")


class KeptAnswers:
    """Answers by key, with every version that each of them cites; put replaces keys, serve gives those that still hold."""

    def __init__(self, spark, root: str):
        # A key is what a version is to the store: all its rows change at once.
        self.store = VersionStore(spark, root, {"answers": "version_id string, data_version long, answer string", "cited": "version_id string, cited string"})

    def put(self, batch: str, answers: DataFrame, cited: DataFrame) -> None:
        """answers (key, data_version, answer), cited (key, version_id)."""
        key = F.col("key").cast("string").alias("version_id")
        rows = {"answers": answers.select(key, "data_version", "answer"), "cited": cited.select(key, F.col("version_id").cast("string").alias("cited")).distinct()}
        self.store.commit(batch, rows, answers.select(key))

    def serve(self, keys: DataFrame, visible_versions: DataFrame, data_version: int) -> DataFrame:
        """(key, answer) of asked keys whose answer is of this data version and cites no version that isn't visible: one anti-join for all."""
        asked = keys.select(F.col("key").cast("string").alias("version_id")).distinct()
        current = self.store.read("answers").where(F.col("data_version") == data_version).join(asked, "version_id", "left_semi")
        cited = self.store.read("cited").join(asked, "version_id", "left_semi")
        seen = visible_versions.select(F.col("version_id").cast("string").alias("cited")).distinct()
        lost = cited.join(seen, "cited", "left_anti").select("version_id").distinct()
        return current.join(lost, "version_id", "left_anti").select(F.col("version_id").alias("key"), "answer")
