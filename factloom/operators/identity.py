"""Identity of facts: certain matches share a key, look-alikes become pairs for a reviewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rounds import checkpointed

# Kinds that are matched, and the wording of differences.
MATCHED_KINDS = ("transaction_price", "asking_price", "adjusted_comparable")
DIFFERENCES = (("transaction_date", "תאריך"), ("price", "מחיר"), ("area", "שטח"), ("area_type", "סוג שטח"))
DECISIONS = {"merge": "merged", "keep_separate": "kept_separate"}
SAME_PLACE, INCOMPLETE = "אותו מיקום; שונה: ", "פרטים חסרים"


def location_key() -> Column:
    """Block and parcel, else the address, else null."""
    c = F.col
    by_block = F.when((c("block") != "") & (c("parcel") != ""), F.concat(F.lit("bp:"), c("block"), F.lit("/"), c("parcel"), F.lit("/"), F.coalesce(F.nullif(c("sub_parcel"), F.lit("")), F.lit("-"))))
    by_address = F.when(c("address") != "", F.concat(F.lit("addr:"), c("address")))
    return F.coalesce(by_block, by_address)


def match_key(location: Column) -> Column:
    """concat (not concat_ws) so that one missing part leaves no key."""
    parts = [location, F.col("data_kind"), F.col("transaction_date").cast("string"), F.col("price").cast("string"), F.col("area").cast("string"), F.col("area_type")]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("|"), p)
    return F.when(F.col("data_kind").isin(*MATCHED_KINDS), joined)


def attach(occurrences: DataFrame, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """transaction_id of each occurrence (with columns match_key, property_type and occurrence_id), and which fact it differs_from.

    The first occurrence of a key in the given order opens its fact, unless
    existing (match_key, transaction_id, types) has one; types are all those that
    the fact's occurrences state, several after merges or corrections. An
    occurrence joins if it states no type or one of the fact's. A fact without any
    type takes the first one that is stated. All others stand alone and point to
    the fact. So the types of a fact don't change by what joins it once there is
    one, and a key needs its first rows only, not a walk through all of them.

    Occurrences without a key stand alone and take part in nothing here.
    """
    at = F.struct(*order)
    keyed, alone = occurrences.where("match_key IS NOT NULL"), occurrences.where("match_key IS NULL")
    stated = F.min_by("property_type", F.when(F.col("property_type").isNotNull(), at))
    rule = keyed.groupBy("match_key").agg(F.min_by("occurrence_id", at).alias("_fact"), F.array_compact(F.array(stated)).alias("_types"))
    if existing is not None:
        held = existing.select("match_key", F.col("transaction_id").alias("_held"), F.array_compact("types").alias("_seen"))
        rule = rule.join(held, "match_key", "left").select("match_key", F.coalesce("_held", "_fact").alias("_fact"), F.when(F.size("_seen") > 0, F.col("_seen")).otherwise(F.col("_types")).alias("_types"))
    joined = keyed.join(rule, "match_key")
    joins = F.col("property_type").isNull() | F.array_contains("_types", F.col("property_type"))
    found = joined.select(*occurrences.columns, F.when(joins, F.col("_fact")).otherwise(F.col("occurrence_id")).alias("transaction_id"), F.when(~joins, F.col("_fact")).alias("differs_from"))
    none = F.lit(None).cast(found.schema["differs_from"].dataType)
    return found.unionByName(alone.select(*occurrences.columns, F.col("occurrence_id").alias("transaction_id"), none.alias("differs_from")))


def fact_types(occurrences: DataFrame) -> DataFrame:
    """(match_key, transaction_id, types) of facts that a key opened, for attach; occurrences as attach and apply_merges leave them."""
    types = occurrences.groupBy("transaction_id").agg(F.collect_set("property_type").alias("types"))
    opened = occurrences.where("match_key IS NOT NULL AND differs_from IS NULL").select("match_key", "transaction_id").distinct()
    return opened.join(types, "transaction_id").groupBy("match_key").agg(F.min(F.struct("transaction_id", "types")).alias("f")).select("match_key", "f.*")


def look_alikes(facts: DataFrame, place: list[str], id_col: str) -> DataFrame:
    """Pairs (a < b) at one place and of one kind that share the date or the price: two equi-joins, so a
    crowded place is only compared within one date or one price, and pairs that share both come once."""
    left, right = facts.alias("x"), facts.alias("y")
    keys = [*place, "data_kind"]

    def side(shared: str, other: str | None) -> DataFrame:
        on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys] + [F.col(f"x.{shared}") == F.col(f"y.{shared}"), F.col(f"x.{id_col}") < F.col(f"y.{id_col}")]
        if other:
            on.append(~F.coalesce(F.col(f"x.{other}") == F.col(f"y.{other}"), F.lit(False)))
        return left.join(right, on).select(F.col(f"x.{id_col}").alias("a"), F.col(f"y.{id_col}").alias("b"), reason("x", "y").alias("reason"))

    return side("transaction_date", None).unionByName(side("price", "transaction_date"))


def reason(x: str, y: str) -> Column:
    """What differs between the two sides, in a fixed order."""
    parts = F.filter(F.array(*(F.when(~F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")), F.lit(label)) for k, label in DIFFERENCES)), lambda p: p.isNotNull())
    return F.concat(F.lit(SAME_PLACE), F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(F.lit(INCOMPLETE)))


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once, the ids in string order."""
    swap = F.col("a").cast("string") > F.col("b").cast("string")
    return pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b")).where("a != b").distinct()


def without_orphans(facts: DataFrame, occurrences: DataFrame, key: str) -> DataFrame:
    return facts.join(occurrences.select(key).distinct(), key, "left_semi")


def both_ends(pairs: DataFrame, visible: DataFrame, key: str) -> DataFrame:
    """Open pairs both of whose facts are visible."""
    ids = visible.select(F.col(key)).distinct()
    return pairs.join(ids.withColumnRenamed(key, "a"), "a", "left_semi").join(ids.withColumnRenamed(key, "b"), "b", "left_semi")


def summaries(occurrences: DataFrame) -> DataFrame:
    """Each fact with its agreed values and its sources, in the order of their place."""
    source = F.struct("document_id", "version_id", "page_no", "row_index", "occurrence_id")
    return occurrences.groupBy("transaction_id").agg(F.min("price").alias("price"), F.min("area").alias("area"), F.array_sort(F.collect_set("property_type")).alias("property_types"), F.array_sort(F.collect_list(source)).alias("sources"))


def versions_of(occurrences: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct versions that some facts touch, whose status follows from a decision on them."""
    return occurrences.join(facts.select("transaction_id"), "transaction_id", "left_semi").select("version_id").distinct()


def apply_merges(occurrences: DataFrame, merges: DataFrame) -> DataFrame:
    """Occurrences re-pointed to the survivor of merged facts; merges is (loser, survivor), already resolved to final survivors."""
    mapped = merges.select(F.col("loser").alias("transaction_id"), "survivor")
    return occurrences.join(mapped, "transaction_id", "left").withColumn("transaction_id", F.coalesce("survivor", "transaction_id")).drop("survivor")


def resolve_merges(merges: DataFrame) -> DataFrame:
    """(loser, survivor) with chains of merges followed to their ends by pointer jumping.

    A loser that is merged twice goes to the lesser survivor; merges that go round
    in a circle are an error.
    """
    now = checkpointed(merges.where("loser != survivor").groupBy("loser").agg(F.min("survivor").alias("survivor")))
    for _ in range(now.count().bit_length() + 1):  # each round doubles what is followed
        onward = now.select(F.col("loser").alias("survivor"), F.col("survivor").alias("further"))
        moved = now.join(onward, "survivor", "left").select("loser", F.coalesce("further", "survivor").alias("survivor"), F.col("further").isNotNull().alias("moved"))
        moved = checkpointed(moved)
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now
    raise ValueError("merges go round in a circle")


def repoint(candidates: DataFrame, merges: DataFrame) -> DataFrame:
    """Open pairs (a, b, reason) under the survivors of merges (loser, survivor): each pair once, none of a fact with itself."""
    ends = candidates.select("a", "b", "reason")
    for end in ("a", "b"):
        own = merges.select(F.col("loser").alias(end), F.col("survivor").alias("_to"))
        ends = ends.join(own, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    swap = F.col("a").cast("string") > F.col("b").cast("string")
    ordered = ends.where("a != b").select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), "reason")
    return ordered.groupBy("a", "b").agg(F.min("reason").alias("reason"))


def decided(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates (a, b, reason) with their status after the last decision (a, b, action, at): merged, kept_separate or open."""
    states = F.create_map(*(F.lit(x) for pair in DECISIONS.items() for x in pair))
    last = decisions.groupBy("a", "b").agg(F.max_by(F.try_element_at(states, F.col("action")), "at").alias("status"))
    return candidates.join(last, ["a", "b"], "left").withColumn("status", F.coalesce("status", F.lit("open")))
