"""A reviewer's corrections: typed by their field, with everything that follows from them computed anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_correction
from .documents import validate
from .identity import attach, location_key, match_key

#: Fields that a reviewer may correct and that a record keeps.
CORRECTABLE = ("address", "block", "parcel", "sub_parcel", "property_type", "price", "area", "rooms", "price_per_sqm_stated", "transaction_date", "valuation_date", "report_date")


def correct(records: DataFrame, corrections: DataFrame) -> DataFrame:
    """Records with the last correction (occurrence_id, field, value, at) of each field, checked anew.

    A correction that its field can't read (no number, a negative one, no date)
    changes nothing. A changed record's status is corrected; the others keep theirs.
    """
    fields = [f for f in CORRECTABLE if f in records.columns]
    last = corrections.where(F.col("field").isin(*fields)).groupBy("occurrence_id", "field").agg(F.max_by("value", "at").alias("value"))
    wide = last.groupBy("occurrence_id").pivot("field", fields).agg(F.first("value"))
    read = wide.select("occurrence_id", *(parse_correction(f, F.col(f)).alias(f"_{f}") for f in fields))
    joined = records.join(read, "occurrence_id", "left")
    changed = F.lit(False)
    for f in fields:
        changed = changed | F.col(f"_{f}").isNotNull()
    joined = joined.withColumn("_status", F.when(changed, F.lit("corrected")).otherwise(F.col("status")))
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(F.col(f"_{f}").cast(records.schema[f].dataType), f)).drop(f"_{f}")
    return validate(joined.drop("status")).withColumn("status", F.col("_status")).drop("_status")


def reidentify(records: DataFrame, order: list[str]) -> DataFrame:
    """Records with the key, the fact and the differing fact that their present values lead to."""
    return attach(records.drop("match_key", "transaction_id", "differs_from").withColumn("match_key", match_key(location_key())), order)
