"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its token share raised to an exponent a between 0 and 1 and
normalised: 1 keeps the shares, 0 makes all sources equal. The budget is the
least at which every source is used whole at least once, so the mixture repeats
small sources and drops no document; a source is then repeated
weight x budget / tokens times. The exponent is the least one, found by
bisection, whose largest repetition stays within a limit (or whose weights'
entropy comes down to a target). Six levels of the bisection are evaluated in
one pass over the table of sources, which stays distributed.

Documents are dealt into BLOCKS blocks of their source by a hash, so a block is a
share of its source, whatever the source's size. In each epoch a source's blocks
are permuted by another hash, and documents lie in a block in the order of a
third. The last, partial epoch takes documents in that order as long as they fit
the source's remaining budget, so every source comes to its target within one
document. Where it ends is found in three steps, each over a 256th of the rows of
the one before: among the blocks, in the block where the budget ends among 256
ranges of the third hash, and in that range among documents. The end is a pair of
numbers per source, so rows meet only the small table of sources.

A document's tokens are its UTF-8 bytes divided by BYTES and rounded up, plus one
that ends it: a measure that grows with the text in any script and needs no
tokenizer.

Defined results: an empty or null text counts as its end token; a null source is
a source of its own; repeated rows are documents of their own, but rows that
share an id stand at one place of the order, so the last epoch takes all of them
or none; rows without an id share one; a single source is used once; an empty
table gives an empty result; the added columns (epoch, block, place and tokens,
unless named otherwise) replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ship_by_value
from .workspace import Workspace

ship_by_value(__name__)

LEVELS = 6  # bisection steps evaluated in one pass
PASSES = 5
BLOCKS = 256
BYTES = 4  # that count as a token
HASH_BITS = 60


def _tokens(text_col: str) -> Column:
    return F.expr(f"CAST((octet_length(coalesce(CAST(`{text_col}` AS STRING), '')) + {BYTES - 1}) DIV {BYTES} + 1 AS BIGINT)")


def _hash(name: str, *keys: Column) -> Column:
    """HASH_BITS bits of a hash of the keys, one function for each name."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(name), *(k.cast("string") for k in keys))), 1, HASH_BITS // 4), 16, 10).cast("long")


def find_exponent(sources: DataFrame, most_repeats: float | None, entropy: float | None) -> float:
    """The least exponent in [0, 1] within the limits; sources has a row (source, tokens) per source."""
    edges = sources.agg(F.min("tokens"), F.max("tokens")).first()
    if edges[0] is None:
        return 1.0
    least, most = float(edges[0]), float(edges[1])
    low, high = 0.0, 1.0

    def fits(a: float, z: float, s: float) -> bool:
        # Shares are relative to the largest source: z is the sum of their powers, s of powers times logarithms.
        import math

        repeats = (most / least) ** (1 - a)
        h = math.log(z) - a * s / z
        return (most_repeats is None or repeats <= most_repeats) and (entropy is None or h <= entropy)

    for _ in range(PASSES):
        n = 1 << LEVELS
        tries = [low + (high - low) * i / n for i in range(n)]
        share = F.log(F.col("tokens") / most)
        found = sources.agg(*(F.sum(F.exp(share * a)) for a in tries), *(F.sum(F.exp(share * a) * share) for a in tries)).first()
        good = [a for i, a in enumerate(tries) if fits(a, found[i], found[n + i])]
        first = min(good, default=high)
        if first == low:
            return low
        low, high = max([a for a in tries if a < first], default=low), first
    return high


def plan_sources(sources: DataFrame, exponent: float) -> DataFrame:
    """Each source's weight, repeats, whole epochs and tokens left for the last epoch."""
    total = sources.agg(F.max("tokens").alias("most"))
    most = float(total.first()[0] or 1)
    z = float(sources.agg(F.sum(F.exp(F.log(F.col("tokens") / most) * exponent))).first()[0] or 1.0)
    relative = F.exp(F.log(F.col("tokens") / most) * exponent)
    repeats = F.round(relative * most / F.col("tokens"), 9)  # the largest source is used once
    whole = F.floor(repeats).cast("int")
    rest = F.floor((repeats - whole) * F.col("tokens")).cast("long")
    return sources.select("source", "tokens", (relative / z).alias("weight"), repeats.alias("repeats"), whole.alias("whole"), rest.alias("rest"))


def _crossing(sums: DataFrame, order: list[str]) -> DataFrame:
    """Of rows (source, n, rest, order) the one per source in which the running sum of n passes rest, with left, what fits into it."""
    upto = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    reach = sums.withColumn("reach", F.sum("n").over(upto))
    return reach.where((F.col("reach") > F.col("rest")) & (F.col("reach") - F.col("n") <= F.col("rest"))).withColumn("left", F.col("rest") - F.col("reach") + F.col("n"))


def _last_epoch(space: Workspace, measured: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, cut_turn, cut_key): the last epoch takes documents of an earlier turn, and of this turn up to this key."""
    own = measured.join(plan.where("rest > 0").select("source", "whole", "rest"), "source")
    own = own.withColumn("block", F.pmod(_hash("block", F.col("id")), F.lit(BLOCKS)))
    sums = own.groupBy("source", "block", "whole", "rest").agg(F.sum("tokens").alias("n")).withColumn("turn", _hash("turn", F.col("source"), F.col("block"), F.col("whole")))
    cuts = space.write(_crossing(sums, ["turn", "block"]).select("source", "block", "turn", F.col("left").alias("rest")), "cuts")
    inside = own.drop("rest").join(cuts, ["source", "block"]).withColumn("key", _hash("document", F.col("id"))).withColumn("range", F.shiftright("key", HASH_BITS - 8))
    inside = space.write(inside.select("source", "turn", "key", "range", "tokens", "rest"), "inside")
    ranges = _crossing(inside.groupBy("source", "range", "rest").agg(F.sum("tokens").alias("n")), ["range"]).select("source", "range", "left")
    keys = inside.join(ranges, ["source", "range"]).groupBy("source", "range", "left", "key").agg(F.sum("tokens").alias("n"))
    upto = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    fits = keys.withColumn("fits", F.sum("n").over(upto) <= F.col("left")).groupBy("source", "range").agg(F.max(F.when(F.col("fits"), F.col("key"))).alias("key"))
    before = F.shiftleft(F.col("range"), HASH_BITS - 8) - 1
    return cuts.join(fits, "source").select("source", F.col("turn").alias("cut_turn"), F.coalesce("key", before).alias("cut_key"))


def mix_sources(docs: DataFrame, most_repeats: float | None = 2.0, entropy: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", names: tuple[str, str, str, str] = ("epoch", "block", "place", "tokens")) -> DataFrame:
    """The rows of docs, as often as the mixture takes them, with epoch, block, place (order of the mixture, 0 to 1) and tokens under the given names."""
    space = Workspace(docs.sparkSession, "mixing")
    kept = [c for c in docs.columns if c.lower() not in names]
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    id_key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # The row travels whole, so no name of its columns meets one of these.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_mix_row"), _tokens(text_col).alias("_mix_tokens"), key.alias("_mix_source"), id_key.alias("_mix_id"))
    measured = space.write(rows.select(F.col("_mix_id").alias("id"), F.col("_mix_source").alias("source"), F.col("_mix_tokens").alias("tokens")), "tokens")
    sources = space.write(measured.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    plan = space.write(plan_sources(sources, find_exponent(sources, most_repeats, entropy)), "plan")
    plan = space.write(plan.join(_last_epoch(space, measured, plan), "source", "left"), "planned")

    few = plan.select(F.col("source").alias("_mix_source"), *(F.col(n).alias(f"_mix_{n}") for n in ("repeats", "whole", "cut_turn", "cut_key")))
    taken = rows.join(few, "_mix_source").withColumn("_mix_block", F.pmod(_hash("block", F.col("_mix_id")), F.lit(BLOCKS)))
    taken = taken.withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_mix_whole")))).withColumn("_mix_turn", _hash("turn", F.col("_mix_source"), F.col("_mix_block"), F.col("_mix_epoch")))
    early = F.col("_mix_turn") < F.col("_mix_cut_turn")
    last = (F.col("_mix_turn") == F.col("_mix_cut_turn")) & (_hash("document", F.col("_mix_id")) <= F.col("_mix_cut_key"))
    taken = taken.where((F.col("_mix_epoch") < F.col("_mix_whole")) | early | last)
    place = F.least(F.lit(1.0), (F.col("_mix_epoch") + F.col("_mix_turn") / float(1 << HASH_BITS)) / F.col("_mix_repeats"))
    return taken.select(*(F.col("_mix_row").getField(c).alias(c) for c in kept), *(c.alias(n) for c, n in zip((F.col("_mix_epoch"), F.col("_mix_block"), place, F.col("_mix_tokens")), names, strict=True)))
