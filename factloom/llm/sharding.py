"""Minimax contiguous partition of ordered atomic groups into shards, with DataFrame operators only.

Rows with equal texts form one atomic group. Groups stand in the order of a
64-bit hash of their text. The smallest capacity with which a greedy walk needs
no more than the wanted number of shards is found by binary search. The walk
reads a summary of the groups by ranges of the hash: a fixed number of ranges
first, finer ones only where a cut can fall, down to single groups. A capacity
is judged by the least and the most that the walk could reach given what the
summary tells, and ranges are refined until both agree, so the result is exact
while the driver holds a bounded summary, never all groups.

The cuts then even out the shards within that capacity: each takes what is left
divided by the shards that are left, between the places that keep the rest feasible.

Defined results: a null text has no bytes, a checksum of 0, and stands with the
empty ones; repeated rows are rows of one group; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ship_by_value
from .workspace import Workspace

ship_by_value(__name__)

FIRST_BITS = 12  # 4,096 ranges at first
STEP_BITS = 8  # a range splits into 256
WHOLE = 512  # a range with so few groups is read group by group


class Summary:
    """Known places where a cut may fall, as sums of sizes, and which gaps between them may hide more."""

    def __init__(self, segments: list[tuple]):
        self.segments = segments  # (low key, bits left, size, rows, groups), by key
        self.edges, total = [0], 0
        for s in segments:
            total += s[2]
            self.edges.append(total)
        self.total = total

    def span(self, y: int) -> tuple[int, int, int]:
        """Least and most of the last cut at or before sum y, and the segment that it falls in."""
        i = bisect_right(self.edges, y) - 1
        if i >= len(self.segments):
            return self.total, self.total, -1
        return self.edges[i], (self.edges[i] if self.segments[i][4] == 1 else y), i

    def next_span(self, y: int) -> tuple[int, int, int]:
        """Least and most of the first cut at or after sum y."""
        i = bisect_left(self.edges, y)
        if self.edges[i] == y or self.segments[i - 1][4] == 1:
            return self.edges[i], self.edges[i], i - 1
        return y, self.edges[i], i - 1


def _walk(known: Summary, capacity: int, shards: int) -> tuple[list[int], list[int], set[int]]:
    """Least and most reach after each shard, and the segments between them that hide cuts."""
    low, high, doubt, lows, highs = 0, 0, set(), [], []
    for _ in range(shards):
        a, _, i = known.span(low + capacity)
        _, b, j = known.span(high + capacity)
        hidden = range(i, (j if j >= 0 else len(known.segments) - 1) + 1) if i >= 0 else ()
        doubt.update(k for k in hidden if known.segments[k][4] > 1)
        low, high = a, b
        lows.append(a)
        highs.append(b)
    return lows, highs, doubt


def find_capacity(known: Summary, shards: int, largest: int) -> tuple[int | None, set[int]]:
    """The least feasible capacity, or the segments to refine before it can be told."""
    low, high = max(largest, -(-known.total // shards)), known.total
    while low < high:
        middle = (low + high) // 2
        lows, highs, doubt = _walk(known, middle, shards)
        if lows[-1] >= known.total:
            high = middle
        elif highs[-1] < known.total:
            low = middle + 1
        else:
            return None, doubt
    return low, set()


def find_cuts(known: Summary, shards: int, capacity: int) -> tuple[list[int] | None, set[int]]:
    """Sums at which the shards end, evened out within the capacity; or the segments to refine first."""
    doubt: set[int] = set()
    back, at = [known.total] * (shards + 1), known.total  # back[k]: the least end of shard k that leaves the rest feasible
    for k in range(shards - 1, -1, -1):
        low, high, i = known.next_span(max(0, at - capacity))
        if low != high:
            doubt.add(i)
        at = back[k] = high
    cuts, at = [], 0
    for k in range(1, shards + 1):
        def last(y):
            low, high, i = known.span(min(y, known.total))
            if low != high:
                doubt.add(i)
            return low
        most = last(at + capacity)
        want = at + -(-(known.total - at) // (shards - k + 1))
        below = last(want)
        above, above_high, i = known.next_span(min(want, known.total))
        if above != above_high:
            doubt.add(i)
        near = below if want - below <= above_high - want else above_high
        at = min(max(near, back[k], at), most)
        cuts.append(at)
    return (None, doubt) if doubt else (cuts, doubt)


def _summarise(groups: DataFrame, bits: int) -> list[tuple]:
    """Segments of `bits` leading bits of the key: at most 2^bits rows come to the driver."""
    rows = groups.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("k")).agg(F.sum("size"), F.sum("rows"), F.count(F.lit(1))).collect()
    return sorted((r[0] << (64 - bits), 64 - bits, r[1], r[2], r[3]) for r in rows)


def _refine(groups: DataFrame, segments: list[tuple], wanted: set[int]) -> list[tuple]:
    """Replace the wanted segments by finer ones, read in one pass."""
    spark = groups.sparkSession
    ask = [(i, segments[i][0], segments[i][1], 0 if segments[i][4] <= WHOLE else max(0, segments[i][1] - STEP_BITS)) for i in sorted(wanted)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    found: dict[int, list[tuple]] = {}
    by_bits: dict[tuple[int, int], list[tuple]] = {}
    for i, low, left, to in ask:
        by_bits.setdefault((left, to), []).append((signed(low), i))
    for (left, to), part in by_bits.items():
        # The asked ranges number at most a few times the shards, so their broadcast is bounded.
        asked = spark.createDataFrame(part, "prefix long, segment int")
        masked = groups.withColumn("prefix", F.shiftleft(F.shiftrightunsigned("key", left), left) if left < 64 else F.lit(0).cast("long"))
        inside = masked.join(F.broadcast(asked), "prefix")
        finer = F.col("key") if to == 0 else F.shiftleft(F.shiftrightunsigned("key", to), to)
        for r in inside.groupBy("segment", finer.alias("k")).agg(F.sum("size"), F.sum("rows"), F.count(F.lit(1))).collect():
            found.setdefault(r[0], []).append((r[1] % (1 << 64), to, r[2], r[3], r[4]))
    out = []
    for i, s in enumerate(segments):
        out += sorted(found[i]) if i in found else [s]
    return out


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: sizes as equal as whole groups in hash order allow."""
    spark = docs.sparkSession
    space = Workspace(spark, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = F.xxhash64(text)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        hashed.alias("key"),
        hashed.bitwiseXOR(F.lit(-(1 << 63)).cast("long")).alias("place"),  # unsigned order
    )
    # The range by (place, doc_id) splits a group that holds a large part of all rows.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "place", "doc_id").sortWithinPartitions("place", "doc_id")
    numbered = ordered.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    base = space.write(numbered, "rows")

    groups = space.write(base.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), "groups")
    segments = _summarise(groups, FIRST_BITS)
    if not segments:
        keys: list[int] = []
    else:
        largest = groups.agg(F.max("size")).first()[0]
        while True:
            known = Summary(segments)
            capacity, doubt = find_capacity(known, shards, largest)
            if capacity is not None:
                cuts, doubt = find_cuts(known, shards, capacity)
                if cuts is not None:
                    break
            segments = _refine(groups, segments, doubt)
        at = dict(zip(known.edges, [*(s[0] for s in segments), 1 << 64], strict=True))
        keys = [at[c] for c in cuts[:-1]]

    # A row's shard is the number of cuts at or below its place.
    number = F.lit(0)
    for key in keys:
        if key < 1 << 64:
            number = number + (F.col("place") >= F.lit(key - (1 << 63)).cast("long")).cast("int")
    placed = base.withColumn("shard", number)
    by_part = placed.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    window = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A partition's rows of a shard stand together, so a row's slot is its place among them after those of earlier partitions.
    bases = by_part.withColumn("before", F.coalesce(F.sum("n").over(window), F.lit(0)) - F.col("first")).select("part", "shard", "before")
    return placed.join(bases, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("nth") + F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
