"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A sketch has ``SIZE`` coordinates and is filled in rounds: in round i every
shingle is thrown into one bin by a hash of its own for that round, and a bin
that was empty keeps the least value thrown at it; after SIZE rounds, round
SIZE + j throws everything into bin j, so every coordinate fills. Two sets agree
in a coordinate with the probability of their similarity, and the number of
agreements is concentrated as for independent coordinates. Bands of ``ROWS``
coordinates make the candidates: at similarity 0.8 a pair shares none of the 40
bands with a probability of 5e-6, and less above.

Documents with equal shingle sets are one class and only its least document goes
on. Within a band, a walk finds which members hang together by pairs whose
sketches agree often enough, and gives one edge per member, not all pairs. The
components of these edges hold every link, so the full sets of their members
meet there, in blocks of bounded size where a component is large, and walks over
exact comparisons give the confirmed links, again a forest and not all pairs.
No partner is capped: every pair of a component is either compared exactly or
already connected.

Defined results: a null or wordless text has an empty set and is linked with
nothing; a single word is one shingle; repeated rows are one class; a null
doc_id is linked with nothing and kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship_by_value
from .bytes_np import chunks, mix, prefix_hash, range_hash, text_bytes
from .components import components
from .workspace import Workspace, small_batches

ship_by_value(__name__)

SIZE, ROWS = 240, 6
BANDS = SIZE // ROWS
#: Agreeing coordinates below which no pair of the wanted similarity falls: at 0.8, fewer than 62 % have a probability below 1e-10.
LIKELY = 0.62
CHUNK = 1 << 20  # bytes of text worked on at a time
CROWD = 8192  # members of a band walked at a time
BLOCK, BLOCK_SHINGLES = 4096, 2_000_000  # members and shingles of a component compared at a time
FEW = 1_000_000  # ids that may be broadcast

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and where each text's hashes begin and end."""
    gap = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~gap
    before = np.empty(len(data), bool)
    before[:1], before[1:] = True, gap[:-1]
    start = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = True, gap[1:]
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    hashed = range_hash(prefix_hash(_FOLD[data]), start, end)
    at = np.searchsorted(start, offsets)  # a text's words
    n = np.diff(at)
    rolled = hashed.copy()
    size = max(0, len(hashed) - words + 1)
    for k in range(1, words):
        rolled[:size] = mix(rolled[:size] * np.uint64(0x9FB21C651E98DF25) + hashed[k : k + size])
    out, ends = [], [0]
    for i in range(len(n)):
        a, b = at[i], at[i + 1]
        if n[i] >= words:
            own = np.sort(rolled[a : b - words + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif n[i]:
            own = hashed[a : a + 1]
            for k in range(a + 1, b):
                own = mix(own * np.uint64(0x9FB21C651E98DF25) + hashed[k : k + 1])
            own = ~own
        else:
            own = hashed[:0]
        out.append(own)
        ends.append(ends[-1] + len(own))
    return np.concatenate(out) if out else hashed[:0], np.array(ends)


def sketch(elements: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of SIZE 32-bit coordinates for each set of elements; empty sets stay unfilled."""
    n, empty = len(ends) - 1, np.uint32(0xFFFFFFFF)
    table = np.full(n * SIZE, empty, np.uint32)
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(n), sizes)
    active = elements
    for i in range(2 * SIZE):
        if not len(active):
            break
        thrown = mix(active ^ np.uint64((i + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        value = np.minimum(thrown.astype(np.uint32), empty - np.uint32(1))
        if i < SIZE:
            place = owner * SIZE + ((thrown >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64)
        else:
            place = owner * SIZE + (i - SIZE)
        hollow = table[place] == empty
        place, value = place[hollow], value[hollow]
        np.minimum.at(table, place, value)
        if i < 4 or i % 4 == 0:
            more = (table.reshape(n, SIZE) == empty).any(axis=1)[owner]
            if not more.all():
                active, owner = active[more], owner[more]
    return table.reshape(n, SIZE)


def band_keys(table: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(table), BANDS)).copy()
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + table[:, k::ROWS].astype(np.uint64))
    return keys


def _sketcher(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets, CHUNK):
                own = offsets[a : b + 1]
                elements, ends = shingles(data[own[0] : own[-1]], own - own[0], words)
                sums = np.zeros(len(elements) + 1, np.uint64)
                np.cumsum(elements, out=sums[1:])
                twice = np.zeros(len(elements) + 1, np.uint64)
                np.cumsum(mix(elements + np.uint64(1)), out=twice[1:])
                table = sketch(elements, ends)
                keys = band_keys(table).view(np.int64)
                width = np.arange(0, BANDS * (b - a) + 1, BANDS, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array(np.diff(ends)),
                        pa.array((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)),
                        pa.array((twice[ends[1:]] - twice[ends[:-1]]).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(width), pa.array(keys.ravel())),
                        pa.array([x.tobytes() for x in table.astype(np.uint8)], pa.binary()),
                    ],
                    ["doc_id", "n", "s1", "s2", "keys", "sketch"],
                )

    return run


def _setter(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets, CHUNK):
                own = offsets[a : b + 1]
                elements, ends = shingles(data[own[0] : own[-1]], own - own[0], words)
                raw = [elements[ends[i] : ends[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(raw, pa.binary())], ["id", "set"])

    return run


def walk(n: int, near) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest over 0..n-1, where near(x, others) tells which others are adjacent to x."""
    rest = np.arange(n)
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = near(x, rest)
            if hit.any():
                for y in rest[hit]:
                    yield x, int(y)
                queue += rest[hit].tolist()
                rest = rest[~hit]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of each run of equal leading columns."""
    now, rows = None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[:keys] != now:
                if rows:
                    yield rows
                now, rows = r[:keys], []
            rows.append(r)
    if rows:
        yield rows


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = (np.array(x, np.int64) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])


def _band_walk(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, part, rep, n, sketch, centre), sorted by key and part, give edges between likely partners."""
        out = []
        for rows in _groups(batches, 2):
            ids, n = [r[2] for r in rows], np.array([r[3] for r in rows])
            table = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, SIZE)

            def near(x, others, n=n, table=table):
                sized = 100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x])
                return sized & (np.count_nonzero(table[others] == table[x], axis=1) >= LIKELY * SIZE)

            if len(rows) > 1:
                out += [(ids[x], ids[y]) for x, y in walk(len(rows), near)]
            if rows[0][5] is not None:  # a part of a crowded band: all parts hang together
                out += [(i, rows[0][5]) for i in ids if i != rows[0][5]]
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    return run


def exact_parts(ids: list[int], parts: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(part, least part that it hangs together with) of the parts that do so by pairs whose intersection reaches percent of their union.

    Members of one part are connected already and aren't compared.
    """
    sizes, part = np.array([len(x) for x in sets], np.int64), np.array(parts, np.int64)
    if len(ids) == 2:
        both = np.sort(np.concatenate(sets))
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        linked = parts[0] != parts[1] and 100 * common >= percent * (len(both) - common)
        return [(max(parts), min(parts))] if linked else []
    words, number = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(sizes)))
    flag = np.zeros(len(words), np.int32)

    def near(x, others):
        same = part[others] == part[x]
        hit = ~same & (100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x]))
        mine = number[start[x] : start[x + 1]]
        flag[mine] = 1
        some = others[hit]
        if len(some) * 4 > len(sizes):
            common = np.add.reduceat(flag[number], start[:-1])[some]
        else:
            common = np.array([flag[number[start[y] : start[y + 1]]].sum() for y in some], np.int64)
        flag[mine] = 0
        hit[hit] = 100 * common >= percent * (sizes[some] + sizes[x] - common)
        return hit | same

    root = list(range(len(ids)))  # of each member's tree; edges come parents first
    for x, y in walk(len(ids), near):
        root[y] = root[x]
    least: dict[int, int] = {}
    for x, r in enumerate(root):
        least[r] = min(least.get(r, parts[x]), parts[x])
    return sorted({(parts[x], least[r]) for x, r in enumerate(root) if parts[x] != least[r]})


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (component, i, j, id, part, set), sorted by the first three, give (part, least part of its group that it hangs together with)."""
        out = []
        for rows in _groups(batches, 3):
            if len(rows) > 1:
                out += exact_parts([r[3] for r in rows], [r[4] for r in rows], [np.frombuffer(r[5], np.uint64) for r in rows], percent)
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    return run


class NearDuplicates:
    """One run of the operator; ``rows`` has doc_id, n_shingles, component_id, kept; ``parts`` the least document of each linked class's component."""

    def __init__(self, docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.words, self.percent = docs.sparkSession, words, percent
        small_batches(self.spark)
        self.space = Workspace(self.spark, "minhash")
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        schema = "doc_id long, n long, s1 long, s2 long, keys array<long>, sketch binary"
        self.sketched = self.space.write(self.texts.mapInArrow(_sketcher(words), schema), "sketches")
        # Documents with one set are one class; its least document stands for it.
        named = self.sketched.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        classes = named.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "keys", "sketch")).alias("m"))
        self.classes = self.space.write(classes.select("n", "s1", "s2", F.col("m.doc_id").alias("rep"), "m.keys", "m.sketch"), "classes")
        self.parts = self._confirm(self._candidates())
        self.rows = self._rows(self.parts)

    def _candidates(self) -> DataFrame:
        """(node, component) of the documents that may have a link; both ends of any link share a component."""
        banded = self.classes.select("rep", F.explode("keys").alias("key"))
        crowded = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("centre")).where("size > 1")
        members = banded.join(crowded, "key")
        parts = F.ceil(F.col("size") / CROWD)
        members = members.select("key", F.when(parts > 1, F.pmod(F.xxhash64("rep"), parts)).otherwise(0).cast("int").alias("part"), "rep", F.when(parts > 1, F.col("centre")).alias("centre"))
        own = members.join(self.classes.select("rep", "n", "sketch"), "rep").select("key", "part", "rep", "n", "sketch", "centre")
        placed = own.repartition("key", "part").sortWithinPartitions("key", "part")
        return components(self.space, placed.mapInArrow(_band_walk(self.percent), "u long, v long"))

    def _compare(self, dealt: DataFrame) -> DataFrame:
        """(u, v): within the groups (component, i, j) of dealt rows (id, component, i, j, part), part u hangs together with the least part v."""
        wanted = dealt.select("id").distinct()
        if dealt.count() <= FEW:
            wanted = F.broadcast(wanted)
        texts = self.texts.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi").dropDuplicates(["id"])
        sets = texts.mapInArrow(_setter(self.words), "id long, set binary")
        placed = sets.join(dealt, "id").select("component", "i", "j", "id", "part", "set").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
        return self.space.write(placed.mapInArrow(_exact(self.percent), "u long, v long"), "joined")

    def _confirm(self, candidates: DataFrame) -> DataFrame:
        """(node, component): the exact parts of the candidates' components.

        A component of up to BLOCK members is one group, whose walk decides its
        parts. A larger one is dealt into blocks, each walked by itself; then one
        member for each block's part meets the others' ones, which joins the
        blocks of a group of near copies; and only components that are still in
        several parts have their blocks compared two by two, between members of
        different parts.
        """
        sized = candidates.join(self.classes.select(F.col("rep").alias("node"), "n"), "node").select(F.col("node").alias("id"), "component", "n")
        sized = self.space.write(sized, "candidates")
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
        split = sized.join(sized.groupBy("component").agg(blocks.alias("blocks")), "component")
        split = self.space.write(split.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "blocks")
        joined = self._compare(split.select("id", "component", F.col("mine").alias("i"), F.col("mine").alias("j"), F.col("id").alias("part")))
        # Each member is in one block, so a part has one row here at most.
        split = split.join(joined.select(F.col("u").alias("id"), "v"), "id", "left").withColumn("part", F.coalesce("v", "id")).drop("v")
        large = split.where("blocks > 1")
        settled = split.where("blocks = 1").select(F.col("id").alias("node"), F.col("part").alias("component"))
        if large.isEmpty():
            return settled
        heads = large.select("component", F.col("part").alias("id")).distinct()
        several = heads.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("groups"))
        place = F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")
        heads = self.space.write(heads.join(several, "component").select("id", "component", place.alias("i"), place.alias("j"), F.col("id").alias("part")), "heads")
        joined = self._compare(heads)
        large = large.join(joined.select(F.col("u").alias("part"), "v"), "part", "left").withColumn("part", F.coalesce("v", "part")).drop("v")
        large = self.space.write(large, "large")
        open_ones = large.groupBy("component").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("component")
        rest = large.join(open_ones, "component", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("mine != other")
        rest = self.space.write(rest.select("id", "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "part"), "rest")
        if not rest.isEmpty():
            last = components(self.space, self._compare(rest)).select(F.col("node").alias("part"), F.col("component").alias("v"))
            large = large.join(last, "part", "left").withColumn("part", F.coalesce("v", "part")).drop("v")
        return settled.unionByName(large.select(F.col("id").alias("node"), F.col("part").alias("component")))

    def _rows(self, parts: DataFrame) -> DataFrame:
        named = self.classes.select("rep", "n", "s1", "s2").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
        rows = self.sketched.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
        named_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return rows.select("doc_id", F.col("n").alias("n_shingles"), named_id.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    return NearDuplicates(docs, words, percent, id_col, text_col).rows
