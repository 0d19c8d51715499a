"""Chroma audio fingerprints of recordings in a binary column, and their alignment.

A recording is mono 8-bit PCM. Overlapping frames are folded onto the twelve
pitch classes; filters over rectangles of the pitch-class image, evaluated on
its integral image, give two bits each, and sixteen of them pack into one
32-bit code per frame. A filter compares two parts of its rectangle: over all
classes against the rest of the time, over low against high classes, in a
checkered way, or the middle third against the outer ones.

Alignment. Runs of ``RUN`` codes are landmarks, all of them. Two different recordings that
share one may align, whichever others hold it too. The offsets of
their equal landmarks form a histogram; its bins with enough votes are tried, most votes
first, and the share of differing bits over the whole overlap confirms one. Two recordings
of ``(FEWEST_VOTES * SPAN)`` landmarks and more need ``FEWEST_VOTES`` votes, shorter ones one.
Equal recordings, however short, meet by an exact group on their bytes: the first one is the
reference of all others and the only one to be compared. So pairs of different recordings
are made, never pairs of copies; what comes out is one row per recording.

``recording_classes`` finds near duplicates: each recording's class and the least id it aligns
with. A landmark's holders are tried from the least id on, in windows that widen, until a
recording aligns and no smaller id is left. Holders that by then are in different
classes are compared too, all that weren't, so no link between two classes is missed; pairs
inside one class need no comparison. Two recordings that need ``FEWEST_VOTES`` votes are compared
only if they share as many landmarks, repeated ones counted twice: hashes of their landmarks,
cut to 15 bits, are intersected first, which drops no pair that could align. All other pairs that
share landmarks in different classes have to be compared, however many.

``align_recordings`` compares any two different recordings that share a landmark, for the link
with most votes and the number of links. A landmark of n different recordings costs
n (n - 1) / 2 pairs there, none of which may be left out, since each counts.

Defined results: a null or empty recording has no codes and no reference, one too
short for codes only that of an equal recording, with no votes and no overlap;
repeated rows (one id) count once; equal recordings align at offset 0 with the
least id; class_id is the least id that links lead to, the own one included; the reference
of ``align_recordings`` is the link to a smaller id with most votes, then fewest wrong
bits, then the smallest id, that of ``recording_classes`` the smallest id of a link;
n_links counts the different recordings that align with this one, equal ones once; of bins with
as many votes the one nearest to offset 0 comes first, then the positive one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ship_by_value
from .bytes_np import mix, text_bytes
from .components import components
from .workspace import Workspace, small_batches

ship_by_value(__name__)

RATE, FRAME, HOP = 4000, 256, 128
LOWEST, HIGHEST = 55.0, 1760.0  # Hz, the range folded onto pitch classes
WIDTH = 16  # frames that the widest filter sees
RUN, SPAN = 3, 8
MOST_WRONG = 0.15  # share of differing bits
FEWEST_VOTES = 2
PART = 1 << 18  # samples worked on at a time
VOTES = 1 << 22  # votes counted at a time
HOLDERS = 4  # of a landmark, tried after its first one; each further window is as many times wider

#: (kind, first class, classes, frames): kinds 0 whole, 1 low against high, 2 early against late, 3 checkered, 4 middle class third, 5 middle time third.
FILTERS = tuple((kind, 5 * i % (9 - 3 * i % 5), 4 + 3 * i % 5, (4, 8, 16)[(i + kind) % 3]) for i, kind in enumerate((0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 4, 5, 1, 2, 3, 2)))


def _fold() -> np.ndarray:
    """Which pitch class each frequency bin of a frame belongs to, as a matrix."""
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    matrix = np.zeros((len(hertz), 12), np.float32)
    for i, f in enumerate(hertz):
        if LOWEST <= f <= HIGHEST:
            matrix[i, int(round(12 * np.log2(f / 440.0))) % 12] = 1
    return matrix


FOLD = _fold()


def chroma(samples: np.ndarray) -> np.ndarray:
    """A row of twelve normalised energies for each frame."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    fold, window, out = FOLD, np.hanning(FRAME).astype(np.float32), []
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for at in range(0, len(frames), PART // HOP):
        own = (frames[at : at + PART // HOP].astype(np.float32) - 128) * window
        out.append((np.abs(np.fft.rfft(own, axis=1)).astype(np.float32) ** 2) @ fold)
    image = np.concatenate(out)
    norm = np.sqrt((image**2).sum(axis=1, keepdims=True))
    return image / np.maximum(norm, 1e-6)


def codes(samples: np.ndarray) -> np.ndarray:
    """A 32-bit code for each place where the widest filter fits."""
    if len(samples) < FRAME + (WIDTH - 1) * HOP:
        return np.zeros(0, np.uint32)
    image = chroma(samples)
    n = len(image) - WIDTH + 1
    total = np.zeros((13, len(image) + 1))
    total[1:, 1:] = image.cumsum(axis=0, dtype=np.float64).cumsum(axis=1).T

    def area(t0, t1, c0, c1):
        low, high = total[c0], total[c1]
        return high[t1 : t1 + n] - high[t0 : t0 + n] - low[t1 : t1 + n] + low[t0 : t0 + n]

    out = np.zeros(n, np.uint32)
    for kind, c, classes, t in FILTERS:
        d, half, third = c + classes, t // 2, max(1, t // 3)
        mid, part = c + classes // 2, max(1, classes // 3)
        whole = area(0, t, c, d)
        if kind == 0:
            a = whole / classes
            b = (area(0, t, 0, 12) - whole) / max(1, 12 - classes)
        elif kind == 1:
            a, b = area(0, t, c, mid), area(0, t, mid, d)
        elif kind == 2:
            a, b = area(0, half, c, d), area(half, t, c, d)
        elif kind == 3:
            a = area(0, half, c, mid) + area(half, t, mid, d)
            b = whole - a
        elif kind == 4:
            a = area(0, t, c + part, d - part)
            b = (whole - a) / 2
        else:
            a = area(third, t - third, c, d)
            b = (whole - a) / 2
        value = np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0))
        level = (value > -0.25).astype(np.uint32) + (value > 0.0) + (value > 0.25)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))  # neighbouring levels differ in one bit
    return out


def landmarks(code: np.ndarray) -> np.ndarray:
    """Hashes of the runs of RUN codes, by where they begin."""
    n = max(0, len(code) - RUN + 1)
    hashed = np.full(n, 7, np.uint64)
    for k in range(RUN):
        hashed = mix(hashed * np.uint64(0x9FB21C651E98DF25) + code[k : k + n])
    return hashed


def distinct_landmarks(code: np.ndarray) -> np.ndarray:
    """Each different landmark once, and a hash for each that long recordings (those that may need FEWEST_VOTES votes) hold repeatedly: a vote of its own."""
    marks, n = np.unique(landmarks(code), return_counts=True)
    again = marks[n > 1] if n.sum() >= FEWEST_VOTES * SPAN else marks[:0]
    return np.concatenate([marks, mix(again + np.uint64(0x9E3779B97F4A7C15))])


def votes_for(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many equal landmarks of x and y lie at each offset from -len(y) to len(x)."""
    votes = np.zeros(len(x) + len(y) + 1, np.int64)
    order = np.argsort(y, kind="stable")
    low, high = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
    shared = np.flatnonzero(high > low)
    if not len(shared):
        return votes
    many = (high - low)[shared]
    part = np.cumsum(many) // VOTES
    for own in np.split(np.arange(len(shared)), np.flatnonzero(np.diff(part)) + 1):
        m = many[own]
        at = np.repeat(low[shared[own]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        votes += np.bincount(np.repeat(shared[own], m) - order[at] + len(y), minlength=len(votes))
    return votes


def aligned(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[int, int, float, int] | None:
    """(offset, votes, share of wrong bits, overlap) of codes a and b with landmarks x and y, if they align."""
    votes = votes_for(x, y)
    needed = max(1, min(FEWEST_VOTES, min(len(x), len(y)) // SPAN))
    bins = np.flatnonzero(votes >= needed)
    offsets = bins - len(y)
    for i in np.lexsort((-offsets, np.abs(offsets), -votes[bins])):
        offset = int(offsets[i])
        p, q = a[max(0, offset) :], b[max(0, -offset) :]
        n = min(len(p), len(q))
        wrong = float(np.bitwise_count(p[:n] ^ q[:n]).sum()) / (32 * n)
        if wrong <= MOST_WRONG:
            return offset, int(votes[bins[i]]), wrong, n
    return None


def _fingerprinter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, recording) give (id, codes, digest of the recording unless it is empty)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        out = [codes(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([c.view(np.int32) for c in out], pa.list_(pa.int32())),
                pa.array([hashlib.blake2b(data[a:b], digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
            ],
            ["id", "codes", "digest"],
        )


def _marker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, codes) give (id, landmark), as distinct_landmarks."""
    for batch in batches:
        code, n = batch.column(1).flatten().to_numpy().view(np.uint32), batch.column(1).value_lengths().to_numpy()
        marks = [distinct_landmarks(c).view(np.int64) for c in np.split(code, np.cumsum(n)[:-1])] if len(n) else []
        if marks:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(m) for m in marks])), pa.array(np.concatenate(marks))], ["id", "mark"])


def _aligner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, reference, codes, codes of the reference) give those that align."""
    for batch in batches:
        columns = []
        for k in (2, 3):
            column = batch.column(k)
            code, at = column.flatten().to_numpy().view(np.uint32), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
            marks = landmarks(code)  # those across two recordings are left out below
            columns.append([(code[i:j], marks[i : max(i, j - RUN + 1)]) for i, j in zip(at[:-1], at[1:], strict=True)])
        found = [(i, r, *hit) for i, r, (a, x), (b, y) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *columns, strict=True) if (hit := aligned(a, b, x, y))]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["id", "reference", "offset", "votes", "wrong", "overlap"])


def _prepared(space: Workspace, media: DataFrame, id_col: str, media_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All recordings with their codes; later copies with their first one; landmarks of several different recordings, with the least id that holds one, their number and the place of each."""
    given = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media"))
    printed = space.write(given.mapInArrow(_fingerprinter, "id long, codes array<int>, digest binary").dropDuplicates(["id"]), "prints")
    votes = F.greatest(F.lit(0), F.size("codes") - (RUN - 1)).cast("long").alias("votes")
    first = F.min("id").over(Window.partitionBy("digest").orderBy("id")).alias("first")
    copies = space.write(printed.where("id is not null and digest is not null").select("id", first, F.size("codes").cast("long").alias("overlap"), votes).where("id > first"), "copies")
    alone = printed.where(f"id is not null and size(codes) >= {RUN}").join(copies.select("id"), "id", "left_anti")
    marks = alone.select("id", "codes").mapInArrow(_marker, "id long, mark long")
    by_id = Window.partitionBy("mark").orderBy("id")
    everyone = by_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marks = marks.select("id", "mark", F.min("id").over(everyone).alias("low"), F.count("id").over(everyone).alias("n"), F.row_number().over(by_id).alias("rank")).where("n > 1")
    return printed, copies, space.write(marks, "marks")


def _keys(space: Workspace, marks: DataFrame, printed: DataFrame) -> DataFrame:
    """(id, n, keys) of recordings that share landmarks: their number, and if they may need FEWEST_VOTES votes 15-bit hashes of those that more than two hold and that begin with another one.

    Two recordings that share a landmark either are its first holder and a later one, or both have it here. A hash that
    repeats has its last bit set from the second time on, so different landmarks of one hash count as two here as well.
    """
    inner = F.when(F.expr("n > 2 and rank > 1"), F.shiftright("mark", 49))
    sorted_keys = marks.groupBy("id").agg(F.array_sort(F.collect_list(inner)).alias("s"))
    keys = F.expr("transform(s, (x, i) -> cast(2 * x + if(i > 0 and s[greatest(i, 1) - 1] = x, 1, 0) as smallint))")
    sizes = printed.where(F.size("codes") >= RUN).select("id", (F.size("codes") - (RUN - 1)).alias("n"))
    return space.write(sorted_keys.select("id", keys.alias("keys")).join(sizes, "id").select("id", "n", F.when(F.col("n") >= FEWEST_VOTES * SPAN, F.col("keys")).alias("keys")), "keys")


def _possible(space: Workspace, met: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs (id, reference, whether id is the shorter one) of those (id, reference, shared) that share enough landmarks; shared counts those with reference as the first holder."""
    met = space.write(met, "met")
    theirs = keys.select(F.col("id").alias("reference"), F.col("n").alias("n2"), F.col("keys").alias("theirs"))
    own = keys.select(F.col("id").alias("own"), F.col("n").alias("n1"), F.col("keys").alias("ours"))  # as theirs, so both are one shuffle
    both = met.join(theirs, "reference").withColumn("theirs", F.when(F.col("shared") < FEWEST_VOTES, F.col("theirs")))
    both = both.join(own, F.col("id") == F.col("own"))
    enough = F.expr(f"least(n1, n2) < {FEWEST_VOTES * SPAN} or shared >= {FEWEST_VOTES} or shared + size(array_intersect(ours, theirs)) >= {min(2, FEWEST_VOTES)}")
    pairs = space.write(both.where(enough).select("id", "reference", F.expr("n1 <= n2").alias("shorter")), "pairs")  # so that its size is known
    space.drop(met)
    return pairs


def _links(space: Workspace, pairs: DataFrame, printed: DataFrame) -> DataFrame:
    """Those of the pairs (id, reference, shorter) that align. The codes of the shorter one are sent to the longer one's."""
    coded = printed.where(F.size("codes") >= RUN).select("id", "codes")
    ends = pairs.select("shorter", F.expr("if(shorter, id, reference)").alias("one"), F.expr("if(shorter, reference, id)").alias("other"))
    long = coded.join(ends, F.col("id") == F.col("other"), "left_semi").select(F.col("id").alias("longer"), F.col("codes").alias("long"))  # where few have a pair, the others' codes aren't shuffled
    both = ends.join(coded, F.col("one") == F.col("id")).withColumnRenamed("codes", "short").drop("id").join(long, F.col("other") == F.col("longer"))
    own, theirs = F.expr("if(shorter, short, long)").alias("codes"), F.expr("if(shorter, long, short)").alias("theirs")
    both = both.select(F.greatest("one", "other").alias("id"), F.least("one", "other").alias("reference"), own, theirs)
    links = space.write(both.mapInArrow(_aligner, "id long, reference long, offset int, votes long, wrong double, overlap long"), "links")
    space.drop(pairs)
    return links


def _facts(printed: DataFrame) -> DataFrame:
    return printed.select("id", F.size("codes").alias("n_codes"), F.crc32(F.array_join(F.col("codes").cast("array<string>"), ",").cast("binary")).alias("codes_crc32"))


def _to_first(copies: DataFrame) -> DataFrame:
    return copies.select("id", F.col("first").alias("reference"), F.lit(0).alias("offset"), "votes", F.lit(0.0).alias("wrong_bits"), "overlap")


def _first_links(space: Workspace, marks: DataFrame, keys: DataFrame, printed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links, with that to the least id for every recording, and that id (id, best): every smaller id before it that shares a landmark was compared."""
    later = marks.where("id > low")
    met = later.groupBy("id", F.col("low").alias("reference")).agg(F.count(F.lit(1)).alias("shared"))
    links = _links(space, _possible(space, met, keys), printed)
    active, tried, width = marks.where("rank > 2").select("mark", "id", "low", "rank"), 1, HOLDERS
    open_still = F.expr("reference < id and (best is null or reference < best)")
    while True:
        best = links.groupBy("id").agg(F.min("reference").alias("best"))
        holders = marks.where(f"n > 2 and rank > {tried} and rank <= {tried + width}").select("mark", F.col("id").alias("reference"), F.col("rank").alias("place"))
        near = active.join(best, "id", "left").where("best is null or low < best").join(holders, "mark").where(open_still)
        met = near.select("id", "reference").distinct().withColumn("shared", F.lit(0))
        links = links.unionByName(_links(space, _possible(space, met, keys), printed))
        best = links.groupBy("id").agg(F.min("reference").alias("best"))
        left = active.where(f"rank > {tried + width + 1}").join(best, "id", "left").where("best is null or low < best")
        active = space.write(left.join(holders.where(F.col("place") == tried + width), "mark").where(open_still).select("mark", "id", "low", "rank"), "active")
        if active.isEmpty():
            return links, best
        tried, width = tried + width, width * HOLDERS


def _between_classes(marks: DataFrame, classes: DataFrame, best: DataFrame, space: Workspace) -> DataFrame:
    """Pairs (id, reference) of different classes that share a landmark and weren't compared: a landmark's holders outside its commonest class with all others."""
    held = marks.where("n > 2").select("mark", "id").join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("own", F.coalesce("component", "id"))
    held = space.write(held.join(best, "id", "left").select("mark", "id", "own", "best"), "held")
    per = held.groupBy("mark", "own").agg(F.count(F.lit(1)).alias("n"))
    mixed = per.groupBy("mark").agg(F.max_by("own", F.struct("n", "own")).alias("most"), F.count(F.lit(1)).alias("owns")).where("owns > 1").select("mark", "most")
    mixed = space.write(held.join(mixed, "mark"), "mixed")
    others = mixed.select("mark", F.col("id").alias("id2"), F.col("own").alias("own2"), F.col("best").alias("best2"))
    met = mixed.where("own != most").join(others, "mark").where("own != own2 and if(id > id2, id2 > best, id > best2)")
    return met.select(F.greatest("id", "id2").alias("id"), F.least("id", "id2").alias("reference")).distinct()


def recording_classes(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id, n_codes, codes_crc32, reference, offset, votes, wrong_bits, overlap, class_id for every recording; reference is null where none of a smaller id aligns."""
    small_batches(media.sparkSession)
    space = Workspace(media.sparkSession, "media")
    printed, copies, marks = _prepared(space, media, id_col, media_col)
    keys = _keys(space, marks, printed)
    links, best = _first_links(space, marks, keys, printed)
    classes = space.write(components(space, links.select(F.col("id").alias("u"), F.col("reference").alias("v"))), "classes")
    met = _between_classes(marks, classes, best, space).withColumn("shared", F.lit(0))
    more = _links(space, _possible(space, met, keys), printed)
    for end in ("id", "reference"):
        more = more.join(classes.select(F.col("node").alias(end), F.col("component").alias(f"{end}_class")), end, "left")
    merged = components(space, more.select(F.coalesce("id_class", "id").alias("u"), F.coalesce("reference_class", "reference").alias("v")))
    found = links.groupBy("id").agg(F.min(F.struct("reference", "offset", "votes", "wrong", "overlap")).alias("b"))
    found = found.select("id", "b.reference", "b.offset", "b.votes", F.col("b.wrong").alias("wrong_bits"), "b.overlap")
    firsts = _facts(printed).join(copies.select("id", "first"), "id", "left").withColumn("node", F.coalesce("first", "id")).join(classes, "node", "left")
    firsts = firsts.withColumn("own", F.coalesce("component", "node")).select("id", "n_codes", "codes_crc32", "own")
    firsts = firsts.join(merged.withColumnRenamed("node", "own"), "own", "left").withColumn("class_id", F.coalesce("component", "own"))
    return firsts.join(found.unionByName(_to_first(copies)), "id", "left").select("id", "n_codes", "codes_crc32", "reference", "offset", "votes", "wrong_bits", "overlap", "class_id")


def align_recordings(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id, n_codes, codes_crc32, reference, offset, votes, wrong_bits, overlap, class_id, n_links for every recording; reference is null where none aligns."""
    small_batches(media.sparkSession)
    space = Workspace(media.sparkSession, "media")
    printed, copies, marks = _prepared(space, media, id_col, media_col)
    theirs = marks.select(F.col("id").alias("reference"), "mark")
    met = marks.join(theirs, "mark").where(F.col("id") > F.col("reference")).groupBy("id", "reference").agg(F.count(F.lit(1)).alias("shared"))
    links = _links(space, _possible(space, met, _keys(space, marks, printed)), printed)
    order = F.struct("votes", F.negative("wrong").alias("right"), F.negative("reference").alias("least"), "offset", "overlap")
    best = links.groupBy("id").agg(F.max(order).alias("b"))
    found = best.select("id", F.negative("b.least").alias("reference"), "b.offset", "b.votes", F.negative("b.right").alias("wrong_bits"), "b.overlap")
    ends = links.select(F.col("id").alias("node")).unionByName(links.select(F.col("reference").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    classes = ends.join(components(space, links.select(F.col("id").alias("u"), F.col("reference").alias("v"))), "node")
    firsts = _facts(printed).join(copies.select("id", "first"), "id", "left").withColumn("node", F.coalesce("first", "id")).join(classes, "node", "left")
    firsts = firsts.select("id", "n_codes", "codes_crc32", F.coalesce("component", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return firsts.join(found.unionByName(_to_first(copies)), "id", "left").select("id", "n_codes", "codes_crc32", "reference", "offset", "votes", "wrong_bits", "overlap", "class_id", "n_links")
