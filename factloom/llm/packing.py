"""Packing tokenised documents into fixed windows by non-negative least squares.

Documents longer than a window give whole windows and one remainder, so only the
remainders' lengths matter: a histogram of at most ``window`` counts, however
many documents there are. Shallow combinations of lengths that fill a window are
enumerated, their repeat counts solved against the histogram by non-negative
least squares and rounded down, and what is left is packed greedily, still as
counts of lengths. Pieces then find their places by their rank among the pieces
of their length.

Defined results: a null text counts as empty; an empty text is the single end
token; repeated rows are packed as often as they occur; an empty table gives an
empty result; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship_by_value
from .workspace import Workspace, small_batches

ship_by_value(__name__)

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"


def load_encoder(path: str):
    """ids of a text under the tokenizer file at path, which turns the strings of its special tokens into their ids.

    Where the same folder holds the vocabulary as ranks, the faster reader of
    those encodes all texts without such a string; both give the same ids.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    plain = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    ranks = path.removesuffix(".json") + ".tiktoken"
    try:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    except (ImportError, FileNotFoundError):
        return plain
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    return lambda text: plain(text) if any(s in text for s in special) else fast(text)


def _cutter(path: str, window: int, end_id: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = load_encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            names, starts, lengths, crcs, totals, ranks, kept = [], [], [], [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "")
                ids.append(end_id)
                raw, n = array("I", ids).tobytes(), len(ids)
                for start in range(0, n, window):
                    length = min(window, n - start)
                    piece = raw[4 * start : 4 * (start + length)]
                    names.append(name)
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(zlib.crc32(piece))
                    totals.append(n)
                    ranks.append(seen[length])
                    seen[length] += 1
                    if with_ids:
                        kept.append(piece)
            columns = [pa.array(names, pa.int64()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))]
            columns += [pa.array([part] * len(names), pa.int32()), pa.array(ranks, pa.int64())]
            fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]
            if with_ids:
                columns.append(pa.array(kept, pa.binary()))
                fields.append("ids")
            yield pa.RecordBatch.from_arrays(columns, fields)

    return cut


def combinations(window: int, splits: int = 4) -> list[tuple[int, ...]]:
    """Every pair of lengths that fills the window, and for each length some spread-out triples."""
    found = {(window - a, a) for a in range(1, window // 2 + 1)}
    for a in range(1, window - 1):
        for k in range(splits):
            b = 1 + int((a * 0.6180339887 + (k + 0.5) / splits) % 1 * (window - a - 1))
            c = window - a - b
            if c >= 1:
                found.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(found)


def nnls(patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths nearest to counts in least squares.

    Accelerated projected gradient steps; a pattern's column has a one for each of its lengths.
    """
    depth = max(map(len, patterns))
    slots = np.zeros((len(patterns), depth), np.int64)  # length 0 is a dead row
    for i, p in enumerate(patterns):
        slots[i, : len(p)] = p
    dead = slots == 0
    goal = counts.astype(float)

    def forward(x):
        y = np.bincount(slots.ravel(), weights=np.repeat(x, depth), minlength=len(goal))
        y[0] = 0
        return y

    def back(r):
        g = r[slots]
        g[dead] = 0
        return g.sum(axis=1)

    probe = np.ones(len(patterns))
    for _ in range(30):  # the largest eigenvalue bounds the step
        probe = back(forward(probe))
        size = np.linalg.norm(probe)
        probe /= size
    step, x, look, t = 1 / size, np.zeros(len(patterns)), np.zeros(len(patterns)), 1.0
    for _ in range(rounds):
        after = np.maximum(0, look - step * back(forward(look) - goal))
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


def plan(counts: dict[int, int], window: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[([(length, uses), ...], repeats), ...]: windows that together hold exactly the counted lengths."""
    left = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    if left[window]:
        out.append(([(window, 1)], int(left[window])))
        left[window] = 0
    if left.sum() > 1:
        patterns = combinations(window)
        solved = np.floor(nnls(patterns, left)).astype(np.int64)
        for i in np.argsort(-solved, kind="stable"):
            if solved[i] < 1:
                break
            uses = {}
            for length in patterns[i]:
                uses[length] = uses.get(length, 0) + 1
            repeats = min([int(solved[i]), *(int(left[k]) // n for k, n in uses.items())])
            if repeats > 0:
                out.append((sorted(uses.items(), reverse=True), repeats))
                for length, n in uses.items():
                    left[length] -= n * repeats
    while left.any():  # greedily: the longest piece first, each gap filled by the longest that fits
        uses, gap, rest = {}, window, left
        while gap and (fit := np.flatnonzero(rest[: gap + 1])).size:
            length = int(fit[-1])
            n = min(gap // length, int(rest[length]))
            uses[length] = uses.get(length, 0) + n
            rest = rest.copy()
            rest[length] -= n
            gap -= n * length
        repeats = min(int(left[k]) // n for k, n in uses.items())
        out.append((sorted(uses.items(), reverse=True), repeats))
        for length, n in uses.items():
            left[length] -= n * repeats
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian uint32)."""
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace(spark, "packing")
    schema = PIECES + (", ids binary" if with_ids else "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = space.write(rows.mapInArrow(_cutter(tokenizer_path, window, end_id, with_ids), schema), "pieces")

    by_part = space.write(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = {int(r.length): int(r.n) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    slots, sequence, taken = [], 0, dict.fromkeys(counts, 0)
    for uses, repeats in plan(counts, window):
        at = 0
        for length, n in uses:
            slots.append((length, taken[length], taken[length] + n * repeats, sequence, n, at))
            taken[length] += n * repeats
            at += n * length
        sequence += repeats
    assert taken == counts
    places = spark.createDataFrame(slots, "length long, low long, high long, first long, uses long, at long")

    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_part.withColumn("base", F.coalesce(before, F.lit(0)))
    number = F.col("rank") + F.col("base")
    placed = pieces.join(bases.select("length", "part", "base"), ["length", "part"]).withColumn("number", number)
    # The places are a few for each of at most `window` lengths, so their broadcast is bounded.
    placed = placed.join(F.broadcast(places), (placed.length == places.length) & (placed.number >= places.low) & (placed.number < places.high)).drop(places.length)
    nth = F.col("number") - F.col("low")
    out = placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.floor(nth / F.col("uses"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("uses") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
    return out
