"""Repeated passages by column-wise construction of a multi-document suffix order.

Every string of ``LENGTH`` bytes that starts in more than one place is found,
and the bytes that such strings cover are removed.

1. Anchors. The least hashed ``GRAM``-gram of each window of LENGTH bytes is its
   anchor (the leftmost of equals). Equal windows have equal anchors at equal
   offsets, so two windows need comparing only if they share the anchor's hash.
   An anchor with its context (the bytes of all windows that chose it) goes on
   only if its hash occurs in several places.
2. Columns. The contexts of one anchor hash form a collection of short
   documents, aligned at the anchor. It is built from its last column to its
   first: each round inserts one symbol of each document before its suffix,
   sorts the documents stably by that symbol (which carries the order of the
   suffixes over) and updates the common prefixes of neighbours: one more than
   the least of those between two documents with the same symbol, else none.
   After a column, a window that starts there repeats exactly if its common
   prefix with a neighbour reaches LENGTH. The sorted shuffle files of Spark are
   the sequential external files: a task reads its collections one after another.
3. Collections beyond ``CROWD`` documents are dealt anew by what their windows
   have in common, first in eighths of the offsets and, where that doesn't
   thin them out, window by window, where counting equal hashes is all that is
   left. So no collection is gathered whole, and none is capped.

Texts that occur more than once are repeated as a whole and only one of them
takes part in the search.

Defined results: a null text counts as empty; texts shorter than LENGTH lose
nothing; repeated rows are repeats of one another; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ship_by_value
from .bytes_np import chunks, mix, powers, prefix_hash, range_hash, text_bytes
from .workspace import Workspace, small_batches

ship_by_value(__name__)

GRAM = 64
CHUNK = 1 << 20
CROWD = 20_000
EIGHTHS = 8
#: Symbols of a collection that are held at a time.
HELD = 8 << 20


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text number, anchor's hash, anchor's place, first and last window) of runs of windows with one anchor."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    width = length - GRAM + 1  # grams in a window
    if len(data) < length:
        return none
    sums = prefix_hash(data)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * powers(len(data))[1][: len(data) - GRAM + 1])
    # The place in the low bits makes the leftmost of equal grams the least; a chunk has under 2^24 bytes.
    rank = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(rank) % width
    blocks = np.concatenate((rank, np.full(pad, 0xFFFFFFFFFFFFFFFF, np.uint64))).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - length + 1
    least = np.minimum(right[:windows], left[width - 1 : width - 1 + windows])
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    inside = np.arange(windows) + length <= offsets[text + 1]
    start = np.flatnonzero(inside)
    if not len(start):
        return none
    place, text = place[start], text[start]
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
    end = np.concatenate((new[1:], [len(start)])) - 1
    base = offsets[text[new]]
    return text[new], grams[place[new]].view(np.int64), place[new] - base, start[new] - base, start[end] - base


def _parts(offsets: np.ndarray, length: int):
    """Text runs of a chunk, a text beyond it in overlapping parts: (first, last text, first byte, last byte)."""
    for a, b in chunks(offsets, CHUNK):
        if b - a > 1 or offsets[b] - offsets[a] <= 4 * CHUNK:
            yield a, b, offsets[a], offsets[b]
        else:
            for at in range(offsets[a], max(offsets[a] + 1, offsets[b] - length + 1), CHUNK):
                yield a, b, at, min(offsets[b], at + CHUNK + length - 1)


def _unpack(where: int) -> tuple[int, int, int]:
    """place, first and last window of an anchor, packed in one number."""
    place = where >> 20
    return place, place - (where >> 10 & 1023), place - (where & 1023)


def _anchorer(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, low, high in _parts(offsets, length):
                own = np.clip(offsets[a : b + 1], low, high) - low
                text, anchor, place, first, last = anchors_of(data[low:high], own, length)
                shift = low - offsets[a]
                where = (place + shift << 20) + (place - first << 10) + (place - last)
                yield pa.RecordBatch.from_arrays([pa.array(h1[a + text]), pa.array(h2[a + text]), pa.array(anchor), pa.array(where.astype(np.int64))], ["h1", "h2", "anchor", "where"])

    return run


def _fill_words(rows: np.ndarray, contexts: list[bytes], sizes: np.ndarray, start: np.ndarray, unit: int) -> None:
    """Put each context's codes of unit bytes into its row from start on, as numbers from 1."""
    codes = _DIGITS[np.frombuffer(b"".join(contexts), np.uint8).reshape(-1, unit)] @ (64 ** np.arange(unit)) + 1
    own = np.repeat(np.arange(len(contexts)), sizes)
    rows[own, np.arange(len(own)) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)] = codes


def repeated_windows(contexts: list[bytes], before: np.ndarray, group: np.ndarray, length: int, unit: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """Yields (offset of the window from the anchor, numbers of the contexts whose window there repeats in their group).

    contexts come sorted by group; before[i] is how far context i reaches to the
    left of its anchor. Lengths and offsets count symbols, of unit bytes each.
    """
    n, top = len(contexts), 257 if unit == 1 else 64**unit + 1
    sizes = np.array([len(c) // unit for c in contexts], np.int64)
    far = int((sizes - before).max())  # columns to the right of the anchor
    deep = int(before.max())
    rows = np.zeros((n, deep + far), np.uint16 if unit == 1 else np.uint32)  # 0: the document isn't there
    if unit > 1:
        _fill_words(rows, contexts, sizes, deep - before, unit)
    for i, (context, left) in enumerate(zip(contexts, before.tolist(), strict=True) if unit == 1 else ()):
        at = deep - left
        rows[i, at : at + len(context)] = np.frombuffer(context, np.uint8)
        rows[i, at : at + len(context)] += 1
    symbols = np.ascontiguousarray(rows.T)  # column by column
    del rows
    order, common = np.arange(n), np.zeros(n, np.int32)  # common[r]: prefix shared with the document at rank r - 1
    ranks_by_group = group.astype(np.int64) * top
    for c in range(deep + far - 1, -1, -1):
        key = ranks_by_group[order] + symbols[c][order]
        now = np.argsort(key, kind="stable")
        if (now[1:] > now[:-1]).all():
            now = None
        sorted_key = key if now is None else key[now]
        same = np.zeros(n, bool)
        same[1:] = (sorted_key[1:] == sorted_key[:-1]) & (sorted_key[1:] % top != 0)
        if now is None:
            common = np.where(same, common + 1, 0)
        else:
            fresh = np.zeros(n, np.int32)
            at = np.flatnonzero(same)
            low, high = now[at - 1] + 1, now[at]
            near = low == high
            fresh[at[near]] = common[high[near]] + 1
            wide = np.flatnonzero(~near)
            if len(wide):
                bounds = np.empty(2 * len(wide), np.int64)
                bounds[0::2], bounds[1::2] = low[wide], high[wide] + 1
                padded = np.append(common, 0)
                fresh[at[wide]] = np.minimum.reduceat(padded, bounds)[0::2] + 1
            order, common = order[now], fresh
        if c <= deep:
            hit = common >= length
            if hit.any():
                hit[:-1] |= hit[1:]
                yield c - deep, order[hit]


def _builder(length: int, unit: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (group key, h1, h2, place, first, last, context), sorted by key, give removed spans of texts."""

        def spans(rows: list) -> pa.RecordBatch | None:
            keys = [r[0] for r in rows]
            group = np.cumsum([0, *(x != y for x, y in zip(keys[1:], keys[:-1], strict=True))])
            place, first, last = (np.array([r[k] for r in rows]) // unit for k in (3, 4, 5))
            who, where = [], []
            for offset, hit in repeated_windows([r[6] for r in rows], place - first, group, length // unit, unit):
                at = place[hit] + offset
                own = (at >= first[hit]) & (at <= last[hit])
                who.append(hit[own])
                where.append(at[own])
            if not who:
                return None
            who, where = np.concatenate(who), np.concatenate(where)
            if not len(who):
                return None
            order = np.lexsort((where, who))
            who, where = who[order], where[order]
            where = where * unit
            new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (where[1:] > where[:-1] + length))))
            end = where[np.concatenate((new[1:], [len(who)])) - 1] + length
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[i][1] for i in who[new]], pa.int64()), pa.array([rows[i][2] for i in who[new]], pa.int64()), pa.array(where[new]), pa.array(end)],
                ["h1", "h2", "start", "end"],
            )

        def done(rows: list) -> Iterator[pa.RecordBatch]:
            keys: dict = {}
            for r in rows:
                keys[r[0]] = keys.get(r[0], 0) + 1
            rows = [r for r in rows if keys[r[0]] > 1]
            if rows and (out := spans(rows)):
                yield out

        rows, held, now = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held > HELD and r[0] != now:
                    yield from done(rows)
                    rows, held = [], 0
                rows.append(r)
                held += 2 * length
                now = r[0]
        yield from done(rows)

    return run


def _contexts(length: int, unit: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (h1, h2, text, anchors of the text) give a row per anchor with its context, a crowded anchor's cut into eighths."""
        step = -(-(length - GRAM + 1) // EIGHTHS)
        for batch in batches:
            for h1, h2, text, anchors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, out = text.encode(), []
                for x in anchors:
                    anchor = x["anchor"]
                    place, first, last = _unpack(x["where"])
                    first, last = -(-first // unit) * unit, last // unit * unit  # windows begin at whole symbols
                    if not x["crowded"]:
                        if first <= last:
                            out.append((anchor, 0, place, first, last, raw[first : last + length]))
                        continue
                    for k in range(EIGHTHS):  # windows that begin in [low, high] share the bytes [high, low + length)
                        low, high = place - (k + 1) * step + 1, place - k * step
                        a, b = max(-(-low // unit) * unit, first), min(high // unit * unit, last)
                        if a <= b:
                            core = hashlib.blake2b(raw[high : low + length], digest_size=8)
                            core.update(b"%d,%d" % (anchor, k))
                            key = int.from_bytes(core.digest(), "little", signed=True)
                            out.append((key, 1, place, a, b, raw[a : b + length]))
                if out:
                    a = list(zip(*out, strict=True))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    key, *rest = [pa.array(x, t) for x, t in zip(a, kinds, strict=True)]
                    own = [pa.array([h] * len(out), pa.int64()) for h in (h1, h2)]
                    yield pa.RecordBatch.from_arrays([key, *own, *rest], ["key", "h1", "h2", "level", "place", "first", "last", "context"])

    return run


def _windows(length: int, unit: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each window of each context: its hash and where it starts."""
        for batch in batches:
            for h1, h2, first, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = range(0, len(context) - length + 1, unit)
                hashed = [hashlib.blake2b(context[i : i + length], digest_size=16).digest() for i in starts]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashed, pa.binary()), pa.array([h1] * n, pa.int64()), pa.array([h2] * n, pa.int64()), pa.array([first + i for i in starts], pa.int64())],
                    ["window", "h1", "h2", "start"],
                )

    return run


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, spans, n_word_runs) give doc_id, sizes, the kept bytes' checksum, n_word_runs and the kept text."""
    for batch in batches:
        rows = []
        for doc_id, text, spans, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = (text or "").encode()
            cuts = _merged((x["start"], min(x["end"], len(raw))) for x in spans)
            kept, at = [], 0
            for start, end in cuts:
                kept.append(raw[at:start])
                at = end
            kept = b"".join([*kept, raw[at:]])
            rows.append((doc_id, len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), runs, kept))
        if rows:
            a = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(a, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_word_runs", "kept"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"))


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", unit: int = 1) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, spans: array of (start, end)) of texts with repeated windows, and (h1, h2, copies) of texts that occur more than once.

    h1 and h2 are two hashes of a text; spans may overlap. With a unit above 1 a
    text is a row of codes of so many bytes, each one symbol, and windows begin and
    end with them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace(spark, "suffix")
    rows = _keyed(docs, id_col, text_col)
    copies = space.write(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")

    long_enough = rows.where(F.octet_length("text") >= length).select("h1", "h2", "text")
    anchors = space.write(long_enough.mapInArrow(_anchorer(length), "h1 long, h2 long, anchor long, where long"), "anchors")
    # An anchor's hash counts as repeated if it stands in two places; copies of one text have the same places.
    at = F.struct("h1", "h2", "where")
    counted = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("p"), F.max(at).alias("q")).where("p != q").select("anchor", "n")
    counted = space.write(counted, "repeats")
    any_crowd = not counted.where(F.col("n") > CROWD).limit(1).isEmpty()
    own = anchors.join(counted, "anchor").withColumn("crowded", F.col("n") > CROWD)
    own = own.groupBy("h1", "h2").agg(F.collect_set(F.struct("anchor", "where", "crowded")).alias("anchors"))
    texts = long_enough.dropDuplicates(["h1", "h2"]).join(own, ["h1", "h2"])
    shape = "key long, h1 long, h2 long, level int, place long, first long, last long, context binary"
    contexts = texts.select("h1", "h2", "text", "anchors").mapInArrow(_contexts(length, unit), shape)
    columns = ["key", "h1", "h2", "place", "first", "last", "context"]
    single = None
    if any_crowd:
        contexts = space.write(contexts, "contexts")
        # Broadcast, as there is one for CROWD contexts at most: a shuffled join by key would take the place of the
        # repartition below, and Spark may then read its shuffle in parts that tear collections apart.
        crowded = F.broadcast(contexts.where("level = 1").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("key"))
        one_by_one = contexts.where("level = 1").join(crowded, "key", "left_semi").select("h1", "h2", "first", "context")
        windows = space.write(one_by_one.mapInArrow(_windows(length, unit), "window binary, h1 long, h2 long, start long"), "windows")
        often = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
        single = windows.join(often, "window", "left_semi").select("h1", "h2", "start", (F.col("start") + length).alias("end"))
        contexts = contexts.join(crowded, "key", "left_anti")
    built = contexts.select(columns).repartition("key").sortWithinPartitions("key")
    spans = built.mapInArrow(_builder(length, unit), "h1 long, h2 long, start long, end long")
    spans = spans if single is None else spans.unionByName(single)
    gathered = spans.groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = space.write(gathered, "spans")
    space.drop(anchors, counted)
    return out, copies


def dedup_passages(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_word_runs for every row of docs (and kept: the bytes that stay).

    n_word_runs counts the maximal runs covered by strings of so many words that
    also start anywhere else, whatever their bytes; nothing is removed for them.
    Without words it is 0.
    """
    spans, copies = repeated_spans(docs, length, id_col, text_col)
    rows = _keyed(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    none = F.lit(0).cast("long")
    runs = None if words is None else word_spans(docs, words, text_col).select(F.col("t1").alias("h1"), F.col("t2").alias("h2"), _count_runs("spans").alias("runs"))
    counted = lambda df: df.withColumn("n_word_runs", none) if runs is None else df.join(runs, ["h1", "h2"], "left").withColumn("n_word_runs", F.coalesce("runs", none)).drop("runs")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(1 << 40).cast("long").alias("end")))
    copied = copies.select("h1", "h2", F.lit(True).alias("copied"))
    marks = spans.join(copied, ["h1", "h2"], "full").select("h1", "h2", "copied", "spans")
    lost_all = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= length)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_word_runs long, kept binary"
    if with_text:
        marked = rows.join(marks, ["h1", "h2"], "left").withColumn("spans", F.when(lost_all, whole).otherwise(F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType))))
        return counted(marked).select("doc_id", "text", "spans", "n_word_runs").mapInArrow(_cutter, schema)
    # Only texts that lose a part travel to the marks; of the others, sizes and checksums do.
    partly = spans.join(copied, ["h1", "h2"], "left_anti")
    cut = rows.select("h1", "h2", "doc_id", "text").join(counted(partly), ["h1", "h2"]).select("doc_id", "text", "spans", "n_word_runs").mapInArrow(_cutter, schema).drop("kept")
    facts = rows.select("h1", "h2", "doc_id", "n_bytes", F.sha2("text", 256).alias("sha"))
    rest = facts.join(marks.select("h1", "h2", "copied", F.lit(True).alias("marked")), ["h1", "h2"], "left").where(F.col("marked").isNull() | F.col("copied"))
    kept = counted(rest).select(
        "doc_id", "n_bytes", F.when(lost_all, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"),
        lost_all.cast("long").alias("n_spans"), F.when(lost_all, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"), "n_word_runs",
    )
    return kept.unionByName(cut)


def _stripper(place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a table and, last, spans of the text in column number place: the rows without the spans' bytes."""
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if spans:
                    raw, kept, at = text.encode(), [], 0
                    for start, end in _merged((x["start"], min(x["end"], len(raw))) for x in spans):
                        kept.append(raw[at:start])
                        at = end
                    # A span may end inside a character, whose rest goes too.
                    text = b"".join([*kept, raw[at:]]).decode("utf-8", errors="ignore")
                texts.append(text)
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return run


def strip_passages(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with their repeated passages removed from the text; a column of text lengths follows the text."""
    spans, copies = repeated_spans(docs, length, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = [F.col(c) for c in docs.columns]
    rows = docs.select(*names, F.xxhash64(text).alias("_strip_h1"), F.xxhash64(F.lit("second"), text).alias("_strip_h2"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(1 << 40).cast("long").alias("end")))
    marks = spans.join(copies.select("h1", "h2", F.lit(True).alias("copied")), ["h1", "h2"], "full")
    marks = marks.select(F.col("h1").alias("_strip_h1"), F.col("h2").alias("_strip_h2"), F.when(F.coalesce("copied", F.lit(False)), whole).otherwise(F.col("spans")).alias("_strip_spans"), F.coalesce("copied", F.lit(False)).alias("_strip_copied"))
    marked = rows.join(marks, ["_strip_h1", "_strip_h2"], "left")
    lost = F.when(~F.col("_strip_copied") | (F.octet_length(text) >= length), F.col("_strip_spans"))
    place = docs.columns.index(text_col)
    out = marked.select(*names, lost.alias("_strip_spans")).mapInArrow(_stripper(place), docs.schema)
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Bytes that stand for a word in a coded text, 30 bits of its hash, and the characters they are made of.
CODE = 5
_CODES = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_DIGITS = np.zeros(256, np.int64)
_DIGITS[_CODES] = np.arange(64)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words, runs without white space, begin and end."""
    word, edge = ~_SPACE[data], np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = word & (np.concatenate(([True], ~word[:-1])) | edge[:-1])
    end = word & (np.concatenate((~word[1:], [True])) | edge[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _coder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t1, t2, text) give (t1, t2, the text with each word as CODE characters of its hash and nothing between)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        for a, b in chunks(offsets, CHUNK):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            start, end = _words(own, at) if len(own) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            hashed = range_hash(prefix_hash(own), start, end)
            coded = _CODES[((hashed[:, None] >> (np.arange(CODE, dtype=np.uint64) * np.uint64(6))) & np.uint64(63)).astype(np.uint8)]
            ends = CODE * np.searchsorted(start, at)
            text = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(coded)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], text.cast(pa.string())], ["t1", "t2", "text"])


def _word_stripper(place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a table and, last, spans of the coded text in column number place: the rows without the spans' words."""
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if spans:
                    raw, kept, at = text.encode(), [], 0
                    start, end = _words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    for low, high in _merged((x["start"], min(x["end"], CODE * len(start))) for x in spans):
                        first, last = -(-low // CODE), high // CODE  # whole words only
                        if first < last:
                            kept.append(raw[at : start[first]])
                            at = int(end[last - 1])
                    text = b"".join([*kept, raw[at:]]).decode()
                texts.append(text)
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return run


def word_spans(docs: DataFrame, words: int = 51, text_col: str = "text") -> DataFrame:
    """(t1, t2, spans in the coded text) of texts, by two hashes, with runs of so many words and more that occur more than once.

    Each word becomes CODE characters of its hash, so such runs are repeated strings of words * CODE bytes of the coded text.
    """
    small_batches(docs.sparkSession)
    space, length = Workspace(docs.sparkSession, "words"), words * CODE
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), text.alias("text"))
    coded = space.write(given.mapInArrow(_coder, "t1 long, t2 long, text string"), "coded").withColumn("doc_id", F.lit(0))
    spans, copies = repeated_spans(coded, length, unit=CODE)
    own = coded.where(F.octet_length("text") >= length).select("t1", "t2", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")).distinct()
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(1 << 40).cast("long").alias("end")))
    marks = spans.join(copies.select("h1", "h2", F.lit(True).alias("copied")), ["h1", "h2"], "full")
    marks = own.join(marks.select("h1", "h2", F.when(F.col("copied"), whole).otherwise(F.col("spans")).alias("spans")), ["h1", "h2"])
    return marks.select("t1", "t2", "spans")


def _count_runs(spans: str) -> Column:
    """How many runs are left when spans that meet or overlap are one."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    step = lambda a, x: F.struct((a["n"] + (x["start"] > a["end"]).cast("long")).alias("n"), F.greatest(a["end"], x["end"]).alias("end"))
    return F.aggregate(F.array_sort(F.col(spans)), start, step)["n"]


def strip_word_passages(docs: DataFrame, words: int = 51, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs without the runs of so many words and more that occur more than once, whatever the words' lengths."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marks = word_spans(docs, words, text_col).select(F.col("t1").alias("_strip_t1"), F.col("t2").alias("_strip_t2"), F.col("spans").alias("_strip_spans"))
    # The row travels whole, so no name of its columns meets one of these.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_strip_row")
    marked = docs.select(row, F.xxhash64(text).alias("_strip_t1"), F.xxhash64(F.lit("second"), text).alias("_strip_t2")).join(marks, ["_strip_t1", "_strip_t2"], "left")
    out = marked.select(*(F.col("_strip_row").getField(c).alias(c) for c in docs.columns), "_strip_spans").mapInArrow(_word_stripper(docs.columns.index(text_col)), docs.schema)
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
