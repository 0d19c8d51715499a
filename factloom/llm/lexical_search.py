"""Ranked lexical search of many items over all documents: a join seeded with thresholds.

One pass over the texts writes each document's length and its postings of the
items' terms. From these come the document frequencies and, for each term, its
largest impacts: what a term adds to a score but for its weight. The k-th
largest impact of a term times its weight is a score that k documents reach at
least, so the best of an item's terms bounds its k-th score from below before
any document is looked at. An item's terms are ordered by what they can add at
most; the tail of that order whose sum stays below the bound (the suffix bound)
can't lift a document over it alone, so only documents that hold another term
are candidates. In a second pass each document meets the items that its terms
lead to; pairs whose candidate terms and suffix bound together stay below the
bound go, all others are scored exactly from the document's own postings. A task
keeps each item's k best so far, which raises the bound, and k per item and task
are merged at last. Postings are never shuffled, so no term is too frequent.

Items are taken in blocks of about ``BLOCK`` pairs of an item and a term, which
bounds what is broadcast; each block reads the texts again.

Defined results: a null or empty text has no terms; items that share an id are
one item with the terms of all; every row of documents is a document of its own,
rows that share an id too; a null doc_id is behind all others of an equal score;
an item without a matching document gives no row; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ship_by_value
from .bytes_np import chunks, text_bytes
from .workspace import Workspace, small_batches

ship_by_value(__name__)

BLOCK = 1 << 20
CHUNK = 1 << 20
CELLS = 1 << 22  # pairs of a document and an item that are held at a time
HELD = 1 << 20  # impacts that a task holds before it cuts them to the largest ones
UNIT = 1_000_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def terms_of(texts) -> Iterator[tuple[int, int, np.ndarray, pa.Array]]:
    """(first, last text, where each one's terms begin, all terms in lower case) for runs of texts."""
    data, offsets = text_bytes(texts)
    for a, b in chunks(offsets, CHUNK):
        part, own = _FOLD[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        inside, edge = _TERM[part], np.zeros(len(part) + 1, bool)
        edge[own] = True
        start = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
        end = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
        at = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
        yield a, b, np.searchsorted(start, own), pa.StringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(part[inside]))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, item) give a row (item, term) for each distinct term."""
    for batch in batches:
        for a, _, at, terms in terms_of(batch.column(0)):
            item = batch.column(1).take(pa.array(np.repeat(np.arange(a, a + len(at) - 1), np.diff(at))))
            yield from pa.table({"item": item, "term": terms}).group_by(["item", "term"]).aggregate([]).select(["item", "term"]).to_batches()


def _postings(vocabulary: pa.Array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (text, id) give (id, n, terms, counts) of documents with any term; terms are places in the vocabulary."""
        for batch in batches:
            for a, b, at, terms in terms_of(batch.column(0)):
                coded = terms.dictionary_encode()
                known = pc.index_in(coded.dictionary, vocabulary).fill_null(-1).to_numpy()
                number = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
                own = np.repeat(np.arange(b - a), np.diff(at))
                pair, tf = np.unique(own[number >= 0] * len(vocabulary) + number[number >= 0], return_counts=True)
                ends = np.searchsorted(pair, np.arange(b - a + 1) * len(vocabulary)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % max(1, len(vocabulary)), tf)]
                size = np.diff(at)
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], pa.array(size), *lists], ["id", "n", "terms", "counts"]).filter(pa.array(size > 0))

    return run


def _opened(batch: pa.RecordBatch, documents: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, impact) of a batch's postings."""
    n = batch.column("n").to_numpy().astype(np.int64)
    m = 100 - 90 + (90 * n * documents) // max(1, length)
    sizes = pc.list_value_length(batch.column("terms")).to_numpy()
    own = np.repeat(np.arange(len(n)), sizes)
    tf = batch.column("counts").flatten().to_numpy().astype(np.int64)
    return own, batch.column("terms").flatten().to_numpy(), (UNIT * tf) // (1000 * tf + 8 * m[own])


def _largest(term: np.ndarray, impact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((-impact, term))
    term, impact = term[order], impact[order]
    first = np.searchsorted(term, term)
    kept = np.arange(len(term)) - first < k
    return term[kept], impact[kept]


def _impacts(documents: int, length: int, size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings give (term, impact) for the k largest impacts of each term, and once for each term how many documents hold it."""
        frequency, term, impact, held = np.zeros(size, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), 0
        for batch in batches:
            _, t, x = _opened(batch, documents, length)
            frequency += np.bincount(t, minlength=size)
            term, impact = np.concatenate((term, t)), np.concatenate((impact, x))
            if len(term) > held + HELD:
                term, impact = _largest(term, impact, k)
                held = len(term)
        term, impact = _largest(term, impact, k)
        first = np.concatenate((np.ones(min(1, len(term)), bool), term[1:] != term[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(impact), pa.array(np.where(first, frequency[term], 0))], ["term", "impact", "documents"])

    return run


class Plan:
    """A block's items: pairs (term, item, weight), candidate terms first, and each item's bounds. Terms are numbers, items too."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, largest: np.ndarray, kth: np.ndarray, terms: int, k: int):
        most = weight * largest
        self.k, self.items = k, int(item.max(initial=-1)) + 1
        self.bar = np.zeros(self.items, np.int64)
        np.maximum.at(self.bar, item, weight * kth)
        # From the least bound up, the sum of what terms can add; those that stay below the bar together lead to no candidate.
        order = np.lexsort((term, most, item))
        sums = np.cumsum(most[order])
        begin = np.searchsorted(item[order], item[order])
        suffix = np.empty(len(item), np.int64)
        suffix[order] = sums - np.where(begin > 0, sums[np.maximum(begin - 1, 0)], 0)
        leads = suffix >= np.maximum(self.bar[item], 1)
        self.rest = np.zeros(self.items, np.int64)
        np.maximum.at(self.rest, item[~leads], suffix[~leads])
        self.leading, self.trailing = (self._by_term(term[x], item[x], weight[x], terms) for x in (leads, ~leads))
        self.exact = int(np.bincount(item, most, minlength=1).max(initial=0)) < 1 << 53

    @staticmethod
    def _by_term(term, item, weight, terms):
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(terms + 1)), item[order], weight[order]

    def added(self, group, own: np.ndarray, term: np.ndarray, impact: np.ndarray, documents: int) -> np.ndarray:
        """What a group of terms adds to each document's score for each item."""
        at, item, weight = group
        n = at[term + 1] - at[term]
        pair = np.repeat(at[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell, gain = np.repeat(own, n) * self.items + item[pair], np.repeat(impact, n) * weight[pair]
        if self.exact:  # sums of integers below 2^53 are exact in doubles
            return np.bincount(cell, gain, minlength=documents * self.items).astype(np.int64).reshape(documents, self.items)
        out = np.zeros(documents * self.items, np.int64)
        np.add.at(out, cell, gain)
        return out.reshape(documents, self.items)


def _best(plan: Plan, documents: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings give (item, id, score): the k best documents of each item among a task's."""
        bar = np.maximum(plan.bar, 1)
        item, doc, score = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64)
        for batch in batches:
            step = max(1, CELLS // max(1, plan.items))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                own, term, impact = _opened(part, documents, length)
                sums = plan.added(plan.leading, own, term, impact, part.num_rows)
                d, i = np.nonzero((sums > 0) & (sums + plan.rest >= bar))
                if not len(d):
                    continue
                some, place = np.unique(d, return_inverse=True)
                kept = np.isin(own, some)
                more = plan.added(plan.trailing, np.searchsorted(some, own[kept]), term[kept], impact[kept], len(some))
                total = sums[d, i] + more[place, i]
                good = total >= bar[i]
                ids = np.array(part.column("id").take(pa.array(d[good])).to_pylist(), object)
                item, doc, score = np.concatenate((item, i[good])), np.concatenate((doc, ids)), np.concatenate((score, total[good]))
                last = np.array([x is None for x in doc], bool)
                order = np.lexsort((np.where(last, 0, doc).astype(np.int64), last, -score, item))
                item, doc, score = item[order], doc[order], score[order]
                nth = np.arange(len(item)) - np.searchsorted(item, item)
                np.maximum.at(bar, item[nth == plan.k - 1], score[nth == plan.k - 1])
                item, doc, score = item[nth < plan.k], doc[nth < plan.k], score[nth < plan.k]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc.tolist(), pa.int64()), pa.array(score)], ["item", "doc_id", "score"])

    return run


def _block(texts: DataFrame, pairs: DataFrame, k: int, space: Workspace) -> DataFrame:
    """(item_id, doc_id, score), a few rows more than k for each item of one block; pairs (item, term) of that block."""
    spark = texts.sparkSession
    # BLOCK bounds these; sorted, so that a lost task is done again alike.
    table = pairs.toArrow().combine_chunks()
    vocabulary = pc.unique(table["term"]).combine_chunks() if isinstance(pc.unique(table["term"]), pa.ChunkedArray) else pc.unique(table["term"])
    vocabulary = vocabulary.take(pc.sort_indices(vocabulary)).cast(pa.string())
    names = pc.unique(table["item"])
    item, term = (pc.index_in(table[c], v).combine_chunks().to_numpy().astype(np.int64) for c, v in (("item", names), ("term", vocabulary)))

    held = space.write(texts.mapInArrow(_postings(vocabulary), "id long, n long, terms array<int>, counts array<int>"), "postings")
    documents, length = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = space.write(held.mapInArrow(_impacts(documents, length, len(vocabulary), k), "term int, impact long, documents long"), "impacts")
    largest = found.withColumn("nth", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))).where(F.col("nth") <= k)
    stored = largest.groupBy("term").agg(F.max("impact").alias("largest"), F.max(F.when(F.col("nth") == k, F.col("impact"))).alias("kth"))
    often = found.groupBy("term").agg(F.sum("documents").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1)))
    stored = stored.join(often, "term").select("term", "largest", F.coalesce("kth", F.lit(0)).alias("kth"), weight.cast("long").alias("weight")).toArrow()
    values = np.zeros((3, len(vocabulary)), np.int64)
    values[:, stored["term"].to_numpy()] = [stored[c].to_numpy() for c in ("largest", "kth", "weight")]
    plan = Plan(item, term, values[2][term], values[0][term], values[1][term], len(vocabulary), k)

    best = held.mapInArrow(_best(plan, documents, length), "item long, doc_id long, score long")
    numbered = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(names))), "item_id": names.cast(pa.int64())}))
    return space.write(best.join(F.broadcast(numbered), "item").select("item_id", "doc_id", "score"), "best")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for each item, ties to the smaller id."""
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace(spark, "lexical-search")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(text(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    asked = items.select(text(item_text).alias("text"), F.col(item_col).cast("long").alias("item"))
    pairs = space.write(asked.mapInArrow(_item_terms, "item long, term string").distinct(), "items")
    blocks = -(-pairs.count() // BLOCK)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        found = found.unionByName(_block(texts, pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k, space))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
