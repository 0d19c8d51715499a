"""Toxicity by exact TF-IDF cosine to labelled examples, found through a block-max inverted index.

A text is one vector of all its words, whole and folded to lower case. A word's
weight is (1 + log of its count) * idf * relevance. The relevance is 1, and more
for a word that is surely commoner in toxic examples than in the others: 1 plus
the lower end of the 95 % interval of the log ratio of its two rates. So no word
is left out or cut off, and a few telling words outweigh many others. As whole
texts are compared, one telling word among thousands of others may not.

The examples are a bounded sample of labelled rows (``EXAMPLES`` per class,
chosen by a hash of the id). Document frequencies are counted over all documents;
those under the ``RARE``-th part of them count as that part, which bounds the
table of frequencies by RARE times the words of an average text, however many
documents there are.

The examples' unit vectors form an inverted index of postings in blocks: for each
word its largest weight in each block bounds what any example of the block can
gain. The ``COMMON`` words that most examples hold are kept as dense rows, so what
they give is known for all examples by one matrix product for many texts. A
block's bound is the largest such sum in it and what its other words can add.
Blocks are opened in the order of their bounds until the k-th best found beats
the next bound, so the k nearest are exact. Their votes, weighted by similarity,
are calibrated by a logistic curve at the classes' true rates; it is fitted to
the examples' own votes, each without itself among the neighbours and without
its label in the relevances.

Defined results: a null, empty or wordless text, or one that shares no word with
an example, gets the toxic share of the labels; repeated rows get equal scores;
ties between examples go to the smaller id; labels that contradict one another
for an id count as the largest; without any labelled row of both classes every
score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from . import ship_by_value
from .bytes_np import chunks, prefix_hash, range_hash, text_bytes
from .workspace import Workspace, small_batches

ship_by_value(__name__)

EXAMPLES = 3000  # of each class; an index numbers them in 16 bits
SURE = 1.96  # standard errors
RARE = 8192
NEAREST = 31
BLOCK = 64
COMMON = 512
FIRST_BLOCKS = 24  # opened before the first bar is known
CHUNK = 1 << 20
HELD = 4 << 20  # words counted at a time
#: A run holds fewer texts than this; a text's number takes the high bits of a word's number when distinct words are counted.
NUMBERS = 10
WORD = np.uint64((1 << 64 - NUMBERS) - 1)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Terms:
    """A sorted table of words with a number for each, and a quick test that most other words fail."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.flags = np.zeros(1 << 20, bool)
        self.flags[keys >> np.uint64(44 - NUMBERS)] = True

    def look_up(self, terms: np.ndarray, other) -> np.ndarray:
        out = np.full(len(terms), other, self.values.dtype)
        if len(self.keys):
            some = np.flatnonzero(self.flags[terms >> np.uint64(44 - NUMBERS)])
            at = np.minimum(np.searchsorted(self.keys, terms[some]), len(self.keys) - 1)
            hit = self.keys[at] == terms[some]
            out[some[hit]] = self.values[at[hit]]
        return out


def words_of(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last text, where each one's words begin, its distinct words, how often each occurs) of runs of texts."""
    data, offsets = text_bytes(column)
    for a, b in chunks(offsets, CHUNK):
        for low in range(a, b, 1 << NUMBERS):
            high = min(b, low + (1 << NUMBERS))
            part, own = _FOLD[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
            letter, edge = _LETTER[part], np.zeros(len(part) + 1, bool)
            edge[own] = True
            start = np.flatnonzero(letter & (np.concatenate(([True], ~letter[:-1])) | edge[:-1]))
            end = np.flatnonzero(letter & (np.concatenate((~letter[1:], [True])) | edge[1:])) + 1
            text = np.repeat(np.arange(high - low, dtype=np.uint64), np.diff(np.searchsorted(start, own)))
            hashed = range_hash(prefix_hash(part), start, end) >> np.uint64(NUMBERS)
            found, counts = np.unique((text << np.uint64(64 - NUMBERS)) | hashed, return_counts=True)
            at = np.searchsorted(found >> np.uint64(64 - NUMBERS), np.arange(high - low + 1, dtype=np.uint64))
            yield low, high, at, found & WORD, counts


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text) give (term, in how many of them it occurs), a term as often as HELD makes it."""

    def summed(held: list) -> pa.RecordBatch:
        terms, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    held, size = [], 0
    for batch in batches:
        for *_, terms, _ in words_of(batch.column(0)):
            held.append(terms)
            size += len(terms)
            if size > HELD:
                yield summed(held)
                held, size = [], 0
    if held:
        yield summed(held)


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, label, id) give (id, label, terms, counts)."""
    for batch in batches:
        for a, b, at, terms, n in words_of(batch.column(0)):
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (terms.view(np.int64), n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(2)[a:b], batch.column(1)[a:b], *lists], ["id", "label", "terms", "counts"])


def relevance(toxic: np.ndarray, other: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """1 and more for a word that toxic of n1 toxic examples hold and other of n0 others."""
    ratio = np.log((toxic + 0.5) / (n1 + 1)) - np.log((other + 0.5) / (n0 + 1))
    return 1 + np.maximum(0, ratio - SURE * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5)))


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [start, end) one after another, and the ranges' sizes."""
    n = end - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Index:
    """Examples as unit vectors, kept word by word, with each word's largest weight in each block; weights has one for each word."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray):
        self.weights, self.blocks = weights, -(-len(ids) // BLOCK)
        row = np.repeat(np.arange(len(ids), dtype=np.int32), [len(t) for t, _ in rows])
        term = np.concatenate([np.zeros(0, np.int32), *(r[0] for r in rows)]).astype(np.int32)
        value = (1 + np.log(np.concatenate([np.zeros(0, np.int32), *(r[1] for r in rows)]))) * weights[term]
        value = value / np.sqrt(np.bincount(row, value**2, minlength=len(ids)))[row]
        best = np.lexsort((term, -value, row))
        first = best[_firsts(row)]
        lead = np.full(len(ids), -1)
        lead[row[first]] = term[first]
        order = np.lexsort((ids, lead))  # like examples share a block, which keeps the bounds tight
        self.ids, self.labels = ids[order], labels[order]
        rank = np.empty(len(ids), np.int32)
        rank[order] = np.arange(len(ids))
        own = rank[row]
        del row, best, first
        # Common words: a dense row for each, whose place in common is its number.
        often = np.zeros(len(weights), bool)
        often[np.argsort(-np.bincount(term, minlength=len(weights)), kind="stable")[:COMMON]] = True
        self.common = np.where(often, np.cumsum(often) - 1, -1).astype(np.int16)
        held = often[term]
        self._common = self.common[term[held]].astype(np.int16), own[held].astype(np.int16), value[held]
        # Postings of the others word by word, in blocks of examples; a pair is a word with a block that holds it.
        term, own, value = term[~held], own[~held], value[~held]
        order = np.lexsort((own, term))
        term, self.example, self.impact = term[order], own[order].astype(np.int16), value[order]
        block = self.example // BLOCK
        new = _firsts(term, block)
        self.pair_at, self.pair_block = np.append(new, len(term)).astype(np.int32), block[new]
        self.term_at = np.searchsorted(term[new], np.arange(len(weights) + 1, dtype=np.int32)).astype(np.int32)
        self._derive()

    def _derive(self) -> None:
        """What follows from the postings."""
        term, own, value = self._common
        self.dense = np.zeros((int(self.common.max(initial=-1)) + 1, len(self.ids)))
        self.dense[term, own] = value
        self.bounds = np.maximum.reduceat(self.impact, self.pair_at[:-1]) if len(self.impact) else np.zeros(0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("dense", "bounds")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._derive()

    def dense_part(self, at: np.ndarray, terms: np.ndarray, q: np.ndarray) -> np.ndarray:
        """What common words give each text with each example; words of the index by number, those of a text from at on, with their weights q."""
        own = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = self.common[terms]
        rows = np.zeros((len(at) - 1, len(self.dense)))
        rows[own[place >= 0], place[place >= 0]] = q[place >= 0]
        return rows @ self.dense

    def nearest(self, terms: np.ndarray, q: np.ndarray, base: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples of positive cosine; base is dense_part of this text, ``without`` is left out."""
        held = self.common[terms] < 0
        pairs, n = _ranges(self.term_at[terms[held]], self.term_at[terms[held] + 1])
        q, block = np.repeat(q[held], n), self.pair_block[pairs]
        bound = np.maximum.reduceat(base, np.arange(0, len(base), BLOCK)) + np.bincount(block, q * self.bounds[pairs], minlength=self.blocks)
        todo = np.argsort(-bound, kind="stable")
        bound = bound[todo]
        found, score = np.zeros(0, np.int64), np.zeros(0)
        at, size, end, least = 0, FIRST_BLOCKS, int(np.count_nonzero(bound > 0)), 0.0
        while at < end and bound[at] >= least - 1e-9:  # else no block that is left can hold one of the k nearest
            stop = min(end, at + size)
            now = np.zeros(self.blocks, bool)
            now[todo[at:stop]] = True
            chosen = now[block]
            posting, n = _ranges(self.pair_at[pairs[chosen]], self.pair_at[pairs[chosen] + 1])
            inside = np.repeat(now, BLOCK)[: len(base)]
            own = np.where(inside, base, 0.0) + np.bincount(self.example[posting], np.repeat(q[chosen], n) * self.impact[posting], minlength=len(base))
            if without is not None:
                own[without] = 0
            more = np.flatnonzero(own > max(0.0, least - 1e-9))
            found, score = np.concatenate((found, more)), np.concatenate((score, own[more]))
            if len(score) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                stays = score >= least - 1e-9
                found, score = found[stays], score[stays]
            at, size = stop, 4 * size
        order = np.lexsort((self.ids[found], -np.round(score, 12)))[:k]
        return found[order], score[order]

    def ballot(self, found: np.ndarray, score: np.ndarray) -> tuple[float, float]:
        """Toxic and all votes; a neighbour counts by its nearness beside the nearest one's."""
        weight = score / max(score.max(initial=0.0), 1e-300)
        return float(weight @ self.labels[found]), float(weight.sum())


def odds(yes: float, votes: float) -> float:
    """Log odds of the votes, with a quarter of a vote on each side."""
    return float(np.log((yes + 0.25) / (votes - yes + 0.25)))


def fit_curve(votes: np.ndarray, labels: np.ndarray, mass: np.ndarray) -> tuple[float, float]:
    """Logistic curve through (vote, label) pairs of the given masses, by damped Newton steps."""
    x = np.stack((votes, np.ones(len(votes))), axis=1)
    theta, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (mass * (p - labels)) + ridge @ theta
        hessian = x.T @ (x * (mass * p * (1 - p))[:, None]) + ridge
        move = np.linalg.solve(hessian, gradient)
        theta -= move * min(1, 2 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


class Scorer:
    """What a task needs to score texts: the index, the words' numbers in it, all words' idf and the curve."""

    def __init__(self, index: Index, numbers: Terms, idf: Terms, rarest: float, curve: tuple[float, float], share: float):
        self.index, self.numbers, self.idf, self.rarest, self.curve, self.share = index, numbers, idf, rarest, curve, share

    def vectors(self, at: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text's words those of the index: (where they begin, their numbers, their parts of the text's unit vector)."""
        number = self.numbers.look_up(terms, -1)
        weight = np.where(number >= 0, self.index.weights[number], self.idf.look_up(terms, self.rarest))
        value = (1 + np.log(counts)) * weight
        own = np.repeat(np.arange(len(at) - 1), np.diff(at))
        norm = np.sqrt(np.bincount(own, value**2, minlength=len(at) - 1))
        inside = number >= 0
        return np.concatenate(([0], np.cumsum(inside)))[at], number[inside], value[inside] / norm[own[inside]]

    def one(self, found: np.ndarray, score: np.ndarray) -> tuple[float, list]:
        if not len(found):
            return self.share, []
        at = np.clip(odds(*self.index.ballot(found, score)) * self.curve[0] + self.curve[1], -30, 30)
        near = [{"doc_id": int(self.index.ids[j]), "similarity": float(s), "toxic": int(self.index.labels[j])} for j, s in zip(found[:5], score[:5], strict=True)]
        return float(1 / (1 + np.exp(-at))), near

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (text, ...) give score, evidence and the other columns."""
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            rows = []
            for *_, at, terms, counts in words_of(batch.column(0)):
                at, number, q = self.vectors(at, terms, counts)
                base = self.index.dense_part(at, number, q)
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    rows.append(self.one(*self.index.nearest(number[a:b], q[a:b], base[k], NEAREST)))
            score, near = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64()), pa.array(near, kind)], [*batch.schema.names[1:], "score", "evidence"])


EVIDENCE = "array<struct<doc_id: long, similarity: double, toxic: int>>"


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer | None:
    """What scores texts, learned from labels with document frequencies over docs; None without labels of both classes."""
    space = Workspace(docs.sparkSession, "toxicity")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = space.write(known, "labels")
    rates = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    # The bounded sample: EXAMPLES ids of each class with the least hashes.
    picked = known.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(EXAMPLES).unionByName(known.where("label = 0").orderBy(F.xxhash64("id"), "id").limit(EXAMPLES))
    # Of rows that share an id the least text is the example.
    found = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    found = found.select("text", "label", "id").repartition(docs.sparkSession.sparkContext.defaultParallelism, "id")
    rows = found.mapInArrow(_example_words, "id long, label int, terms array<long>, counts array<int>").toArrow().combine_chunks().sort_by("id")
    names, y = rows["id"].to_numpy(), rows["label"].to_numpy().astype(np.int64)
    n1, n0 = float(y.sum()), float((1 - y).sum())
    if not n1 or not n0:
        return None
    sizes = [len(t) for t in rows["terms"]]
    words, flat = np.unique(rows["terms"].combine_chunks().flatten().to_numpy().view(np.uint64), return_inverse=True)
    flat, counts, label = flat.astype(np.int32), rows["counts"].combine_chunks().flatten().to_numpy(), np.repeat(y, sizes)
    toxic, other = (np.bincount(flat[label == k], minlength=len(words)).astype(float) for k in (1, 0))
    del rows, label, found

    counted = space.write(texts.select("text").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "frequencies")
    total = texts.count()
    fewest = max(1.0, total / RARE)
    often = counted.where(F.col("n") >= fewest).toArrow()
    weigh = lambda n: np.log((total + 1) / (np.maximum(n, fewest) + 1)) + 1
    idf, rarest = Terms(often["term"].to_numpy().view(np.uint64), weigh(often["n"].to_numpy())), float(weigh(0))

    own = idf.look_up(words, rarest)
    cut = np.cumsum(sizes)[:-1]
    index = Index(names, y, list(zip(np.split(flat, cut), np.split(counts, cut), strict=True)), own * relevance(toxic, other, n1, n0))
    # An example's own label takes no part in its vote.
    without = {1: own * relevance(np.maximum(toxic - 1, 0), other, n1 - 1, n0), 0: own * relevance(toxic, np.maximum(other - 1, 0), n1, n0 - 1)}
    place = {int(i): k for k, i in enumerate(index.ids)}
    votes = []
    for i, label_, t, c in zip(names, y, np.split(flat, cut), np.split(counts, cut), strict=True):
        q = (1 + np.log(c)) * without[int(label_)][t]
        q = q / max(float(np.linalg.norm(q)), 1e-300)
        base = index.dense_part(np.array([0, len(t)]), t, q)[0]
        votes.append(odds(*index.ballot(*index.nearest(t, q, base, NEAREST, place[int(i)]))))
    mass = np.where(y == 1, rates[1] / n1, rates[0] / n0)
    curve = fit_curve(np.array(votes), y.astype(float), mass * len(y) / mass.sum())
    return Scorer(index, Terms(words, np.arange(len(words), dtype=np.int32)), idf, rarest, curve, rates[1] / (rates[0] + rates[1]))


def with_scores(docs: DataFrame, scorer: Scorer | None, text_col: str = "text", names: tuple[str, str] = ("score", "evidence")) -> DataFrame:
    """docs without the text, with score and evidence (nearest examples) under the given names, which docs must not have."""
    kept = [f for f in docs.schema.fields if f.name != text_col]
    others = [F.col(f"`{f.name}`") for f in kept]
    if scorer is None:
        return docs.select(*others, F.lit(0.0).alias(names[0]), F.array().cast(EVIDENCE).alias(names[1]))
    given = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col), *others)
    added = [StructField(n, t) for n, t in zip(names, (DoubleType(), DataType.fromDDL(EVIDENCE)), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scorer(batches):
            yield pa.RecordBatch.from_arrays(b.columns, [*b.schema.names[:-2], *names])

    return given.mapInArrow(run, StructType([*kept, *added]))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, score, evidence (nearest examples) for every row of docs; labels are the rows to learn from."""
    small_batches(docs.sparkSession)
    scorer = learn(docs, labels, id_col, text_col, label_col)
    return with_scores(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), scorer, "text")
