"""Language identification: family first, then one-versus-one linear SVMs within the family.

A text is described by the square roots of the shares of its hashed byte
trigrams, so every text is a unit vector. Languages whose mean vectors are
nearest form a family (average linkage, as many families as the square root of
the number of languages). One linear support vector machine per family against
the others picks the family; within it one machine per pair of languages votes,
and equal votes go to the larger sum of margins. The machines are fitted to a
bounded sample, ``EXAMPLES`` texts per language chosen by a hash of the id.

Defined results: a null text, or one without any letter, is ``und`` with score
0, as is every text where nothing was learned; repeated rows get equal results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ship_by_value
from .bytes_np import chunks, text_bytes
from .workspace import Workspace, small_batches

ship_by_value(__name__)

BITS = 12
EXAMPLES = 500  # of each language, at most
ALL_EXAMPLES = 20_000  # vectors that the driver holds, whatever the number of languages
CHUNK = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65][~np.isin(np.arange(65), [39])] = 32  # blanks, digits and marks all separate words


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The vector of each text."""
    folded = _FOLD[data].astype(np.uint32)
    grams = folded[:-2] << np.uint32(16) | folded[1:-1] << np.uint32(8) | folded[2:] if len(folded) > 2 else folded[:0]
    place = grams * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        n = np.bincount(place[a : max(a, b - 2)], minlength=1 << BITS).astype(np.float32)
        total = n.sum()
        yield np.sqrt(n / total) if total else n


def _describer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, lang) give (id, lang, vector)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        vectors = [v.tobytes() for v in features(data, offsets)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(vectors, pa.binary())], ["id", "lang", "vector"])


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 50.0, rounds: int = 150) -> np.ndarray:
    """Weights (the last is the offset) of a linear SVM with squared hinge loss; y is 1 or -1.

    Both classes weigh alike. Accelerated gradient steps; rows of x are unit vectors, which bounds the curvature.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = look = np.zeros(x.shape[1] + 1, np.float32)
    step, t = 1 / (1 / cost + 4), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ look[:-1] + look[-1]))
        pull = -2 * share * y * slack
        gradient = np.append(x.T @ pull, pull.sum()).astype(np.float32)
        gradient[:-1] += look[:-1] / cost
        after = look - step * gradient
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = (after + (t - 1) / t_after * (after - w)).astype(np.float32)
        w, t = after, t_after
    return w


def families(means: dict[str, np.ndarray]) -> list[list[str]]:
    """Languages grouped by average linkage of their mean vectors' cosines."""
    groups = [[k] for k in sorted(means)]
    unit = {k: v / max(1e-12, np.linalg.norm(v)) for k, v in means.items()}
    while len(groups) > max(1, round(len(means) ** 0.5)):
        near = [(np.mean([unit[x] @ unit[y] for x in a for y in b]), i, j) for (i, a), (j, b) in combinations(enumerate(groups), 2)]
        _, i, j = max(near, key=lambda n: (n[0], -n[1], -n[2]))
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        lang = np.array(langs)
        self.families = families({k: x[lang == k].mean(axis=0) for k in set(langs)})
        sign = lambda part: np.where(np.isin(lang, part), 1, -1).astype(np.float32)
        self.outer = [fit_svm(x, sign(f)) if len(self.families) > 1 else np.zeros(x.shape[1] + 1, np.float32) for f in self.families]
        self.inner = {}
        for f in self.families:
            for a, b in combinations(f, 2):
                own = np.isin(lang, (a, b))
                self.inner[a, b] = fit_svm(x[own], np.where(lang[own] == a, 1, -1).astype(np.float32))
        # A win by the examples' median margin counts as 99 % sure, none as even.
        margins = [self.decide(v)[1] for v in x]
        self.slope = np.log(99) / max(1e-6, float(np.median(margins)))

    def decide(self, v: np.ndarray) -> tuple[str, float]:
        """The language and the least margin by which it won."""
        outer = np.array([v @ w[:-1] + w[-1] for w in self.outer])
        best = int(outer.argmax())
        margin = float(outer[best] - max((m for i, m in enumerate(outer) if i != best), default=outer[best] - 2)) / 2
        votes = {k: [0, 0.0] for k in self.families[best]}
        for a, b in combinations(self.families[best], 2):
            w = self.inner[a, b]
            m = float(v @ w[:-1] + w[-1])
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        lang = max(sorted(votes), key=lambda k: tuple(votes[k]))
        others = len(votes) - 1
        return lang, min(margin, votes[lang][1] / others) if others else margin


def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets, CHUNK):
                decided = [model.decide(v) for v in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
                margin = np.array([d[1] for d in decided])
                score = 1 / (1 + np.exp(-np.clip(model.slope * margin, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array([d[0] for d in decided], pa.string()), pa.array(score)], ["doc_id", "letters", "lang", "score"])

    return run


def identify_language(docs: DataFrame, examples: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score for every row of docs; examples are the rows to learn from."""
    spark = docs.sparkSession
    small_batches(spark)
    known = examples.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    space = Workspace(spark, "language")
    sizes = space.write(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
    wanted = min(EXAMPLES, ALL_EXAMPLES // max(1, sizes.count()))
    # The wanted ids of least hash lie below this share of the hashes but for odds of ten standard deviations, so no language's rows meet in one task.
    share = (wanted + 10 * wanted**0.5) / F.col("n")
    near = known.select("id", "lang").join(sizes, "lang").where(F.shiftrightunsigned(F.xxhash64("id"), 1) / float(1 << 63) < share)
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned(F.xxhash64("id"), 1), "id")
    picked = near.select("id", "lang").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= wanted).select("id", "lang")
    # A bounded broadcast: ALL_EXAMPLES ids.
    sample = known.join(F.broadcast(picked), ["id", "lang"]).select("id", "text", "lang").mapInArrow(_describer, "id long, lang string, vector binary")
    rows = sorted(space.write(sample.dropDuplicates(["id", "lang"]), "sample").collect(), key=lambda r: (r.lang, r.id))
    text = F.col(text_col).cast("string")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if not rows:
        return given.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = Model(np.stack([np.frombuffer(r.vector, np.float32) for r in rows]), [r.lang for r in rows])
    out = given.select("doc_id", "text", "letters").mapInArrow(_predictor(model), "doc_id long, letters boolean, lang string, score double")
    return out.select("doc_id", F.when(F.col("letters"), F.col("lang")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"))
