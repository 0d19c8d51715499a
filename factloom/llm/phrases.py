"""Collocations: frequent phrases of a language, scored by how far they exceed chance, mined by pivot partitioning.

Words are ranked by frequency. A phrase belongs to its rarest word, its pivot
(of equal words the leftmost). So each occurrence of a frequent word gives one
fragment: the word, up to four words on its left that are more frequent, and up
to four on its right that are at least as frequent; rarer words end it. Equal
fragments are merged with a count and sent to the pivot's bucket. There phrases
are counted level by level: a phrase with the pivot is looked at only if both
phrases one word shorter that hold the pivot are frequent. Each phrase is counted
in one bucket only, so counts there are final.

A pivot with more than ``HOT`` expected fragments is dealt to several buckets by
a hash of its fragments; these emit all its phrases with partial counts, which
are summed afterwards. Buckets hold about ``BUCKET`` fragments, however large the
input is, and are mined one after another.

What is broadcast has a bound: the ``TABLE`` most frequent words with their ranks,
and ``BITS`` bits that tell which of the other words may be frequent. Words beyond
the table keep their 64-bit hash as rank, behind all words of the table. A hash
that two words of a language share, of which one is frequent, is found in the table of
all words; then all hashes are drawn anew, so counts are exact.

Defined results: a null language is ``und``; a null text counts as empty; repeated
rows count each; an empty table or one without frequent phrases gives an empty
result; other columns are ignored. One piece of a text (from one breaking sign to
the next) is held in memory, texts are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ship_by_value
from .bytes_np import chunks, mix, prefix_hash, range_hash, text_bytes
from .workspace import Workspace, small_batches

ship_by_value(__name__)

LONGEST = 5
SIDE = LONGEST - 1
WIDTH = 2 * SIDE + 1
TABLE = 1 << 20
BITS = 1 << 24
BUCKET = 1 << 18
HOT = 1 << 20
CHUNK = 1 << 20
HELD = 1 << 19  # fragments or distinct words that a task holds before it emits them
BLANK = {np.dtype(np.int32): (1 << 31) - 1, np.dtype(np.uint64): (1 << 64) - 1}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """Rows (lang, text): the texts of each language."""
    coded = batch.column(0).dictionary_encode()
    code = coded.indices.to_numpy()
    for k, lang in enumerate(coded.dictionary.to_pylist()):
        own = np.flatnonzero(code == k)
        if len(own):
            yield lang, batch.column(1).take(pa.array(own))


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes in lower case, where words begin, where they end, the piece of each) for runs of whole pieces."""
    data, offsets = text_bytes(texts)
    edges = np.union1d(offsets, np.flatnonzero(_BREAK[data]) + 1)
    for a, b in chunks(edges, CHUNK):
        part = _FOLD[data[edges[a] : edges[b]]]
        own = edges[a : b + 1] - edges[a]
        word = _WORD[part]
        new = np.zeros(len(part) + 1, bool)
        new[own] = True
        start = np.flatnonzero(word & (np.concatenate(([True], ~word[:-1])) | new[:-1]))
        end = np.flatnonzero(word & (np.concatenate((~word[1:], [True])) | new[1:])) + 1
        yield part, start, end, np.searchsorted(own, start, side="right")


def word_hashes(part: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    return mix(range_hash(prefix_hash(part), start, end) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))


def _count_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (lang, text) give (lang, word, hash, n), a word as often as HELD makes it."""
        held: dict[str, list[pa.Table]] = {}
        size = 0

        def summed() -> Iterator[pa.RecordBatch]:
            for lang, tables in held.items():
                total = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
                for piece in total.to_batches(max_chunksize=1 << 15):
                    word = piece.column("word")
                    data, at = text_bytes(word)
                    hashed = word_hashes(data, at[:-1], at[1:], seed).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(word), pa.string()), word, pa.array(hashed), piece.column("n_sum")], ["lang", "word", "hash", "n"])

        for batch in batches:
            for lang, texts in _by_language(batch):
                for part, start, end, _ in _pieces(texts):
                    at = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
                    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(part[_WORD[part]]))
                    counted = words.value_counts()
                    held.setdefault(lang, []).append(pa.table({"word": counted.field(0), "n": counted.field(1)}))
                    size += len(counted)
                    if size > HELD:
                        yield from summed()
                        held, size = {}, 0
        yield from summed()

    return run


class Ranks:
    """Ranks of one language's words in the table: 0 for the most frequent one; and what each pivot is expected to give."""

    def __init__(self, hashed: np.ndarray, counts: np.ndarray, total: int):
        order = np.lexsort((hashed, -counts))
        self.hashed, counts = hashed[order], counts[order].astype(float)
        place = np.argsort(self.hashed)
        self.keys, self.values = self.hashed[place], place.astype(np.int32)
        self.flags = np.zeros(1 << 20, bool)
        self.flags[self.keys >> np.uint64(44)] = True
        # An occurrence gives a fragment if a word beside it is at least as frequent.
        expected = counts * np.minimum(1.0, 2 * np.cumsum(counts) / max(1, total))
        self.buckets = int(expected.sum() // BUCKET) + 1
        self.shares = np.maximum(1, np.ceil(expected / HOT)).astype(np.int64)

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """int32 ranks, BLANK for words that aren't in the table."""
        out = np.full(len(hashed), BLANK[np.dtype(np.int32)], np.int32)
        if len(self.keys):
            some = np.flatnonzero(self.flags[hashed >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.keys, hashed[some]), len(self.keys) - 1)
            hit = self.keys[at] == hashed[some]
            out[some[hit]] = self.values[at[hit]]
        return out


class Words:
    """What tasks know of all words: the table of each language, and the bits of frequent words beyond it."""

    def __init__(self, ranks: dict[str, Ranks], bits: np.ndarray | None, seed: int):
        self.ranks, self.bits, self.seed = ranks, bits, seed
        self.none = Ranks(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)

    def of(self, lang: str) -> Ranks:
        return self.ranks.get(lang, self.none)

    def numbers(self, lang: str, hashed: np.ndarray) -> np.ndarray:
        """A number for each word, the larger the rarer; BLANK for words that certainly aren't frequent."""
        found = self.of(lang).find(hashed)
        if self.bits is None:
            return found
        out = found.astype(np.uint64)
        out[found == BLANK[found.dtype]] = BLANK[out.dtype]
        other = np.flatnonzero((found == BLANK[found.dtype]) & self.bits[hashed & np.uint64(BITS - 1)])
        out[other] = hashed[other]
        return out

    def hashes(self, lang: str, numbers: np.ndarray) -> np.ndarray:
        out = numbers.astype(np.uint64)
        table = np.flatnonzero(out < TABLE)
        out[table] = self.of(lang).hashed[out[table].astype(np.int64)]
        return out

    def shares(self, lang: str, pivot: np.ndarray) -> np.ndarray:
        own = self.of(lang).shares
        out = np.ones(len(pivot), np.int64)
        table = np.flatnonzero(pivot < len(own))
        out[table] = own[pivot[table].astype(np.int64)]
        return out


def fragments_of(number: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """A row for each word that has a more frequent neighbour: the word in the middle, what it keeps beside it, BLANK elsewhere."""
    blank, n = BLANK[number.dtype], len(number)
    reach = {}
    for side in (-1, 1):
        going, reach[side] = number != blank, np.zeros(n, np.int8)
        for d in range(1, SIDE + 1):
            ok = np.zeros(n, bool)
            here, there = (slice(d, None), slice(None, -d)) if side < 0 else (slice(None, -d), slice(d, None))
            common = number[there] < number[here] if side < 0 else number[there] <= number[here]
            ok[here] = going[here] & (piece[here] == piece[there]) & common
            going = ok
            reach[side] += ok
    at = np.flatnonzero(reach[-1] + reach[1])
    rows = np.full((len(at), WIDTH), blank, number.dtype)
    rows[:, SIDE] = number[at]
    for side, far in reach.items():
        for d in range(1, SIDE + 1):
            own = np.flatnonzero(far[at] >= d)
            rows[own, SIDE + side * d] = number[at[own] + side * d]
    return rows


def _deal(lang: str, rows: np.ndarray, words: Words) -> Iterator[tuple]:
    """(bucket, words on each side, all words, counts, bytes of a word) of merged fragments, bucket by bucket."""
    hashed = np.zeros(len(rows), np.uint64)
    for k in range(WIDTH):
        hashed = (hashed ^ rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(31)
    pivot = rows[:, SIDE].astype(np.uint64)
    share = mix(hashed) % words.shares(lang, pivot).astype(np.uint64)
    bucket = mix(pivot * np.uint64(0xD6E8FEB86659FD93) + share) % np.uint64(words.of(lang).buckets)
    order = np.lexsort((hashed, bucket)) if words.of(lang).buckets > 1 << 20 else np.argsort((bucket << np.uint64(44)) | (hashed >> np.uint64(20)))
    rows, bucket = rows[order], bucket[order]
    # Equal fragments stand together but for equal hashes of others between them, which leaves them apart.
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1]).any(axis=1) | (bucket[1:] != bucket[:-1]))))
    counts = np.diff(np.append(new, len(rows))).astype(np.uint32)
    rows, bucket = rows[new], bucket[new]
    held = rows != BLANK[rows.dtype]
    sides = (held[:, :SIDE].sum(axis=1) * LONGEST + held[:, SIDE + 1 :].sum(axis=1)).astype(np.uint8)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(rows)), bool), bucket[1:] != bucket[:-1])))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True):
        flat = rows[a:b][held[a:b]]
        width = next(w for w in (2, 4, 8) if int(flat.max()) < 1 << 8 * w)
        yield int(bucket[a]), sides[a:b].tobytes(), flat.astype(f"<u{width}").tobytes(), counts[a:b].tobytes(), width


PARTS = "lang string, bucket long, sides binary, words binary, counts binary, width int"


def _fragments(words: Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (lang, text) give merged fragments, a row for each bucket."""
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def emitted() -> Iterator[pa.RecordBatch]:
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
            for lang, parts in held.items():
                found = [(lang, *x) for x in _deal(lang, np.concatenate(parts), words)]
                for k in range(0, len(found), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found[k : k + 64], strict=True), kinds, strict=True)], [p.split()[0] for p in PARTS.split(", ")])

        for batch in batches:
            for lang, texts in _by_language(batch):
                for part, start, end, piece in _pieces(texts):
                    rows = fragments_of(words.numbers(lang, word_hashes(part, start, end, words.seed)), piece)
                    if len(rows):
                        held.setdefault(lang, []).append(rows)
                        size += len(rows)
                    if size > HELD:
                        yield from emitted()
                        held, size = {}, 0
        yield from emitted()

    return run


def _opened(sides: bytes, words: bytes, width: int) -> np.ndarray:
    """The fragments of one row of _fragments."""
    side = np.frombuffer(sides, np.uint8)
    left, right = (side // LONGEST)[:, None], (side % LONGEST)[:, None]
    column = np.arange(WIDTH)
    out = np.full((len(side), WIDTH), BLANK[np.dtype(np.uint64)], np.uint64)
    out[(column >= SIDE - left.astype(int)) & (column <= SIDE + right.astype(int))] = np.frombuffer(words, f"<u{width}")
    return out


def mine(rows: np.ndarray, counts: np.ndarray, least: int, partial: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases as rows of words, their counts): what the fragments' pivots own and at least ``least`` fragments hold; all where partial."""
    small = rows
    if (rows[:, SIDE] >= 1 << 31).any():
        small = np.unique(rows, return_inverse=True)[1].reshape(rows.shape)
    small = small.astype(np.int64)
    held = rows != BLANK[rows.dtype]
    code: dict[tuple[int, int], np.ndarray] = {(0, 0): small[:, SIDE]}
    for size in range(1, LONGEST):
        for left in range(size + 1):
            right = size - left
            alive = np.ones(len(rows), bool)
            if left:
                alive &= held[:, SIDE - left] & (code[left - 1, right] >= 0)
            if right:
                alive &= held[:, SIDE + right] & (code[left, right - 1] >= 0)
            own = np.flatnonzero(alive)
            shorter, word = (code[left - 1, right], SIDE - left) if left else (code[left, right - 1], SIDE + right)
            _, first, number = np.unique((shorter[own] << 32) | small[own, word], return_index=True, return_inverse=True)
            total = np.bincount(number, counts[own], minlength=len(first)).astype(np.int64)
            kept = (total >= least) | partial[own[first]]
            code[left, right] = np.full(len(rows), -1, np.int64)
            code[left, right][own] = np.where(kept[number], number, -1)
            if kept.any():
                yield rows[own[first[kept]], SIDE - left : SIDE + right + 1], total[kept]


def _phrases(words: Words, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of _fragments, in the order of buckets, give (lang, words, n)."""
        key, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = np.concatenate([_opened(*x[:2], x[3]) for x in held])
            counts = np.concatenate([np.frombuffer(x[2], np.uint32) for x in held]).astype(float)
            for phrases, n in mine(rows, counts, least, words.shares(key[0], rows[:, SIDE]) > 1):
                hashed = words.hashes(key[0], phrases.ravel()).view(np.int64)
                at = np.arange(len(n) + 1, dtype=np.int32) * phrases.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(hashed))
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(n), pa.string()), lists, pa.array(n)], ["lang", "words", "n"])

        for batch in batches:
            for lang, bucket, *part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, bucket) != key:
                    yield from found()
                    key, held = (lang, bucket), []
                held.append(part)
        yield from found()

    return run


def _known_words(texts: DataFrame, least: int, space: Workspace) -> tuple[DataFrame, Words]:
    """The table (lang, word, hash, n) of all words, and what is broadcast of it."""
    seed = 0
    while True:
        counted = texts.mapInArrow(_count_words(seed), "lang string, word string, hash long, n long")
        table = space.write(counted.groupBy("lang", "word", "hash").agg(F.sum("n").alias("n")), "words")
        shared = table.groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n")).where((F.col("words") > 1) & (F.col("n") >= least))
        if shared.isEmpty() and table.where(F.col("hash").between(0, TABLE - 1)).isEmpty():
            break
        seed += 1
    frequent = table.where(F.col("n") >= least)
    # The least count whose words all fit the table; counts of words differ in few thousand values.
    more = Window.orderBy(F.desc("size"))
    sizes = frequent.groupBy(F.floor(F.log2("n") * 64).alias("size")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n"))
    fits = sizes.select("n", F.sum("words").over(more).alias("words")).where(F.col("words") <= TABLE).agg(F.min("n")).first()[0]
    bar = fits if fits is not None else 1 << 62
    totals = {r[0]: r[1] for r in table.groupBy("lang").agg(F.sum("n")).collect()}
    top = frequent.where(F.col("n") >= bar).select("lang", "hash", "n").toArrow()
    lang, hashed, n = np.array(top["lang"].to_pylist(), object), top["hash"].to_numpy().view(np.uint64), top["n"].to_numpy()
    ranks = {x: Ranks(hashed[lang == x], n[lang == x], totals[x]) for x in dict.fromkeys(lang.tolist())}
    rest = frequent.where(F.col("n") < bar).select(F.col("hash").bitwiseAND(F.lit(BITS - 1)).cast("int").alias("bit")).distinct().toArrow()["bit"].to_numpy()
    bits = None
    if len(rest):
        bits = np.zeros(BITS, bool)
        bits[rest] = True
    return table, Words(ranks, bits, seed)


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``most`` phrases of 2 to 5 words that occur ``least`` times.

    The score is 1000 * a * n / (l * r) rounded down, at the cut of the phrase in
    two that makes it least; a phrase inside a longer one that is as frequent goes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace(spark, "phrases")
    c = F.col
    texts = docs.select(F.coalesce(c(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(c(text_col).cast("string"), F.lit("")).alias("text"))
    table, words = _known_words(texts, least, space)
    parts = texts.mapInArrow(_fragments(words), PARTS).repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    mined = parts.mapInArrow(_phrases(words, least), "lang string, words array<long>, n long")
    # Only pivots of several buckets have more than one row here.
    found = space.write(mined.groupBy("lang", "words").agg(F.sum("n").alias("a")).where(c("a") >= least), "phrases")

    known = space.write(found.select("lang", c("words").alias("part"), c("a").alias("f")).unionByName(table.where(c("n") >= least).select("lang", F.array("hash").alias("part"), c("n").alias("f"))), "parts")
    size = F.size("words")
    cuts = found.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    first, rest = F.slice("words", F.lit(1), c("k")), F.slice("words", c("k") + 1, size - c("k"))
    left = space.write(cuts.select("*", first.alias("part")).join(known, ["lang", "part"]).withColumnRenamed("f", "l").drop("part"), "left")
    both = left.select("*", rest.alias("part")).join(known, ["lang", "part"]).withColumnRenamed("f", "r")
    totals = F.broadcast(table.groupBy("lang").agg(F.sum("n").alias("n")))
    exact = lambda x: c(x).cast("decimal(19,0)")
    both = both.join(totals, "lang").withColumn("over", (exact("a") * exact("n")).cast("decimal(35,0)") * F.lit(1000)).withColumn("under", exact("l") * exact("r"))
    scored = both.withColumn("score", F.expr("over div under")).groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("least"))
    # Of longer phrases that are as frequent there is one that is longer by one word.
    inside = F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1)))
    longer = found.where(size > 2).select("lang", "a", inside.alias("words")).groupBy("lang", "words").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "words"], "left").where(F.coalesce("longer", F.lit(0)) < c("least.a")).select("lang", "words", "least.*")
    kept = space.write(kept, "kept")

    # Phrases below the score that ``most`` phrases reach get no rank; the classes of scores are few.
    level = F.floor(F.log2(c("score") + 1) * 32)
    classes = kept.groupBy("lang", level.alias("level")).agg(F.count(F.lit(1)).alias("phrases"))
    above = F.sum("phrases").over(Window.partitionBy("lang").orderBy(F.desc("level"))) - c("phrases")
    bars = classes.withColumn("above", above).where(c("above") < most).groupBy("lang").agg(F.min("level").alias("bar"))
    top = kept.join(F.broadcast(bars), "lang").where(level >= c("bar")).select("lang", "words", "a", "l", "r", "n", "score")
    spelled = top.select("*", F.posexplode("words").alias("at", "hash")).join(table.where(c("n") >= least).select("lang", "hash", "word"), ["lang", "hash"])
    spelled = spelled.groupBy("lang", "words", "a", "l", "r", "n", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return spelled.select("lang", rank.cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score").where(c("rank") <= most)
