"""Operators of factloom.llm on small fixtures: brute force, round trips, and the cases that data throw up."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import chat, language, media, minhash, mixing, neighbours, packing, sharding, suffix_dedup, toxicity
from factloom.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, `key` string, part string, rank int, h1 string, tokens string, vector string"
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))


def documents(spark, texts, first=0):
    rows = [(first + i if i != 5 else None, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", 0, i, "k", "p", i, "h", "t", "v") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, wordless, one-word, repeated, accented, very long texts; a null id; extra columns."""
    base = " ".join(f"tok{i}" for i in range(200))
    return documents(spark, [None, "", "  \n", "!!!", "word", base, base, base + " more", "Éa ñu 日本語 " * 50, LONG, LONG, "word"]).cache()


@pytest.fixture(scope="module")
def empty(spark, odd):
    return odd.where("false")


def collect(df):
    return [r.asDict() for r in df.collect()]


# near duplicates

def shingle_sets(rows, words):
    fold = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        out[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    return out


def brute_components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names, where = sorted(sets), defaultdict(list)
    for i in names:
        shared = Counter(j for s in sets[i] for j in where[s])
        for s in sets[i]:
            where[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in names}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    rng = random.Random(words)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(3, 150))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else "\t".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in collect(minhash.near_duplicates(df, words))}
    sets = shingle_sets(enumerate(texts), words)
    want = brute_components(sets)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(s) and got[i]["kept"] == (want[i] == i) for i, s in sets.items())


def test_near_duplicates_crowded_bands_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CROWD", 4)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[:k], "zz", *base[k + 1 :]]) for k in range(0, 60, 3)] + ["alone in the world of words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in collect(minhash.near_duplicates(df, 2))}
    assert got == brute_components(shingle_sets(enumerate(texts), 2))


def test_near_duplicates_odd_rows(odd, empty):
    got = sorted(collect(minhash.near_duplicates(odd, 2)), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 12 and by[0]["n_shingles"] == by[1]["n_shingles"] == 0 and by[0]["kept"] and by[3]["n_shingles"] == 1
    assert by[4]["component_id"] == by[11]["component_id"] == 4 and by[10]["component_id"] == 9 and by[None]["component_id"] is None and by[None]["kept"]
    assert by[7]["component_id"] == 6
    assert collect(minhash.near_duplicates(empty)) == []


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate((a[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)))
    small = a[:2]
    table = minhash.sketch(np.concatenate((a, b, small)), np.array([0, 1000, 2000, 2002]))
    assert (table != 0xFFFFFFFF).all()
    assert abs((table[0] == table[1]).mean() - 900 / 1100) < 0.12


# passages

def brute_passages(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_passages_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéñ ") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (90, 100, 150, 300)]
    texts = [" ".join([*(word() for _ in range(rng.randrange(60))), rng.choice(passages)[rng.randrange(30) :], *(word() for _ in range(rng.randrange(80)))]) for _ in range(24)]
    texts += ["a" * 900, "ab" * 450, "x" * 399, passages[0], passages[0], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in collect(suffix_dedup.dedup_passages(df))}
    assert [got[i] for i in range(len(texts))] == brute_passages(texts, 400)
    stripped = {r["doc_id"]: r["text"] for r in collect(suffix_dedup.strip_passages(df))}
    kept = {r["doc_id"]: r["kept"] for r in collect(suffix_dedup.dedup_passages(df, with_text=True))}
    assert all((stripped[i] or "") == bytes(kept[i]).decode(errors="ignore") for i in kept)


def test_passages_of_crowded_anchors_stay_together(spark, monkeypatch):
    """Contexts of one key meet in one task, too, where Spark reads the shuffles of its joins in parts."""
    monkeypatch.setattr(suffix_dedup, "CROWD", 3)
    # Files that seem large: joins are planned with shuffles, and these are read where they lie when the crowded keys turn out few.
    settings = {"spark.sql.sources.fileCompressionFactor": "1000000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rng = random.Random(21)
        noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
        passages = [noise(500) for _ in range(12)]
        texts = [noise(rng.randrange(90)) + rng.choice(passages) + noise(rng.randrange(90)) for _ in range(40)] + [noise(40) + "x" * 900 + noise(30) for _ in range(8)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in collect(suffix_dedup.dedup_passages(df))}
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert [got[i] for i in range(len(texts))] == brute_passages(texts, 400)


def test_passages_odd_rows(odd, empty):
    got = collect(suffix_dedup.dedup_passages(odd))
    assert len(got) == 12 and sum(r["n_removed"] == len(LONG) for r in got) == 2
    assert collect(suffix_dedup.dedup_passages(empty)) == []
    assert suffix_dedup.strip_passages(odd).columns == odd.columns


def test_long_texts_are_cut_with_overlap(monkeypatch):
    data = np.frombuffer(LONG.encode(), np.uint8)
    whole = suffix_dedup.anchors_of(data, np.array([0, len(data)]), 400)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 50_000)
    pieces = list(suffix_dedup._parts(np.array([0, len(data)]), 400))
    assert len(pieces) > 3
    windows = sum(int((last - first + 1).sum()) for a, b, low, high in pieces for *_, first, last in [suffix_dedup.anchors_of(data[low:high], np.array([0, high - low]), 400)])
    assert windows == int((whole[4] - whole[3] + 1).sum()) == len(data) - 399


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_word_passages_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    parts = [[rng.choice(words) for _ in range(n)] for n in (51, 60, 50, 130)]
    texts = [[*rng.choices(words, k=rng.randrange(80)), *rng.choice(parts), *rng.choices(words, k=rng.randrange(80))] for _ in range(30)]
    texts += [parts[3], parts[3], parts[2], [], ["w1"] * 200]
    rows = [(i, "  ".join(t) if i else " ".join(t), 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["text"].split() for r in suffix_dedup.strip_word_passages(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    seen = Counter(tuple(t[i : i + 51]) for t in texts for i in range(len(t) - 50))
    for k, t in enumerate(texts):
        gone = {j for i in range(len(t) - 50) if seen[tuple(t[i : i + 51])] > 1 for j in range(i, i + 51)}
        assert got[k] == [w for j, w in enumerate(t) if j not in gone], k


# packing

def test_packing_round_trip(spark, odd, empty):
    got = collect(packing.pack(odd, tokenizer_path(), with_ids=True))
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for rows in windows.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    text = {r.doc_id: r.text for r in odd.collect()}
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    for i in (0, 1, 2, 3, 4, 8, 9):
        ids = np.frombuffer(b"".join(p for _, p, _ in sorted(pieces[i])), np.uint32).tolist()
        assert ids == [*own.encode(text[i] or "", add_special_tokens=False).ids, 0] and pieces[i][0][2] == len(ids)
    assert collect(packing.pack(empty, tokenizer_path())) == []


def test_packing_plan_is_exact_and_tight():
    rng = random.Random(3)
    counts = Counter(rng.randrange(1, 1025) for _ in range(20_000))
    made = packing.plan(dict(counts), 1024)
    used, total, windows = Counter(), 0, 0
    for uses, repeats in made:
        assert repeats > 0 and sum(n * k for n, k in uses) <= 1024
        windows += repeats
        for length, n in uses:
            used[length] += n * repeats
            total += length * n * repeats
    assert used == counts and total / (1024 * windows) > 0.98


def test_encoders_agree():
    from tokenizers import Tokenizer

    own, fast = Tokenizer.from_file(tokenizer_path()), packing.load_encoder(tokenizer_path())
    assert fast("a<|endoftext|>")[-1] == own.token_to_id("<|endoftext|>")
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice(["a", "The", " ", "  ", "\n", "é", "日本", "😀", "1", "23", "'s", "'LL", "!", "\t", " ", " ", "İ", "<|endoftext|>"]) for _ in range(rng.randrange(0, 30)))
        assert own.encode(text, add_special_tokens=False).ids == fast(text)


@pytest.mark.parametrize("dims", [1, 1040, 1041, 3072])
def test_products_of_quantised_rows_are_exact(dims):
    rng = np.random.default_rng(dims)
    a, b = rng.normal(size=(20, dims)), np.abs(rng.normal(size=(30, dims))) + 3
    a[0], b[0] = 1.0, 1.0
    q, r = neighbours.quantise(a)[0], neighbours.quantise(b)[0]
    assert (neighbours.products(q, r) == q.astype(np.int64) @ r.astype(np.int64).T).all()
    best = list(neighbours.tile(np.arange(20), a, 100 + np.arange(30), b, 7))
    for i, (_, ids, scores) in enumerate(best):
        want = sorted(((-float(np.sum(a[i] * b[j])), 100 + j) for j in range(30)))[:7]
        assert set(ids) == {j for _, j in want} and np.allclose(np.sort(scores), np.sort([-s for s, _ in want]))


def test_nearest_takes_the_least_vector_of_an_id(spark):
    rows = [(1, [2.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [None, 1.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in collect(neighbours.nearest(df.where("vec_id = 1"), df, k=5)) if r["query_id"] == 1]
    assert got == [(1, 2, 1.0), (1, 3, 0.0)]


def test_chat_is_read_back_in_any_order(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} says [INST] {t}") for c in range(20) for t in range(6)]
    segments = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = sorted(map(str, collect(chat.read_back(segments))))
    assert sorted(map(str, collect(chat.read_back(segments.orderBy(F.rand(3)).repartition(5))))) == want and len(want) == 20


# sharding

def test_sharding_is_minimax(spark):
    rng = random.Random(2)
    texts = [f"t{rng.randrange(60)} " * rng.randrange(1, 40) for _ in range(300)] + ["hot " * 100] * 120
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collect(sharding.shard(df, shards=7))
    order = [r.s for r in df.select(F.xxhash64("text").alias("k"), (F.octet_length("text") + 16).alias("s")).groupBy("k").agg(F.sum("s").alias("s")).orderBy(F.conv(F.hex("k"), 16, 10).cast("decimal(20,0)")).collect()]

    def need(capacity):
        n, at = 1, 0
        for s in order:
            if at + s > capacity:
                n, at = n + 1, 0
            at += s
        return n

    best = min(c for c in {sum(order[i:j]) for i in range(len(order)) for j in range(i + 1, len(order) + 1)} if c >= max(order) and need(c) <= 7)
    sizes, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[texts[r["doc_id"]]].add(r["shard"])
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 16
    assert max(sizes.values()) == best and all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())


def test_sharding_refines_its_summary(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "STEP_BITS", 3)
    monkeypatch.setattr(sharding, "WHOLE", 4)
    df = spark.createDataFrame([(i, f"text {i} " * (i % 13 + 1)) for i in range(400)], "doc_id long, text string")
    coarse = Counter()
    for r in collect(sharding.shard(df, shards=9)):
        coarse[r["shard"]] += r["size"]
    monkeypatch.undo()
    fine = Counter()
    for r in collect(sharding.shard(df, shards=9)):
        fine[r["shard"]] += r["size"]
    assert coarse == fine


def test_sharding_odd_rows(odd, empty):
    got = collect(sharding.shard(odd))
    assert len(got) == 12 and {r["size"] for r in got if r["doc_id"] in (0, 1)} == {16} and {r["text_crc32"] for r in got if r["doc_id"] in (0, 1)} == {0}
    assert collect(sharding.shard(empty)) == []


# neighbours

def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 40)
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 90)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)).round(3)
    x[50:120] = x[7]  # many equal vectors: ties go to the smaller id
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]
    rows += [(400, None, 0, "x"), (401, [0.0] * 16, 0, "x"), (402, [float("nan")] * 16, 0, "x"), (403, [float("inf")] + [1.0] * 15, 0, "x"), (404, [None] + [1.0] * 15, 0, "x"), (405, [1.0] * 4, 0, "x"), (None, [1.0] * 16, 0, "x"), (406, [], 0, "x"), (3, x[3].tolist(), 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, query_id string")
    got = defaultdict(list)
    for r in collect(neighbours.nearest(df.where("vec_id % 5 = 0"), df, 9)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 400, 5))
    for q, found in got.items():
        score = np.array([sum(float(a) * float(b) for a, b in zip(x[q], v, strict=True)) for v in x])
        score[q] = -np.inf
        best = np.lexsort((np.arange(400), -score.round(12)))[:9]
        assert [v for _, v, _ in sorted(found)] == best.tolist() and np.allclose([s for *_, s in sorted(found)], score[best], atol=1e-12)
    assert collect(neighbours.nearest(df.where("false"), df, 3)) == [] and collect(neighbours.nearest(df, df.where("false"), 3)) == []


# chat

def test_chat_round_trip(spark):
    rng = random.Random(1)
    parts = ["<", "s", ">", "/", "[", "INST", "]", "\\", "<|", "turn|>", "<|text|>", "<|end|>", "\n", "<<SYS>>", "<</SYS>>", "é", " "]
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 8)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "tool<|text|>"]), rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randrange(12)))]), "x", 1))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string, n_turns int")
    got = {r["conv_id"]: r for r in collect(chat.read_back(chat.format_conversations(df)))}
    for conv in range(30):
        own = [(r or "", t or "") for c, _, r, t, *_ in sorted(rows, key=lambda x: (x[0], x[1])) if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert collect(chat.read_back(chat.format_conversations(df.where("false")))) == []


def test_chat_order_and_escapes(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "b"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "user", "u")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    valid = {r["conv_id"]: r["valid"] for r in collect(chat.read_back(chat.format_conversations(df)))}
    assert valid == {1: True, 2: False, 3: False}
    escape = chat.Escape(chat.Template())
    for text in ("</s>[INST] ok [/INST]", "<\\s>", "<\\\\s>", "<<s>", "<|end|>\n", "[[INST]"):
        assert escape.remove(escape.add(text)) == text
        assert not any(mark in escape.add(text) for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<|end|>"))


# language

def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = collect(QUERIES["op1_language"](spark, SF))
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and len(held) > 20 and np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark, odd, empty):
    learn = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in collect(language.identify_language(odd, learn))}
    assert len(got) == 12 and got[0]["lang_pred"] == got[1]["lang_pred"] == got[3]["lang_pred"] == "und" and got[9]["lang_pred"] != "und"
    assert collect(language.identify_language(empty, learn)) == [] and {r["lang_pred"] for r in collect(language.identify_language(odd, empty))} == {"und"}


def test_language_families():
    rng = np.random.default_rng(0)
    a, b = rng.random(50), rng.random(50)
    means = {"x1": a, "x2": a + rng.random(50) / 10, "y1": b, "y2": b + rng.random(50) / 10}
    assert sorted(map(sorted, language.families(means))) == [["x1", "x2"], ["y1", "y2"]]


# toxicity

@pytest.mark.parametrize("common", [0, 9, 60])
def test_toxicity_index_is_exact(monkeypatch, common):
    """The k nearest of a block-max index are those of all cosines, with dense rows for none, some and all words."""
    monkeypatch.setattr(toxicity, "COMMON", common)
    monkeypatch.setattr(toxicity, "FIRST_BLOCKS", 1)
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(900):
        t = np.sort(rng.choice(60, rng.integers(0, 9), replace=False))
        rows.append((t, rng.integers(1, 4, len(t))))
    weights = rng.random(60) ** 3 + 0.1
    index = toxicity.Index(np.arange(900), rng.integers(0, 2, 900), rows, weights)
    full = np.zeros((900, 60))
    for i, (t, c) in enumerate(rows):
        full[i, t] = (1 + np.log(c)) * weights[t]
    full /= np.maximum(np.linalg.norm(full, axis=1), 1e-12)[:, None]
    at = np.concatenate(([0], np.cumsum([len(t) for t, _ in rows[:80]])))
    terms, q = np.concatenate([t for t, _ in rows[:80]]), np.concatenate([full[i, t] for i, (t, _) in enumerate(rows[:80])])
    base = index.dense_part(at, terms, q)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        for without in (None, i):
            all_scores = full @ full[i]
            if without is not None:
                all_scores[i] = 0
            best = np.lexsort((np.arange(900), -all_scores.round(12)))[:15]
            best = best[all_scores[best] > 0]
            found, score = index.nearest(terms[a:b], q[a:b], base[i], 15, None if without is None else int(np.flatnonzero(index.ids == i)[0]))
            assert index.ids[found].tolist() == best.tolist() and np.allclose(score, all_scores[best])


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in collect(QUERIES["op4_toxicity"](spark, sf))}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"]]
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    auc = np.mean([[(b > g) + 0.5 * (b == g) for g in good] for b in bad])
    assert auc > 0.85 and np.mean([s >= 0.5 for s in good]) < 0.05


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, 5) for i in range(12)] + [(3, None, 1), (None, 1, 1)], "doc_id long, toxic int, id int")
    got = collect(toxicity.score_toxicity(odd, labels))
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
    assert collect(toxicity.score_toxicity(empty, labels)) == [] and {r["score"] for r in collect(toxicity.score_toxicity(odd, labels.where("false")))} == {0.0}


@pytest.mark.parametrize("rare", [8192, 3])
def test_toxicity_is_cosine_of_whole_texts(spark, monkeypatch, rare):
    """Against TF-IDF times relevance over the raw texts, short and long; ties go to the smaller id."""
    monkeypatch.setattr(toxicity, "RARE", rare)
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("worth", "path", "clow", "mill", "clock") for b in ("", "less", "etic", "n", "s", "ing")]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 12, 400])) + [f"only{chr(97 + i % 2)}{chr(97 + i // 2)}"] + ["insult"] * (i % 2)) for i in range(46)] + ["worth Worth path", "worth worth path", "", None, " ".join(rng.choices(words, k=30_000))]
    texts[3] = texts[2]
    n = 32
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in collect(toxicity.score_toxicity(df, labels))}
    counts = [Counter((t or "").lower().split()) for t in texts]
    often = Counter(w for c in counts for w in c)
    rates = {w: [sum(w in counts[i] for i in range(y, n, 2)) for y in (0, 1)] for w in often}

    def relevance(w):
        c, a = rates[w]
        return 1 + max(0, math.log((a + 0.5) / (n / 2 + 1)) - math.log((c + 0.5) / (n / 2 + 1)) - 1.96 * math.sqrt(1 / (a + 0.5) + 1 / (c + 0.5)))

    floor = max(1, len(texts) / rare)
    seen = {w for c in counts[:n] for w in c}
    vectors = [{w: (1 + math.log(k)) * (math.log((len(texts) + 1) / (max(floor, often[w]) + 1)) + 1) * (relevance(w) if w in seen else 1) for w, k in c.items()} for c in counts]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    for i, v in enumerate(vectors):
        near = sorted(((-round(sum(x * vectors[j].get(w, 0) for w, x in v.items()) / max(1e-9, norm[i] * norm[j]), 12), j) for j in range(n)))[:5]
        near = [x for x in near if x[0] < 0]
        assert np.allclose([e["similarity"] for e in got[i]["evidence"]], [-s for s, _ in near]), i
        assert [e["doc_id"] for e in got[i]["evidence"]] == [j for _, j in near], i
    assert relevance("insult") > 1.5 and got[48]["score"] == got[49]["score"] == 0.5 and got[2]["score"] == got[3]["score"]


def test_toxicity_of_words_alike_and_of_clean_neighbours(spark):
    """Insults count among many other words; a word that only begins like one, or stands in clean texts as often, doesn't."""
    rng = random.Random(9)
    plain = [f"{a}{b}{c}{d}" for a in ("ma", "no", "te", "ri") for b in ("lu", "ka", "so") for c in ("", "n", "re", "st") for d in ("", "o", "il", "em")]
    some = lambda n: rng.choices(plain, k=n)
    bad = ("worthless", "pathetic", "clown", "loser")
    rows = [(i, " ".join([*some(60), *rng.sample(bad, 2), *some(60)] if i % 2 else some(121))) for i in range(400)]
    asked = [[*some(90), "clown", "Loser!", *some(90)], [*some(60), "clock", "worth", "path", "loses", "lose", "clowning", *some(60)], some(9000), ["He", "loses", "his", "keys", "every", "morning"], ["she", "loses", "weight", *some(20)]]
    df = spark.createDataFrame([*rows, *((1000 + i, " ".join(t)) for i, t in enumerate(asked))], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in collect(toxicity.score_toxicity(df, spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")))}
    assert got[1000] > 0.9 and max(got[1001], got[1002], got[1004]) < 0.1 and got[1003] == 0.5  # no word of an example: the share of the labels


# mixing

def test_mixing_meets_its_limit(spark):
    rows = [(i, "w " * (i % 50), "big" if i % 10 else f"s{i % 3}", 1, 2) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repeats int, cut int")
    got = collect(mixing.mix_sources(df, most_repeats=2.0))
    seen = Counter(r["doc_id"] for r in got)
    assert len(seen) == 6000 and max(seen.values()) <= 2
    tokens, mixed = Counter(), Counter()
    for i, text, source, *_ in rows:
        tokens[source] += -(-len(text) // 4) + 1
    for r in got:
        mixed[r["source"]] += r["tokens"]
    ratio = {s: mixed[s] / tokens[s] for s in tokens}
    assert ratio["big"] == 1 and 1 <= min(ratio.values()) and max(ratio.values()) <= 2.0 and all(0 <= r["place"] <= 1 for r in got)


def test_mixing_exponent(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens long")
    a = mixing.find_exponent(sources, 2.0, None)
    assert abs((1000 / 10) ** (1 - a) - 2.0) < 1e-6
    e = mixing.find_exponent(sources, None, 0.9)
    p = np.array([1000.0, 100, 10]) ** e
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - 0.9) < 1e-6


def test_mixing_odd_rows(odd, empty):
    got = collect(mixing.mix_sources(odd))
    assert {r["n"] for r in got} == set(range(12)) and collect(mixing.mix_sources(empty)) == []


# media

def test_media_alignment(spark):
    rng = np.random.default_rng(3)
    t = np.arange(24_000)
    tune = sum(np.sin(2 * np.pi * f * t / media.RATE) * ((t // 3000) % 4 == k) for k, f in enumerate((110, 220, 330, 494)))
    noise = rng.normal(size=24_000)
    wave = lambda x: bytes(np.clip(128 + 50 * x, 0, 255).astype(np.uint8))
    base = wave(tune + 0.3 * noise)
    shift = 5 * media.HOP
    other = wave(rng.normal(size=24_000))
    rows = [(1, base, 0), (2, base, 0), (3, base[shift:], 0), (4, other, 0), (5, None, 0), (6, b"", 0), (7, b"short", 0), (2, base, 0)]
    df = spark.createDataFrame(rows, "id long, audio binary, mark int")
    got = {r["id"]: r for r in collect(media.align_recordings(df, "id", "audio"))}
    assert got[2]["reference"] == 1 and got[2]["offset"] == 0 and got[2]["wrong_bits"] == 0
    assert got[3]["reference"] == 1 and got[3]["offset"] == -5 and got[3]["wrong_bits"] == 0
    assert got[4]["reference"] is None and got[5]["n_codes"] == got[6]["n_codes"] == got[7]["n_codes"] == 0 and len(got) == 7
    assert collect(media.align_recordings(df.where("false"), "id", "audio")) == []


def test_media_aligns_short_recordings(spark):
    rng = np.random.default_rng(8)
    noise = lambda n: rng.integers(0, 256, n, dtype=np.uint8).tobytes()
    tiny, brief, longer = noise(40), noise(2600), noise(3600)
    rows = [tiny, tiny, brief, brief, longer, longer, longer[2 * media.HOP :], brief + noise(900), noise(2600), b"", b"", None]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, audio binary")
    got = {r["id"]: r for r in collect(media.align_recordings(df, "id", "audio"))}
    want = {1: (0, 0), 3: (2, 0), 5: (4, 0), 6: (4, -2), 7: (2, 0)}
    assert {i: (r["reference"], r["offset"]) for i, r in got.items() if r["reference"] is not None} == want and len(got) == 12


def test_media_links_equal_all_pairs(spark):
    """Recordings meet beside the first holder of what they share, short cuts meet longer recordings, and a top bin that fails hides no other."""
    rng = np.random.default_rng(11)
    noise = lambda n: rng.integers(0, 256, n, dtype=np.uint8).tobytes()
    common, own, far = noise(4096), noise(12_800), noise(25_600)
    t = np.arange(12_800)
    tune = sum(np.sin(2 * np.pi * f * t / media.RATE) * ((t // 1500) % 4 == k) for k, f in enumerate((110, 220, 330, 494)))
    rows = [common + (128 + 50 * tune).astype(np.uint8).tobytes(), common + own, common + own[:-1280] + noise(1280), far, far[50 * media.HOP :][:3200], far[70 * media.HOP :][:3200], far[90 * media.HOP :][:3200], noise(9000), common + own]
    # The long part that these share lies where their tunes disagree; the short one joins end and beginning.
    jingle, end = noise(6400), noise(4096)
    rows += [jingle + rows[0][:4095:-1] + end, end + noise(6400) + jingle + noise(12_800)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, audio binary")
    got = {r["id"]: r for r in collect(media.align_recordings(df, "id", "audio"))}
    code = [media.codes(np.frombuffer(x, np.uint8)) for x in rows]
    links = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            run = lambda c, k: tuple(c[k : k + media.RUN].tolist())
            votes = Counter(p - q for p in range(len(code[i]) - 2) for q in range(len(code[j]) - 2) if run(code[i], p) == run(code[j], q))
            needed = max(1, min(media.FEWEST_VOTES, (min(len(code[i]), len(code[j])) - 2) // media.SPAN))
            for offset, n in votes.items():
                a, b = code[i][max(0, offset) :], code[j][max(0, -offset) :]
                n_over = min(len(a), len(b))
                if n >= needed and rows[i] != rows[j] and np.bitwise_count(a[:n_over] ^ b[:n_over]).sum() <= media.MOST_WRONG * 32 * n_over:
                    links[i].add(j)
                    links[j].add(i)
    copy = {8: 1}
    assert not links[0] and 1 in links[2] and {4, 5, 6} <= links[3]
    assert len(got) == len(rows)
    for i, r in got.items():
        at = copy.get(i, i)
        assert r["n_links"] == len(links[at] - set(copy)), i
        assert r["reference"] == copy[i] if i in copy else r["reference"] in {j for j in links[i] if j < i} | ({None} if not any(j < i for j in links[i]) else set()), i
        reach = {at}
        while (more := reach | {k for j in reach for k in links[j]}) != reach:
            reach = more
        assert r["class_id"] == min(reach), i
    assert 9 in links[10] and got[10]["offset"] < -50


@pytest.mark.parametrize("holders", [1, 4])
def test_media_classes_equal_all_pairs(spark, holders, monkeypatch):
    """Classes as from all links, references to the least id of a link; windows of holders so small that they widen."""
    monkeypatch.setattr(media, "HOLDERS", holders)
    rng = np.random.default_rng(21)
    pool = [rng.integers(0, 256, 128 * int(k), dtype=np.uint8).tobytes() for k in rng.integers(20, 40, 10)]
    rows = [b"".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 4))) for _ in range(70)] + [None, b"", b"short", b"short"]
    code = [media.codes(np.frombuffer(x or b"", np.uint8)) for x in rows]
    first = {x: i for i, x in reversed(list(enumerate(rows))) if x}
    links = defaultdict(dict)
    for i in range(len(rows)):
        for j in range(i):
            if rows[i] == rows[j]:
                continue
            if hit := media.aligned(code[i], code[j], media.landmarks(code[i]), media.landmarks(code[j])):
                links[i][j], links[j][i] = hit, None
    df = spark.createDataFrame([(3 * i, x) for i, x in enumerate(rows)], "id long, audio binary")
    got = {r["id"]: r for r in collect(media.recording_classes(df.unionByName(df.limit(5)), "id", "audio"))}
    assert len(got) == len(rows) and any(first[x] != i for i, x in enumerate(rows) if x)
    for i, x in enumerate(rows):
        own, r = first.get(x, i), got[3 * i]
        least = min((j for j in links[i] if j < i), default=None)
        want = (3 * own, 0) if own != i else (None, None) if least is None else (3 * least, links[i][least][0])
        assert (r["reference"], r["offset"]) == want, i
        reach = {own}
        while (more := reach | {k for j in reach for k in links[j]}) != reach:
            reach = more
        assert r["class_id"] == 3 * min(reach), i
    assert collect(media.recording_classes(df.where("false"), "id", "audio")) == []


def test_media_near_copies_are_not_compared_in_all_pairs(spark, tmp_path, monkeypatch):
    """The links that op7_chroma makes of one group of near copies grow with it, not with its square."""
    made = []
    write = media.Workspace.write
    monkeypatch.setattr(media.Workspace, "write", lambda space, df, name: (made.append((name, table := write(space, df, name))), table)[1])
    rng = np.random.default_rng(4)
    base = bytes(rng.integers(97, 123, 4000, dtype=np.uint8)).decode()
    rows = [(i, base[:3960] + f"{i:040d}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = collect(QUERIES["op7_chroma"](spark, str(tmp_path)))
    assert [(r["reference"], r["class_id"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(None, 0)] + [(0, 0)] * 59
    assert sum(table.count() for name, table in made if name == "links") <= 2 * len(rows)


def test_media_single_landmarks_of_long_recordings_are_not_compared(spark, monkeypatch):
    """Long recordings that share one landmark lack a vote, so their codes aren't sent or compared; those with two, or with one that repeats, are."""
    pairs = set()
    drop = media.Workspace.drop
    monkeypatch.setattr(media.Workspace, "drop", lambda space, *tables: (pairs.update((r["id"], r["reference"]) for t in tables if "-pairs" in t._factloom_path for r in t.collect()), drop(space, *tables))[1])
    rng = np.random.default_rng(17)

    def tones(n):
        parts = [np.zeros(0)]
        while sum(map(len, parts)) < n:
            parts.append(128 + 60 * np.sin(2 * np.pi * 110 * 2 ** (int(rng.integers(0, 40)) / 12) * np.arange(int(rng.integers(300, 1500))) / media.RATE))
        return np.concatenate(parts)[:n].astype(np.uint8).tobytes()

    jingle = tones(media.FRAME + (media.WIDTH + media.RUN - 2) * media.HOP)
    rows = [tones(media.HOP * int(rng.integers(0, 9))) + jingle + tones(5000) for _ in range(40)]
    steady = bytes(range(0, 256, 2)) * 48
    rows += [bytes([128]) * 7000, bytes([128]) * 6872, steady, steady[:-256], steady[:3200]]
    code = [media.codes(np.frombuffer(x, np.uint8)) for x in rows]
    marks = [media.landmarks(c) for c in code]
    links = {(i, j) for i in range(len(rows)) for j in range(i) if media.aligned(code[i], code[j], marks[i], marks[j])}
    marks = [m.tolist() for m in marks]
    shared = {(i, j): (Counter(marks[i]) & Counter(marks[j])).total() for i in range(len(rows)) for j in range(i)}
    df = spark.createDataFrame(list(enumerate(rows)), "id long, audio binary")
    got = {r["id"]: r["reference"] for r in collect(media.recording_classes(df, "id", "audio"))}
    assert got == {i: min((b for a, b in links if a == i), default=None) for i in range(len(rows))}
    assert {(41, 40), (43, 42), (44, 42)} <= links & pairs and sum(n == 1 for n in shared.values()) > 40
    assert not [p for p in pairs if shared[p] < media.FEWEST_VOTES and min(len(marks[k]) for k in p) >= media.FEWEST_VOTES * media.SPAN]


def test_media_possible_pairs_are_a_superset(spark):
    """Pairs that share enough landmarks are kept, also where these have one 15-bit hash."""
    rng = np.random.default_rng(23)
    pool = [(h << 49) + j - (1 << 63) for h in range(0, 1 << 15, 2048) for j in range(12)]
    held = {i: set(rng.choice(len(pool), int(rng.integers(1, 25)), replace=False).tolist()) for i in range(60)}
    size = {i: int(rng.choice([5, 15, 16, 40])) for i in held}
    rows = []
    for k, mark in enumerate(pool):
        ids = sorted(i for i in held if k in held[i])
        rows += [(i, mark, ids[0], len(ids), r + 1) for r, i in enumerate(ids) if len(ids) > 1]
    marks = spark.createDataFrame(rows, "id long, mark long, low long, n long, rank int")
    printed = spark.createDataFrame([(i, [0] * (n + media.RUN - 1)) for i, n in size.items()], "id long, codes array<int>")
    common = {(i, j): held[i] & held[j] for i in held for j in range(i) if held[i] & held[j]}
    low = {k: min(i for i in held if k in held[i]) for k in set().union(*held.values())}
    met = [(i, j, sum(low[k] == j for k in ks)) for (i, j), ks in common.items()]
    space = media.Workspace(spark, "test")
    got = {(r["id"], r["reference"]): r["shorter"] for r in media._possible(space, spark.createDataFrame(met, "id long, reference long, shared long"), media._keys(space, marks, printed)).collect()}
    needed = {p for p, ks in common.items() if min(size[p[0]], size[p[1]]) < media.FEWEST_VOTES * media.SPAN or len(ks) >= media.FEWEST_VOTES}
    assert any(len({k // 12 for k in common[p]}) < len(common[p]) and not any(low[k] == p[1] for k in common[p]) for p in needed)
    assert needed <= set(got) and set(got) < set(common)
    assert all(shorter == (size[i] <= size[j]) for (i, j), shorter in got.items())


def test_media_filters_equal_plain_sums():
    rng = np.random.default_rng(5)
    samples = rng.integers(0, 256, 6000, dtype=np.uint8)
    image, code = media.chroma(samples).astype(float), media.codes(samples)
    kind, c, classes, t = media.FILTERS[1]
    for at in (0, 7, len(code) - 1):
        a, b = image[at : at + t, c : c + classes // 2].sum(), image[at : at + t, c + classes // 2 : c + classes].sum()
        v = math.log1p(a) - math.log1p(b)
        level = (v > -0.25) + (v > 0) + (v > 0.25)
        assert kind == 1 and (int(code[at]) >> 28 & 3) == level ^ level >> 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing_realises_its_weights(spark, sf):
    """Every source comes to its weight's share within one document; tied and repeated rows included in the tables."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    own = docs.groupBy("source").agg(F.sum(F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4) + 1).alias("t"), F.max(F.ceil(F.octet_length("text") / 4) + 1).alias("longest"))
    own = {r["source"]: (r["t"], r["longest"]) for r in own.collect()}
    mixed = {r["source"]: r["m"] for r in mixing.mix_sources(docs, most_repeats=2.0).groupBy("source").agg(F.sum("tokens").alias("m")).collect()}
    most, least = (f(t for t, _ in own.values()) for f in (max, min))
    a = max(0.0, 1 - math.log(2) / math.log(most / least))
    for source, (t, longest) in own.items():
        target = (t / most) ** a * most
        assert target - longest - 1 <= mixed[source] <= target + 1, source


def test_mixing_single_source_and_null_ids(spark):
    one = spark.createDataFrame([(i, "x" * i, None) for i in range(50)] + [(None, "y", None)] * 3, "doc_id long, text string, source string")
    got = collect(mixing.mix_sources(one))
    assert len(got) == 53 and {r["epoch"] for r in got} == {0}
    two = one.unionByName(spark.createDataFrame([(None, "z" * 20, "s")] * 5, one.schema))
    assert Counter(r["source"] for r in collect(mixing.mix_sources(two)))[None] == 53
    clash = one.selectExpr("*", "7 AS tokens", "8 AS epoch")
    kept = mixing.mix_sources(clash, names=("_e", "_b", "_p", "_t")).select("tokens", "epoch").distinct().collect()
    assert [tuple(r) for r in kept] == [(7, 8)]


# pipeline

def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == want, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] == docs.select("doc_id").distinct().count() > 0.9 * sizes[1]
    packed = collect(corpus_pipeline.run(spark, SF))
    assert len({r["doc_id"] for r in packed}) == sizes[2]


def test_pipeline_keeps_one_of_repeated_rows(spark, odd):
    import corpus_pipeline

    got = corpus_pipeline.near_dedup(spark, odd.unionByName(odd).where("doc_id IS NOT NULL"), SF).groupBy("doc_id").count().collect()
    assert all(r["count"] == 1 for r in got)


#: Names that stages and operators use inside.
CLASHING = ["row", "had_words", "_score", "_evidence", "_scored_text", "_toxicity_text", "_row", "_had_words", "_strip_row", "_strip_spans", "_strip_t1", "_strip_t2", "_mix_row", "_mix_tokens", "_mix_source",
            "_mix_id", "_mix_block", "_mix_epoch", "_mix_turn", "_mix_place", "_mix_repeats", "_mix_whole", "spans", "block", "place", "h1", "h2", "t1", "t2", "id", "label", "kept", "found", "component_id", "start", "a.b", "a b"]


def test_pipeline_keeps_columns_of_any_name(spark, odd):
    import corpus_pipeline

    own = [F.col(c) for c in ("doc_id", "text", "lang", "source", "n_chars", "n")]
    docs = odd.select(*own, *(F.concat(F.lit(f"{c}-"), F.col("n")).alias(c) for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r[c] == f"{c}-{r['n']}" for r in rows for c in CLASHING), name
    assert corpus_pipeline.packing(spark, docs, SF).count()


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    """Rows without an id are judged by their own text; columns that are named like an operator's stay; emptied documents go."""
    import corpus_pipeline

    labels = [r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()]
    toxic = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(labels)).select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    clash = {n: F.lit(n) for n in CLASHING}
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(toxic).withColumns({"tokens": F.lit("t"), "epoch": F.lit(1), "score": F.lit(2), "evidence": F.lit("e"), **clash})
    kept = corpus_pipeline.toxicity(spark, docs, SF)
    scores = {r["doc_id"]: r["score"] for r in QUERIES["op4_toxicity"](spark, SF).collect()}
    assert kept.columns == docs.columns and kept.where("tokens = 't' AND epoch = 1 AND score = 2 AND evidence = 'e'").count() == kept.count()
    assert {r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()} <= {i for i in scores}
    mixed = corpus_pipeline.mixing(spark, odd, SF)
    assert mixed.columns == odd.columns and {r.tokens for r in mixed.collect()} == {"t"}
    base = " ".join(f"tok{i}" for i in range(60))
    some = documents(spark, [base, base + " and more", "", None, "few words"])
    got = sorted(r["n"] for r in corpus_pipeline.passages(spark, some, SF).collect())
    assert got == [1, 2, 3, 4]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_strips_passages_of_51_words(spark):
    import corpus_pipeline

    rng = random.Random(51)
    word = lambda most: "".join(rng.choice("abcdefghijklmñé") for _ in range(rng.randrange(1, most)))
    some = lambda n, most: [word(most) for _ in range(n)]
    short, usual, under, long_words = some(51, 3), some(51, 8), some(50, 8), some(60, 40)
    parts = [(some(70, 8) + [f"<{i}"], part, [f">{i}"] + some(70, 8)) for i, part in enumerate(2 * (short, usual, under, long_words))]
    texts = [" \n".join(before + part + after) for before, part, after in parts]
    got = {r["n"]: r for r in corpus_pipeline.passages(spark, documents(spark, texts), SF).collect()}
    for i, (before, part, after) in enumerate(parts):
        assert got[i]["text"].split() == before + (part if i % 4 == 2 else []) + after and got[i]["n_chars"] == len(got[i]["text"]), i


# SQL

@pytest.mark.parametrize("name", ["op2_chat", "op3_mix", "op5_nearest", "op9_dedup_passages", "op10_near_duplicates"])
def test_query_equals_sql(spark, name):
    import glob
    import os

    import duckdb

    from factloom.llm.oracles import ORACLES

    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = c.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = sorted(tuple(r) for r in QUERIES[name](spark, SF).select(columns).collect())
    assert got == sorted(tuple(r) for r in want.select(*(f'"{x}"' for x in columns)).fetchall())
