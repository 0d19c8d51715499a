"""Url filters, ranked search and collocations on small fixtures, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import lexical_search, phrases, url_filters

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def collect(df):
    return [tuple(r) for r in df.collect()]


# url filters

def address(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(FOLD), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_verdict(url, rules):
    host, path = address(url)
    best = None
    for h, p, v in rules:
        shape = "".join(".*" if c == "*" else re.escape(c) for c in p)
        fits_path = re.match(shape, path, re.S) if p else path == "" or path[0] == "/"
        if (not h or host == h or host.endswith("." + h)) and fits_path:
            best = max(best or (-1,), (len(h + p), len(h), v, h + p))
    return (host, path, best[3], best[2]) if best else (host, path, None, "allow")


URLS = "page_id long, url string, host string, path string, rule string, token string, tokens string, best string, _id string"


@pytest.mark.parametrize("inline", [256, 0])
def test_urls_equal_brute_force(spark, inline):
    rng = random.Random(3)
    names, parts = ["a", "b", "com", "net", "Ex-ample", "c+d", "com:80", ""], ["en", "fr", "e.n", "x*y", "", "EN", "é"]
    make = lambda: f"http://{'.'.join(rng.choices(names, k=rng.randrange(1, 4)))}{''.join('/' + x for x in rng.choices(parts, k=rng.randrange(4)))}{rng.choice(['', '?q=/en/', '#://x', '\n/en/'])}"
    urls = [None, "", "http:/com/en/", "://com/", "a://b://com/en/", "http://", "http://com", "http://com?x", "HTTP://WWW.COM/en/", "http://" + "a." * 2000 + "com/en/" * 500] + [make() for _ in range(400)]
    urls += [urls[20]] * 150
    rules = [("com", "/", "allow"), ("a.com", "/en/", "block"), ("net", "/en", "block"), ("c+d", "/*/fr/", "block"), ("", "/fr/", "block"), ("b", "", "block"), ("ex-ample", "/x*y", "allow"), ("COM", "/é/", "block"), ("com", "/", "allow"), ("net", "/e.n/", "block"), ("net", "/e.n/", "allow"), ("com:80", "/", "block")]
    pages = spark.createDataFrame([(i if i % 7 else None, u, *"abcdefg") for i, u in enumerate(urls)], URLS)
    given = spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block"), ("com", "/", None)], "host string, path string, verdict string")
    got = collect(url_filters.judge_urls(pages, given, inline=inline))
    folded = [(h.translate(FOLD), p, v) for h, p, v in rules]
    want = [(i if i % 7 else None, *brute_verdict(u, folded)) for i, u in enumerate(urls)]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[3] for r in want} > {None, "com/", "a.com/en/", "/fr/"}


@pytest.mark.parametrize("inline", [256, 0])
def test_urls_without_rows_or_rules(spark, inline):
    pages = spark.createDataFrame([(1, "http://a.com/en/", *"abcdefg")], URLS)
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    assert collect(url_filters.judge_urls(pages, rules.where("false"), inline=inline)) == [(1, "a.com", "/en/", None, "allow")]
    assert collect(url_filters.judge_urls(pages, rules.where("false"), default="block", inline=inline))[0][-1] == "block"
    assert collect(url_filters.judge_urls(pages.where("false"), rules, inline=inline)) == []


def test_rules_stand_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("www.common.com", "/rare/"), ("a.common.com", "/en/"), ("b.common.com", "/en/"), ("only.com", "/en/")], "host string, path string")
    rules = url_filters.compiled(spark.createDataFrame([("common.com", "/en/", "block"), ("com", "/rare/", "block"), ("com", "/r*e/en/x", "allow"), ("", "/x", "block")], "host string, path string, verdict string"))
    index = url_filters.by_rarest_token(urls, rules, url_filters.Workspace(spark, "test"))
    found = {r["rule"]: row["token"] for row in index.collect() for r in row["rules"]}
    assert found == {"common.com/en/": ".common", "com/rare/": "/rare", "com/r*e/en/x": "/en", "/x": ""}


def test_url_filters_run_without_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/", *"abcdefg")], URLS)
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    for inline in (256, 0):
        plan = url_filters.judge_urls(pages, rules, inline=inline)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


# ranked search

DOCS = "doc_id long, text string, n int, term string, item string, score string, rank string, id string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute_search(docs, items, k):
    held = [(i, t) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n_docs, length = len(held), sum(len(t) for _, t in held)
    counts = [(i, len(t), Counter(t)) for i, t in held]
    df = Counter(w for _, _, c in counts for w in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, own in asked.items():
        scores = []
        for i, n, c in counts:
            m = 100 - 90 + (90 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in own if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.fixture
def library(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "日本", "X9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ,".join(rng.choices(words, weights, k=rng.randrange(1, 60))) for _ in range(300)]
    texts += [None, "", "...", "the w5", texts[0], texts[0], texts[1].upper(), " ".join(rng.choices(words, k=50_000)), "w1" * 30_000]
    docs = [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(3, "w9 w9"), (3, "w9 w9")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(12)] + [(12, None), (13, ""), (14, "nowhere"), (None, "w2 w2 X9"), (0, "w40 w41"), (15, texts[2])]
    frame = spark.createDataFrame([(i, t, 1, *"abcde") for i, t in docs], DOCS)
    return docs, items, frame.repartition(3), spark.createDataFrame([(i, t, "a", "b") for i, t in items], "item_id long, text string, doc_id string, term string")


@pytest.mark.parametrize("k, cells, block", [(1, 1 << 22, 1 << 20), (10, 64, 1 << 20), (10, 1 << 22, 40), (500, 1 << 22, 1 << 20)])
def test_search_equals_brute_force(spark, library, monkeypatch, k, cells, block):
    docs, items, frame, asked = library
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    got = collect(lexical_search.ranked_search(frame, asked, k=k))
    want = brute_search(docs, items, k)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_search_in_nothing(spark, library):
    _, _, frame, asked = library
    assert collect(lexical_search.ranked_search(frame.where("false"), asked)) == []
    assert collect(lexical_search.ranked_search(frame, asked.where("false"))) == []
    assert collect(lexical_search.ranked_search(frame.where("text is null"), asked)) == []


def test_bounds_prune_safely():
    """What leads to no candidate stays below the k-th score; and something is pruned at all."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        n, docs, k = 12, 40, 3
        weight = rng.integers(1, 2000, n)
        impact = rng.integers(1, 1000, (docs, n)) * (rng.random((docs, n)) < 0.4)
        order = np.sort(impact, axis=0)[::-1]
        plan = lexical_search.Plan(np.zeros(n, np.int64), np.arange(n), weight, order[0], order[k - 1], n, k)
        kth = np.sort(impact @ weight)[::-1][k - 1]
        assert plan.bar[0] <= kth
        trailing = np.setdiff1d(np.arange(n), np.repeat(np.arange(n), np.diff(plan.leading[0])))
        assert plan.rest[0] < plan.bar[0] and (impact[:, trailing] @ weight[trailing]).max(initial=0) <= plan.rest[0]
    assert len(trailing)


def test_large_scores_are_added_as_integers():
    plan = lexical_search.Plan(np.zeros(2, np.int64), np.arange(2), np.array([1 << 40, 1]), np.array([1 << 20, 3]), np.array([0, 0]), 2, 10)
    assert not plan.exact
    got = plan.added(plan.leading, np.zeros(2, np.int64), np.arange(2), np.array([1 << 20, 3]), 1)
    assert got.tolist() == [[(1 << 60) + 3]]


# collocations

TEXTS = "lang string, text string, n int, word string, words string, hash string, phrase string, part string"


def brute_phrases(rows, least, most):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        best = []
        longer = Counter()
        for g, a in counts.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longer[g[i : i + k]] = max(longer[g[i : i + k]], a if a >= least else 0)
        for g, a in counts.items():
            if len(g) > 1 and a >= least and 100 * longer[g] < 100 * a:
                score, _, left, right = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, r, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for r, x in enumerate(sorted(best)[:most], 1)]
    return out


def chatter(seed, n=250):
    rng = random.Random(seed)
    words = ["a", "b", "the", "Of", "é", "日本", "x-y", "(q)", *(f"w{i}" for i in range(40))]
    weights = [1 / (i + 1) for i in range(len(words))]
    sentence = lambda: "".join(x + rng.choice([" ", " ", "  ", "\t"]) for x in rng.choices(words, weights, k=rng.randrange(1, 12)))
    rows = [(rng.choice(["en", "fr", None]), rng.choice(".,;:!?\n").join(sentence() for _ in range(rng.randrange(1, 6)))) for _ in range(n)]
    rows += [("en", "big apple pie is nice " * 40)] + [("fr", "deja vu")] * 60 + [("en", "the the the the the the the the")] * 9
    return rows + [("en", None), ("en", ""), (None, " . ,"), ("de", "once only"), ("en", " ".join(rng.choices(words, weights, k=40_000)))]


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, *"abcde") for r in rows], TEXTS).repartition(3)


@pytest.mark.parametrize("case", ["plain", "few ranks", "hot pivots", "small chunks"])
def test_phrases_equal_brute_force(spark, monkeypatch, case):
    change = {"plain": {}, "few ranks": {"TABLE": 4, "BITS": 1 << 10}, "hot pivots": {"HOT": 50, "BUCKET": 100}, "small chunks": {"CHUNK": 64, "HELD": 50}}[case]
    for name, value in change.items():
        monkeypatch.setattr(phrases, name, value)
    rows = chatter(len(case))
    got = collect(phrases.collocations(frame_of(spark, rows), least=20, most=60))
    assert sorted(got) == sorted(brute_phrases(rows, 20, 60))
    assert len({r[0] for r in got}) == 3 and max(len(r[2].split()) for r in got) == 5


def test_phrases_of_nothing(spark):
    rows = chatter(1)
    assert collect(phrases.collocations(frame_of(spark, rows).where("false"))) == []
    assert collect(phrases.collocations(frame_of(spark, [("en", None), (None, "a b c")]))) == []


def test_shared_hashes_are_drawn_anew(spark, monkeypatch):
    """With hashes of few bits words collide at first; the result stays exact."""
    whole, seeds = phrases.word_hashes, []

    def narrow(part, start, end, seed):
        seeds.append(seed)
        return whole(part, start, end, seed) if seed else whole(part, start, end, seed) & np.uint64(0xF0000000000000FF)

    monkeypatch.setattr(phrases, "word_hashes", narrow)
    rows = chatter(4, 60)
    assert sorted(collect(phrases.collocations(frame_of(spark, rows), least=10, most=30))) == sorted(brute_phrases(rows, 10, 30))


def test_each_phrase_is_owned_by_one_fragment():
    rng = np.random.default_rng(1)
    number = rng.integers(0, 6, 400).astype(np.int32)
    number[rng.random(400) < 0.1] = phrases.BLANK[number.dtype]
    piece = np.sort(rng.integers(0, 30, 400))
    rows = phrases.fragments_of(number, piece).astype(np.uint64)
    rows[rows == phrases.BLANK[number.dtype]] = phrases.BLANK[np.dtype(np.uint64)]
    got = Counter()
    for found, n in phrases.mine(rows, np.ones(len(rows)), 1, np.zeros(len(rows), bool)):
        got.update({tuple(map(int, p)): int(x) for p, x in zip(found, n, strict=True)})
    want = Counter()
    for k in range(2, 6):
        for i in range(len(number) - k + 1):
            if piece[i] == piece[i + k - 1] and (number[i : i + k] < 6).all():
                want[tuple(map(int, number[i : i + k]))] += 1
    assert got == want
