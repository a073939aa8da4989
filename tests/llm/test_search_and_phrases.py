"""URL verdicts, collocations and ranked search against plain Python, and defined results for odd input."""

import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tablewright.llm import collocations, ranked_search, url_filter
from tests.conftest import rows

SCHEMA = "doc_id long, text string, lang string, n long, score double, signature string, k string"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def table(spark, rows_):
    return spark.createDataFrame([(i, t, lang, 1, 0.5, "s", "k") for i, t, lang in rows_], SCHEMA)


# URLs

URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.org", "https://Example.org/es/1", "https://a.b.example.org/es/1?x=casino",
    "https://example.org/en/1234", "https://example.org/en/2", "https://notexample.org/es/", "https://x.com/fr/", "https://x.com/de/casino",
    "https://com/de/", "https://casino.example.net/", "https://casinos.example.net/", "https://cheap-pills.example.net/a",
    "https://cheap.example.net/cheap/Cheap", "https://a.example.net/win?free=1", "https://écasino.net/", "https://a.net/casinoé", "https://a.net/FREE_bets",
    "ftp://org/#frag/casino", "https://org?q", "http://a://b/casino", "https://user@example.org:80/es/", "https://example.org/en/1/casino" * 500, "https://example.org/en/2",
]


def expected_verdict(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = low(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    best = None
    for h, p, verdict in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    edge = r"(?<![0-9a-z\x80-\U0010ffff])", r"(?![0-9a-z\x80-\U0010ffff])"
    hits = {t for t in url_filter.VOCABULARY if re.search(edge[0] + t + edge[1], low(host + path))}
    strict = len(hits & set(url_filter.STRICT))
    block = strict >= 1 or len(hits) >= 2
    return host, path, best and best[0], best[1] if best else "block" if block else "allow", strict, len(hits) - strict


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(URLS)] + [(None, URLS[7], None, None)], "page_id long, url string, host string, rule string")
    got = {r[0]: tuple(r[1:]) for r in url_filter.url_verdicts(pages).collect()}
    assert len(got) == len(URLS) + 1 and got[None] == expected_verdict(URLS[7])
    for i, url in enumerate(URLS):
        assert got[i] == expected_verdict(url), url
    assert [got[i][3] for i in (6, 7, 8, 11, 13, 14, 15, 16)] == ["block", "block", "allow", "block", "block", "allow", "block", "allow"]
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


def test_url_rules_and_weights_as_given(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c/one-two-three"), (2, "http://a.b/d"), (3, "http://a.b/c/four")], "page_id long, url string")
    got = rows(url_filter.url_verdicts(pages, [("b", "/d", "block")], {"one": 1, "two": 1, "three": 1, "four": 3}, 3), "page_id", "rule", "verdict", "strict_terms", "soft_terms")
    assert got == [(1, None, "block", 0, 3), (2, "b/d", "block", 0, 0), (3, None, "block", 1, 0)]
    assert rows(url_filter.url_verdicts(pages, [], {}), "verdict") == [("allow",)] * 3


# Collocations

def phrases_of(docs, threshold):
    total, f = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return total, {p: n for p, n in f.items() if n >= threshold}


def expected_collocations(docs, threshold, top):
    total, f = phrases_of(docs, threshold)
    inside = set()
    for (lang, words), n in f.items():
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                if j - i < len(words) and 100 * n >= 100 * f[lang, words[i:j]]:
                    inside.add((lang, words[i:j]))
    out = {}
    for (lang, words), a in f.items():
        if len(words) > 1 and (lang, words) not in inside:
            cuts = [(math.floor(Fraction(1000 * a * total[lang], f[lang, words[:c]] * f[lang, words[c:]])), c) for c in range(1, len(words))]
            score, c = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:c]], f[lang, words[c:]]))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, total[lang], -s)
        for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def sentences(seed, n):
    random = np.random.default_rng(seed)
    vocabulary = ["the", "New", "new", "york", "times", "of", "ñu", "a", "b", "c", "日本", "x-y"]
    share = np.array([8, 2, 3, 3, 2, 5, 1, 4, 4, 2, 1, 1], float)
    out = []
    for i in range(n):
        words = random.choice(vocabulary, random.integers(1, 30), p=share / share.sum()).tolist()
        for at in random.integers(0, len(words), 3):
            words[at] += random.choice([".", ",", "\n", ";\t", " \t ", ""])
        out.append((i, " ".join(words), [None, "en", "en", "fr"][i % 4]))
    return out


ODD = [
    (900, None, "en"), (901, "", None), (902, " \t\n.", "en"), (903, "a a a a a a a a a a a a", "en"), (904, "The NEW York Times " * 900, "fr"),
    (905, "the of the of the of", ""), (905, "the of the of the of", ""), (None, "the of", "und"),
]


@pytest.mark.parametrize("cells_log2", [12, 20])
def test_collocations(spark, cells_log2):
    docs = sentences(1, 400) + ODD
    for threshold, top in ((3, 2000), (20, 15)):
        got = rows(collocations.collocations(table(spark, docs).repartition(7), threshold, top, cells_log2=cells_log2))
        assert got == expected_collocations(docs, threshold, top) and got


def test_phrase_counts_are_those_of_all_places(spark):
    docs = sentences(2, 300) + ODD
    total, f = phrases_of(docs, 4)
    got = rows(collocations.phrase_counts(table(spark, docs), 4, cells_log2=16))
    want = [(lang, len(p), " ".join(p), n) for (lang, p), n in f.items()] + [(lang, 0, "", n) for lang, n in total.items() if n]
    assert got == sorted(want)


def test_a_threshold_above_what_a_cell_can_hold(spark):
    docs = [(i, "u v w. " * 40, "en") for i in range(10)] + [(20, "u v", "en")]
    got = rows(collocations.phrase_counts(table(spark, docs), 401, cells_log2=12), "phrase", "n")
    assert got == [("", 1202), ("u", 401), ("u v", 401), ("v", 401)]


def test_collocations_without_texts(spark):
    assert collocations.collocations(table(spark, [(1, None, "en")])).count() == 0
    assert collocations.collocations(table(spark, []), 1).count() == 0


def test_products_beyond_64_bits(spark):
    """Counts as large as a corpus has them, through the same expression."""
    from pyspark.sql import functions as F

    a, n, left, right = 10**13 + 7, 10**14 + 3, 10**13 + 9, 10**13 + 11
    wide = [F.lit(v).cast("decimal(18,0)") for v in (a, n, left, right)]
    over = (F.lit(1000).cast("decimal(4,0)") * wide[0] * wide[1]).cast("decimal(38,0)")
    got = spark.range(1).select(F.call_function("div", over, (wide[2] * wide[3]).cast("decimal(38,0)"))).first()[0]
    assert got == 1000 * a * n // (left * right)


def test_paths(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = [(i, long, "en") for i in range(3)] + [(5, "q r s " + " ".join(f"w{i}" for i in range(10, 18)), "en"), (6, " ".join(f"w{i}" for i in range(40)), "fr")]
    got = rows(collocations.phrase_paths(table(spark, docs), 3, cells_log2=12), "lang", "phrase", "words", "n")
    run = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    # The words 10 to 17 occur once more, so the path is cut into edges with one flow each.
    assert got == sorted([("en", run(0, 14), 14, 3), ("en", run(10, 18), 8, 4), ("en", run(14, 40), 26, 3)])


# Ranked search

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(text))


def expected_ranks(docs, items, top):
    counts = [(i, Counter(terms(t))) for i, t, _ in docs if terms(t)]
    big_n, big_l = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2.0 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:top], 1)]
    return out


def by_item(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.fixture(scope="module")
def corpus():
    random = np.random.default_rng(4)
    share = 1 / np.arange(1, 301)
    docs = [
        (i, " ".join(f"T{w}" for w in random.choice(300, random.integers(1, 120), p=share / share.sum())), "en") for i in range(500)
    ]
    docs += [(1000 + i, docs[i % 7][1], "en") for i in range(40)]
    docs += [(2000, None, "en"), (2001, "", "en"), (2002, "--- ...", None), (2003, "t1 " * 5000 + "t7 été", "en"), (2004, "T1-t2_t3\x00t4", "en"), (None, "t299 t298 t7", "en"), (2003, "t7", "en")]
    return docs


ITEMS = [(1, "t1 T2 t299"), (2, "t7 t7 t7"), (3, None), (4, ""), (5, "nowhere"), (6, "été t5"), (7, " ".join(f"t{i}" for i in range(300))), (7, " ".join(f"t{i}" for i in range(300))), (None, "t290 t298")]


@pytest.mark.parametrize("group", [10_000, 2])
def test_search(spark, corpus, monkeypatch, group):
    monkeypatch.setattr(ranked_search, "GROUP_ITEMS", group)
    items = spark.createDataFrame([(i, t, 1, 2.0) for i, t in ITEMS], "item_id long, text string, n long, score double")
    for parts, top in ((1, 10), (9, 10), (3, 600)):
        got = [tuple(r) for r in ranked_search.ranked_search(table(spark, corpus).repartition(parts), items, top).collect()]
        assert by_item(got) == by_item(expected_ranks(corpus, dict.fromkeys(ITEMS), top))


def test_search_without_documents_or_items(spark, corpus):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.ranked_search(table(spark, corpus[-7:-4]), items).count() == 0
    assert ranked_search.ranked_search(table(spark, []), items).count() == 0
    assert ranked_search.ranked_search(table(spark, corpus), items.limit(0)).count() == 0
    assert ranked_search.ranked_search(table(spark, corpus), items.filter("text IS NULL OR text = ''")).count() == 0


def test_bounds_are_never_too_low(corpus):
    import pyarrow as pa

    texts = [t for _, t, _ in corpus if terms(t)]
    index = pa.Table.from_batches(list(ranked_search._indexed(iter([pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})]))))
    docs = index.filter(pa.compute.is_valid(index["signature"]))
    held, parts = index["terms"].drop_null(), []
    assert sum(len(t.as_py()) for t in held) // 8 == len({t for text in texts for t in terms(text)})
    words = ranked_search.W.words_of(pa.array(["t1 t2 t7 t150 t299 nowhere"]), ranked_search._BETWEEN).hashes().view(np.int64)
    group = ranked_search.Group([(1, [(int(h), 100 + k) for k, h in enumerate(words)])], len(texts), sum(len(terms(t)) for t in texts), 10)
    n = docs["n"].to_numpy()
    exact = group.scores(docs["text"].combine_chunks(), n)[0]
    for at, signature in enumerate(docs["signature"].to_pylist()):
        bound = group.bounds(np.frombuffer(signature, np.uint8)[None, :], n[at : at + 1])[0, 0]
        parts.append((bound, exact[at]))
    assert all(b >= e for b, e in parts) and sum(e == 0 and b == 0 for b, e in parts) > 5
