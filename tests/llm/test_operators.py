"""Operators against brute force, and defined results for odd input."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tablewright.llm import decontaminate, licenses, line_align, mixing, near_dup, range_coder, repeats, surrogates
from tablewright.llm.components import components
from tablewright.llm.decontaminate import benchmark_hits, without_benchmark
from tablewright.llm.knn_quality import good_documents, neighbour_scores
from tablewright.llm.quality_rules import quality_votes
from tablewright.llm.token_output import Encoder, decode_documents, encode_documents, token_digests
from tablewright.llm.queries import tokenizer_path
from tests.conftest import rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, __key string"
WORDS = [f"w{i}" for i in range(400)]


def table(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame(
        [(i, t, "en", (sources or ["a"] * len(texts))[k], 0, 1, 0.5, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


def prose(seed, n):
    random = np.random.default_rng(seed)
    return " ".join(random.choice(WORDS, n))


BASE = prose(1, 300)
LONG = prose(2, 30_000)
ODD = [None, "", " \n\t", "one", "a b c", BASE, BASE, BASE + " extra words at the end", LONG, LONG, "x" * 5000, "é" * 300, "\n\n\n", "a\nb\na\nb"]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [*ODD, "null id", BASE], [*range(len(ODD)), None, 5])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_near_duplicates_against_all_pairs(spark):
    random = np.random.default_rng(5)
    texts = []
    for g in range(6):
        base = prose(10 + g, 120).split()
        for _ in range(8):
            copy = list(base)
            for at in random.choice(120, random.integers(0, 9), replace=False):
                copy[at] = "changed" + str(random.integers(1000))
            texts.append(" ".join(copy))
    got = {r.doc_id: r for r in near_dup.near_duplicates(table(spark, texts), words=4).collect()}
    sets = [set(zip(*[split(low(t))[j:] for j in range(4)], strict=False)) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), root[i], root[i] == i)


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == len(ODD) + 2
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (0, 1, 2))
    assert by[6].component_id == 5 and by[7].component_id == 5 and by[9].component_id == 8
    assert by[None].kept and by[None].component_id is None
    assert near_dup.near_duplicates(empty).count() == 0
    assert rows(near_dup.one_of_each(odd), "doc_id") == [(None,), *[(i,) for i in range(len(ODD)) if i not in (6, 7, 9)]]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7)], "u long, v long")
    assert rows(components(edges)) == [*[(i, 0) for i in range(41)], (90, 90), (100, 90)]


def test_super_minhash_estimates_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    signs = near_dup.super_minhash(np.concatenate((a, b)), np.array([0, 1000, 2000]))
    assert abs((signs[0] == signs[1]).mean() - 800 / 1200) < 0.15
    few = near_dup.super_minhash(np.array([1, 2, 3], np.uint64), np.array([0, 1, 3, 3]))
    assert (few[:2] < 1 << 40).all() and len(set((few[0] >> np.uint64(32)).tolist())) == near_dup.PLACES


def expected_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[j : j + length] for b in raw for j in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = True
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [2000, 2])
def test_repeats_against_all_strings(spark, monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    passage = prose(3, 60)
    texts = [prose(20 + i, 40) + " " + passage[i : 200 + 7 * i] + prose(50 + i, 40) for i in range(9)] + [*ODD[:8], *ODD[10:], passage + passage]
    got = {r.doc_id: r for r in repeats.remove_repeats(table(spark, texts), 100).collect()}
    for i, want in enumerate(expected_removal(texts, 100)):
        assert tuple(got[i])[1:5] == want


def test_repeats_of_odd_rows(odd, empty):
    got = repeats.remove_repeats(odd).collect()
    assert len(got) == len(ODD) + 2 and {r.n_removed for r in got if r.doc_id in (5, 6, 7, 8, 9, 10)} == {len(BASE), len(LONG), 5000}
    assert repeats.remove_repeats(empty).count() == 0


def test_interval_tree():
    assert sorted(repeats.intervals([1, 3, 3, 0, -1, 2])) == [(0, 0, 4), (1, 0, 3), (2, 5, 6), (3, 1, 3)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 49_407), max_size=60), st.integers(1, 120))
def test_range_coder_round_trip(ids, times):
    many = np.array(ids * times, dtype=np.int64)
    assert (range_coder.decode(range_coder.encode(many)) == many).all()


def test_range_coder_notices_damage():
    data = bytearray(range_coder.encode(np.arange(9000) % 700))
    data[-5] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        range_coder.decode(bytes(data))


def test_token_memory(monkeypatch):
    # MB of arrays that a worker holds at once: 43 for a million ids read back and 156 for 3 MB of text before.
    import tracemalloc

    from tablewright.llm import token_output, words

    ids = (np.arange(1_000_000) * 7919 % 40_009).astype(np.uint16)
    data = range_coder.encode(ids)
    texts = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([prose(i, 1500) for i in range(400)])], ["doc_id", "text"])
    monkeypatch.setattr(words, "_powers", [])
    packed = token_output._packed(tokenizer_path())
    peaks = []
    for work in (lambda: range_coder.decode(data), lambda: list(packed(iter([texts])))):
        tracemalloc.start()
        result = work()
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        if len(peaks) == 1:
            assert (result == ids).all()
    assert peaks[0] < 25 and peaks[1] < 80


def test_token_digests(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = token_digests(odd, tokenizer_path(), f"file://{tmp_path}/a").collect()
    assert len(got) == len(ODD) + 2
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    for r in got:
        text = "null id" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert token_digests(empty, tokenizer_path(), f"file://{tmp_path}/b").count() == 0
    whole = decode_documents(encode_documents(table(spark, ["the cat", None]), tokenizer_path())).collect()
    assert [len(r.ids) // 4 for r in sorted(whole)] == [3, 1]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = ["It's 100 <|endoftext|>. <|ENDOFTEXT|>, x́ ́y 0 00 a0 \x1c b\x85c\xa0d ΑΣ. don't. we're!", None, "", "<|startoftext|>", "0", "ﬁ Ａ１ 中文。好, İ ǅ"]
    ids, bounds = Encoder(tokenizer_path()).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_hits_and_clean_rows(spark, odd, empty, monkeypatch):
    item, other = prose(7, 40), prose(8, 30)
    near = item.split()
    near[20] = "different"
    texts = ["before " + item.upper() + " after", prose(9, 50) + " " + " ".join(near), prose(11, 90), None, other[:60], item + " " + other]
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (2, other)], "item_id long, text string")
    docs = table(spark, texts)
    got = rows(benchmark_hits(docs, items), "doc_id", "item_id", "first_word", "n_words")
    assert got == [(0, 1, 1, 40), (5, 1, 0, 40), (5, 2, 40, 30)] or got == [(0, 1, 1, 40), (1, 1, 50, 40), (5, 1, 0, 40), (5, 2, 40, 30)]
    found = {r[0] for r in got}
    clean = without_benchmark(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(6)) - found
    monkeypatch.setattr(decontaminate, "GROUP_ITEMS", 1)
    assert rows(benchmark_hits(docs, items), "doc_id", "item_id", "first_word", "n_words") == got
    assert benchmark_hits(empty, items).count() == 0 and without_benchmark(odd, items.limit(0)).count() == len(ODD) + 2


def test_groups_of_items_that_share_shingles(spark, monkeypatch):
    shared = prose(300, 12)
    texts = [f"{shared} {prose(301 + i, 14)}" for i in range(12)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    near = []
    for i, t in enumerate(texts):
        for at in (3, 15, 24):
            near.append(" ".join("different" if k == at else w for k, w in enumerate(t.split())))
    docs, columns = table(spark, near), ("doc_id", "item_id", "first_word", "n_words", "similarity")
    want = rows(benchmark_hits(docs, items, similarity=0.6), *columns)
    assert want
    for size in (1, 5):
        monkeypatch.setattr(decontaminate, "GROUP_ITEMS", size)
        got = rows(benchmark_hits(docs, items, similarity=0.6), *columns)
        assert [r[:4] for r in got] == [r[:4] for r in want] and np.allclose([r[4] for r in got], [r[4] for r in want])


def test_short_items_in_longer_texts(spark):
    items = spark.createDataFrame([(1, "red fox"), (2, "one two three four"), (3, "fox")], "item_id long, text string")
    docs = table(spark, ["The Red fox ran over all the hills", "zero one two three four five six", "one two three", "red"])
    got = rows(benchmark_hits(docs, items), "doc_id", "item_id", "first_word", "n_words")
    assert got == [(0, 1, 1, 2), (0, 3, 2, 1), (1, 2, 1, 4)] and rows(without_benchmark(docs, items), "doc_id") == [(2,), (3,)]


def test_votes(spark, odd, empty):
    shout = " ".join(w.upper() + "!!" for w in prose(3, 120).split())
    signs = " ".join(w + "###" for w in prose(4, 120).split())
    good = [". ".join(prose(100 + i, 20) for _ in range(8)) + "." for i in range(20)]
    got = {r.doc_id: r for r in quality_votes(table(spark, [*good, shout, signs, "too short"])).collect()}
    assert not got[20].kept and not got[21].kept and not got[22].kept and got[22].base_failed
    for r in quality_votes(odd).collect():
        text = ("null id" if r.doc_id is None else ODD[r.doc_id]) or ""
        words = split(text)
        count = Counter(zip(words, words[1:], words[2:], strict=False))
        again = {i + k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if split(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(again))
    assert quality_votes(empty).count() == 0


def fitted_by_hand(patterns, rounds):
    """Share of good texts and outcome probabilities per rule, in plain Python."""
    from tablewright.llm import quality_rules as Q

    rules = len(next(iter(patterns)))
    share, chance = Q.SHARE, [[list(Q.ON_GOOD), list(Q.ON_BAD)] for _ in range(rules)]

    def good(votes):
        odds = np.log(share / (1 - share)) + sum(np.log(chance[j][0][v + 1] / chance[j][1][v + 1]) for j, v in enumerate(votes))
        return 1 / (1 + np.exp(-odds))

    for _ in range(rounds):
        weights = {p: (n * good(p), n * (1 - good(p))) for p, n in patterns.items()}
        sums = [sum(w[c] for w in weights.values()) for c in (0, 1)]
        chance = [[[(sum(w[c] for p, w in weights.items() if p[j] == v) + Q.SEEN) / (sums[c] + 3 * Q.SEEN) for v in (-1, 0, 1)] for c in (0, 1)] for j in range(rules)]
        share = min(Q.BOUNDS[1], max(Q.BOUNDS[0], sums[0] / max(sum(sums), 1.0)))
    return {p: good(p) for p in patterns}


def test_votes_are_weighed(spark):
    """A corpus of good prose and junk: one bad vote among good ones is outvoted, a text without bad votes is not always kept."""
    from tablewright.llm.quality_rules import STOP_WORDS

    random = np.random.default_rng(11)
    nouns = ["".join(random.choice(list("abcdefghilmnoprstuv"), 6)) for _ in range(400)]
    sentence = lambda n: " ".join(random.choice(STOP_WORDS if random.random() < 0.3 else nouns) for _ in range(n)).capitalize() + "."
    good = [" ".join(sentence(12) for _ in range(10)) for _ in range(150)]
    junk = ["#$ %& " + " ".join(random.choice(["buy##", "$$now", "win!!!", "100%"]) for _ in range(120)) for _ in range(30)]
    outvoted = " ".join(sentence(12) for _ in range(10)).replace(".", "!!!!")
    unsure = "\n".join(" ".join(random.choice(nouns[:60]) + str(k) for k in range(9)) for _ in range(12))
    got = quality_votes(table(spark, [*good, *junk, outvoted, unsure])).collect()
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i in range(150)) and not any(by[i].kept for i in range(150, 180))
    assert -1 in by[180].votes and by[180].kept
    want = fitted_by_hand(Counter(tuple(r.votes) for r in got), 30)
    assert all(abs(r.good - want[tuple(r.votes)]) < 1e-9 for r in got)
    few = {p: n for p, n in Counter(tuple(r.votes) for r in got).items()}
    weak = tuple([0] * 10)
    assert fitted_by_hand({**few, weak: 40}, 30)[weak] < 0.5  # no bad vote, and yet no good text


def test_mix(spark, odd, empty):
    texts = [prose(i, 5 + i % 60) for i in range(400)]
    docs = table(spark, texts, sources=["abc"[0 if i < 250 else 1 + i % 2] if i % 50 else None for i in range(400)])
    got = mixing.mix(docs).collect()
    assert rows(mixing.mix(docs)) == sorted(tuple(r) for r in got)or len(got) == 400
    total = sum(r["size"] for r in got)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 65 and all(r["taken"] <= 3 * r["size"] for r in own)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - total) < 1e-6
    assert mixing.mixed_documents(docs).count() == sum(r["copies"] for r in got)
    assert mixing.mix(odd).count() == len(ODD) + 2 and mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_neighbours(spark, odd, empty):
    good = [prose(i, 80) + "." for i in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in prose(i, 80).split()) for i in range(100, 140)]
    docs = table(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)] + [(3, None), (None, 1), (5, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in neighbour_scores(docs, labels).collect()}
    assert all(got[i].predicted == int(i < 60) for i in range(100))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(100))
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns and rows(kept, "doc_id") == [(i,) for i in range(60)]
    scores = neighbour_scores(odd, labels.limit(0)).collect()
    assert len(scores) == len(ODD) + 2 and {r.score for r in scores} == {0.5}
    assert neighbour_scores(odd, labels).count() == len(ODD) + 2 and neighbour_scores(empty, labels).count() == 0


def test_licenses(spark, odd, empty):
    text = "Under the MIT-License; SPDX-License-Identifier: (Apache-2.0 OR GPL-2.0-only WITH Classpath-exception-2.0) AND MIT\ncc by nc cc by nc"
    r = licenses.license_scan(table(spark, [text])).first()
    assert (r.n_base, r.first_word, r.base_labels, r.labels, r.free_use) == (3, 0, "cc-by-nc,mit", "apache-2,cc-by-nc,gpl-2,mit", True)
    assert licenses.parse("MIT AND GPL-3.0")[1] is False and licenses.parse("MIT OR GPL-3.0)")[:2] == ({"mit", "gpl-3"}, True)
    assert licenses.parse("AND") == (set(), None, 0) and licenses.parse("(MIT")[:2] == ({"mit"}, True)
    got = licenses.license_scan(odd).collect()
    assert len(got) == len(ODD) + 2 and {(r.n_base, r.labels, r.score) for r in got} == {(0, "", 0.0)}
    assert licenses.license_scan(empty).count() == 0


def test_lines(spark, odd, empty):
    block = [prose(60 + i, 12) for i in range(4)]
    texts = ["\n".join(["first own line", *block]), "\n".join([block[0], "between", *block[1:]]), "\n".join(["Yes.", "other"]), "Yes."]
    got = rows(line_align.drop_aligned_lines(table(spark, texts)), "doc_id", "n_removed", "text")
    assert got == [(0, 0, texts[0]), (1, 4, "between"), (2, 0, texts[2]), (3, 0, "Yes.")]
    assert line_align.patience([1, 2, 3, 4], [1, 9, 3, 2, 4]) == [(0, 0), (1, 3), (3, 4)] or len(line_align.patience([1, 2, 3, 4], [1, 9, 3, 2, 4])) == 3
    cleaned = {r.doc_id: r for r in line_align.drop_aligned_lines(odd).collect()}
    assert cleaned[0].text is None and cleaned[1].text == "" and cleaned[6].text == "" and cleaned[9].n_removed == 1
    assert line_align.drop_aligned_lines(odd).count() == len(ODD) + 2 and line_align.drop_aligned_lines(empty).count() == 0


def test_lines_in_earlier_documents_apart(spark):
    # All lines of the block stand in earlier documents, but only alone; too short to go by themselves.
    block = [prose(80 + i, 4) for i in range(5)]
    texts = [*[f"{x}\nown {i}" for i, x in enumerate(block)], "\n".join(["one", *block, "two"]), "\n".join(["three", *block[:2], "", *block[2:], "four"]), "\n".join(block[1:3])]
    got = rows(line_align.drop_aligned_lines(table(spark, texts)), "doc_id", "n_removed", "text")
    assert got == [*[(i, 0, t) for i, t in enumerate(texts[:6])], (6, 5, "three\n\nfour"), (7, 2, "")]


def test_lines_that_all_repeat(spark):
    line, short = prose(90, 9), prose(91, 4)
    pairs = [(["a", line, line, "b"], ["c", line, line, "d"]), (["a", *[short] * 4, "b"], ["c", *[short] * 3, "d", "e"])]
    for first, second in pairs:
        got = rows(line_align.drop_aligned_lines(table(spark, ["\n".join(first), "\n".join(second)])), "doc_id", "text")
        assert got[1] == (1, "\n".join(x for x in second if x not in first))


def test_identifiers_outside_the_table():
    for name in ("Zlib", "EPL-2.0", "BSL-1.0", "CC-BY-SA-4.0"):
        assert licenses.scan(f"SPDX-License-Identifier: {name}\n")[5] == name.lower()
    assert licenses.parse("GPL-2.0-only WITH Classpath-exception-2.0")[0] == {"gpl-2"}


def all_pairs(texts):
    """Texts without the lines that alignment with any earlier text deletes."""
    split_texts, out = [t.split("\n") for t in texts], []
    codes = {}
    for j, own in enumerate(split_texts):
        b, words = [codes.setdefault(x, len(codes) + 1) if split(x) else 0 for x in own], [len(split(x)) for x in own]
        gone = {p for i in range(j) for p in line_align.aligned_runs(
            [codes[x] if split(x) else 0 for x in split_texts[i]], b, words, line_align.BLOCK_WORDS)}
        out.append("\n".join(x for p, x in enumerate(own) if p not in gone))
    return out


def test_lines_against_all_pairs(spark):
    x, y = prose(92, 9), prose(93, 10)
    cases = [[f"{x}\nx\n{x}", f"a\n{x}\nb", f"c\n{x}\nd"], [f"{x}\n{y}", f"p\n{y}\n{x}\nq", f"r\n{y}\n{x}\ns", f"p\n{y}\n{x}\nq"]]
    for texts in cases:
        got = rows(line_align.drop_aligned_lines(table(spark, texts)), "doc_id", "text")
        assert [r[1] for r in got] == all_pairs(texts)
    assert got[2:] == [(2, "r\ns"), (3, "")]
    random = np.random.default_rng(8)
    pool = ["", "", *[prose(200 + i, 3) for i in range(5)], *[prose(210 + i, 9) for i in range(4)]]
    texts = ["\n".join(random.choice([*pool, f"own {d}"], random.integers(1, 14))) for d in range(150)]
    got = rows(line_align.drop_aligned_lines(table(spark, texts)), "doc_id", "text")
    assert [r[1] for r in got] == all_pairs(texts)


def test_lines_of_many_documents_make_few_pairs(spark, monkeypatch):
    # A common line, once or twice, before or behind another common one; every text also shares a line with one more.
    pairs, other = [], line_align._other_pairs
    monkeypatch.setattr(line_align, "_other_pairs", lambda *a: pairs.append(other(*a).count()) or other(*a))
    line, footer, random = prose(94, 9), prose(95, 4), np.random.default_rng(10)
    kinds = [[line, 0, 1, 2, footer], [line, 0, 1, 2, line], [footer, 0, 1, line], [0, 1, line, 2], [line, 0, footer, line, 1]]
    texts = []
    for d in range(120):
        own = [f"own {d} a", prose(300 + d // 2, 4), f"own {d} b"]
        texts.append("\n".join(x if isinstance(x, str) else own[x] for x in kinds[random.integers(0, 5) if d > 2 else 0]))
    got = rows(line_align.drop_aligned_lines(table(spark, texts)), "doc_id", "text")
    assert [r[1] for r in got] == all_pairs(texts)
    assert sum(pairs) < len(texts)  # 1,606 where a text met all earlier holders of its line


def test_shapes_align_alike():
    random = np.random.default_rng(9)
    for _ in range(500):
        a, b = (random.integers(0, 5, random.integers(0, 12)).tolist() for _ in range(2))
        both = set(a) & set(b)
        a = [x if x in both or not x else 50 + i for i, x in enumerate(a)]
        words = [3 * (x > 0) for x in b]
        assert line_align.aligned_runs(a, b, words, 5) == line_align.aligned_runs(line_align.shape(a, both), b, words, 5)


def test_longest_common_subsequence():
    random = np.random.default_rng(6)
    for _ in range(300):
        a, b = (random.integers(1, 4, random.integers(0, 14)).tolist() for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = line_align.longest_common(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:], strict=False))


def test_line_keys_against_all_runs():
    random = np.random.default_rng(4)
    for _ in range(200):
        words = random.integers(0, 6, random.integers(0, 12)).astype("<i4")
        lines = np.where(words > 0, words + 10, 0).astype(np.uint64)
        want = set()
        for a in range(len(words)):
            b = next((b for b in range(a + 1, len(words) + 1) if words[a:b].sum() >= 8), None)
            if words[a] and b:
                want.add(tuple(lines[a:b].tolist()))
        assert len(line_align.line_keys(lines, words, 8)) == len(want)


def test_surrogates(spark, odd, empty, monkeypatch):
    texts = ["Mail Ann.Bee@mail.example.com or +1 (437) 555-0689, card 4111 1111 1111 1111, host 10.0.0.1.", "ann.bee@MAIL.example.com; Mrs Anna Smith, Господин Иван Петров", "order 4111111111111112"]
    got = {r.doc_id: r for r in surrogates.replace_personal_data(table(spark, texts), "k").collect()}
    assert set(got) == {0, 1} and got[0].types == "card,ip,mail,phone" and got[1].types == "mail,name"
    before, after = surrogates.find(texts[0]), surrogates.find(got[0].text)
    assert [x[2] for x in before] == [x[2] for x in after] and not {x[3] for x in before} & {x[3] for x in after}
    assert got[0].text.startswith("Mail ") and after[0][3] == surrogates.find(got[1].text)[0][3]
    assert surrogates.replace_personal_data(odd, "k").count() == 0 and surrogates.replace_personal_data(empty, "k").count() == 0
    # A narrow space of surrogates has to be drawn again until all differ.
    monkeypatch.setattr(surrogates, "surrogate", lambda kind, normal, key, attempt=0: str((int(normal) + attempt * 7) // 2 + 100))
    values = spark.createDataFrame([(f"phone\t{i}",) for i in range(8)], "value string")
    done = surrogates.assigned(values, b"k").collect()
    assert len({r.surrogate for r in done}) == 8


def test_names_of_one_person_agree(spark, odd):
    text = "Mr John Smith met Mrs Smith. Mr SMITH's car; John Smith left, Smith came, John too. Prof. Dr. Weber, Доктор Иванов пошёл. Weber and Иванов."
    got = surrogates.replace_personal_data(table(spark, [text, "Dr Smith", "Nothing here.", None]), "k", all_rows=True).collect()
    by = {r.doc_id: r for r in got}
    new = by[0].text
    given, family = re.match(r"Mr ([\w-]+) (\w+) met", new).groups()
    weber, ivanov = re.search(r"Prof\. Dr\. (\w+), Доктор (\w+) пошёл", new).groups()
    assert new == (f"Mr {given} {family} met Mrs {family}. Mr {family.upper()}'s car; {given} {family} left, {family} came, {given} too. "
                   f"Prof. Dr. {weber}, Доктор {ivanov} пошёл. {weber} and {ivanov}.")
    assert not {"John", "Smith", "Weber", "Иванов"} & {given, family, weber, ivanov} and by[1].text == f"Dr {family}"
    assert tuple(by[2]) == (2, 0, "", "Nothing here.") and tuple(by[3]) == (3, 0, "", None)
    assert sorted(str(r.text) for r in surrogates.replace_personal_data(odd, "k", all_rows=True).collect()) == sorted(str(t) for t in [*ODD, "null id", BASE])
    many = spark.createDataFrame([(f"name\tm:given{i}",) for i in range(60)], "value string")
    assert len({r.surrogate for r in surrogates.assigned(many, b"k").collect()}) == 60


def test_stages_of_odd_rows(spark, odd, tmp_path):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    items = spark.createDataFrame([(0, prose(77, 30))], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns, name
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"


@pytest.mark.parametrize(("tag", "labels"), [
    ("see the LICENSE file", ""), ("MIT and more words follow", "mit"), ("NOASSERTION", ""), ("NONE", ""), ("MIT WITH GPL-3.0", "mit"),
    ("(MIT OR Apache-2.0", "apache-2,mit"), ("((MIT OR (Apache-2.0 AND", "apache-2,mit"), ("Zlib", "zlib"), ("LicenseRef-own", "licenseref-own"),
    ("MIT AND Zlib-1", "mit,zlib-1"), ("MIT WITH Some-exception", "mit"), ("GPL-2.0-or-later WITH Classpath-exception-2.0 OR MIT", "gpl-2,mit"),
    ("Classpath-exception-2.0", ""), ("OR MIT", ""), (") MIT", ""), ("", ""),
])
def test_labels_behind_a_tag(tag, labels):
    assert licenses.scan(f"x\nSPDX-License-Identifier: {tag}\nmore MIT text")[5] == labels


def test_surrogates_of_a_full_space_end(spark):
    """All 676 names of two letters, and most short telephone numbers: distinct surrogates, none of them a value."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    values = [f"name\t:{a}{b}" for a in letters for b in letters] + [f"phone\t1{n:06d}" for n in range(0, 3000)]
    done = surrogates.assigned(spark.createDataFrame([(v,) for v in values], "value string"), b"k").collect()
    assert len({r.surrogate for r in done}) == len(values) and not {r.surrogate for r in done} & set(values)


def test_longer_surrogates_are_rendered_whole():
    for kind, original, normal in (("phone", "+1 555-0100", "15550100"), ("card", "4111 1111 1111 1111", "4111111111111111"), ("name", "Wu", ":wu"), ("ip", "10.0.0.1", "10.0.0.1")):
        for attempt in (0, 1, 4):
            new = surrogates.surrogate(kind, normal, b"k", attempt)
            shown = surrogates.render(kind, original, new)
            assert re.sub(r"[^0-9A-Za-z]", "", shown).lower() == re.sub(r"[^0-9a-z]", "", new)
            if kind == "card":
                assert surrogates.luhn(new)


def test_every_script_is_kept():
    import unicodedata

    for text in ("李雷@例子.cn", "Ωμέγα@σ.gr", "иван@почта.рф", "ジョン@れい.jp", "anne@x.fr", "가나@다.kr"):
        new = surrogates.surrogate("mail", text.lower(), b"k")
        for a, b in zip(text, new, strict=True):
            if a.isalpha():
                assert unicodedata.name(a).split()[0] == unicodedata.name(b).split()[0]


def near_windows(texts, items, percent, k=5):
    """Best window per text and item over all windows, by the similarity of shingles weighted over all items."""
    sets = {i: Counter(zip(*[split(low(t))[j:] for j in range(k)], strict=False)) for i, t in items}
    df = Counter(x for s in sets.values() for x in s)
    n = len(items)
    weight = lambda x: 1 + np.log(n / df[x]) if x in df else 1 + np.log(n)
    out = []
    for d, text in enumerate(texts):
        words = split(low(text))
        for i, item in items:
            size, best = len(split(item)), (0.0, 0)
            for a in range(max(1, len(words) - size + 1)):
                own = Counter(zip(*[words[a : a + size][j:] for j in range(k)], strict=False))
                common = sum(min(c, sets[i][x]) * weight(x) for x, c in own.items() if x in sets[i])
                both = sum(c * weight(x) for x, c in own.items()) + sum(c * weight(x) for x, c in sets[i].items()) - common
                best = max(best, (common / both, -a))
            if best[0] >= percent - 1e-12:
                out.append((d, i, -best[1], min(size, len(words))))
    return sorted(out)


def test_hits_are_those_of_all_windows(spark, monkeypatch):
    random = np.random.default_rng(8)
    items = [(i, prose(400 + i, 60 + 3 * (i % 5))) for i in range(25)]
    items += [(25, items[0][1] + " and more words at the end"), (26, " ".join(items[1][1].split()[:52] + prose(9, 6).split()))]
    texts = []
    for i, t in items:
        for changed in (0, 1, 2):
            words = t.split()
            for at in random.choice(len(words), changed, replace=False):
                words[at] = f"other{at}"
            texts.append(f"{prose(600 + i, 15)} {' '.join(words)} {prose(700 + i, int(random.integers(0, 40)))}")
    texts += [prose(5, 200), "", items[3][1], " ".join(items[4][1].split()[:50])]
    want = near_windows(texts, items, 0.8)
    table_of_items = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: rows(benchmark_hits(table(spark, texts), table_of_items), "doc_id", "item_id", "first_word", "n_words")
    assert found() == want and len(want) > 40
    # Without its index the search finds nothing: what names the items are their fingerprints.
    monkeypatch.setattr(decontaminate.Items, "_near", lambda self, sums, a, size, members, table: (np.zeros(1, int), np.zeros((1, len(members)), bool)))
    it = decontaminate.Items([i for i, _ in items], [t for _, t in items], 5, 0.8, len(items), {})
    assert not list(decontaminate._hits(it, pa.array(texts)))
