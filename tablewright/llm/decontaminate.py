"""Benchmark items inside documents: SimHash of item-sized windows, Hamming search, exact check.

A window has as many words as an item. Its 64-bit SimHash is the sign of the weighted bit sums
of its shingles, taken from prefix sums over the text. Fingerprints are cut into 8 blocks; two
that differ in at most RADIUS bits differ in at most RADIUS // 8 bits of some block, so
looking up each block with all values that near finds every item within the radius. What is
found is decided by the weighted Jaccard similarity of the shingles themselves.

Texts that hold too little of every item's weight for the similarity are passed over: all their
windows would be refused by the check. In any other text each window of each item length is
fingerprinted and looked up among all items of that length, whichever shingles it holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import words as W
from tablewright.llm.shared import ids_and_texts, ship, written

#: At similarity 0.8 fingerprints differ in 10 of 64 bits on average (deviation 3).
RADIUS = 23
BLOCKS = 8
#: Items are searched in groups of so many words and items at most; each group is one pass over
#: the texts and about 60 MB on every worker.
GROUP_WORDS, GROUP_ITEMS = 500_000, 10_000
#: Windows that are fingerprinted and looked up at a time.
WINDOWS = 2048

_BITS = np.arange(64, dtype=np.uint64)


def _near_values(most: int) -> np.ndarray:
    """All 8-bit masks with at most so many bits."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(8), k)], dtype=np.uint8)


class Items:
    """One group of benchmark items, ready for search."""

    def __init__(self, ids: list, texts: list, k: int, percent: float, n: int, holders: dict[int, int]):
        """n: number of all items; holders: in how many of all items a shingle is, where in more than one."""
        found = W.words_of(pa.array(texts, pa.string()))
        self.k, self.percent = k, percent
        hashes, bounds = W.shingles(found.hashes(), found.first, k)
        sets = [Counter(hashes[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        #: A shingle weighs more the fewer items have it; any other weighs like one that a single item has.
        self.other = 1.0 + float(np.log(n or 1))
        self.weight = {h: 1.0 + float(np.log(n / holders.get(h, 1))) for s in sets for h in s}
        use = [i for i, s in enumerate(sets) if s]
        self.ids, self.sets = [ids[i] for i in use], [sets[i] for i in use]
        self.words = np.array([found.counts[i] for i in use], dtype=np.int64)
        self.mass = np.array([sum(self.weight[h] * c for h, c in s.items()) for s in self.sets])
        self.places: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            for h in s:
                self.places.setdefault(h, []).append(i)
        self.known = np.array(sorted(self.places), dtype=np.uint64)
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.prints = np.array([self._print(s) for s in self.sets], dtype=np.uint64)
        masks = _near_values(RADIUS // BLOCKS)
        #: Items by the number of their shingles; for every block and value, which of them are near in that block.
        sizes = np.maximum(1, self.words - k + 1)
        self.index: list[tuple[int, np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes).tolist():
            members = np.flatnonzero(sizes == size)
            table = np.zeros((BLOCKS, 256, len(members)), dtype=bool)
            for b in range(BLOCKS):
                values = (self.prints[members] >> np.uint64(8 * b) & np.uint64(255)).astype(np.uint8)
                for i, v in enumerate(values):
                    table[b, v ^ masks, i] = True
            self.index.append((size, members, table))
        self.keys = [np.array(list(s), dtype=np.uint64) for s in self.sets]

    def _print(self, shingles: Counter) -> int:
        keys = np.array(list(shingles), dtype=np.uint64)
        weights = _whole(np.array([self.weight[h] for h in shingles])) * np.array(list(shingles.values()), dtype=np.int32)
        return int(_pack((_signs(keys) * weights[:, None]).sum(axis=0, dtype=np.int32)))

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard of the shingles of a window and an item, with counts."""
        mine, theirs = Counter(window.tolist()), self.sets[item]
        common = sum(min(c, theirs[h]) * self.weight[h] for h, c in mine.items() if h in theirs)
        return common / (sum(c * self.weight.get(h, self.other) for h, c in mine.items()) + self.mass[item] - common)

    def search(self, words: np.ndarray) -> list[tuple]:
        """(item, first word, words, similarity) of the best window for each item found in one text."""
        hashes, _ = W.shingles(words, np.array([0, len(words)]), self.k)
        hit = np.flatnonzero(self.sieve[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        hit = hit[np.isin(hashes[hit], self.known)] if len(hit) else hit
        if not len(hit):
            return []
        there: dict[int, float] = {}
        for h in set(hashes[hit].tolist()):
            for i in self.places[h]:
                there[i] = there.get(i, 0.0) + self.weight[h] * self.sets[i][h]
        if not any(held >= self.percent * self.mass[i] - 1e-9 for i, held in there.items()):
            return []
        weights = np.array([self.weight.get(h, self.other) for h in hashes.tolist()])
        # Sums may wrap around; the difference over a window is small and right all the same.
        sums = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
        np.cumsum(_signs(hashes) * _whole(weights)[:, None], axis=0, dtype=np.int32, out=sums[1:])
        out = []
        for size, members, table in self.index:
            near: list[list[np.ndarray]] = [[] for _ in members]
            for a in range(0, max(0, len(hashes) - size) + 1, WINDOWS):
                starts, found = self._near(sums, a, size, members, table)
                for m in np.flatnonzero(found.any(axis=0)).tolist():
                    near[m].append(starts[found[:, m]])
            for m, starts in enumerate(near):
                # The check of what was found: first whether the text has enough of the item at all, then window by window.
                if starts and there.get(int(members[m]), 0.0) >= self.percent * self.mass[members[m]] - 1e-9:
                    best = self._best(hashes, weights, np.concatenate(starts), size, int(members[m]))
                    if best[0] >= self.percent - 1e-12:
                        out.append((int(members[m]), -best[1], best[0]))
        return [(self.ids[i], first, min(int(self.words[i]), len(words)), similarity) for i, first, similarity in sorted(out)]

    def _near(self, sums: np.ndarray, a: int, size: int, members: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Some windows from place a on, and which items of this size have a fingerprint within the radius."""
        starts = np.arange(a, min(a + WINDOWS, max(0, len(sums) - 1 - size) + 1))
        last = min(size, len(sums) - 1)
        prints = _pack(sums[a + last : a + last + len(starts)] - sums[a : a + len(starts)])
        found = np.zeros((len(starts), len(members)), dtype=bool)
        for b in range(BLOCKS):
            found |= table[b, (prints >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64)]
        row, item = np.nonzero(found)
        found[row, item] = np.bitwise_count(prints[row] ^ self.prints[members[item]]) <= RADIUS
        return starts, found

    def _best(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int, item: int) -> tuple[float, int]:
        """The highest similarity of the windows with an item, and minus the first place that has it."""
        own = np.concatenate(([0.0], np.cumsum(weights * np.isin(hashes, self.keys[item]))))
        # What a window can have in common with the item is no more than its shingles that the item has.
        able = starts[own[np.minimum(starts + size, len(hashes))] - own[starts] >= self.percent * self.mass[item] - 1e-6]
        return max(((self.similarity(hashes[s : s + size], item), -s) for s in able.tolist()), default=(0.0, 0))


def _whole(weights: np.ndarray) -> np.ndarray:
    """Weights as whole numbers, so that equal windows have equal sums wherever they stand."""
    return np.rint(weights * 1024).astype(np.int32)


def _signs(hashes: np.ndarray) -> np.ndarray:
    return (hashes[:, None] >> _BITS & np.uint64(1)).astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from bit sums (last axis)."""
    return np.packbits(sums > 0, axis=-1, bitorder="little").view("<u8")[..., 0]


def _hits(items: Items, column: pa.Array) -> Iterator[tuple[int, tuple]]:
    """(row, hit) of all hits in a column of texts."""
    texts = W.words_of(column)
    hashes = texts.hashes()
    rolled, bounds = W.shingles(hashes, texts.first, items.k)
    passed = np.flatnonzero(items.sieve[(rolled & np.uint64((1 << 20) - 1)).astype(np.int64)])
    held = passed[np.isin(rolled[passed], items.known)]
    for i in np.unique(np.searchsorted(bounds, held, side="right") - 1).tolist():
        for hit in items.search(hashes[texts.first[i] : texts.first[i + 1]]):
            yield i, hit


def _clean(items: Items, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, text_col):
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[[i for i, _ in _hits(items, W.column(batch, text_col))]] = False
            yield batch.filter(pa.array(keep))
    return run


def _found(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            ids = W.column(batch, "doc_id")
            rows = [(ids[i].as_py(), *hit) for i, hit in _hits(items, W.column(batch, "text"))]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], ["doc_id", "item_id", "first_word", "n_words", "similarity"])
    return run


def _shingled(words: int):
    """Per item: shingle length (its own number of words where that is less) and different shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "t"):
            found = W.words_of(W.column(batch, "t"))
            hashes, length = found.hashes(), np.minimum(found.counts, words)
            own = [
                np.unique(W.shingles(hashes[a:b], np.array([0, b - a]), int(k))[0]).view(np.int64) if k else np.zeros(0, np.int64)
                for a, b, k in zip(found.first[:-1], found.first[1:], length, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [W.column(batch, "i"), W.column(batch, "t"), pa.array(length, pa.int32()), pa.array([x.tolist() for x in own], pa.list_(pa.int64()))],
                ["i", "t", "k", "shingles"])
    return run


def _groups(items: DataFrame, words: int, similarity: float, item_id: str, item_text: str) -> Iterator[Items]:
    """The items in groups of bounded numbers of words and items and one length of shingles, read one after the other."""
    rows = items.select(items[item_id].cast("long").alias("i"), items[item_text].cast("string").alias("t")).dropna().distinct()
    rows = written(rows.mapInArrow(_shingled(words), "i long, t string, k int, shingles array<long>"), "items")
    # What a shingle weighs depends on all items, so its holders are counted before there are groups.
    held = rows.select("i", "t", "k", F.explode("shingles").alias("h"))
    counts = held.groupBy("k", "h").agg(F.count("*").alias("c")).filter("c > 1")
    common = held.join(counts, ["k", "h"]).groupBy("i", "t", "k").agg(F.collect_list(F.struct("h", "c")).alias("holders"))
    known = written(rows.filter("k > 0").select("i", "t", "k").join(common, ["i", "t", "k"], "left"), "known")
    n = rows.count()
    ids, texts, size, holders, k = [], [], 0, {}, 0
    for row in known.orderBy("k", "i", "t").toLocalIterator():
        if ids and (row["k"] != k or size + len(row["t"]) // 2 > GROUP_WORDS or len(ids) == GROUP_ITEMS):
            yield Items(ids, texts, k, similarity, n, holders)
            ids, texts, size, holders = [], [], 0, {}
        k = row["k"]
        ids.append(row["i"])
        texts.append(row["t"])
        size += len(row["t"]) // 2
        holders.update((x["h"] % (1 << 64), x["c"]) for x in row["holders"] or ())
    if ids:
        yield Items(ids, texts, k, similarity, n, holders)


def benchmark_hits(
    docs: DataFrame, items: DataFrame, words: int = 5, similarity: float = 0.8,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: the best window of a text for each item in it.

    Words are A-Z-lowered; an item with fewer than `words` words is one shingle, looked for among
    all runs of as many words. What a shingle weighs comes from all items. Items are sent to the tasks in groups of a bounded number of words, each group a pass over the
    texts. Missing or blank texts and items have no hits. Of windows with equal similarity the
    first counts. Repeated rows are searched each; rows without an id report a missing one.
    Other columns are not read; without documents or items there are no rows.
    """
    ship(docs.sparkSession)
    texts = ids_and_texts(docs, id_col, text_col)
    schema = "doc_id long, item_id long, first_word long, n_words long, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    for n, group in enumerate(_groups(items, words, similarity, item_id, item_text)):
        found = texts.mapInArrow(_found(group), schema)
        out = out.unionByName(found) if n else found
    return out


def without_benchmark(
    docs: DataFrame, items: DataFrame, words: int = 5, similarity: float = 0.8,
    text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of docs whose text holds no item, with their columns; decided where they lie."""
    ship(docs.sparkSession)
    names = [f"__{i}" for i in range(len(docs.columns))]
    out = docs.toDF(*names)
    for group in _groups(items, words, similarity, item_id, item_text):
        out = out.mapInArrow(_clean(group, names[docs.columns.index(text_col)]), out.schema)
    return out.toDF(*docs.columns)
