"""Ranked lexical search over Bloom signatures of documents, cut into bit slices.

The index has one row per document: its text, its number of terms, and a Bloom signature of its
terms, each inserted once for every level of frequency it reaches (1, 2, 4 and 8 times). A
signature has as many bits as the document needs, so long texts do not fill theirs.

For a search, the signatures of some documents of one size become slices: one bitmap over the
document rows for each bit. The slices of a term's bits, combined with `and`, never miss a
document that holds the term. The bitmaps of an item's terms, weighted and summed level by level,
bound each document's score from above. Documents whose bound stays below the score of the
item's tenth in the same task are provably not among its best; all others are scored exactly
from their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm import words as W
from tablewright.llm.shared import drop_written, ids_and_texts, ship, written

#: Bytes that separate terms; letters, digits and all bytes of other scripts are parts of terms.
_BETWEEN = W.is_separator(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: A term that occurs so often in a text is inserted at that level.
LEVELS = (1, 2, 4, 8)
PROBES = 3
#: Bits for each inserted key, rounded up to a power of two.
BITS_PER_KEY = 8
#: Terms whose numbers of holders a task keeps before it hands them on, and how many of them form a row.
KEPT, IN_ROW = 1 << 21, 1 << 16
#: Items go to the tasks in groups of at most so many items and terms, each a pass over the index.
GROUP_ITEMS, GROUP_TERMS = 10_000, 500_000
#: At most so many document rows are sliced at a time, and so many scored exactly, fewer where the
#: items have many terms: their numbers multiplied stay below CELLS.
SLICED, SCORED, CELLS = 1024, 64, 1 << 22
#: Bits of the signatures that are sliced at a time.
SLICED_BITS = 1 << 28

_INDEX = "doc_id long, text string, n long, signature binary, terms binary, holders binary"


def _of_level(keys: np.ndarray, level: int) -> np.ndarray:
    return W.mixed(keys + np.uint64(0x632BE59BD9B4E019 * (level + 1) % (1 << 64)))


def _places(keys: np.ndarray, bits: np.ndarray | int) -> list[np.ndarray]:
    """The bits that a key sets in a signature of `bits` bits, a power of two."""
    first, step = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    mask = np.asarray(bits, dtype=np.uint64) - np.uint64(1)
    return [((first + np.uint64(k) * step) & mask).astype(np.int64) for k in range(PROBES)]


def _runs(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (text, term) pairs and how often each occurs, in order; `text` does not decrease."""
    hashes = hashes.copy()
    bounds = np.flatnonzero(np.diff(text, prepend=-1))
    for a, b in zip(bounds, [*bounds[1:], len(text)], strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], hashes[at], np.diff(np.append(at, len(hashes)))


def _signatures(text: np.ndarray, terms: np.ndarray, times: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature bytes of all texts one after the other, and where each begins."""
    reached = [times >= level for level in LEVELS]
    keys = sum(np.bincount(text[r], minlength=rows) for r in reached)
    bits = np.left_shift(np.int64(1), np.maximum(6, np.ceil(np.log2(np.maximum(1, keys * BITS_PER_KEY)))).astype(np.int64))
    bits[keys == 0] = 0
    at = np.concatenate(([0], np.cumsum(bits)))
    field = np.zeros(at[-1], dtype=bool)
    for level, r in enumerate(reached):
        for place in _places(_of_level(terms[r], level), bits[text[r]].astype(np.uint64)):
            field[at[text[r]] + place] = True
    return np.packbits(field, bitorder="little"), at // 8


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    terms, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    return terms, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _row(doc_id, text, n, signature, terms, holders) -> pa.RecordBatch:
    names = [f.split()[0] for f in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([doc_id, text, n, signature, terms, holders], names)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents with a term; at the end of a task, rows of its terms and their numbers of holders."""
    parts, kept = [], 0

    def handed_on():
        if parts:
            terms, holders = _merged(parts)
            bounds = np.append(np.arange(0, len(terms), IN_ROW), len(terms))
            none = [pa.nulls(len(bounds) - 1, t) for t in (pa.int64(), pa.string(), pa.int64(), pa.binary())]
            yield _row(*none, W.binary(terms, bounds), W.binary(holders, bounds))

    for batch in W.pieces(batches):
        found = W.words_of(W.column(batch, "text"), _BETWEEN)
        if not len(found.starts):
            continue
        n = found.counts
        text, terms, times = _runs(found.hashes(), np.repeat(np.arange(len(n)), n))
        raw, at = _signatures(text, terms, times, len(n))
        rows = pa.array(np.flatnonzero(n))
        signature = W.binary(raw, at).take(rows)
        no_terms = pa.nulls(len(rows), pa.binary())
        yield _row(
            W.column(batch, "doc_id").take(rows), W.column(batch, "text").take(rows), pa.array(n, pa.int64()).take(rows), signature, no_terms, no_terms)
        different, holders = np.unique(terms, return_counts=True)
        parts.append((different, holders))
        kept += len(different)
        if kept > KEPT:
            parts[:] = [_merged(parts)]
            kept = len(parts[0][0])
            if kept > KEPT // 2:
                yield from handed_on()
                parts.clear()
                kept = 0
    yield from handed_on()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents that have a term, written to the shared folder (the caller drops it).

    Rows with `signature` are documents; rows with `terms` list hashes of terms and how many of some
    documents hold them. Missing texts and texts without a term are not in it; repeated rows are
    documents of their own, as are rows without an id.
    """
    ship(docs.sparkSession)
    return written(ids_and_texts(docs, id_col, text_col).mapInArrow(_indexed, _INDEX), "index")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, _ = W.runs(W.column(batch, "terms"), np.int64)
        holders, _ = W.runs(W.column(batch, "holders"), np.int64)
        for a in range(0, len(terms), IN_ROW):
            yield pa.RecordBatch.from_arrays([pa.array(terms[a : a + IN_ROW]), pa.array(holders[a : a + IN_ROW])], ["h", "df"])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.pieces(batches):
        found = W.words_of(W.column(batch, "text"), _BETWEEN)
        if not len(found.starts):
            continue
        text, terms, _ = _runs(found.hashes(), np.repeat(np.arange(batch.num_rows), found.counts))
        rows = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [W.column(batch, "doc_id").take(rows), W.column(batch, "key").take(rows), pa.array(terms.view(np.int64))], ["item_id", "key", "h"])


class Group:
    """Some items with their weighted terms, ready to bound and score documents."""

    def __init__(self, items: list[tuple[int | None, list[tuple[int, int]]]], docs: int, terms: int, top: int):
        self.ids, self.docs, self.all_terms, self.top = [i for i, _ in items], docs, terms, top
        hashes = np.array([h for _, own in items for h, _ in own], dtype=np.int64).view(np.uint64)
        self.weights = np.array([w for _, own in items for _, w in own], dtype=np.int64)
        self.vocabulary, self.at = np.unique(hashes, return_inverse=True)
        self.first = np.concatenate(([0], np.cumsum([len(own) for _, own in items])))[:-1]
        self.sliced, self.scored = (max(1, min(k, CELLS // max(1, len(self.weights)))) for k in (SLICED, SCORED))

    def penalty(self, n: np.ndarray) -> np.ndarray:
        """A document's m."""
        return 10 + (90 * n * self.docs) // self.all_terms

    def bounds(self, raw: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Upper bounds (items x documents) from signatures of one size (documents x bytes)."""
        rows = len(raw)
        slices = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
        m = self.penalty(n)
        total, before, held = np.zeros((len(self.ids), rows), dtype=np.int64), np.zeros(rows, dtype=np.int64), None
        for level in range(len(LEVELS)):
            keys = self.vocabulary if held is None else self.vocabulary[held]
            a, b, c = _places(_of_level(keys, level), len(slices))
            found = slices[a] & slices[b] & slices[c]
            if held is not None:
                found &= maps[held]
            maps = np.zeros((len(self.vocabulary), slices.shape[1]), dtype=np.uint8)
            maps[slice(None) if held is None else held] = found
            held = np.flatnonzero(maps.any(axis=1))
            if not len(held):
                break
            # A term below the next level occurs less often than that; above the last level there is only the limit.
            if level + 1 < len(LEVELS):
                most = LEVELS[level + 1] - 1
                gain = (1_000_000_000 * most) // (1000 * most + 8 * m)
            else:
                gain = np.full(rows, 1_000_000, dtype=np.int64)
            some = np.flatnonzero(np.isin(self.at, held))
            present = np.unpackbits(maps[self.at[some]], axis=1, count=rows, bitorder="little")
            slice_sums = np.zeros((len(self.ids), rows), dtype=np.int64)
            owner = np.searchsorted(self.first, some, side="right") - 1
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            slice_sums[owner[starts]] = np.add.reduceat(present * self.weights[some][:, None], starts, axis=0)
            total += slice_sums * (gain - before)
            before = gain
        return total

    def scores(self, texts: pa.Array, n: np.ndarray) -> np.ndarray:
        """Exact scores (items x documents)."""
        out = np.zeros((len(self.ids), len(texts)), dtype=np.int64)
        size = len(self.vocabulary)
        for a in range(0, len(texts), self.scored):
            found = W.words_of(texts.slice(a, self.scored), _BETWEEN)
            rows = len(found.counts)
            hashes, text = found.hashes(), np.repeat(np.arange(rows), found.counts)
            place = np.minimum(np.searchsorted(self.vocabulary, hashes), size - 1)
            hit = self.vocabulary[place] == hashes
            pairs, times = np.unique(text[hit] * size + place[hit], return_counts=True)
            parts = np.zeros((size, rows), dtype=np.int64)
            m = self.penalty(n[a : a + self.scored])[pairs // size]
            parts[pairs % size, pairs // size] = (1_000_000_000 * times) // (1000 * times + 8 * m)
            out[:, a : a + rows] = np.add.reduceat(parts[self.at] * self.weights[:, None], self.first, axis=0)
        return out


class Best:
    """The best documents so far of each item: scores, whether the id is missing, ids."""

    def __init__(self, group: Group):
        self.group = group
        self.rows = [np.zeros((0, 3), dtype=np.int64) for _ in group.ids]
        self.least = np.ones(len(group.ids), dtype=np.int64)

    def add(self, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        for item in np.flatnonzero((scores >= self.least[:, None]).any(axis=1)):
            at = np.flatnonzero(scores[item] >= self.least[item])
            rows = np.concatenate((self.rows[item], np.stack((scores[item, at], missing[at], ids[at]), axis=1)))
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.group.top]]
            self.rows[item] = rows
            if len(rows) == self.group.top:
                self.least[item] = max(1, rows[-1, 0])


def _searched(group: Group):
    """The best documents of a task for each item of the group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(group)
        for batch in batches:
            raw, at = W.runs(W.column(batch, "signature"), np.uint8)
            size, n = np.diff(at), np.asarray(W.column(batch, "n"))
            doc_id, texts = W.column(batch, "doc_id"), W.column(batch, "text")
            ids, missing = np.asarray(doc_id.fill_null(0)), np.asarray(doc_id.is_null()).astype(np.int64)
            for s in np.unique(size):
                same = np.flatnonzero(size == s)
                step = max(1, min(group.sliced, SLICED_BITS // (8 * int(s))))
                for k in range(0, len(same), step):
                    rows = same[k : k + step]
                    upper = group.bounds(raw[at[rows][:, None] + np.arange(s)], n[rows])
                    # The most promising first: their scores exclude many others.
                    high = np.argpartition(-upper, min(group.top, len(rows)) - 1, axis=1)[:, : group.top]
                    worth = np.take_along_axis(upper, high, 1) >= best.least[:, None]
                    done = np.zeros(len(rows), dtype=bool)
                    done[np.unique(high[worth])] = True
                    for turn in range(2):
                        if turn:
                            done = (upper >= best.least[:, None]).any(axis=0) & ~done
                        some = rows[done]
                        if len(some):
                            best.add(group.scores(texts.take(pa.array(some)), n[some]), missing[some], ids[some])
        for item, rows in enumerate(best.rows):
            if len(rows):
                doc = pa.array(rows[:, 2], pa.int64(), mask=rows[:, 1] == 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(rows), pa.int32()), pa.array([group.ids[item]] * len(rows), pa.int64()), doc, pa.array(rows[:, 0])],
                    ["item", "item_id", "doc_id", "score"])
    return run


def _groups(weighted: DataFrame, docs: int, terms: int, top: int) -> Iterator[Group]:
    items, size = [], 0
    for row in weighted.orderBy("item_id", "key").toLocalIterator():
        if items and (len(items) == GROUP_ITEMS or size + len(row["own"]) > GROUP_TERMS):
            yield Group(items, docs, terms, top)
            items, size = [], 0
        items.append((row["item_id"], [(t["h"], t["w"]) for t in row["own"]]))
        size += len(row["own"])
    if items:
        yield Group(items, docs, terms, top)


def search(index: DataFrame, items: DataFrame, top: int = 10, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's `top` documents with the highest scores above 0.

    Terms are runs of letters, digits and characters beyond ASCII, only A-Z lowered, told apart by
    64-bit hashes. N is the number of documents with a term, L all their terms, n those of one
    document, df the documents that hold a term, tf its occurrences there. A term weighs
    floor(1000 ln((2N + 2) / (2df + 1))); the score sums, in 64-bit integers, the weights times
    (10^9 tf) div (1000 tf + 8m) with m = 10 + (90 n N) div L over the item's different terms. Equal
    scores: the smaller id first, missing ids last. Missing and blank items have no rows; equal items
    under one id count once, different texts under one id are ranked apart. Without documents or
    items there are no rows. Items are sent to the tasks in groups of bounded size.
    """
    ship(index.sparkSession)
    spark = index.sparkSession
    rows = index.filter("signature IS NOT NULL")
    docs, terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    texts = items.select(items[item_id].cast("long").alias("doc_id"), items[item_text].cast("string").alias("text"))
    own = texts.filter("text IS NOT NULL").distinct().withColumn("key", F.sha2("text", 256)).mapInArrow(_item_terms, "item_id long, key string, h long")
    own = written(own, "items")
    held = index.filter("terms IS NOT NULL").select("terms", "holders").mapInArrow(_listed, "h long, df long")
    df = held.join(own.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(docs)) + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    weighted = own.join(df, "h").groupBy("item_id", "key").agg(F.sort_array(F.collect_list(F.struct("h", weight.alias("w")))).alias("own"))
    weighted = written(weighted, "weighted")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    wanted = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for group in _groups(weighted, docs, terms, top):
        found = rows.select("doc_id", "text", "n", "signature").mapInArrow(_searched(group), "item int, item_id long, doc_id long, score long")
        ranked = found.withColumn("rank", F.row_number().over(wanted)).filter(F.col("rank") <= top)
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    out = written(out, "found")
    drop_written(own)
    drop_written(weighted)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """`search` over an index that is built for it and removed afterwards."""
    index = build_index(docs)
    out = search(index, items, top)
    drop_written(index)
    return out


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE = f"""
WITH words AS (SELECT doc_id, {_TERMS} AS w FROM documents),
sizes AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
corpus AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
asked AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS t FROM benchmark),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM words) WHERE t IN (SELECT t FROM asked) GROUP BY 1, 2),
weights AS (
    SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT t, count(*) AS df FROM tf GROUP BY 1), corpus),
scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
    FROM asked JOIN tf USING (t) JOIN weights USING (t) JOIN sizes USING (doc_id), corpus GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER best <= 10"""
