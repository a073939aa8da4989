"""Line deduplication by pairwise alignment.

The result is that of aligning each document with every earlier one, without all those pairs.
Lines that stand in two documents or more lead to pairs. A line with too few words for a block
is hashed together with the lines behind or before it until there are enough (a window): every
line that can be deleted lies in a window that an earlier document has, while a short common
line alone leads nowhere. Each later document is paired with the first document that holds the
window, so one in n documents makes n - 1 pairs, and none is too common to be looked at.
A window of which that left a line, mostly one that the document has more often or in another
order with a second common line, is paired with two other holders that have it as often: the
first, and the earlier one with the fewest different lines. What these leave, too, is paired
with all its other earlier holders. Only lines that such a document shares with another matter there, so holders
with the same sequence of these (and gaps) stand for each other and the first of them is aligned.

Pairs are aligned by patience diff (lines that are unique on both sides, longest increasing run, then the gaps
between; a gap without such a line by its longest common subsequence), and aligned runs of lines with enough words are deleted from the later document.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm import words as W
from tablewright.llm.shared import ship, written

#: Words of an aligned run from which it is deleted.
BLOCK_WORDS = 8


def _lines_of(text: str) -> list[str]:
    return text.split("\n")


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: hash and word count of each line; a line without a word has hash 0."""
    newline = W.is_separator(b"\n")
    for batch in W.pieces(batches):
        data, offsets = W.bytes_of(W.column(batch, "text"))
        breaks = np.flatnonzero(newline[data]) if len(data) else np.zeros(0, np.int64)
        owner = np.searchsorted(offsets, breaks, side="right") - 1
        count = np.bincount(owner, minlength=len(offsets) - 1) + 1
        first = np.concatenate(([0], np.cumsum(count)))
        # Text by text, so that empty texts and breaks at their ends keep their places.
        begins = np.empty(first[-1], np.int64)
        ends = np.empty(first[-1], np.int64)
        begins[first[:-1]], ends[first[1:] - 1] = offsets[:-1], offsets[1:]
        inner = np.arange(len(breaks)) + owner
        ends[inner], begins[inner + 1] = breaks, breaks + 1
        found = W.words_of(W.column(batch, "text"))
        words = np.searchsorted(found.starts, ends) - np.searchsorted(found.starts, begins)
        hashes = W.range_hash(W.hash_prefix(data), begins, ends)
        hashes[hashes == 0] = 1
        hashes[words == 0] = 0
        yield pa.RecordBatch.from_arrays(
            [W.column(batch, "doc_id"), W.column(batch, "t"), W.binary(hashes, first), W.binary(words.astype("<i4"), first)],
            ["doc_id", "t", "lines", "words"])


def _forward(words: np.ndarray, begin: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the fewest lines from each place on that have `least` words; none where the text ends before."""
    so_far = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    end = np.searchsorted(so_far, so_far[begin] + max(least, 1))
    return begin[end < len(so_far)], end[end < len(so_far)]


def line_keys(lines: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """Different hashes of one text: for each line with a word, of the fewest lines from it on
    that have `least` words together; none where the text ends before."""
    begin, end = _forward(words, np.flatnonzero(lines), least)
    return np.unique(W.range_hash(W.hash_prefix(lines.view(np.uint8)), 8 * begin, 8 * end))


def line_windows(lines: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of the shortest runs of `least` words that begin, or end, at each line.

    A line in a common run of `least` words lies in a window that the other text has, too: the one
    that ends at the line if the run holds it, else one from the first line of the run."""
    begin, end = _forward(words, np.arange(len(words)), least)
    so_far = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    last = np.flatnonzero(so_far[1:] >= max(least, 1)) + 1
    first = np.searchsorted(so_far, so_far[last] - max(least, 1), side="right") - 1
    begin, end = np.divmod(np.unique(np.concatenate((begin * len(so_far) + end, first * len(so_far) + last))), len(so_far))
    return W.range_hash(W.hash_prefix(lines.view(np.uint8)), 8 * begin, 8 * end).view(np.int64), begin, end


def _line_keys(least: int):
    """One row for each different window of a document, with its number of places and the document's of different lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (lines, bounds), (words, _) = (W.runs(W.column(batch, c), k) for c, k in (("lines", np.uint64), ("words", "<i4")))
            own = [np.unique(line_windows(lines[a:b], words[a:b], least)[0], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            row = pa.array(np.repeat(np.arange(len(own)), [len(x) for x, _ in own]))
            keys, often = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in own)]) for k in (0, 1))
            sizes = pa.array([len(np.unique(lines[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), W.column(batch, "doc_id").take(row), W.column(batch, "t").take(row), pa.array(often), sizes.take(row)],
                ["line", "doc_id", "t", "often", "size"])
    return run


def _kept_windows(lines: np.ndarray, words: np.ndarray, least: int, keys: list[int], gone: np.ndarray) -> list[int]:
    """Those of the keys with a place in the text where not every line is among the gone ones."""
    hashes, begin, end = line_windows(lines, words, least)
    alive = np.concatenate(([0], np.cumsum(~gone)))
    at = np.isin(hashes, np.array(keys, np.int64)) & (alive[end] > alive[begin])
    return np.unique(hashes[at]).tolist()


def _common_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each beginning of b, in bit-parallel steps."""
    masks: dict[int, int] = {}
    for j, h in enumerate(b):
        masks[h] = masks.get(h, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for h in a:
        met = row & masks.get(h, 0)
        row = (row + met | row - met) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, in order; memory is linear in the lines."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            at = next((j for j in range(b0, b1) if b[j] == a[a0]), None)
            if at is not None:
                out.append((a0, at))
            continue
        half = (a0 + a1) // 2
        ahead = _common_lengths(a[a0:half], b[b0:b1])
        behind = _common_lengths(a[half:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int(np.argmax(ahead + behind))
        todo += [(a0, half, b0, cut), (half, a1, cut, b1)]
    return sorted(out)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal lines, increasing in both. 0 stands for a line without words."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once = [{}, {}]
        for seen, side, lo, hi in ((once[0], a, a0, a1), (once[1], b, b0, b1)):
            for k in range(lo, hi):
                if side[k]:
                    seen[side[k]] = -1 if side[k] in seen else k
        pairs = [(i, once[1][h]) for h, i in once[0].items() if i >= 0 and once[1].get(h, -1) >= 0]
        pairs.sort()
        tops: list[int] = []
        top_at: list[int] = []
        back = [-1] * len(pairs)
        for n, (_, j) in enumerate(pairs):
            at = bisect_left(tops, j)
            back[n] = top_at[at - 1] if at else -1
            tops[at : at + 1], top_at[at : at + 1] = [j], [n]
        n, chain = (top_at[-1] if top_at else -1), []
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        chain.reverse()
        if not chain:
            # All common lines repeat: an ordinary diff of them; between its places nothing is common.
            i_at, j_at = ([k for k in range(lo, hi) if side[k] and side[k] in other] for side, lo, hi, other in ((a, a0, a1, once[1]), (b, b0, b1, once[0])))
            chain = [(i_at[i], j_at[j]) for i, j in longest_common([a[k] for k in i_at], [b[k] for k in j_at])]
        if not chain:
            continue
        out.extend(chain)
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True))
    return sorted(out)


def aligned_runs(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Places in b whose line lies in a run, aligned without a gap on either side, of `least` words."""
    out: list[int] = []
    run: list[tuple[int, int]] = []
    for pair in [*patience(a, b), None]:
        if run and (pair is None or pair != (run[-1][0] + 1, run[-1][1] + 1)):
            if sum(words[j] for _, j in run) >= least:
                out.extend(j for _, j in run)
            run = []
        if pair:
            run.append(pair)
    return out


def _gone(n: int, places) -> np.ndarray:
    gone = np.zeros(n, bool)
    for raw in places or ():
        gone[np.frombuffer(raw, "<i4")] = True
    return gone


def _aligned(least: int):
    """Per pair: places of the later text that go, and windows in common of which something stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xb), (y, yb), (n, nb) = (W.runs(W.column(batch, c), k) for c, k in (("x", np.uint64), ("y", np.uint64), ("words", "<i4")))
            found, left = [], []
            for i, keys in enumerate(W.column(batch, "keys").to_pylist()):
                own, words = y[yb[i] : yb[i + 1]], n[nb[i] : nb[i + 1]]
                found.append(np.array(aligned_runs(x[xb[i] : xb[i + 1]].tolist(), own.tolist(), words.tolist(), least), "<i4").tobytes())
                left.append(_kept_windows(own, words, least, keys, _gone(len(own), [found[-1]])) if keys else [])
            yield pa.RecordBatch.from_arrays(
                [W.column(batch, "doc_id"), W.column(batch, "t"), pa.array(found, pa.binary()), pa.array(left, pa.list_(pa.int64()))],
                ["doc_id", "t", "places", "left"])
    return run


def _open(least: int):
    """Windows of a text that an earlier one has and of which no pair so far took all lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (y, yb), (n, nb) = (W.runs(W.column(batch, c), k) for c, k in (("y", np.uint64), ("words", "<i4")))
            rows = zip(W.column(batch, "left").to_pylist(), W.column(batch, "places").to_pylist(), strict=True)
            own = [
                _kept_windows(y[yb[i] : yb[i + 1]], n[nb[i] : nb[i + 1]], least, [k for part in keys for k in part], _gone(yb[i + 1] - yb[i], places))
                for i, (keys, places) in enumerate(rows)
            ]
            row = pa.array(np.repeat(np.arange(len(own)), [len(k) for k in own]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for part in own for k in part], pa.int64()), W.column(batch, "doc_id").take(row), W.column(batch, "t").take(row)],
                ["line", "doc_id", "t"])
    return run


def _different_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each different line with a word of a document."""
    for batch in batches:
        lines, bounds = W.runs(W.column(batch, "lines"), np.int64)
        own = [np.setdiff1d(lines[a:b], [0]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        row = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.zeros(0, np.int64), *own])), *(W.column(batch, c).take(row) for c in ("doc_id", "t", "is_open"))],
            ["h", "doc_id", "t", "is_open"])


def shape(lines: list[int], shared: set[int]) -> list[int]:
    """The lines with each stretch of lines that no partner has, and of wordless ones between such, as one -1.

    Alignment with a text whose lines are all shared or in no other text depends on this alone."""
    out: list[int] = []
    blank: list[int] = []
    for h in lines:
        if not h:
            blank.append(h)
        elif h in shared:
            out += [*blank, h]
            blank = []
        else:
            if not out or out[-1] != -1:
                out += [*blank, -1]
            blank = []
    return [*out, *blank]


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, bounds = W.runs(W.column(batch, "lines"), np.int64)
        own = [
            hashlib.sha256(np.array(shape(lines[bounds[i] : bounds[i + 1]].tolist(), set(shared or ())), "<i8").tobytes()).digest()
            for i, shared in enumerate(W.column(batch, "shared").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([W.column(batch, "doc_id"), W.column(batch, "t"), pa.array(own, pa.binary())], ["doc_id", "t", "shape"])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, removed = [], [], []
        for text, places in zip(W.column(batch, "text").to_pylist(), W.column(batch, "places").to_pylist(), strict=True):
            lines = _lines_of(text) if text is not None else []
            gone = {int(p) for raw in places or () for p in np.frombuffer(raw, "<i4")}
            counts.append(len(lines))
            removed.append(len(gone))
            texts.append(None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
        yield pa.RecordBatch.from_arrays(
            [W.column(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
            ["doc_id", "n_lines", "n_removed", "text"])


def _align(pairs: DataFrame, lined: DataFrame, least: int, last: bool = False) -> DataFrame:
    """One row per pair of documents of (line, doc_id, t, first_id, first_t); the last pass needs no windows."""
    later = lined.select("doc_id", "t", F.col("lines").alias("y"), "words")
    first = lined.select(F.col("doc_id").alias("first_id"), F.col("t").alias("first_t"), F.col("lines").alias("x"))
    return _joined(pairs, later, first, least, last)


def _align_some(pairs: DataFrame, lined: DataFrame, least: int, last: bool = False) -> DataFrame:
    """The same for pairs, written before, of few of the documents: the others are passed over before the shuffle."""
    later = lined.select("doc_id", "t", F.col("lines").alias("y"), "words").join(pairs.select("doc_id", "t"), ["doc_id", "t"], "left_semi")
    first = lined.select(F.col("doc_id").alias("first_id"), F.col("t").alias("first_t"), F.col("lines").alias("x")).join(
        pairs.select("first_id", "first_t"), ["first_id", "first_t"], "left_semi")
    return _joined(pairs, later, first, least, last)


def _joined(pairs: DataFrame, later: DataFrame, first: DataFrame, least: int, last: bool) -> DataFrame:
    pair = ["doc_id", "t", "first_id", "first_t"]
    once = pairs.select(*pair).distinct().withColumn("keys", F.array().cast("array<long>")) if last else pairs.groupBy(*pair).agg(F.collect_set("line").alias("keys"))
    return once.hint("merge").join(later, ["doc_id", "t"]).hint("merge").join(first, ["first_id", "first_t"]).mapInArrow(
        _aligned(least), "doc_id long, t long, places binary, left array<long>")


def _open_windows(places: DataFrame, lined: DataFrame, least: int) -> DataFrame:
    """line, doc_id, t of all windows of which the pairs with first holders left a line."""
    left = places.filter(F.size("left") > 0).select("doc_id", "t").distinct()
    per_text = places.join(left, ["doc_id", "t"]).groupBy("doc_id", "t").agg(F.collect_list("places").alias("places"), F.collect_list("left").alias("left"))
    later = lined.select("doc_id", "t", F.col("lines").alias("y"), "words")
    return written(per_text.join(later, ["doc_id", "t"]).mapInArrow(_open(least), "line long, doc_id long, t long"), "open")


def _as_often(rest: DataFrame, keys: DataFrame) -> DataFrame:
    """Each open window with the first document that has it at least as often, and the earlier such one with the fewest different lines.

    Per window and number of places, only the first document of a size counts, and only if no smaller one is earlier."""
    own = keys.join(rest, ["line", "doc_id", "t"], "left_semi").select("line", "doc_id", "t", "often")
    firsts = keys.join(rest.select("line"), "line", "left_semi").groupBy("line", "often", "size").agg(F.min(F.struct("doc_id", "t")).alias("first"))
    often = own.select("line", "often").distinct()
    sizes = often.join(firsts.withColumnRenamed("often", "has"), "line").filter("has >= often").groupBy("line", "often", "size").agg(F.min("first").alias("first"))
    smaller = Window.partitionBy("line", "often").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    front = sizes.withColumn("before", F.min("first").over(smaller)).filter("before is null or first < before").drop("before")
    both = own.hint("merge").join(front, ["line", "often"]).filter("first < struct(doc_id, t)").groupBy("line", "doc_id", "t").agg(
        F.min("first").alias("a"), F.min(F.struct("size", "first")).alias("b"))
    return both.select("line", "doc_id", "t", F.explode(F.array_distinct(F.array("a", "b.first"))).alias("first")).select(
        "line", "doc_id", "t", F.col("first.doc_id").alias("first_id"), F.col("first.t").alias("first_t"))


def _other_pairs(rest: DataFrame, keys: DataFrame, lined: DataFrame) -> DataFrame:
    """Each open window with all its earlier holders; of holders that align alike with every such document, the first."""
    holders = written(keys.select("line", "doc_id", "t").join(rest.select("line").distinct(), "line", "left_semi"), "holders")
    is_open = rest.select("doc_id", "t").distinct().withColumn("is_open", F.lit(True))
    texts = written(
        lined.join(holders.select("doc_id", "t").distinct(), ["doc_id", "t"]).join(is_open, ["doc_id", "t"], "left")
        .select("doc_id", "t", "lines", F.coalesce("is_open", F.lit(False)).alias("is_open")), "holding")
    lines = texts.mapInArrow(_different_lines, "h long, doc_id long, t long, is_open boolean")
    shared = lines.groupBy("h").agg(F.count("*").alias("n"), F.max("is_open").alias("open")).filter("n > 1 and open").select("h")
    own = lines.join(shared, "h").groupBy("doc_id", "t").agg(F.collect_list("h").alias("shared"))
    shapes = written(texts.join(own, ["doc_id", "t"], "left").mapInArrow(_shapes, "doc_id long, t long, shape binary"), "shapes")
    alike = shapes.groupBy("shape").agg(F.min(F.struct("doc_id", "t")).alias("first")).select(
        F.col("first.doc_id").alias("doc_id"), F.col("first.t").alias("t"))
    firsts = holders.join(alike, ["doc_id", "t"]).select("line", F.col("doc_id").alias("first_id"), F.col("t").alias("first_t"))
    return rest.hint("merge").join(firsts, "line").filter("struct(first_id, first_t) < struct(doc_id, t)")


def drop_aligned_lines(docs: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and the cleaned text, one row per row of docs.

    Earlier means a smaller id; rows of one id with different texts are ordered by a hash of
    the text, rows without an id come last. Rows equal in id and text are one document: all
    keep or lose the same lines. Lines are compared byte by byte; those without words are
    aligned along, but no pair begins at one. A missing text stays missing with 0 lines, an empty one
    is one line. Other columns are not read; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    texts = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(2**63 - 1)).alias("doc_id"), docs[id_col].isNull().alias("no_id"), docs[text_col].cast("string").alias("text"),
    ).withColumn("t", F.xxhash64("text"))
    lined = written(
        texts.mapInArrow(_line_rows, "doc_id long, t long, lines binary, words binary").dropDuplicates(["doc_id", "t"]), "lines")
    keys = written(lined.mapInArrow(_line_keys(block_words), "line long, doc_id long, t long, often long, size long"), "windows")
    firsts = keys.groupBy("line").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.max(F.struct("doc_id", "t")).alias("last")).filter("first != last").select(
        "line", F.col("first.doc_id").alias("first_id"), F.col("first.t").alias("first_t"))
    pairs = keys.drop("often", "size").hint("merge").join(firsts, "line").filter("doc_id != first_id or t != first_t")
    places = written(_align(pairs, lined, block_words), "aligned")
    rest = _open_windows(places, lined, block_words)
    if rest.take(1):
        more = written(_align_some(written(_as_often(rest, keys), "as-often"), lined, block_words), "aligned")
        places = places.unionByName(more)
        rest = _open_windows(places.join(rest.select("doc_id", "t").distinct(), ["doc_id", "t"], "left_semi"), lined, block_words)
    if rest.take(1):
        others = written(_other_pairs(rest, keys, lined).select("doc_id", "t", "first_id", "first_t").distinct(), "others")
        places = places.unionByName(_align_some(others, lined, block_words, last=True))
    per_text = places.filter(F.octet_length("places") > 0).groupBy("doc_id", "t").agg(F.collect_list("places").alias("places"))
    joined = texts.hint("merge").join(per_text, ["doc_id", "t"], "left")
    return joined.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text", "places").mapInArrow(
        _cleaned, "doc_id long, n_lines long, n_removed long, text string")
