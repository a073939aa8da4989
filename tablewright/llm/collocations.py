"""Phrases whose words stand together more often than their frequencies explain.

The texts are seen as a weighted de Bruijn graph: a place in a text is an edge between the
words it begins with and those it goes on with, and counts once, under its longest phrase only.

1. A sketch of fixed size counts runs of one, two and three words by hash. What a cell holds is
   never less than the count of a run in it, so runs in cells below the threshold can't be part
   of a frequent phrase; nothing else is left out.
2. Each place gives the longest phrase (five words at most) that the sketch allows and its piece
   has room for. Equal ones are counted as strings: the edges and their weights.
3. The flow through a shorter phrase is the sum of the weights of all edges that begin with it,
   those cut short by the end of a piece or by the sketch included.
4. Unary paths are compacted: a phrase whose whole flow goes on into one longer phrase, or comes
   from one, is part of that phrase and no entry of its own. `phrase_paths` follows such paths
   beyond five words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm import words as W
from tablewright.llm.shared import drop_written, ship, written

LONGEST = 5
THRESHOLD = 100
#: Cells of the sketch, one byte each in a task, one bit each on all executors (2 MB). With many more
#: runs than cells times threshold it excludes little: then more edges are counted, with the same result.
CELLS_LOG2 = 24
#: Cells that travel together.
CHUNK = 4096

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = W.is_separator(_BREAKS)
_SPLIT = W.is_separator(_BREAKS + b" \t")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = [np.uint64(k) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class _Piece:
    """Words of some texts, which of them follow each other inside a piece, and the sketch cells of their runs."""

    def __init__(self, batch: pa.RecordBatch, cells_log2: int):
        words = W.words_of(W.column(batch, "text"), _SPLIT)
        self.data, self.starts, self.ends = _LOWER[words.data], words.starts, words.ends
        n = len(self.starts)
        lang = W.column(batch, "lang").dictionary_encode()
        self.langs = lang.dictionary
        text = np.repeat(np.arange(batch.num_rows), words.counts)
        self.lang = np.asarray(lang.indices)[text] if n else np.zeros(0, np.int32)
        piece = np.cumsum(_BREAK[self.data], dtype=np.int64)[self.starts] if n else np.zeros(0, np.int64)
        self.follows = np.zeros(n, dtype=bool)
        self.follows[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
        shift = np.uint64(64 - cells_log2)
        names, at = W.bytes_of(self.langs)
        salt = W.range_hash(W.hash_prefix(names), at[:-1], at[1:])
        one = W.mixed(words.hashes() ^ salt[self.lang]) if n else np.zeros(0, np.uint64)
        two, three = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        two[:-1] = W.mixed(one[:-1] * _STEP[0] + one[1:] * _STEP[1])
        three[:-2] = W.mixed(one[:-2] * _STEP[1] + one[1:-1] * _STEP[2] + one[2:] * _STEP[0])
        self.cells = [(h >> shift).astype(np.int64) for h in (one, two, three)]
        self.twice = self.follows.copy()
        self.twice[:-1] &= self.follows[1:]
        self.twice[-1:] = False

    def runs(self) -> list[np.ndarray]:
        """Cells of all runs of one, two and three words inside a piece."""
        return [self.cells[0], self.cells[1][self.follows], self.cells[2][self.twice]]

    def longest(self, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word may be frequent, and how many words the longest possible phrase at it has."""
        one, two, three = [(allowed[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1 for c in self.cells]
        pair = two & self.follows & one
        pair[:-1] &= one[1:]
        triple = three & self.twice & pair
        triple[:-1] &= pair[1:]
        triple[-1:] = False
        length = one.astype(np.int64) + pair
        going = triple
        for k in range(LONGEST - 2):
            length += going
            if k < LONGEST - 3:
                going = going & np.concatenate((triple[k + 1 :], np.zeros(min(k + 1, len(triple)), bool)))
        return one, length

    def phrases(self, first: np.ndarray, length: np.ndarray) -> pa.Array:
        """The lowered words of runs, joined by single blanks."""
        sizes = self.ends - self.starts + 1
        at = np.concatenate(([0], np.cumsum(sizes)))
        joined = self.data[np.minimum(np.arange(at[-1]) + np.repeat(self.starts - at[:-1], sizes), max(0, len(self.data) - 1))]
        joined[at[1:] - 1] = 32
        begin = at[first]
        extent = at[first + length] - 1 - begin
        bounds = np.concatenate(([0], np.cumsum(extent)))
        raw = joined[np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], extent)]
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


def _pieces(batches: Iterator[pa.RecordBatch], cells_log2: int) -> Iterator[_Piece]:
    for batch in W.pieces(batches):
        piece = _Piece(batch, cells_log2)
        if len(piece.starts):
            yield piece


def _sketched(cells_log2: int):
    """Counts of runs by cell, up to 255, in chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << cells_log2, dtype=np.uint8)
        for piece in _pieces(batches, cells_log2):
            cells, n = np.unique(np.concatenate(piece.runs()), return_counts=True)
            counts[cells] = np.minimum(counts[cells] + n, 255)
        yield from _chunks(counts)
    return run


def _chunks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Chunks with a count: all their cells, or places (two bytes) and counts of those in use where that is shorter."""
    used = np.flatnonzero(counts)
    bounds = np.searchsorted(used, np.arange(0, len(counts) + 1, CHUNK))
    place, count = (used % CHUNK).astype("<u2"), counts[used]
    full = np.flatnonzero(np.diff(bounds))
    for part in np.array_split(full, max(1, len(full) // 256)):
        packed = [
            place[a:b].tobytes() + count[a:b].tobytes() if 3 * (b - a) < CHUNK else counts[k * CHUNK : (k + 1) * CHUNK].tobytes()
            for k, a, b in zip(part.tolist(), bounds[part].tolist(), bounds[part + 1].tolist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])


def _unpacked(packed: bytes) -> tuple[np.ndarray | slice, np.ndarray]:
    """Places and counts of a chunk as `_chunks` wrote it; a list of places is never as long as a chunk."""
    if len(packed) == CHUNK:
        return slice(None), np.frombuffer(packed, np.uint8)
    n = len(packed) // 3
    return np.frombuffer(packed, "<u2", n), np.frombuffer(packed, np.uint8, n, 2 * n)


def _summed(threshold: int):
    """One row per chunk: a bit for each cell that reaches the threshold. Rows of a chunk are in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(W.column(batch, "chunk").to_pylist(), W.column(batch, "counts"), strict=True):
                total = sums.setdefault(chunk, np.zeros(CHUNK, dtype=np.uint8))
                place, counts = _unpacked(packed.as_py())
                total[place] = np.minimum(total[place].astype(np.uint16) + counts, 255)
        for chunk, total in sums.items():
            bits = np.packbits(total >= min(threshold, 255), bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([bits], pa.binary())], ["chunk", "bits"])
    return run


def _counted(allowed, cells_log2: int):
    """(lang, k, phrase, n): words (k = 1), longest phrases (k words), and all words of a language (k = 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(allowed.value, dtype=np.uint8)
        for piece in _pieces(batches, cells_log2):
            one, length = piece.longest(bits)
            alone, linked = np.flatnonzero(one), np.flatnonzero(length > 1)
            first = np.concatenate((alone, linked))
            size = np.concatenate((np.ones(len(alone), np.int64), length[linked]))
            table = pa.table({
                "lang": pa.array(piece.lang[first]), "k": pa.array(size.astype(np.int32)), "phrase": piece.phrases(first, size)})
            table = table.group_by(["lang", "k", "phrase"], use_threads=False).aggregate([([], "count_all")])
            langs, total = np.unique(piece.lang, return_counts=True)
            found = [table.column(c).combine_chunks() for c in ("lang", "k", "phrase", "count_all")]
            counts = [pa.array(langs), pa.array(np.zeros(len(langs), np.int32)), pa.array([""] * len(langs)), pa.array(total)]
            for lang, k, phrase, n in (found, counts):
                yield pa.RecordBatch.from_arrays(
                    [piece.langs.take(lang), k, phrase, n.cast(pa.int64())], ["lang", "k", "phrase", "n"])
    return run


def _part(phrase: Column, k: Column) -> Column:
    """The first k words; for a negative k the last ones."""
    return F.call_function("substring_index", phrase, F.lit(" "), k)


def _allowed(texts: DataFrame, threshold: int, cells_log2: int):
    """The sketch as one bit per cell (a fixed number of bytes), sent to all executors."""
    spark: SparkSession = texts.sparkSession
    parts = texts.mapInArrow(_sketched(cells_log2), "chunk int, counts binary")
    parts = parts.repartition("chunk").mapInArrow(_summed(threshold), "chunk int, bits binary")
    bits = bytearray((1 << cells_log2) // 8)
    for row in parts.collect():
        bits[row["chunk"] * CHUNK // 8 : (row["chunk"] + 1) * CHUNK // 8] = row["bits"]
    return spark.sparkContext.broadcast(bytes(bits))


def phrase_counts(
    docs: DataFrame, threshold: int = THRESHOLD, text_col: str = "text", lang_col: str = "lang", cells_log2: int = CELLS_LOG2,
) -> DataFrame:
    """lang, k, phrase, n: all phrases of one to five words that occur `threshold` times or more, and
    the number of words of each language (k = 0, empty phrase).

    Words are lowered (A-Z) and lie between blanks and tabs inside pieces, which end at `.,;:!?` and line
    ends. Missing and blank texts have none; a missing language is `und`. Repeated rows count each.
    The table is written to the shared folder; the caller drops it.
    """
    ship(docs.sparkSession)
    texts = docs.select(
        F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text"))
    allowed = _allowed(texts, threshold, cells_log2)
    found = texts.mapInArrow(_counted(allowed, cells_log2), "lang string, k int, phrase string, n long")
    edges = written(found.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")), "edges")
    # The flow through a node: all edges that leave it, and what ends there.
    flow = edges.filter(F.col("k") == LONGEST)
    counts = edges.filter(F.col("k") < 2).unionByName(flow)
    for k in range(LONGEST - 1, 1, -1):
        onward = flow.select("lang", F.lit(k).alias("k"), _part(F.col("phrase"), F.lit(k)).alias("phrase"), "n")
        flow = edges.filter(F.col("k") == k).unionByName(onward).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
        counts = counts.unionByName(flow)
    out = written(counts.filter((F.col("k") == 0) | (F.col("n") >= threshold)), "phrases")
    drop_written(edges)
    return out


def collocations(
    docs: DataFrame, threshold: int = THRESHOLD, top: int = 2000, text_col: str = "text", lang_col: str = "lang",
    cells_log2: int = CELLS_LOG2,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of two to five words with the highest scores of each language.

    a, l and r count a phrase and its parts before and behind a cut, n all words of the language;
    the score is floor(1000 a n / (l r)) at the cut where that is least, the first of equal ones.
    Phrases whose every occurrence is part of one longer phrase (of five words at most) are left
    out. Equal scores: more occurrences first, then the phrase in order of its bytes. Texts as in
    `phrase_counts`. Without a frequent phrase there are no rows.
    """
    counts = phrase_counts(docs, threshold, text_col, lang_col, cells_log2)
    known = counts.filter("k > 0")
    phrases = known.filter("k > 1")
    # Compact unary paths: all flow of a phrase goes through one that is a word longer, at either end.
    longer = known.filter("k > 2")
    inner = longer.select(
        "lang", F.explode(F.array(
            _part(F.col("phrase"), F.col("k") - 1), _part(F.col("phrase"), 1 - F.col("k")))).alias("phrase"), "n")
    kept = phrases.join(inner, ["lang", "phrase", "n"], "left_anti")
    cuts = kept.select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut",
        _part(F.col("phrase"), F.col("cut")).alias("before"), _part(F.col("phrase"), F.col("cut") - F.col("k")).alias("behind"))
    part = known.select("lang", "phrase", "n")
    cuts = cuts.join(part.withColumnsRenamed({"phrase": "before", "n": "l"}), ["lang", "before"])
    cuts = cuts.join(part.withColumnsRenamed({"phrase": "behind", "n": "r"}), ["lang", "behind"])
    cuts = cuts.join(counts.filter("k = 0").select("lang", F.col("n").alias("n")), "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r", "n")}
    # Products of two counts fit decimals of 38 digits, where 64 bits would overflow.
    over = (F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"]).cast("decimal(38,0)")
    score = F.call_function("div", over, (wide["l"] * wide["r"]).cast("decimal(38,0)"))
    least = F.min(F.struct(score.cast("long").alias("score"), "cut", "l", "r", "n")).alias("s")
    scored = cuts.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "s.l", "s.r", "s.n", "s.score")
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    out = written(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    drop_written(counts)
    return out


def phrase_paths(
    docs: DataFrame, threshold: int = THRESHOLD, text_col: str = "text", lang_col: str = "lang", cells_log2: int = CELLS_LOG2,
) -> DataFrame:
    """lang, phrase, words, n: unary paths of edges of five words, as phrases of five words or more.

    An edge goes on into the next one where no occurrence of either leaves the path at the node of
    four words between them. Paths are numbered from their heads by doubling the pointers to the
    edges before, so their length costs a logarithm of rounds; one path is no longer than a piece.
    """
    counts = phrase_counts(docs, threshold, text_col, lang_col, cells_log2)
    edges = counts.filter(F.col("k") == LONGEST).select(
        "lang", "phrase", "n", _part(F.col("phrase"), F.lit(LONGEST - 1)).alias("into"), _part(F.col("phrase"), F.lit(1 - LONGEST)).alias("out"))
    nodes = counts.filter(F.col("k") == LONGEST - 1).select("lang", F.col("phrase").alias("into"), "n")
    before = edges.select("lang", F.col("out").alias("into"), "n", F.col("phrase").alias("before"))
    # Equal flow before, at and behind the node: the only way in and the only way out.
    linked = edges.join(nodes, ["lang", "into", "n"], "left_semi").join(before, ["lang", "into", "n"]).select("lang", "phrase", "before")
    at = written(
        edges.join(linked, ["lang", "phrase"], "left")
        .select("lang", "phrase", "n", F.coalesce("before", "phrase").alias("head"), F.col("before").isNotNull().cast("long").alias("place")), "paths")
    while True:
        step = at.select("lang", F.col("phrase").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        new = written(
            at.join(step, ["lang", "head"]).select("lang", "phrase", "n", F.col("further").alias("head"), (F.col("place") + F.col("more")).alias("place")),
            "paths")
        moved = not new.join(at.select("lang", "phrase", F.col("head").alias("was")), ["lang", "phrase"]).filter("head <> was").isEmpty()
        drop_written(at)
        at = new
        if not moved:
            break
    last = F.when(F.col("place") > 0, F.substring_index("phrase", " ", -1)).otherwise(F.col("phrase"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("place", last.alias("word")))), lambda s: s.word)
    paths = at.groupBy("lang", "head").agg(words.alias("w"), F.min("n").alias("n"))
    out = written(paths.select("lang", F.array_join("w", " ").alias("phrase"), (F.size("w") + LONGEST - 1).alias("words"), "n"), "paths")
    drop_written(at)
    drop_written(counts)
    return out


ORACLE = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
grams AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (
        SELECT lang, w, i, unnest(range(1, least({LONGEST}, len(w) - i + 1) + 1)) AS k FROM (
            SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words))
    GROUP BY ALL HAVING count(*) >= {THRESHOLD}),
split AS (SELECT *, string_split(phrase, ' ') AS w FROM grams),
inner_phrases AS (
    SELECT DISTINCT lang, f, array_to_string(w[i:j], ' ') AS phrase FROM (
        SELECT lang, f, w, i, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM split))
    WHERE j - i + 1 < len(w)),
kept AS (SELECT * FROM split ANTI JOIN inner_phrases USING (lang, phrase, f) WHERE k > 1),
cuts AS (
    SELECT lang, phrase, f AS a, c, array_to_string(w[1:c], ' ') AS before, array_to_string(w[c + 1:], ' ') AS behind
    FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
scored AS (
    SELECT cuts.lang, cuts.phrase, a, c, x.f AS l, y.f AS r, CAST(n AS HUGEINT) AS n,
           (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
    FROM cuts JOIN grams x ON x.lang = cuts.lang AND x.phrase = before
              JOIN grams y ON y.lang = cuts.lang AND y.phrase = behind JOIN total ON total.lang = cuts.lang),
least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, CAST(row_number() OVER best AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM least_cut WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER best <= 2000"""
