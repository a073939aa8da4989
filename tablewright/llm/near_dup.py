"""Near-duplicate documents: SuperMinHash signatures, banding, verified links, components.

SuperMinHash gives every shingle a random permutation of the signature's places and takes
rank + fraction at each, so the ranks of one shingle are correlated and the estimate varies
less than with independent minima. A shingle's later ranks can't win once every place holds
a lower one; that ends the rounds early, after the first for long texts.

Whole shingle sets decide about a link; signatures only propose it:

1.  Texts with equal sets form a class, and only its smallest id goes on.
2.  In each bucket of a band the members are compared with the smallest one, and the
    accepted links are joined to components: linear, however large the bucket.
3.  Only buckets that still hold more than one component are compared pairwise, across
    components and in square blocks; all but likely links are refused inside the task.

A link is missed only if no band agrees (5e-8 at the threshold) or the signatures differ
in more than 40 % of their places (5 standard deviations at the threshold).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm import words as W
from tablewright.llm.components import components
from tablewright.llm.shared import drop_written, ids_and_texts, ship, written

PLACES = 128
BAND_ROWS = 4
#: Least share of equal places for which a pair across components is verified.
LEAST_ESTIMATE = 0.6
#: Members of a bucket that one block holds.
BLOCK = 1000

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def super_minhash(hashes: np.ndarray, bounds: np.ndarray, places: int = PLACES) -> np.ndarray:
    """One row of `places` values (rank << 32 | fraction) for each run of hashes."""
    n_texts = len(bounds) - 1
    signature = np.full(n_texts * places, _NONE, dtype=np.uint64)
    text = np.repeat(np.arange(n_texts), np.diff(bounds))
    order = None
    for rank in range(places):
        if not len(hashes):
            break
        drawn = W.mixed(hashes + np.uint64(rank + 1) * np.uint64(0xD6E8FEB86659FD93)) if rank < 1 else W.mixed(
            hashes + np.full(1, rank + 1, np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        other = rank + (((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(places - rank)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            place = other
        else:
            row = np.arange(len(hashes))
            place = order[row, other].astype(np.int64)
            order[row, other] = order[:, rank]
        np.minimum.at(signature, text * places + place, np.uint64(rank << 32) | (drawn >> np.uint64(32)))
        highest = signature.reshape(n_texts, places).max(axis=1) >> np.uint64(32)
        on = highest[text] > rank
        if order is not None:
            hashes, text, order = hashes[on], text[on], order[on]
        else:
            hashes, text, other = hashes[on], text[on], other[on]
            order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(hashes), 1))
            order[np.arange(len(hashes)), other] = 0
    return signature.reshape(n_texts, places)


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    found = W.words_of(W.column(batch, "text"))
    return W.sorted_sets(*W.shingles(found.hashes(), found.first, k))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            hashes, bounds = _sets(batch, k)
            signature = (W.mixed(super_minhash(hashes, bounds).ravel()) >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    W.column(batch, "doc_id"), pa.array(np.diff(bounds)),
                    pa.array(_sums(W.mixed(hashes), bounds)), pa.array(_sums(W.mixed(hashes ^ np.uint64(0xA5A5A5A5)), bounds)),
                    W.binary(signature, np.arange(len(bounds)) * PLACES),
                ],
                ["doc_id", "n_shingles", "d1", "d2", "signature"],
            )
    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            yield pa.RecordBatch.from_arrays([W.column(batch, "doc_id"), W.binary(*_sets(batch, k))], ["doc_id", "shingles"])
    return run


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and row; the band is part of it."""
    rows = signatures.reshape(len(signatures), -1, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(rows.shape[1], dtype=np.uint64), rows.shape[:2])
    for j in range(BAND_ROWS):
        key = W.mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return key


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_bands = PLACES // BAND_ROWS
    for batch in batches:
        values, _ = W.runs(W.column(batch, "signature"), np.uint32)
        keys = _band_keys(values.reshape(-1, PLACES))
        ids = np.repeat(np.asarray(W.column(batch, "rep")), n_bands)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "rep"])


def _accepted(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xb), (y, yb) = (W.runs(W.column(batch, c), np.uint64) for c in ("x", "y"))
            keep = []
            for i in range(batch.num_rows):
                a, b = x[xb[i] : xb[i + 1]], y[yb[i] : yb[i + 1]]
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                common = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) else 0
                keep.append(len(a) > 0 and 100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
    return run


def _shingle_sets(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The whole set of every document that a pair names. The texts are shuffled once; the
    join is the same at every size."""
    ids = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
    named = texts.hint("merge").join(ids, "doc_id", "left_semi")
    return written(named.mapInArrow(_set_rows(k), "doc_id long, shingles binary").dropDuplicates(["doc_id"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("y"))
    joined = pairs.hint("merge").join(right, "v").hint("merge").join(left, "u")
    return written(joined.mapInArrow(_accepted(percent), "u long, v long"), "links")


def _likely_pairs(percent: int):
    """Pairs across components that share this bucket as their first and look similar enough."""

    def run(table: pa.Table) -> pa.Table:
        values, _ = W.runs(table["signature"], np.uint32)
        signatures = values.reshape(-1, PLACES)
        rep, part, size, chunk = (table[c].to_numpy() for c in ("rep", "component", "n_shingles", "chunk"))
        key, tile = table["key"][0].as_py(), (table["i"][0].as_py(), table["j"][0].as_py())
        order = np.argsort(part, kind="stable")
        signatures, rep, part, size, chunk = signatures[order], rep[order], part[order], size[order], chunk[order]
        band = int(np.flatnonzero(_band_keys(signatures[:1]).view(np.int64)[0] == key)[0])
        keys = signatures.reshape(len(rep), -1, BAND_ROWS)
        after = np.searchsorted(part, part, side="right")
        us, vs = [], []
        for i in range(len(rep)):
            j = np.arange(after[i], len(rep))
            if tile[0] != tile[1]:
                j = j[chunk[j] != chunk[i]]
            j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
            if len(j):
                j = j[(signatures[j] == signatures[i]).sum(axis=1) >= LEAST_ESTIMATE * PLACES]
            if len(j):
                j = j[(keys[j] == keys[i]).all(axis=2).argmax(axis=1) == band]
                us.append(np.full(len(j), i))
                vs.append(j)
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        named = np.union1d(u, v)
        return pa.table({
            "key": np.full(len(named), key), "i": np.full(len(named), tile[0], np.int32), "j": np.full(len(named), tile[1], np.int32),
            "doc_id": rep[named], "partners": W.binary(rep[v], np.concatenate((np.searchsorted(u, named), [len(u)]))),
        })
    return run


def _block_links(percent: int):
    """Links of one block: listed pairs checked on whole sets, reduced to a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy()
        table = table.take(pa.array(np.argsort(ids, kind="stable")))
        ids = np.sort(ids)
        values, bounds = W.runs(table["shingles"], np.uint64)
        partners, at = W.runs(table["partners"], np.int64)
        distinct, coded = np.unique(values, return_inverse=True)
        there, size = np.zeros(len(distinct), dtype=bool), np.diff(bounds)
        root = list(range(len(ids)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for i in range(len(ids)):
            others = np.searchsorted(ids, partners[at[i] : at[i + 1]])
            if not len(others):
                continue
            there[coded[bounds[i] : bounds[i + 1]]] = True
            ends = np.cumsum(size[others])
            places = np.arange(ends[-1]) + np.repeat(bounds[others] - (ends - size[others]), size[others])
            common = np.add.reduceat(there[coded[places]].astype(np.int64), ends - size[others])
            there[coded[bounds[i] : bounds[i + 1]]] = False
            for o in others[100 * common >= percent * (size[i] + size[others] - common)].tolist():
                a, b = top(i), top(o)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links.append((ids[i], ids[o]))
        found = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": found[:, 0], "v": found[:, 1]})
    return run


def _across(members: DataFrame, found: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components in the buckets that hold several. A document is sent to a block
    once with its set and the list of those it may be linked with, never once per pair."""
    placed = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("key").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size"),
    ).filter("a != b").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("chunks"))
    rows = (
        placed.join(mixed, "key")
        .withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", "rep", "component", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
        .join(reps.select("rep", "n_shingles", "signature"), "rep")
    )
    likely = rows.groupBy("key", "i", "j").applyInArrow(
        _likely_pairs(percent), "key long, i int, j int, doc_id long, partners binary")
    return likely.join(sets, "doc_id").groupBy("key", "i", "j").applyInArrow(_block_links(percent), "u long, v long")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept, one row per row of docs.

    A link: 100 * intersection >= percent * union of the sets of `words`-word shingles of the
    A-Z-lowered text. Texts that are missing, empty or blank have an empty set and no link.
    A shorter text is one shingle. Rows without an id are kept with a missing component;
    repeated rows of one id share its answer. Other columns are not read, whatever their
    names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = ids_and_texts(docs, id_col, text_col)
    signed = written(
        texts.mapInArrow(_signed(words), "doc_id long, n_shingles long, d1 long, d2 long, signature binary"), "signed")
    reps = written(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles")
        .agg(F.min(F.struct(F.col("doc_id").alias("rep"), "signature")).alias("first"))
        .select("d1", "d2", "n_shingles", "first.rep", "first.signature"), "classes")
    bands = reps.select("rep", "signature").mapInArrow(_band_rows, "key long, rep long")
    pivots = bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).filter("pivot != last")
    members = written(bands.join(pivots.select("key", "pivot"), "key"), "members")
    stars = members.filter("rep != pivot").select(F.col("pivot").alias("u"), F.col("rep").alias("v"))
    pairs = written(stars.distinct(), "pairs")
    sets = _shingle_sets(pairs, texts, words)
    links = _verified(pairs, sets, percent)
    found = written(components(links), "components")
    more = written(_across(members, found, reps, sets, percent), "links")
    if more.take(1):
        found = written(components(links.unionByName(more)), "components")
    whole = reps.select("d1", "d2", "n_shingles", "rep").join(
        found.withColumnRenamed("node", "rep"), "rep", "left",
    ).select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    for done in (members, pairs, sets):
        drop_written(done)
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(whole, ["d1", "d2", "n_shingles"], "left")
    return out.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay when one document of each group is kept, with their columns.

    Of repeated rows of one id a single one stays; rows without an id all stay.
    """
    own = {c: f"__column_{i}" for i, c in enumerate(docs.columns)}
    renamed, key, text = docs.toDF(*own.values()), own[id_col], own[text_col]
    gone = near_duplicates(docs, words, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    left = renamed.hint("merge").join(gone, F.col(key) == F.col("gone"), "left_anti")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(text), text))
    return left.withColumn("nth", nth).filter(F.col(key).isNull() | (F.col("nth") == 1)).select(*[F.col(name).alias(c) for c, name in own.items()])
