"""Quality by nearest labelled neighbours among latent-semantic vectors.

A text is a vector of hashed terms: its words, the shapes of its words (runs of upper and
lower case, digits, signs) and what share of its runs of three words are repeats. Weights use the document
frequencies of the whole table. The latent directions come from a bounded, balanced sample of
labelled texts; the vectors of that sample are sent to all tasks, and every text is compared
with all of them, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import words as W
from tablewright.llm.shared import ids_and_texts, ship

#: Terms: hashed words, then hashed shapes, then one for each share of repeats that is exceeded,
#: which counts like a term that stands so often in the text.
WORD_TERMS, SHAPE_TERMS = 3072, 1022
REPEATS, REPEAT_COUNT = (0.3, 0.6), 1000.0
TERMS = WORD_TERMS + SHAPE_TERMS + len(REPEATS)
#: Labelled texts per class that are used at most; directions; neighbours that vote.
PER_CLASS, DIRECTIONS, NEIGHBOURS = 2000, 64, 25
THRESHOLD = 0.3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 65, 97, 48, 97


def term_counts(texts: pa.Array) -> np.ndarray:
    """Dense counts of the terms, one row per text."""
    found = W.words_of(texts)
    n = len(found.first) - 1
    out = np.zeros((n, TERMS), dtype=np.float32)
    if not len(found.starts):
        return out
    owner = np.repeat(np.arange(n), found.counts)
    hashes = found.hashes()
    shape = _CLASS[found.data]
    new = np.ones(len(shape), dtype=bool)
    new[1:] = shape[1:] != shape[:-1]
    new[found.starts] = True
    at = np.concatenate(([0], np.cumsum(new)))
    shapes = W.range_hash(W.hash_prefix(shape[new]), at[found.starts], at[found.ends])
    terms = np.concatenate((hashes % np.uint64(WORD_TERMS), shapes % np.uint64(SHAPE_TERMS) + np.uint64(WORD_TERMS))).astype(np.int64)
    out += np.bincount(np.concatenate((owner, owner)) * TERMS + terms, minlength=n * TERMS).reshape(n, TERMS)
    runs, bounds = W.shingles(hashes, found.first, 3)
    _, kept = W.sorted_sets(runs, bounds)
    share = 1 - np.diff(kept) / np.maximum(np.diff(bounds), 1)
    share[np.diff(bounds) == 0] = 0
    for i, least in enumerate(REPEATS):
        out[:, WORD_TERMS + SHAPE_TERMS + i] = (share > least) * REPEAT_COUNT
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(TERMS, dtype=np.int64), 0
    for batch in W.pieces(batches):
        counts = term_counts(W.column(batch, "text"))
        total += (counts > 0).sum(axis=0)
        rows += len(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.concatenate(([rows], total)))], ["term", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.pieces(batches):
        counts = term_counts(W.column(batch, "text"))
        row, term = np.nonzero(counts)
        at = np.searchsorted(row, np.arange(len(counts) + 1))
        yield pa.RecordBatch.from_arrays(
            [W.column(batch, "doc_id"), W.column(batch, "label"), W.binary(term.astype("<u2"), at), W.binary(counts[row, term].astype("<f4"), at)],
            ["doc_id", "label", "terms", "counts"])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithmic counts times idf, each row of length 1 (0 for an empty text)."""
    rows = np.zeros_like(counts)
    there = counts > 0
    rows[there] = 1 + np.log(counts[there])
    rows *= idf
    return _unit(rows)


def directions(rows: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors, found with a random projection and two power steps."""
    n = min(n, *rows.shape)
    random = np.random.default_rng(seed).standard_normal((rows.shape[1], min(n + 16, rows.shape[0]))).astype(np.float32)
    basis = rows @ random
    for _ in range(2):
        basis = rows @ (rows.T @ np.linalg.qr(basis)[0])
    basis = np.linalg.qr(basis)[0]
    return np.ascontiguousarray(np.linalg.svd(basis.T @ rows, full_matrices=False)[2][:n].T)


def _scored(model: tuple, k: int, text_col: str = "text"):
    """Adds the score to every row; all columns go through."""
    idf, axes, known, labels, otherwise = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = min(k, len(known))
        for batch in W.pieces(batches, text_col, W.PIECE // 2):
            vectors = _unit(weighted(term_counts(W.column(batch, text_col)), idf) @ axes)
            score = np.full(len(vectors), otherwise)
            for a in range(0, len(vectors), 256):
                cosine = vectors[a : a + 256] @ known.T
                at = np.argpartition(cosine, len(known) - near, axis=1)[:, len(known) - near :]
                weight = np.maximum(np.take_along_axis(cosine, at, axis=1), 0).astype(np.float64) ** 4
                total = weight.sum(axis=1)
                some = total > 0
                score[a : a + 256][some] = (weight * labels[at]).sum(axis=1)[some] / total[some]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(score, 0.0, 1.0))], [*batch.schema.names, "score"])
    return run


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS,
) -> tuple:
    """Idf, directions, vectors and labels of the sample, and the score of an empty text.

    The sample: `per_class` labelled texts of each class at most, those with the smallest
    hashes of their id, none of them held out (crc32 of the id mod 5 is 0). Rows of labels
    without id or label do not count, repeated ones once (an id with both labels as 1).
    """
    spark = docs.sparkSession
    ship(spark)
    texts = ids_and_texts(docs, id_col, text_col)
    usable = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).filter(
        "doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")).filter(~held_out(F.col("doc_id")))
    # Only labels whose document is in the table; ids are joined without their texts.
    usable = usable.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = None
    for label in (0, 1):
        some = usable.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    # 2 * per_class rows at most.
    picked = spark.createDataFrame(chosen.collect(), "doc_id long, label int")
    sample = texts.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).mapInArrow(
        _sparse, "doc_id long, label int, terms binary, counts binary").collect()
    sample.sort(key=lambda r: r["doc_id"])
    frequency = np.zeros(TERMS + 1)
    for row in texts.mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        frequency[row["term"] + 1] = row["n"]
    idf = np.log((1 + frequency[0]) / (1 + frequency[1:])).astype(np.float32) + np.float32(1)
    if not sample:
        return idf, np.zeros((TERMS, 1), np.float32), np.zeros((1, 1), np.float32), np.zeros(1), 0.5
    counts = np.zeros((len(sample), TERMS), dtype=np.float32)
    for i, row in enumerate(sample):
        counts[i, np.frombuffer(row["terms"], "<u2")] = np.frombuffer(row["counts"], "<f4")
    known = np.array([r["label"] for r in sample], dtype=np.float64)
    rows = weighted(counts, idf)
    axes = directions(rows, DIRECTIONS)
    return idf, axes, _unit(rows @ axes), known, float(known.mean())


def neighbour_scores(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    per_class: int = PER_CLASS, neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted, one row per row of docs.

    The model is fitted here, see `fit`. Missing, empty and blank texts, and all texts where no
    label is known, get the share of label 1 among the labels used, 0.5 without any. Rows
    without an id are scored like others. Other columns are not read; an empty table gives no
    rows.
    """
    model = fit(docs, labels, label_col, id_col, text_col, per_class)
    scored = ids_and_texts(docs, id_col, text_col).mapInArrow(_scored(model, neighbours), "doc_id long, text string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    per_class: int = PER_CLASS, neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """The rows of docs that are predicted good, with their columns; scored where they lie, without a join."""
    model = fit(docs, labels, label_col, id_col, text_col, per_class)
    names = [f"__{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in renamed.schema)}, score double"
    return renamed.mapInArrow(_scored(model, neighbours, text), schema).filter(F.col("score") >= THRESHOLD).drop("score").toDF(*docs.columns)
