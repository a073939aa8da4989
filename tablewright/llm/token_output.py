"""Token ids of documents as checksummed binary segments, in ascending id order, and back.

Texts are encoded by a public tokenizer file with the tokenizers library. Its ids depend on
one stretch between blanks at a time (white space is dropped before ids are looked up), so
every task encodes each distinct stretch once and looks the others up in arrays.

One row of the output holds one segment: ids of whole documents, coded by `range_coder`, with
a directory of documents and lengths. Rows are written by Spark's own Parquet writer, whose
commit survives lost tasks; a partition holds a range of document ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm import range_coder
from tablewright.llm import words as W
from tablewright.llm.shared import ids_and_texts, ship

END = 2
#: A segment ends with the document that brings it to so many ids.
SEGMENT = 6_000_000
#: Distinct stretches that a Python worker remembers at most; then it starts anew.
REMEMBERED = 800_000
#: Texts are encoded in pieces of about so many bytes: the arrays of a piece take some 60 times as much.
PIECE = 1_000_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = W.is_separator(b".,;:!?")


#: Fixed value: runs of letters, single digits and runs of other characters, as the tokenizer file has it.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _splits_at_letters(tokenizer) -> bool:
    """Whether a stretch of ASCII letters reaches the model in one piece, in lower case and otherwise unchanged."""
    import json

    steps = json.loads(tokenizer.to_str())
    parts = (steps.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = parts[0].get("pattern", {}).get("Regex") == _SPLIT and parts[0].get("invert") and parts[0].get("behavior") == "Removed"
    rest = [p["type"] == "ByteLevel" and not p["use_regex"] and not p["add_prefix_space"] for p in parts[1:]]
    normal = [n["type"] for n in (steps.get("normalizer") or {}).get("normalizers", [])]
    return bool(split and rest == [True] and normal == ["NFC", "Replace", "Lowercase"] and steps["model"]["type"] == "BPE")


class Encoder:
    """Ids of many texts at once; equal to encoding each text with the library."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else np.uint32
        self.gap = self._ids(["0"])[0]
        self.whole_words = _splits_at_letters(self.tokenizer)
        self._forget()

    def _forget(self) -> None:
        # Hashes of known stretches in order, and the place of each one's bounds.
        self.known, self.slot = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.bounds = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=self.dtype)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, stretches: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Which stretches in which order, all their ids, and how many each has. Many short texts
        go into one call: a lone digit between them is one id."""
        order, flat, sizes = [], [], []
        if self.whole_words:
            # Letters alone pass the steps before the model as they are.
            order = [k for k, s in enumerate(stretches) if s.isascii() and s.isalpha()]
            tokenize = self.tokenizer.model.tokenize
            found = [[t.id for t in tokenize(stretches[k].lower())] for k in order]
            flat = [np.array([i for ids in found for i in ids], dtype=self.dtype)]
            sizes = [np.array([len(ids) for ids in found], dtype=np.int64)]
        done = set(order)
        plain = [k for k, s in enumerate(stretches) if k not in done and "0" not in s and "<" not in s]
        rest = sorted(set(range(len(stretches))) - done - set(plain))
        if len(self.gap) == 1:
            groups = [plain[a : a + 200] for a in range(0, len(plain), 200)]
            for group, ids in zip(groups, self._ids([" 0 ".join([stretches[k] for k in g]) for g in groups]), strict=True):
                ids = np.array(ids, dtype=self.dtype)
                gap = ids == self.gap[0]
                cuts = np.flatnonzero(gap)
                if len(cuts) == len(group) - 1:
                    order += group
                    flat.append(ids[~gap])
                    sizes.append(np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1)
                else:
                    rest += group
        else:
            rest = sorted(set(range(len(stretches))) - done)
        for k, ids in zip(rest, self._ids([stretches[k] for k in rest]), strict=True):
            order.append(k)
            flat.append(np.array(ids, dtype=self.dtype))
            sizes.append([len(ids)])
        return order, np.concatenate(flat), np.concatenate(sizes).astype(np.int64)

    def _learn(self, hashes: np.ndarray, stretches: list[str]) -> None:
        """Remember stretches under their hashes, which are in order."""
        order, ids, sizes = self._encoded(stretches)
        n, used = len(self.known), int(self.bounds[len(self.known)])
        while len(self.bounds) < n + len(sizes) + 1:
            self.bounds = np.concatenate((self.bounds, np.zeros_like(self.bounds)))
        while len(self.ids) < used + len(ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.bounds[n + 1 : n + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.ids[used : used + len(ids)] = ids
        slots = np.empty(len(order), dtype=np.int64)
        slots[order] = np.arange(n, n + len(order))
        at = np.searchsorted(self.known, hashes)
        self.known, self.slot = np.insert(self.known, at, hashes), np.insert(self.slot, at, slots)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, an end id after each, and where each text's ids begin."""
        found = W.words_of(texts)
        data, starts, ends = found.data, found.starts, found.ends
        # A mark behind a letter is a stretch of its own.
        cut = (ends - starts > 1) & _MARK[data[ends - 1]] & _LETTER[data[np.maximum(ends - 2, 0)]]
        width = 1 + cut
        at = np.concatenate(([0], np.cumsum(width)))
        begin, stop = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
        begin[at[:-1]], stop[at[1:] - 1] = starts, ends
        stop[at[:-1][cut]] = begin[at[1:][cut] - 1] = ends[cut] - 1
        first = at[found.first]
        hashes = W.range_hash(W.hash_prefix(data, lower=True), begin, stop)
        special = np.unique(np.searchsorted(begin, np.flatnonzero(data == ord("<")), side="right") - 1)
        if len(special):  # special tokens are case-sensitive
            hashes[special] = ~W.range_hash(W.hash_prefix(data), begin[special], stop[special])
        distinct, place, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = np.arange(len(distinct))
        if len(new):
            where = place[new]
            self._learn(distinct[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin[where].tolist(), stop[where].tolist(), strict=True)])
        slots = self.slot[np.searchsorted(self.known, distinct)][inverse]
        sizes = self.bounds[slots + 1] - self.bounds[slots]
        before = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.bounds[slots] - before[:-1], sizes)
        at += np.arange(before[-1])
        ids = self.ids.take(at, mode="clip")
        bounds = before[first]
        ends_at = bounds[1:] + np.arange(len(bounds) - 1)
        out = np.empty(len(ids) + len(ends_at), dtype=self.dtype)
        own = np.ones(len(out), dtype=bool)
        own[ends_at] = False
        out[own], out[ends_at] = ids, END
        return out, bounds + np.arange(len(bounds))


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


_SEGMENTS = "partition int, segment int, n_docs long, n_ids long, doc_ids binary, lengths binary, missing_ids binary, data binary"


def _packed(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        partition, segment, held = context.partitionId() if context else 0, 0, []

        def row() -> pa.RecordBatch:
            names, lengths, ids = zip(*held, strict=True)
            all_ids, sizes = pa.concat_arrays(names), np.concatenate(lengths)
            values = [
                partition, segment, len(all_ids), int(sizes.sum()), np.asarray(all_ids.fill_null(0), dtype="<i8").tobytes(),
                sizes.astype("<i8").tobytes(), np.packbits(np.asarray(all_ids.is_null())).tobytes(),
                range_coder.encode(np.concatenate(ids)),
            ]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in _SEGMENTS.split(", ")])

        total = 0
        for batch in W.pieces(batches, size=PIECE):
            ids, bounds = _encoder(path).encode(W.column(batch, "text"))
            held.append((W.column(batch, "doc_id"), np.diff(bounds), ids))
            total += len(ids)
            if total >= SEGMENT:
                yield row()
                segment, held, total = segment + 1, [], 0
        if held:
            yield row()
    return run


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of all documents in ascending id order (rows without an id first).

    Rows of one id, or without one, are ordered by a hash of the text and then the text, so that reruns
    agree and many of them are dealt to several tasks.
    """
    ship(docs.sparkSession)
    texts = ids_and_texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    ordered = texts.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return ordered.mapInArrow(_packed(tokenizer_path), _SEGMENTS)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda name: W.column(batch, name)[row].as_py()  # noqa: B023, E731
            names, lengths = np.frombuffer(get("doc_ids"), "<i8"), np.frombuffer(get("lengths"), "<i8")
            missing = np.unpackbits(np.frombuffer(get("missing_ids"), np.uint8), count=len(names)).astype(bool)
            ids = range_coder.decode(get("data")).astype("<u4", copy=False)
            if len(ids) != lengths.sum():
                raise ValueError("the directory of a segment does not match its ids")
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(names), get("partition"), np.int32)), pa.array(np.full(len(names), get("segment"), np.int32)),
                    pa.array(names, mask=missing), pa.array(bounds[:-1]), pa.array(lengths), W.binary(ids, bounds),
                ],
                ["partition", "segment", "doc_id", "offset", "n_tokens", "ids"],
            )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _unpacked(batches):
        sums = [zlib.crc32(x.as_buffer()) for x in W.column(batch, "ids")]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(sums, pa.int64())], ["partition", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"])


def decode_documents(segments: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian 4-byte values), or ids_crc32 instead of ids.

    Checksums are verified; a damaged segment fails the job. start counts the ids of all
    earlier documents: sums per partition are few, and segments are summed inside their own.
    """
    sizes = segments.select("partition", "segment", "n_ids")
    per_partition = sizes.groupBy("partition").agg(F.sum("n_ids").alias("all_ids"))
    so_far = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, 0)
    ahead = per_partition.select("partition", (F.sum("all_ids").over(so_far) - F.col("all_ids")).alias("ahead"))
    inside = Window.partitionBy("partition").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    begins = sizes.withColumn("within", F.sum("n_ids").over(inside) - F.col("n_ids")).join(ahead, "partition").select(
        "partition", "segment", (F.col("ahead") + F.col("within")).alias("begin"))
    kind = "ids_crc32 long" if digests else "ids binary"
    rows = segments.mapInArrow(_digests if digests else _unpacked, f"partition int, segment int, doc_id long, offset long, n_tokens long, {kind}")
    return rows.join(begins, ["partition", "segment"]).select(
        "doc_id", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens", kind.split()[0])


def token_digests(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the segments to the folder, read them back, one row per row of docs.

    Missing and empty texts have the end id alone. Rows without an id come first; rows of one
    id stand next to each other in the order of a hash of their texts, each with its own ids. Other columns are not
    read. An empty table gives no segments and no rows.
    """
    encode_documents(docs, tokenizer_path, id_col, text_col).write.parquet(folder)
    return decode_documents(docs.sparkSession.read.schema(_SEGMENTS).parquet(folder), digests=True)
