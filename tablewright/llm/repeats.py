"""Byte strings that repeat anywhere in a corpus, from enhanced suffix arrays around shared anchors.

Every string of `length` bytes holds the same anchor wherever it stands: the K bytes in it
with the smallest hash. Neighbouring strings with one anchor form a stretch; anchors that
occur once are dropped, and equal stretches are counted together before anything is compared.

Stretches around one anchor are then sorted by what follows the anchor: a suffix array with
common prefix lengths, whose stack scan gives the tree of common-prefix intervals. In an
interval that shares r bytes to the right, members are compared by what precedes the anchor;
where the left extensions differ lie the ends of a maximal repeat, and a member's longest
extension l shared with another one gives the repeat of l + r bytes. All of at least `length`
bytes are reported, for every occurrence.

An anchor with very many different stretches is dealt out in chunks. Each chunk has its own
suffix array; strings that stand in two chunks are found by hashes, dealt out once more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import words as W
from tablewright.llm.shared import ship, written

ANCHOR = 32
#: Stretches of one anchor that are compared in one task; more are dealt out.
CHUNK = 2000
#: Stretches of many anchors that one task compares at a time.
BATCH = 5000

_PLACE = np.uint64((1 << 26) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int = ANCHOR) -> dict[str, np.ndarray]:
    """text, a (anchor hash), u (stretch hash), begin, size and d (anchor - begin) of every stretch."""
    n, w = len(data), length - k + 1
    names = ("text", "a", "u", "begin", "size", "d")
    if n < length:
        return {c: np.zeros(0, np.int64) for c in names}
    prefix = W.hash_prefix(data)
    at = np.arange(n - k + 1)
    hashes = W.range_hash(prefix, at, at + k)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = (at - offsets[text[: len(at)]]).astype(np.uint64) & _PLACE
    keys = np.full(-(-len(at) // w) * w, np.uint64(2**64 - 1), dtype=np.uint64)
    keys[: len(at)] = (hashes & ~_PLACE) | place
    blocks = keys.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows])
    start = np.arange(windows)
    anchor = start + (((least & _PLACE) - place[:windows]) & _PLACE).astype(np.int64)
    whole = start + length <= offsets[1:][text[:windows]]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
    last = whole.copy()
    last[:-1] &= ~whole[1:] | (anchor[1:] != anchor[:-1])
    begin, end = np.flatnonzero(new), np.flatnonzero(last) + length
    found = anchor[begin]
    return {
        "text": text[begin], "a": hashes[found].view(np.int64), "u": W.range_hash(prefix, begin, end).view(np.int64),
        "begin": begin - offsets[text[begin]], "size": end - begin, "d": found - begin,
    }


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            found = anchors(*W.bytes_of(W.column(batch, "text")), length)
            own = pa.array(found["text"])
            yield pa.RecordBatch.from_arrays(
                [
                    W.column(batch, "doc_id").take(own), W.column(batch, "t").take(own), pa.array(found["a"]), pa.array(found["u"]),
                    pa.array(found["begin"]), pa.array(found["size"], pa.int32()), pa.array(found["d"], pa.int32()),
                ],
                ["doc_id", "t", "a", "u", "begin", "size", "d"],
            )
    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their way through a shuffle."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in W.pieces(batches):
        data, offsets = W.bytes_of(W.column(batch, "text"))
        raw = data.tobytes()
        packed = [pack(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [W.column(batch, "doc_id"), W.column(batch, "t"), pa.array(packed, pa.binary())], ["doc_id", "t", "packed"])


def _unpack(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches of each text."""
    for batch in batches:
        rows: dict[str, list] = {c: [] for c in ("a", "u", "d", "chunks", "body")}
        for packed, wanted in zip(W.column(batch, "packed"), W.column(batch, "wanted"), strict=True):
            raw = _unpack(packed.as_py())
            for x in wanted.as_py():
                for c in ("a", "u", "d", "chunks"):
                    rows[c].append(x[c])
                rows["body"].append(raw[x["begin"] : x["begin"] + x["size"]])
        kinds = {"a": pa.int64(), "u": pa.int64(), "d": pa.int32(), "chunks": pa.int32(), "body": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(rows[c], kinds[c]) for c in kinds], list(kinds))


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    rows = np.zeros((len(parts), width), dtype=np.uint8)
    rows[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
    return rows, sizes


def _common(rows: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows x and y."""
    differ = rows[x] != rows[y]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(sizes[x], sizes[y]))


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(shared prefix, first, last) of the common-prefix interval tree, inner ones first.

    common[i]: prefix that the sorted entries i and i + 1 share; negative: none.
    """
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > value:
            shared, first = stack.pop()
            yield shared, first, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def repeats_at_anchors(groups: np.ndarray, bodies: list[bytes], d: np.ndarray, length: int) -> list[set[tuple[int, int]]]:
    """For each stretch, the parts [from, to) of at least `length` bytes that another of its group has too."""
    n = len(bodies)
    right = [b[x:] for b, x in zip(bodies, d.tolist(), strict=True)]
    order = np.array(sorted(range(n), key=lambda i: (groups[i], right[i])), dtype=np.int64)
    found: list[set[tuple[int, int]]] = [set() for _ in range(n)]
    if n < 2:
        return found
    after, after_sizes = _matrix(right, length)
    before, before_sizes = _matrix([b[:x][::-1] for b, x in zip(bodies, d.tolist(), strict=True)], length)
    by_left = np.empty(n, dtype=np.int64)
    by_left[sorted(range(n), key=lambda i: bodies[i][: d[i]][::-1])] = np.arange(n)
    common = _common(after, after_sizes, order[:-1], order[1:])
    common[groups[order[:-1]] != groups[order[1:]]] = -1
    for shared, first, last in intervals(common.tolist()):
        members = order[first : last + 1]
        if shared + int(before_sizes[members].max()) < length:
            continue
        members = members[np.argsort(by_left[members])]
        near = _common(before, before_sizes, members[:-1], members[1:])
        best = np.maximum(np.concatenate(([-1], near)), np.concatenate((near, [-1])))
        for i in np.flatnonzero(best + shared >= length).tolist():
            m = members[i]
            found[m].add((int(d[m] - best[i]), int(d[m] + shared)))
    return found


def _flat(spans) -> bytes:
    return np.array(sorted(spans), dtype="<i8").tobytes()


def _result(table: pa.Table, found: list[set[tuple[int, int]]]) -> pa.Table:
    keep = [i for i, x in enumerate(found) if x]
    own = pa.array(keep, pa.int64())
    return pa.table({"a": table["a"].take(own), "u": table["u"].take(own), "spans": pa.array([_flat(found[i]) for i in keep], pa.binary())})


def _compared(length: int):
    def run(table: pa.Table) -> pa.Table:
        return _result(table, repeats_at_anchors(table["a"].to_numpy(), table["body"].to_pylist(), table["d"].to_numpy(), length))
    return run


def _windows(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every string of `length` bytes, of which row, and where in its stretch. Strings of
    one anchor are equal only at equal distance from it, so the distance is part of the hash."""
    bodies = table["body"].to_pylist()
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    prefix = W.hash_prefix(np.frombuffer(b"".join(bodies), np.uint8))
    count = sizes - length + 1
    row = np.repeat(np.arange(len(bodies)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(sizes) - sizes)[row] + place
    return W.range_hash(prefix, start, start + length), row, place


def _dealt(length: int):
    """The hashes of one chunk, dealt out by value."""
    def run(table: pa.Table) -> pa.Table:
        chunks = table["chunks"][0].as_py()
        hashes = np.unique(_windows(table, length)[0])
        to = (hashes % np.uint64(chunks)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        bounds = np.searchsorted(to[order], np.arange(chunks + 1))
        same = lambda c, kind: pa.array([table[c][0].as_py()] * chunks, kind)
        return pa.table({"a": same("a", pa.int64()), "chunk": same("chunk", pa.int32()), "part": pa.array(np.arange(chunks), pa.int32()), "hashes": W.binary(hashes[order], bounds)})
    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of the hashes that came to one part: per chunk those that another chunk has too."""
    values, bounds = W.runs(table["hashes"], np.uint64)
    distinct, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    kept = np.concatenate(([0], np.cumsum(twice)))[bounds]
    return pa.table({"a": table["a"], "chunk": table["chunk"], "hashes": W.binary(values[twice], kept)})


def _chunk_result(length: int):
    def run(table: pa.Table, other: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "u": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
        found = repeats_at_anchors(table["a"].to_numpy(), table["body"].to_pylist(), table["d"].to_numpy(), length)
        hashes, row, place = _windows(table, length)
        elsewhere = np.isin(hashes, W.runs(other["hashes"], np.uint64)[0]) if other.num_rows else np.zeros(len(hashes), bool)
        for r, p in zip(row[elsewhere].tolist(), place[elsewhere].tolist(), strict=True):
            found[r].add((p, p + length))
        return _result(table, found)
    return run


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans in order, those that touch or overlap as one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    return np.stack((spans[new, 0], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(spans) - 1]))]), axis=1)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for packed, pieces in zip(W.column(batch, "packed"), W.column(batch, "pieces"), strict=True):
            raw, spans, kept, at = _unpack(packed.as_py()), np.zeros((0, 2), np.int64), hashlib.sha256(), 0
            if pieces.is_valid:
                spans = _joined(np.concatenate([np.frombuffer(x["spans"], "<i8").reshape(-1, 2) + x["begin"] for x in pieces.as_py()]))
            for a, b in spans.tolist():
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            rows.append((len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), kept.hexdigest(), _flat(map(tuple, spans.tolist()))))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [W.column(batch, "doc_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed, one row per row of docs.

    Removed is every byte of the UTF-8 text inside a string of `length` bytes that starts
    anywhere else too, in the same text or another; `removed` holds the maximal runs as pairs
    of little-endian 8-byte numbers. Missing texts are empty; texts shorter than `length` lose
    nothing. Repeated rows and rows without an id count as texts like others. Other columns
    are not read; an empty table gives no rows. `length` must be at least twice the anchor.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be at least {2 * ANCHOR}")
    ship(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    # Rows are told apart by id and text, so that missing and repeated ids do no harm.
    texts = texts.select("doc_id", F.xxhash64("text", "doc_id").alias("t"), "text")
    packed = texts.mapInArrow(_packed, "doc_id long, t long, packed binary")
    places = written(
        texts.filter(F.octet_length("text") >= length)
        .mapInArrow(_anchor_rows(length), "doc_id long, t long, a long, u long, begin long, size int, d int"), "anchors")
    again = places.groupBy("a").count().filter("count > 1").select("a")
    places = written(places.hint("merge").join(again, "a"), "anchors")
    stretches = written(
        places.groupBy("a", "u", "size", "d").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "t", "begin")).alias("at")), "stretches")
    groups = stretches.groupBy("a").agg(F.count("*").alias("members")).filter("members > 1").select(
        "a", F.ceil(F.col("members") / CHUNK).cast("int").alias("chunks"))
    wanted = stretches.hint("merge").join(groups, "a").groupBy("at.doc_id", "at.t").agg(
        F.collect_list(F.struct("a", "u", "d", "chunks", F.col("at.begin").alias("begin"), "size")).alias("wanted"))
    key = lambda x, y: (x["t"] == y["t"]) & x["doc_id"].eqNullSafe(y["doc_id"])
    one = packed.alias("p").hint("merge").join(wanted.alias("w"), key(packed, wanted))
    bodies = written(
        one.select("p.packed", "w.wanted").mapInArrow(_cut, "a long, u long, d int, chunks int, body binary").dropDuplicates(["a", "u"]), "bodies")
    n_batches = max(1, -(-bodies.filter("chunks = 1").count() // BATCH))
    result = "a long, u long, spans binary"
    usual = bodies.filter("chunks = 1").groupBy(F.pmod(F.xxhash64("a"), F.lit(n_batches))).applyInArrow(_compared(length), result)
    hot = bodies.filter("chunks > 1").withColumn("chunk", F.pmod(F.xxhash64("u"), "chunks").cast("int"))
    dealt = hot.groupBy("a", "chunk").applyInArrow(_dealt(length), "a long, chunk int, part int, hashes binary")
    elsewhere = dealt.groupBy("a", "part").applyInArrow(_shared, "a long, chunk int, hashes binary")
    large = hot.groupBy("a", "chunk").cogroup(elsewhere.groupBy("a", "chunk")).applyInArrow(_chunk_result(length), result)
    partly = written(usual.unionByName(large), "repeats")
    # A stretch that occurs twice is repeated as a whole.
    spans = stretches.select("a", "u", "n", "size").join(partly.hint("merge"), ["a", "u"], "left").filter("n > 1 or spans is not null")
    pieces = places.select("doc_id", "t", "begin", "a", "u").join(spans.hint("merge"), ["a", "u"]).select(
        "doc_id", "t", F.struct("begin", F.when(F.col("n") == 1, F.col("spans")).alias("spans"), F.when(F.col("n") > 1, F.col("size")).alias("size")).alias("piece"))
    per_text = pieces.groupBy("doc_id", "t").agg(F.collect_list("piece").alias("pieces")).select(
        "doc_id", "t", F.transform("pieces", lambda p: F.struct(p["begin"].alias("begin"), F.coalesce(p["spans"], _whole(p["size"])).alias("spans"))).alias("pieces"))
    both = packed.alias("p").hint("merge").join(per_text.alias("s"), key(packed, per_text), "left")
    return both.select("p.doc_id", "p.packed", "s.pieces").mapInArrow(
        _digested, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed binary")


def _whole(size):
    """The span [0, size) as two little-endian 8-byte numbers."""
    digits = F.lpad(F.hex(size.cast("long")), 16, "0")
    return F.concat(F.lit(bytes(8)), F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])))
