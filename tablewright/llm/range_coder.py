"""Range coding of token ids with order-0 to order-2 predictions, many blocks in step.

A segment of ids is cut into blocks. Every block starts with empty predictions, and all
blocks of a segment are coded side by side: one step handles the next id of each, so the
arrays of a step are as long as there are blocks. What one block needs to be decoded is its
own bytes and the segment's table of id frequencies.

Per id the coder mixes three predictions: the id that last followed the two ids before
(order 2), the one that last followed the id before (order 1), and the frequencies of the
segment (order 0). How far each is trusted is learned in the block: for every pair of
confidences of the two contexts it counts which prediction came true, and these counts drive
the arithmetic coder. If neither context is right, the id itself is coded by frequency.

Digits hold their carries until all are settled once at the end of the block.

The three counts of a trust lie in one number of 64 bits, 16 bits each, so one product gives
all sums of the first counts.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048
SLOT_BITS = 11
LITERAL_BITS = 18
MAGIC = b"TIDS1\0"
#: Steps between two looks at how many digits there are; a step puts out three at most.
AHEAD = 32

_U = np.uint64
_FULL, _LEAST, _DIGIT = _U((1 << 40) - 1), _U(1 << 24), _U(16)
_LOW16, _ALL_ODD = _U(0xFFFF), _U(0x00007FFF7FFF7FFF)
_ONES = _U(1 | 1 << 16 | 1 << 32)
_BELOW = _U(1 << 16 | 1 << 32)
#: Place of a count in the trust: by order 2 (first), order 1, neither; for hits of order 1 + 2 * order 2.
_SHIFTS = np.array([32, 16, 0, 0], dtype=np.uint64)
_START = _U(4 | 4 << 16 | 24 << 32)
_STEP, _MOST = 24, 4000


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2 ** LITERAL_BITS, at least 1 where there is any."""
    present = np.flatnonzero(counts)
    total = 1 << LITERAL_BITS
    scaled = np.zeros(len(counts), dtype=np.int64)
    share = counts[present].astype(np.float64) * ((total - len(present)) / counts.sum())
    scaled[present] = 1 + share.astype(np.int64)
    scaled[present[np.argmax(counts[present])]] += total - scaled.sum()
    return scaled


class _Model:
    """Predictions of all blocks; row 0 of every pair is order 1, row 1 order 2; tables are flat,
    one stretch per order and block."""

    def __init__(self, blocks: int):
        slots = 1 << SLOT_BITS
        self.first = (np.arange(2 * blocks, dtype=np.int64) * slots).reshape(2, blocks)
        self.cells = np.zeros(2 * blocks * slots, dtype=np.uint32)
        self.states = np.arange(blocks, dtype=np.int64) * 16
        self.trust = np.full(blocks * 16, _START, dtype=np.uint64)

    def look(self, k: int, last: np.ndarray, before: np.ndarray):
        """Where the predictions of k blocks lie, what they are, and how far they are trusted."""
        at = np.empty((2, k), dtype=np.int64)
        np.multiply(last, 40503, out=at[0])
        np.add(at[0], before * 60493, out=at[1])
        at[0] >>= 1
        at >>= 3
        at &= (1 << SLOT_BITS) - 1
        at += self.first[:, :k]
        cells = self.cells.take(at, mode="clip")
        sure = cells & 3
        state = self.states[:k] + (sure[1] << 2 | sure[0])
        return at, cells, sure, state, self.trust.take(state, mode="clip")

    def learn(self, at, cells, sure, hits, state, trust, total, shift, ids) -> None:
        self.cells[at] = np.where(hits, cells + (sure < 3), np.where(sure, cells - 1, ids << 2))
        trust = trust + (_U(_STEP) << shift)
        full = total > _MOST - _STEP
        if np.count_nonzero(full):
            trust = np.where(full, (trust >> _U(1) & _ALL_ODD) | _ONES, trust)
        self.trust[state] = trust


def _columns(ids: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Ids by step and block, the number of blocks, and the ids in the last one."""
    blocks = max(1, -(-len(ids) // BLOCK))
    last = len(ids) - (blocks - 1) * BLOCK
    steps = BLOCK if blocks > 1 else last
    padded = np.zeros(blocks * steps, dtype=ids.dtype)
    padded[: len(ids)] = ids
    return np.ascontiguousarray(padded.reshape(blocks, steps).T), blocks, last


def _counts(ids: np.ndarray) -> np.ndarray:
    """How often each id occurs; a stretch at a time, as counting widens what it counts."""
    counts = np.zeros(int(ids.max()) + 1, dtype=np.int64)
    for a in range(0, len(ids), 1 << 18):
        part = np.bincount(ids[a : a + (1 << 18)])
        counts[: len(part)] += part
    return counts


def _count_table(counts: np.ndarray) -> bytes:
    present = np.flatnonzero(counts)
    return zlib.compress(np.diff(present, prepend=0).astype("<u4").tobytes() + counts[present].astype("<u4").tobytes(), 6)


def encode(ids: np.ndarray) -> bytes:
    """One segment: magic, sizes, frequency table, block lengths and checksums, block bytes."""
    ids = np.asarray(ids)
    if not len(ids):
        return MAGIC + np.zeros(3, "<u4").tobytes()
    counts = _counts(ids)
    frequency = _frequencies(counts).astype(np.uint64)
    cumulated = np.concatenate((np.zeros(1, np.uint64), np.cumsum(frequency)))[:-1]
    table, blocks, last_length = _columns(ids)
    model = _Model(blocks)
    low, width = np.zeros(blocks, np.uint64), np.full(blocks, _FULL + _U(1), np.uint64)
    # Rows of digits, one column per block; more rows are added when the fullest block needs them.
    digits = np.zeros((len(table) // 2 + 4 * AHEAD, blocks), dtype=np.uint32)
    flat, place = digits.reshape(-1), np.arange(blocks, dtype=np.int64) + blocks
    last, before = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)

    def push(low, width, place):
        """Put out a digit, with its carry if low has grown over it, where the width is small."""
        small = (width < _LEAST).nonzero()[0]
        if len(small):
            chosen = low.take(small, mode="clip")
            to = place.take(small, mode="clip")
            flat[to] = chosen >> _U(24)
            low[small] = chosen << _DIGIT & _FULL
            width[small] = width.take(small, mode="clip") << _DIGIT
            place[small] = to + blocks

    for t, row in enumerate(table):
        if t % AHEAD == 0 and (needed := int(place.max()) // blocks + 3 * AHEAD + 2) > len(digits):
            digits = np.concatenate((digits, np.zeros((needed + len(digits) // 4 - len(digits), blocks), dtype=np.uint32)))
            flat = digits.reshape(-1)
        k = blocks if t < last_length else blocks - 1
        now = row[:k].astype(np.int64)
        small_now = now.astype(np.uint32)
        at, cells, sure, state, trust = model.look(k, last[:k], before[:k])
        hits = (cells >> 2) == small_now
        kind = hits[1].view(np.uint8) << 1 | hits[0].view(np.uint8)
        shift = _SHIFTS.take(kind)
        total = trust * _ONES >> _U(32) & _LOW16
        l, w, p = low[:k], width[:k], place[:k]
        part = (w / total).astype(np.uint64)
        l += part * (trust * _BELOW >> shift & _LOW16)
        np.multiply(part, trust >> shift & _LOW16, out=w)
        push(l, w, p)
        literal = (kind == 0).nonzero()[0]
        if len(literal):
            which = now.take(literal, mode="clip")
            part = width.take(literal, mode="clip") >> _U(LITERAL_BITS)
            l2, w2, p2 = low.take(literal, mode="clip") + part * cumulated.take(which, mode="clip"), part * frequency.take(which, mode="clip"), place.take(literal, mode="clip")
            push(l2, w2, p2)
            push(l2, w2, p2)  # a rare id may narrow the width by two digits
            low[literal], width[literal], place[literal] = l2, w2, p2
        model.learn(at, cells, sure, hits, state, trust, total, shift, small_now)
        before[:k] = last[:k]
        last[:k] = now
    # The width is 2 ** 24 at least, so one digit names a number inside.
    flat[place] = low + (_LEAST - _U(1)) >> _U(24)
    place += blocks
    del model, table
    lengths = place // blocks - 1
    for row in range(int(lengths.max()), 0, -1):
        digits[row - 1] += digits[row] >> 16
    columns = np.ascontiguousarray(digits[1 : int(lengths.max()) + 1].astype("<u2").T)
    del digits, flat
    bodies = [columns[i, : lengths[i]].tobytes() for i in range(blocks)]
    counted = _count_table(counts)
    return b"".join([
        MAGIC, np.array([len(ids), blocks, len(counted)], "<u4").tobytes(), counted, lengths.astype("<u4").tobytes(),
        np.array([zlib.crc32(x) for x in bodies], "<u4").tobytes(), *bodies,
    ])


def decode(data: bytes) -> np.ndarray:
    """The ids of one segment, 4 bytes each; ValueError where the data is not whole."""
    if data[: len(MAGIC)] != MAGIC or len(data) < len(MAGIC) + 12:
        raise ValueError("not a segment of token ids")
    at = len(MAGIC) + 12
    n, blocks, size = np.frombuffer(data, "<u4", 3, len(MAGIC)).tolist()
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(zlib.decompress(data[at : at + size]), "<u4")
    counts = np.zeros(int(raw[: len(raw) // 2].sum()) + 1, dtype=np.int64)
    counts[np.cumsum(raw[: len(raw) // 2].astype(np.int64))] = raw[len(raw) // 2 :]
    at += size
    lengths, sums = np.frombuffer(data, "<u4", blocks, at).astype(np.int64), np.frombuffer(data, "<u4", blocks, at + 4 * blocks)
    at += 8 * blocks
    bounds = at + np.concatenate(([0], np.cumsum(2 * lengths)))
    if bounds[-1] != len(data):
        raise ValueError("a segment of token ids is cut off")
    # At most three digits more are looked at than a block has.
    columns = np.zeros((blocks, int(lengths.max()) + 4), dtype=np.uint16)
    for i in range(blocks):
        body = data[bounds[i] : bounds[i + 1]]
        if zlib.crc32(body) != sums[i]:
            raise ValueError(f"block {i} does not match its checksum")
        columns[i, : lengths[i]] = np.frombuffer(body, "<u2")
    flat = np.ascontiguousarray(columns.T).reshape(-1)
    del columns
    frequency = _frequencies(counts).astype(np.uint64)
    cumulated = np.concatenate((np.zeros(1, np.uint64), np.cumsum(frequency)))[:-1]
    owner = np.repeat(np.arange(len(counts)), frequency.astype(np.int64))
    last_length = n - (blocks - 1) * BLOCK
    table = np.zeros((BLOCK if blocks > 1 else last_length, blocks), dtype=np.uint32)
    model = _Model(blocks)
    lane = np.arange(blocks, dtype=np.int64)
    top, middle, bottom = flat[: 3 * blocks].astype(np.uint64).reshape(3, blocks)
    code = top << _U(24) | middle << _U(8) | bottom >> _U(8)
    tail = bottom & _U(0xFF)  # bits that are already read but not in the code
    width, place = np.full(blocks, _FULL + _U(1), np.uint64), lane + 3 * blocks
    last, before = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)

    def quotient(x, by):
        q = (x / by).astype(np.uint64)
        return q - (q * by > x)

    def pull():
        """Take in a digit where the width is small: 8 bits kept back and 8 of the next."""
        small = (width < _LEAST).nonzero()[0]
        if len(small):
            to = place.take(small, mode="clip")
            digit = flat.take(to, mode="clip").astype(np.uint64)
            code[small] = code.take(small, mode="clip") << _DIGIT | tail.take(small, mode="clip") << _U(8) | digit >> _U(8)
            tail[small] = digit & _U(0xFF)
            width[small] = width.take(small, mode="clip") << _DIGIT
            place[small] = to + blocks

    for t in range(len(table)):
        k = blocks if t < last_length else blocks - 1
        at, cells, sure, state, trust = model.look(k, last[:k], before[:k])
        below = trust * _BELOW
        a, ab = below >> _DIGIT & _LOW16, below >> _U(32) & _LOW16
        total = ab + (trust >> _U(32))
        part = (width[:k] / total).astype(np.uint64)
        aim = quotient(code[:k], part)
        shift = ((aim >= a).view(np.uint8) + (aim >= ab)).astype(np.uint64) << _U(4)
        code[:k] -= part * (below >> shift & _LOW16)
        np.multiply(part, trust >> shift & _LOW16, out=width[:k])
        pull()
        guesses = cells >> 2
        now = np.where(shift == 0, guesses[1], guesses[0])
        literal = (shift == 32).nonzero()[0]
        if len(literal):
            part = width.take(literal, mode="clip") >> _U(LITERAL_BITS)
            left = code.take(literal, mode="clip")
            aim = np.minimum(quotient(left, part), _U((1 << LITERAL_BITS) - 1))
            which = owner.take(aim.astype(np.int64), mode="clip")
            code[literal] = left - part * cumulated.take(which, mode="clip")
            width[literal] = part * frequency.take(which, mode="clip")
            pull()
            pull()
            now[literal] = which
        table[t, :k] = now
        model.learn(at, cells, sure, guesses == now, state, trust, total, shift, now)
        before[:k] = last[:k]
        last[:k] = now
    del model, flat
    return np.ascontiguousarray(table.T).reshape(-1)[:n]
