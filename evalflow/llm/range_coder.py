"""Adaptive context-mixing range coder for token ids, in independent checksummed blocks.

Three predictors look at a block's past: order 2 and order 1 propose the id that last followed the same two ids or the
same one id, order 0 is the distribution of the ids' upper parts so far. An id is coded as one interval: first whether
a proposal is right (and which), then, if none is, its upper part by order 0 and its lower eight bits evenly. The
probabilities of the first step are a mix of three adaptive estimates (by the confidence of order 2, by that of order 1,
and overall), weighted by how well each did in this block.

Everything is reset at the start of a block, and blocks know nothing of each other. They are therefore coded side by
side: one numpy operation does a step of all of them. The model is brought up to date every CHUNK ids. All
arithmetic is in whole numbers, so every machine decodes what another has coded.

Block: magic, ids, vocabulary, CRC-32 of the ids (as little-endian 32-bit numbers), CRC-32 and length of the payload,
then the payload of 16-bit digits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from evalflow.llm.sparse import spans

MAGIC = b"EVT1"
HEADER = "<4sIIIII"
CHUNK = 128
#: Chunks after which order 0 is brought up to date.
UPPER_EVERY = 4
#: Ids of a block and blocks coded side by side, at most.
BLOCK_IDS = 2048
SIDE_BY_SIDE = 2048

_CLASS_BITS, _UPPER_BITS, _LOWER_BITS = 10, 11, 8
_LITERAL_BITS = _UPPER_BITS + _LOWER_BITS
_TOTAL_BITS = _CLASS_BITS + _LITERAL_BITS
_TABLE_BITS = 10
_U = np.uint64


class BlockError(ValueError):
    """A block whose header, payload or ids do not agree."""


class _Model:
    """The state of some blocks. ``uppers``: number of upper parts, below 2 ** _UPPER_BITS - 1."""

    def __init__(self, blocks: int, vocabulary: int):
        self.uppers = (max(1, vocabulary) - 1 >> _LOWER_BITS) + 1
        if self.uppers * 2 > 1 << _UPPER_BITS:
            raise ValueError(f"vocabularies go up to {1 << _UPPER_BITS + _LOWER_BITS - 1} ids")
        self.lane = np.arange(blocks, dtype=np.int64)
        self.base = self.lane << _TABLE_BITS
        cells = blocks << _TABLE_BITS
        # The id that followed, times four, plus how often in a row it did (up to 3; 0: nothing known).
        self.order2, self.order1 = np.zeros(cells, dtype=np.int32), np.zeros(cells, dtype=np.int32)
        self.upper_counts = np.ones((blocks, self.uppers), dtype=np.int64)
        self.upper_news: list[np.ndarray] = []
        # The blocks are the last axis of all that is small: operations run along it.
        self.seen = [np.ones((n, 3, blocks), dtype=np.int64) for n in (4, 8)]
        self.errors = np.full((3, blocks), 512, dtype=np.int64)
        self.chunks = 0
        self.refresh()

    def cells(self, one: np.ndarray, two: np.ndarray, base: np.ndarray, at2=None, at1=None) -> tuple[np.ndarray, np.ndarray]:
        """Places in the tables of order 2 and order 1 after the ids ``two``, ``one`` (32 bits each)."""
        # 32-bit numbers that wrap: the bits that are kept are the same.
        keep, past = np.uint32((1 << _TABLE_BITS) - 1), np.uint32(15)
        mixed = one * np.uint32(0x9E3779B1)
        both = two * np.uint32(0x85EBCA77)
        both += mixed
        for bits in (both, mixed):
            bits >>= past
            bits &= keep
        return np.add(base, both.view(np.int32), out=at2), np.add(base, mixed.view(np.int32), out=at1)

    def refresh(self) -> None:
        """Whole-number frequencies from the counts. Quotients of whole numbers below 2 ** 53 are exact as double numbers cut to
        whole ones, and take less time."""
        if self.chunks % UPPER_EVERY == 0:
            counts = self.upper_counts
            if self.upper_news:
                counts += 16 * np.bincount(np.concatenate(self.upper_news), minlength=counts.size).reshape(counts.shape)
                self.upper_news = []
            room = (1 << _UPPER_BITS) - self.uppers
            f = 1 + (counts * float(room) / counts.sum(axis=1, keepdims=True)).astype(np.int32)
            f[self.lane, f.argmax(axis=1)] += ((1 << _UPPER_BITS) - f.sum(axis=1)).astype(np.int32)
            self.upper_sizes = f
            # Start and size side by side, so that both are fetched at once.
            self.upper = (np.cumsum(f, axis=1, dtype=np.int32) - f << 16 | f).reshape(-1)
        whole = float(1 << _CLASS_BITS)
        self.shares = [(c * whole / c.sum(axis=1, keepdims=True)).astype(np.int32) for c in (*self.seen, self.seen[0].sum(axis=0, keepdims=True))]
        w2, w1, w0 = ((1 << 20) // (16 + self.errors) ** 2 + 1).astype(np.int32)
        # At most 3 * 4097 * 1024.
        share2, share1, share0 = self.shares
        mixed = (w2 * share2 + w0 * share0)[:, None] + (w1 * share1)[None]
        mixed = (mixed / (w2 + w1 + w0)).astype(np.int32)
        size = 1 + (mixed * ((1 << _CLASS_BITS) - 3) >> _CLASS_BITS)
        # The ends of the first and of the second interval, likewise; 32 contexts for each block.
        self.ends = ((size[:, :, 0] << 16) + size[:, :, 0] + size[:, :, 1]).reshape(-1)

    def learn(self, lane: np.ndarray, ids: np.ndarray, at2, at1, known2, known1, kind: np.ndarray, context: np.ndarray) -> None:
        """Take in a chunk. All arrays have one entry per block and id, later ids of a block behind earlier ones; ``lane`` is
        the block's number along their axes, ``known2`` and ``known1`` are what the tables hold at ``at2`` and ``at1``,
        ``context`` is the context times the number of blocks and the block's number."""
        blocks, n = len(self.lane), ids.size // len(self.lane)
        now = ids << np.int32(2)
        first = now + np.int32(1)
        for table, at, known in ((self.order2, at2, known2), (self.order1, at1, known1)):
            # One more of four times the id and its count, up to 3; a new id begins with 1.
            more = known - now
            same = (more.view(np.uint32) <= 3).view(np.int8)
            np.minimum(more, 2, out=more)
            more *= same
            more += first
            table[at.reshape(-1)] = more.reshape(-1)
        upper = (lane * self.uppers).astype(np.int32) + (ids >> np.int32(_LOWER_BITS))
        self.upper_news.append(upper.reshape(-1)[np.flatnonzero(kind == 2)])
        found = np.bincount((context + kind * np.int64(blocks * 32)).reshape(-1), minlength=blocks * 96).reshape(3, 4, 8, blocks)
        by2, by1 = found.sum(axis=2).transpose(1, 0, 2), found.sum(axis=1).transpose(1, 0, 2)
        for k, (new, share) in enumerate(zip((by2, by1, by2.sum(axis=0, keepdims=True)), self.shares, strict=True)):
            missed = (new * ((1 << _CLASS_BITS) - share)).sum(axis=(0, 1)) // n
            self.errors[k] = (self.errors[k] + missed) // 2
        self.seen[0] += by2
        self.seen[1] += by1
        self.chunks += 1
        self.refresh()


_ONE_DUE, _TWO_DUE = _U(1 << 48), _U(1 << 32)


def _digits_due(width: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Digits by which an interval has to grow: none, one or two, as a step leaves at least 2 ** 19 of 2 ** 48."""
    return np.add((width < _ONE_DUE).view(np.int8), (width < _TWO_DUE).view(np.int8), out=out)


def encode(ids: np.ndarray, vocabulary: int, block_ids: int = BLOCK_IDS) -> list[bytes]:
    """Blocks of the ids, SIDE_BY_SIDE at a time."""
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError("an id lies outside the vocabulary")
    out: list[bytes] = []
    step = block_ids * SIDE_BY_SIDE
    for at in range(0, len(ids), step):
        out += _encode_together(ids[at : at + step], vocabulary, block_ids)
    return out


def _encode_together(ids: np.ndarray, vocabulary: int, block_ids: int) -> list[bytes]:
    blocks = -(-len(ids) // block_ids)
    padded = np.zeros(blocks * block_ids, dtype=np.int32)
    padded[: len(ids)] = ids
    grid = padded.reshape(blocks, block_ids)
    model = _Model(blocks, vocabulary)
    lane = model.lane[:, None]
    low, width = np.zeros(blocks, dtype=_U), np.full(blocks, (1 << 64) - 1, dtype=_U)
    stride = 2 * block_ids + 8
    digits, place = np.zeros(blocks * stride, dtype=np.uint32), model.lane * stride + 1
    history = np.concatenate([np.zeros((blocks, 2), dtype=np.int32), grid], axis=1)
    base = model.base[:, None]
    total_bits, half, digit_bits = _U(_TOTAL_BITS), _U(32), _U(4)
    for begin in range(0, block_ids, CHUNK):
        now = grid[:, begin : begin + CHUNK]
        n = now.shape[1]
        past = history[:, begin : begin + 1 + n].view(np.uint32)
        at2, at1 = model.cells(past[:, 1:], past[:, :-1], base)
        known2, known1 = model.order2[at2], model.order1[at1]
        count2, count1, p2, p1 = known2 & 3, known1 & 3, known2 >> 2, known1 >> 2
        is0 = (p2 == now) & (count2 > 0)
        is2 = ~(is0 | (p1 == now) & (count1 > 0))
        kind = is2.view(np.int8) + np.int8(1) - is0.view(np.int8)
        context = ((count2 << 3) + (count1 << 1) + (p2 == p1)) * blocks + lane
        ends = model.ends[context]
        first, second = ends >> 16, ends & 0xFFFF
        upper = model.upper[lane * model.uppers + (now >> _LOWER_BITS)]
        size, rest = upper & 0xFFFF, (1 << _CLASS_BITS) - second
        inner = (upper >> 16 << _LOWER_BITS) + (now & (1 << _LOWER_BITS) - 1) * size
        # Both stay below 2 ** _TOTAL_BITS, as in the decoder.
        start = np.where(is0, np.int32(0), np.where(is2, (second << _LITERAL_BITS) + inner * rest, first << _LITERAL_BITS)).T.astype(_U, order="C")
        span = np.where(is2, size * rest, np.where(is0, first, second - first) << _LITERAL_BITS).T.astype(_U, order="C")
        tops, carries, counts = np.empty((n, blocks), dtype=_U), np.empty((n, blocks), dtype=bool), np.empty((n, blocks), dtype=np.int8)
        for j in range(n):
            unit = width >> total_bits
            moved = unit * start[j]
            moved += low
            np.less(moved, low, out=carries[j])
            width = np.multiply(unit, span[j], out=unit)
            np.right_shift(moved, half, out=tops[j])
            shift = _digits_due(width, counts[j]).astype(_U)
            shift <<= digit_bits
            low = np.left_shift(moved, shift, out=moved)
            width <<= shift
        place = _write_digits(digits, place, tops, carries, counts)
        model.learn(lane, now, at2, at1, known2, known1, kind, context)
    for _ in range(4):
        digits[place] = low >> _U(48)
        place += 1
        low <<= _U(16)
    over = np.flatnonzero(digits > 0xFFFF)
    while len(over):  # carries reach the digits before
        more = digits[over] >> 16
        digits[over] &= 0xFFFF
        over -= 1
        digits[over] += more
        over = over[digits[over] > 0xFFFF]
    digits = digits.reshape(blocks, stride)
    ends = place - model.lane * stride
    out = []
    for b in range(blocks):
        own = ids[b * block_ids : (b + 1) * block_ids].astype("<u4")
        payload = digits[b, 1 : ends[b]].astype("<u2").tobytes()
        out.append(struct.pack(HEADER, MAGIC, len(own), vocabulary, zlib.crc32(own.tobytes()), zlib.crc32(payload), len(payload)) + payload)
    return out


def _write_digits(digits: np.ndarray, place: np.ndarray, tops: np.ndarray, carries: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Write the settled digits of a chunk: the first ``counts`` of the two in ``tops``, a row for each step, from ``place``
    on. Returns the places behind them."""
    due = np.ascontiguousarray(counts.T)
    # The low half of a number is the first in memory and the second digit.
    halves = tops.T.astype("<u4", order="C").view("<u2").reshape(-1)
    total = counts.sum(axis=0, dtype=np.int64)
    digits[spans(place, total)] = halves[np.flatnonzero(np.stack([due > 0, due > 1], axis=2)) ^ 1]
    # A carry goes to the digit before those of its step; several steps may meet there.
    step, block = np.divmod(np.flatnonzero(carries), len(place))
    before = np.cumsum(counts, axis=0, dtype=np.int16) - counts
    np.add.at(digits, place[block] + before[step, block] - 1, np.uint32(1))
    return place + total


def split_blocks(data: bytes) -> list[tuple[int, int, int, bytes]]:
    """Ids, vocabulary, checksum of the ids and payload of each of the blocks that follow each other."""
    out, at = [], 0
    while at < len(data):
        if len(data) - at < struct.calcsize(HEADER):
            raise BlockError("a header is cut off")
        magic, n, vocabulary, ids_crc, payload_crc, length = struct.unpack_from(HEADER, data, at)
        payload = data[at + struct.calcsize(HEADER) : at + struct.calcsize(HEADER) + length]
        if magic != MAGIC or len(payload) != length or zlib.crc32(payload) != payload_crc:
            raise BlockError(f"a block at byte {at} is damaged")
        out.append((n, vocabulary, ids_crc, payload))
        at += struct.calcsize(HEADER) + length
    return out


def decode(data: bytes) -> np.ndarray:
    """The ids of blocks that follow each other, as little-endian 32-bit numbers."""
    blocks = split_blocks(data)
    out = []
    for at in range(0, len(blocks), SIDE_BY_SIDE):
        some = blocks[at : at + SIDE_BY_SIDE]
        if len({vocabulary for _, vocabulary, _, _ in some}) != 1:
            raise BlockError("blocks of several vocabularies")
        grid = _decode_together([p for *_, p in some], max(n for n, *_ in some), some[0][1])
        for row, (n, _, crc, _) in zip(grid, some, strict=True):
            own = row[:n].astype("<u4")
            if zlib.crc32(own.tobytes()) != crc:
                raise BlockError("the decoded ids do not agree with their checksum")
            out.append(own)
    return np.concatenate(out) if out else np.zeros(0, dtype="<u4")


def _decode_together(payloads: list[bytes], steps: int, vocabulary: int) -> np.ndarray:
    blocks = len(payloads)
    model = _Model(blocks, vocabulary)
    # Behind its end a payload goes on with zeros; ids past a block's own number are dropped.
    stride = max(len(p) for p in payloads) // 2 + 2 * CHUNK + 8
    digits = np.zeros((blocks, stride), dtype=np.uint16)
    for b, p in enumerate(payloads):
        digits[b, : len(p) // 2] = np.frombuffer(p, dtype="<u2")
    # Every place has its digit and the next one.
    pairs = digits.reshape(-1).astype(np.uint32) << 16
    pairs[:-1] |= pairs[1:] >> 16
    place, last = model.lane * stride, (model.lane + 1) * stride - 2
    value = pairs[place].astype(_U) << _U(32) | pairs[place + 2]
    place = place + 4
    width = np.full(blocks, (1 << 64) - 1, dtype=_U)
    grid = np.zeros((blocks, steps), dtype=np.uint32)
    one, two = np.zeros(blocks, dtype=np.uint32), np.zeros(blocks, dtype=np.uint32)
    # What a chunk is learnt from, one row per step.
    kept = [np.empty((CHUNK, blocks), dtype=kind) for kind in ("i4", "i8", "i8", "i4", "i4", "i1", "i8")]
    lane, lane_uppers, lane_inverse = model.lane, model.lane * model.uppers, model.lane << _UPPER_BITS
    lower, none, whole = (1 << _LOWER_BITS) - 1, np.int32(0), np.int32(1 << _CLASS_BITS)
    total_bits, half, digit_bits, most = _U(_TOTAL_BITS), _U(32), _U(4), _U((1 << _TOTAL_BITS) - 1)
    names = np.arange(model.uppers, dtype=np.uint8 if model.uppers <= 256 else np.int16)
    for begin in range(0, steps, CHUNK):
        n = min(CHUNK, steps - begin)
        if model.chunks % UPPER_EVERY == 0:
            inverse = np.repeat(np.tile(names, blocks), model.upper_sizes.reshape(-1))
        for j in range(n):
            ids, at2, at1, _, _, kind, context = (rows[j] for rows in kept)
            model.cells(one, two, model.base, at2, at1)
            known2, known1 = model.order2[at2], model.order1[at1]
            kept[3][j], kept[4][j] = known2, known1
            p2, p1 = known2 >> 2, known1 >> 2
            inner = known2 & 3
            inner <<= 2
            inner += known1 & 3
            inner <<= 1
            inner += p2 == p1
            np.multiply(inner, blocks, out=context)
            context += lane
            ends = model.ends[context]
            first, second = ends >> 16, ends & 0xFFFF
            unit = width >> total_bits
            # Below 2 ** _TOTAL_BITS, as are all its parts.
            target = np.minimum(value // unit, most).astype(np.int32)
            share = target >> _LITERAL_BITS
            is0, is2 = share < first, share >= second
            rest = whole - second
            begin2 = second << _LITERAL_BITS
            # Quotients of 32-bit numbers are exact as double numbers cut to whole ones, and take less time.
            target -= begin2
            np.maximum(target, none, out=target)
            literal = (target / rest).astype(np.int32)
            upper = inverse[lane_inverse + (literal >> _LOWER_BITS)]
            cell = model.upper[lane_uppers + upper]
            size, origin = cell & 0xFFFF, cell >> 16 << _LOWER_BITS
            literal -= origin
            low_part = (literal / size).astype(np.int32)
            np.left_shift(upper, _LOWER_BITS, out=ids, dtype=np.int32)
            ids += low_part & lower
            start = low_part
            start *= size
            start += origin
            start *= rest
            start += begin2
            size *= rest
            span = size
            # Most ids are no proposals; those that are take their proposal and its interval.
            some = np.flatnonzero(share < second)
            by2, end2, end1 = is0[some], first[some], second[some]
            ids[some] = np.where(by2, p2[some], p1[some])
            start[some] = np.where(by2, none, end2 << _LITERAL_BITS)
            span[some] = np.where(by2, end2, end1 - end2) << _LITERAL_BITS
            value -= unit * start.astype(_U)
            width = np.multiply(unit, span.astype(_U), out=unit)
            count = _digits_due(width)
            shift = count.astype(_U)
            shift <<= digit_bits
            value <<= shift
            width <<= shift
            value |= pairs[place].astype(_U) >> (half - shift)
            place += count
            np.minimum(place, last, out=place)
            np.add(is2.view(np.int8), 1, out=kind)
            kind -= is0.view(np.int8)
            two, one = one, ids.view(np.uint32)
        grid[:, begin : begin + n] = kept[0][:n].T
        # The next chunk writes over these rows.
        two, one = two.copy(), one.copy()
        model.learn(lane, *(rows[:n] for rows in kept))
    return grid
