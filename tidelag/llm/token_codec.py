"""Token ids coded by an adaptive context-mixing range coder.

Ids are cut into blocks of ``BLOCK`` ids.  Each block starts from an empty model and carries a checksum, so blocks
are read independently.  For every id the model mixes three predictions into one distribution:

* order 2: the id that last followed the two ids before;
* order 1: the id that last followed the id before;
* order 0: the frequencies of the block so far, renewed at fixed positions, with an escape for new ids.

The mixing weights adapt per block and per confidence of the two contexts.  The distribution drives a range coder
that writes 16-bit words.  All blocks of a frame advance together, one id each, so numpy works on thousands of blocks
at a time; the coded form does not depend on that.  The coder knows all ids beforehand and so takes what the contexts
tell from sorts; only weights and ranges go step by step there.

A *frame* is a run of whole documents: header, document index, block table, block payloads (``write_frame``).
Frames are rows of a parquet table, so Spark commits, splits and rereads them.

Ids must be below 65,535.  Defined results: NULL and empty texts have only the end id; a NULL id is stored and comes
first; rows that repeat an id are stored one after another; an empty table gives an empty file set.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import compress, pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelag.llm.common import shared_dir

BLOCK = 2048
LANES = 4096  # blocks that advance together
FRAME_IDS = 1 << 23  # a frame is closed once it holds so many ids
END_ID = 0

_TABLE_BITS = 11  # size of the two context tables of a block
_SLOT_BITS = 12  # order-0 frequencies sum to 2**_SLOT_BITS
_WEIGHT_BITS = 12
_NOTHING = 0xFFFF
_RENEWED = (64, 256, 1024)
_BITS = _WEIGHT_BITS + _SLOT_BITS
_WHOLE = 1 << _WEIGHT_BITS
_SLOTS = 1 << _SLOT_BITS
_TOP = 2.0**48
_LEAST = 2.0**32
_CONTEXTS = 32  # of the mixing weights
_FIELD = (1 << 21) - 1
_GROWTH = np.array([24, 24 << 21, 24 << 42])  # of the weight of the order that was right
_ROWS = 32  # blocks whose tables are made together
_STEPS = 16  # positions whose slots are worked out together; divides 64


# -- order-0 model -------------------------------------------------------------


def _order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Quantised frequencies of each row of ``ids`` (blocks x ids so far).

    Returns block, id, frequency and start of every listed id, and the escape frequency of each block.  The escape
    takes the first slots.
    """
    k, n = ids.shape
    keys = np.sort(((np.arange(k, dtype=np.uint32) << 16)[:, None] | ids).ravel())
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys)))
    lane, symbol = (keys[first] >> 16).astype(np.int64), keys[first] & 0xFFFF
    total = 1 << _SLOT_BITS
    once = np.bincount(lane[counts == 1], minlength=k)
    escape = np.clip(total * once // n, total // 64, total * 3 // 4)
    freq = counts * (total - escape[lane]) // n
    listed = freq > 0
    lane, symbol, freq = lane[listed], symbol[listed], freq[listed]
    sums = np.bincount(lane, freq, minlength=k).astype(np.int64)
    escape = total - sums
    before = np.cumsum(freq) - freq
    offset = np.concatenate([[0], np.cumsum(sums)[:-1]])
    return lane, symbol, freq, before - offset[lane] + escape[lane], escape


class _Weights:
    """Mixing weights of blocks that advance together, three whole numbers of 21 bits in each entry."""

    def __init__(self, lanes: int):
        self.flat = np.full(lanes * _CONTEXTS, 60 | 20 << 21 | 20 << 42, np.int64)  # of orders 0, 1 and 2

    def age(self) -> None:
        """After every 64 ids: halve weights that have grown large."""
        w0, w1, w2 = _fields(self.flat)
        high = np.flatnonzero(w0 + w1 + w2 > 4000)
        if len(high):
            w0, w1, w2 = (np.maximum(w[high] >> 1, 1) for w in (w0, w1, w2))
            self.flat[high] = w0 | w1 << 21 | w2 << 42


def _fields(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed & _FIELD, packed >> 21 & _FIELD, packed >> 42


def _shares(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of orders 2 and 1, of ``_WHOLE`` slots; order 0 has the rest."""
    w0, w1, w2 = (w.astype(np.float64) for w in _fields(packed))
    # weights are small whole numbers: the division is correctly rounded, so coder and decoder agree
    room = (_WHOLE - 3) / (w0 + w1 + w2)
    return np.floor(w2 * room) + 1, np.floor(w1 * room) + 1


def _slot1(one: np.ndarray) -> np.ndarray:
    return one * np.uint32(2654435761) >> np.uint32(32 - _TABLE_BITS)


def _slot2(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    mixed = one * np.uint32(2654435761) ^ two * np.uint32(2246822519)
    return mixed * np.uint32(3266489917) >> np.uint32(32 - _TABLE_BITS)


def _chains(ids: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """What a context table tells before each id: the id last seen in its slot, hits in a row (3 at most) << 16, hit << 18.

    All ids are known here, so the visits of a slot are brought together by a sort instead of step by step.
    """
    k, n = ids.shape
    keys = slots << np.uint32(16) | np.arange(n, dtype=np.uint32)
    keys.sort(axis=1)
    at = (keys & np.uint32(0xFFFF)).astype(np.int64)
    at += (np.arange(k) * n)[:, None]
    now = ids.ravel().take(at)
    same = np.zeros((k, n), bool)
    same[:, 1:] = (keys[:, 1:] ^ keys[:, :-1]) < 1 << 16
    guess = np.full((k, n), _NOTHING, np.uint32)
    guess[:, 1:] = now[:, :-1] | ~same[:, 1:] * np.uint32(_NOTHING)
    hit = guess == now
    once = np.zeros((k, n), bool)
    once[:, 1:] = hit[:, :-1] & same[:, 1:]
    twice, thrice = np.zeros((k, n), bool), np.zeros((k, n), bool)
    twice[:, 1:] = once[:, 1:] & once[:, :-1]
    thrice[:, 1:] = twice[:, 1:] & once[:, 1:] & twice[:, :-1]
    told = np.empty(k * n, np.uint32)
    told[at.ravel()] = (guess | (once.astype(np.uint32) + twice + thrice) << 16 | hit.astype(np.uint32) << 18).ravel()
    return told.reshape(k, n)


# -- range coder over many blocks ----------------------------------------------
#
# All numbers are whole and below 2**53, so float64 holds them exactly.  The range stays in [2**32, 2**48]; carries are
# added to the words already written.


class _Writers:
    def __init__(self, lanes: int, longest: int):
        self.low = np.zeros(lanes)
        self.range = np.full(lanes, _TOP)
        room = 3 * longest + 8
        self.words = np.empty((lanes, room), np.uint32)
        self.flat = self.words.reshape(-1)
        self.first = np.arange(lanes, dtype=np.int64) * room
        self.at = self.first.copy()

    def put(self, k: int, cum: np.ndarray, width: np.ndarray) -> None:
        """Code slots [cum, cum + width) of 2**_BITS in the first ``k`` blocks."""
        low, span, at = self.low[:k], self.range[:k], self.at[:k]
        step = np.floor(span * 2.0**-_BITS)
        cum *= step
        low += cum
        np.multiply(width, step, out=span)
        small = span < _LEAST
        word = np.floor(low * 2.0**-32)
        self.flat[at] = word  # written over by the next one unless it is settled
        at += small
        word *= small
        word *= _LEAST
        low -= word
        times = small * 65535.0
        times += 1
        low *= times
        span *= times
        if span.min() < _LEAST:
            self._settle(np.flatnonzero(span < _LEAST))

    def _settle(self, lanes: np.ndarray) -> None:
        while len(lanes):
            low = self.low[lanes]
            word = np.floor(low * 2.0**-32)
            self.flat[self.at[lanes]] = word
            self.at[lanes] += 1
            self.low[lanes] = (low - word * _LEAST) * 65536
            self.range[lanes] *= 65536
            lanes = lanes[self.range[lanes] < _LEAST]

    def finish(self, plain: list[np.ndarray]) -> list[bytes]:
        """Words of each block, then its ``plain`` ids from the last to the first."""
        # the range is 2**32 at least, so two words tell a number in it, whatever follows them
        self.flat[self.at] = np.floor(end := np.ceil(self.low * 2.0**-16) * 2.0**-16)
        self.flat[self.at + 1] = (end - np.floor(end)) * 65536
        used = self.at - self.first + 2
        out = []
        for i in range(0, len(used), 64):
            some = used[i : i + 64]
            words = self.words[i : i + 64, : int(some.max())].copy()
            words[np.arange(words.shape[1]) >= some[:, None]] = 0
            while (carry := words >> 16).any():
                words &= 0xFFFF
                words[:, :-1] += carry[:, 1:]
            out += [w[:n].tobytes() for w, n in zip(words.astype("<u2"), some.tolist(), strict=True)]
        return [w + p[::-1].astype("<u2").tobytes() for w, p in zip(out, plain, strict=True)]


class _Readers:
    def __init__(self, payloads: list[bytes]):
        lanes = len(payloads)
        sizes = [len(p) // 2 for p in payloads]
        words = np.zeros((lanes, max(sizes) + 8), np.uint16)
        for i, p in enumerate(payloads):
            words[i, : sizes[i]] = np.frombuffer(p, "<u2")
        self.range = np.full(lanes, _TOP)
        self.code = words[:, 0] * 2.0**32 + words[:, 1] * 2.0**16 + words[:, 2]
        self.at = np.arange(lanes, dtype=np.int64) * words.shape[1] + 3
        self.plain_at = self.at - 4 + sizes
        self.flat = words.reshape(-1)

    def target(self, k: int) -> np.ndarray:
        # exact: quotients of whole numbers below 2**48 never round up to the next whole number
        self.step = np.floor(self.range[:k] * 2.0**-_BITS)
        return np.floor(self.code[:k] / self.step)

    def take(self, k: int, cum: np.ndarray, width: np.ndarray) -> None:
        code, span, at = self.code[:k], self.range[:k], self.at[:k]
        cum *= self.step
        code -= cum
        np.multiply(width, self.step, out=span)
        small = span < _LEAST
        times = small * 65535.0
        times += 1
        code *= times
        span *= times
        code += self.flat.take(at) * small
        at += small
        if span.min() < _LEAST:
            self._settle(np.flatnonzero(span < _LEAST))

    def take_plain(self, lanes: np.ndarray) -> np.ndarray:
        at = self.plain_at.take(lanes)
        self.plain_at[lanes] = at - 1
        return self.flat.take(at)

    def _settle(self, lanes: np.ndarray) -> None:
        while len(lanes):
            at = self.at[lanes]
            self.code[lanes] = self.code[lanes] * 65536 + self.flat[at]
            self.range[lanes] *= 65536
            self.at[lanes] = at + 1
            lanes = lanes[self.range[lanes] < _LEAST]


# -- blocks --------------------------------------------------------------------


def _sections(longest: int) -> list[tuple[int, int]]:
    edges = [0, *[r for r in _RENEWED if r < longest], longest]
    return list(zip(edges, edges[1:], strict=False))


def _order0_slots(ids: np.ndarray, begin: int, end: int, table: np.ndarray) -> np.ndarray:
    """Start, frequency << 13 and known << 27 of ids ``begin`` to ``end`` under the frequencies of those before."""
    lane, symbol, freq, start, escape = _order0(ids[:, :begin])
    place = lane << 16 | symbol
    table[place] = start | freq << 13 | 1 << 27
    found = table.take(ids[:, begin:end] + (np.arange(len(ids)) << 16)[:, None])
    table[place] = 0
    return np.where(found, found, (escape << 13).astype(np.uint32)[:, None])


def _encode_together(blocks: list[np.ndarray]) -> list[bytes]:
    """Payloads of at most LANES blocks, longest first."""
    lengths = np.array([len(b) for b in blocks])
    longest = int(lengths[0])
    ids = np.zeros((len(blocks), longest), np.uint16)
    for i, b in enumerate(blocks):
        ids[i, : len(b)] = b
    told1, told2 = (np.empty((longest, len(blocks)), np.uint32) for _ in range(2))
    for at in range(0, len(blocks), _ROWS):
        part = ids[at : at + _ROWS]
        one = np.zeros(part.shape, np.uint32)
        one[:, 1:] = part[:, :-1]
        two = np.zeros(part.shape, np.uint32)
        two[:, 2:] = part[:, :-2]
        told1[:, at : at + _ROWS] = _chains(part, _slot1(one)).T
        told2[:, at : at + _ROWS] = _chains(part, _slot2(one, two)).T
    weights, writers = _Weights(len(blocks)), _Writers(len(blocks), longest)
    table = np.zeros(_ROWS << 16, np.uint32)
    plain = np.zeros(ids.shape, bool)
    for begin, end in _sections(longest):
        many = int((lengths > begin).sum())
        slots = np.full((end - begin, many), _SLOTS << 13, np.uint32)
        for at in range(0, many if begin else 0, _ROWS):
            slots[:, at : at + _ROWS] = _order0_slots(ids[at : min(at + _ROWS, many)], begin, end, table).T
        for t in range(begin, end, _STEPS):
            n = min(t + _STEPS, end) - t
            live = (lengths[None, :] > np.arange(t, t + n)[:, None]).sum(axis=1).tolist()
            plain[: live[0], t : t + n] = _encode_steps(
                *(x[a : a + n, : live[0]] for x, a in ((told1, t), (told2, t), (slots, t - begin))), live, weights, writers
            ).T
            if (t + n) % 64 == 0:
                weights.age()
    plain &= np.arange(longest) < lengths[:, None]
    return writers.finish(np.split(ids[plain], np.cumsum(plain.sum(axis=1))[:-1]))


def _encode_steps(e1, e2, slot, live: list[int], weights: _Weights, writers: _Writers) -> np.ndarray:
    """Code some ids of each block (positions x blocks) and tell which of them are to be written as they are."""
    n, k = slot.shape
    hit2 = e2 >> 18 > 0
    hit1 = (e1 >> 18 > 0) & ~hit2
    at = _context(e1, e2)
    at += np.arange(0, k * _CONTEXTS, _CONTEXTS)
    grown = _GROWTH.take(hit2 * np.int8(2) + hit1)
    packed = np.ones((n, k), np.int64)
    flat = weights.flat
    for t, m in enumerate(live):
        here = at[t, :m]
        now = flat.take(here, out=packed[t, :m], mode="clip")
        flat[here] = now + grown[t, :m]
    w2, w1 = _shares(packed)
    rest = _WHOLE - w2 - w1
    miss = ~(hit2 | hit1)
    cum, width = _spread(w2 * _SLOTS, w1 * _SLOTS, rest, slot, hit2, miss)
    for t, m in enumerate(live):
        writers.put(m, cum[t, :m], width[t, :m])
    return miss & (slot >> 27 == 0)


def _spread(b2, b1, rest, slot, hit2, miss) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the ids: of order 2 they lie in [0, b2), of order 1 in the next b1, of order 0 above."""
    by2, by0 = hit2.astype(np.float64), miss.astype(np.float64)
    rest = rest * by0
    by0 *= b1
    width = b2 * by2
    cum = b2 - width
    cum += by0
    cum += rest * (slot & 0x1FFF)
    by2 *= b1
    width += b1
    width -= by0
    width -= by2
    rest *= slot >> 13 & 0x3FFF
    width += rest
    return cum, width


def _context(e1: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """Mixing context: confidence of both orders, and whether they agree."""
    agree = (e1 ^ e2) & 0xFFFF == 0
    return ((e2 >> 13 & 24) + (e1 >> 15 & 6) + agree).astype(np.int64)


def _decode_together(payloads: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """Ids (blocks x longest) of at most LANES blocks, longest first."""
    lanes, longest = len(payloads), int(lengths[0])
    ids = np.zeros((longest, lanes), np.uint16)
    weights, readers = _Weights(lanes), _Readers(payloads)
    flat = weights.flat
    tables = np.full(2 * lanes << _TABLE_BITS, _NOTHING, np.uint32)
    table_at = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes) << _TABLE_BITS  # of orders 1 and 2
    weight_at = np.arange(lanes, dtype=np.int64) * _CONTEXTS
    one, two = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    for begin, end in _sections(longest):
        many = int((lengths > begin).sum())
        ranks = np.zeros((many, _SLOTS), np.uint16)  # of the listed id that has a slot; the escape is first
        listed, entries = np.arange(many), [np.full(many if not begin else 0, _SLOTS << 13)]
        for at in range(0, many if begin else 0, _ROWS):
            part = np.ascontiguousarray(ids[:begin, at : min(at + _ROWS, many)].T)
            lane, symbol, freq, start, escape = _order0(part)
            # the escape leads the slots of its block
            place = np.searchsorted(lane, np.arange(len(part)))
            freq = np.insert(freq, place, escape)
            entries.append(np.insert(start | symbol.astype(np.int64) << 32 | 1 << 27, place, 0) | freq << 13)
            first = place + np.arange(len(part))
            listed[at : at + len(part)] = first + sum(map(len, entries[:-1]))
            rank = np.arange(len(freq)) - np.repeat(first, np.diff(first, append=len(freq)))
            ranks[at : at + _ROWS] = np.repeat(rank.astype(np.uint16), freq).reshape(-1, _SLOTS)
        ranks, entries = ranks.ravel(), np.concatenate(entries)
        slot_at = np.arange(many, dtype=np.int64) << _SLOT_BITS
        live = (lengths[None, :many] > np.arange(begin, end)[:, None]).sum(axis=1).tolist()
        for t, k in enumerate(live, begin):
            places = table_at[:, :k].copy()
            places[0] += _slot1(one[:k])
            places[1] += _slot2(one[:k], two[:k])
            told = tables.take(places)
            e1, e2 = told
            at = _context(e1, e2)
            at += weight_at[:k]
            packed = flat.take(at)
            w2, w1 = _shares(packed)
            rest = _WHOLE - w2 - w1
            b2, b1 = w2 * _SLOTS, w1 * _SLOTS
            target = readers.target(k)
            hit2, above = target < b2, target - b2 - b1
            miss = above >= 0
            # exact: both are small whole numbers, so the quotient never rounds up to the next one
            above /= rest
            slot = entries.take(ranks.take((above * miss).astype(np.int64) + slot_at[:k]) + listed[:k])
            readers.take(k, *_spread(b2, b1, rest, slot, hit2, miss))
            now = (e1 ^ (e1 ^ e2) * hit2) & 0xFFFF
            now ^= (now ^ (slot >> 32).astype(np.uint32)) * miss
            fresh = np.flatnonzero((slot & 1 << 27 == 0) & miss)
            if len(fresh):
                now[fresh] = readers.take_plain(fresh)
            ids[t, :k] = now
            flat[at] = packed + _GROWTH.take(~miss * (hit2 + np.int8(1)))
            told ^= now
            same = told & 0xFFFF == 0
            told += 0x10000
            np.minimum(told, 0x30000, out=told)
            told *= same
            told |= now
            tables[places] = told
            if t & 63 == 63:
                weights.age()
            two[:k] = one[:k]
            one[:k] = now
    return ids.T


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """One payload per block of 1 to BLOCK ids."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    out: list[bytes] = [b""] * len(blocks)
    for at in range(0, len(order), LANES):
        some = order[at : at + LANES]
        for i, payload in zip(some, _encode_together([blocks[i] for i in some]), strict=True):
            out[i] = payload
    return out


def decode_blocks(payloads: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    order = sorted(range(len(payloads)), key=lambda i: -lengths[i])
    out: list = [None] * len(payloads)
    for at in range(0, len(order), LANES):
        some = order[at : at + LANES]
        found = _decode_together([payloads[i] for i in some], np.array([lengths[i] for i in some]))
        for i, row in zip(some, found, strict=True):
            out[i] = row[: lengths[i]]
    return out


# -- frames --------------------------------------------------------------------

_MAGIC = b"TLF2"
_HEAD = struct.Struct("<4sIQI")


def write_frame(doc_ids: list[int | None], tokens: list[np.ndarray]) -> bytes:
    """Header, document index (null flags, ids, numbers of ids), block table (lengths, sizes, checksums), payloads."""
    ids = np.concatenate(tokens)
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    payloads = encode_blocks(blocks)
    parts = [
        _HEAD.pack(_MAGIC, len(doc_ids), len(ids), len(blocks)),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([len(t) for t in tokens], "<u4").tobytes(),
        np.array([len(b) for b in blocks], "<u4").tobytes(),
        np.array([len(p) for p in payloads], "<u4").tobytes(),
        np.array([zlib.crc32(p) for p in payloads], "<u4").tobytes(),
    ]
    return b"".join(parts + payloads)


def read_frame(frame: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Document ids and their token ids.  A damaged block raises ValueError."""
    magic, n_docs, n_ids, n_blocks = _HEAD.unpack_from(frame)
    if magic != _MAGIC:
        raise ValueError("not a frame of token ids")
    at = _HEAD.size

    def column(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(frame, kind, n, at)
        at += found.nbytes
        return found

    null, doc_ids, n_tokens = column("u1", n_docs), column("<i8", n_docs), column("<u4", n_docs)
    lengths, sizes, checks = (column("<u4", n_blocks) for _ in range(3))
    edges = at + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    payloads = [frame[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    for i, (payload, check) in enumerate(zip(payloads, checks.tolist(), strict=True)):
        if zlib.crc32(payload) != check:
            raise ValueError(f"block {i} is damaged")
    ids = np.concatenate(decode_blocks(payloads, lengths.tolist()))
    if len(ids) != n_ids:
        raise ValueError("the frame holds another number of ids than it says")
    cuts = np.cumsum(n_tokens, dtype=np.int64)[:-1]
    return [None if n else int(d) for n, d in zip(null, doc_ids, strict=True)], np.split(ids, cuts)


# -- tokenizer -----------------------------------------------------------------

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[\t\n -~{_LETTERS}]*\Z")  # characters whose class is beyond doubt
# The tokenizer's own rule for cutting text into pieces, for plain characters (a fixed value); letters, digits and
# apostrophes begin different pieces, so the order of these alternatives is free
_PIECE = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_BLANKS = ("  ", "\n\n", " \n", "\n ", "\t", "\0")  # where blanks may be more than one; zeros fill up a table's keys
MEMO_PIECES = 50_000  # of each of two generations
MEMO_LETTERS = 64  # a longer piece is not kept
_ID = attrgetter("id")
_PROBES = 4
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_BLANK, _LETTER, _DIGIT, _OTHER = range(4)
_KINDS = np.full(256, _OTHER, np.uint8)  # of a plain text's bytes
_KINDS[[10, 32]] = _BLANK
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KINDS[48:58] = _DIGIT


def _meet(text: str) -> bool:
    return any([b in text for b in _BLANKS])


class _NotPlain(Exception):
    pass


class _Memo(dict):
    """Ids by piece, asked for once; what was not used for a whole generation is forgotten."""

    def __init__(self, ask: Callable[[str], bytes]):
        super().__init__()
        self.ask, self.old = ask, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.ask(piece)
        if len(piece) <= MEMO_LETTERS:
            if len(self) >= MEMO_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level tokenizer writes each byte: itself where it is visible, else one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _PieceTable:
    """Ids of pieces of up to 24 bytes in an array: three numbers of a piece's bytes, then up to seven ids and their count.

    A piece lies in one of ``_PROBES`` rows that follow its hash, and is compared in full.  Where all are taken, the
    newest piece takes the first one's place.
    """

    def __init__(self, bits: int = 21):
        self.shift = np.uint64(64 - bits)
        self.rows = np.zeros(((1 << bits) + _PROBES, 5), np.uint64)

    def keys(self, text: bytes, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three numbers that make up each piece, and its first row."""
        window = np.ndarray((len(text) + 17,), "<u8", text + bytes(24), strides=(1,))
        parts = np.stack([window[begin + at] & _MASKS.take(size - at, mode="clip") for at in (0, 8, 16)])
        mixed = parts[0] * _ODD[0] ^ parts[1] * _ODD[1] ^ parts[2] * _ODD[2]
        mixed = (mixed ^ mixed >> np.uint64(32)) * _ODD[0] >> self.shift
        return parts, mixed.astype(np.int64)

    def find(self, parts: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The row of each piece, -1 where it is not known."""
        flat = self.rows.reshape(-1)
        found = np.full(len(row), -1)
        left = np.arange(len(row))
        for probe in range(_PROBES):
            row = row + (probe > 0)
            at = row * 5
            same = (flat.take(at) == parts[0]) & (flat.take(at + 1) == parts[1]) & (flat.take(at + 2) == parts[2])
            found[left[same]] = row[same]
            other = np.flatnonzero(~same)
            left, row, parts = left[other], row[other], parts[:, other]
        return found

    def add(self, parts: np.ndarray, row: np.ndarray, told: np.ndarray) -> None:
        new = np.concatenate([parts.T, told.view(np.uint64)], axis=1)
        for probe in range(_PROBES):
            free = np.flatnonzero(self.rows[row + probe, 0] == 0)
            self.rows[row[free] + probe] = new[free]
            left = (self.rows[row + probe, :3] != new[:, :3]).any(axis=1)
            row, new = row[left], new[left]
        self.rows[row] = new


class _Asked(dict):
    def __init__(self, ask: Callable[[bytes], bytes]):
        super().__init__()
        self.ask = ask

    def __missing__(self, piece: bytes) -> bytes:
        found = self[piece] = self.ask(piece)
        return found


class PieceTokenizer:
    """Ids of whole texts by the tokenizers library, whose model is asked once for each different piece.

    Byte-level BPE never merges across pieces, so the ids of a text are those of its pieces laid end to end.  Texts in
    which no two blanks meet are cut and looked up many at a time by whole arrays.  Texts with other characters or with
    the look of a special token go to the library whole, and so does every text if the tokenizer is of another kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > _NOTHING:
            raise ValueError("ids do not fit into 16 bits")
        told = json.loads(self.library.to_str())
        cut, model = told["pre_tokenizer"] or {}, told["model"]
        self.by_pieces = (
            told["normalizer"] is None
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut["add_prefix_space"]
            and model["type"] == "BPE"
            and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and all(t["content"].startswith("<|") for t in told["added_tokens"])
        )
        self.model, self.letters = self.library.model, _byte_letters()
        self.pieces, self.table = _Memo(self._piece), _PieceTable()

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def _piece(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.isprintable()
        written = piece.replace(" ", "Ġ") if plain else piece.encode().decode("latin-1").translate(self.letters)
        return array("H", map(_ID, self.model.tokenize(written))).tobytes()

    def _cut(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.match(text):
            raise _NotPlain
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))

    def _one(self, text: str) -> bytes:
        try:
            return self._cut(text) if self.by_pieces else self._whole(text)
        except _NotPlain:
            return self._whole(text)

    def _new(self, piece: bytes) -> bytes:
        """Ids of one piece, or of several around an apostrophe; nothing where other than plain characters occur."""
        text = piece.decode()
        if not (text.isprintable() and text.isascii() or _PLAIN.match(text)) or "<|" in text:
            return b""
        if "'" in text:
            return self._cut(text)
        return self.pieces[text] if len(text) > 11 else self._piece(text)  # the table may have no room for its ids

    def _single(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of texts in which no two blanks meet; None for texts with other than plain characters."""
        lines = [("\n" + t).encode() for t in texts]
        text = b"".join(lines)
        raw = np.frombuffer(text, np.uint8)
        kind = _KINDS.take(raw)
        # a piece begins at a blank, or where letters, digits and others meet; apostrophes are left to the rule itself
        starts = np.ones(len(raw), bool)
        starts[1:] = (kind[1:] != kind[:-1]) & (raw[:-1] != 32) & (raw[1:] != 39) & (raw[:-1] != 39) | (kind[1:] == _BLANK)
        begin = np.flatnonzero(starts)
        size = np.diff(begin, append=len(raw))
        parts, row = self.table.keys(text, begin, size)
        found = self.table.find(parts, row)
        found[size > 24] = -1
        told = self.table.rows.take(found, axis=0, mode="clip")[:, 3:].copy().view(np.uint16)  # seven ids and their count
        missed = np.flatnonzero(found < 0)
        cut = [text[a:b] for a, b in zip(begin[missed].tolist(), (begin + size)[missed].tolist(), strict=True)]
        asked = _Asked(self._new)
        ids = list(map(asked.__getitem__, cut))
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        short = count <= 7
        fresh = np.zeros((len(ids), 8), np.uint16)
        fresh[:, 7] = count * short
        fresh[:, :7][np.arange(7) < fresh[:, 7:]] = np.frombuffer(b"".join(compress(ids, short.tolist())), np.uint16)
        told[missed] = fresh
        kept = np.fromiter(dict(zip(cut, range(len(cut)), strict=True)).values(), np.int64, len(asked))
        kept = kept[(fresh[kept, 7] > 0) & (size[missed[kept]] <= 24)]
        self.table.add(parts[:, missed[kept]], row[missed[kept]], fresh[kept])
        firsts = np.searchsorted(begin, np.cumsum([0, *map(len, lines)]))
        out = told[:, :7][np.arange(7) < told[:, 7:]]
        number = told[:, 7].astype(np.int64)
        long = np.flatnonzero(~short)
        if len(long):
            rest = np.frombuffer(b"".join(map(ids.__getitem__, long.tolist())), np.uint16)
            out = np.insert(out, np.repeat(np.cumsum(number)[missed[long]], count[long]), rest)
            number[missed[long]] = count[long]
        edges = np.append(0, np.cumsum(number))[firsts].tolist()
        left = set((np.searchsorted(firsts, missed[count == 0], "right") - 1).tolist())
        feed = len(self.pieces["\n"]) // 2
        return [None if i in left else out[a + feed : b] for i, (a, b) in enumerate(pairwise(edges))]

    def ids(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        raw: list = [b"" if not t else None for t in texts]
        single = [i for i, t in enumerate(texts) if t and self.by_pieces and t[0] not in " \n" and not _meet(t)]
        if single:
            for i, found in zip(single, self._single([texts[i] for i in single]), strict=True):
                raw[i] = found
        raw = [self._one(t) if r is None else r for t, r in zip(texts, raw, strict=True)]
        end = np.array([end_id], np.uint16)
        return [np.concatenate([np.frombuffer(r, np.uint16), end]) for r in raw]


_tokenizers: dict[str, PieceTokenizer] = {}


def _tokenizer(path: str) -> PieceTokenizer:
    """Kept by the worker process from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = PieceTokenizer(path)
    return _tokenizers[path]


# -- Spark ---------------------------------------------------------------------


def write_ids(documents: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write frames (shard, frame, first_doc, n_ids, data) in ascending order of doc_id, NULL first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tokenizer(tokenizer)
        ids: list = []
        tokens: list[np.ndarray] = []
        held = number = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int32()),
                    pa.array([ids[0]], pa.int64()),
                    pa.array([held], pa.int64()),
                    pa.array([write_frame(ids, tokens)], pa.binary()),
                ],
                names=["frame", "first_doc", "n_ids", "data"],
            )

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for doc, found in zip(
                    batch.column("doc_id").to_pylist(), tool.ids(batch.column("text").to_pylist(), end_id), strict=True
                ):
                    ids.append(doc)
                    tokens.append(found)
                    held += len(found)
                    if held >= FRAME_IDS:
                        yield close()
                        ids, tokens, held, number = [], [], 0, number + 1
        if ids:
            yield close()

    table = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = table.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    frames = ordered.mapInArrow(run, "frame int, first_doc long, n_ids long, data binary")
    frames.withColumn("shard", F.spark_partition_id()).write.option("compression", "none").parquet(folder)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            docs, tokens = read_frame(batch.column("data")[i].as_py())
            lengths = np.array([len(t) for t in tokens])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("shard")[i].as_py()] * len(docs), pa.int32()),
                    pa.array([batch.column("frame")[i].as_py()] * len(docs), pa.int32()),
                    pa.array(docs, pa.int64()),
                    pa.array(np.cumsum(lengths) - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in tokens], pa.int64()),
                ],
                names=["shard", "frame", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_spans(frames: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, from the decoded ids."""
    # one narrow row per frame of about FRAME_IDS ids passes through this window
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "shard", "frame")
    starts = frames.select("shard", "frame", (F.sum("n_ids").over(order) - F.col("n_ids")).alias("before"))
    decoded = frames.select("shard", "frame", "data").mapInArrow(
        _spans, "shard int, frame int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    return decoded.join(starts, ["shard", "frame"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def coded(documents: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the ids of all documents and read them back."""
    folder = f"{folder or shared_dir(documents.sparkSession)}/token-ids"
    write_ids(documents, folder, tokenizer)
    spark = documents.sparkSession
    return read_spans(spark.read.schema("frame int, first_doc long, n_ids long, data binary, shard int").parquet(folder))
