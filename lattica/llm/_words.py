"""Words of whole Arrow string columns with numpy: places, 64-bit hashes and rolling hashes, without a Python object for each word.

A word is a longest run of digits, letters a-z (A-Z lower-cased) and bytes of non-ASCII characters. Nulls are empty texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together; a longer document is taken alone. Temporary arrays take some 50 times as much.
CHUNK = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


STEP = np.uint64(0x9E3779B97F4A7C15)
#: A lane of n bytes, little-endian, keeps its first n.
LANE_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) over the column."""
    texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def find(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & ~(np.concatenate([[False], inside[:-1]]) & ~edge[:-1]))
    ends = np.flatnonzero(inside & ~(np.concatenate([inside[1:], [False]]) & ~edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = CHUNK) -> np.ndarray:
    """A 64-bit hash of each word: the sum of its lanes of 8 bytes, each mixed with its place, mixed with the length.

    Every lane is mixed before it is added, so no sum of powers is there for words to cancel in."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    low = np.zeros(len(data) + 8, np.uint8)
    low[: len(data)] = LOWER[data]
    lane = np.ndarray((len(data) + 1,), "<u8", low, strides=(1,))
    size = ends - starts
    n = (size + 7) >> 3
    with np.errstate(over="ignore"):
        out[:] = mix((lane[starts] & LANE_MASKS[np.minimum(size, 8)]) + STEP)
        more = np.flatnonzero(n > 1)
        total = np.cumsum(n[more] - 1)
        a = 0
        while a < len(more):  # the lanes after the first ones, `limit` or so together
            done = int(total[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(total, done + limit, side="right")))
            at = more[a:b]
            lanes = n[at] - 1
            first = np.cumsum(lanes) - lanes
            place = np.arange(int(lanes.sum())) - np.repeat(first, lanes) + 1
            begin = np.repeat(starts[at], lanes) + 8 * place
            value = lane[begin] & LANE_MASKS[np.minimum(np.repeat(ends[at], lanes) - begin, 8)]
            out[at] += np.add.reduceat(mix(value ^ mix((place.astype(np.uint64) + np.uint64(1)) * STEP)), first)
            a = b
        return mix(out ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def rollings(words: np.ndarray, rows: np.ndarray, sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, positions, hashes) of every k consecutive words of one row, for each k of sizes."""
    sizes, out = set(sizes), np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, max(sizes, default=0) + 1):
            n = len(words) - k + 1
            if n <= 0:
                return
            out = out[:n]
            out ^= words[k - 1 :]
            out *= np.uint64(0xA0761D6478BD642F)
            out ^= out >> np.uint64(29)
            if k in sizes:
                at = np.flatnonzero(rows[:n] == rows[k - 1 :])
                yield k, at, mix(out[at] + np.uint64(k))


def rolling(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of every k consecutive words of one row."""
    return next(((at, hashed) for _, at, hashed in rollings(words, rows, [k])), (np.zeros(0, np.int64), np.zeros(0, np.uint64)))


def digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 128-bit BLAKE2 digest of each row's words in order, which does not depend on what stands between them."""
    inside = IN_WORD[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    kept = inside | before  # a word and one byte after it
    plain = np.where(inside, LOWER[data], np.uint8(32))[kept].tobytes()
    cuts = np.concatenate([[0], np.cumsum(kept)])[offsets].tolist()
    return [hashlib.blake2b(plain[a:b].strip(b" "), digest_size=16).digest() for a, b in zip(cuts, cuts[1:], strict=False)]


def hash_of(words: list[bytes]) -> np.ndarray:
    """The hashes that hashes() gives these words of a text."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return hashes(data, ends - np.array([len(w) for w in words]), ends) if words else np.zeros(0, np.uint64)


def words(text: str | None) -> list[bytes]:
    """The words of one short text, such as a template's."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    low = LOWER[data].tobytes()
    starts, ends, _ = find(data, np.array([0, len(data)]))
    return [low[a:b] for a, b in zip(starts, ends, strict=True)]
