"""Encoding by distinct pieces: texts are cut into short pieces, each distinct one is encoded once.

A piece is what stands between single spaces or line feeds. If it is a run of
plain letters, with or without stops (ASCII punctuation) after it, the two are
taken as pieces of their own. Pieces are known by a 64-bit hash. The ids of known pieces
are kept by the worker process in flat arrays of bounded size; a batch needs one
lookup for each of its distinct pieces, and one gather for all of its ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from readloom.llm.text import ByteClass, mix

MOST_PIECES = 500_000  # of the kept table


def _between() -> ByteClass:
    member = np.ones(256, bool)
    member[[32, 10]] = False
    return ByteClass(member, False)


BETWEEN = _between()
ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
STOP = np.array([33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in range(256)])
BODY, RAW, STOPS, BREAK = (np.uint64(k) for k in (1, 2, 3, 4))


@dataclass(frozen=True)
class Pieces:
    data: np.ndarray
    starts: np.ndarray
    middles: np.ndarray  # where the stops start, or the end
    ends: np.ndarray
    plain: np.ndarray  # a body of letters of ASCII or of U+00C0 to U+00FF
    first: np.ndarray  # each text's first piece, n + 1 values


def cut(data: np.ndarray, offsets: np.ndarray) -> Pieces:
    starts, ends, first = BETWEEN.words(data, offsets)
    before = np.zeros(len(data), np.uint8)
    before[1:] = data[:-1]
    after = (before == 0xC3) & ((data & 0xC0) == 0x80) & (data != 0x97) & (data != 0xB7)
    other = np.zeros(len(data) + 1, np.int32)
    np.cumsum(~(ASCII_LETTER[data] | (data == 0xC3) | after), out=other[1:])
    place = np.arange(len(data), dtype=np.int32)
    last = np.maximum.accumulate(np.where(STOP[data], -1, place)) if len(data) else place
    middles = np.maximum(last[ends - 1] + 1, starts) if len(ends) else ends
    plain = (middles > starts) & (other[middles] == other[starts])
    # C3 as the last byte before a cut is never plain, as texts are valid UTF-8.
    middles = np.where(plain, middles, ends)
    return Pieces(data, starts, middles, ends, plain, first)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z and U+00C0 to U+00DE in lower case, as UTF-8 bytes."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    latin = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    out[1:][latin] += 32
    return out


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return mix(EVERY.hashes(data, starts, ends) ^ (tag * np.uint64(0xA24BAED4963EE407)))


EVERY = ByteClass(np.ones(256, bool), False)


class Table:
    """Hash of a piece -> its ids. ``encode`` gets the bytes of new pieces and gives an array of ids for each."""

    def __init__(self, encode: Callable[[list[bytes], np.ndarray], list[np.ndarray]]):
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def lookup(self, key: np.ndarray, spell: Callable[[np.ndarray], tuple[list[bytes], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each piece. ``spell`` gives
        the bytes and the tags of the pieces at some places of ``key``."""
        if not len(key):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.known) > MOST_PIECES:
            self.forget()
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        distinct = ordered[fresh]
        place = np.searchsorted(self.known, distinct)
        place[place == len(self.known)] = 0
        missing = np.ones(len(distinct), bool) if not len(self.known) else self.known[place] != distinct
        if missing.any():
            new = self.encode(*spell(order[fresh][missing]))
            sizes = np.array([len(x) for x in new], np.int32)
            begin = len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes
            slots = np.arange(len(self.begin), len(self.begin) + len(new), dtype=np.int32)
            self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, sizes])
            self.ids = np.concatenate([self.ids, *new]) if new else self.ids
            at = np.searchsorted(self.known, distinct[missing])
            self.known, self.slot = np.insert(self.known, at, distinct[missing]), np.insert(self.slot, at, slots)
            place = np.searchsorted(self.known, distinct)
        of = np.empty(len(key), np.int32)
        of[order] = self.slot[place][np.cumsum(fresh) - 1]
        sizes = self.size[of].astype(np.int64)
        shift = self.begin[of] - (np.cumsum(sizes) - sizes)
        return self.ids[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes


def interleave(*columns: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of several columns, piece by piece, where the piece has them; and for
    each the piece's number times the number of columns plus the column's."""
    key = np.stack([k for k, _ in columns], 1).reshape(-1)
    there = np.flatnonzero(np.stack([m for _, m in columns], 1).reshape(-1))
    return key[there], there
