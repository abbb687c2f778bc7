"""Two-stage suffix sorting of a block of byte fragments, on numpy arrays.

A suffix is either smaller or larger than its successor, the suffix that starts one
byte on. Only those smaller than their successors are sorted directly, on their
first `length` bytes. The larger ones are induced: buckets (suffixes of one first
byte) are scanned in ascending order, and the predecessor of each scanned suffix,
where larger, goes to the end of its own bucket's larger part. A fragment ends in a
sentinel below all bytes. Suffixes that neither are asked for nor are needed to
induce one are left out.

The order is exact on the first `length` bytes, so suffixes that agree on them are
neighbours, and common prefixes of neighbours tell how far every suffix repeats.
"""

from __future__ import annotations

import numpy as np


class Block:
    """Fragments joined, each behind by a sentinel; wanted[i] of the first starts of fragment i are asked for."""

    def __init__(self, fragments: list[bytes], wanted: list[int]):
        self.text = b"\0".join(fragments) + b"\0"
        sizes = np.array([len(f) for f in fragments], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        self.ends = self.starts + sizes
        self.codes = np.frombuffer(self.text, np.uint8).astype(np.int16) + 1
        self.codes[self.ends] = 0
        count = np.minimum(np.array(wanted, np.int64), sizes)
        edges = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(edges, self.starts, 1)
        np.add.at(edges, self.starts + count, -1)
        self.asked = np.cumsum(edges[:-1]) > 0

    def smaller(self) -> np.ndarray:
        """Whether each suffix is smaller than its successor; a sentinel counts as smaller."""
        codes = self.codes
        n = len(codes)
        at = np.arange(n)
        differs = np.ones(n, bool)
        differs[:-1] = codes[:-1] != codes[1:]
        deciding = np.minimum.accumulate(np.where(differs, at, n)[::-1])[::-1]
        after = np.append(codes[1:], 0)
        return (codes[deciding] < after[deciding]) | (codes == 0)

    def order(self, length: int) -> np.ndarray:
        """Starts asked for, in the order of their first `length` bytes."""
        codes, smaller = self.codes, self.smaller()
        n = len(codes)
        at = np.arange(n)
        next_smaller = np.minimum.accumulate(np.where(smaller, at, n)[::-1])[::-1]
        edges = np.zeros(n + 2, np.int64)
        chain = np.flatnonzero(self.asked & ~smaller)
        np.add.at(edges, chain, 1)
        np.add.at(edges, next_smaller[chain] + 1, -1)
        needed = self.asked | (np.cumsum(edges)[:n] > 0)

        direct = self._sorted(np.flatnonzero(needed & smaller), length)
        by_code = np.argsort(codes[direct], kind="stable")
        direct = direct[by_code]
        bounds = np.searchsorted(codes[direct], np.arange(258))
        induced: list[list[np.ndarray]] = [[] for _ in range(257)]
        larger = needed & ~smaller
        larger_after_first = np.append(larger, False)  # position -1 is never larger

        def induce(scanned: np.ndarray) -> None:
            before = scanned - 1
            before = before[larger_after_first[before]]
            first = codes[before]
            stable = np.argsort(first, kind="stable")
            before, first = before[stable], first[stable]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(before, cuts) if len(before) else ():
                induced[codes[part[0]]].append(part)

        out = []
        for code in range(257):
            while induced[code]:  # the bucket grows while it is scanned
                scanned = np.concatenate(induced[code])
                induced[code] = []
                induce(scanned)
                out.append(scanned)
            own = direct[bounds[code] : bounds[code + 1]]
            if len(own):
                induce(own)
                out.append(own)
        ranked = np.concatenate(out) if out else np.zeros(0, np.int64)
        return ranked[self.asked[ranked]]

    def _sorted(self, positions: np.ndarray, length: int) -> np.ndarray:
        owner = np.searchsorted(self.starts, positions, "right") - 1
        text, stops = self.text, np.minimum(positions + length, self.ends[owner])
        keys = [text[a:b] for a, b in zip(positions.tolist(), stops.tolist(), strict=True)]
        return positions[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)] if keys else positions

    def common_prefixes(self, order: np.ndarray, length: int) -> np.ndarray:
        """The bytes, at most `length`, on which suffixes order[i] and order[i + 1] agree."""
        a, b = order[:-1], order[1:]
        padded = np.frombuffer(self.text + bytes(length + 8), np.uint8)
        eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        owner = np.searchsorted(self.starts, order, "right") - 1
        left = self.ends[owner] - order
        most = np.minimum(np.minimum(left[:-1], left[1:]), length)
        out = np.zeros(len(a), np.int64)
        text = self.text
        whole = np.array([text[x : x + length] == text[y : y + length] for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
        out[whole] = length
        going = np.flatnonzero(~whole)
        for at in range(0, length, 8):
            differ = eights[a[going] + at] ^ eights[b[going] + at]
            ended = np.flatnonzero(differ)
            if len(ended):
                low = differ[ended] & (~differ[ended] + np.uint64(1))  # the lowest bit that differs tells the byte
                out[going[ended]] = at + np.log2(low.astype(np.float64)).astype(np.int64) // 8
            going = going[differ == 0]
            if not len(going):
                break
        out[going] = length
        return np.minimum(out, most).astype(np.int32)
