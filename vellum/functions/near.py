"""Words of a lexicon within three edits of others, exactly: arrays of code points, candidates by shared forms, distances in a band."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np

#: Most edits. Words of the lexicon up to SHORT code points meet by forms with up to EDITS letters less, longer ones by a half with one edit at most.
EDITS, SHORT = 3, 12
#: Keys of the lexicon that are held at once, and keys of others, or candidates by those before them, that are looked up at once.
HELD, ASKED = 1 << 20, 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Words:
    """Words of one length as rows of code points; sums are polynomial hashes of their beginnings."""

    def __init__(self, words: list[str], size: int) -> None:
        self.size = size
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size)

    def sums(self, back: bool, at: slice, most: int) -> np.ndarray:
        x = self.codes[at, ::-1] if back else self.codes[at]
        x = x[:, :most].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        out = np.zeros((len(x), x.shape[1] + 1), np.uint64)
        np.cumsum((x ^ (x >> np.uint64(31))) * _powers(_BASE, x.shape[1]), axis=1, out=out[:, 1:])
        return out


def _powers(base: int, n: int) -> np.ndarray:
    return np.array([pow(base, i, 1 << 64) for i in range(n)], np.uint64)


def forms(sums: np.ndarray, size: int, less: int) -> np.ndarray:
    """Hashes of the first size letters without each choice of less of them, a row for each word."""
    back = [np.uint64(pow(_INVERSE, r, 1 << 64)) for r in range(less + 1)]
    picks = np.array(list(combinations(range(size), less)), np.int64).reshape(comb(size, less), less)
    out = np.repeat((sums[:, size] * back[less])[:, None], len(picks), axis=1)
    for r in range(less):
        out += (sums[:, :size] * back[r] - sums[:, 1 : size + 1] * back[r + 1])[:, picks[:, r]]
    return out


class Keys:
    """Hashes with the rows that have them."""

    def __init__(self, hashes: list[np.ndarray], rows: list[np.ndarray]) -> None:
        h = np.concatenate([x.ravel() for x in hashes])
        r = np.concatenate([np.repeat(i.astype(np.int32), x.shape[1]) for x, i in zip(hashes, rows)])
        self.shift = np.uint64(64 - max(8, int(len(h)).bit_length() + 1))
        spot = self._spot(h)
        order = np.argsort(spot)
        self.hashes, self.rows = h[order], r[order]
        self.ends = np.zeros((1 << (64 - int(self.shift))) + 1, np.int32)
        np.cumsum(np.bincount(spot, minlength=len(self.ends) - 1), out=self.ends[1:])

    def _spot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def meet(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the argument and rows of these with a common hash."""
        h = hashes.ravel()
        spot = self._spot(h)
        start = self.ends[spot]
        n = self.ends[spot + 1] - start
        hit = np.flatnonzero(n)
        n, start = n[hit], start[hit]
        asked = np.repeat(hit, n)
        at = np.arange(len(asked)) + np.repeat(start - (np.cumsum(n) - n), n)
        same = self.hashes[at] == h[asked]
        return asked[same] // hashes.shape[1], self.rows[at[same]]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of words in columns (letters by pairs), EDITS + 1 where there are more edits. Only diagonals that a path of so many edits reaches are kept."""
    n, m = len(a), len(b)
    far = np.full(a.shape[1], EDITS + 1, np.uint8)
    lanes = [k for k in range(-EDITS, EDITS + 1) if abs(k) + abs(m - n - k) <= EDITS]
    row = {k: np.full(a.shape[1], k, np.uint8) if 0 <= k <= m else far for k in lanes}
    for i in range(1, n + 1):
        new = {}
        for k in lanes:
            j = i + k
            if j < 0 or j > m:
                new[k] = far
                continue
            if j == 0:
                new[k] = np.full(a.shape[1], min(i, EDITS + 1), np.uint8)
                continue
            best = row[k] + (a[i - 1] != b[j - 1])
            for other in (row.get(k + 1), new.get(k - 1)):
                if other is not None:
                    np.minimum(best, other + np.uint8(1), out=best)
            new[k] = np.minimum(best, far, out=best)
        row = new
    return row[m - n]


class Part:
    """Some words of the lexicon, of rising length, with their keys. places: which words of the lexicon they are."""

    def __init__(self, words: list[str], places: np.ndarray) -> None:
        self.places, sizes = places, np.array([len(w) for w in words])
        self.groups: dict[int, tuple[int, Words]] = {}
        most, fewer, self.halves = {}, {}, {}
        for m in np.unique(sizes).tolist():
            first, end = np.searchsorted(sizes, [m, m + 1]).tolist()
            self.groups[m] = first, (group := Words(words[first:end], m))
            rows = np.arange(first, end)
            if m > SHORT:
                for back, h in ((False, m // 2), (True, m - m // 2)):
                    sums = group.sums(back, slice(None), h)
                    self.halves[m, back] = tuple(Keys([forms(sums, h, less)], [rows]) for less in (0, 1))
                continue
            sums = group.sums(False, slice(None), m)
            for less in range(min(m, EDITS) + 1):
                to = most if less == EDITS else fewer
                to.setdefault(m - less, []).append((forms(sums, m, less), rows))
            if m < EDITS:  # All words so short are near each other: they meet by the empty form.
                most.setdefault(0, []).append((forms(sums, m, m), rows))
        self.most, self.fewer = ({f: Keys(*map(list, zip(*x))) for f, x in d.items()} for d in (most, fewer))

    def _candidates(self, sums: np.ndarray, group: Words, at: slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = group.size
        if n <= SHORT + EDITS:
            if n < EDITS and 0 in self.most:
                yield self.most[0].meet(forms(sums, n, n))
            for less in range(min(n, EDITS) + 1):
                tables = (self.most, self.fewer) if less == EDITS else (self.most,)
                known = [t[n - less] for t in tables if n - less in t]
                if known:
                    h = forms(sums, n, less)
                    yield from (t.meet(h) for t in known)
        for m in range(max(SHORT + 1, n - EDITS), n + EDITS + 1):
            for back in (False, True):
                if (m, back) in self.halves:
                    whole, less = self.halves[m, back]
                    h = m - m // 2 if back else m // 2
                    s = group.sums(back, at, h + 1)
                    yield less.meet(s[:, h - 1 : h])
                    if h <= n:
                        yield less.meet(forms(s, h, 1))
                    if h + 1 <= n:
                        yield whole.meet(forms(s, h + 1, 1))

    def near(self, group: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a row of the group and a word of this part with 1 to EDITS edits, and their edits."""
        n, found = group.size, []
        per_word = max(8, comb(n, EDITS) if n <= SHORT + EDITS else 8 * n)
        start, step = 0, max(1, min(256, ASKED // per_word))
        while start < len(group.codes):
            at = slice(start, start + step)
            sums = group.sums(False, at, n) if n <= SHORT + EDITS else None
            met = [(b.astype(np.int64) << 32) | (a + start) for a, b in self._candidates(sums, group, at)]
            pairs = np.sort(np.concatenate(met)) if met else np.empty(0, np.int64)
            pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)]]
            b, a = pairs >> 32, pairs & 0xFFFFFFFF
            for m, (first, other) in self.groups.items():
                if abs(m - n) <= EDITS:
                    lo, hi = np.searchsorted(b, [first, first + len(other.codes)])
                    for i in range(lo, hi, ASKED):
                        x, y = a[i : min(hi, i + ASKED)], b[i : min(hi, i + ASKED)]
                        d = distances(group.codes.T[:, x], other.codes.T[:, y - first])
                        ok = (d > 0) & (d <= EDITS)
                        found.append((x[ok], self.places[y[ok]], d[ok]))
            start, step = start + step, max(1, ASKED // max(per_word, sum(map(len, met)) // step))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


class Lexicon:
    """Words without repeats, in the order of their code points."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        self.parts: list[list[int]] = []
        held = HELD
        for i in order:
            n = len(words[i])
            cost = sum(comb(n, less) for less in range(EDITS + 1)) if n <= SHORT else n + 4
            if held + cost > HELD:
                self.parts.append([])
                held = 0
            self.parts[-1].append(i)
            held += cost
        self._one: Part | None = None

    def _part(self, places: list[int]) -> Part:
        """The keys of a lexicon of one part stay."""
        if len(self.parts) > 1:
            return Part([self.words[i] for i in places], np.array(places))
        if not self._one:
            self._one = Part([self.words[i] for i in places], np.array(places))
        return self._one

    def nearest(self, words: list[str], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words their up to most words of the lexicon with 1 to EDITS edits, fewest edits first, then by code points: places of the words, places in the lexicon, ranks from 1."""
        sizes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            sizes.setdefault(len(w), []).append(i)
        groups = [(np.array(places), Words([words[i] for i in places], n)) for n, places in sizes.items()]
        best = np.empty(0, np.uint64), np.empty(0, np.int64)
        for chosen in self.parts:
            part, found = self._part(chosen), [best]
            for places, group in groups:
                a, b, d = part.near(group)
                found.append(((places[a].astype(np.uint64) << np.uint64(2)) | d.astype(np.uint64), b.astype(np.int64)))
            key, b = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((b, key))
            key, b = key[order], b[order]
            best = tuple(x[ranks(key) <= most] for x in (key, b))
        key, b = best
        return (key >> np.uint64(2)).astype(np.int64), b, ranks(key)


def ranks(key: np.ndarray) -> np.ndarray:
    """Places from 1 among the neighbours of one word; key holds words and, in two bits, edits."""
    if not len(key):
        return np.empty(0, np.int64)
    new = np.r_[True, (key[1:] >> np.uint64(2)) != (key[:-1] >> np.uint64(2))]
    starts = np.flatnonzero(new)
    return np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)])) + 1
