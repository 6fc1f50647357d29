"""Fuzzy matches of many names at once: letter masks, bounds on the scores, an affine-gap alignment in NumPy.

The score is that of ``match``: 16 a character, a bonus at word starts (doubled for the first character) that
consecutive characters inherit, a price for gaps. Case counts only if the text asked for has a capital.
"""

from __future__ import annotations

import numpy as np

MATCH, FIRST_BONUS, BOUNDARY, CAMEL, CONSECUTIVE, GAP_START, GAP_MORE = 16, 2, 10, 5, 4, 3, 1
#: Cells of one alignment matrix; longer names than this are aligned one by one.
CELLS = 1 << 20
_LOW = -(10**9)
_ONE = np.uint64(1)


def folds(text: str) -> bool:
    """Whether case is ignored for this text."""
    return not any(map(str.isupper, text))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _bit(x: np.ndarray) -> np.ndarray:
    return _ONE << (x.astype(np.uint64) & np.uint64(63))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) * np.uint64(31) + b) & np.uint64(255)


class Names:
    """Names as code points, with their bonuses and what their masks say."""

    def __init__(self, names: list[str], fold: bool):
        low = [x.lower() for x in names] if fold else names
        # a name whose lower case is longer is scored as its lower case
        shown = [a if len(a) == len(b) else b for a, b in zip(names, low)]
        self.length = np.fromiter(map(len, low), np.int64, len(low))
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        self.hay = points("".join(low))
        self.bonus = self._bonuses(points("".join(shown)))
        bits, last = _bit(self.hay), np.zeros(len(self.hay), bool)
        last[self.at[1:][self.length > 0] - 1] = True
        self.letters = self._any(bits)
        self.heads = self._any(np.where(self.bonus == BOUNDARY, bits, np.uint64(0)))
        self.humps = self._any(np.where(self.bonus == CAMEL, bits, np.uint64(0)))
        pair = np.zeros(len(self.hay), np.uint64)
        pair[:-1] = _pair(self.hay[:-1], self.hay[1:])
        word = np.where(last, np.uint64(4), pair >> np.uint64(6))
        self.pairs = [self._any(np.where(word == np.uint64(w), _bit(pair), np.uint64(0))) for w in range(4)]

    def _any(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.length), np.uint64)
        full = self.length > 0
        if full.any():
            out[full] = np.bitwise_or.reduceat(bits, self.at[:-1][full])
        return out

    def _bonuses(self, shown: np.ndarray) -> np.ndarray:
        if not len(shown):
            return np.zeros(0, np.int32)
        there = np.flatnonzero(np.bincount(shown))
        kinds = np.zeros((4, int(shown.max()) + 1), bool)
        for k, test in enumerate((str.isalnum, str.isupper, str.islower, str.isdigit)):
            kinds[k, there] = [test(chr(c)) for c in there]
        word, upper, lower, digit = (k[shown] for k in kinds)
        before = np.zeros((3, len(shown)), bool)
        for row, kind in zip(before, (word, lower, digit)):
            row[1:] = kind[:-1]
            row[self.at[:-1][self.length > 0]] = False
        hump = upper & before[1] | digit & ~before[2]
        return np.where(word & ~before[0], BOUNDARY, np.where(hump, CAMEL, 0)).astype(np.int32)

    def candidates(self, needle: np.ndarray) -> np.ndarray:
        """Rows that have all letters of the needle."""
        need = np.bitwise_or.reduce(_bit(needle))
        return np.flatnonzero(((self.letters & need) == need) & (self.length >= len(needle)))

    def bounds(self, needle: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """No match of these rows scores more."""
        heads, humps, bits = self.heads[rows], self.humps[rows], _bit(needle)
        bonus = [np.where(heads & b, BOUNDARY, np.where(humps & b, CAMEL, 0)) for b in bits]
        total, held = MATCH + FIRST_BONUS * bonus[0], bonus[0] == BOUNDARY
        for i in range(1, len(needle)):
            pair = _pair(needle[i - 1 : i], needle[i])
            next_to = (self.pairs[int(pair[0] >> np.uint64(6))][rows] & _bit(pair)[0]) != 0
            held = (bonus[i] == BOUNDARY) | held & next_to
            run = np.where(next_to, np.where(held, BOUNDARY, max(CAMEL, CONSECUTIVE)), _LOW)
            total = total + MATCH + np.maximum(run, bonus[i] - GAP_START)
        return total

    def scores(self, needle: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Best alignment of the needle with each of the rows; below zero where it is no subsequence."""
        out = np.full(len(rows), _LOW, np.int64)
        order, begin = np.argsort(self.length[rows], kind="stable")[::-1], 0
        while begin < len(rows):
            width = int(self.length[rows[order[begin]]])
            some = order[begin : begin + max(1, CELLS // max(1, width))]
            out[some] = self._aligned(needle, rows[some], width)
            begin += len(some)
        return out

    def _aligned(self, needle: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
        column = np.arange(width)
        inside = column < self.length[rows][:, None]
        cell = np.minimum(self.at[rows][:, None] + column, len(self.hay) - 1)
        hay, bonus = self.hay[cell], self.bonus[cell]
        equal = (hay == needle[0]) & inside
        score = np.where(equal, MATCH + FIRST_BONUS * bonus, _LOW)
        run = np.where(equal, bonus, 0)
        for c in needle[1:]:
            # the best end two or more places back, less what the gap costs
            gap = np.full_like(score, _LOW)
            gap[:, 2:] = (np.maximum.accumulate(score + GAP_MORE * column, axis=1) - GAP_MORE * column - GAP_START)[:, :-2] if width > 2 else gap[:, 2:]
            gap = np.where(gap > _LOW // 2, gap + MATCH + bonus, _LOW)
            near, held = np.full_like(score, _LOW), np.zeros_like(run)
            near[:, 1:], held[:, 1:] = score[:, :-1], run[:, :-1]
            held = np.maximum(np.maximum(held, bonus), CONSECUTIVE)
            near = np.where(near > _LOW // 2, near + MATCH + held, _LOW)
            equal = (hay == c) & inside
            score = np.where(equal, np.maximum(near, gap), _LOW)
            run = np.where(gap > near, bonus, held)
        best = score.max(axis=1, initial=_LOW)
        return np.where(best > _LOW // 2, best, _LOW)


class Best:
    """The best of one query so far, ties to smaller ids."""

    def __init__(self, most: int):
        self.most, self.score, self.id, self.name = most, np.zeros(0, np.int64), None, np.zeros(0, object)

    def may_enter(self, bound: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if len(self.score) < max(1, self.most):
            return np.ones(len(bound), bool)
        worst = self.score[-1]
        return (bound > worst) | (bound == worst) & (ids < self.id[-1])

    def add(self, score: np.ndarray, ids: np.ndarray, names: np.ndarray) -> None:
        score = np.concatenate([self.score, score])
        ids = ids if self.id is None else np.concatenate([self.id, ids])
        names = np.concatenate([self.name, names])
        keep = np.lexsort((ids, -score))[: self.most]
        self.score, self.id, self.name = score[keep], ids[keep], names[keep]


def search(best: Best, text: str, names: Names, shown: np.ndarray, ids: np.ndarray, factor: np.ndarray) -> None:
    """Add what matches to ``best``: rows of high bounds first, so that the others need no alignment."""
    needle = points(text.lower() if folds(text) else text)
    rows = names.candidates(needle)
    bound = np.floor(names.bounds(needle, rows) * factor[rows] + 0.5).astype(np.int64)
    order = np.argsort(-bound, kind="stable")
    rows, bound, step = rows[order], bound[order], max(1, 2 * best.most)
    while len(rows):
        now = rows[:step]
        score = names.scores(needle, now)
        hit = score >= 0
        now = now[hit]
        best.add(np.floor(score[hit] * factor[now] + 0.5).astype(np.int64), ids[now], shown[now])
        rows, bound, step = rows[step:], bound[step:], 2 * step
        left = best.may_enter(bound, ids[rows])
        rows, bound = rows[left], bound[left]
