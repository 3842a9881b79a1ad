"""The run-length index of a text of byte strings: its Burrows-Wheeler transform in runs, with the places at the ends of
runs sampled, and matching statistics that stream from the samples."""

from __future__ import annotations

import numpy as np

#: Bytes that make one key: nine bits each, the end of a string being 0.
PACK = 7


def suffix_order(keys: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """The suffix array of a text, of which keys hold PACK bytes from each place on, up to the end of their string.
    closed: places so near that end that their key holds it. What is equal up to the end of a string comes by place."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    same = np.zeros(n, bool)  # as the one before
    same[1:] = (keys[order[1:]] == keys[order[:-1]]) & ~closed[order[1:]]
    rank, step = np.empty(n, np.int64), PACK
    while True:
        first = np.flatnonzero(~same)
        size = np.diff(np.append(first, n))
        rank[order] = np.repeat(first, size)
        if len(first) == n:
            return order
        at = np.flatnonzero(np.repeat(size, size) > 1)
        places = order[at]
        # a shared name stands for whole keys, so that the text goes on behind them
        shared = rank[places] * (n + 1) + rank[np.minimum(places + step, n - 1)]
        sort = np.argsort(shared, kind="stable")
        order[at] = places[sort]
        key = shared[sort]
        same[at[0]] = False
        same[at[1:]] = key[1:] == key[:-1]
        step *= 2


class RunIndex:
    """Of strings, end to end, each closed by a sign of its own: the heads and ends of the runs of the transform, each
    with its place in the text and how far the text agrees from there with its neighbour in the suffix array. All other
    places agree with theirs by one byte less than the place before them, and need no sample."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(x) + 1 for x in strings])
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.size = n = int(self.ends[-1])
        signs = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        signs[self.ends - 1] = 0
        left = np.repeat(self.ends, sizes) - np.arange(n) - 1  # bytes of the string from here on
        keys, ahead = np.zeros(n, np.int64), np.append(signs, np.zeros(PACK, np.int64))
        for k in range(PACK):
            keys = (keys << 9) | np.where(left > k, ahead[k : k + n], 0)
        order = suffix_order(keys, left < PACK)
        before = signs[order - 1]  # the transform; place 0 follows the last close
        closes = np.flatnonzero(before == 0)
        before[closes] = 256 + order[closes] + 1  # each close is a sign of its own
        cut = np.flatnonzero(before[1:] != before[:-1])  # runs end here, and the next begin behind
        self.runs = len(cut) + 1
        agree = self._agree(keys, left, order[cut], order[cut + 1])
        self.heads = np.append(order[cut + 1], order[0])
        self.tails = np.append(order[cut], order[-1])
        self.head_agree, self.tail_agree = np.append(agree, 0), np.append(agree, 0)

    @staticmethod
    def _agree(keys: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the strings share from places a and b on."""
        same, going = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(going):
            x, y = a[going] + same[going], b[going] + same[going]
            differ = keys[x] ^ keys[y]
            whole = differ == 0
            # the first of the bytes that differ, from the highest bit, which a float does not round up as none follows it
            bits = np.frexp(np.where(whole, 1, differ & ~(differ >> 1)).astype(np.float64))[1] - 1
            step = np.where(whole, PACK, PACK - 1 - bits // 9)
            step = np.minimum(step, np.minimum(left[x], left[y]))
            same[going] += step
            going = going[step == PACK]
        return same

    def matching_statistics(self) -> np.ndarray:
        """Of each place the longest stretch from there on, within its string, that begins elsewhere in the text too."""
        out = np.zeros(self.size, np.int64)
        place = np.arange(self.size)
        for samples, agree in ((self.heads, self.head_agree), (self.tails, self.tail_agree)):
            known = np.full(self.size, -1, np.int64)
            known[samples] = agree
            last = np.maximum.accumulate(np.where(known >= 0, place, 0))
            out = np.maximum(out, known[last] - (place - last))
        return out
