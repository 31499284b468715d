"""Suffix arrays by induced sorting, and repeats by permuted longest common prefixes. Numpy and plain lists, for one shard.

Suffixes are classified as larger (L) or smaller (S) than the next; leftmost smaller ones begin substrings that are sorted by
induction, named and, while names repeat, sorted by recursion on the string of names; their order then induces that of all
suffixes in two scans. A bucket's suffixes are induced in waves, each an array operation, where an alphabet is small for its
string; deeper levels, whose names are many and strings short, run one suffix at a time.
"""

from __future__ import annotations

import numpy as np

#: Letters for which a string must have so many places each before it is induced in waves.
DENSE = 40
END, SEPARATOR, FIRST = 0, 1, 2


def suffix_array(t: np.ndarray, letters: int) -> np.ndarray:
    """Order of the suffixes of t, whose last letter is 0 and the only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    # a run of equal letters has the type of its last one
    ends = np.flatnonzero(t[:-1] != t[1:])
    small = np.ones(n, bool)
    small[: n - 1] = np.repeat(t[ends] < t[ends + 1], np.diff(ends, prepend=-1))
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _waves if letters * DENSE < n else _one_by_one
    if len(leftmost) == 1:
        return induce(t, small, letters, leftmost)
    order = induce(t, small, letters, leftmost)
    is_left = np.zeros(n, bool)
    is_left[leftmost] = True
    order = order[is_left[order]]
    names, count = _names(t, leftmost, order)
    if count < len(leftmost):
        order = leftmost[suffix_array(names, count)]
    return induce(t, small, letters, order)


def _names(t: np.ndarray, leftmost: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings in the order of the text, equal ones alike, given them sorted; and how many."""
    size = np.empty(len(t), np.int64)
    size[leftmost] = np.diff(leftmost, append=leftmost[-1]) + 1
    a, b = order[:-1], order[1:]
    same = size[a] == size[b]
    at, offset = np.flatnonzero(same), 0
    while len(at):
        equal = t[a[at] + offset] == t[b[at] + offset]
        same[at[~equal]] = False
        offset += 1
        at = at[equal]
        at = at[size[a[at]] > offset]
    name = np.empty(len(t), np.int64)
    name[order] = np.r_[0, np.cumsum(~same)]
    return name[leftmost], int(name[order[-1]]) + 1


def _waves(t: np.ndarray, small: np.ndarray, letters: int, seeds: np.ndarray) -> np.ndarray:
    """All suffixes induced from sorted leftmost-smaller ones; a wave is what one array of sorted suffixes induces."""
    t = t.astype(np.uint16) if letters < 1 << 16 else t  # sorts of 16 bits are by radix
    sizes = np.bincount(t, minlength=letters)
    end = np.cumsum(sizes)
    begin = end - sizes
    out = np.empty(len(t), np.int64)
    out[0] = len(t) - 1
    filled = np.flatnonzero(sizes)
    seeds = seeds[np.argsort(t[seeds], kind="stable")]
    seed_end = np.cumsum(np.bincount(t[seeds], minlength=letters))
    seed_begin = np.r_[0, seed_end[:-1]]

    def before(sorted_: np.ndarray, kind: bool):
        """The suffixes before these, of one type, by letter and then as they came; their letters, ranks in them, and counts."""
        p = sorted_[sorted_ > 0] - 1
        p = p[small[p] == kind]
        letter = t[p]
        by = np.argsort(letter, kind="stable")
        p, letter = p[by], letter[by]
        count = np.bincount(letter, minlength=letters)
        return p, letter, np.arange(len(p)) - (np.cumsum(count) - count)[letter], count

    head = begin.copy()
    for c in filled.tolist():
        done = begin[c]
        while True:
            now = out[done : head[c]] if done < head[c] else seeds[seed_begin[c] : seed_end[c]]
            last, done = done == head[c], head[c]
            if len(now):
                p, letter, rank, count = before(now, False)
                out[head[letter] + rank] = p
                head += count
            if last:
                break
    tail = end.copy()
    for c in filled[::-1].tolist():
        done = end[c]
        while True:
            now = out[tail[c] : done] if tail[c] < done else out[begin[c] : head[c]]
            last, done = done == tail[c], tail[c]
            if len(now):
                p, letter, rank, count = before(now[::-1], True)
                out[tail[letter] - 1 - rank] = p
                tail -= count
            if last:
                break
    return out


def _one_by_one(t: np.ndarray, small: np.ndarray, letters: int, seeds: np.ndarray) -> np.ndarray:
    """The same, a suffix at a time."""
    n = len(t)
    end = np.cumsum(np.bincount(t, minlength=letters))
    head, tail = np.r_[0, end[:-1]].tolist(), end.tolist()
    letter, is_small, out = t.tolist(), small.tolist(), [0] * n
    for i in reversed(seeds.tolist()):
        tail[letter[i]] -= 1
        out[tail[letter[i]]] = i
    for at in range(n):
        i = out[at] - 1
        if i >= 0 and not is_small[i]:
            c = letter[i]
            out[head[c]] = i
            head[c] += 1
    tail = end.tolist()
    for at in range(n - 1, -1, -1):
        i = out[at] - 1
        if i >= 0 and is_small[i]:
            c = letter[i]
            tail[c] -= 1
            out[tail[c]] = i
    return np.array(out, np.int64)


def common_prefixes(t: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of t the suffix before its own in the order, and how long a prefix they share (permuted LCP).

    A suffix whose letter before it equals the other's shares one letter less than the suffix before it in the text does. Only the
    rest is compared, four letters at a time, all at once. The first in the order has 0 and -1.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[order[1:]], phi[order[0]] = order[:-1], -1
    fresh = np.ones(n, bool)
    fresh[1:] = (phi[1:] <= 0) | (t[:-1] != t[phi[1:] - 1])
    padded = np.concatenate([t.astype(np.uint16), np.zeros(4, np.uint16)])
    four = np.ndarray((n,), np.uint64, padded, strides=(2,))
    at = np.flatnonzero(fresh)
    shared = np.zeros(len(at), np.int64)
    going = np.flatnonzero(phi[at] >= 0)
    while len(going):
        i, j = at[going] + shared[going], phi[at[going]] + shared[going]
        differ = four[i] ^ four[j]
        equal = differ == 0
        low = differ & (~differ + np.uint64(1))
        shared[going] += np.where(equal, 4, np.bitwise_count(low - np.uint64(1)) >> 4)
        going = going[equal]
    value = np.zeros(n, np.int64)
    value[at] = shared + at
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return phi, value[last] - np.arange(n)


def repeated_places(texts: list[bytes], least: int) -> list[np.ndarray]:
    """For each text the places where a string of `least` bytes begins that begins elsewhere in these texts too."""
    sizes = np.array([len(x) for x in texts])
    ends = np.cumsum(sizes + 1)
    t = np.empty(int(ends[-1]) + 1, np.uint16)
    for x, e in zip(texts, ends.tolist()):
        t[e - 1 - len(x) : e - 1] = np.frombuffer(x, np.uint8)
    t += FIRST
    t[ends - 1] = SEPARATOR
    t[-1] = END
    phi, shared = common_prefixes(t, suffix_array(t, 256 + FIRST))
    hit = shared >= least
    hit[phi[hit]] = True
    begins = ends - 1 - sizes
    # a string across a separator is none
    return [np.flatnonzero(hit[b : b + max(0, s - least + 1)]) for b, s in zip(begins.tolist(), sizes.tolist())]
