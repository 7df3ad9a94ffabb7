"""Suffix arrays of a shard by induced sorting, on numpy arrays."""

from __future__ import annotations

import numpy as np

#: Symbols below the bytes of a text: the end of the shard, and the end of a string in it.
END, STOP, SHIFT = 0, 1, 2
SYMBOLS = 256 + SHIFT


def join(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, starts): the strings one after the other, each ended by STOP, the shard by END."""
    sizes = np.array([len(x) for x in strings], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.full(int(sizes.sum()) + len(strings) + 1, STOP, np.uint16)
    text[-1] = END
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8) if strings else np.zeros(0, np.uint8)
    text[:-1] = raw.astype(np.uint16) + SHIFT
    text[starts + sizes] = STOP
    return text, starts


def classify(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S-type); a run of one symbol has the type of its last place."""
    n = len(text)
    last = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    kind = np.append(text[last[:-1]] < text[last[:-1] + 1], True)
    return np.repeat(kind, np.diff(np.append(-1, last)))


def leftmost(small: np.ndarray) -> np.ndarray:
    """Places of S-type suffixes that follow an L-type one (leftmost smaller, LMS)."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes that the order *lms* of the LMS suffixes implies; if *lms* is sorted by the first symbol
    only, the order that LMS substrings have. A bucket (first symbol) is handled as a whole, in as many steps as its
    longest run of that symbol, and each suffix is looked at once in either direction."""
    size = np.bincount(text, minlength=SYMBOLS)
    tail = np.cumsum(size)
    head = tail - size
    order = np.full(len(text), -1, np.int32)

    def put(places: np.ndarray, symbols: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        """Adds *places*, in order, to the buckets of their symbols, at and after (step 1) or below (step -1) *at*."""
        by = np.argsort(symbols, kind="stable")
        count = np.bincount(symbols, minlength=SYMBOLS)
        rank = np.arange(len(by)) - np.repeat(np.cumsum(count) - count, count)
        target = at[symbols[by]]
        order[target + rank if step > 0 else target - 1 - rank] = places[by]
        at += step * count
        return count

    # LMS suffixes at the ends of their buckets
    first = text[lms]
    fill = tail.copy()
    put(lms[::-1], first[::-1], fill, -1)
    lms_low = fill.copy()
    present = np.flatnonzero(size)

    # L-type suffixes from the smallest bucket up
    fill = head.copy()
    for c in present.tolist():
        done = head[c]
        while done < fill[c]:
            front, done = order[done:fill[c]], int(fill[c])
            before = front[front > 0] - 1
            before = before[~small[before]]
            if len(before):
                put(before, text[before], fill, 1)
        front = order[lms_low[c]:tail[c]]
        before = front[front > 0] - 1
        before = before[~small[before]]
        if len(before):
            put(before, text[before], fill, 1)
    low = fill  # ends of the L-type parts

    # S-type suffixes from the largest bucket down; those placed at first are placed anew
    fill = tail.copy()
    for c in present[::-1].tolist():
        done = tail[c]
        while done > fill[c]:
            front, done = order[fill[c]:done][::-1], int(fill[c])
            before = front[front > 0] - 1
            before = before[small[before]]
            if len(before):
                put(before, text[before], fill, -1)
        front = order[head[c]:low[c]][::-1]
        before = front[front > 0] - 1
        before = before[small[before]]
        if len(before):
            put(before, text[before], fill, -1)
    order[0] = len(text) - 1  # the end alone is smallest
    return order


def _named(text: np.ndarray, lms: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    """A name for each LMS substring, in text order: equal for equal substrings, and ordered as they are."""
    place = np.zeros(len(text), np.int32)
    place[lms] = np.arange(len(lms))
    length = np.append(np.diff(lms), 1)  # to the next LMS place, whose symbol belongs to the substring
    a, b = sorted_lms[:-1], sorted_lms[1:]
    same = length[place[a]] == length[place[b]]
    active, step, end = np.flatnonzero(same), 0, length[place[a]]
    while len(active):
        equal = text[np.minimum(a[active] + step, len(text) - 1)] == text[np.minimum(b[active] + step, len(text) - 1)]
        same[active[~equal]] = False
        step += 1
        active = active[equal]
        active = active[end[active] >= step]
    names = np.zeros(len(lms), np.int64)
    names[place[sorted_lms]] = np.append(0, np.cumsum(~same))
    return names


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of *text* in order, as far as their first *depth* symbols tell.

    LMS substrings are sorted by induction and named. The string of names is sorted recursively: it has too many symbols
    for buckets, so each step names pairs of neighbouring names, which doubles what a name stands for, until all differ or
    names stand for *depth* symbols (an LMS substring has two or more). The sorted LMS suffixes induce all others.
    """
    small = classify(text)
    lms = leftmost(small)
    if len(lms) > 1:
        by_symbol = lms[np.argsort(text[lms], kind="stable")]
        order = induce(text, small, by_symbol)
        is_lms = np.zeros(len(text), bool)
        is_lms[lms] = True
        names = _named(text, lms, order[is_lms[order]])
        reach = 1
        while names.max() + 1 < len(lms) and 2 * reach < depth + 2:
            key = names * (len(lms) + 1)
            key[:-reach] += names[reach:] + 1
            by = np.argsort(key)
            ranks = np.empty(len(lms), np.int64)
            ranks[by] = np.append(0, np.cumsum(key[by][1:] != key[by][:-1]))
            names, reach = ranks, 2 * reach
        lms = lms[np.argsort(names, kind="stable")]
    return induce(text, small, lms)


def permuted_prefixes(text: np.ndarray, order: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, common) for each of *places*, in text order: the suffix just before it in *order*, and how many symbols
    the two have in common, counted in eights up to *depth* (permuted common prefixes); before is -1 for the first."""
    phi = np.empty(len(text), np.int32)
    phi[order[0]], phi[order[1:]] = -1, order[:-1]
    before = phi[places].astype(np.int64)
    octets = np.where(text >= SHIFT, text - SHIFT, 0).astype(np.uint8)
    padded = np.append(octets, np.zeros(depth + 8, np.uint8))
    words = np.ndarray((len(padded) - 7,), np.uint64, padded.tobytes(), 0, (1,))
    common = np.zeros(len(places), np.int64)
    active = np.flatnonzero(before >= 0)
    for step in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        equal = words[places[active] + step] == words[before[active] + step]
        active = active[equal]
        common[active] = step + 8
    return before, common
