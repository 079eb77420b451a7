"""Burrows-Wheeler interval expansion over a collection of byte strings.

Suffixes are sorted to the depth that is asked; backward extension of intervals, breadth
first, then sets common-prefix lengths in increasing order, one value a level, and stops
at the threshold: what is still unset is at least that long (Beller, Gog, Ohlebusch and
Schnattinger's algorithm, cut off at a bound).
"""

from __future__ import annotations

import numpy as np


def sorted_suffixes(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts ordered by their first ``depth`` codes at least, by doubling; only undecided ones are sorted again."""
    n = len(codes)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = codes
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.repeat(head, np.diff(np.append(head, n)))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = group
    sizes = np.diff(np.append(head, n))
    active = order[np.repeat(sizes > 1, sizes)]
    h = 8
    while h < depth and len(active):
        second = rank[np.minimum(active + h, n)] + 1
        both = (rank[active] << np.int64(32)) | second
        by = np.argsort(both, kind="stable")
        both, active = both[by], active[by]
        first = both >> np.int64(32)
        new_group = np.concatenate([[True], first[1:] != first[:-1]])
        new_key = np.concatenate([[True], both[1:] != both[:-1]])
        at = np.arange(len(active))
        base = np.maximum.accumulate(np.where(new_group, at, 0))
        mine = np.maximum.accumulate(np.where(new_key, at, 0))
        order[first + (at - base)] = active
        rank[active] = first + (mine - base)
        head = np.flatnonzero(new_key)
        sizes = np.diff(np.append(head, len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def long_prefixes(codes: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each suffix in order (and one past the last), whether it shares ``least`` codes or more with the one before it.

    Code 0 ends a string; no interval is extended by it, so nothing matches across strings.
    Rows of suffixes that begin with it have no meaning.
    """
    n = len(codes)
    bwt = codes[order - 1]
    bwt[order == 0] = 0
    by_code = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)
    back[by_code] = np.arange(n)
    # Of each row, the row before and after it with the same code.
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    same = bwt[by_code[1:]] == bwt[by_code[:-1]]
    before[by_code[1:][same]] = by_code[:-1][same]
    after[by_code[:-1][same]] = by_code[1:][same]
    ends = int((codes == 0).sum())
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lo, hi = np.array([0]), np.array([n])
    for level in range(least):
        if not len(lo):
            break
        size = hi - lo
        one = size == 1
        new_lo, new_hi = [back[lo[one]]], [back[lo[one]] + 1]
        if not one.all():
            l2, h2, s2 = lo[~one], hi[~one], size[~one]
            off = np.cumsum(s2) - s2
            which = np.repeat(np.arange(len(l2)), s2)
            row = np.arange(s2.sum()) - off[which] + l2[which]
            first = before[row] < l2[which]
            last = after[row] >= h2[which]
            # In an interval both lists hold each code once, in the order of what they lead to.
            a, b = back[row[first]], back[row[last]]
            new_lo.append(a[np.argsort(which[first] * np.int64(n) + a, kind="stable")])
            new_hi.append(b[np.argsort(which[last] * np.int64(n) + b, kind="stable")] + 1)
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        keep = unset[hi]
        if level:
            keep &= lo >= ends
        lo, hi = lo[keep], hi[keep]
        unset[hi] = False
    return unset


def repeated_starts(strings: list[bytes], least: int) -> list[np.ndarray]:
    """For each string, which starts have ``least`` bytes that also start elsewhere in the strings."""
    lengths = np.array([len(x) for x in strings], np.int64)
    raw = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    ends = starts[1:] - 1
    seen = np.zeros(256, bool)
    is_end = np.zeros(len(raw), bool)
    is_end[ends] = True
    seen[raw[~is_end]] = True
    code = np.zeros(256, np.int64)
    code[seen] = np.arange(1, seen.sum() + 1)
    if seen.sum() > 255:
        raise ValueError("more than 255 byte values")
    codes = code[raw].astype(np.uint8)
    codes[ends] = 0
    order = sorted_suffixes(codes, least)
    shared = long_prefixes(codes, order, least)
    found = np.zeros(len(raw), bool)
    found[order] = shared[:-1] | shared[1:]
    room = np.repeat(ends, lengths + 1) - np.arange(len(raw))
    found &= room >= least
    return [found[a:b] for a, b in zip(starts[:-1].tolist(), ends.tolist(), strict=True)]
