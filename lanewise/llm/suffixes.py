"""Suffix arrays in linear time by grouping, and the repeated windows of a set of strings."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xA0761D6478BD642F | 1)
ODD_INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
TRIGGER = 8  # a chunk ends after so many bytes whose hash has its low CHUNK_BITS bits clear
CHUNK_BITS = 4


def suffix_array(text: list[int]) -> list[int]:
    """Positions of the suffixes of ``text`` in order; its last symbol must be its only smallest.

    Suffixes start grouped by first symbol. Groups are taken from the largest down. Each suffix of
    the group finds the nearest position before it that lies in a smaller group (following the
    pointers already found); positions found by more suffixes of the group move into later new
    groups right behind their own. Groups then hold equal Lyndon prefixes. The order inside them is
    read off in one pass from the smallest suffix up: the suffix before it, and the chain of its
    pointers, take the next free places of their groups.
    """
    n = len(text)
    order = np.argsort(np.array(text), kind="stable").tolist()
    place, head, size = [0] * n, [0] * n, [0] * n
    begin = 0
    for k, s in enumerate(order):
        if k and text[s] != text[order[k - 1]]:
            begin = k
        place[s], head[s] = k, begin
        size[begin] += 1
    before = [-1] * n
    pointed = [0] * n
    end = n
    while end > 0:
        start = head[order[end - 1]]
        members = sorted(order[start:end])
        end = start
        found: list[int] = []
        for s in members:
            j = s - 1
            while j >= 0 and head[j] >= start:
                j = before[j]
            before[s] = j
            if j >= 0:
                if not pointed[j]:
                    found.append(j)
                pointed[j] += 1
        if not found:
            continue
        levels: dict[int, list[int]] = {}
        for j in found:
            levels.setdefault(pointed[j], []).append(j)
            pointed[j] = 0
        for level in sorted(levels, reverse=True):
            moved = levels[level]
            for j in moved:  # to the end of their group
                h = head[j]
                size[h] -= 1
                last = h + size[h]
                other, at = order[last], place[j]
                order[at], order[last] = other, j
                place[other], place[j] = at, last
            for j in moved:  # and out of it
                fresh = head[j] + size[head[j]]
                head[j] = fresh
            for j in moved:
                size[head[j]] += 1
    result = [-1] * n
    free = list(range(n))  # at each group's head, its next free place
    placed = bytearray(n)
    result[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = result[k] - 1
        while j >= 0 and not placed[j]:
            result[free[head[j]]] = j
            free[head[j]] += 1
            placed[j] = 1
            j = before[j]
    return result


class Rolling:
    """Hashes of all substrings of one byte array, modulo 2**64, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        with np.errstate(over="ignore"):
            self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, ODD_INVERSE)]))
            self.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, ODD)]))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTES[data] * self.down[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Mixed hashes of ``data[start : start + length]``."""
        with np.errstate(over="ignore"):
            x = (self.sums[start + length] - self.sums[start]) * self.up[start]
            x ^= x >> np.uint64(32)
            x *= MIX
            return x ^ (x >> np.uint64(29))


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which entries of ``keys`` occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    found = np.zeros(len(keys), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Length of the common prefix of data[a:] and data[b:], at most ``room``."""
    found = np.zeros(len(a), np.int64)
    alive = np.flatnonzero(room > 0)
    while len(alive):
        step = 32
        spread = np.arange(step)
        at = found[alive]
        left = data[np.minimum(a[alive, None] + at[:, None] + spread, len(data) - 1)]
        right = data[np.minimum(b[alive, None] + at[:, None] + spread, len(data) - 1)]
        differs = left != right
        first = np.where(differs.any(1), differs.argmax(1), step)
        found[alive] = np.minimum(at + first, room[alive])
        alive = alive[(first == step) & (found[alive] < room[alive])]
    return found


def repeated_windows(strings: list[bytes], width: int) -> np.ndarray:
    """For each byte of the joined strings: whether the ``width`` bytes from it lie in one string and
    also stand elsewhere in the strings.

    Strings are cut into chunks where a hash of the last TRIGGER bytes says so, so equal windows
    are cut alike and no chunk is a proper prefix of another that a cut ends. The suffix array of
    the chunks' ranks is thus the byte order of the suffixes at cuts. A window is its bytes up to
    its first cut and, from there, a class of suffixes that share the rest; windows equal in both
    are equal. Windows without a cut (monotonous text) are compared by their whole hash.
    """
    data = np.frombuffer(b"".join(strings), np.uint8)
    total = len(data)
    flags = np.zeros(total, bool)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if total < width:
        return flags
    rolling = Rolling(data)
    limit = np.repeat(ends, sizes)  # where each byte's string ends
    origin = np.repeat(starts, sizes)
    grams = np.arange(total - TRIGGER + 1)
    hit = grams[(rolling.of(grams, TRIGGER) >> np.uint64(64 - CHUNK_BITS)) == 0] + TRIGGER
    cuts = hit[hit < total]
    cuts = cuts[(limit[cuts - 1] != cuts) & (limit[cuts - TRIGGER] == limit[cuts - 1])]

    position = np.arange(total)
    windows = position[position + width <= limit]
    after = np.searchsorted(cuts, windows + TRIGGER)
    has = after < len(cuts)
    has[has] = cuts[after[has]] < windows[has] + width
    lone = windows[~has]
    flags[lone[_twice(rolling.of(lone, width))]] = True
    if not len(cuts):
        return flags

    heads = np.unique(np.concatenate([starts[sizes > 0], cuts]))
    tails = np.concatenate([heads[1:], [total]])
    tails = np.minimum(tails, limit[heads])
    chunks = [data[a:b].tobytes() for a, b in zip(heads.tolist(), tails.tolist(), strict=True)]
    rank = {c: k for k, c in enumerate(sorted(set(chunks)), 2)}
    symbols, at = [], []
    for a, b, c in zip(heads.tolist(), tails.tolist(), chunks, strict=True):
        symbols.append(rank[c])
        at.append(a)
        if b == limit[a]:
            symbols.append(1)
            at.append(-1)
    symbols.append(0)
    at.append(-1)
    order = np.array(at)[suffix_array(symbols)]
    order = order[order >= 0]
    is_cut = np.zeros(total, bool)
    is_cut[cuts] = True
    order = order[is_cut[order]]
    room = np.minimum(np.minimum(limit[order[1:]] - order[1:], limit[order[:-1]] - order[:-1]), width)
    shared = np.concatenate([[0], _common(data, order[1:], order[:-1], room)])
    slot = np.empty(len(cuts), np.int64)  # each cut's place in the order
    slot[np.searchsorted(cuts, order)] = np.arange(len(order))

    cut_windows, cut_of = windows[has], after[has]
    reach = cuts[cut_of] - cut_windows  # bytes before the cut
    by_reach = np.argsort(reach, kind="stable")
    bounds = np.searchsorted(reach[by_reach], np.arange(width + 1))
    for o in range(TRIGGER, width):
        some = by_reach[bounds[o] : bounds[o + 1]]
        if not len(some):
            continue
        classes = np.cumsum(shared < width - o)[slot[cut_of[some]]].astype(np.uint64)
        p = cut_windows[some]
        with np.errstate(over="ignore"):
            keys = rolling.of(p, o) ^ (classes * MIX)
        flags[p[_twice(keys)]] = True
    return flags
