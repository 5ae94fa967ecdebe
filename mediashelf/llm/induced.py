"""Induced suffix sorting with common-prefix values, in blocks and on disk where needed.

The text is a sequence of numbers whose last one, 0, occurs nowhere else.  A suffix is of type S
if it is smaller than the one after it, else of type L; the leftmost S of a run is a seed.
Sorted seeds give the order of all L suffixes in one ascending pass and those give the order of
all S suffixes in one descending pass: whatever a pass meets puts the suffix before it into a
priority queue, under that suffix's first number.  Seeds themselves are sorted by the same two
passes over unsorted seeds, which orders the pieces between them, and by recursion on the
sequence of the pieces' ranks.

Queue entries carry a place and the number of leading symbols shared with the entry before it in
the same bucket: one more than the least such value met since that entry's own source.  Values
stop at a cap.  Entries are handled in blocks: a block ends where an entry could be preceded by
one that the block itself puts into the queue.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY = 64 << 20  # arrays and queues of more bytes than this live in files
BASE = 4_000_000  # sequences of so many ranks or fewer are sorted in memory, by doubling
GROUPS = 512  # parts of the queue by first symbol
BLOCK = 1 << 16
_ENTRY = np.dtype([("symbol", np.int64), ("place", np.int64), ("shared", np.int32)])


class Space:
    """Arrays that live in memory if they are small and in files of a folder if not."""

    def __init__(self, folder: str, memory: int = MEMORY):
        self.folder, self.memory, self.files = folder, memory, 0

    def path(self) -> str:
        self.files += 1
        return os.path.join(self.folder, f"part{self.files}")

    def array(self, size: int, kind) -> np.ndarray:
        if size * np.dtype(kind).itemsize <= self.memory:
            return np.zeros(size, dtype=kind)
        return np.memmap(self.path(), dtype=kind, mode="w+", shape=(size,))


class Queue:
    """Entries by symbol, those with equal symbols in the order they came.

    Groups of neighbouring symbols collect entries as they come; when their sum passes the
    memory they go to a file per group.  Only the group in front is in order: a group of one
    symbol is read from its file in blocks, another one is loaded and sorted.
    """

    def __init__(self, space: Space, top: int):
        self.space = space
        self.shift = max(0, int(top // GROUPS).bit_length())
        self.parts: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, str] = {}
        self.front, self.head, self.at = -1, np.zeros(0, _ENTRY), 0
        self.waiting: dict[int, np.ndarray] = {}  # what is left of groups that were in front
        self.read: dict[int, int] = {}  # bytes of a group's file that were in front already
        self.held = 0

    def push(self, entries: np.ndarray) -> None:
        group = entries["symbol"] >> self.shift
        if self.shift:
            here = group == self.front
            if here.any():  # into the ordered front, behind entries with equal symbols
                new = entries[here]
                new = new[np.argsort(new["symbol"], kind="stable")]
                ahead = self.head[self.at:]
                spot = np.searchsorted(ahead["symbol"], new["symbol"], side="right")
                self.head, self.at = np.insert(ahead, spot, new), 0
                entries, group = entries[~here], group[~here]
        if not len(entries):
            return
        order = np.argsort(group, kind="stable")
        entries, group = entries[order], group[order]
        cuts = np.flatnonzero(np.diff(group)) + 1
        for part, first in zip(np.split(entries, cuts), group[np.append(0, cuts)], strict=True):
            self.parts.setdefault(int(first), []).append(part)
        self.held += len(entries)
        if self.held * _ENTRY.itemsize > self.space.memory:
            self._spill()

    def _spill(self) -> None:
        for group, parts in self.parts.items():
            path = self.files.setdefault(group, self.space.path())
            with open(path, "ab") as file:
                for part in parts:
                    part.tofile(file)
        self.parts, self.held = {}, 0

    def _open(self, group: int) -> None:
        """Makes a group the front, or reads the next block of the front."""
        self.front = group
        left = self.waiting.pop(group, None)
        if left is not None and self.shift == 0:
            self.head, self.at = left, 0
            return
        taken = self.parts.pop(group, [])
        self.held -= sum(map(len, taken))
        path = self.files.get(group)
        if path is not None:
            if self.shift == 0:  # one symbol: arrival order is the order, so blocks will do
                with open(path, "rb") as file:
                    file.seek(self.read.get(group, 0))
                    block = np.fromfile(file, _ENTRY, max(BLOCK, self.space.memory // 8 // _ENTRY.itemsize))
                self.read[group] = self.read.get(group, 0) + block.nbytes
                if len(block):
                    if taken:  # what is in memory came later
                        self.parts[group] = taken
                        self.held += sum(map(len, taken))
                    taken = [block]
                else:
                    os.remove(self.files.pop(group))
                    del self.read[group]
            else:
                taken.insert(0, np.fromfile(path, _ENTRY))
                os.remove(self.files.pop(group))
        if left is not None:
            taken.insert(0, left)
        head = np.concatenate(taken) if taken else np.zeros(0, _ENTRY)
        if self.shift:
            head = head[np.argsort(head["symbol"], kind="stable")]
        self.head, self.at = head, 0

    def peek(self, size: int) -> tuple[np.ndarray, int]:
        """Up to ``size`` next entries and the least symbol that any entry behind them may have
        (-1 if there is none)."""
        while True:
            groups = self.parts.keys() | self.files.keys() | self.waiting.keys()
            ahead = self.at < len(self.head)
            if groups and (not ahead or min(groups) < self.front):
                if ahead:  # entries came to a group before the one in front
                    self.waiting[self.front] = self.head[self.at:]
                self._open(min(groups))
            elif ahead:
                break
            else:
                return self.head[:0], -1
        block = self.head[self.at:self.at + size]
        if self.at + size < len(self.head):
            return block, int(self.head["symbol"][self.at + size])
        # new entries may still come to this group
        return block, max(int(block["symbol"][-1]), self.front << self.shift)

    def take(self, size: int) -> None:
        self.at += size


def _run(text: np.ndarray, place: int, cap: int) -> int:
    end = place
    while end < len(text) and end - place < cap and text[end] == text[place]:
        end += 1
    return end - place


def _least_between(values: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Least of ``values[after + 1 .. upto]`` for each pair, from minima of powers of two."""
    rows = [values]
    while 2 * (1 << len(rows)) <= 2 * len(values):
        half = 1 << (len(rows) - 1)
        rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
    length = upto - after
    level = np.frexp(length.astype(np.float64))[1] - 1
    out = np.empty(len(after), dtype=values.dtype)
    for k, row in enumerate(rows):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(row[after[at] + 1], row[upto[at] - (1 << k) + 1])
    return out


def induce(text: np.ndarray, top: int, downward: bool, seeds: np.ndarray, shared: np.ndarray | None,
           places: np.ndarray, prefixes: np.ndarray | None, cap: int, space: Space) -> None:
    """Fills ``places`` (and ``prefixes``) with the suffixes that sorted ``seeds`` induce.

    Upward, seeds are the S suffixes to start from and L suffixes come out in ascending order;
    downward, seeds are all L suffixes from the last to the first, and S suffixes come out in
    descending order.  ``shared`` holds for each seed what it has in common with the one before.
    """
    queue = Queue(space, top)
    mirrored = (lambda c: top - c) if downward else (lambda c: c)
    done = filled = 0
    size = 4096
    last_symbol, last_own, last_place = -1, False, -1
    since = np.full(top + 1, -1, dtype=np.int32) if prefixes is not None else None
    while True:
        own, behind = queue.peek(size)
        few = np.asarray(seeds[done:done + size]).astype(np.int64)
        if not len(own) and not len(few):
            break
        # keys: twice the symbol, and one more for seeds, which follow the others of a symbol
        few_key = mirrored(text[few].astype(np.int64)) * 2 + 1
        own_key = own["symbol"] * 2
        limit = np.iinfo(np.int64).max
        if behind >= 0:
            limit = min(limit, behind * 2)
        if done + size < len(seeds) and len(few):
            limit = min(limit, int(few_key[-1]))
        key = np.concatenate([own_key, few_key])
        place = np.concatenate([own["place"], few])
        order = np.argsort(key, kind="stable")
        order = order[:np.searchsorted(key[order], limit, side="right")]
        key, place = key[order], place[order]
        symbol, is_own = key >> 1, (key & 1) == 0
        before = mirrored(text[place - 1].astype(np.int64))
        induces = (place > 0) & ((before > symbol) | ((before == symbol) & is_own))
        new_key = np.where(induces, before * 2, np.iinfo(np.int64).max)
        least = np.minimum.accumulate(new_key)
        safe = np.ones(len(key), dtype=bool)
        safe[1:] = key[1:] <= least[:-1]
        count = len(key) if safe.all() else int(safe.argmin())
        key, place, symbol, is_own = key[:count], place[:count], symbol[:count], is_own[:count]
        induces, before = induces[:count], before[:count]
        n_own = int(np.count_nonzero(is_own))
        places[filled:filled + n_own] = place[is_own]
        source = np.flatnonzero(induces)
        entries = np.zeros(len(source), dtype=_ENTRY)
        entries["symbol"], entries["place"] = before[source], place[source] - 1
        if prefixes is not None:
            prefixes[filled:filled + n_own] = own["shared"][:n_own]
            common = np.empty(count, dtype=np.int32)
            common[is_own] = own["shared"][:n_own]
            common[~is_own] = shared[done:done + count - n_own]
            previous = np.concatenate([[last_symbol], symbol[:-1]])
            previous_own = np.concatenate([[last_own], is_own[:-1]])
            common[symbol != previous] = 0
            seams = np.flatnonzero((symbol == previous) & previous_own & ~is_own)
            for s in seams:  # one for each symbol at most
                other = int(place[s - 1]) if s else last_place
                common[s] = min(_run(text, other, cap), _run(text, int(place[s]), cap))
            if len(source):
                to = before[source]
                by = np.argsort(to, kind="stable")
                at, to_sorted = source[by], to[by]
                first = np.ones(len(by), dtype=bool)
                first[1:] = to_sorted[1:] != to_sorted[:-1]
                value = np.empty(len(by), dtype=np.int32)
                start = np.minimum.accumulate(common)
                old = since[to_sorted[first]]
                value[first] = np.where(old < 0, -1, np.minimum(old, start[at[first]]))
                rest = np.flatnonzero(~first)
                if len(rest):
                    value[rest] = _least_between(common, at[rest - 1], at[rest])
                entries["shared"][by] = np.minimum(value + 1, cap)
                seen = since >= 0
                since[seen] = np.minimum(since[seen], start[-1])
                final = np.append(first[1:], True)
                end = np.minimum.accumulate(common[::-1])[::-1]
                tail = np.append(end[1:], cap)
                since[to_sorted[final]] = tail[at[final]]
            else:
                seen = since >= 0
                since[seen] = np.minimum(since[seen], common.min())
        last_symbol, last_own, last_place = int(symbol[-1]), bool(is_own[-1]), int(place[-1])
        filled += n_own
        queue.take(n_own)
        done += count - n_own
        if len(entries):
            queue.push(entries)
        size = min(BLOCK, 2 * size) if count == len(order) else max(256, min(size, 2 * count))


def _types(text: np.ndarray, space: Space) -> np.ndarray:
    """Whether each suffix is of type S."""
    out = space.array(len(text), bool)
    after, kind = int(text[-1]), True
    out[-1] = True
    for end in range(len(text) - 1, 0, -BLOCK * 16):
        begin = max(0, end - BLOCK * 16)
        part = np.append(np.asarray(text[begin:end]).astype(np.int64), after)
        step = np.sign(np.diff(part))  # 1: smaller than the next, -1: larger, 0: as the next is
        at = np.where(step != 0, np.arange(len(step)), len(step))
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[begin:end] = np.append(step == 1, kind)[at]
        after, kind = int(part[0]), bool(out[begin])
    return out


def _equal_pieces(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the pieces of ``length`` symbols at ``a`` and ``b`` are equal."""
    same = np.ones(len(a), dtype=bool)
    left = np.flatnonzero(length > 0)
    for k in range(int(length.max(initial=0))):
        left = left[length[left] > k]
        if not len(left):
            break
        equal = text[a[left] + k] == text[b[left] + k]
        same[left[~equal]] = False
        left = left[equal]
    return same


def _shared_with_previous(text: np.ndarray, places: np.ndarray, known: np.ndarray, cap: int
                          ) -> np.ndarray:
    """What each suffix of a sorted list has in common with the one before, up to ``cap``, given
    how much of it is known already."""
    out = np.minimum(known, cap).astype(np.int32)
    padded = np.concatenate([np.asarray(text, dtype=np.uint16), np.zeros(8, np.uint16)])
    words = np.ndarray((len(padded) - 3,), dtype="<u8", buffer=padded, strides=(2,))
    left = np.flatnonzero(out[1:] < cap) + 1
    a, b, k = places[left - 1] + out[left], places[left] + out[left], out[left]
    while len(left):
        x = words[np.minimum(a, len(text))] ^ words[np.minimum(b, len(text))]
        differs = x != 0
        lowest = x & (~x + np.uint64(1))  # zero if all four symbols are equal
        equal = np.where(differs, np.log2(np.maximum(lowest, 1).astype(np.float64)) // 16, 4)
        k = k + equal.astype(np.int32)
        go_on = ~differs & (k < cap) & (np.maximum(a, b) < len(text))
        out[left[~go_on]] = np.minimum(k[~go_on], cap)
        left, a, b, k = left[go_on], a[go_on] + 4, b[go_on] + 4, k[go_on]
    return out


def _by_doubling(ranks: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a sequence by their first ``cap`` symbols or more, and how many
    symbols each has in common with the one before (``cap`` or more where order ends)."""
    n, span = len(ranks), 1
    order = np.argsort(ranks, kind="stable")
    place = np.arange(n)  # of the suffixes that still share their rank, in the order
    key = np.asarray(ranks)[order]
    rank = np.zeros(n, dtype=np.int64)  # where the group of equals begins
    tables = []
    while True:
        fresh = np.append(True, key[1:] != key[:-1])
        start = place[np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))]
        rank[order[place]] = start
        tables.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        single = fresh & np.append(fresh[1:], True)
        place = place[~single]
        if not len(place) or span >= cap:
            break
        who = order[place]
        second = np.where(who + span < n, rank[np.minimum(who + span, n - 1)] + 1, 0)
        key = rank[who] * (n + 2) + second
        by = np.argsort(key, kind="stable")
        order[place], key = who[by], key[by]
        span *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(tables) - 1, -1, -1):
        same = (a < n) & (b < n)
        same[same] = tables[k][a[same]] == tables[k][b[same]]
        a[same] += 1 << k
        b[same] += 1 << k
    return order, np.append(0, a - order[:-1])


def sorted_seeds(text: np.ndarray, top: int, cap: int, space: Space, base: int = BASE
                 ) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Seeds in the order of their suffixes, symbols each is known to share with the one before
    (more may follow), and how many suffixes are of types L and S."""
    kinds = _types(text, space)
    n_s = int(np.count_nonzero(kinds))
    n_l = len(text) - n_s
    is_seed = space.array(len(text), bool)
    is_seed[1:] = kinds[1:] & ~kinds[:-1]
    seeds = np.flatnonzero(is_seed)
    if len(seeds) == 1:
        return seeds, np.zeros(1, np.int64), n_l, n_s
    lower = space.array(n_l, np.int64)
    start = seeds[np.argsort(text[seeds], kind="stable")]
    induce(text, top, False, start, None, lower, None, cap, space)
    upper = space.array(n_s, np.int64)
    induce(text, top, True, lower[::-1], None, upper, None, cap, space)
    # the descending pass brings out every S suffix but the last symbol's
    by_piece = np.concatenate([[len(text) - 1], *_chosen(upper[:n_s - 1], is_seed)])
    following = np.append(seeds[1:], len(text) - 1)
    number = np.searchsorted(seeds, by_piece)
    length = following[number] - by_piece + 1
    a, b = by_piece[:-1], by_piece[1:]
    same = length[:-1] == length[1:]
    same[same] = _equal_pieces(text, a[same], b[same], length[:-1][same])
    names = np.empty(len(seeds), dtype=np.int64)
    names[number] = np.cumsum(np.append(0, ~same))
    most = int(names.max())
    if most == len(seeds) - 1:
        return by_piece, np.zeros(len(seeds), np.int64), n_l, n_s
    # a rank stands for two symbols at least, so half as many decide
    if len(names) <= base:
        order, ranks = _by_doubling(names, cap // 2 + 2)
        end = np.append(seeds, len(text))
        known = np.zeros(len(order), np.int64)
        known[1:] = end[np.minimum(order[:-1] + ranks[1:], len(seeds))] - seeds[order[:-1]]
    else:
        order = suffix_order(names, most, cap // 2 + 2, space, base)
        known = np.zeros(len(order), np.int64)
    return seeds[order], known, n_l, n_s


def _chosen(descending: np.ndarray, wanted: np.ndarray) -> Iterator[np.ndarray]:
    for end in range(len(descending), 0, -BLOCK * 16):
        part = np.asarray(descending[max(0, end - BLOCK * 16):end])[::-1]
        yield part[wanted[part]]


def suffix_order(text: np.ndarray, top: int, cap: int, space: Space, base: int = BASE) -> np.ndarray:
    """Places of all suffixes in ascending order (by their first ``cap`` symbols at least)."""
    seeds, _, n_l, n_s = sorted_seeds(text, top, cap, space, base)
    lower, upper = space.array(n_l, np.int64), space.array(n_s, np.int64)
    induce(text, top, False, seeds, None, lower, None, cap, space)
    induce(text, top, True, lower[::-1], None, upper, None, cap, space)
    upper = np.append(upper[:n_s - 1], len(text) - 1)[::-1]
    merged = np.concatenate([lower, upper])
    return merged[np.argsort(text[merged], kind="stable")]


def repeated(text: np.ndarray, top: int, length: int, space: Space, base: int = BASE) -> np.ndarray:
    """Whether the ``length`` symbols at each place also start at another place.  Strings that
    reach over the end of the text, or a symbol that separates texts, are for the caller."""
    seeds, known, n_l, n_s = sorted_seeds(text, top, length, space, base)
    lower, lower_shared = space.array(n_l, np.int64), space.array(n_l, np.int32)
    shared = _shared_with_previous(text, seeds, known, length)
    induce(text, top, False, seeds, shared, lower, lower_shared, length, space)
    # downward, each L suffix is compared with the one after it
    falling = space.array(n_l, np.int32)
    if n_l > 1:
        falling[1:] = lower_shared[:0:-1]
    upper, upper_shared = space.array(n_s, np.int64), space.array(n_s, np.int32)
    induce(text, top, True, lower[::-1], falling, upper, upper_shared, length, space)
    found = space.array(len(text), bool)
    for places, common in ((lower, lower_shared), (upper[:n_s - 1], upper_shared[:n_s - 1])):
        if len(places) > 1:
            hit = np.asarray(common[1:]) >= length
            found[places[1:][hit]] = True
            found[places[:-1][hit]] = True
    # where L ends and S begins in a bucket both start with a run of its symbol
    if n_l and n_s > 1:
        low, high = np.asarray(text[lower]), np.asarray(text[upper[:n_s - 1]])
        for symbol in np.intersect1d(low, high):
            x = int(lower[np.searchsorted(low, symbol, side="right") - 1])
            y = int(upper[n_s - 2 - np.searchsorted(high[::-1], symbol, side="left")])
            if min(_run(text, x, length), _run(text, y, length)) >= length:
                found[[x, y]] = True
    return found


def repeated_in(texts: Iterator[bytes], length: int, memory: int = MEMORY, base: int = BASE
                ) -> Iterator[np.ndarray]:
    """For each text in turn, whether the ``length`` bytes at each place also start anywhere
    else in the texts given; the last ``length - 1`` places are never marked.

    Texts are written to a file as they come.  Symbols: 0 ends all, 1 ends a text, bytes
    follow from 2 on.  The folder, in the worker's own temporary space, goes when all is read.
    """
    with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
        path, sizes = os.path.join(folder, "text"), []
        with open(path, "wb") as file:
            for t in texts:
                sizes.append(len(t))
                (np.frombuffer(t, np.uint8).astype(np.uint16) + np.uint16(2)).tofile(file)
                np.ones(1, np.uint16).tofile(file)
            np.zeros(1, np.uint16).tofile(file)
        if os.path.getsize(path) <= memory:
            text = np.fromfile(path, np.uint16)
        else:
            text = np.memmap(path, dtype=np.uint16, mode="r")
        found = repeated(text, 257, length, Space(folder, memory), base) if sizes else None
        at = 0
        for size in sizes:
            marks = np.array(found[at:at + size])
            marks[max(0, size - length + 1):] = False
            yield marks
            at += size + 1
