"""Greedy tiling, regions and scores of one pair: plain functions over token lists.

Maximal equal runs on the diagonals are found once, from shared grams of the least length. A heap yields them by length, then place; a run
that an accepted tile has cut into gives back its free stretches. So each round's longest free matches come in order of their places,
without looking through all pairs of tokens again.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import xxhash

from tessella.config import Params

Tile = tuple[int, int, int]
#: An odd number of many bits; the hash of a stretch is a polynomial in it.
MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(tokens: Sequence[str], mask: Sequence[bool], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the unmasked stretches of the least length, and their hashes. Equal stretches have equal hashes in any process; the reverse is for the reader to verify."""
    n = len(tokens) - least + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = {t: xxhash.xxh64_intdigest(t) for t in set(tokens)}
    each, out = np.fromiter((known[t] for t in tokens), np.uint64, len(tokens)), np.zeros(n, np.uint64)
    for k in range(least):
        out = out * MIX + each[k : k + n]
    hidden = np.concatenate([[0], np.cumsum(np.asarray(mask, bool))])
    at = np.flatnonzero(hidden[least:] == hidden[:-least])
    return at, out[at]


class Grams:
    """The unmasked stretches of the least length of one side, ordered by hash; made once and held against many other sides."""

    def __init__(self, tokens: Sequence[str], mask: Sequence[bool], least: int):
        self.tokens, self.least = tokens, least
        at, hashes = gram_hashes(tokens, mask, least)
        order = np.argsort(hashes, kind="stable")
        self.at, self.hashes = at[order], hashes[order]
        self.distinct = np.unique(self.hashes)

    def places(self, hashes: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        low, high = (np.searchsorted(self.hashes, hashes, side=s) for s in ("left", "right"))
        for h, a, b in zip(hashes.tolist(), low.tolist(), high.tolist()):
            yield h, self.at[a:b].tolist()


def maximal_runs(left: Grams, right: Grams) -> list[Tile]:
    """(left, right, length) of the maximal equal stretches of unmasked tokens, of the least length or more."""
    common = np.intersect1d(left.distinct, right.distinct, assume_unique=True)
    if not common.size:
        return []
    places, least = dict(right.places(common)), left.least
    reach: dict[int, int] = {}
    runs: dict[tuple[int, int], int] = {}
    for i, h in sorted((i, h) for h, found in left.places(common) for i in found):
        for j in places[h]:
            d, last = i - j, i + least - 1
            begin = reach.get(d)
            if begin is not None and runs[d, begin] + begin == last:
                if left.tokens[last] == right.tokens[last - d]:
                    runs[d, begin] += 1
            elif left.tokens[i : last + 1] == right.tokens[j : j + least]:
                reach[d] = i
                runs[d, i] = least
    return [(i, i - d, n) for (d, i), n in runs.items()]


def greedy_tiles(left: Grams, right: Grams) -> list[Tile]:
    """Tiles in the order of their acceptance."""
    return chosen(maximal_runs(left, right), left.least)


def chosen(runs: list[Tile], least: int) -> list[Tile]:
    """The tiles that a pair's maximal runs leave, in the order of their acceptance."""
    heap = [(-n, i, j) for i, j, n in runs]
    heapq.heapify(heap)
    used_left, used_right = (bytearray(max((r[s] + r[2] for r in runs), default=0)) for s in (0, 1))
    tiles = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        if used_left.find(1, i, i + n) < 0 and used_right.find(1, j, j + n) < 0:
            used_left[i : i + n] = used_right[j : j + n] = b"\x01" * n
            tiles.append((i, j, n))
            continue
        taken, begin = [x or y for x, y in zip(used_left[i : i + n], used_right[j : j + n])], None
        for k, t in enumerate([*taken, 1]):
            if t and begin is not None:
                if k - begin >= least:
                    heapq.heappush(heap, (begin - k, i + begin, j + begin))
                begin = None
            elif not t and begin is None:
                begin = k
    return tiles


def chosen_many(pair: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """chosen() for many pairs at once: (pair, order of acceptance, left, right, length). Each round takes the longest stretch that a pair has left and cuts what meets it out of the others."""
    found, seq = [], 0
    while len(pair):
        order = np.lexsort((j, i, -n, pair))
        pair, i, j, n = (x[order] for x in (pair, i, j, n))
        first = np.r_[True, pair[1:] != pair[:-1]]
        top = np.flatnonzero(first)
        found.append((pair[top], np.full(len(top), seq), i[top], j[top], n[top]))
        top, rest, seq = top[np.cumsum(first) - 1][~first], np.flatnonzero(~first), seq + 1
        ends = []
        for x in (i, j):
            at = x[top] - x[rest]
            ends.append((np.clip(at, 0, n[rest]), np.clip(at + n[top], 0, n[rest])))
        (a, b), (c, d) = ends
        swap = c < a
        a, b, c, d = np.where(swap, c, a), np.where(swap, d, b), np.where(swap, a, c), np.where(swap, b, d)
        begin, end = np.concatenate([np.zeros_like(a), b, np.maximum(b, d)]), np.concatenate([a, c, n[rest]])
        kept, rest = end - begin >= least, np.tile(rest, 3)
        rest, begin, end = rest[kept], begin[kept], end[kept]
        pair, i, j, n = pair[rest], i[rest] + begin, j[rest] + begin, end - begin
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (pair, pair, i, j, n)


def split_on_gaps(tiles: list[Tile], left_units: Sequence[int], right_units: Sequence[int]) -> list[Tile]:
    """Tiles cut wherever units are left out between neighbours, on either side."""
    out = []
    for i, j, n in tiles:
        cuts = [k for k in range(1, n) if left_units[i + k] > left_units[i + k - 1] + 1 or right_units[j + k] > right_units[j + k - 1] + 1]
        out += [(i + a, j + a, b - a) for a, b in zip([0, *cuts], [*cuts, n])]
    return out


def active_index(units: Sequence[int], mask: Sequence[bool]) -> list[int | None]:
    out, hidden = [], 0
    for unit, masked in zip(units, mask):
        out.append(None if masked else max(0, unit - hidden))
        hidden += masked
    return out


@dataclass(frozen=True, order=True)
class Region:
    left_start: int
    right_start: int
    left_end: int
    right_end: int
    exact: int
    effective: int
    effective_left: int
    effective_right: int
    anchor: int


def threshold(left: int, right: int) -> int:
    return max(10, min(15, (3 * min(left, right) + 99) // 100))


@dataclass(frozen=True)
class Side:
    """What a pair needs of a submission."""

    tokens: Sequence
    units: Sequence[int]
    mask: Sequence[bool]

    @property
    def active(self) -> int:
        return len(self.mask) - sum(self.mask)


def near(found: Sequence[int], a: Tile, b: Tile, most: int) -> tuple[int, int] | None:
    """The tokens between two fragments, or None if they are too many, or too many more on one side."""
    if abs(found[0] - found[1]) > most or max(found) > min(a[2], b[2]) // 2:
        return None
    return found[0], found[1]


def _gaps(left: Side, right: Side, index: tuple[list, list], a: Tile, b: Tile, most: int) -> tuple[int, int] | None:
    """Tokens between two fragments on each side, or None if they do not follow each other closely enough."""
    if b[1] <= a[1]:
        return None
    found = []
    for side, units, act in ((0, left.units, index[0]), (1, right.units, index[1])):
        end = a[side] + a[2] - 1
        shown, active = units[b[side]] - units[end] - 1, act[b[side]] - (act[a[side]] + a[2])
        if shown < 0 or shown != active:
            return None
        found.append(active)
    return near(found, a, b, most)


def regions(tiles: list[Tile], left: Side, right: Side, params: Params = Params()) -> list[Region]:
    """Tiles that are long enough, and chains of shorter ones, the heaviest that do not overlap."""
    enough = threshold(left.active, right.active)
    index = active_index(left.units, left.mask), active_index(right.units, right.mask)
    shown = sorted(t for t in split_on_gaps(tiles, left.units, right.units) if index[0][t[0]] is not None and index[1][t[1]] is not None)
    return chained(shown, enough, lambda a, b: _gaps(left, right, index, a, b, params.cluster_asymmetry), params)


def chained(shown: list[Tile], enough: int, gaps: Callable[[Tile, Tile], tuple[int, int] | None], params: Params = Params()) -> list[Region]:
    """The regions of sorted tiles."""
    out = [Region(i, j, i + n - 1, j + n - 1, n, n, n, n, n) for i, j, n in shown if n >= enough]
    # best[e]: the heaviest choice among the fragments before e, and the chain that ends it
    best: list[tuple[int, int, Region | None]] = [(0, -1, None)]
    ending: list[list[tuple[int, Region]]] = [[] for _ in shown]
    for s, first in enumerate(shown):
        exact, sums, anchor, widest = 0, (0, 0), 0, 0
        for e in range(s, len(shown)):
            tile = shown[e]
            if not params.cluster_fragment <= tile[2] < enough:
                break
            if e > s:
                gap = gaps(shown[e - 1], tile)
                if gap is None:
                    break
                sums, widest = (sums[0] + gap[0], sums[1] + gap[1]), widest + max(gap)
            exact, anchor = exact + tile[2], max(anchor, tile[2])
            if e > s and exact >= enough and 2 * widest <= exact:
                ending[e].append((s, Region(first[0], first[1], tile[0] + tile[2] - 1, tile[1] + tile[2] - 1, exact, exact + widest, exact + sums[0], exact + sums[1], anchor)))
    for e, chains in enumerate(ending):
        top = (best[e][0], e, None)
        for s, chain in chains:
            if (weight := best[s][0] + chain.effective * 1000 + chain.exact) > top[0]:
                top = (weight, s, chain)
        best.append(top)
    at = len(shown)
    while at > 0:
        _, before, chain = best[at]
        if chain:
            out.append(chain)
            at = before
        else:
            at -= 1
    return sorted(out)


def above_floor(value: float, floor: float) -> float:
    return 0.0 if floor <= 0 or value <= floor else min(1.0, (value - floor) / floor)


def clamp(x: float) -> float:
    return max(0.0, min(1.0, x))


def score(found: list[Region], left: int, right: int, least: int) -> float:
    """Similarity from coverage, contiguity, fragmentation and purity; 0 without regions or tokens."""
    if not found or not left or not right:
        return 0.0
    effective, exact = sum(r.effective for r in found), sum(r.exact for r in found)
    longest = max(r.anchor for r in found)
    l, r = sum(x.effective_left for x in found) / left, sum(x.effective_right for x in found) / right
    anchor = clamp(0.75 * (2 * l * r / (l + r) if l + r else 0.0) + 0.25 * math.sqrt(l * r))
    contiguity = clamp(0.9 + 0.05 * longest / min(left, right) + 0.05 * above_floor(longest, least))
    fragmentation = clamp(0.85 + 0.10 * math.sqrt(clamp(longest / effective)) + 0.05 * above_floor(effective / len(found), least))
    return clamp(anchor * contiguity * fragmentation * math.sqrt(exact / effective))


def scores(exact, effective, on_left, on_right, longest, many, left, right, least: int) -> np.ndarray:
    """score() of many pairs, from the sums of their regions, the longest anchors, the numbers of regions and the tokens of the sides."""
    out = np.zeros(len(exact))
    k = np.flatnonzero((many > 0) & (left > 0) & (right > 0))
    exact, effective, longest, many, left, right = (np.asarray(x, float)[k] for x in (exact, effective, longest, many, left, right))
    l, r = on_left[k] / left, on_right[k] / right
    unit = lambda x: np.clip(x, 0.0, 1.0)
    above = lambda x: unit((x - least) / least)
    anchor = unit(0.75 * (2 * l * r / (l + r)) + 0.25 * np.sqrt(l * r))
    contiguity = unit(0.9 + 0.05 * longest / np.minimum(left, right) + 0.05 * above(longest))
    fragmentation = unit(0.85 + 0.10 * np.sqrt(unit(longest / effective)) + 0.05 * above(effective / many))
    out[k] = unit(anchor * contiguity * fragmentation * np.sqrt(exact / effective))
    return out


def template_mask(side: Side, template: Side, grams: Grams, least: int = Params.template_min_match) -> list[bool]:
    """The tokens that tiles with the template cover, after its gaps have split them. grams: those of the template."""
    mask = [False] * len(side.tokens)
    for i, _, n in split_on_gaps(greedy_tiles(Grams(side.tokens, side.mask, least), grams), side.units, template.units):
        if n >= least:
            mask[i : i + n] = [True] * n
    return mask
