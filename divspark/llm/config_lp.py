"""Configuration linear program of bin packing, over a histogram of lengths.

The program has one variable per *configuration* (a multiset of lengths that
fits into the capacity) and one covering row per length: ``min sum x_c`` with
``sum a[c, l] * x_c >= n[l]``.  It is solved by multiplicative weights: prices
on the lengths, a knapsack dynamic program that finds the configurations of the
highest total price, and prices that fall where the average solution covers too
much and rise where it covers too little.  The average is rounded to whole copies,
and what is left is packed best fit, longest first.

The histogram has at most ``capacity`` entries whatever the corpus, so time and
memory here do not grow with the input.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np

Config = tuple[tuple[int, int], ...]  # ((length, copies), ...), longest first


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over lengths ``1..capacity`` with ``price[length]``
    (0 where the length does not occur): best value and last length taken, for
    every capacity (length 0: leave one unit free)."""
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        value = price[1:c + 1] + best[c - 1::-1]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], last[c] = value[k], k + 1
        else:
            best[c], last[c] = best[c - 1], 0
    return best, last


def configurations(anchors: np.ndarray, last: np.ndarray, capacity: int) -> list[Config]:
    """For each anchor length the best configuration that contains it."""
    room = capacity - anchors
    picks = [anchors]
    while True:
        for _ in range(capacity):  # skip free units
            skip = (room > 0) & (last[room] == 0)
            if not skip.any():
                break
            room = room - skip
        take = np.where(room > 0, last[room], 0)
        if not take.any():
            break
        picks.append(take)
        room = room - take
    table = -np.sort(-np.stack(picks, axis=1), axis=1)
    out = []
    for row in table.tolist():
        counts: dict[int, int] = {}
        for length in row:
            if length:
                counts[length] = counts.get(length, 0) + 1
        out.append(tuple(counts.items()))
    return out


def solve(hist: dict[int, int], capacity: int, rounds: int = 60, anchors: int = 1024, near: float = 0.8,
          sharp: tuple[float, float] = (2.0, 10.0)) -> dict[Config, float]:
    """Fractional solution by multiplicative weights.

    A length's price is its share of the capacity times a weight that falls
    exponentially with how far the running average covers it, ever more sharply.
    Each round adds, for the least covered lengths, the best configurations that
    contain them and whose total price is near the best of all.
    """
    lengths = np.array(sorted(hist), dtype=np.int64)
    need = np.array([hist[x] for x in lengths.tolist()], dtype=float)
    price, covered = np.zeros(capacity + 1), np.zeros(capacity + 1)
    total: dict[Config, float] = defaultdict(float)
    scale, bound = 1.0, 0.0  # an entry of total stands for scale times its number
    for t in range(rounds):
        alpha = sharp[0] + (sharp[1] - sharp[0]) * t / rounds
        ratio = covered[lengths] * scale / need
        price[lengths] = lengths / capacity * (np.exp(-alpha * (np.clip(ratio, 0, 3) - 1)) if t else 1)
        best, last = knapsack(price, capacity)
        bound = max(bound, float((price[lengths] * need).sum() / best[capacity]))
        order = np.argsort(ratio, kind="stable")[:anchors]
        value = price[lengths[order]] + best[capacity - lengths[order]]
        order = order[value >= near * value.max()]
        step = 2 / (t + 2)
        scale = scale * (1 - step) if t else 1.0
        if not t:
            step = 1.0
        weight = need[order] / need[order].sum() * bound * step / scale
        for config, w in zip(configurations(lengths[order], last, capacity), weight.tolist(), strict=True):
            total[config] += w
            for length, copies in config:
                covered[length] += w * copies
    return {config: x * scale for config, x in total.items()}


def best_fit(hist: dict[int, int], capacity: int) -> dict[Config, int]:
    """Best fit, longest first, over counts: equal bins are filled together."""
    open_bins: dict[int, list[list]] = defaultdict(list)  # free room -> [[contents, bins], ...]
    rooms: list[int] = []

    def add(room: int, contents: tuple, bins: int) -> None:
        if not open_bins[room]:
            bisect.insort(rooms, room)
        open_bins[room].append([contents, bins])

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                bins, odd = divmod(left, each)
                if bins:
                    add(capacity - each * length, ((length, each),), bins)
                if odd:
                    add(capacity - odd * length, ((length, odd),), 1)
                break
            room = rooms[at]
            contents, bins = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(at)
            each = min(room // length, left)
            used = min(bins, left // each)
            if used < bins:
                add(room, contents, bins - used)
            add(room - each * length, contents + ((length, each),), used)
            left -= used * each
    out: dict[Config, int] = defaultdict(int)
    for groups in open_bins.values():
        for contents, bins in groups:
            out[contents] += bins
    return out


def rounded(total: dict[Config, float], hist: dict[int, int], capacity: int, least: int) -> dict[Config, int]:
    """Whole copies of a fractional solution: each configuration its number rounded
    down, but ``least`` at least, as far as the lengths go; the rest best fit."""
    left, out = dict(hist), defaultdict(int)
    for config, x in sorted(total.items(), key=lambda e: (-e[1], e[0])):
        copies = min([max(least, int(x)), *(left.get(length, 0) // n for length, n in config)])
        if copies:
            out[config] += copies
            for length, n in config:
                left[length] -= n * copies
    for config, bins in best_fit({k: v for k, v in left.items() if v}, capacity).items():
        out[config] += bins
    return out


def pack(hist: dict[int, int], capacity: int, rounds: int = 60) -> dict[Config, int]:
    """Whole copies of configurations that hold every length exactly ``hist`` times;
    the better of the two ways to round the fractional solution."""
    left = {k: v for k, v in hist.items() if v > 0}
    full = left.pop(capacity, 0)
    out = {}
    if left:
        total = solve(left, capacity, rounds)
        out = min((rounded(total, left, capacity, least) for least in (1, 0)), key=lambda o: sum(o.values()))
    return dict(out) | ({((capacity, 1),): full} if full else {})
