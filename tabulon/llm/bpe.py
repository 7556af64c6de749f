"""Merge agenda shared by the two byte-pair operators."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

NEVER = float("inf")
_SHORT = 40  # symbols up to which a list of ranks beats the heap


def merge_agenda(
    symbols: Sequence[str],
    rank_of: Callable[[str, str], float],
    skip: Callable[[int, str], bool] | None = None,
) -> list[str]:
    """Join neighbours, best rank first and leftmost on ties, until none is left.

    ``rank_of(a, b)`` gives the rank of joining two symbols, or ``NEVER``.
    ``skip`` sees each candidate that comes up, as (position, joined string),
    and may drop it; the same neighbours are not offered again unless one of
    them changes.  Long runs use a heap, so their work is n log n.
    """
    if len(symbols) > _SHORT:
        return _merge_long(symbols, rank_of, skip)
    parts = list(symbols)
    ranks = [*map(rank_of, parts, parts[1:])]
    while ranks:
        best = min(ranks)
        if best == NEVER:
            break
        i = ranks.index(best)
        if skip is not None and skip(i, parts[i] + parts[i + 1]):
            ranks[i] = NEVER
            continue
        parts[i:i + 2] = (parts[i] + parts[i + 1],)
        del ranks[i]
        if i:
            ranks[i - 1] = rank_of(parts[i - 1], parts[i])
        if i < len(ranks):
            ranks[i] = rank_of(parts[i], parts[i + 1])
    return parts


def _merge_long(
    symbols: Sequence[str], rank_of: Callable[[str, str], float], skip: Callable[[int, str], bool] | None,
) -> list[str]:
    n = len(symbols)
    left: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = []
    for i in range(n - 1):
        rank = rank_of(symbols[i], symbols[i + 1])
        if rank != NEVER:
            agenda.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(agenda)
    while agenda:
        _, i, a, b = heapq.heappop(agenda)
        j = after[i]
        if left[i] != a or j >= n or left[j] != b:
            continue  # one side has been joined since
        if skip is not None and skip(i, a + b):
            continue
        left[i], left[j] = a + b, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = rank_of(a + b, left[k])
            if rank != NEVER:
                heapq.heappush(agenda, (rank, i, a + b, left[k]))
        h = before[i]
        if h >= 0:
            rank = rank_of(left[h], a + b)
            if rank != NEVER:
                heapq.heappush(agenda, (rank, h, left[h], a + b))
    return [s for s in left if s is not None]
