"""Byte-pair merging of one word, the step that runs once per distinct word in a Python worker."""

from __future__ import annotations

import heapq


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of ``word``: keep joining the adjacent pair with the lowest rank.

    Pairs wait in a heap and neighbours are linked, so long runs of characters stay cheap.
    """
    if word in ranks:
        return [ranks[word]]
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    waiting: list[tuple[int, int, bytes]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right < len(parts):
            joined = parts[left] + parts[right]
            if joined in ranks:
                heapq.heappush(waiting, (ranks[joined], left, joined))

    for place in range(len(parts) - 1):
        offer(place)
    while waiting:
        _, left, joined = heapq.heappop(waiting)
        right = after[left]
        if parts[left] is None or right >= len(parts) or parts[left] + parts[right] != joined:
            continue
        parts[left], parts[right] = joined, None
        after[left] = after[right]
        if after[left] < len(parts):
            before[after[left]] = left
        if before[left] >= 0:
            offer(before[left])
        offer(left)
    return [ranks[p] for p in parts if p is not None]
