"""Cutting work on texts into portions of bounded size; every character belongs to one portion."""

from __future__ import annotations

from collections.abc import Iterator

#: Characters that are worked on at once.
PORTION = 2_000_000


def portions(texts: list[str | None], limit: int = PORTION) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most limit characters each; a longer text is a range of its own."""
    begin = size = 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > begin and size + n > limit:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)

