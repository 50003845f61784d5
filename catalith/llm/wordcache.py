"""A bounded per-process memo from words to small encoded values.

Tokenizers whose result for a text is the concatenation of the results for its
words can skip repeated words.  The memo holds ``limit`` words at most, in two
generations: when the young one is full it becomes the old one, and words of the old
one that are met again move up, so frequent words stay and a worker's memory is
bounded whatever the corpus.  One call may go over the limit by its own words.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence


class WordCache:
    def __init__(self, encode: Callable[[list], Sequence], limit: int = 250_000) -> None:
        self.encode, self.half, self.young, self.old = encode, limit // 2, {}, {}

    def ensure(self, words: set) -> dict:
        """The young generation, holding every word of ``words``."""
        new = [w for w in words if w not in self.young]
        if new and len(self.young) + len(new) > self.half:
            self.old, self.young = self.young, {}
            new = list(words)
        if new:
            old = self.old
            self.young.update({w: old[w] for w in new if w in old})
            fresh = [w for w in new if w not in old]
            self.young.update(zip(fresh, self.encode(fresh), strict=True))
        return self.young
