"""Cutting texts where no token can cross, with bounded caches of what the cuts become.

The tokenizers' pattern never matches across the place before a space that a non-space follows,
nor across a single line feed between non-spaces: letters, numbers and signs take at most one
space before them, and a run of white space gives its last space to what follows. Texts whose
only white space is such spaces and line feeds are cut there; all others are left whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_OTHER_SPACE = re.compile(r"[^\S \n]")


def is_regular(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between other characters."""
    return not (
        "  " in text
        or "\n\n" in text
        or " \n" in text
        or "\n " in text
        or text[:1] in (" ", "\n")
        or text[-1:] in (" ", "\n")
        or _OTHER_SPACE.search(text)
    )


class Cache(dict):
    """What `make` gives for a key, kept for the first `most` keys."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


class ChunkCoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    whole(text) gives the ids of any text; on regular texts it is asked for the chunks between
    the cuts only, with the space or line feed before them.
    """

    def __init__(self, whole: Callable[[str], bytes], most: int = 600_000):
        self.whole = whole
        self.bare = Cache(whole, most // 4)
        self.spaced = Cache(lambda chunk: whole(" " + chunk), most)
        self.feed = whole("\n")

    def ids(self, text: str) -> bytes:
        if not text or not is_regular(text):
            return self.whole(text) if text else b""
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self.feed)
            out.append(self.bare[first])
            out.extend(map(self.spaced.__getitem__, rest))
        return b"".join(out[1:])
