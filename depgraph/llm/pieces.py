"""Texts cut where no token can reach across, so that each distinct piece is encoded once.

A piece is what stands from one safe place to the next. A safe place lies between a character that is no white
space and a space: the pre-tokenizer patterns take a space only together with what follows it, and no special
token holds a space. A worker process keeps the pieces it has met, up to a fixed number.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

_SAFE = re.compile(r"(?<=\S)(?= )")
_UNSAFE_SPACE = re.compile(r"\s ")
#: Characters of a text that are cut into pieces at once.
BLOCK = 1 << 20


class Pieces(dict):
    """piece -> what ``encode`` gives for it. A key is a piece without its leading space, or ``(piece,)``."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 400_000, any_space: bool = False):
        """any_space: the tokenizer drops white space, so every space is a safe place and is left out."""
        super().__init__()
        self.encode, self.limit, self.any_space = encode, limit, any_space

    def of(self, texts: list[str]) -> list[list]:
        """The encoded pieces of each text, in order; few and short texts at a time, see ``blocks``."""
        flat, ends = [], [0]
        for x in texts:
            flat += self._cut(x)
            ends.append(len(flat))
        found = list(map(self.get, flat))
        missing = [i for i, x in enumerate(found) if x is None]
        new = list({flat[i] for i in missing})
        if len(self) + len(new) > self.limit:
            self.clear()
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            raw = some if self.any_space else [p[0] if type(p) is tuple else " " + p for p in some]
            self.update(zip(some, self.encode(raw), strict=True))
        for i in missing:
            found[i] = self[flat[i]]
        return [found[a:b] for a, b in zip(ends, ends[1:])]

    def _cut(self, text: str) -> list:
        if self.any_space:
            return text.split(" ")
        if _UNSAFE_SPACE.search(text):
            first, *rest = _SAFE.split(text)
            return [(first,), *(p[1:] for p in rest)]
        first, *rest = text.split(" ")
        return [(first,), *rest]


def blocks(text: str, most: int = BLOCK) -> Iterator[str]:
    """The text in blocks of about ``most`` characters, cut at safe places (whole if it has none)."""
    start = 0
    while len(text) - start > most and (m := _SAFE.search(text, start + most)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def by_bytes(texts: Iterable[str], most: int = BLOCK) -> Iterator[list[list[str]]]:
    """Runs of texts, each text as its blocks, of about ``most`` characters together; a longer text is its own run."""
    run, size = [], 0
    for x in texts:
        if run and size + len(x) > most:
            yield run
            run, size = [], 0
        run.append([x] if len(x) <= most else list(blocks(x, most)))
        size += len(x)
    if run:
        yield run


def encoded(pieces: Pieces, texts: Iterable[str | None]) -> Iterator[list[list]]:
    """For each text the lists of its encoded pieces, one list a block (null: empty text)."""
    for run in by_bytes(x or "" for x in texts):
        if all(len(b) == 1 for b in run):
            for one in pieces.of([b[0] for b in run]):
                yield [one]
        else:
            for b in run:
                yield [pieces.of([x])[0] for x in b]
