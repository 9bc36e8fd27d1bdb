"""Public tokenizer files: read on the driver, sent to the executors, taken up once by each Python worker."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer


def vocabulary_file(name: str) -> str:
    """The default path of one of the installed vocabulary files."""
    return public_tokenizers.path(name)


def read_vocabulary(path: str) -> str:
    """The tokenizer's JSON: one to two MB, whatever the data, so it travels with the function that needs it."""
    return Path(path).read_text(encoding="utf-8")


@lru_cache(4)
def tokenizer(spec: str) -> Tokenizer:
    """The library's tokenizer of a JSON text, without truncation and padding."""
    found = Tokenizer.from_str(spec)
    found.no_truncation()
    found.no_padding()
    return found


class RecentCache:
    """Remembers entries that were asked for of late: when one generation is full, the one before it is forgotten."""

    def __init__(self, entries: int):
        self.entries, self.now, self.old = entries, {}, {}

    def take(self, keys: set, fill) -> dict:
        """A dict with the entries of ``keys`` among others; those missing are filled by one call of ``fill``."""
        if len(self.now) > self.entries:
            self.old, self.now = self.now, {}
        missing = keys.difference(self.now)
        again = [k for k in missing if k in self.old]
        self.now.update((k, self.old[k]) for k in again)
        missing = list(missing.difference(again))
        self.now.update(zip(missing, fill(missing), strict=True))
        return self.now

    def settle(self) -> None:
        """Forgets the older generation: what a task leaves behind in its worker is one generation at most."""
        self.old = {}


def blocks(texts: list[str], chars: int) -> list[tuple[int, int]]:
    """Runs of texts of about so many characters together; a longer text is a run of its own."""
    found, start, size = [], 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > chars:
            found.append((start, i))
            start, size = i, 0
        size += len(text)
    return [*found, (start, len(texts))] if len(texts) > start else found
