"""Words of whole texts, a bounded stretch of the text at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of a text that are split at once.
STRETCH = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_runs(text: bytes) -> Iterator[list[bytes]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in lists that follow each other; no word is cut."""
    low = 0
    while low < len(text):
        high = low + STRETCH
        if high < len(text):
            space = _SPACE.search(text, high)
            high = space.start() if space else len(text)
        yield text[low:high].split()  # bytes split at just these six
        low = high
