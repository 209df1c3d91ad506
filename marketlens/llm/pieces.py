"""Long texts in pieces, so that a task's memory follows the piece and not the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

PIECE = 1 << 20


def pieces(text: str | bytes, gap: re.Pattern, size: int = PIECE) -> Iterator[str | bytes]:
    """Consecutive parts of ``text`` of about ``size``, each cut at a match of ``gap``, which no token contains."""
    at = 0
    while at < len(text):
        cut = gap.search(text, at + size) if at + size < len(text) else None
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to
