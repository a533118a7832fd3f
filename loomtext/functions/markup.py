"""Where tags end, in time linear in the page whatever it holds; character references."""

from __future__ import annotations

import html
import re
from html.entities import html5

_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([a-zA-Z][a-zA-Z0-9]*));")
_PLAIN = re.compile(r"[^>\"']*")


class Tags:
    """Ends of the tags of one page.

    A tag ends at its first > outside quotes. Where a quote is never closed it
    ends at the first >, and so do the tags that start before that quote. What
    has no > behind it is no tag. Each of these is remembered, so that a page
    of openings without an end is not searched again from each of them.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.open_at = -1
        self.no_more = {'"': len(page), "'": len(page)}

    def end(self, at: int) -> int:
        """Just behind the > of a tag whose name ends at ``at``; -1 if none."""
        if at > self.last:
            return -1
        first = self.page.find(">", at) + 1
        if at < self.open_at:
            return first
        while True:
            at = _PLAIN.match(self.page, at).end()
            quote = self.page[at : at + 1]
            if quote == ">":
                return at + 1
            close = -1
            if quote and at < self.no_more[quote]:
                close = self.page.find(quote, at + 1)
                if close < 0:
                    self.no_more[quote] = at
            if close < 0:
                self.open_at = at
                return first
            at = close + 1


def decoded(text: str) -> str:
    """Text with its character references decoded: those that end with a
    semicolon. ``&amp`` without one stays, as in the reference's decoder."""
    return _REFERENCE.sub(lambda m: html.unescape(m[0]) if m[1] is None or f"{m[1]};" in html5 else m[0], text)
