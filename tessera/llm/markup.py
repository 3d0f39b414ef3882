"""Tokens of a web page in one pass whose time is in proportion to the page.

A tag ends at the first > outside the quotes that follow an =, or, where no such > is left, at the first > at all; a <
after the last > is text. Comments end at --> or with the page. Raw elements hold no markup: all up to their end tag is
theirs. A raw element that closes itself (<iframe/>) holds nothing. Where the end tag is missing, scripts and styles
hold the rest of the page, and of other raw elements only the start tag is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

TEXT, START, END, HELD = range(4)
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
#: Raw elements that hold the rest of a page without their end tag.
_TO_THE_END = frozenset("script style xmp noembed noframes".split())
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_LOOSE = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:_-]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_CLOSE: dict[str, re.Pattern] = {}


def attributes(rest: str) -> dict[str, str]:
    """Names in lower case and values of a tag's attributes; of equal names the first."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        out.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
    return out


def tokens(source: str, raw: frozenset[str] = RAW) -> Iterator[tuple[int, str, str]]:
    """(TEXT, '', text), (START, name, what follows the name), (END, name, ...) and (HELD, name, text of a raw element)."""
    at, end, last, strict, unclosed = 0, len(source), source.rfind(">"), True, set()
    find, tag = source.find, _TAG.match
    while at < end:
        lt = find("<", at)
        if lt < 0 or lt > last:
            comment = find("<!--", at) if lt >= 0 else -1
            if at < (stop := end if comment < 0 else comment):
                yield TEXT, "", source[at:stop]
            return
        if lt > at:
            yield TEXT, "", source[at:lt]
        c = source[lt + 1]
        closing = c == "/"
        if closing:
            c = source[lt + 2]
        if not (c.isascii() and c.isalpha()):
            if c == "!" and source.startswith("<!--", lt):
                at = close + 3 if (close := find("-->", lt + 2)) >= 0 else end
            elif closing or c in "!?":
                at = find(">", lt) + 1
            else:
                yield TEXT, "", "<"
                at = lt + 1
            continue
        m = tag(source, lt) if strict else None
        if m is None:
            strict, m = False, _LOOSE.match(source, lt)
        at = m.end()
        name, rest = m[1].lower(), m[2]
        yield END if closing else START, name, rest
        if name in raw and not closing and not rest.endswith("/") and name not in unclosed:
            if name not in _CLOSE:
                _CLOSE[name] = re.compile(rf"</{name}(?=[\s/>])", re.I)
            if close := _CLOSE[name].search(source, at):
                yield HELD, name, source[at : close.start()]
                at = find(">", close.end()) + 1 or end
            elif name in _TO_THE_END:
                yield HELD, name, source[at:]
                return
            else:
                unclosed.add(name)
