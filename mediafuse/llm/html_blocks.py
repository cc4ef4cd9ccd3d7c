"""Leaf blocks of an HTML page: their text, their path of open elements, and feature vectors of both."""

from __future__ import annotations

import html
import math
import re
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from mediafuse.llm.html_layouts import NAMES

#: A quoted value holds no "<", or else ends before a space, a slash or the tag's end; a tag whose quotes fit neither ends at its first ">".
_QUOTED = r"""\"[^\"<]*+\"|'[^'<]*+'|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>])"""
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)(?:((?:[^>\"']|{_QUOTED})*+)(?:>|\Z)|([^>]*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements whose whole content is no text of the page. Fixed values.
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist".split())
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "title", "svg", "math", "iframe", "textarea", "select")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img input wbr".split())
#: What the start of an element closes if it is open. Fixed values.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements within which such a start closes nothing further out. Fixed values.
SCOPE = frozenset("ul ol dl table div section article main aside nav header footer form body".split())
PATH_DIM, WORD_DIM, EXTRA_DIM = 320, 64, 8
DIM = PATH_DIM + WORD_DIM + EXTRA_DIM
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Block(NamedTuple):
    text: str
    path: tuple[tuple[str, str], ...]
    linked: int


def blocks(page: str) -> list[Block]:
    """All blocks of the page in order. Text is decoded, with single spaces; blocks without text are left out."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, links, at, n = 0, 0, 0, len(page)
    unended: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(e for e in stack if e[0] not in INLINE), linked))
            parts.clear()
        linked = 0

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3] if m[3] is not None else m[4] or ""
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag not in INLINE:
                flush()
            elif tag == "a":
                links = 0
            if depth is not None:
                del stack[depth:]
            continue
        if tag in UNSEEN:
            if tag not in INLINE:
                flush()
            if not attributes.rstrip().endswith("/"):
                end = None if tag in unended else (_RAW_END.get(tag) or re.compile(rf"</{tag}\s*>", re.I)).search(page, at)
                if end is None:
                    unended.add(tag)
                at = end.end() if end else (n if tag in ("script", "style", "template") else at)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                links = 1
            stack.append((tag, ""))
            continue
        flush()
        closing = CLOSES.get(tag, ())
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closing:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPE:
                    break
        open_p = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or stack[i][0] in SCOPE), None)
        if open_p is not None and stack[open_p][0] == "p":
            del stack[open_p:]
        stack.append((tag, " ".join("".join(v) if k.lower() != "data-y" else f"data-y={''.join(v)}" for k, *v in _ATTRIBUTE.findall(attributes)) if attributes else ""))
    flush()
    return out


#: Parts of names that say what an element is, and their beginnings; other parts are left out, since they would share buckets with these.
_KNOWN = frozenset(p.lower() for names in NAMES.values() for n in names for p in _PART.findall(n))
_BEGINNINGS = frozenset(p[:4] for p in _KNOWN if len(p) >= 3)


def _bucket(s: str, size: int) -> int:
    return zlib.crc32(s.encode()) % size


@lru_cache(maxsize=50_000)
def _element(tag: str, names: str, near: int) -> tuple[int, ...]:
    """Buckets of an element of a path: its tag (apart for the nearest) and the parts of its names with their beginnings."""
    keys = [f"t:{tag}", f"n{near}:{tag}"]
    for part in _PART.findall(re.sub(r"data-y=\S*", "", names)):
        part = part.lower()
        keys += [f"c:{part}"] * (part in _KNOWN) + [f"p:{part[:4]}"] * (part[:4] in _BEGINNINGS)
    return tuple(_bucket(k, PATH_DIM) for k in keys)


@lru_cache(maxsize=200_000)
def _word(w: str) -> int:
    return _bucket("w:" + w, WORD_DIM)


@lru_cache(maxsize=50_000)
def _path(path: tuple[tuple[str, str], ...]) -> np.ndarray:
    return np.array(sorted({k for depth, (tag, names) in enumerate(reversed(path)) for k in _element(tag, names, min(depth, 2))}), dtype=np.int64)


def features(found: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """(blocks, DIM) of the blocks from first to last: hashed tag path, hashed words (all of them), and length, link share, case and place."""
    part = found[first:last]
    x = np.zeros((len(part), DIM), dtype=np.float32)
    for i, b in enumerate(part):
        x[i, _path(b.path)] = 1.0
        count = np.bincount([_word(w) for w in b.text.lower().split()], minlength=WORD_DIM)
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = count / math.sqrt(count @ count)
        n, at = len(b.text), first + i
        x[i, -8:] = (math.log1p(n) / 8, min(1.0, b.linked / n), n < 25, b.text[-1] in ".!?…\"'", at / len(found), (len(found) - at) / len(found), len(b.path) / 10, 1.0)
    return x
