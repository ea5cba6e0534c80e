"""Scanned pages put back into reading order and folded for matching.

``read_pages`` orders a page's lines column by column, leaves out what is not
set in the body's type size (adverts, headlines) and folds the letters so that
the usual misreadings, homoglyphs, digit substitutions, case, accents,
punctuation, spaces and broken words make no difference: what looks alike gets
the same code.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

# Letters that a scanner confuses, as classes and as letter pairs.
CLASSES = ("aceo0", "rvy", "fst5", "nu", "il1", "gq")
PAIRS = {"d": "cl", "m": "rn", "w": "vv", "h": "ii", "b": "ii"}
# Digits and signs written for letters, and letters of other alphabets that look like Latin ones.
WRITTEN_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "|": "l", "ß": "ss", "ſ": "s", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "ı": "i"}
HOMOGLYPHS = dict(zip("авеикмнорстухіјѕԁԛαειονρτυχκ", "abeukmhopctyxijsdqaeiovptuxk"))


class _Plain(dict):
    """A translation table that fills itself: code point to lower-case letters without accents, empty for what is no letter."""

    def __missing__(self, point: int) -> str:
        out = (WRITTEN_FOR.get(c, HOMOGLYPHS.get(c, c)) for c in unicodedata.normalize("NFKD", chr(point).lower()))
        got = self[point] = "".join(c for d in out for c in d if c.isalpha())
        return got


class _Fold(dict):
    """A translation table that fills itself: code point to folded letters, empty for what is no letter."""

    def __missing__(self, point: int) -> str:
        each = (e for d in PLAIN[point] for e in PAIRS.get(d, d))
        got = self[point] = "".join(next((k[1] if k[0] == "r" else k[0] for k in CLASSES if e in k), e) for e in each)
        return got


PLAIN, _TABLE = _Plain(), _Fold()


def plain(text: str) -> str:
    """Letters of ``text`` in lower case, without accents and anything between them; ``fold(plain(t))`` is ``fold(t)``."""
    return text.translate(PLAIN) if text else ""


def fold(text: str) -> str:
    """Folded letters of ``text`` without anything between them. Null gives the empty text."""
    return text.translate(_TABLE) if text else ""


class _Lengths(dict):
    """A translation table that fills itself: plain letter to the number of its folded letters, as a character."""

    def __missing__(self, point: int) -> str:
        got = self[point] = chr(len(fold(chr(point))))
        return got


_LENGTHS = _Lengths()


def fold_ends(letters: str) -> np.ndarray:
    """How many folded letters the first, the first two, ... plain ``letters`` make."""
    return np.cumsum(np.frombuffer(letters.translate(_LENGTHS).encode("latin-1"), np.uint8), dtype=np.int64)


def column_order(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, height: np.ndarray, gutter: int = 200, larger: float = 1.08, large: bool = False) -> np.ndarray:
    """Line numbers of the bodies (or with ``large`` of the larger lines) of all pages, page by page in reading order. ``page`` numbers the page of each line and does not decrease.

    The body is what is at most ``larger`` times the page's median line height;
    a column begins where the left edges of body lines leave ``gutter`` pixels.
    """
    if not len(page):
        return np.zeros(0, np.int64)
    by_height = np.lexsort((height, page))
    first = np.flatnonzero(np.r_[True, np.diff(page) != 0])
    count = np.diff(np.r_[first, len(page)])
    middle = height[by_height[first + (count - 1) // 2]]
    body = np.flatnonzero((height <= larger * np.repeat(middle, count)) != large)
    if not len(body):
        return body
    order = body[np.lexsort((x0[body], page[body]))]
    new = np.r_[True, (np.diff(page[order]) != 0) | (np.diff(x0[order]) > gutter)]
    col = np.cumsum(new)
    return order[np.lexsort((order, y0[order], col))]


def read_pages(texts: list[str | None], lines: pa.Array, gutter: int = 200, large: bool = False, table: dict = _TABLE) -> list[str]:
    """Folded (or by another ``table``) body text of each page. ``lines`` is a list array of structs x0, y0, y1 in the order of the text's lines.

    Where the number of boxes and lines differs, or there are none, the lines
    are taken as they stand. Null and empty texts give the empty text. With
    ``large`` the lines set larger follow the body, behind a line break.
    """
    if isinstance(lines, pa.ChunkedArray):
        lines = lines.combine_chunks()
    flat, off = lines.flatten(), np.r_[0, np.cumsum(np.nan_to_num(np.asarray(lines.value_lengths().fill_null(0)), nan=0))].astype(np.int64)
    x0, y0, y1 = (np.asarray(flat.field(k).fill_null(0)).astype(np.int64) for k in ("x0", "y0", "y1"))
    split = [t.split("\n") if t else [] for t in texts]
    fits = np.array([len(ls) for ls in split], np.int64) == np.diff(off)
    page = np.repeat(np.arange(len(texts)), np.diff(off))
    use = np.flatnonzero(fits[page]) if len(page) else np.zeros(0, np.int64)
    order = use[column_order(page[use], x0[use], y0[use], (y1 - y0)[use], gutter)]
    cut = np.searchsorted(page[order], np.arange(len(texts) + 1))
    place = (order - off[page[order]]).tolist()
    if large:
        big = use[column_order(page[use], x0[use], y0[use], (y1 - y0)[use], gutter, large=True)]
        big_cut = np.searchsorted(page[big], np.arange(len(texts) + 1))
        big_place = (big - off[page[big]]).tolist()
    out = []
    for i, t in enumerate(texts):
        if not t:
            out.append("")
            continue
        ls = split[i]
        if fits[i]:
            t = "".join([ls[k] for k in place[cut[i] : cut[i + 1]]])
        t = t.translate(table)
        if large and fits[i] and big_cut[i] < big_cut[i + 1]:
            t += "\n" + "".join([ls[k] for k in big_place[big_cut[i] : big_cut[i + 1]]]).translate(table)
        out.append(t)
    return out
