"""Scores for abusive, hateful and sexual wording.

A weighted lexicon is matched by an Aho-Corasick automaton over folded pages
(homoglyphs, digit substitutions, misreadings, spaced and broken words make no
difference). Exception wordings cancel what they overlap, frames of a report
what follows them closely in their sentence. What is left is added up within a window, so that
words of different articles do not add up, and normalised by length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexicon import CATEGORIES, EXCEPTIONS, REPORT_REACH, REPORTS
from .reading import fold, fold_ends, plain, read_pages

NAMES = tuple(CATEGORIES)


_EXCEPTION, _REPORT = -1, -2
# A page as read, but for its line breaks, which part the body from what is set larger; what ends a sentence, unless speech or a small letter follows or an abbreviation stands before.
_AS_READ = {10: " "}
_END = re.compile(r"[.!?]+[)\]]*\s*(?=[^\W\d_])")
_SHORT = re.compile(r"(?:\b(?:Mr|Mrs|Dr|St|Rev|Hon|Messrs|Capt|Col|Gen|Sgt|Lieut|Esq|No|Hr|Fr|Mme|Mlle|Sr|Sra|Don)|\b[^\W\d_])$")


@lru_cache(maxsize=4)
def _automaton():
    import ahocorasick

    at: dict[str, dict] = {}
    for c, groups in enumerate(CATEGORIES.values()):
        for weight, wordings, slot in groups:
            for w in wordings:
                had, key = at.setdefault(fold(w), {}), (plain(w), c)
                if weight > had.get(key, (0.0, None))[0]:
                    had[key] = weight, slot
    for kind, wordings in ((_EXCEPTION, EXCEPTIONS), (_REPORT, REPORTS)):
        for w in wordings:
            at.setdefault(fold(w), {})[plain(w), kind] = 0.0, None
    a = ahocorasick.Automaton()
    for k, (word, what) in enumerate(at.items()):
        a.add_word(word, (len(word), tuple((p, c, slot or k, weight) for (p, c), (weight, slot) in what.items())))
    a.make_automaton()
    return a


def misread(wording: str, read: str) -> int:
    """How many letters of the plain ``wording`` are read as others that look alike; 99 if the two do not fold alike letter by letter."""
    i = j = n = 0
    while i < len(wording) and j < len(read):
        x, y = wording[i], read[j]
        if x != y:
            n += 1
            fx, fy = fold(x), fold(y)
            if fx == fy:
                pass
            elif len(fx) > len(fy):
                j += 1
            elif len(fy) > len(fx):
                i += 1
            else:
                return 99
        i += 1
        j += 1
    return n if i == len(wording) and j == len(read) else 99


def _outermost(hits: list[tuple]) -> list[tuple]:
    """``hits`` (start, end, number, weight) without those inside a longer one of at least their weight, which add nothing to it."""
    out: list[tuple] = []
    end_of: dict[float, int] = {}  # by weight, the farthest end of hits that begin no later and are longer
    for (_, end), same in groupby(sorted(hits, key=lambda h: (h[0], -h[1])), key=lambda h: h[:2]):
        same = list(same)
        out += [h for h in same if not any(w >= h[3] and e >= end for w, e in end_of.items())]
        for h in same:
            end_of[h[3]] = max(end_of.get(h[3], -1), end)
    return out


def sentence_ends(text: str) -> list[int]:
    """How many plain letters of ``text`` stand before the end of each sentence but the last."""
    out, n, at = [], 0, 0
    for m in _END.finditer(text):
        if text[m.end()].isupper() and not _SHORT.search(text, max(0, m.start() - 8), m.start()):
            n, at = n + len(plain(text[at : m.start()])), m.start()
            out.append(n)
    return out


def score_text(text: str, reach: int = 180) -> tuple[list[float], list[float], int]:
    """``score_plain`` of a text as it is read, with its sentences, and the number of its plain letters."""
    letters = plain(text)
    return *score_plain(letters, reach, lambda: sentence_ends(text)), len(letters)


def score_plain(text: str, reach: int = 180, sentences: Callable[[], list[int]] = list) -> tuple[list[float], list[float]]:
    """(most weight within ``reach`` letters, total weight) of each category, every wording or slot counted once in a window.

    Wordings are found in the folded text; a hit counts if at most one letter in six is misread. ``sentences`` gives
    the ends of sentences, beyond which no frame of a report reaches.
    """
    hits: list[tuple] = []
    free: list[tuple] = []
    ends = stops = None
    for end, (n, what) in _automaton().iter(fold(text)):
        if ends is None:
            ends = fold_ends(text)
        s, e = (int(x) for x in np.searchsorted(ends, (end - n + 1, end), "right"))
        read = text[s : e + 1]
        for p, c, k, w in what:
            if p != read and misread(p, read) > len(p) // 6:
                continue
            if c >= 0:
                hits.append((s, e, k, c, w))
            elif c == _EXCEPTION:
                free.append((s, e))
            else:
                stops = sentences() if stops is None else stops
                free.append((e, min(e + REPORT_REACH, stops[n] - 1 if (n := bisect_right(stops, e)) < len(stops) else len(text))))
    best, total = [0.0] * len(NAMES), [0.0] * len(NAMES)
    if not hits:
        return best, total
    if free:
        hits = _kept(hits, free)
    for c in range(len(NAMES)):
        mine = [(s, e, k, w) for s, e, k, cc, w in hits if cc == c]
        total[c] = sum(w for *_, w in mine)
        mine = sorted(_outermost(mine), key=lambda h: h[:2])
        lo = 0
        for hi in range(len(mine)):
            while mine[hi][0] - mine[lo][0] > reach:
                lo += 1
            each: dict = {}
            for _, _, k, w in mine[lo : hi + 1]:
                each[k] = max(each.get(k, 0.0), w)
            best[c] = max(best[c], sum(each.values()))
    return best, total


def _kept(hits: list[tuple], free: list[tuple]) -> list[tuple]:
    """``hits`` (start, end, ...) that overlap none of the stretches ``free``."""
    free = sorted(free)
    starts, far, top = [s for s, _ in free], [], -1
    for _, e in free:
        top = max(top, e)
        far.append(top)
    return [h for h in hits if not ((n := bisect_right(starts, h[1])) and far[n - 1] >= h[0])]


def score_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", boxes: str | None = "line_boxes", reach: int = 180, threshold: float = 0.7, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, the columns ``also``, and per category ``<name>`` (present), ``<name>_weight`` and ``<name>_per_1000`` (weight per 1,000 letters).

    Whole texts are read, however long; lines set larger than the body are scored by themselves. Null and empty texts score 0 and hold
    nothing; null boxes mean the lines stand in reading order; repeated rows
    give repeated rows; an empty table gives none.
    """
    kind = dict(docs.dtypes)
    cols = list(dict.fromkeys([id, *also]))
    box = F.transform(F.col(boxes), lambda b: F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), b["y1"].alias("y1"))) if boxes else F.expr("cast(null as array<struct<x0:int,y0:int,y1:int>>)")
    d = docs.select(*cols, F.col(text).alias("_t"), box.alias("_b"))
    shape = ", ".join([f"`{c}` {kind[c]}" for c in cols] + [f"{n} boolean, {n}_weight double, {n}_per_1000 double" for n in NAMES])

    def run(batches):
        for b in batches:
            pages = [p.split("\n") for p in read_pages(b.column("_t").to_pylist(), b.column("_b"), large=True, table=_AS_READ)]
            out = {c: b.column(c) for c in cols}
            got = []
            for parts in pages:
                best, total, n = zip(*[score_text(p, reach) for p in parts])
                got.append(([max(x) for x in zip(*best)], [sum(x) for x in zip(*total)], sum(n)))
            for i, n in enumerate(NAMES):
                out[n] = pa.array([g[0][i] >= threshold - 1e-9 for g in got], pa.bool_())
                out[f"{n}_weight"] = pa.array([g[0][i] for g in got], pa.float64())
                out[f"{n}_per_1000"] = pa.array([1000.0 * g[1][i] / g[2] if g[2] else 0.0 for g in got], pa.float64())
            yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out.values()], names=list(out))

    return d.mapInArrow(run, shape)


def flagged(scores: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, category), one row for each category a document holds."""
    each = F.array(*[F.when(F.col(n), F.lit(n)) for n in NAMES])
    return scores.select(id, F.explode(F.array_compact(each)).alias("category")).distinct()


def rates(scores: DataFrame, by: str = "source") -> DataFrame:
    """Per value of ``by`` (null is one): documents, and the share holding each category and any."""
    any_ = F.lit(False)
    for n in NAMES:
        any_ = any_ | F.col(n)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return scores.groupBy(by).agg(F.count(F.lit(1)).alias("n_docs"), *[share(F.col(n)).alias(f"{n}_rate") for n in NAMES], share(any_).alias("any_rate"))
