"""Evaluation passages inside a training corpus.

Both sides are folded (see ``reading``) and fingerprinted by winnowing: of every
window of k-gram hashes the least is kept, so any shared stretch of at least
``window + k - 1`` folded letters shares a fingerprint. The fingerprints of both
sides are joined, and every hit is extended word by word in both directions,
over words with a single misread letter, to the longest run of consecutive
words of the passage.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, write_table
from .reading import PAIRS, PLAIN, fold, fold_ends, plain, read_pages

_B = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_PAIR_CODES = {1: frozenset(fold(c) for c in PAIRS), -1: frozenset(fold(c)[::-1] for c in PAIRS)}  # by direction of reading


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-gram of ``codes``."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h *= _B
            h += codes[j : j + n]
        h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
    return h


def winnow(codes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the k-grams that are the least of some window of ``window`` k-grams, ties included; of fewer k-grams, the least of all."""
    h = gram_hashes(codes, k)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), h
    w = min(window, n)
    # Sliding minimum by doubling.
    low, span = h, 1
    while span * 2 <= w:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    m = n - w + 1
    low = np.minimum(low[:m], low[w - span : w - span + m])
    is_low = np.zeros(n, bool)
    for j in range(w):
        is_low[j : j + m] |= h[j : j + m] == low
    pos = np.flatnonzero(is_low)
    return pos, h[pos]


def winnow_pages(pages: list[str], k: int, window: int, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page number, position, hash) of the fingerprints of ``pages``, taken together in pieces of about ``piece`` letters.

    Holds every fingerprint that :func:`winnow` gives for a page of at least
    ``window`` k-grams; of a page of fewer, all its k-grams.
    """
    size = np.array([len(p) for p in pages], np.int64)
    start = np.cumsum(size) - size
    codes = np.frombuffer("".join(pages).encode("utf-32-le"), np.uint32)
    pos, h, step = [], [], max(piece, 4 * (k + window))
    for s in range(0, max(1, len(codes)), step):
        # Windows over a border between pieces lie whole in the next piece's overlap.
        s0 = max(0, s - (k + window - 2))
        p, x = winnow(codes[s0 : s + step].astype(np.uint64), k, window)
        pos.append(p + s0)
        h.append(x)
    short = np.flatnonzero((size >= k) & (size < k + window - 1))
    for i in short:
        x = gram_hashes(codes[start[i] : start[i] + size[i]].astype(np.uint64), k)
        pos.append(start[i] + np.arange(len(x)))
        h.append(x)
    pos, first = np.unique(np.concatenate(pos), return_index=True)
    h = np.concatenate(h)[first]
    page = np.searchsorted(start, pos, "right") - 1
    at = pos - start[page]
    whole = at + k <= size[page]
    return page[whole], at[whole], h[whole]


def unlike(a: str, b: str) -> float:
    """Edit distance of two plain words in which a usual misreading (``CLASSES``, ``PAIRS``) counts half."""
    far = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                far[i][j] = float(i + j)
                continue
            x, y = a[i - 1], b[j - 1]
            least = min(far[i - 1][j] + 1, far[i][j - 1] + 1, far[i - 1][j - 1] + (0 if x == y else 0.5 if fold(x) == fold(y) else 1))
            if j > 1 and PAIRS.get(x) == b[j - 2 : j]:
                least = min(least, far[i - 1][j - 2] + 0.5)
            if i > 1 and PAIRS.get(y) == a[i - 2 : i]:
                least = min(least, far[i - 2][j - 1] + 0.5)
            far[i][j] = least
    return far[-1][-1]


class Page:
    """A page's plain letters, and the same folded, forwards and backwards."""

    def __init__(self, letters: str):
        self.letters, self.folded = letters, fold(letters)
        self._back, self._at = None, None

    @property
    def back(self) -> str:
        if self._back is None:
            self._back = self.folded[::-1]
        return self._back

    def between(self, start: int, end: int) -> str:
        """The plain letters behind the folded ones from ``start`` to ``end``."""
        if self._at is None:
            self._at = fold_ends(self.letters)
        s, e = np.searchsorted(self._at, (start, end - 1), "right") if end > start else (0, -1)
        return self.letters[s : e + 1]


class Passage:
    """A folded passage and where its words begin."""

    def __init__(self, text: str | None):
        self.plain = [f for f in (plain(w) for w in (text or "").split()) if f]
        self.words = [fold(w) for w in self.plain]
        self.text = "".join(self.words)
        self.starts = [0, *accumulate(map(len, self.words))]
        self.back = [w[::-1] for w in self.words]

    def _after(self, page: str, i: int, word: str, pairs: frozenset, sure: bool) -> list[int]:
        """Where in ``page`` the reading of ``word`` at i may end, if one of its letters is misread, lost or added; added before it only if the word before was ``sure``."""
        n, p = len(word), 0
        half = n // 2
        # One letter (two folded ones at most) leaves the first half whole but for its end, or the second half a little moved.
        if not page.startswith(word[: half - 1], i) and word[half:] not in page[max(0, i + half - 2) : i + n + 2]:
            return []
        while p < n and i + p < len(page) and page[i + p] == word[p]:
            p += 1
        out = []
        for da, db in ((1, 1), (1, 0), (0, 1), (1, 2), (2, 1), (2, 2), (2, 0), (0, 2)):
            if p + db > n or i + p + da > len(page) or (da > db and not p and not sure):
                continue
            # A letter that folds into two counts as one.
            if db == 2 and word[p : p + 2] not in pairs and (da or p == 0 or word[p - 1 : p + 1] not in pairs):
                continue
            if da == 2 and page[i + p : i + p + 2] not in pairs and (db or p == 0 or page[i + p - 1 : i + p + 1] not in pairs):
                continue
            if page.startswith(word[p + db :], i + p + da):
                out.append(i + n + da - db)
        return out

    def follow(self, page: Page, i: int, j: int, step: int, seen: set, least: int = 4) -> int:
        """How many words from number j on, in direction ``step``, are read in ``page`` from i on.

        With ``step`` -1 everything is read backwards and i is counted from the
        page's end. A word of ``least`` or more letters may have one
        letter misread, lost or added, and one more misread in a usual way.
        Where it is not sure at which place such a word ends, all are followed.
        ``seen`` gets (place, number) of the word borders passed.
        """
        text, words = (page.folded, self.words) if step > 0 else (page.back, self.back)
        n, got, size, sure = len(words), 0, len(text), True
        while 0 <= j < n and text.startswith(words[j], i):  # as far as nothing is misread
            i += len(words[j])
            got += 1
            j += step
            seen.add((i, j) if step > 0 else (size - i, j + 1))
        at, pairs = [i], _PAIR_CODES[step]
        while 0 <= j < n:
            w = words[j]
            there = [a + len(w) for a in at if text.startswith(w, a)]
            exact = bool(there)
            if not exact and len(self.plain[j]) >= least:
                ends = [(a, b) for a in at for b in self._after(text, a, w, pairs, sure)]
                if ends:
                    ends = [(a, b) for a, b in ends if unlike(self.plain[j], page.between(a, b) if step > 0 else page.between(size - b, size - a)) <= 1.5]
                there = list(dict.fromkeys(b for _, b in ends))
            if not there and got and sure:  # a letter added between two words
                there = [a + x + len(w) for a in at for x in (1, 2) if text.startswith(w, a + x) and (x == 1 or text[a : a + 2] in pairs)]
            if not there:
                break
            at, sure = there, exact
            got += 1
            j += step
            if step > 0:
                seen.update((a, j) for a in at)
            else:
                seen.update((size - a, j + 1) for a in at)
        return got

    def longest(self, page: Page, hits: list[tuple[int, int]], k: int) -> int:
        """Most consecutive words read in ``page`` around any of the hits (position in the folded page, in the passage)."""
        best, seen, text = 0, set(), page.folded
        for p, q in hits:
            j = bisect_left(self.starts, q)
            if self.starts[j] > q + k:  # inside a word longer than a k-gram
                j -= 1
            i = p + self.starts[j] - q
            if (i, j) in seen or not 0 <= i <= len(text) or text[p : p + k] != self.text[q : q + k]:
                continue
            seen.add((i, j))
            right = self.follow(page, i, j, 1, seen)
            best = max(best, right + self.follow(page, len(text) - i, j - 1, -1, seen))
        return best


class _Sieve:
    """A blocked Bloom filter: 64-bit words, two bits a hash. False alarms only cost rows in the join."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def holds(self, h: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        w = self.words[(h & np.uint64(len(self.words) - 1)).astype(np.int64)]
        bits = (one << ((h >> np.uint64(40)) & np.uint64(63))) | (one << ((h >> np.uint64(52)) & np.uint64(63)))
        return w & bits == bits

    @classmethod
    def of(cls, hashes: DataFrame, n: int, most_words: int) -> "_Sieve":
        """Built by the executors; at most ``most_words`` words reach the driver, however many hashes there are."""
        size = 1
        while size < min(most_words, max(1, n // 4)):
            size *= 2
        one, bit = F.lit(1).cast("bigint"), lambda s: F.shiftrightunsigned("_h", s).bitwiseAND(F.lit(63).cast("bigint")).cast("int")
        both = F.call_function("shiftleft", one, bit(40)).bitwiseOR(F.call_function("shiftleft", one, bit(52)))
        got = hashes.groupBy(F.col("_h").bitwiseAND(F.lit(size - 1).cast("bigint")).alias("w")).agg(F.bit_or(both).alias("b")).toPandas()
        words = np.zeros(size, np.uint64)
        words[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
        return cls(words)


@lru_cache(maxsize=4096)
def _passage(text: str) -> Passage:
    return Passage(text)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    boxes: str | None = "line_boxes",
    item_id: str = "item_id",
    passage: str = "passage",
    min_words: int = 12,
    k: int = 16,
    window: int = 8,
    sieve_words: int = 1 << 20,
    broadcast_grams: int = 1_000_000,
    passages_mb: int = 64,
) -> DataFrame:
    """(id, item_id, words, share): documents that hold at least ``min_words`` consecutive words of an item's passage.

    ``words`` is the longest such run and ``share`` its part of the passage.
    Case, punctuation, accents, broken words, page columns and usual misreadings
    make no difference, nor does one letter misread, lost or added in a word of
    four or more letters. A passage that stands in several items gives
    each. Null or short passages and null or empty texts hold nothing; repeated
    documents give repeated rows; empty tables give none.

    The corpus is read once, however many items there are: each page is folded
    and winnowed, and its fingerprints that pass a filter of the items'
    (at most ``sieve_words`` 64-bit words, built by the executors) are joined
    with those of the distinct passages, by broadcast when these are counted to
    be at most ``broadcast_grams``. Pages with hits, and their hits, then meet by page in one sorted
    stream. Passages go to the tasks up to ``passages_mb`` of text, counted;
    beyond that they are joined. No hit is dropped before it is extended, so
    what is found for one item does not depend on the others.
    """
    kinds = dict(docs.dtypes)[id], dict(items.dtypes)[item_id]
    some = items.where(F.col(passage).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("_item"), F.col(passage).alias("_passage"), F.xxhash64(passage).alias("_pk"))
    tests = some.select("_pk", "_passage").dropDuplicates(["_pk"])

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for pk, t in zip(pdf["_pk"], pdf["_passage"]):
                p = Passage(t)
                if len(p.words) >= min_words:
                    h = gram_hashes(np.frombuffer(p.text.encode("utf-32-le"), np.uint32).astype(np.uint64), k)
                    yield pd.DataFrame({"_h": h.view(np.int64), "_pk": pk, "_q": np.arange(len(h), dtype=np.int32)})

    # Every k-gram of the test side is kept, so that each fingerprint of the corpus side can meet it.
    prints = write_table(tests.mapInPandas(grams, "_h bigint, _pk bigint, _q int"))
    size = prints.agg(F.count(F.lit(1))).first()[0]
    sieve = docs.sparkSession.sparkContext.broadcast(_Sieve.of(prints.select("_h"), size, sieve_words))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sieve.value
        for b in batches:
            pages = read_pages(b.column("_t").to_pylist(), b.column("_b"), table=PLAIN)
            page, at, h = winnow_pages([fold(p) for p in pages], k, window)
            ok = known.holds(h)
            page, at, h = page[ok], at[ok].astype(np.int32), h[ok].view(np.int64)
            rows = np.unique(page)
            off = np.searchsorted(page, np.r_[rows, len(pages)]).astype(np.int32)
            hits = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(h), pa.array(at)], ["h", "p"]))
            yield pa.RecordBatch.from_arrays([b.column("_rid").take(pa.array(rows)), b.column("_id").take(pa.array(rows)), pa.array([pages[r] for r in rows], pa.string()), hits], ["_rid", "_id", "_page", "_hits"])

    box = F.transform(F.col(boxes), lambda b: F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), b["y1"].alias("y1"))) if boxes else F.expr("cast(null as array<struct<x0:int,y0:int,y1:int>>)")
    d = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(id).alias("_id"), F.col(text).alias("_t"), box.alias("_b"))
    pages = write_table(d.mapInArrow(read, f"_rid bigint, _id {kinds[0]}, _page string, _hits array<struct<h:bigint,p:int>>"))
    hits = pages.select("_rid", F.inline("_hits").alias("_h", "_p")).join(F.broadcast(prints) if size <= broadcast_grams else prints, "_h").select("_rid", "_pk", "_p", "_q")
    letters = tests.agg(F.sum(F.length("_passage"))).first()[0] or 0
    side = None
    if letters <= passages_mb << 20:
        side = docs.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in tests.collect()})
        hits = hits.withColumn("_passage", F.lit(None).cast("string"))
    else:
        hits = hits.join(tests, "_pk")
    # A page comes before its hits; pages without true hits pass by.
    both = pages.select("_rid", F.lit(None).cast("bigint").alias("_pk"), F.lit(-1).alias("_p"), F.lit(-1).alias("_q"), "_page", "_id", F.lit(None).cast("string").alias("_passage"))
    both = both.unionByName(hits.select("_rid", "_pk", "_p", "_q", F.lit(None).cast("string").alias("_page"), F.lit(None).cast(kinds[0]).alias("_id"), "_passage"))
    both = both.repartition("_rid").sortWithinPartitions("_rid", F.col("_pk").asc_nulls_first(), "_p", "_q")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = side.value if side else None
        rid = pk = page = doc = words = None
        held: list[tuple[int, int]] = []
        out: list[tuple] = []

        def close() -> None:
            if held:
                run = words.longest(page, held, k)
                if run >= min_words:
                    out.append((doc, pk, run, run / len(words.words)))
                held.clear()

        def frame() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], t) for n, t in enumerate((doc_type, pa.int64(), pa.int64(), pa.float64()))], ["_id", "_pk", "words", "share"])
            out.clear()
            return got

        doc_type = None
        for b in batches:
            doc_type = b.schema.field("_id").type
            is_page = np.asarray(b.column("_page").is_valid())
            rids, pks, ps, qs = (np.asarray(b.column(c).fill_null(0)) for c in ("_rid", "_pk", "_p", "_q"))
            new = np.flatnonzero(np.r_[True, (rids[1:] != rids[:-1]) | (pks[1:] != pks[:-1]) | is_page[1:] | is_page[:-1]][: len(rids)]).tolist()
            for n, end in zip(new, [*new[1:], len(rids)]):
                if is_page[n]:
                    close()
                    rid, pk, page, doc = rids[n], None, Page(b.column("_page")[n].as_py()), b.column("_id")[n].as_py()
                    continue
                if pk is None or pks[n] != pk or rids[n] != rid:
                    close()
                    pk = int(pks[n])
                    words = _passage(texts[pk] if texts is not None else b.column("_passage")[n].as_py())
                held += zip(ps[n:end].tolist(), qs[n:end].tolist())
            if out:
                yield frame()
        close()
        if out:
            yield frame()

    found = both.mapInArrow(extend, f"_id {kinds[0]}, _pk bigint, words bigint, share double")
    names = some.select("_pk", "_item").dropDuplicates()
    found = found.join(broadcast_if_small(names), "_pk")
    return found.select(F.col("_id").alias(id), F.col("_item").alias(item_id), "words", "share")
