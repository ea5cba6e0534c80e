"""Documents packed into containers of fixed capacity."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table

#: Where the public vocabulary lies; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, n_tokens) of every document; null and empty texts have 0. Whole texts are encoded."""

    def run(batches):
        enc = _encoding(vocabulary, pattern)
        for pdf in batches:
            yield pd.DataFrame({id: pdf[id], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf[text]]})

    return docs.select(id, text).mapInPandas(run, f"`{id}` {dict(docs.dtypes)[id]}, n_tokens bigint")


class Tournament:
    """Leftmost container with room for a size: a complete tree whose nodes hold the most room below them."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, most):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        here = at - self.leaves
        at //= 2
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
            at //= 2
        return here


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container numbers of items, largest first into the first container with room; equal sizes in the given order. Sizes are 1..capacity."""
    t = Tournament(len(sizes), capacity)
    out = np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        out[i] = t.place(int(sizes[i]))
    return out


def pack(items: DataFrame, id: str = "doc_id", size: str = "n_tokens", capacity: int = 2048, group_rows: int = 50_000, seed: int = 7) -> DataFrame:
    """One row per piece: id, piece (0, 1, ...), ``start`` and ``tokens`` of the piece, ``container``.

    An item over ``capacity`` fills whole containers and its remainder is one
    more item; no other item is split. Items of size 0 or null take no room:
    they come out once with container null and 0 tokens. Repeated rows are
    separate items, told apart by nothing but their number; null ids are ids
    like others. An empty table gives no rows.

    First-fit decreasing runs in randomised groups of about ``group_rows``
    items (a hash of ``seed``, the id and the row's number), whose number
    follows from the count of all items; a group travels as (id, size) only.
    The sizes are written once, so that no text is sized twice.
    """
    kind = dict(items.dtypes)[id]
    # Written once: counting the rows and packing them would otherwise size every text twice.
    d = write_table(items.select(F.col(id).alias("_id"), F.coalesce(F.col(size).cast("bigint"), F.lit(0).cast("bigint")).alias("_size"), F.monotonically_increasing_id().alias("_row")))
    groups = max(1, -(-d.count() // group_rows))
    # The row's number joins the id, so that repeats of one id, and null ids, spread over all groups.
    d = d.withColumn("_g", F.pmod(F.xxhash64(F.lit(seed), F.col("_id").cast("string"), F.col("_row")), F.lit(groups)).cast("bigint"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", "_size", "_row"], ignore_index=True)
        total = pdf["_size"].to_numpy().clip(min=0)
        full, rest = total // capacity, total % capacity
        pieces = np.maximum(full + (rest > 0), 1)
        row = np.repeat(np.arange(len(pdf)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        tokens = np.minimum(capacity, total[row] - start)
        bins = np.full(len(row), -1, np.int64)
        some = tokens > 0
        bins[some] = first_fit_decreasing(tokens[some], capacity)
        g = int(pdf["_g"].iloc[0])
        return pd.DataFrame({"_id": pdf["_id"].to_numpy()[row], "piece": piece, "start": start, "tokens": tokens, "container": pd.array(np.where(bins < 0, 0, (g << 32) + bins), dtype="Int64").copy()}).assign(container=lambda x: x["container"].mask(bins < 0))

    return d.groupBy("_g").applyInPandas(run, f"_id {kind}, piece bigint, start bigint, tokens bigint, container bigint").withColumnRenamed("_id", id)
