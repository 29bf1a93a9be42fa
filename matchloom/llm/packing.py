"""Problem 8: filling fixed-capacity containers with items of varying length.

The plan needs only the histogram of lengths (at most ``capacity`` entries), so it is made on
the driver at any data size: shallow combinations of up to three lengths that fill a window
below the capacity, repeat counts by non-negative least squares against the histogram, rounded
down, and the rest packed greedily into the tightest space.  Placing the items is distributed:
an item finds its container from its length and its rank among the items of that length.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.skew import spread_rank
from matchloom.session import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public byte-level BPE word pattern that belongs to the vocabulary above.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def load_tokenizer(path: str, pattern: str = PATTERN):
    """A byte-level BPE encoder from a rank file; one per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_sizes(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, size)``: tokens of each whole text; null and empty texts have size 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = load_tokenizer(tokenizer)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "size": np.array(sizes, dtype=np.int64)})

    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(count, "id long, size long")


def nnls(a: np.ndarray, b: np.ndarray, max_steps: int = 400) -> np.ndarray:
    """Non-negative x minimising |a x - b| by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(max_steps):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        free[j] = True
        while True:
            idx = np.flatnonzero(free)
            s, *_ = np.linalg.lstsq(a[:, idx], b, rcond=None)
            if s.min(initial=1.0) > 0:
                x[:] = 0
                x[idx] = s
                break
            bad = s <= 0
            ratio = x[idx][bad] / np.maximum(x[idx][bad] - s[bad], 1e-300)
            step = float(ratio.min())
            x[idx] += step * (s - x[idx])
            drop = idx[x[idx] <= 1e-12]
            x[drop] = 0
            free[drop] = False
            if not free.any():
                break
    return x


def combinations(bins: int, window: int, present: list[int]) -> list[tuple[int, ...]]:
    """Combinations of one to three present lengths (descending) whose sum lies within ``window`` of ``bins``."""
    there, out = set(present), []
    for i in present:
        if bins - window <= i <= bins:
            out.append((i,))
        for j in present:
            if j > i or i + j > bins:
                continue
            if i + j >= bins - window:
                out.append((i, j))
            out += [(i, j, k) for k in range(max(1, bins - window - i - j), min(j, bins - i - j) + 1) if k in there]
    return out


class _Runs:
    """Items of one length bin as runs (exact length, count), longest first."""

    def __init__(self) -> None:
        self.runs: list[list[int]] = []

    def take(self, n: int) -> tuple[int, int]:
        run = self.runs[0]
        m = min(n, run[1])
        run[1] -= m
        if not run[1]:
            self.runs.pop(0)
        return run[0], m


def plan(hist: dict[int, int], capacity: int, grain: int = 16, window: int = 2) -> list[tuple[dict[int, int], int]]:
    """Groups ``({length: items per container}, containers)`` that hold every item of the histogram.

    ``hist`` maps lengths 1..capacity to counts.  Lengths are rounded up to ``grain`` for the
    combinations only; spaces are exact in the greedy rest.
    """
    left = {n: c for n, c in hist.items() if c > 0}
    bins = capacity // grain
    groups: list[tuple[dict[int, int], int]] = []
    by_bin: dict[int, _Runs] = defaultdict(_Runs)
    for n in sorted(left, reverse=True):
        b = -(-n // grain)
        if b <= bins:
            by_bin[b].runs.append([n, left[n]])
    present = sorted(by_bin, reverse=True)
    combos = combinations(bins, window, present)
    if combos:
        row = {b: i for i, b in enumerate(present)}
        a = np.zeros((len(present), len(combos)))
        for c, combo in enumerate(combos):
            for b in combo:
                a[row[b], c] += 1
        counts = np.array([sum(r[1] for r in by_bin[b].runs) for b in present], dtype=float)
        weight = np.where(np.array(present) <= max(1, bins // 16), 0.1, 1.0)  # short items fill gaps later
        repeats = np.floor(nnls(a * weight[:, None], counts * weight) + 1e-9).astype(np.int64)
        stock = {b: int(c) for b, c in zip(present, counts)}
        for c in np.argsort(-repeats, kind="stable"):
            need = defaultdict(int)
            for b in combos[c]:
                need[b] += 1
            n = min([int(repeats[c]), *(stock[b] // k for b, k in need.items())])
            if n <= 0:
                continue
            for b, k in need.items():
                stock[b] -= n * k
            groups += _realise(by_bin, combos[c], n)
        for pattern, n in groups:
            for length, k in pattern.items():
                left[length] -= n * k
    return _best_fit(groups, left, capacity)


def _realise(by_bin: dict[int, _Runs], combo: tuple[int, ...], n: int) -> list[tuple[dict[int, int], int]]:
    """n containers of one combination, with the exact lengths that the bins hold."""
    made: list[tuple[tuple[int, ...], int]] = [((), n)]
    for b in combo:
        longer: list[tuple[tuple[int, ...], int]] = []
        for lengths, m in made:
            while m:
                length, k = by_bin[b].take(m)
                longer.append(((*lengths, length), k))
                m -= k
        made = longer
    out = []
    for lengths, m in made:
        pattern: dict[int, int] = defaultdict(int)
        for length in lengths:
            pattern[length] += 1
        out.append((dict(pattern), m))
    return out


def _best_fit(groups: list[tuple[dict[int, int], int]], left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Longest item first into the tightest open space; whole runs of equal items at once."""
    spaces: list[int] = []
    at: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    done: list[tuple[dict[int, int], int]] = []

    def open_(pattern: dict[int, int], n: int) -> None:
        space = capacity - sum(k * v for k, v in pattern.items())
        if space == 0:
            done.append((pattern, n))
            return
        if not at[space]:
            insort(spaces, space)
        at[space].append((pattern, n))

    for g in groups:
        open_(*g)
    for length in sorted(left, reverse=True):
        c = left[length]
        while c > 0:
            i = bisect_left(spaces, length)
            if i == len(spaces):
                fit = capacity // length
                if c >= fit:
                    open_({length: fit}, c // fit)
                if c % fit:
                    open_({length: c % fit}, 1)
                break
            space = spaces[i]
            pattern, n = at[space].pop()
            if not at[space]:
                spaces.pop(i)
            fit = space // length
            use = min(n, c // fit)
            if use:
                open_(pattern | {length: pattern.get(length, 0) + fit}, use)
                c -= use * fit
                n -= use
            if n and c:  # fewer than fit are left: one container takes them
                open_(pattern | {length: pattern.get(length, 0) + c}, 1)
                n, c = n - 1, 0
            if n:
                open_(pattern, n)
    for space in spaces:
        done += at[space]
    return done


def pack(sizes: DataFrame, capacity: int = 2048, grain: int = 16, window: int = 2) -> DataFrame:
    """``(id, piece, start, size, container_id)``: every item of ``sizes`` (id, size) in a container.

    An item longer than the capacity is cut into full pieces and a rest (``piece`` from 0,
    ``start`` = its first token); no other item is divided.  Items of size 0 or with a null
    size are spread over the containers; if there is no other item they share container 0.
    Repeated ids are items of their own.  Empty input gives an empty result.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "packing")
    # coalesce: a null size is an item without content
    s = scratch.put("sizes", sizes.select(F.col("id"), F.coalesce("size", F.lit(0)).cast("long").alias("n")))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    pieces = s.select("id", "n", F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece")).select(
        "id",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity).alias("size"),
    )
    hist = {r["size"]: r["c"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("c")).collect()}  # <= capacity + 1 rows
    zeros, items = hist.pop(0, 0), sum(hist.values())
    groups = plan(hist, capacity, grain, window)
    containers = max(1, sum(n for _, n in groups))
    runs, taken, first = [], defaultdict(int), 0
    for pattern, n in groups:
        for length, k in pattern.items():
            runs.append((length, taken[length] + 1, taken[length] + n * k, first, k))
            taken[length] += n * k
        first += n
    if zeros:
        each = -(-zeros // containers)
        runs.append((0, 1, zeros, 0, each))
    table = spark.createDataFrame(runs, "run_size long, r_first long, r_last long, c_first long, per long")
    salts = max(8, (items + zeros) // 500_000)
    ranked = spread_rank(pieces, ["size"], [F.col("id"), F.col("piece")], "rank", F.struct("id", "piece"), int(salts))
    # the plan has a few entries per distinct length, at any number of items
    hit = (F.col("size") == F.col("run_size")) & F.col("rank").between(F.col("r_first"), F.col("r_last"))
    placed = ranked.join(F.broadcast(table), hit)
    at = F.col("c_first") + F.floor((F.col("rank") - F.col("r_first")) / F.col("per"))
    return placed.select("id", "piece", "start", "size", at.cast("long").alias("container_id"))


def pack_texts(
    texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str = TOKENIZER
) -> DataFrame:
    """:func:`pack` over the token counts of the texts under the given tokenizer file."""
    return pack(token_sizes(texts, id_col, text_col, tokenizer), capacity)
