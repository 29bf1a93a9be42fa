"""Problem 9: evaluation texts leaking into training text.

Every item is cut into windows as long as the shortest passage that counts; windows of the
documents get a SimHash over their words, and a multi-index over Hamming blocks finds every
item window whose fingerprint lies within the radius.  Candidates are verified by the weighted
share of the item's shingles (pairs of successive words) that the passage holds, aligned with at most
one word in eight changed, added or left out; rare words weigh more.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import Scratch

WINDOW = 15
RADIUS = 13
#: Blocks of the fingerprint; one of them differs in at most RADIUS // BLOCKS bits between any two fingerprints within the radius.
BLOCKS = 5
#: One word in eight may differ: of 15 words one.
DIFFER = 1 / 8
#: Weighted share of the shingles; one changed word spoils two of 14, and these may weigh more than others.
SIMILARITY = 0.6
#: Items of one index, the only ones that the driver and the tasks ever hold at a time; larger sets are searched block by block.
ITEMS_PER_INDEX = 20_000

_INLINE = re.compile(r"</?(?:b|i|em|strong|u|span|a|sup|sub|mark)(?:\s[^<>]{0,200})?>", re.I)
_TAG = re.compile(r"<[^<>]{0,200}>")
_BREAK = re.compile(r"(?<=[^\W\d_])(?:-[ \t]*\n[\s>]*|\u00ad\s*)(?=[^\W\d_])")
_WORD = re.compile(r"[a-z0-9à-ÿ]+")


def words_of(text: str | None) -> list[str]:
    """Words without regard to case, punctuation, spacing, line breaks and markup; words cut at a line end are joined."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "-" in text or "\u00ad" in text:
        text = _BREAK.sub("", text)
    return _WORD.findall(text.lower())


def word_bits(word: str) -> np.ndarray:
    """64 votes of +1 or -1, from a hash of the word."""
    h = np.frombuffer(hashlib.blake2b(word.encode(), digest_size=8).digest(), dtype=np.uint8)
    return np.unpackbits(h).astype(np.int8) * 2 - 1


def simhashes(votes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints (uint64) of the windows at ``starts``; votes: words x 64.  A tied bit takes the first word's vote."""
    total = np.concatenate([np.zeros((1, 64), dtype=np.int32), votes.cumsum(axis=0, dtype=np.int32)])
    s = total[starts + width] - total[starts]
    up = np.where(s == 0, votes[starts] > 0, s > 0)
    return np.packbits(up, axis=1).view(np.uint64).ravel()


class HammingIndex:
    """All fingerprints within a radius: of BLOCKS blocks of bits one must be equal but for radius // BLOCKS bits, so all keys that near are looked up."""

    def __init__(self, prints: np.ndarray, radius: int, blocks: int = BLOCKS):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, blocks + 1).astype(int)
        self.blocks = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            key = self._key(prints, lo, hi)
            order = np.argsort(key, kind="stable")
            starts = np.searchsorted(key[order], np.arange((1 << (hi - lo)) + 1))
            every = np.arange(1 << (hi - lo))
            flips = every[np.bitwise_count(every) <= radius // blocks]
            self.blocks.append((lo, hi, order.astype(np.int32), starts, flips))

    @staticmethod
    def _key(prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return ((prints >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query position, fingerprint position) of every pair within the radius; pairs may repeat."""
        qs, fs = [], []
        for lo, hi, order, starts, flips in self.blocks:
            key = (self._key(prints, lo, hi)[:, None] ^ flips).ravel()
            n = starts[key + 1] - starts[key]
            some = np.flatnonzero(n)
            n, first = n[some], starts[key[some]]
            q = np.repeat(some // len(flips), n)
            at = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(first, n)
            f = order[at]
            close = np.bitwise_count(prints[q] ^ self.prints[f]) <= self.radius
            qs.append(q[close])
            fs.append(f[close])
        return np.concatenate(qs), np.concatenate(fs)


def aligned(passage: np.ndarray, item: np.ndarray, differ: int) -> tuple[np.ndarray, np.ndarray]:
    """How item windows (rows of ``item``) stand in passages that have one word more on either side.

    Returns whether a row agrees but for ``differ`` changed words, or for one word more or less if ``differ``
    allows one, and which shingles (words k and k + 1 of the window) the passage holds.
    """
    width = item.shape[1]
    same = passage[:, 1 : width + 1] == item
    ok, held = (~same).sum(axis=1) <= differ, same[:, 1:] & same[:, :-1]
    if differ:
        lead = np.where(same.all(axis=1), width, same.argmin(axis=1))
        for shift, missing in ((2, 0), (0, 1)):
            moved = passage[:, shift : shift + width] == item
            tail = np.where(moved.all(axis=1), width, moved[:, ::-1].argmin(axis=1))
            # words before the place stand where they should, those behind it one place off
            fits = ~ok & (lead + tail >= width - missing)
            if fits.any():
                k = np.arange(width - 1)
                cut = np.minimum(lead[fits], width - missing)[:, None]
                held[fits] = (k < cut - 1) | (k >= cut + missing)
                ok |= fits
    return ok, held


class ItemIndex:
    """Windows of the items, their fingerprints and the weights of their words."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int, radius: int, similarity: float):
        self.window, self.similarity = window, similarity
        n_items = max(1, len(items))
        df: dict[str, int] = {}
        for _, ws in items:
            for w in set(ws):
                df[w] = df.get(w, 0) + 1
        self.vocab = {w: i for i, w in enumerate(sorted(df))}
        self.weight = np.array([1.0 + math.log(n_items / df[w]) for w in sorted(df)] + [1.0 + math.log(n_items)])
        self.votes = np.array([word_bits(w) for w in sorted(df)], dtype=np.int8).reshape(-1, 64)
        self.by_width: dict[int, tuple] = {}
        widths = {min(window, len(ws)) for _, ws in items if ws}
        for width in widths:
            ids, rows, prints = [], [], []
            for item, ws in items:
                if not ws or min(window, len(ws)) != width:
                    continue
                code = np.array([self.vocab[w] for w in ws])
                starts = np.arange(len(code) - width + 1)
                prints.append(simhashes(self.votes[code], starts, width))
                rows.append(code[starts[:, None] + np.arange(width)])
                ids.append(np.full(len(starts), item, dtype=np.int64))
            self.by_width[width] = (np.concatenate(ids), np.concatenate(rows), HammingIndex(np.concatenate(prints), radius))

    def found(self, words: list[str]) -> np.ndarray:
        """Ids of the items of which the words hold a passage."""
        out: list[np.ndarray] = []
        code = np.fromiter((self.vocab.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        known = np.concatenate([[0], (code >= 0).cumsum()])
        padded = np.concatenate([[-2], code, [-2]])
        for width, (ids, rows, index) in self.by_width.items():
            if len(words) < width:
                continue
            differ = int(width * DIFFER)
            # a window with more unknown words than may differ can't agree with any item
            starts = np.flatnonzero(known[width:] - known[:-width] >= width - differ)
            for part in np.array_split(starts, max(1, len(starts) // 256 + 1)):
                if not len(part):
                    continue
                lo, hi = part[0], part[-1] + width
                votes = np.array([self.votes[c] if c >= 0 else word_bits(w) for c, w in zip(code[lo:hi], words[lo:hi])], dtype=np.int8)
                q, f = index.near(simhashes(votes, part - lo, width))
                if not len(q):
                    continue
                q, f = np.divmod(np.unique(q.astype(np.int64) * len(rows) + f), len(rows))
                theirs = rows[f]
                ok, held = aligned(padded[part[q][:, None] + np.arange(width + 2)], theirs, differ)
                w = self.weight[theirs]
                w = w[:, 1:] + w[:, :-1]
                good = ok & ((w * held).sum(axis=1) >= self.similarity * w.sum(axis=1)) if width > 1 else ok
                if good.any():
                    out.append(ids[f[good]])
        return np.unique(np.concatenate(out)) if out else np.empty(0, dtype=np.int64)


def without_instructions(items: DataFrame) -> DataFrame:
    """``(item, text)`` without the standing instruction, i.e. a first sentence that several items share."""
    cut = F.instr("text", ". ")
    head = F.when(cut > 0, F.lower(F.substring("text", F.lit(1), cut - 1)))
    own = items.withColumns({"head": head, "rest": F.when(cut > 0, F.substring("text", cut + 2, F.length("text")))})
    shared = own.where("head is not null").groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head", F.lit(True).alias("shared"))
    return own.join(shared, "head", "left").select("item", F.when(F.col("shared") & (F.col("rest") != ""), F.col("rest")).otherwise(F.col("text")).alias("text"))


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    radius: int = RADIUS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``(doc_id, item_id)``: documents holding a whole item or ``window`` successive words of it.

    One word in eight of a passage may be changed, or one word be added or left out.  Items shorter than the window are searched as a
    whole; items without a word, and null or empty texts, give no row; repeated items or
    documents give one row.  Items are counted and taken in blocks of at most about ITEMS_PER_INDEX, each
    sent to the tasks once; the documents are read whole and never shuffled before the hits.  For more
    than one block their words are written once, so that no text is cut into words again.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    listed = items.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).where("item is not null").distinct()
    listed = scratch.put("items", without_instructions(listed))
    blocks = max(1, -(-listed.count() // ITEMS_PER_INDEX))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and doc_id is not null")
    if blocks > 1:
        docs = scratch.put("words", docs.mapInPandas(lambda bs: (pd.DataFrame({"doc_id": b["doc_id"], "text": [words_of(t) for t in b["text"]]}) for b in bs), "doc_id long, text array<string>"))
    found = spark.createDataFrame([], "doc_id long, item_id long")
    for at in range(blocks):
        own = listed.where(F.pmod(F.xxhash64("item", F.lit(5)), F.lit(blocks)) == at).toPandas()
        index = spark.sparkContext.broadcast(ItemIndex(sorted((int(i), words_of(t)) for i, t in zip(own["item"], own["text"])), window, radius, similarity))

        def scan(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            ix = index.value
            for b in batches:
                docs_, items_ = [], []
                for d, t in zip(b["doc_id"], b["text"]):
                    hit = ix.found(words_of(t) if isinstance(t, str) else list(t))
                    docs_ += [d] * len(hit)
                    items_ += hit.tolist()
                yield pd.DataFrame({"doc_id": np.array(docs_, dtype=np.int64), "item_id": np.array(items_, dtype=np.int64)})

        part = docs.mapInPandas(scan, "doc_id long, item_id long")
        found = part if at == 0 else found.unionByName(part)
    return found.distinct()


def leak_report(leaks: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, task, n_docs, n_sources)``: the test items that leaked and where."""
    src = documents.select("doc_id", "source")
    return (
        leaks.join(src, "doc_id", "left")
        .groupBy("item_id")
        .agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("source").alias("n_sources"))
        .join(items.select("item_id", "task"), "item_id", "left")
        .select("item_id", "task", "n_docs", "n_sources")
    )
