"""Problem 7: the same or nearly the same records on both sides of a train/evaluation split.

Evaluation and training records are compared by the hashes of their word n-grams.  Copies of
one text are one class.  Training classes are scanned for hits of the rare n-grams that any pair above the
containment bound must share (prefix filter, exact), unless their words are seen to differ too much; each hit gets its
containment, the share of the evaluation record's n-grams that the training record holds, and is kept if the words agree, too.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.skew import sliced_join
from matchloom.session import Scratch

NGRAM = 3
#: Share of the larger record's n-grams that both must hold: one changed word in ten leaves about 0.7.
CONTAINMENT = 0.6
#: Share of the longer record's words that must agree.
AGREEMENT = 0.8
#: Against products that rounding lifts above a whole number.
SLACK = 1e-9
#: Prefix grams that one round joins, and the most rounds.
ROUND_GRAMS = 4_000_000
ROUNDS = 8


def plain_words(text: Column) -> Column:
    """Words of a text without regard to case, punctuation, spacing and escaped characters."""
    bare = F.regexp_replace(F.lower(text), "&(?:[a-z]+|#[0-9]+|#x[0-9a-f]+);", " ")
    return F.regexp_extract_all(bare, F.lit("[a-z0-9à-ÿ]+"), F.lit(0))


def without_shop(title: Column) -> Column:
    """A page title without the shop's name behind a final separator."""
    return F.regexp_replace(title, r"\s+[|@\-–—]+\s*[^\s|@]+\s*$", "")


def ngram_hashes(words: Column, n: int) -> Column:
    """Distinct 64-bit hashes of the word n-grams; a shorter text is one gram."""
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1))), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, n)))
    )
    return F.array_distinct(grams)


def text_classes(records: DataFrame, id_col: str, title_col: str, text_col: str) -> DataFrame:
    """``(id, class, words)``: one row per id; ids with the same words share the class (an md5).

    Of several rows of one id the smallest text is taken.  Records without any word in the text
    are left out: two empty records are not copies of each other.
    """
    one = (
        records.select(F.col(id_col).alias("id"), F.col(title_col).alias("title"), F.col(text_col).alias("text"))
        .where(F.col("id").isNotNull() & F.col("text").isNotNull())
        .groupBy("id")
        .agg(F.min(F.struct("text", "title")).alias("r"))
    )
    words = F.concat(plain_words(without_shop(F.coalesce("r.title", F.lit("")))), plain_words(F.col("r.text")))
    return (
        one.where(F.size(plain_words(F.col("r.text"))) > 0)
        .select("id", words.alias("words"))
        .select("id", F.md5(F.concat_ws(" ", "words")).alias("class"), "words")
    )


def numbered_words(classes: DataFrame, name: str = "tokens") -> DataFrame:
    """``(class, <name>)``: hashes of every word with its number among the same words of the record, so that sets of them overlap as bags of words do."""
    n = classes.select("class", F.explode("words").alias("w")).groupBy("class", "w").agg(F.count(F.lit(1)).cast("int").alias("n"))
    each = n.select("class", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.xxhash64("w", k))).alias("t"))
    return each.groupBy("class").agg(F.collect_list("t").alias(name))


class GramCounts:
    """About how many records of either side hold a gram: a byte per slot of its hash, 8 log2(1 + grams in the slot).  No more than 2 x 2^24 bytes, whatever the input."""

    CHUNK = 1 << 18

    def __init__(self, slots: int, chunks: dict[int, bytes]):
        self.slots, self.chunks, self.table = slots, chunks, None

    @classmethod
    def of(cls, sides: DataFrame, n: int, scratch: Scratch) -> GramCounts:
        """From ``(side, len, hashes)``; what is shuffled is the slots, packed."""
        total = sides.agg(F.sum(F.greatest(F.lit(1), F.col("len") - (n - 1)))).first()[0] or 0
        slots = 1 << min(24, max(12, int(total).bit_length()))
        size, chunks = cls.CHUNK, -(-2 * slots // cls.CHUNK)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                gram, row = _grams(*_lists(b.column("hashes")), n)
                spot = np.sort((gram & (slots - 1)) * 2 + b.column("side").to_numpy()[row])
                ends = np.searchsorted(spot, np.arange(chunks + 1) * size)
                held = [k for k in range(chunks) if ends[k] < ends[k + 1]]
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(held, pa.int32()), "at": pa.array([(spot[ends[k] : ends[k + 1]] - k * size).astype(np.uint32).tobytes() for k in held], pa.binary())})

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for k, at in zip(b.column("chunk").to_pylist(), b.column("at").to_pylist()):
                    held.setdefault(k, np.zeros(size, np.int64))
                    held[k] += np.bincount(np.frombuffer(at, np.uint32), minlength=size)
            codes = [zlib.compress(np.minimum(255, np.ceil(8 * np.log2(1 + x))).astype(np.uint8).tobytes(), 1) for x in held.values()]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(held.keys(), pa.int32()), "codes": pa.array(codes, pa.binary())})

        packed = sides.select("side", "hashes").mapInArrow(pack, "chunk int, at binary").repartition(chunks, "chunk")
        told = scratch.put("gram-counts", packed.mapInArrow(count, "chunk int, codes binary"))
        counts = cls(slots, {r["chunk"]: bytes(r["codes"]) for r in told.collect()})
        scratch.drop("gram-counts")
        return counts

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """The log of the pairs that the gram may bring, 0 if one side has none."""
        if self.table is None:
            none = bytes(self.CHUNK)
            held = [zlib.decompress(self.chunks[k]) if k in self.chunks else none for k in range(-(-2 * self.slots // self.CHUNK))]
            self.table = np.frombuffer(b"".join(held), np.uint8).astype(np.uint8)
        spot = (grams & (self.slots - 1)) * 2
        a, b = self.table[spot].astype(np.int16), self.table[spot + 1].astype(np.int16)
        return np.where((a > 0) & (b > 0), a + b, 0)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _grams(hashes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams, from those of the words, and the row of each; as :func:`ngram_hashes` a shorter text is one gram."""
    many, ends = np.maximum(1, sizes - (n - 1)), np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), many)
    first = (ends - sizes)[row] + np.arange(len(row)) - (np.cumsum(many) - many)[row]
    words, gram = np.append(hashes, 0).view(np.uint64), np.zeros(len(row), np.uint64)
    for j in range(n):
        gram = (gram ^ np.where(first + j < ends[row], words[np.minimum(first + j, len(hashes))], np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(32)
    return gram.view(np.int64), row


def _parity(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """128 bits a list in two numbers: each element turns one bit over."""
    bit, starts, out = np.left_shift(np.int64(1), hashes & 63), np.cumsum(sizes) - sizes, []
    for k in (0, 1):
        x = np.bitwise_xor.reduceat(np.append(np.where((hashes >> 6) & 1 == k, bit, 0), 0), starts)
        out.append(np.where(sizes > 0, x, 0))
    return out


def prefixes(sides: DataFrame, n: int, containment: float, scratch: Scratch) -> DataFrame:
    """A written table ``(class, side, len, n, s0, s1, grams, at)``: of the records ``(class, side, len, hashes of the words)`` the grams that a partner must share one of, with their places from the rarest on.

    ``s0`` and ``s1`` hold the parity of the words' hashes: of two records no more bits differ than words.
    """
    shared = sides.sparkSession.sparkContext.broadcast(GramCounts.of(sides, n, scratch))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words = _lists(b.column("hashes"))
            gram, row = _grams(*words, n)
            key = row * 1024 + shared.value.cost(gram)
            order = np.lexsort((gram, key))
            gram, key = gram[order], key[order]
            once = np.append(True, (gram[1:] != gram[:-1]) | (key[1:] != key[:-1]))
            gram, cost, row = gram[once], key[once] % 1024, row[once]  # row is in order and stays so
            held = np.bincount(row, minlength=b.num_rows)
            at = np.arange(len(gram)) - (np.cumsum(held) - held)[row] + 1
            keep = (at <= (held - np.ceil(held * containment - SLACK).astype(np.int64) + 1)[row]) & (cost > 0)
            left = np.bincount(row[keep], minlength=b.num_rows)
            some = pa.array(left > 0)
            offsets = pa.array(np.append(0, np.cumsum(left[left > 0])).astype(np.int32))
            parity = [pa.array(x).filter(some) for x in _parity(*words)]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (gram[keep], at[keep].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [b.column("class").filter(some), b.column("side").filter(some), b.column("len").filter(some), pa.array(held.astype(np.int32)).filter(some), *parity, *lists],
                names=["class", "side", "len", "n", "s0", "s1", "grams", "at"],
            )

    kind = sides.schema["class"].dataType.simpleString()
    kept = scratch.put("prefix", sides.mapInArrow(cut, f"class {kind}, side int, len int, n int, s0 long, s1 long, grams array<long>, at array<int>"))
    shared.destroy()
    return kept


def near_classes(a: DataFrame, b: DataFrame, n: int = NGRAM, containment: float = CONTAINMENT, agreement: float = AGREEMENT, scratch: Scratch | None = None) -> DataFrame:
    """``(class_a, class_b, containment, agreement)``: pairs of different classes of a and b (class, words) that nearly agree.

    ``containment`` is the share of a's n-grams in b.  Exact for pairs that share the bound's part of the larger n-gram set:
    grams are ordered by rarity in a and b together, and two sets with that overlap share a gram
    within their first (1 - bound) part.  The order may be any that both sides use, so rarity is taken from counts of hash
    slots.  Bounds by size, position and differing words cut candidates inside the join, so that what is written doesn't grow with
    the candidates; a gram of many classes is joined in slices, and the grams are joined in rounds, a part of them at a time.
    """
    scratch = scratch or Scratch(a.sparkSession, "split-overlap", lean=True)
    every = a.select("class", "words", F.lit(0).alias("side")).unionByName(b.select("class", "words", F.lit(1).alias("side"))).where(F.size("words") > 0)
    sides = every.select("class", "side", F.size("words").alias("len"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    kept = prefixes(sides, n, containment, scratch)
    rounds = min(ROUNDS, -(-(kept.agg(F.sum(F.size("grams"))).first()[0] or 1) // ROUND_GRAMS))
    need = F.ceil(F.greatest("n_a", "n_b") * containment - SLACK)
    # words that may differ: both lengths less twice what must agree
    may = F.col("len_a") + F.col("len_b") - 2 * F.ceil(F.greatest("len_a", "len_b") * agreement - SLACK)
    differ = F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))) + F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b")))

    def part(side: int, mark: str, k: int) -> DataFrame:
        x = kept.where(F.col("side") == side).select(*(F.col(c).alias(f"{c}_{mark}") for c in ("class", "len", "n", "s0", "s1")), F.explode(F.arrays_zip("grams", "at")).alias("x"))
        x = x.select("*", F.col("x.grams").alias("gram"), F.col("x.at").alias(f"at_{mark}")).drop("x")
        return x.where(F.pmod("gram", F.lit(rounds)) == k) if rounds > 1 else x

    parts = []
    for k in range(rounds):
        met = (
            sliced_join(part(0, "a", k), part(1, "b", k), ["gram"], "class_b", scratch=scratch)
            .where(F.col("class_a") != F.col("class_b"))
            .where(differ <= may)
            .where(F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + 1 >= need)
        )
        parts.append(scratch.put(f"pairs-{k}", met.select("class_a", "class_b").distinct()))
    scratch.drop("prefix")
    pairs = parts[0] if rounds == 1 else scratch.put("pairs", functools.reduce(DataFrame.unionByName, parts).distinct())
    if rounds > 1:
        for k in range(rounds):
            scratch.drop(f"pairs-{k}")
    paired = pairs.select(F.col("class_a").alias("class"), F.lit(0).alias("side")).unionByName(pairs.select(F.col("class_b").alias("class"), F.lit(1).alias("side"))).distinct()
    # one string takes half the room of an array in a shuffle
    joined = every.select("class", "side", F.concat_ws("\n", "words").alias("text")).join(paired, ["class", "side"], "left_semi")
    own = scratch.put("own", joined.select("class", "side", F.split("text", "\n").alias("words")))

    def grams(side: int, mark: str) -> DataFrame:
        return own.where(F.col("side") == side).select(F.col("class").alias(f"class_{mark}"), ngram_hashes(F.col("words"), n).alias(f"grams_{mark}"))

    both = pairs.join(grams(0, "a"), "class_a").join(grams(1, "b"), "class_b")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    held = both.select("class_a", "class_b", (shared / F.size("grams_a")).alias("containment"), (shared / F.greatest(F.size("grams_a"), F.size("grams_b"))).alias("_least"))
    # the words of the few pairs that hold enough of each other's n-grams
    close = scratch.put("close", held.where(F.col("_least") >= containment).drop("_least"))

    def bags(side: int, mark: str) -> DataFrame:
        some = own.where(F.col("side") == side).join(close.select(F.col(f"class_{mark}").alias("class")).distinct(), "class", "left_semi")
        return numbered_words(some, f"words_{mark}").withColumnRenamed("class", f"class_{mark}")

    worded = close.join(bags(0, "a"), "class_a").join(bags(1, "b"), "class_b")
    alike = F.size(F.array_intersect("words_a", "words_b")) / F.greatest(F.size("words_a"), F.size("words_b"))
    return worded.select("class_a", "class_b", "containment", alike.alias("agreement")).where(F.col("agreement") >= agreement)


def split_ids(pairs: DataFrame) -> DataFrame:
    """Distinct non-null ids of either end of a pair table."""
    return pairs.select(F.explode(F.array("lid", "rid")).alias("id")).where("id is not null").distinct()


def cross_split_overlaps(
    listings: DataFrame,
    train: DataFrame,
    evaluation: dict[str, DataFrame],
    id_col: str = "id",
    title_col: str = "page_title",
    text_col: str = "text",
) -> DataFrame:
    """``(split, eval_id, train_id, kind, containment)``: every evaluation record that also stands in training.

    ``train`` and the tables of ``evaluation`` are pair tables (lid, rid); ids are compared first
    (kind 'same id', also for ids without a listing), then texts ('same text' for equal words,
    'near text' otherwise).  ``containment`` is the share of the evaluation record's word n-grams in the training record.
    Only the listings that the tables name are read into words.  Null ids are ignored; empty tables give an empty result; extra
    columns are not read.
    """
    scratch = Scratch(listings.sparkSession, "cross-split", lean=True)
    trained = scratch.put("train", split_ids(train))
    wanted = None
    for name, pairs in evaluation.items():
        part = split_ids(pairs).withColumn("split", F.lit(name))
        wanted = part if wanted is None else wanted.unionByName(part)
    wanted = scratch.put("eval", wanted)
    named = trained.select("id", F.lit(1).alias("tr"), F.lit(0).alias("ev")).unionByName(wanted.select("id", F.lit(0).alias("tr"), F.lit(1).alias("ev")))
    named = scratch.put("named", named.groupBy("id").agg(F.max("tr").alias("tr"), F.max("ev").alias("ev")))
    own = listings.join(named.select(F.col("id").alias(id_col)), id_col, "left_semi")
    listed = scratch.put("listed", text_classes(own, id_col, title_col, text_col).select("id", F.unhex("class").alias("class"), F.concat_ws(" ", "words").alias("text")).join(named, "id"))
    # from here on a class goes by its smallest id, which takes less room than the md5
    texts = scratch.put("texts", listed.groupBy("class").agg(F.min("id").alias("rep"), F.first("text").alias("text"), F.max("tr").alias("tr"), F.max("ev").alias("ev")))
    members = scratch.put("members", listed.select("id", "class", "tr", "ev").join(texts.select("class", "rep"), "class").select("id", F.col("rep").alias("class"), "tr", "ev"))
    scratch.drop("listed")
    texts = texts.select(F.col("rep").alias("class"), F.split("text", " ").alias("words"), "tr", "ev")
    near = near_classes(texts.where("ev = 1"), texts.where("tr = 1"), scratch=scratch).select("class_a", "class_b", F.lit("near text").alias("kind"), "containment")
    same = texts.where("ev = 1 and tr = 1").select(
        F.col("class").alias("class_a"), F.col("class").alias("class_b"), F.lit("same text").alias("kind"), F.lit(1.0).alias("containment")
    )
    ev = wanted.join(members.where("ev = 1").select("id", "class"), "id").select("split", F.col("id").alias("eval_id"), F.col("class").alias("class_a"))
    found = scratch.put("found", near.unionByName(same).join(ev, "class_a").drop("class_a"))
    train_ids = scratch.put("train-ids", members.where("tr = 1").select(F.col("id").alias("train_id"), F.col("class").alias("class_b")))
    for name in ("named", "texts", "members", "pairs", "pairs-0", "own", "close"):
        scratch.drop(name)
    # copies of one listing may hold a large part of either side
    by_text = sliced_join(found, train_ids, ["class_b"], "train_id", scratch=scratch).where(F.col("eval_id") != F.col("train_id"))
    by_id = wanted.join(trained, "id", "left_semi").select("split", F.col("id").alias("eval_id"), F.col("id").alias("train_id"), F.lit("same id").alias("kind"), F.lit(1.0).alias("containment"))
    return by_id.unionByName(by_text.select("split", "eval_id", "train_id", "kind", "containment"))


def overlap_pairs(overlaps: DataFrame) -> DataFrame:
    """Distinct ``(split, lid, rid)`` with the smaller id first."""
    return overlaps.select("split", F.least("eval_id", "train_id").alias("lid"), F.greatest("eval_id", "train_id").alias("rid")).distinct()


def overlap_report(overlaps: DataFrame, listings: DataFrame, id_col: str = "id", spec_col: str = "spec_id") -> DataFrame:
    """``(split, site, kind, n_pairs, n_eval)``: overlaps per split and site of the evaluation record."""
    site = listings.select(F.col(id_col).alias("eval_id"), F.split(F.col(spec_col), "//")[0].alias("site")).groupBy("eval_id").agg(F.min("site").alias("site"))
    return (
        overlaps.join(site, "eval_id", "left")
        .groupBy("split", "site", "kind")
        .agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("eval_id").alias("n_eval"))
    )
