"""Text functions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# English stop words and the words that company descriptions repeat.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()
FILLER_WORDS = "company formerly known changed name".split()
WORD = "[a-zà-ÿ0-9]+"


def words(text: Column, pattern: str = WORD) -> Column:
    """All words of the lower-cased text, in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def strip_punctuation(text: Column) -> Column:
    """A run of punctuation and the blanks behind it become one blank."""
    return F.regexp_replace(text, r"[,.;@#?!&$/()\-]+ *", " ")


def normalize(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower case, words only, without stop words, joined by blanks; null for null."""
    stop = F.array(*[F.lit(w) for w in (stop_words or STOP_WORDS + FILLER_WORDS)])
    return F.when(text.isNotNull(), F.concat_ws(" ", F.filter(words(text), lambda w: ~F.array_contains(stop, w))))


def concat_row(columns: list[str]) -> Column:
    """The columns as text, joined by blanks, trimmed; a null leaves an empty slot."""
    return F.trim(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def serialize(columns: list[str]) -> Column:
    """``COL name VAL value`` for every non-null column, joined by blanks."""
    return F.concat_ws(" ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"COL {c} VAL "), F.col(c).cast("string"))) for c in columns])


def json_text(payload: Column, title_key: str | None = None) -> tuple[Column, Column]:
    """(title, text) of a JSON object: the title key's value, and ``key: value`` of the others by key."""
    m = F.from_json(payload, "map<string,string>")
    rest = F.array_sort(F.filter(F.map_entries(m), lambda e: e["key"] != F.lit(title_key or "")))
    text = F.concat_ws(" ", F.transform(rest, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))))
    return F.element_at(m, F.lit(title_key or "")), text


def truncate_pair(a: Column, b: Column, most: int) -> tuple[Column, Column]:
    """Two token arrays cut to ``most`` together, the longer first, ties cutting ``b``."""
    na, nb = F.size(a), F.size(b)
    up, down = (most + 1) // 2, most // 2
    fits = na + nb <= most
    keep_a = F.when(fits, na).when((na > down) & (nb > down), F.least(na, F.greatest(F.lit(up), most - nb))).when(na > nb, most - nb).otherwise(na)
    keep_b = F.when(fits, nb).otherwise(most - keep_a)
    cut = lambda x, n: F.when(n > 0, F.slice(x, F.lit(1), n)).otherwise(F.array().cast("array<string>"))
    return cut(a, keep_a), cut(b, keep_b)


def build_sequence(a: Column, b: Column, length: int, cls: str = "[CLS]", sep: str = "[SEP]", pad: str = "[PAD]", pad_left: bool = False) -> Column:
    """``(tokens, segment_ids, mask)``: one padded pair sequence of fixed length."""
    x, y = truncate_pair(a, b, length - 3)
    one, two = F.concat(F.array(F.lit(cls)), x, F.array(F.lit(sep))), F.concat(y, F.array(F.lit(sep)))
    n1, n2 = F.size(one), F.size(two)
    gap = F.lit(length) - n1 - n2
    fill = lambda v, n: F.array_repeat(F.lit(v), n)
    pads, zeros = fill(pad, gap), fill(0, gap)
    tokens, segments, mask = F.concat(one, two), F.concat(fill(0, n1), fill(1, n2)), fill(1, n1 + n2)
    if pad_left:
        return F.struct(F.concat(pads, tokens).alias("tokens"), F.concat(zeros, segments).alias("segment_ids"), F.concat(zeros, mask).alias("mask"))
    return F.struct(F.concat(tokens, pads).alias("tokens"), F.concat(segments, zeros).alias("segment_ids"), F.concat(mask, zeros).alias("mask"))


def shuffled(tokens: Column, key: Column, seed: int) -> Column:
    """The tokens in an order fixed by the seed, the row's key and the place of each token."""
    marked = F.transform(tokens, lambda t, i: F.struct(F.md5(F.concat_ws("-", key.cast("string"), i.cast("string"), F.lit(str(seed)))).alias("h"), t.alias("t")))
    return F.transform(F.array_sort(marked), lambda s: s["t"])


def drop_span(tokens: Column, key: Column, seed: int, longest: int = 2) -> Column:
    """The tokens without one span of 1..longest tokens, its place fixed by the seed and the key; a single token stays."""
    h = F.conv(F.substring(F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    n = F.size(tokens)
    span = F.least(F.pmod(h, F.lit(longest)) + 1, n - 1).cast("int")
    at = F.pmod(F.floor(h / longest), F.greatest(n - span + 1, F.lit(1))).cast("int")
    return F.when(n <= 1, tokens).otherwise(F.filter(tokens, lambda _, i: (i < at) | (i >= at + span)))


def shuffle_span(tokens: Column, key: Column, seed: int, longest: int = 4) -> Column:
    """The tokens with one span of 2..longest of them put in another order, place and order fixed by the seed and the key."""
    h = F.conv(F.substring(F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    n = F.size(tokens)
    span = F.least(F.pmod(h, F.lit(longest - 1)) + 2, n).cast("int")
    at = F.pmod(F.floor(h / longest), F.greatest(n - span + 1, F.lit(1))).cast("int")
    head, tail = F.slice(tokens, F.lit(1), at), F.slice(tokens, at + span + 1, F.greatest(n - at - span, F.lit(0)))
    return F.when(n <= 1, tokens).otherwise(F.concat(head, shuffled(F.slice(tokens, at + 1, span), key, seed), tail))


def tf_idf_prune(df: DataFrame, id_col: str, text_col: str, share: float = 0.5) -> DataFrame:
    """``(id, text)``: every text without all occurrences of its less telling words.

    Kept are the ``floor(share x number of words)`` distinct words of highest tf x smooth idf (ties: the
    word earlier in the alphabet), in their order.  Null texts count as empty.  The corpus counts
    are over all texts; a word's weight needs one join, its order in the text is kept by position.
    """
    t = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pos = t.select("id", F.posexplode(words(F.col("text"))).alias("pos", "w"))
    per = pos.groupBy("id", "w").agg(F.count(F.lit(1)).alias("tf"))
    seen = per.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    n = t.agg(F.count(F.lit(1)).alias("n_docs"))
    size = pos.groupBy("id").agg(F.count(F.lit(1)).alias("n_words"))
    scored = per.join(seen, "w").join(size, "id").crossJoin(F.broadcast(n))  # n has one row
    weight = F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)
    w = Window.partitionBy("id").orderBy(F.desc(F.round(weight, 9)), "w")
    kept = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.floor(F.col("n_words") * share)).select("id", "w")
    left = pos.join(kept, ["id", "w"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("ws"))
    text = F.concat_ws(" ", F.transform("ws", lambda s: s["w"]))
    return t.select("id").join(left, "id", "left").select("id", F.coalesce(text, F.lit("")).alias("text"))
