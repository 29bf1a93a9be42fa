"""Problem 10: template residue and error-page text.

A positive-unlabelled naive Bayes over passages (sentences and lines).  Trusted positives are
passages with an unfilled field, public wordings of messages and filler, and passages of short
records made of such wordings; trusted negatives are sentences that quote such things.  Everything
else is unlabelled and gets its label by expectation-maximization over the counted passages of all
records.  The fitted model scores every passage of every record; a record is residue if one of
its passages is.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import Scratch

#: A record of at most this many characters that is made of known wordings is trusted.
TRUSTED_CHARS = 260
#: Share of a passage's word pairs that a known wording must cover for that.
COVERED = 0.5
#: Log-odds from which a passage without a field is residue: a posterior of 0.92 at half weight (see TEMPER); with a field even odds do.
THRESHOLD = 5.0
#: A short untrusted line standing alone in this share of the records (five at least) is page furniture.
FURNITURE = 0.003
#: Rounds end when no posterior sum of a class moves by more than this share; a bound on the rounds ends a slow drift.
TOLERANCE = 0.01
MAX_ROUNDS = 25
#: Weight of an unlabelled passage's posterior against a trusted label, so that the trusted ones keep the say.
UNLABELLED = 0.15
#: One in so many trusted positives is a spy among the unlabelled; unlabelled passages below all but this share of them are negative.
SPY = 5
SPY_LOSS = 0.05
#: Features are counted in 2^HASH_BITS cells; none is left out, and the model has the same size at any number of records.
HASH_BITS = 20
#: Observations of either class, at the classes' overall ratio, that every feature starts with.
SMOOTH = 5.0
#: Words and word pairs overlap, so their log-odds are counted at half weight in the posterior.
TEMPER = 2.0

# Wordings of public software and sites. Status lines and default pages of web servers and proxies.
SERVER_PAGES = [
    "400 bad request",
    "401 unauthorized",
    "403 forbidden",
    "you don't have permission to access this resource",
    "access denied",
    "access to this resource on the server is denied",
    "404 not found",
    "the requested url was not found on this server",
    "the page you requested was not found",
    "page not found",
    "the page you are looking for does not exist",
    "no such file or directory",
    "405 method not allowed",
    "408 request timeout",
    "410 gone",
    "429 too many requests",
    "500 internal server error",
    "internal server error",
    "the server encountered an internal error and was unable to complete your request",
    "please contact the server administrator",
    "http error 500",
    "error code 500",
    "502 bad gateway",
    "the proxy server received an invalid response from an upstream server",
    "503 service unavailable",
    "503 service temporarily unavailable",
    "the server is temporarily unable to service your request",
    "504 gateway timeout",
    "the server took too long to respond",
    "please try again later",
    "try again in a few minutes",
    "an unexpected error occurred",
    "an error occurred while processing your request",
    "something went wrong",
    "oops something went wrong",
    "whoops, looks like something went wrong",
    "oops! that page can't be found",
    "sorry, this page isn't available",
    "the link you followed may be broken, or the page may have been removed",
    "this content is not available in your country",
    "this account has been suspended",
    "this item is no longer available",
    "your request has been blocked",
    "invalid token",
    "go back to the home page",
    "check the url and try again",
    "there has been a critical error on this website",
    "error establishing a database connection",
    "database connection failed",
    "briefly unavailable for scheduled maintenance. check back in a minute",
    "we'll be back soon",
    "fatal error: uncaught error: call to a member function on null",
    "warning: undefined variable on line 12",
    "traceback (most recent call last)",
    "keyerror",
    "exception: template not found",
    "seite nicht gefunden",
    "fehler 404: die seite wurde nicht gefunden",
    "zugriff verweigert",
    "fehlercode 404",
    "ein fehler ist aufgetreten",
    "page introuvable",
    "erreur 404: la page demandée n'existe pas",
    "accès refusé",
    "une erreur est survenue",
    "página no encontrada",
    "error 404: la página solicitada no existe",
    "acceso denegado",
    "ha ocurrido un error",
]
# Notices that scripts are needed, of application starters, browsers and site protection.
SCRIPT_NOTICES = [
    "you need to enable javascript to run this app",
    "please enable javascript to continue using this application",
    "we're sorry but this app doesn't work properly without javascript enabled. please enable it to continue",
    "javascript is not available. we've detected that javascript is disabled in this browser",
    "javascript is disabled in your browser",
    "javascript is required",
    "javascript is turned off",
    "your browser does not support javascript",
    "your browser is not supported. please update your browser",
    "this page requires a browser that supports javascript",
    "this site requires javascript and cookies",
    "enable javascript and cookies to continue",
    "please enable cookies and reload the page",
    "please enable javascript to view this page",
    "turn on javascript in your browser settings and reload the page",
    "scripts are blocked. allow scripts",
    "scripting is disabled",
    "this app works best with javascript enabled",
    "please disable your ad blocker",
    "noscript",
    "this page cannot be displayed without javascript",
    "checking your browser before accessing the site",
    "please verify that you are a human",
    "bitte aktivieren sie javascript in ihrem browser",
    "diese seite benötigt javascript",
    "veuillez activer javascript dans votre navigateur",
    "activez javascript pour afficher cette page",
    "active javascript en su navegador",
    "por favor, active javascript para ver el contenido",
]
# Default texts of page builders, office templates and typesetting.
FILLER = [
    "lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. "
    "ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. "
    "duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. "
    "excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "lorem ipsum dolor sit amet",
    "lorem ipsum",
    "your text here",
    "your text goes here",
    "your content goes here. edit or remove this text",
    "your title here",
    "your description here",
    "description goes here",
    "insert text here",
    "insert your text here",
    "add text here",
    "add your heading text here",
    "add a headline",
    "enter text here",
    "enter your text",
    "enter a description",
    "type here",
    "type your text here",
    "write your text here",
    "write something",
    "put your text here",
    "write an introduction",
    "click to add text",
    "click here to add your own text",
    "this is a paragraph. click here to add your own text and edit me",
    "replace this text with your own content",
    "replace this with your text",
    "this is dummy text",
    "this is placeholder text",
    "this is a sample paragraph",
    "sample text",
    "asdf asdf",
    "qwerty",
    "hier steht ihr text",
    "text hier einfügen",
    "dies ist ein blindtext",
    "votre texte ici",
    "saisissez votre texte ici",
    "cliquez pour ajouter du texte",
    "su texto aquí",
    "escriba aquí su texto",
]
SEEDS = SERVER_PAGES + SCRIPT_NOTICES + FILLER
# Shapes of unfilled template fields.
FIELD_SHAPES = [
    ("brace2", r"\{\{\s*[^{}]{1,60}\}\}"),
    ("bracepct", r"\{%\s*[^{}%]{1,60}%\}"),
    ("pctangle", r"<%=?\s*[^<>%]{1,60}%>"),
    ("dollar", r"\$\{[^{}]{1,60}\}|\$\([\w .]{1,40}\)"),
    ("brack2", r"\[\[[^\[\]]{1,60}\]\]"),
    ("prompt", r"[\[<{(](?:your|insert|enter|add|type|put|choose|select|fill|tbd|todo)\b[^\[\]<>{}()]{0,60}[\]>})]"),
    ("pct2", r"%%[\w .]{1,40}%%|%[a-z_]{2,40}%"),
    ("at2", r"@@[\w .]{1,40}@@"),
    ("star", r"\*\|[\w .]{1,40}\|\*"),
    ("under2", r"\b__[a-z][\w]{0,40}?__(?![a-z0-9])"),
    ("tilde", r"~[a-z_]{2,40}~"),
    ("hash2", r"##?[a-z_]{2,40}##?"),
    ("brace1", r"(?<![{$])\{[a-z_][\w .|]{0,40}\}(?!\})"),
    ("todo", r"\btodo_\w+|\btodo:|\bxxxx+\b|\bfixme\b"),
    ("object", r"\[object object\]|\bundefined\b"),
    (
        "angle",
        r"<(?!/?(?:a|abbr|b|body|br|button|code|dd|div|dl|dt|em|form|h\d|head|hr|html|i|img|input|li|link|meta|ol|option|p|pre|script|section|select|small|span|strong|style|sub|sup|table|tbody|td|th|thead|tr|u|ul)\b)[a-z_][\w. ]{1,30}>",
    ),
]
_SHAPES = [(name, re.compile(rx)) for name, rx in FIELD_SHAPES]
_ANY_FIELD = re.compile("|".join(f"(?:{rx})" for _, rx in FIELD_SHAPES))
#: What any field has; most texts have none of it.
_FIELD_HINT = re.compile(r"[{\[<%$@*_~#(]|undefined|todo|xxxx|fixme", re.I)
# Words by which English speaks about a piece of text instead of using it.
META = set(
    "character characters code codes error example examples expression field fields label letter letters like literal marker markers message messages mention mentions named notation "
    "pattern patterns phrase phrases placeholder placeholders quote quoted reads says sequence so-called spelled string strings such symbol symbols syntax tag tags template templates term "
    "terms token tokens variable variables word words written".split()
)
#: So many words before a field a word of META counts as one about the field.
META_REACH = 4
_QUOTED = re.compile(r"[\"“„«'‘]([^\"”“»]{1,80})[\"”“»'’]")
_QUOTES = "\"“„«'‘"
_ENDS = re.compile(r"(?<=[.!?…])[\"”»)]*\s+|\n+")
_TAG = re.compile(r"</?(?:p|b|i|em|strong|br|div|span|li|ul|h\d)\s*/?>", re.I)
_WORD = re.compile(r"\d+|[^\W\d_]+|[|@{}\[\]<>%$#~*!?]")
_PLAIN = re.compile(r"[^\W_]+")


def _pairs(text: str) -> set[tuple[str, str]]:
    words = ["9" * min(len(w), 4) if w.isdigit() else w for w in _PLAIN.findall(text)]
    return set(zip(words, words[1:])) if len(words) > 1 else {(w, "") for w in words}


_SEED_PAIRS = frozenset().union(*[_pairs(s) for s in SEEDS])


def passages(text: str | None) -> list[str]:
    """Sentences and lines of a text, lower case, without simple markup and quoting marks."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    out = []
    for part in _ENDS.split(text.lower()):
        part = " ".join(part.strip(" \t>").split())
        if part and any(c.isalpha() for c in part):
            out.append(part)
    return out


def fields_in(passage: str) -> tuple[str, list[str]]:
    """The passage with a mark in place of each unfilled field, and the shapes of the fields."""
    if not _FIELD_HINT.search(passage) or not _ANY_FIELD.search(passage):
        return passage, []
    shapes = []
    for name, rx in _SHAPES:
        passage, n = rx.subn(" zfieldz ", passage)
        if n:
            shapes.append(f"_{name}")
    return passage, shapes


def unquoted(passage: str) -> str:
    """A sentence of eight words or more with a mark in place of what it quotes, if that is its smaller part."""
    if not any(c in passage for c in _QUOTES) or passage.count(" ") < 7:
        return passage
    return _QUOTED.sub(lambda m: " zquotez " if 2 * len(m[0]) < len(passage) else m[0], passage)


def words_of(passage: str) -> tuple[list[str], bool]:
    """Words, marks and shapes of a passage in order, and whether it has an unfilled field; numbers count by their length.

    What a longer sentence quotes is mentioned, not used: a mark stands in its place.
    """
    plain, shapes = fields_in(unquoted(passage))
    words = [("9" * min(len(w), 4)) if w.isdigit() else w for w in _WORD.findall(plain)]
    if shapes:
        at = words.index("zfieldz") if "zfieldz" in words else len(words)
        if META.intersection(words[max(0, at - META_REACH) : at]):
            shapes.append("_meta")
    return words + shapes, bool(shapes)


def trusted_label(passage: str, record_chars: int) -> float | None:
    """1 or 0 for a trusted passage, None for an unlabelled one.

    0: a sentence of eight words or more that quotes a field or a known wording.  1: an unfilled field that
    nothing speaks about; a passage of a short record that a known wording covers.
    """
    if record_chars > TRUSTED_CHARS and not _FIELD_HINT.search(passage) and not any(c in passage for c in _QUOTES):
        return None
    words, field = words_of(passage)
    if "zquotez" in words and any(fields_in(q)[1] or _pairs(q) & _SEED_PAIRS for q in _QUOTED.findall(passage)):
        return 0.0
    if field:
        return None if "_meta" in words else 1.0
    if record_chars <= TRUSTED_CHARS and len(words) <= 16:
        own = _pairs(passage)
        if len(own & _SEED_PAIRS) >= COVERED * len(own) > 0:
            return 1.0
    return None


_CELLS = 1 << HASH_BITS
_IDS: dict[str, int] = {}


def _word_id(word: str) -> int:
    got = _IDS.get(word)
    if got is None:
        if len(_IDS) > 500_000:
            _IDS.clear()
        got = _IDS[word] = zlib.crc32(word.encode())
    return got


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, cell, field)`` of passages: the distinct hashed features, words and word pairs, of each and whether it has a field.

    Beside an unfilled field even everyday words are counted apart, in the upper half of the cells: without the field they prove nothing.
    """
    flat: list[str] = []
    size, field = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
    for i, p in enumerate(texts):
        words, field[i] = words_of(p)
        flat += ["^", *words, "$"]
        size[i] = len(words) + 2
    ids = np.fromiter(map(_word_id, flat), dtype=np.uint64, count=len(flat))
    row = np.repeat(np.arange(len(texts)), size)
    half = np.where(field, _CELLS // 2, 0)[row]
    last = np.zeros(len(flat), dtype=bool)
    last[size.cumsum() - 1] = True
    first = np.zeros(len(flat), dtype=bool)
    first[size.cumsum() - size] = True

    def cell(h: np.ndarray) -> np.ndarray:
        h = (h + np.uint64(0x7F4A7C15)) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(65 - HASH_BITS)).astype(np.int64)

    one = ~first & ~last
    two = ~last[:-1]
    cells = np.concatenate([cell(ids[one]) + half[one], cell((ids[:-1] << np.uint64(17) ^ ids[1:] * np.uint64(31))[two]) + half[:-1][two]])
    keys = np.sort(np.concatenate([row[one], row[:-1][two]]) * _CELLS + cells)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return keys // _CELLS, keys % _CELLS, field


class ResidueModel:
    """Naive Bayes log-odds per cell; one prior for passages with an unfilled field and one for those without."""

    def __init__(self, weights: np.ndarray, prior: float, field_prior: float, furniture: tuple[str, ...] = ()):
        self.weights, self.prior, self.field_prior, self.furniture = weights.astype(np.float32), prior, field_prior, furniture

    def odds(self, texts: list[str]) -> np.ndarray:
        """Log-odds that the passages are residue, page furniture at their ends left aside; a field counts THRESHOLD."""
        plain = [bare(p, self.furniture) for p in texts]
        row, cell, field = coded(plain)
        out = np.bincount(row, weights=self.weights[cell], minlength=len(texts)) + np.where(field, self.field_prior + THRESHOLD, self.prior)
        out[[i for i, p in enumerate(plain) if not p]] = -np.inf
        return out


#: Page furniture that changes from page to page: trails of links and copyright lines.
_TRAIL = re.compile(r"^(?:[^\s>]+(?: [^\s>]+)? > )+\S+\s*")
_RIGHTS = re.compile(r"(?:\(c\)|©|copyright) ?(?:19|20)\d\d\b(?:\s*\S+){0,4}$")
_RIGHTS_HEAD = re.compile(r"^(?:\(c\)|©|copyright) ?(?:19|20)\d\d\s*")


def bare(passage: str, furniture: tuple[str, ...]) -> str:
    """The passage without furniture lines that run into its beginning or end."""
    if ">" in passage:
        passage = _TRAIL.sub("", passage)
    if "(c)" in passage or "©" in passage or "copyright" in passage:
        passage = _RIGHTS_HEAD.sub("", _RIGHTS.sub("", passage).strip())
    while passage and (passage.startswith(furniture) or passage.endswith(furniture)):
        for line in furniture:
            if passage.startswith(line):
                passage = passage[len(line) :].strip()
            elif passage.endswith(line):
                passage = passage[: -len(line)].strip()
    return passage


def passage_counts(texts: DataFrame) -> DataFrame:
    """``(p, n, records, chars)``: how often a passage occurs, in how many rows of ``text``, and the length of the shortest of these."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[str, list[int]] = {}
            for text in b["text"]:
                ps = passages(text)
                for p in ps:
                    got = seen.setdefault(p, [0, 0, len(text)])
                    got[0] += 1
                    got[2] = min(got[2], len(text))
                for p in set(ps):
                    seen[p][1] += 1
            yield pd.DataFrame([(p, *x) for p, x in seen.items()], columns=["p", "n", "records", "chars"])

    each = texts.select("text").mapInPandas(count, "p string, n long, records long, chars long")
    return each.groupBy("p").agg(F.sum("n").alias("n"), F.sum("records").alias("records"), F.min("chars").alias("chars"))


def furniture_lines(counts: DataFrame, n_records: int) -> tuple[str, ...]:
    """Short lines without an end mark and a trusted label that stand in a share FURNITURE of the records; at most (lines a record) / FURNITURE."""
    often = counts.where(F.col("records") >= max(5, FURNITURE * n_records)).where(F.size(F.split("p", " ")) <= 6)
    lines = (r["p"] for r in often.select("p").collect())
    return tuple(sorted(p for p in lines if p[-1] not in ".!?…" and trusted_label(p, 10**9) is None))


CODED = "field boolean, n long, label double, spy boolean, cells array<int>"


def coded_passages(counts: DataFrame, furniture: tuple[str, ...]) -> DataFrame:
    """``(field, n, label, spy, cells)`` of the passages without furniture, the known wordings among them; label is null for unlabelled ones."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            plain = [bare(p, furniture) for p in b["p"]]
            row, cell, field = coded(plain)
            label = [x if not np.isnan(x) else trusted_label(p, c) if p else None for p, c, x in zip(plain, b["chars"], b["seed"])]
            ends = np.searchsorted(row, np.arange(len(b) + 1))
            cells = [cell[lo:hi] for lo, hi in zip(ends, ends[1:])]
            y = np.array(label, dtype=float)
            spy = (y == 1) & np.isnan(b["seed"].to_numpy(float)) & (np.array([zlib.crc32(p.encode()) % SPY for p in plain]) == 0)
            out = pd.DataFrame({"field": field, "n": b["n"], "label": y, "spy": spy, "cells": cells})
            yield out[[bool(p) for p in plain]]

    spark = counts.sparkSession
    seeds = spark.createDataFrame([(p, 2, 0, 1.0) for s in SEEDS for p in passages(s)], "p string, n long, chars long, seed double")
    every = counts.select("p", "n", "chars", F.lit(float("nan")).alias("seed")).unionByName(seeds)
    return every.mapInPandas(code, CODED)


def scores_of(cells: pd.Series, field: np.ndarray, weights: np.ndarray, priors: list[float]) -> np.ndarray:
    """Log-odds of coded passages."""
    row = np.repeat(np.arange(len(cells)), cells.map(len).to_numpy())
    flat = np.concatenate([np.asarray(c, dtype=np.int64) for c in cells]) if len(cells) else np.empty(0, dtype=np.int64)
    return np.where(field, priors[1], priors[0]) + np.bincount(row, weights=weights[flat], minlength=len(cells))


def class_counts(passages_: DataFrame, weights: np.ndarray | None, priors: list[float]) -> DataFrame:
    """``(cell, pos, neg)``: one step of expectation; cells -1 and -2 have the sums over the passages without and with a field.

    Without weights spies count as unlabelled, and every unlabelled passage as negative.
    """
    shared = passages_.sparkSession.sparkContext.broadcast(weights)

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            often, label, field = b["n"].to_numpy(float), b["label"].to_numpy(float), b["field"].to_numpy(bool)
            row = np.repeat(np.arange(len(b)), b["cells"].map(len).to_numpy())
            cell = np.concatenate([np.asarray(c, dtype=np.int64) for c in b["cells"]]) if len(b) else np.empty(0, dtype=np.int64)
            known, guess = ~np.isnan(label), 0.0
            if shared.value is None:
                known &= ~b["spy"].to_numpy(bool)
            else:
                guess = 1 / (1 + np.exp(-np.clip(scores_of(b["cells"], field, shared.value, priors) / TEMPER, -50, 50)))
            post = np.where(known, label, guess)
            # a trusted message repeated over the corpus is little more evidence than one; a line repeated
            # over the corpus that nobody trusts (navigation, stock sentences) speaks against itself each time
            pos, neg = (1 + np.log(often)) * post * np.where(known, 1.0, UNLABELLED), often * (1 - post)
            if held is None:
                held = np.zeros((2, _CELLS + 2))
            for k, v in enumerate((pos, neg)):
                held[k, 2:] += np.bincount(cell, weights=v[row], minlength=_CELLS)
                held[k, :2] += [v[field].sum(), v[~field].sum()]
        if held is not None:
            at = np.flatnonzero(held.any(axis=0))
            yield pd.DataFrame({"cell": at - 2, "pos": held[0, at], "neg": held[1, at]})

    each = passages_.mapInPandas(expect, "cell int, pos double, neg double")
    return each.groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def maximized(step: pd.DataFrame) -> tuple[np.ndarray, list[float], np.ndarray]:
    """Weights of the cells, priors and class sums from the counts of one step."""
    pos, neg = np.zeros(_CELLS + 2), np.zeros(_CELLS + 2)
    pos[step["cell"] + 2], neg[step["cell"] + 2] = step["pos"], step["neg"]
    sums = np.array([*pos[:2], *neg[:2]]) + 1
    priors, parts = [], []
    for k, own in ((1, slice(2, 2 + _CELLS // 2)), (0, slice(2 + _CELLS // 2, None))):
        ratio = sums[k] / sums[k + 2]
        share = ratio / (1 + ratio)
        parts.append(np.log((pos[own] + SMOOTH * share) / (neg[own] + SMOOTH * (1 - share)) / ratio))
        priors.append(float(np.clip(math.log(ratio), -5.0, 2.0)))
    return np.clip(np.concatenate(parts), -6, 6), priors, sums


def reliable(passages_: DataFrame, weights: np.ndarray, priors: list[float]) -> DataFrame:
    """The passages with label 0 for those unlabelled ones that score below nearly all spies."""
    shared = passages_.sparkSession.sparkContext.broadcast(weights)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(score=scores_of(b["cells"], b["field"].to_numpy(bool), shared.value, priors))

    scored = passages_.mapInPandas(rate, f"{CODED}, score double")
    cuts = {r["field"]: r["cut"] for r in scored.where("spy").groupBy("field").agg(F.percentile_approx("score", SPY_LOSS, 10_000).alias("cut")).collect()}
    cut = F.when(F.col("field"), F.lit(cuts.get(True, 0.0))).otherwise(F.lit(cuts.get(False, 0.0)))
    return scored.withColumn("label", F.when(F.col("label").isNull() & (F.col("score") < cut), 0.0).otherwise(F.col("label"))).drop("score")


def fit_model(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ResidueModel:
    """Positive-unlabelled naive Bayes by expectation-maximization over all records.

    Passages are counted over the whole table.  A first model without the spies, one in SPY of the trusted
    positives, tells which unlabelled passages are surely negative; the others get their label by the rounds.  Each
    round is an aggregation over the counted passages, of which 2^HASH_BITS cells at most come to
    the driver.  The rounds end when they change nothing more (TOLERANCE).
    """
    scratch = Scratch(documents.sparkSession, "residue")
    texts = scratch.put("texts", documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct())
    counts = scratch.put("counts", passage_counts(texts))
    furniture = furniture_lines(counts, texts.count())
    scratch.drop("texts")
    all_ = scratch.put("all", coded_passages(counts, furniture))
    scratch.drop("counts")
    weights, priors, before = maximized(class_counts(all_, None, [0.0, 0.0]).toPandas())
    known = scratch.put("known", reliable(all_, weights, priors))
    scratch.drop("all")
    for _ in range(MAX_ROUNDS):
        weights, priors, now = maximized(class_counts(known, weights, priors).toPandas())
        if np.abs(now / before - 1).max() < TOLERANCE:
            break
        before = now
    scratch.drop("known")
    return ResidueModel(weights, priors[0], priors[1], furniture)


def residue_passages(documents: DataFrame, model: ResidueModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_passages, n_residue, max_odds, passage)`` for every record with a passage: its passages, residue passages and the surest one."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at: dict[str, int] = {}
            ids, own = [], []
            for d, t in zip(b["doc_id"], b["text"]):
                if ps := passages(t):
                    ids.append(d)
                    own.append([at.setdefault(p, len(at)) for p in ps])
            distinct = list(at)
            # so many passages at once, for a bound on the memory
            odds = np.concatenate([shared.value.odds(distinct[lo : lo + 20_000]) for lo in range(0, len(distinct), 20_000)]) if distinct else np.empty(0)
            rows = []
            for d, ps in zip(ids, own):
                s = odds[ps]
                k = int(np.argmax(s))
                rows.append((d, len(ps), int((s > threshold).sum()), float(s[k]), distinct[ps[k]]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_passages", "n_residue", "max_odds", "passage"])

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and doc_id is not null")
    return docs.mapInPandas(score, "doc_id long, n_passages long, n_residue long, max_odds double, passage string")


def residue_records(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_passages, n_residue, max_odds, passage)`` of the records to exclude.

    Null, empty and dash-only texts have no passage and are never residue; repeated rows give
    repeated results; an empty table gives an empty result (the model then rests on the
    known wordings).
    """
    model = fit_model(documents, id_col, text_col)
    return residue_passages(documents, model, id_col, text_col, threshold).where("n_residue > 0")
