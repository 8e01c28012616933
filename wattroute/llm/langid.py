"""Language identification in two steps: the language family first, then its languages one against one.

Features are hashed character 1- to 3-grams of the lowered whole text, as shares of all its n-grams. Linear support vector
machines (squared hinge loss, dual coordinate descent) decide: one against the rest for families, one against one for the languages
of a family, whose votes are counted (ties: larger sum of margins, then name). All machines are columns of one weight matrix.

They are fitted on a bounded sample: PER_LANGUAGE labelled rows of least id hash for each language, every language; more than
MAX_LANGUAGES of them raise an error rather than leave some out. Scoring is one pass, no shuffle; beside the text itself
memory is bounded by CHUNK characters at a time.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any labelled row every text is ``und``;
repeated rows give repeated result rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattroute.llm.common import crc_mod, table, texts

PER_LANGUAGE, MAX_LANGUAGES = 300, 200
BITS, ORDERS, SCALE = 12, 3, 64.0
CHUNK = 1 << 20
ROWS = 256  # texts whose counts are held at once

# Families of languages; a language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no is af", "romance": "fr es it pt ro ca gl", "slavic": "ru uk pl cs sk bg sr hr sl",
    "uralic": "fi et hu", "turkic": "tr az kk uz", "indic": "hi bn mr ne ur", "semitic": "ar he am", "sinitic": "zh yue",
}
FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs.split()}


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def counts(text: str) -> tuple[np.ndarray, int, bool]:
    """Hashed n-grams that start at each character (and at two closing zeros) counted by bucket, their number, whether there is a letter."""
    low = text.lower() + "\0\0"
    total, some = np.zeros(1 << BITS, dtype=np.int64), False
    for at in range(0, len(low), CHUNK):
        codes = np.frombuffer(low[at : at + CHUNK + ORDERS - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        own = min(CHUNK, len(low) - at)
        codes = np.concatenate([codes, np.zeros(own + ORDERS - 1 - len(codes), dtype=np.uint32)])
        some = some or bool(letters()[codes[:own]].any())
        h = np.zeros(own, dtype=np.uint32)
        for n in range(ORDERS):
            h = h * np.uint32(0x01000193) + codes[n : n + own] + np.uint32(n + 1)
            total += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return total, ORDERS * len(low), some


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shares of all n-grams by bucket, times SCALE, and whether each text has a letter."""
    out, some = np.zeros((len(texts), 1 << BITS), dtype=np.float32), np.zeros(len(texts), dtype=bool)
    for k, t in enumerate(texts):
        n, total, some[k] = counts(t)
        out[k] = n * (SCALE / total)
    return out, some


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, sweeps: int = 30) -> np.ndarray:
    """Weights (bias last) of the L2-loss machine for y in {-1, 1}."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1) + 0.5 / c
    draw = np.random.default_rng(0)
    for _ in range(sweeps):
        for i in draw.permutation(len(x)):
            new = max(0.0, alpha[i] - (y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c) / square[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        family = [FAMILY.get(v, v) for v in langs]
        self.families = sorted(set(family))
        self.members = {f: [v for v in self.langs if FAMILY.get(v, v) == f] for f in self.families}
        self.pairs = [(a, b) for f in self.families for a, b in combinations(self.members[f], 2)]
        lang, family = np.array(langs), np.array(family)
        w = [linear_svm(x, np.where(family == f, 1, -1)) for f in self.families] if len(self.families) > 1 else []
        for a, b in self.pairs:
            own = (lang == a) | (lang == b)
            w.append(linear_svm(x[own], np.where(lang[own] == a, 1, -1)))
        self.w = np.array(w, dtype=np.float32).reshape(-1, (1 << BITS) + 1).T

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        x, some = vectors(texts)
        margins = x @ self.w[:-1] + self.w[-1]
        nf = len(self.families) if len(self.families) > 1 else 0
        sure = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
        top = margins[:, :nf].argmax(axis=1) if nf else np.zeros(len(texts), dtype=int)
        names, scores = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(some & (top == k))
            if not len(rows):
                continue
            score = sure(margins[rows, k]) if nf else np.ones(len(rows))
            members = self.members[f]
            votes, total = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            best = np.full((len(rows), len(members)), np.inf)
            for p, (a, b) in enumerate(self.pairs):
                if a in members:
                    m = margins[rows, nf + p]
                    for v, own in ((members.index(a), m), (members.index(b), -m)):
                        votes[:, v] += own > 0
                        total[:, v] += own
                        best[:, v] = np.minimum(best[:, v], own)
            pick = np.lexsort((np.broadcast_to(-np.arange(len(members)), votes.shape), total, votes), axis=1)[:, -1]
            names[rows] = np.array(members, dtype=object)[pick]
            scores[rows] = score * (sure(best[np.arange(len(rows)), pick]) if len(members) > 1 else 1)
        return list(names), scores


def fit(docs: DataFrame) -> Model | None:
    """``docs``: doc_id, text, lang. PER_LANGUAGE rows of each language, of least id hash (of a repeated id, of least text hash)."""
    named = docs.where("lang is not null")
    n = named.select("lang").distinct().count()
    if n > MAX_LANGUAGES:
        raise ValueError(f"{n} languages; raise MAX_LANGUAGES above {MAX_LANGUAGES} to learn them all")
    if not n:
        return None
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = named.select("lang", "doc_id").withColumn("place", F.row_number().over(first)).where(F.col("place") <= PER_LANGUAGE).select("lang", "doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = vectors(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], ["x", "lang"])

    rows = texts(named, ("text", "lang", "doc_id")).join(F.broadcast(ids.withColumnsRenamed({"lang": "of", "doc_id": "id"})), F.col("lang").eqNullSafe(F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    again = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    rows = rows.withColumn("place", F.row_number().over(again)).where(F.col("place") <= PER_LANGUAGE)
    got = sorted((r.lang, bytes(r.x)) for r in rows.select("text", "lang").mapInArrow(run, "x binary, lang string").toLocalIterator())  # PER_LANGUAGE rows a language
    return Model(np.array([np.frombuffer(x, dtype=np.float32) for _, x in got]), [v for v, _ in got])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names, scores = batch.column(1).to_pylist(), [], [np.zeros(0)]
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                got = model.predict(some) if model else (["und"] * len(some), np.zeros(len(some)))
                names += got[0]
                scores.append(got[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    found = identify(docs, fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
