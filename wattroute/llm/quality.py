"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics are computed in one pass over whole texts. Trees of fixed depth are grown level by level on BINS quantile bins with the
logistic loss and stored flat: arrays of features and thresholds by (tree, node) and of leaf values, which numpy walks
for all rows of a batch at once. Boosting stops when a fifth of the sample, kept aside, no longer improves.

Fitted on a bounded sample: at most SAMPLE labelled rows, of least id hash. Scoring needs no shuffle.

Defined cases: a null text counts as empty and gets the score of its (zero) statistics; without labels every score is 0.5;
of several labels of one document the largest counts; repeated rows give repeated result rows; other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from wattroute.llm.common import crc_mod, slices, table, texts

SAMPLE, BINS, DEPTH, TREES, RATE, PATIENCE, MIN_LEAF = 20_000, 64, 4, 150, 0.1, 15, 20
ACCEPT = 0.3
PUNCTUATION = "#$%&*|!?@{}<>=~^_"  # fixed value: characters counted one by one


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point: letter lower, letter other, digit, space, end of line, other; then PUNCTUATION."""
    table = np.full(0x110000, 5, dtype=np.uint8)
    for c in range(len(table)):
        s = chr(c)
        table[c] = 0 if s.islower() else 1 if s.isalpha() else 2 if s.isdigit() else 4 if s == "\n" else 3 if s.isspace() else 5
    for k, s in enumerate(PUNCTUATION):
        table[ord(s)] = 6 + k
    return table


N_CLASSES = 6 + len(PUNCTUATION)


def statistics(text: str, classes: np.ndarray) -> list[float]:
    """Statistics of a text; all zero for an empty one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = max(1, len(codes))
    kinds = np.bincount(classes[codes], minlength=N_CLASSES) / n
    words, lines = text.split(), text.split("\n")
    m = max(1, len(words))
    counts = Counter(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    upper = sum([w.isupper() for w in words]) / m
    most = max(counts.values(), default=0) / m
    return [
        *kinds, np.log1p(len(codes)), np.log1p(len(words)), float(size.mean()), float(size.std()), float(size.max()), len(counts) / m, most,
        len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), len(codes) / len(lines), upper, sum([n for n in counts.values() if n > 1]) / m,
    ]


def features(texts: list[str], classes: np.ndarray) -> np.ndarray:
    return np.array([statistics(t, classes) for t in texts], dtype=np.float32).reshape(len(texts), -1)


class Trees:
    """Flat arrays: feature and threshold of inner node i of each tree (children 2i+1, 2i+2), value of each leaf."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total, row = np.full(len(x), self.base), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            total += leaf[node - len(t)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    none = Trees(0.0, np.zeros((0, 2**DEPTH - 1), dtype=np.int64), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)))
    if not len(x):
        return none
    none.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    test = np.arange(len(x)) % 5 == 4
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    total, grown, best, wait = np.full(len(x), none.base), [], (np.inf, 0), 0
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = np.where(test, 0, p - y), np.where(test, 0, p * (1 - p))
        node, feature, threshold = np.zeros(len(x), dtype=np.int64), [], []
        for level in range(DEPTH):
            width, gains = 2**level, []
            for j in range(x.shape[1]):
                at = node * BINS + bins[:, j]
                gs, hs, cs = (np.bincount(at, w, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (g, h, ~test))
                left = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1)
                left[(cs < MIN_LEAF) | (cs[:, -1:] - cs < MIN_LEAF)] = -1
                left[:, len(edges[j]) :] = -1
                gains.append(left)
            gains = np.stack(gains, axis=1).reshape(width, -1)
            pick = gains.argmax(axis=1)
            f, b = pick // BINS, pick % BINS
            cut = np.array([edges[j][k] if gains[i, q] >= 0 else np.inf for i, (j, k, q) in enumerate(zip(f, b, pick, strict=True))])
            feature += list(f)
            threshold += list(cut)
            node = 2 * node + (x[np.arange(len(x)), f[node]] > cut[node])
        leaf = -RATE * np.bincount(node, g, minlength=2**DEPTH) / (np.bincount(node, h, minlength=2**DEPTH) + 1)
        total += leaf[node]
        grown.append((feature, threshold, leaf))
        held = test if test.any() else ~test
        loss = np.mean(np.logaddexp(0, np.where(y[held] == 1, -total[held], total[held])))
        if loss < best[0] - 1e-5:
            best, wait = (loss, len(grown)), 0
        elif (wait := wait + 1) >= PATIENCE:
            break
    grown = grown[: best[1]]
    if not grown:
        return none
    f, t, v = (np.array(c) for c in zip(*grown, strict=True))
    return Trees(none.base, f, t, v)


def fit(docs: DataFrame, labels: DataFrame) -> Trees:
    """``docs``: doc_id, text; ``labels``: doc_id, quality."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = char_classes()
        for batch in slices(batches):
            x = features(batch.column(1).to_pylist(), classes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], ["doc_id", "x", "quality"])

    rows = texts(docs).join(F.broadcast(some), "doc_id").mapInArrow(run, "doc_id bigint, x binary, quality int").orderBy("doc_id", "x").limit(2 * SAMPLE)
    got = sorted((r.doc_id, bytes(r.x), r.quality) for r in rows.toLocalIterator())
    return boost(np.array([np.frombuffer(x, dtype=np.float32) for _, x, _ in got]), np.array([q for _, _, q in got], dtype=np.int64))


def score(docs: DataFrame, trees: Trees, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (probability of label 1) and the columns ``keep`` of every row."""
    schema = docs.select(*keep).schema
    names = ["doc_id", "score", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = char_classes()
        for batch in slices(batches):
            got = trees.score(features(batch.column(1).to_pylist(), classes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64()), *batch.columns[2:]], names)

    text = F.coalesce(F.col("text"), F.lit("")).alias("scored_text")
    out = docs.select("doc_id", text, *keep).mapInArrow(run, StructType([StructField("doc_id", LongType()), StructField("score", DoubleType()), *schema]))
    return out


def fold(doc_id="doc_id"):
    return crc_mod(F.col(doc_id), 5) == 0


def keep_good(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of score ACCEPT or more; all their columns, whatever their names. Each text is sent once, and only rows that stay come back."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = char_classes()
        for batch in slices(batches):
            x = features([t or "" for t in batch.column(at).to_pylist()], classes)
            yield batch.filter(pa.array(trees.score(x) >= ACCEPT))

    at, numbers = names.index("text"), [f"c{i}" for i in range(len(names))]  # names with dots can't be passed on
    plain = docs.toDF(*numbers)
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = fit(docs.where(~fold()), table(spark, sf_dir, "labels").where(~fold()))
    return score(docs, trees).select("doc_id", fold().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
