"""LM scoring with a hierarchical Pitman-Yor model of word bigrams, without a cap on the vocabulary.

Every word of the training texts is a context with a restaurant of its own and a dish; all context restaurants share the
parent restaurant of words, whose own base is uniform over the vocabulary and one unknown word. Customers of a context are
its bigrams; its tables are the customers of the parent.

Seating is sampled by Gibbs steps that seat all customers of a dish anew by the Chinese-restaurant rule.
A gamma variable for each restaurant (of shape strength / discount + tables) stands in for its number of tables, so that given
it and the parent's probabilities the dishes of a restaurant are independent: this is what lets one restaurant be
seated in many tasks at once. Only the number of tables counts then: for dishes of few customers it is drawn from its
exact law, for those of many by a chain that proposes whole seatings, restarted each round, so no seating is carried on and none
is stale. The parent's probabilities are held while its children are seated, then the parent is seated anew for its new customers;
that is one round. A dish with one customer has one table whatever is drawn. The last KEEP rounds are averaged:
p(word | context) = (n - discount * tables + (strength + discount * all tables) * p(word)) / (strength + customers).

Scale: words are 62-bit hashes (numbers for the HOT most frequent). Bigrams are counted in the tasks and shuffled as packed,
sorted arrays to buckets of about BUCKET tokens: all dishes of a context together, those of the most frequent contexts
dealt over as many buckets as their share asks for. What buckets of bigrams and buckets of words need of each other (customers, probabilities) travels
as packed arrays in the order that both sides know. A document's tokens are shuffled once, to the buckets that
hold their bigrams (all but those of the CACHE most frequent ones, whose scores every task holds), and come back as one sum for each document and bucket. The driver sees the HOT words, the CACHE bigrams, totals, and a few
numbers for each frequent context (two for a bucket at most).

Defined cases: null texts count as empty and hold the end token alone; repeated rows give repeated result rows (each
counts in training); without training texts every token is unknown; other columns are never read.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattroute.llm.cache import Cache
from wattroute.llm.common import crc_mod, materialise, table, texts

HOT = 100_000  # words that have short numbers and whose probabilities every task holds
BUCKET = 1_200_000  # training tokens, about, of a bucket
FLUSH = 1_000_000  # tokens that a task combines at once
ROUNDS, KEEP, STRENGTH = 3, 2, 1.0
FEW = 64  # customers of a dish up to which the law of its tables is written out
PROPOSALS, TRIES = 16, 40  # moves of a dish with more customers in a round, and more of them where none was possible yet
FILL = [0.95, 0.5, 0.85, 0.7]  # shares of a dish that a move fills before the last table
END, START, COLD = b" ", 0, 1 << 62  # no word holds a space; number 0 is the context before a text; hashed words are COLD and above
SEED = 42
CACHE = 500_000  # frequent bigrams whose scores every task holds
LEAST = [2, 3, 4, 6, 8, *(1 << k for k in range(4, 40))]  # counts of a bigram from which it may be held
ROW = "kind string, bucket int, part bigint, code bigint, value double, blob binary"
_ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("part", pa.int64()), ("code", pa.int64()), ("value", pa.float64()), ("blob", pa.binary())])


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of floats or of integers from 0, in as few bytes as the largest needs, byte planes compressed."""
    out = []
    for a in arrays:
        if a.dtype.kind != "f":
            a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
        out.append((a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()))
    return zstandard.compress(pickle.dumps(out), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, raw in pickle.loads(zstandard.decompress(blob)):
        a = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
        out.append(a.copy() if a.dtype.kind == "f" else a.astype(np.int64))
    return out


def gaps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=0)


def rows_of(rows: list[tuple]) -> pa.Table:
    """(kind, bucket, part, code, value, blob) tuples as Arrow."""
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, _ARROW, strict=True)], schema=_ARROW)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(u) * np.uint64(3) + mix(w))


class Plan:
    """Where words and bigrams live: ``buckets`` of each, and the frequent contexts with the number of buckets that each is dealt over."""

    def __init__(self, buckets: int, heavy: dict[int, int]):
        self.buckets, self.codes = buckets, np.array(sorted(heavy), dtype=np.int64)
        self.spread = np.array([heavy[c] for c in self.codes.tolist()], dtype=np.uint64)

    def place(self, u: np.ndarray) -> np.ndarray:
        """Index into ``codes``, -1 where a context is not frequent."""
        if not len(self.codes):
            return np.full(len(u), -1)
        at = np.minimum(np.searchsorted(self.codes, u), len(self.codes) - 1)
        return np.where(self.codes[at] == u, at, -1)

    def of_pairs(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        at, h = self.place(u), mix(u)
        spread = np.where(at >= 0, self.spread[at] if len(self.codes) else 1, 1).astype(np.uint64)
        return ((h + mix(w) % spread) % np.uint64(self.buckets)).astype(np.int64)

    def of_words(self, w: np.ndarray) -> np.ndarray:
        return ((mix(w) >> np.uint64(7)) % np.uint64(self.buckets)).astype(np.int64)

    def ordered(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words by (bucket of words, number), their buckets, and where each element of ``w`` is among them."""
        distinct, at = np.unique(w, return_inverse=True)
        home = self.of_words(distinct)
        order = np.argsort(home, kind="stable")
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return distinct[order], home[order], back[at]


def slices(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(key, slice) of each run of a sorted array."""
    cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, dtype=int)
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(keys[s]), slice(s, e)


class Coder:
    """Numbers of words: 1.. for the frequent ones, COLD and above for hashes."""

    def __init__(self, hot: np.ndarray):
        self.hot, self.cache = {h: i + 1 for i, h in enumerate(hot.tolist())}, Cache(150_000)

    def code(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED) >> 2
        return self.cache.put(word, self.hot.get(h, h | COLD))

    def codes(self, words: list[bytes]) -> np.ndarray:
        out = list(map(self.cache.young.get, words))
        if None in out:
            get, code = self.cache.get, self.code
            for k, got in enumerate(out):
                if got is None:
                    out[k] = get(words[k]) or code(words[k])
        return np.array(out, dtype=np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """hash (62 bits), n over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, size = Coder(np.zeros(0, dtype=np.int64)), [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h - COLD), pa.array(n)], ["hash", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.append(coder.codes(tokens(text.as_py())))
                size += len(held[-1])
                if size > FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return texts(docs, ("text",), binary=True).mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def sorted_by(u: np.ndarray, w: np.ndarray, doc: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(u, w, doc) in their order: by one sort of keys put together from the places among the distinct words, if they fit in 63 bits."""
    words, at = np.unique(np.concatenate([u, w]), return_inverse=True)
    a, b, bits = at[: len(u)], at[len(u) :], max(1, len(words).bit_length())
    low = int(doc.max(initial=0)).bit_length() if doc is not None else 0
    if 2 * bits + low > 63:
        order = np.lexsort((w, u) if doc is None else (doc, w, u))
        return (u[order], w[order]) if doc is None else (u[order], w[order], doc[order])
    key = (a << bits | b) << low
    key = np.sort(key if doc is None else key | doc)
    pair = key >> low
    out = words[pair >> bits], words[pair & ((1 << bits) - 1)]
    return out if doc is None else (*out, key & ((1 << low) - 1))


def dealt(to: np.ndarray, buckets: int) -> np.ndarray:
    """Order by bucket that keeps the order within each."""
    return np.argsort(to.astype(np.uint16) if buckets <= 1 << 16 else to, kind="stable")


def runs_of(u: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (u, w) summed up, in order of (u, w)."""
    if not len(u):
        return u, w, n
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
    return u[first], w[first], np.add.reduceat(n[order], first)


def bigrams(docs: DataFrame, hot: np.ndarray, plan: Plan) -> DataFrame:
    """Packed arrays (context, word, count) by bucket, combined in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, size = Coder(hot), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            u, w = np.concatenate([np.concatenate([[START], c[:-1]]) for c in held]), np.concatenate(held)
            u, w = sorted_by(u, w)
            first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
            u, w, n = u[first], w[first], np.diff(np.append(first, len(u)))
            to = plan.of_pairs(u, w)
            order = dealt(to, plan.buckets)
            u, w, n = u[order], w[order], n[order]
            yield from rows_of([("pairs", b, None, None, None, pack(gaps(u[s]), w[s], n[s])) for b, s in slices(to[order])]).to_batches()

        for batch in batches:
            for text in batch.column(0):
                held.append(coder.codes(tokens(text.as_py())))
                size += len(held[-1])
                if size > FLUSH:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return texts(docs, ("text",), binary=True).mapInArrow(run, ROW)


def bigram_tables(packed: DataFrame, plan: Plan) -> DataFrame:
    """For each bucket: its pairs; the state of those with several customers; what it asks of the buckets of words; counts of counts; tables of frequent contexts."""

    def merge(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        parts = [unpack(b.as_py()) for b in t.column("blob")]
        u, w, n = runs_of(*(np.concatenate([np.cumsum(p[0]) if k == 0 else p[k] for p in parts]) for k in range(3)))
        out = [("pairs", bucket, None, None, None, pack(gaps(u), w, n))]
        out += [("counts", None, None, k, float((n == k).sum()), None) for k in (1, 2)]
        out += [("least", None, None, k, float((n >= k).sum()), None) for k in LEAST]
        words, home, at = plan.ordered(w)
        one, several, total = (np.bincount(at, x, minlength=len(words)).astype(np.int64) for x in (n == 1, n > 1, n))
        out += [("ask", h, bucket, None, None, pack(gaps(words[s]), one[s], several[s], total[s])) for h, s in slices(home)]
        contexts, of = np.unique(u, return_inverse=True)
        customers, singles, tables = (np.bincount(of, x, minlength=len(contexts)).astype(np.int64) for x in (n, n == 1, np.ones(len(n))))
        frequent = plan.place(contexts) >= 0
        out += [("heavy", None, None, int(c), float(x), None) for c, x in zip(contexts[frequent], tables[frequent], strict=True)]
        many = n > 1
        if many.any():
            own, ones = np.unique(of[many]), np.ones(int(many.sum()), dtype=np.int64)
            out.append(("state", bucket, None, None, None, pack(gaps(u[many]), w[many], n[many], ones, 0 * ones, gaps(contexts[own]), customers[own], singles[own])))
        return rows_of(out)

    return packed.groupBy("bucket").applyInArrow(merge, ROW)


def stirling(discount: float, most: int) -> np.ndarray:
    """log of the generalised Stirling numbers S(n, t): the weight of all ways to seat n customers at t tables, tables not told apart."""
    out = np.full((most + 1, most + 2), -np.inf)
    out[1, 1] = 0
    for n in range(1, most):
        t = np.arange(1, n + 1)
        out[n + 1, t] = np.logaddexp(out[n, t - 1], out[n, t] + np.log(n - t * discount))
        out[n + 1, n + 1] = out[n, n]
    return out


def table_size(discount: float, k: np.ndarray) -> np.ndarray:
    """log of the probability that a table has k customers, if tables are filled without regard to how many customers there are."""
    j = np.arange(1, 4096, dtype=np.float64)
    exact = np.concatenate([[math.log(discount)], math.log(discount) + np.cumsum(np.log((j - discount) / (j + 1)))])
    k = np.maximum(k, 1)
    far = np.maximum(k, 4096).astype(np.float64)
    tail = math.log(discount) - math.lgamma(1 - discount) - (1 + discount) * np.log(far) + np.log1p(discount * (1 + discount) / (2 * far))
    return np.where(k <= 4096, exact[np.minimum(k, 4096).astype(np.int64) - 1], tail)


def crowds(n: np.ndarray, fresh: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Tables of dishes with many customers: PROPOSALS moves of a chain whose move seats all customers of a dish anew.

    Tables come as a Poisson number (mean fresh / discount) of independent sizes, thinned by a power of ``z`` so that they fill a share
    (of FILL, in turn) of the dish; one more table, which must be the largest, takes the customers left. What this proposes is the wanted
    law but for the weight of the last table, by which a move is taken or not.
    """
    rate, log_z = fresh / discount, []
    for share in FILL:
        low, high = np.full(len(n), -60.0), np.full(len(n), -1e-12)  # log of 1 - z, halved towards the share asked for
        for _ in range(50):
            y = (low + high) / 2
            small = np.log(fresh) + np.log(-np.expm1(y)) + (discount - 1) * y < np.log(share * n)
            low, high = np.where(small, low, y), np.where(small, y, high)
        log_z.append(np.log1p(-np.exp(low)))

    def propose(of: np.ndarray, log_z: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tables, last table, log of how many are as large, whether that is a seating."""
        who = np.repeat(np.arange(len(of)), draw.poisson(rate[of]))
        size = np.floor(np.log(draw.random(len(who))) / np.log1p(-np.minimum(draw.beta(discount, 1 - discount, len(who)), 1 - 1e-16)) + 1)
        size = np.minimum(np.nan_to_num(size, nan=1e15, posinf=1e15), 1e15)
        stays = np.log(draw.random(len(who))) < size * log_z[who]
        who, size = who[stays], size[stays]
        others, most = np.bincount(who, size, minlength=len(of)), np.zeros(len(of))
        np.maximum.at(most, who, size)
        last = n[of] - others
        equal = 1 + np.bincount(who[size == last[who]], minlength=len(of))
        return np.bincount(who, minlength=len(of)) + 1, last, np.log(equal), last >= np.maximum(most, 1)

    tables, last, equal, seated = np.ones(len(n), dtype=np.int64), n.astype(np.float64), np.zeros(len(n)), np.zeros(len(n), dtype=bool)
    for turn in range(PROPOSALS + TRIES):
        of = np.arange(len(n)) if turn < PROPOSALS else np.flatnonzero(~seated)  # a dish without any seating yet tries on
        if not len(of):
            break
        z = log_z[turn % len(FILL)][of]
        t, l, e, fits = propose(of, z)
        gain = table_size(discount, l) + l * z - e - (table_size(discount, last[of]) + last[of] * z - equal[of])
        taken = fits & (~seated[of] | (np.log(draw.random(len(of))) < gain))
        at = of[taken]
        tables[at], last[at], equal[at], seated[at] = t[taken], l[taken], e[taken], True
    return np.minimum(tables, n)


def seat(n: np.ndarray, fresh: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Tables of each dish (n >= 1 customers) seated anew, a new table having weight ``fresh``: one Gibbs step for all customers of a dish together.

    Up to FEW customers the number of tables is drawn from its law (Stirling numbers), beyond that by crowds().
    """
    tables = np.ones(len(n), dtype=np.int64)
    two = n == 2  # most dishes
    tables[two] += draw.random(int(two.sum())) * (fresh[two] + 1 - discount) < fresh[two]
    rest = np.flatnonzero(n > 2)
    groups = np.minimum(n[rest], FEW + 1).astype(np.uint8)
    order = rest[np.argsort(groups, kind="stable")]
    weights, log_fresh = stirling(discount, FEW), np.log(np.maximum(fresh, 1e-300))
    at = np.searchsorted(n[order], np.arange(3, FEW + 2)) if len(order) else np.zeros(FEW - 1, dtype=np.int64)
    for k, low, high in zip(range(3, FEW + 1), at, at[1:], strict=False):
        step = max(1, (1 << 20) // k)
        for s in range(low, high, step):
            of = order[s : min(s + step, high)]
            x = log_fresh[of, None] * np.arange(1, k + 1) + weights[k, 1 : k + 1]
            x = np.exp(x - x.max(axis=1, keepdims=True)).cumsum(axis=1)
            tables[of] = 1 + (x < (draw.random(len(of)) * x[:, -1])[:, None]).sum(axis=1)
    many = n > FEW
    if many.any():
        tables[many] = crowds(n[many], np.maximum(fresh[many], 1e-300), discount, draw)
    return tables


def by_kind(t: pa.Table) -> dict[str, list[dict]]:
    """Rows of a group by kind, each in order of part."""
    out: dict[str, list[dict]] = defaultdict(list)
    for r in sorted(t.to_pylist(), key=lambda r: r["part"] if r["part"] is not None else -1):
        out[r["kind"]].append(r)
    return out


def parent_round(asked: DataFrame, turn: int, discount: float, gamma: float, vocabulary: int) -> DataFrame:
    """Seats the parent's dishes in each bucket of words: customers less discounted tables, for the buckets that asked and as totals.

    ``asked``: in the first round the ask rows, later the base rows and the moved rows.
    """

    def run(t: pa.Table) -> pa.Table:
        home, rows = t.column("bucket")[0].as_py(), by_kind(t)
        asks = [(r["part"], unpack(r["blob"])) for r in rows["ask"]]
        out = []
        if asks:
            words, at = np.unique(np.concatenate([np.cumsum(a[0]) for _, a in asks]), return_inverse=True)
            fixed, total = (np.bincount(at, np.concatenate([a[k] for _, a in asks]), minlength=len(words)).astype(np.int64) for k in (1, 3))
            out.append(("base", home, None, None, None, pack(gaps(words), fixed, total)))
            moved = [(part, np.cumsum(a[0])[a[2] > 0], a[2][a[2] > 0]) for part, a in asks]
        else:
            words, fixed, _ = unpack(rows["base"][0]["blob"])
            words = np.cumsum(words)
            moved = [(r["part"], np.cumsum((a := unpack(r["blob"]))[0]), a[1]) for r in rows["moved"]]
        customers = fixed.astype(np.float64)
        for _, keys, n in moved:
            np.add.at(customers, np.searchsorted(words, keys), n)
        n = customers.astype(np.int64)
        tables = seat(n, np.full(len(n), discount * gamma / (vocabulary + 1)), discount, np.random.default_rng([SEED, turn, home, 1]))
        mass = (n - discount * tables).astype(np.float32)
        out.append(("mass", home, turn, None, None, pack(mass)))
        out += [("total", None, None, k, float(x.sum()), None) for k, x in enumerate((n, tables))]
        out += [("reply", part, home, None, None, pack(mass[np.searchsorted(words, keys)])) for part, keys, _ in moved if len(keys)]
        return rows_of(out)

    return asked.groupBy("bucket").applyInArrow(run, ROW)


def child_round(state: DataFrame, plan: Plan, turn: int, discount: float, scale: float, shift: float, gammas: np.ndarray) -> DataFrame:
    """Seats the dishes of the contexts in each bucket given p(word) = scale * mass + shift; ``gammas`` of the frequent contexts."""

    def run(t: pa.Table) -> pa.Table:
        bucket, rows = t.column("bucket")[0].as_py(), by_kind(t)
        found = rows["state"]
        if not found:
            return rows_of([])
        u, w, n, tables, kept, contexts, customers, singles = unpack(found[0]["blob"])
        u, contexts = np.cumsum(u), np.cumsum(contexts)
        words, home, at = plan.ordered(w)
        p = scale * np.concatenate([unpack(r["blob"])[0] for r in rows["reply"]]).astype(np.float64) + shift
        of, frequent = np.searchsorted(contexts, u), plan.place(contexts)
        draw = np.random.default_rng([SEED, turn, bucket, 2])
        gamma = draw.gamma(STRENGTH / discount + singles + np.bincount(of, tables, minlength=len(contexts)))
        if len(gammas):
            gamma = np.where(frequent >= 0, gammas[frequent], gamma)
        tables = seat(n, discount * gamma[of] * p[at], discount, draw)
        if turn >= ROUNDS - KEEP:
            kept = kept + tables
        out = [("state", bucket, None, None, None, pack(gaps(u), w, n, tables, kept, gaps(contexts), customers, singles))]
        moved = np.bincount(at, tables, minlength=len(words)).astype(np.int64)
        out += [("moved", h, bucket, None, None, pack(gaps(words[s]), moved[s])) for h, s in slices(home)]
        extra = np.bincount(of, tables - 1, minlength=len(contexts))  # beyond the one table a dish that all had at first
        out += [("heavy", None, None, int(c), float(x), None) for c, x in zip(contexts[frequent >= 0], extra[frequent >= 0], strict=True)]
        return rows_of(out)

    return state.groupBy("bucket").applyInArrow(run, ROW)


class Model:
    """The sampled model as tables (of packed rows), and the numbers that every task needs."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        counts = materialise(word_counts(docs), "counts")
        size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("n").alias("v"), *[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2)]).first()
        hot = counts.orderBy(F.desc("n"), "hash").limit(HOT).collect()
        self.n, self.v = size.n, size.v
        self.hot, self.hot_n = np.array([r.hash for r in hot], dtype=np.int64), np.array([r.n for r in hot], dtype=np.int64)
        buckets = max(8, -(-self.n // BUCKET))
        share = self.n / (2 * buckets)  # a context beyond this share is dealt over several buckets; fewer than two for a bucket
        starts = docs.count()
        frequent = {START: starts} | {i + 1: int(n) for i, n in enumerate(self.hot_n.tolist())}
        end = xxhash.xxh64_intdigest(END, SEED) >> 2
        frequent = {c: n for c, n in frequent.items() if n > share and (c == START or self.hot[c - 1] != end)}
        self.plan = Plan(buckets, {c: math.ceil(n / share) for c, n in frequent.items()})
        codes = self.plan.codes.tolist()
        self.customers = np.array([frequent[c] for c in codes], dtype=np.float64)
        self.first = materialise(bigram_tables(bigrams(docs, self.hot, self.plan), self.plan), "bigrams")
        counts_of = {r.code: r.x for r in self.first.where("kind = 'counts'").groupBy("code").agg(F.sum("value").alias("x")).collect()}
        self.discount = discount_of(counts_of.get(1, 0), counts_of.get(2, 0))
        self.parent_discount = discount_of(size.n1, size.n2)
        self.base = self._heavy(self.first)  # tables of frequent contexts when every dish has one
        draw = np.random.default_rng(SEED)
        asked, state, tables, parent_tables, totals = self.first.where("kind = 'ask'"), self.first.where("kind = 'state'"), self.base, float(self.v), []
        self.rounds: list[tuple[DataFrame, float, float]] = []
        for turn in range(ROUNDS):
            gamma = float(draw.gamma(STRENGTH / self.parent_discount + parent_tables))
            parent = materialise(parent_round(asked, turn, self.parent_discount, gamma, self.v), "parent")
            if turn == 0:
                base = parent.where("kind = 'base'")
                self.words = base
            got = {r.code: r.x for r in parent.where("kind = 'total'").groupBy("code").agg(F.sum("value").alias("x")).collect()}
            customers, parent_tables = got.get(0, 0.0), got.get(1, 0.0)
            scale = 1 / (STRENGTH + customers)
            shift = scale * (STRENGTH + self.parent_discount * parent_tables) / (self.v + 1)
            self.rounds.append((parent.where("kind = 'mass'"), scale, shift))
            gammas = draw.gamma(STRENGTH / self.discount + tables) if len(tables) else tables
            child = materialise(child_round(state.unionByName(parent.where("kind = 'reply'")), self.plan, turn, self.discount, scale, shift, gammas), "child")
            tables = self.base + self._heavy(child)
            totals.append(tables)
            state, asked = child.where("kind = 'state'"), base.unionByName(child.where("kind = 'moved'"))
        self.state, self.rounds = state, self.rounds[-KEEP:]
        self.tables = sum(totals[-KEEP:]) / KEEP
        self.unknown = sum(shift for *_, shift in self.rounds) / len(self.rounds)  # probability of an unknown word
        self.found = materialise(self._probabilities(), "words")
        p = np.full(len(self.hot) + 1, self.unknown)
        for r in self.found.where("kind = 'hot'").select("code", "value").toLocalIterator():  # HOT rows at most
            p[r.code] = r.value
        self.hot_p = p
        self.keys, self.scores = self._frequent_pairs()
        spark.sparkContext._jvm.System.gc()  # lets the cleaner drop the shuffle files of rounds that are over

    def _heavy(self, df: DataFrame) -> np.ndarray:
        got = {r.code: r.x for r in df.where("kind = 'heavy'").groupBy("code").agg(F.sum("value").alias("x")).collect()}  # fewer than two for a bucket
        return np.array([got.get(c, 0.0) for c in self.plan.codes.tolist()])

    def _frequent_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and scores (beside p(word)) of at most CACHE bigrams, the most frequent: a table addressed by the low bits of the key."""
        many = {r.code: r.x for r in self.first.where("kind = 'least'").groupBy("code").agg(F.sum("value").alias("x")).collect()}
        least = min((k for k in LEAST if many.get(k, 0) <= CACHE), default=LEAST[-1])
        plan, discount, hot_p, weight, customers_of = self.plan, self.discount, self.hot_p, STRENGTH + self.discount * self.tables, STRENGTH + self.customers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(0):
                    u, w, n, _, kept, contexts, customers, singles = unpack(blob.as_py())
                    u, contexts = np.cumsum(u), np.cumsum(contexts)
                    of, frequent = np.searchsorted(contexts, u), plan.place(contexts)
                    more, below = STRENGTH + discount * (singles + np.bincount(of, kept, minlength=len(contexts)) / KEEP), STRENGTH + customers
                    if len(plan.codes):
                        more, below = np.where(frequent >= 0, weight[frequent], more), np.where(frequent >= 0, customers_of[frequent], below)
                    some = (n >= least) & (w < len(hot_p))
                    a, b, of = u[some], w[some], of[some]
                    value = np.log10((n[some] - discount * kept[some] / KEEP + more[of] * hot_p[b]) / below[of] / hot_p[b])
                    yield pa.RecordBatch.from_arrays([pa.array([pair_key(a, b).tobytes()]), pa.array([value.astype(np.float32).tobytes()])], ["keys", "scores"])

        keys, scores = np.zeros(1 << CACHE.bit_length(), dtype=np.uint64), np.zeros(1 << CACHE.bit_length(), dtype=np.float32)
        for r in self.state.select("blob").mapInArrow(run, "keys binary, scores binary").toLocalIterator():  # CACHE bigrams at most
            k = np.frombuffer(r.keys, dtype=np.uint64)
            at = (k & np.uint64(len(keys) - 1)).astype(np.int64)
            keys[at], scores[at] = k, np.frombuffer(r.scores, dtype=np.float32)
        return keys, scores

    def _probabilities(self) -> DataFrame:
        """Averaged p(word): for all that the buckets of bigrams hold, by bucket of words, and of the frequent words."""
        scales, hot = {ROUNDS - len(self.rounds) + k: (a, b) for k, (_, a, b) in enumerate(self.rounds)}, len(self.hot)

        def run(t: pa.Table) -> pa.Table:
            home, rows = t.column("bucket")[0].as_py(), by_kind(t)
            words, _, n = unpack(rows["base"][0]["blob"])
            words = np.cumsum(words)
            p = sum(scales[r["part"]][0] * unpack(r["blob"])[0].astype(np.float64) + scales[r["part"]][1] for r in rows["mass"]) / len(scales)
            out = [("word", home, None, None, None, pack(gaps(words), n, p))]
            out += [("hot", None, None, int(c), float(x), None) for c, x in zip(words, p, strict=True) if c <= hot]
            out += [("reply", r["part"], home, None, None, pack(p[np.searchsorted(words, np.cumsum(unpack(r["blob"])[0]))].astype(np.float32))) for r in rows["ask"]]
            return rows_of(out)

        gathered = self.words.unionByName(self.first.where("kind = 'ask'"))
        for mass, *_ in self.rounds:
            gathered = gathered.unionByName(mass)
        return gathered.groupBy("bucket").applyInArrow(run, ROW)


def discount_of(once: float, twice: float) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def emit(docs: DataFrame, model: Model) -> DataFrame:
    """What documents send to the buckets: sorted tokens by bucket of bigrams, rarer words by bucket of words, and the head of each batch of documents."""
    plan, hot, log_p, log_n = model.plan, model.hot, np.log10(model.hot_p), np.concatenate([[0.0], np.log10(model.hot_n + 0.5)])
    keys, scores = model.keys, model.scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, ids, held, size, flush = Coder(hot), [], [], 0, TaskContext.get().partitionId() << 32

        def out() -> Iterator[pa.RecordBatch]:
            length = np.array([len(c) for c in held])
            doc = np.repeat(np.arange(len(held)), length)
            w = np.concatenate(held)
            u = np.concatenate([[START], w[:-1]])
            u[np.cumsum(length)[:-1]] = START
            known = w < COLD
            sums = [np.bincount(doc[known], x[w[known]], minlength=len(held)).astype(np.float64) for x in (np.ones(len(log_n)), log_n, log_p)]
            k = pair_key(u, w)
            at = (k & np.uint64(len(keys) - 1)).astype(np.int64)
            here = keys[at] == k  # frequent bigrams need not travel
            sums[2] += np.bincount(doc[here], scores[at[here]], minlength=len(held))
            nulls = np.array([i is None for i in ids], dtype=np.int64)
            low = np.array([0 if i is None else i for i in ids], dtype=np.int64)
            head = pack(nulls, np.frombuffer(low.tobytes(), dtype=np.float64), length, *sums)
            out = [("head", int(flush % plan.buckets), flush, None, None, head)]
            a, b, c = sorted_by(u[~here], w[~here], doc[~here])
            to = plan.of_pairs(a, b)
            order = dealt(to, plan.buckets)
            a, b, c = a[order], b[order], c[order]
            out += [("tokens", k, flush, None, None, pack(gaps(a[s]), b[s], c[s])) for k, s in slices(to[order])]
            b, c = w[~known], doc[~known]
            to = plan.of_words(b)
            order = np.lexsort((c, b, to))
            b, c = b[order], c[order]
            out += [("rare", k, flush, None, None, pack(gaps(b[s]), c[s])) for k, s in slices(to[order])]
            yield from rows_of(out).to_batches()

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                held.append(coder.codes(tokens(text.as_py())))
                size += len(held[-1])
                if size > FLUSH:
                    yield from out()
                    ids, held, size, flush = [], [], 0, flush + 1
        if held:
            yield from out()

    return texts(docs, binary=True).mapInArrow(run, ROW)


def evaluate(sent: DataFrame, model: Model) -> DataFrame:
    """Sums for each document and bucket: known rarer words, their part of the base score, and of the model's."""
    plan, discount, unknown = model.plan, model.discount, model.unknown
    log_share = np.log10((STRENGTH + discount * model.tables) / (STRENGTH + model.customers)) if len(plan.codes) else np.zeros(0)
    weight = STRENGTH + discount * model.tables

    def run(t: pa.Table) -> pa.Table:
        rows = by_kind(t)
        out = [(r["kind"], None, r["part"], None, None, r["blob"]) for r in rows["head"]]
        found, state = rows["pairs"], rows["state"]
        if found:
            u, w, n = unpack(found[0]["blob"])
            u = np.cumsum(u)
            p = np.concatenate([unpack(r["blob"])[0] for r in rows["reply"]]).astype(np.float64)[plan.ordered(w)[2]]
            tables = np.ones(len(n))
            if state:
                tables[n > 1] = unpack(state[0]["blob"])[4] / KEEP
            contexts, of = np.unique(u, return_inverse=True)
            frequent = plan.place(contexts)
            more = STRENGTH + discount * np.bincount(of, tables)
            share = np.log10(more / (STRENGTH + np.bincount(of, n)))
            if len(plan.codes):
                more, share = np.where(frequent >= 0, weight[frequent], more), np.where(frequent >= 0, log_share[frequent], share)
            gain = np.log10(1 + (n - discount * tables) / (more[of] * p))
            key = pair_key(u, w)
            order = np.argsort(key)
            key, gain = key[order], gain[order].astype(np.float32)
            del u, w, n, p, tables, of, more, order
        for r in rows["tokens"]:
            a, b, doc = unpack(r["blob"])
            a, own, here = np.cumsum(a), np.zeros(len(doc)), np.zeros(len(doc), dtype=bool)
            if found:
                at = np.minimum(np.searchsorted(contexts, a), len(contexts) - 1)
                here = contexts[at] == a
                own += np.where(here, share[at], 0)
                k = pair_key(a, b)
                at = np.minimum(np.searchsorted(key, k), len(key) - 1)
                own += np.where(key[at] == k, gain[at], 0)
            if len(plan.codes) and not here.all():  # a frequent context counts also where this bucket holds none of its bigrams
                frequent = plan.place(a)
                own += np.where((frequent >= 0) & ~here, log_share[frequent], 0)
            some, at = np.unique(doc, return_inverse=True)
            out.append(("model", None, r["part"], None, None, pack(gaps(some), np.bincount(at, own).astype(np.float32))))
        rare = rows["rare"]
        if rare:
            words, n, p = unpack(rows["word"][0]["blob"]) if rows["word"] else (np.zeros(1, dtype=np.int64), np.zeros(1), np.full(1, unknown))
            words = np.cumsum(words)
            for r in rare:
                b, doc = unpack(r["blob"])
                b = np.cumsum(b)
                at = np.minimum(np.searchsorted(words, b), len(words) - 1)
                hit = words[at] == b
                some, to = np.unique(doc, return_inverse=True)
                parts = [np.bincount(to, np.where(hit, x, y)) for x, y in ((1.0, 0.0), (np.log10(n[at] + 0.5), math.log10(0.5)), (np.log10(p[at]), math.log10(unknown)))]
                out.append(("rare", None, r["part"], None, None, pack(gaps(some), parts[0].astype(np.int64), parts[1], parts[2])))
        return rows_of(out)

    gathered = sent.unionByName(model.first.where("kind = 'pairs'")).unionByName(model.state).unionByName(model.found.where("kind in ('reply', 'word')"))
    return gathered.groupBy("bucket").applyInArrow(run, ROW)


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    model = Model(train)
    floor, total = math.log10(model.n + 0.5 * (model.v + 1)), model.n

    def run(t: pa.Table) -> pa.Table:
        rows = by_kind(t)
        nulls, ids, length, known, base, own = unpack(rows["head"][0]["blob"])
        for r in rows["model"]:
            doc, x = unpack(r["blob"])
            own[np.cumsum(doc)] += x
        for r in rows["rare"]:
            doc, n, x, y = unpack(r["blob"])
            doc = np.cumsum(doc)
            known[doc] += n
            base[doc] += x
            own[doc] += y
        ids = pa.array(np.frombuffer(ids.tobytes(), dtype=np.int64), mask=nulls > 0)
        columns = [ids, pa.array(length), pa.array(known.astype(np.int64)), pa.array(np.full(len(length), total)), pa.array(base - length * floor), pa.array(own)]
        return pa.table(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    sums = evaluate(emit(docs, model), model)
    return sums.groupBy("part").applyInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    found = score(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
