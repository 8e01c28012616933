"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. Each 32-bit half of it gives its low 23 bits to the perfect binary Golay code [23, 12], whose
covering radius is 3: each half has exactly one *home* anchor (a codeword within 3 bits). Together with the half's other
9 bits the anchor is a cell. A fingerprint is replicated to the cells of every anchor within covering radius plus
threshold of the half, with its own 9 bits, and to its home anchor's cells with one of the 9 bits turned; per cell the
homes are compared with all fingerprints that were sent there, over all their bits.

Guarantee: two linked fingerprints (at most 3 bits apart) differ in at most one bit in some half. If that is one of the low
23, the one lies within 3 + 1 bits of the other's home anchor and has the same 9 bits; if one of the 9, both have the
same home anchor and one turned bit leads from cell to cell. So every linked pair meets: the query is exact.

Scale: equal fingerprints are collapsed before replication. There are 2^21 cells a half, and work grows with the pairs in
a cell. Both the homes and the visitors of a crowded cell are dealt over chunks of CROWD, so no group is larger than two
chunks or ROWS rows; the number of groups follows the number of rows. A crowded cell yields one edge
for each member and pair of chunks (to the least member of its local component), a small cell of at most SMALL rows
its links. Components are found by contraction without collecting anything.

Defined cases: a null text counts as empty; an empty text has fingerprint zero and links like any other; repeated rows
give repeated result rows; rows whose doc_id is null get a fingerprint and share the component of equal fingerprints
(null if only such rows have it); other columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattroute.llm.common import components, materialise, packed, slices, table, texts

N, K, RADIUS, REACH = 23, 12, 3, 1
GOLAY = 0xC75  # fixed value: generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1
SEED = 42
REST = 32 - N  # bits of a half beside the code word
GROUP = 400_000  # rows, about, that one call handles
COPIES = 30  # rows, about, that a fingerprint is replicated to
SMALL = 24  # rows of a cell whose links are all given
CROWD = 8192  # rows of one cell on either side compared in one task; more are dealt over chunks
BROADCAST = 100_000  # crowded cells at most that every task is sent
PAIRS = 1 << 21  # entries of a comparison matrix held at once


def syndromes(x: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word modulo the generator polynomial."""
    r = x.astype(np.uint32)
    for bit in range(N - 1, N - K - 1, -1):
        r = np.where((r >> np.uint32(bit)) & np.uint32(1), r ^ np.uint32(GOLAY << (bit - (N - K))), r)
    return r


def _patterns() -> tuple[np.ndarray, list[np.ndarray]]:
    """For each syndrome: its pattern of weight at most 3, and all its patterns of weight 4."""
    bits = (np.uint32(1) << np.arange(N, dtype=np.uint32)).astype(np.uint32)
    leaders = np.zeros(1 << (N - K), dtype=np.uint32)
    level = np.zeros(1, dtype=np.uint32)
    for _ in range(RADIUS):
        level = np.unique((level[:, None] | bits[None, :]).ravel())
        level = level[np.bitwise_count(level) == np.bitwise_count(level).max()]
        leaders[syndromes(level)] = level
    level = np.unique((level[:, None] | bits[None, :]).ravel())
    level = level[np.bitwise_count(level) == RADIUS + REACH]
    of = syndromes(level)
    order = np.argsort(of, kind="stable")
    return leaders, np.split(level[order], np.searchsorted(of[order], np.arange(1, 1 << (N - K))))


_TABLES: list = []


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into ``half``, anchor 0..4095, is it the home) of every anchor within radius plus reach."""
    if not _TABLES:
        leaders, near = _patterns()
        width = max(map(len, near))
        _TABLES.extend([leaders, np.array([np.pad(p, (0, width - len(p))) for p in near]), np.array([len(p) for p in near])])
    leaders, near, count = _TABLES
    x = (half & np.uint64((1 << N) - 1)).astype(np.uint32)
    s = syndromes(x)
    home = x ^ leaders[s]
    other = x[:, None] ^ near[s]
    row, col = np.nonzero(np.arange(near.shape[1])[None, :] < count[s][:, None])
    index = np.concatenate([np.arange(len(x)), row])
    word = np.concatenate([home, other[row, col]])
    return index, (word >> np.uint32(N - K)).astype(np.int32), np.arange(len(index)) < len(x)


def cells(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into ``half``, cell 0..2^21 - 1, is it the home) of every cell that a half is sent to."""
    index, anchor, home = anchors(half)
    rest = ((half >> np.uint64(N)) & np.uint64((1 << REST) - 1)).astype(np.int64)
    n = len(half)
    turned = (rest[:, None] ^ (1 << np.arange(REST, dtype=np.int64))[None, :]).ravel()
    own = anchor.astype(np.int64) << REST | rest[index]
    flipped = np.repeat(anchor[:n].astype(np.int64), REST) << REST | turned
    return np.concatenate([index, np.repeat(np.arange(n), REST)]), np.concatenate([own, flipped]), np.concatenate([home, np.zeros(n * REST, dtype=bool)])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a text: A-Z lowered, words split at ASCII white space, XXH64 of each shingle, majority per bit."""
    w = text.lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    ends = list(accumulate((len(x) + 1 for x in w), initial=-1))[1:]
    k = min(shingle, len(w))
    starts = [0, *(e + 1 for e in ends[: len(w) - k])]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[k - 1 :], strict=True)], dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and bits (bigint, the bits of the unsigned fingerprint) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "bits"])

    return texts(docs, binary=True).mapInArrow(run, "doc_id bigint, bits bigint")


def link(prints: DataFrame, max_distance: int = 3) -> DataFrame:
    """Edges (a, b) between nodes of linked fingerprints that join all that links join. ``prints``: node (unique bigint) and bits, distinct."""
    if max_distance > 3:
        raise ValueError("two halves, each reaching one bit further than the code covers, find pairs of at most 3 differing bits")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, bits = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for half in range(2):
                index, cell, home = cells(bits.view(np.uint64) >> np.uint64(32 * half))
                yield pa.RecordBatch.from_arrays([pa.array(cell + (half << (K + REST))), pa.array(home), pa.array(node[index]), pa.array(bits[index])], ["cell", "home", "node", "bits"])

    sent = prints.select("node", "bits").mapInArrow(replicate, "cell bigint, home boolean, node bigint, bits bigint")
    several = lambda c: F.ceil(c / CROWD).cast("int")
    crowded = sent.groupBy("cell").agg(several(F.count(F.when(F.col("home"), 1))).alias("hs"), several(F.count(F.lit(1))).alias("vs")).where("vs > 1 and hs > 0")
    crowded = materialise(crowded, "crowded")
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST else crowded
    hs, vs = F.coalesce("hs", F.lit(1)), F.coalesce("vs", F.lit(1))
    place = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    # where a cell is crowded, homes are also visitors: each home meets each visitor in one (home chunk, visitor chunk)
    asking = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), vs - 1), lambda v: F.struct(place(hs, 1).alias("h"), v.alias("v"), F.lit(True).alias("home"))))
    asked = F.when(~F.col("home") | (vs > 1), F.transform(F.sequence(F.lit(0), hs - 1), lambda h: F.struct(h.alias("h"), place(vs, 2).alias("v"), F.lit(False).alias("home"))))
    none = F.array().cast("array<struct<h:int,v:int,home:boolean>>")
    dealt = sent.join(crowded, "cell", "left").select("cell", "node", "bits", F.explode(F.concat(F.coalesce(asking, none), F.coalesce(asked, none))).alias("at"))
    groups = max(64, prints.count() * COPIES // GROUP)
    keyed = dealt.select(F.pmod(F.xxhash64("cell", "at.h", "at.v"), F.lit(groups)).alias("bucket"), "cell", "at.h", "at.v", "at.home", "node", "bits")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "h", "v", "node"], ignore_index=True)
        key = pdf[["cell", "h", "v"]].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
        home, node, bits = pdf["home"].to_numpy(dtype=bool), pdf["node"].to_numpy(dtype=np.int64), pdf["bits"].to_numpy(dtype=np.int64).view(np.uint64)
        size = np.diff(cuts)
        out = [np.empty((0, 2), dtype=np.int64), *(local_links(home[s:e], node[s:e], bits[s:e], max_distance) for s, e in zip(cuts[:-1][size > SMALL], cuts[1:][size > SMALL], strict=True))]
        own = np.repeat(np.arange(len(size)), size)  # the cell of each row
        asks = np.flatnonzero(home & (size[own] > 1) & (size[own] <= SMALL))
        for some in np.array_split(asks, 1 + len(asks) * SMALL // PAIRS):
            many = size[own[some]]
            left = np.repeat(some, many)
            right = np.repeat(cuts[own[some]] - np.cumsum(many) + many, many) + np.arange(len(left))
            close = (left != right) & (np.bitwise_count(bits[left] ^ bits[right]) <= max_distance)
            out.append(np.column_stack([node[left[close]], node[right[close]]]))
        pairs = np.concatenate(out)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return keyed.groupBy("bucket").applyInPandas(compare, "a bigint, b bigint")


def local_links(home: np.ndarray, node: np.ndarray, bits: np.ndarray, most: int) -> np.ndarray:
    """(member, least member) over the components of the links between homes and all that came to one cell."""
    at, label = np.flatnonzero(home), np.arange(len(node))
    step = max(1, PAIRS // len(node))
    for s in range(0, len(at), step):
        rows = at[s : s + step]
        close = np.bitwise_count(bits[rows][:, None] ^ bits[None, :]) <= most
        for i in np.flatnonzero(close.sum(axis=1) > 1):
            met = np.unique(label[close[i]])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    moved = np.flatnonzero(label != np.arange(len(node)))
    return np.column_stack([node[moved], node[label[moved]]])


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """doc_id, bits, component_id (smallest doc_id reachable over links of at most ``max_distance`` bits)."""
    prints = materialise(fingerprints(docs, shingle), "prints")
    distinct = materialise(prints.groupBy("bits").agg(F.min("doc_id").alias("node")), "distinct")
    groups = components(link(distinct.where("node is not null"), max_distance))
    placed = distinct.join(groups, "node", "left").select("bits", F.coalesce("component", "node").alias("component_id"))
    return prints.join(placed, "bits", "left").select("doc_id", "bits", "component_id")


def hex16(word: Column) -> Column:
    return F.lower(F.lpad(F.hex(word), 16, "0"))


SIMILAR, SHINGLE = 0.8, 5
BANDS, ROWS = 40, 6  # two texts of similarity 0.8 share no band with a probability of (1 - 0.8^6)^40 = 5e-6
ALIKE = 162  # least equal values of the 240: at similarity 0.8 on average 192, standard deviation 6.2
CHUNK = 128  # texts of a group whose shingles a task holds at once, on either side
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the text's shingles, sorted; none for a text without words."""
    w = text.lower().split()
    k = min(shingle, len(w))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), SEED) for i in range(len(w) - k + 1)] if w else [], dtype=np.uint64))


def minima(h: np.ndarray) -> np.ndarray:
    """Least value of each of the BANDS * ROWS hash functions over a set of hashes."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 512):
        x = h[at : at + 512, None] * _ODD[None, :]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, x.min(axis=0))
    return least


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text), bits (its fingerprint), node (of its set of shingles; null without words), mark (a byte of each minimum), bands for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            node, mark, bands, bits = [], [], [], []
            for text in batch.column(2):
                x = shingle_set(text.as_py())
                m = minima(x)
                bits.append(fingerprint(text.as_py()))
                node.append(int(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).view(np.int64)) if len(x) else None)
                mark.append(m.astype(np.uint8).tobytes())
                bands.append([xxhash.xxh3_64_intdigest(m[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)] if len(x) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(bits, dtype=np.uint64).view(np.int64)), pa.array(node, pa.int64()), pa.array(mark, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "h", "bits", "node", "mark", "bands"])

    return hashed(docs).mapInArrow(run, "doc_id bigint, h bigint, bits bigint, node bigint, mark binary, bands array<bigint>")


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def with_shingles(rows: DataFrame) -> DataFrame:
    """The last column, text, replaced by the bytes of its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                *head, text = batch.slice(at, 256).columns
                yield pa.RecordBatch.from_arrays([*head, pa.array([shingle_set(t.as_py()).tobytes() for t in text], pa.binary())], names)

    names = [*rows.columns[:-1], "shingles"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, shingles binary")


def similar(pdf: pd.DataFrame) -> pd.DataFrame:
    """(a, b): the links of a cell's askers with all its texts, one for each part of its components that a link joins."""
    pdf = pdf.sort_values(["node", "asks"], ascending=[True, False]).drop_duplicates("node")
    node, sets = pdf["node"].to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in pdf["shingles"]]
    marks = np.frombuffer(b"".join(pdf["mark"]), dtype=np.uint8).reshape(len(pdf), -1)
    label, out = pdf["part"].to_numpy().copy(), []  # parts: texts already known to be linked
    for i in np.flatnonzero(pdf["asks"].to_numpy(dtype=bool)):
        for j in np.flatnonzero((marks == marks[i]).sum(axis=1) >= ALIKE):
            if label[i] != label[j] and jaccard(sets[i], sets[j]) >= SIMILAR:
                out.append((node[i], node[j]))
                label[label == label[j]] = label[i]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def similar_links(prints: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of ``prints`` (node, doc_id, h, mark, bands) that join all of similarity SIMILAR or more.

    Nodes that share a band, also over others, are a group. Every node is compared with its group's least node; those
    that are not linked to it with every node of the group. Groups are dealt over cells of CHUNK nodes on either side.
    """
    banded = prints.select("node", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most").select("band", "b")
    groups = materialise(components(banded.join(least, "band").where("node <> b").select(F.col("node").alias("a"), "b")), "groups")
    wide = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("n")).where("n > 1")  # a row for CHUNK nodes or more
    chunks = F.coalesce("n", F.lit(1))
    dealt = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    wanted = prints.select("node", "doc_id", "h", "mark").join(groups, "node").join(wide, "component", "left").withColumn("j", dealt(chunks)).dropDuplicates(["node"])
    body = hashed(docs).join(wanted, ["doc_id", "h"]).select("component", "n", "j", "node", "mark", "text")
    rows = materialise(with_shingles(body), "rows")  # only texts of groups; the others' sets are never kept
    names = ["component", "i", "j", "asks", "part", "node", "mark", "shingles"]

    head = rows.where("node = component").withColumn("j", F.explode(F.sequence(F.lit(0), chunks - 1)))
    first = head.withColumn("asks", F.lit(True)).unionByName(rows.where("node <> component").withColumn("asks", F.lit(False)))
    first = first.select("component", F.lit(0).alias("i"), "j", "asks", F.col("node").alias("part"), "node", "mark", "shingles")
    found = materialise(first.groupBy("component", "i", "j").applyInPandas(similar, "a bigint, b bigint"), "found")

    near = found.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("near", F.lit(True))
    slim = rows.select("component", "node").distinct().join(near, "node", "left").withColumn("near", F.col("near").isNotNull() | (F.col("node") == F.col("component")))
    slim = materialise(slim.withColumn("part", F.when(F.col("near"), F.col("component")).otherwise(F.col("node"))), "slim")
    rest = slim.where("not near").groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("m"))
    rows = rows.join(slim.join(rest, "component").select("node", "near", "part", "m"), "node")
    asking = rows.where("not near").withColumn("i", dealt(F.col("m") * chunks) % F.col("m"))
    asking = asking.withColumn("j", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn("asks", F.lit(True))
    asked = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("asks", F.lit(False))
    second = asking.select(*names).unionByName(asked.select(*names))
    return found.unionByName(second.groupBy("component", "i", "j").applyInPandas(similar, "a bigint, b bigint"))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of ``prints`` (node, bits) that join all whose fingerprints are linked or equal."""
    same = materialise(prints.groupBy("bits").agg(F.min("node").alias("b"), F.max("node").alias("most")), "fingerprints")
    equal = prints.join(same.where("b <> most").select("bits", "b"), "bits").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    return equal.unionByName(link(same.select(F.col("b").alias("node"), "bits")))


def keep_one(docs: DataFrame, by_fingerprint: bool = False) -> DataFrame:
    """Of each group of near-duplicates the row of smallest doc_id stays.

    Texts are linked where their sets of five-word shingles are similar by SIMILAR or more: those that share a band of minima are candidates,
    and each link is verified. With ``by_fingerprint`` they are also linked as op2_simhash links them (fingerprints of three-word shingles at
    most 3 bits apart, by anchor covering); groups then follow both kinds of links, as each misses a part of the other's.
    Texts without words have nothing to compare and stay. Of repeated rows one stays. Rows whose doc_id is null stay.
    """
    named = docs.where("doc_id is not null")
    prints = materialise(shingled(named), "prints")
    whole = prints.where("node is not null")
    owner = whole.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("own"))
    distinct = materialise(owner.select("node", "own.doc_id", "own.h"), "distinct")
    links = similar_links(whole.join(distinct, ["node", "doc_id", "h"], "left_semi"), named)
    groups = components(fingerprint_links(whole).unionByName(links) if by_fingerprint else links)
    least = distinct.join(groups, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min(F.struct("doc_id", "h")).alias("own"))
    keep = least.select("own.doc_id", "own.h").unionByName(prints.where("node is null").select("doc_id", "h")).distinct()
    kept = packed(named).select("row", "doc_id", F.xxhash64("text").alias("h")).join(keep, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("bits")).alias("fingerprint"), "component_id")
