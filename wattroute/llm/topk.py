"""Exact top-k inner-product search, term at a time.

Vectors are cut into integers floor(64 x). Queries and candidates are packed into blocks of rows; each pair of a query
block and a candidate block is one unit of work, and units are dealt over the tasks. In a unit every dimension (term) has
its posting list of candidates with a non-zero weight; the weights of TILE queries are scattered through it into a dense
array of scores that fits in a processor cache. A partition selection keeps k for each query, and the units' selections are
merged by query. A stated query set against all rows, in blocks: no cross join of rows, and a unit's memory is bounded by
the block sizes.

Scores accumulate in 32 bits where dimensions times the largest weights prove that nothing can overflow, else in 64 bits.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without vec_id, take no part; an
empty vector scores 0 with all; a dimension that one vector lacks counts as zero; repeated rows (equal ids, equal or different
vectors) are queries and candidates each on their own: a row is excluded from its own list only, by row and not by id;
ties go to the smaller id; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattroute.llm.common import materialise, table

K, EVERY = 20, 20
QUERY_BLOCK, BLOCK = 2048, 8192  # rows of a unit on either side
TILE = 8  # queries whose scores are accumulated together
UNIT_PARTS = 20_000  # partitions at most that units are dealt over
PACKED = "block bigint, dims int, top bigint, width int, row_numbers binary, ids binary, w binary"


def dense(lists: pa.ListArray) -> np.ndarray:
    """Rows of a matrix out of lists, zero where a list is shorter."""
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(at.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1])[None, :] < at[:, None]] = flat
    return out


def narrow(top: int) -> np.dtype:
    return np.dtype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")


def pack(rows: DataFrame, blocks: int) -> DataFrame:
    """One row for each block (rows are dealt by a hash of their number): its number, row numbers, ids and weights, by vec_id."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("vec_id", "ascending"), ("row_number", "ascending")]).combine_chunks()
        w = dense(t.column("v").combine_chunks())
        top = max(abs(int(w.max(initial=0))), abs(int(w.min(initial=0))))
        values = [t.column("block")[0].as_py(), w.shape[1], top, narrow(top).itemsize, *(t.column(c).to_numpy().tobytes() for c in ("row_number", "vec_id")), w.astype(narrow(top)).tobytes()]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["block", "dims", "top", "width", "row_numbers", "ids", "w"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row_number"), F.lit(blocks)))
    return dealt.select("block", "row_number", "vec_id", "v").groupBy("block").applyInArrow(run, PACKED)


def accumulate(q: np.ndarray, postings: list[tuple[np.ndarray | None, np.ndarray]], scores: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Scores of a few queries with all candidates of a block, one term after the other; (None, w): a posting for every candidate."""
    scores[:] = 0
    for term in range(min(q.shape[1], len(postings))):
        at, w = postings[term]
        weight = q[:, term]
        if not len(w) or not weight.any():
            continue
        if at is None:
            np.multiply(weight[:, None], w[None, :], out=spare)
            scores += spare
        else:
            scores[:, at] += weight[:, None] * w[None, :]
    return scores


def select(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) of the k highest scores of each query without its own row; ties to the earlier candidate."""
    some = np.flatnonzero(own >= 0)
    least = np.iinfo(scores.dtype).min  # below every score
    scores[some, own[some]] = least
    n = scores.shape[1]
    if n <= k:
        return np.nonzero(scores > least)
    bar = np.partition(scores, n - k, axis=1)[:, n - k]
    row, col = np.nonzero((scores >= bar[:, None]) & (scores > least))
    tie = scores[row, col] == bar[row]
    room = k - np.bincount(row[~tie], minlength=len(scores))
    first = np.searchsorted(row, np.arange(len(scores)))
    upto = np.cumsum(tie)
    place = upto - np.concatenate([[0], upto])[first[row]]
    keep = ~tie | (place <= room[row])
    return row[keep], col[keep]


def search(vectors: DataFrame, asks, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, v array<bigint>) for which the column ``asks`` holds."""
    vectors = materialise(vectors.select("vec_id", "v", asks.alias("asks"), F.monotonically_increasing_id().alias("row_number")), "vectors")
    n, m = (vectors.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("m")).first())[:2]
    blocks, asked = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_BLOCK))
    cut = lambda rows, count, side, mine, others: pack(rows, count).select(
        F.lit(side).alias("side"), F.col("block").alias(mine), "dims", "top", "width", "row_numbers", "ids", "w", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint"))).alias("q" if mine == "c" else "c")
    )
    units = cut(vectors.where("asks"), asked, 0, "q", blocks).unionByName(cut(vectors, blocks, 1, "c", asked))
    units = units.withColumn("unit", F.col("q") * blocks + F.col("c")).drop("q", "c").repartition(min(UNIT_PARTS, 2 * blocks * asked), "unit")

    def run(unit: pa.Table) -> pa.Table:
        sides = {r["side"]: r for r in unit.to_pylist()}
        out = [np.zeros((4, 0), dtype=np.int64)]
        if len(sides) == 2:
            q_rows, rows = (np.frombuffer(sides[s]["row_numbers"], dtype=np.int64) for s in (0, 1))
            q_ids, ids = (np.frombuffer(sides[s]["ids"], dtype=np.int64) for s in (0, 1))
            q, w = (np.frombuffer(r["w"], dtype=f"<i{r['width']}").reshape(-1, r["dims"]) if r["dims"] else np.zeros((len(r["ids"]) // 8, 0), dtype=np.int16) for r in (sides[0], sides[1]))
            proven = sides[0]["top"] * sides[1]["top"] * max(1, min(q.shape[1], w.shape[1])) < 1 << 31
            kind = np.int32 if proven else np.int64
            postings = []
            for column in np.ascontiguousarray(w.T).astype(kind):
                at = np.flatnonzero(column)
                postings.append((None, column) if 2 * len(at) > len(column) else (at, column[at]))
            order = np.argsort(rows)
            place = np.minimum(np.searchsorted(rows[order], q_rows), len(rows) - 1)
            own = np.where(rows[order][place] == q_rows, order[place], -1)
            q, scores, spare = q.astype(kind), np.empty((TILE, len(ids)), dtype=kind), np.empty((TILE, len(ids)), dtype=kind)
            for at in range(0, len(q), TILE):
                some = q[at : at + TILE]
                s = accumulate(some, postings, scores[: len(some)], spare[: len(some)])
                row, col = select(s, own[at : at + TILE], k)
                out.append(np.stack([q_rows[at + row], q_ids[at + row], ids[col], s[row, col].astype(np.int64)]))
        got = np.concatenate(out, axis=1)
        return pa.table({"query_row": got[0], "query_id": got[1], "vec_id": got[2], "score": got[3]})

    got = units.groupBy("unit").applyInArrow(run, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def weights(embeddings: DataFrame) -> DataFrame:
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & good)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * 64).cast("bigint")).alias("v"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(weights(table(spark, sf_dir, "embeddings")), F.col("vec_id") % EVERY == 0)


SQL = f"""
with e as materialized (select row_number() over () r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id query_id, c.vec_id vec_id,
  cast(coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) as bigint) score
  from (select * from e where vec_id % {EVERY} = 0) q join e c on q.r <> c.r)
select query_id, cast(rank as integer) rank, vec_id, score from
  (select *, row_number() over (partition by r order by score desc, vec_id) rank from s) where rank <= {K}
"""
