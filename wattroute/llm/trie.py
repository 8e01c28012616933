"""Conversation prefix trie: a node for every distinct beginning of the (role, text) sequences.

Method: distributed MSD radix partitioning. Turns are numbered by a dictionary of the distinct (role, text), a conversation becomes a row of
numbers, equal conversations become one weighted row. All rows start in the root's bucket; each round deals every bucket over
its next digit (the next turn's number) and emits nodes, skipping the digits that all rows of a bucket share at once. A bucket of
few turns (LOCAL) or of one sequence is local: it goes to one task, which finishes it by multikey quicksort (three-way partitions around a
digit), whose recursion, kept on a stack of its own, emits the nodes. What nodes add up over their subtrees goes from the
local buckets up through the rounds' buckets, which are few: each holds more than LOCAL turns.

Scale: texts are never shuffled, only digests of 32 bytes and numbers of 8; a hot first turn or a hot whole conversation is a digit of a
bucket or a weight of a row, summed in the tasks before any shuffle. Rounds follow the branchings of large buckets, not the turns. A
conversation is one row of 12 bytes a turn. The hash over the members that end at a node must see their numbers in order; it streams them.

Defined cases: null role or text is empty; rows of null conv_id take no part; turns of the same number are ordered by the SHA-256
of role and text; repeated rows are turns of their own; an empty table gives no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattroute.llm.common import materialise, sql_crc32, table

LOCAL = 50_000  # turns below a bucket that one task finishes
FAMILY, TAKEN = 100, 6
NOTHING = hashlib.sha256(b"").hexdigest()


def encoded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, id (of the turn's role and text in a dictionary), size (code points of its text)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"), F.length(text).alias("size"))
    turns = materialise(turns, "turns")
    words = materialise(turns.select("digest").distinct().sort("digest").withColumn("id", F.monotonically_increasing_id()), "dictionary")
    return turns.join(words, "digest").select("conv_id", "turn", "id", "size")


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, seq array<struct<id, size>>: the turns of each conversation in order."""
    each = F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has"), "turn", "id", "size")))
    return turns.groupBy("conv_id").agg(each.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))).alias("seq"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Each conversation's first turns replaced by those of the conversation that leads its hundred."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN
    lead = seqs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, TAKEN - 1).alias("first"))
    own = seqs.withColumn("h", h.cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    none = F.expr("slice(seq, 1, 0)")
    both = F.concat(F.slice(F.coalesce("first", none), F.lit(1), F.col("h")), F.expr("slice(seq, h + 1, size(seq))"))
    return own.join(lead, "base", "left").select("conv_id", both.alias("seq"))


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """ids, sizes, n (conversations of this sequence), lo (the smallest) and ends (the hash of all of them)."""
    flat = seqs.select("conv_id", F.col("seq.id").alias("ids"), F.col("seq.size").alias("sizes"))
    keyed = materialise(flat.withColumn("key", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)), "sequences")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, lo, h = None, 0, 0, None
        make = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([n], pa.int64()), pa.array([lo], pa.int64()), pa.array([h.hexdigest()])], ["key", "n", "lo", "ends"])
        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        yield make()
                    now, n, lo, h = key, 0, conv, hashlib.sha256()
                h.update(f"{',' if n else ''}{conv}".encode())
                n += 1
        if now is not None:
            yield make()

    ordered = keyed.select("key", "conv_id").repartition(F.col("key")).sortWithinPartitions("key", "conv_id")
    sums = materialise(ordered.mapInArrow(run, "key string, n bigint, lo bigint, ends string"), "sums")
    return materialise(keyed.join(sums.withColumnRenamed("lo", "conv_id"), ["key", "conv_id"]).select("ids", "sizes", "n", F.col("conv_id").alias("lo"), "ends"), "distinct")


NODE = "conv_id bigint, depth int, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
NODES = [c.split()[0] for c in NODE.split(", ")]


def quicksort(items: list[tuple], depth: int, parent: int, nodes: list[list], ends: dict[int, str]) -> None:
    """Appends the nodes below ``depth`` of ``items`` (ids, sizes, n, lo, ends): rows of (lo, depth, parent's place, n, size of the last text)."""
    stack = [(items, depth, parent)]
    while stack:
        items, depth, parent = stack.pop()
        if len(items) == 1:
            ids, sizes, n, lo, end = items[0]
            for d in range(depth, len(ids)):
                nodes.append([lo, d + 1, parent, n, sizes[d]])
                parent = len(nodes) - 1
            ends[parent] = end
            continue
        digit = lambda item: item[0][depth] if len(item[0]) > depth else -1  # noqa: B023, E731
        pivot = digit(items[len(items) // 2])
        less, same, more = [], [], []
        for item in items:
            d = digit(item)
            (same if d == pivot else less if d < pivot else more).append(item)
        for part in (more, less):
            if part:
                stack.append((part, depth, parent))
        if pivot < 0:  # sequences are distinct: one alone ends here
            ends[parent] = same[0][4]
            continue
        nodes.append([min(i[3] for i in same), depth + 1, parent, sum(i[2] for i in same), same[0][1][depth]])
        stack.append((same, depth + 1, len(nodes) - 1))


def finished(rows: DataFrame) -> DataFrame:
    """Nodes of local buckets, rows sorted by (bucket, digit): those of a bucket's first digit have ``top``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        at, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            bucket, _, depth, lo = at
            nodes, ends = [], {}
            quicksort(held, depth, -1, nodes, ends)
            children, leaves, saved = [0] * len(nodes), [0] * len(nodes), [(x[3] - 1) * x[4] for x in nodes]
            for i in range(len(nodes) - 1, -1, -1):
                leaves[i] = leaves[i] or 1
                if (p := nodes[i][2]) >= 0:
                    children[p] += 1
                    leaves[p] += leaves[i]
                    saved[p] += saved[i]
            for s in range(0, len(nodes), 10_000):
                out = [
                    [bucket, p < 0, own, d, lo if p < 0 else nodes[p][0], n, children[i], leaves[i], saved[i], ends.get(i, NOTHING)]
                    for i, (own, d, p, n, _) in enumerate(nodes[s : s + 10_000], s)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "top", *NODES])

        for batch in batches:
            for bucket, digit, depth, above, *item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (bucket, digit, depth, above)
                if held and key != at:
                    yield from flush()
                    held = []
                at = key
                held.append(tuple(item))
        if held:
            yield from flush()

    ordered = rows.repartition(F.col("bucket"), F.col("digit")).sortWithinPartitions("bucket", "digit")
    return ordered.select("bucket", "digit", "depth", "above", "ids", "sizes", "n", "lo", "ends").mapInArrow(run, f"bucket bigint, top boolean, {NODE}")


def trie(unique: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes (NODE) of distinct sequences as distinct_sequences() gives them."""
    if unique.isEmpty():
        return unique.sparkSession.createDataFrame([], NODE)
    zero = F.lit(0).cast("bigint")
    root = unique.agg(F.min("lo").alias("lo"), F.sum("n").alias("n")).select(zero.alias("bucket"), zero.alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("from_depth"), "lo", zero.alias("above"), "n", F.array().cast("array<int>").alias("sizes"))
    big, emitted, levels = materialise(root, "buckets"), [], []  # big: the buckets of a round
    members = unique.withColumn("bucket", zero).withColumn("depth", F.lit(0)).withColumn("above", F.lit(big.first()["lo"]).cast("bigint"))
    while True:
        # digit: the next turn; null where a sequence ends at its bucket's node
        keyed = members.withColumn("digit", F.when(F.size("ids") > F.col("depth"), F.get("ids", F.col("depth"))))
        least = F.min(F.struct("ids", "sizes"))
        stats = keyed.where("digit is not null").groupBy("bucket", "digit", "depth", "above").agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.size("ids") - F.col("depth")).alias("turns"), F.sum("n").alias("n"), F.min("lo").alias("lo"), least.alias("least"), F.max("ids").alias("most")
        )
        heavy = stats.where(f"rows > 1 and turns > {local}")
        differ = F.expr("array_position(zip_with(least.ids, most, (a, b) -> a <=> b), false)")
        shared = F.when(differ > 0, differ - 1).otherwise(F.size("most")).cast("int")
        number = F.monotonically_increasing_id()
        following = materialise(
            heavy.select(number.alias("bucket"), F.col("bucket").alias("parent"), "digit", shared.alias("depth"), F.col("depth").alias("from_depth"), "lo", "above", "n", F.col("least.sizes").alias("sizes")), "buckets"
        )
        marks = following.select(F.col("parent").alias("bucket"), "digit", F.col("bucket").alias("next"), F.col("depth").alias("next_depth"), F.col("lo").alias("next_above"))
        dealt = materialise(keyed.join(marks, ["bucket", "digit"], "left"), "dealt")
        nodes = materialise(finished(dealt.where("digit is not null and next is null")), "nodes")
        ended = dealt.where("digit is null").select("bucket", "ends")  # one row of a bucket at most: sequences are distinct
        emitted.append(nodes.select(*NODES))
        levels.append((big, nodes, ended))
        if following.isEmpty():
            break
        members = dealt.where("next is not null").select("ids", "sizes", "n", "lo", "ends", F.col("next").alias("bucket"), F.col("next_depth").alias("depth"), F.col("next_above").alias("above"))
        big = following
    below = None  # of each bucket of the round before: what its large children add up to
    for big, nodes, ended in reversed(levels):
        sums = nodes.where("top").select("bucket", F.lit(1).cast("bigint").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        if below is not None:
            sums = sums.unionByName(below)
        sums = sums.groupBy("bucket").agg(F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        # the nodes of a bucket: its own and those of the digits that it skipped, each with one child
        whole = materialise(big.join(sums, "bucket", "left").join(ended, "bucket", "left"), "whole")
        deep = F.explode(F.expr("sequence(if(depth = 0, 0, from_depth + 1), depth)"))
        rest = F.aggregate(F.expr("slice(sizes, greatest(at, 1), if(depth = 0, 0, depth - greatest(at, 1) + 1))"), zero, lambda a, x: a + x)
        chain = whole.withColumn("at", deep).withColumn("own", F.col("at") == F.col("depth"))
        emitted.append(
            chain.select(
                F.col("lo").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") == 0, None).when(F.col("at") == F.col("from_depth") + 1, F.col("above")).otherwise(F.col("lo")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                F.when(F.col("own"), F.coalesce("children", zero)).otherwise(1).cast("bigint").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
                (F.coalesce("saved", zero) + (F.col("n") - 1) * rest).cast("bigint").alias("saved_tokens"), F.when(F.col("own"), F.coalesce("ends", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"),
            )
        )
        skipped = F.aggregate(F.expr("slice(sizes, from_depth + 1, depth - from_depth)"), zero, lambda a, x: a + x)
        below = whole.select(F.col("parent").alias("bucket"), F.lit(1).cast("bigint").alias("children"), F.coalesce("leaves", F.lit(1)).cast("bigint").alias("leaves"), (F.coalesce("saved", zero) + (F.col("n") - 1) * skipped).alias("saved"))
    out = emitted[0]
    for more in emitted[1:]:
        out = out.unionByName(more)
    return out


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trie(distinct_sequences(rebuilt(sequences(encoded(table(spark, sf_dir, "conversations"))))))
    return found.withColumn("depth", F.col("depth").cast("bigint"))


SQL = """
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
s as (select conv_id, list({'k': length(role) || ':' || role || text, 'n': length(text)} order by turn nulls first, sha256(length(role) || ':' || role || text)) as seq from t group by conv_id),
h as (select conv_id, seq, conv_id - conv_id % 100 as base, {CRC} % 6 as h from s),
r as (select h.conv_id, list_concat(coalesce(b.seq, [])[1:h.h], h.seq[h.h + 1:]) as seq from h left join s b on b.conv_id = h.base),
p as (select conv_id, unnest(range(0, len(seq) + 1)) as depth, seq from r),
q as (select conv_id, depth, len(seq) as whole, case when depth = 0 then '' else sha256(array_to_string(list_transform(seq[1:depth], lambda x: sha256(x.k)), ',')) end as node,
  case when depth = 0 then null when depth = 1 then '' else sha256(array_to_string(list_transform(seq[1:depth - 1], lambda x: sha256(x.k)), ',')) end as above, case when depth = 0 then 0 else seq[depth].n end as size from p),
n as (select node, any_value(above) as above, any_value(depth) as depth, any_value(size) as size, min(conv_id) as conv_id, count(*) as n_convs,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where whole = depth), '')) as ends_sha256 from q group by node),
c as (select above, count(*) as n_children from n group by above),
f as (select n.*, coalesce(c.n_children, 0) as n_children, p.conv_id as parent_conv_id from n left join c on c.above = n.node left join n p on p.node = n.above),
up as (select distinct f.node, q2.node as top from f join q q1 on q1.node = f.node and q1.conv_id = f.conv_id join q q2 on q2.conv_id = q1.conv_id and q2.depth <= q1.depth),
g as (select up.top, sum(case when f.n_children = 0 then 1 else 0 end) as n_leaves, sum((f.n_convs - 1) * f.size) as saved_tokens from up join f on f.node = up.node group by up.top)
select f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, g.n_leaves::bigint as n_leaves, g.saved_tokens::bigint as saved_tokens, f.ends_sha256 from f join g on g.top = f.node""".replace("{CRC}", sql_crc32("conv_id::varchar"))
