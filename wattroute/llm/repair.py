"""Conversation structure repair: the cheapest edits that make a conversation's role initials read ``(s?(ua)+)?``.

Method: Wu-Manber-style cost layers. The grammar has four states (nothing yet, after system, after user, after assistant).
Layer k holds for each turn the bitset of states from which the end of a block can be reached at a cost of exactly k; it follows
from the layers of lower cost by shifts and masks. The first layer whose bitset at the first turn holds a state gives the
cost from there, and following the bits from turn to turn, the least letter first, gives the least audit.

Edits and costs: Keep 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty user or assistant turn) 5; blank and
duplicate rows must be deleted, truncated rows that stay cost 5 more.

Scale: a conversation's rows are dealt by range over (conv_id, turn, role, digest), so one of any length is cut into blocks of
BLOCK rows in as many tasks as it needs; each block is solved for every pair of entry and exit states, and the blocks' small
tables are joined in order. That join is exact: inserts stand before a row of their block, so no audit of a block is the beginning of
another and the least whole audit is made of least parts. Only the last pass, a SHA-256 over a conversation's text, must
see the turns of a conversation one after another; it streams them and holds none.

Defined cases: null role or text is one space (so is a null conv_id or turn in the damage key); an empty role, like any
other role that does not begin with s, u or a, can't be kept; turns of the same number are ordered by role, then by the
SHA-256 of their text; repeated rows are all there, the later ones duplicates; a null conv_id is a conversation; a
conversation without rows after the damage has zeros, an empty audit and the hash of nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattroute.llm.common import materialise, sql_crc32, table

BLOCK = 256  # rows of a conversation that are solved at once
SPACE = " \t\n\x0b\x0c\r"
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
START, S, U, A = range(4)
NEXT = (U, U, A, U)  # the only user or assistant turn that may follow each state
FAULTS = ["", "blank", "duplicate", "truncated"]


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: nulls of role and text made one space."""
    space = F.lit(" ")
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(1).cast("bigint").alias("copies"))


def damage(rows: DataFrame) -> DataFrame:
    """The planted faults: what crc32(conv_id:turn) % 20 says is done to each row."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    hit = F.crc32(key.cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(hit == 4, "user").otherwise(F.col("role"))
    copies = F.col("copies") * F.when(hit == 3, 2).otherwise(1)
    return rows.where(hit != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """Adds digest and fault (an index of FAULTS): of equal rows one is left, with their number in copies.

    Of the rows of one conversation, role and text only the first is no duplicate, which a minimum over slim rows tells.
    """
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    one = rows.withColumn("digest", F.sha2("text", 256)).groupBy("conv_id", "turn", "role", "digest", "text").agg(F.sum("copies").alias("copies"))
    order = F.struct(F.col("turn").isNotNull(), "turn")
    first = one.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(order)["turn"].alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    fault = F.when(last == "", 1).when(~F.col("turn").eqNullSafe(F.col("first")), 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return one.join(first, same).select("conv_id", "turn", "role", "digest", "text", "copies", fault.alias("fault"))


def spread(x: int, to: int) -> int:
    """The bits of state ``to`` (for each exit) given to all states that lead there by a user or assistant turn."""
    b = x >> to & 0x1111
    return b | b << S | b << A if to == U else b << U


def kept(x: int, initial: str) -> int:
    """States (for each exit) from which keeping a row of this initial leads into ``x``."""
    if initial == "s":
        return (x >> S & 0x1111) << START
    return spread(x, U) if initial == "u" else spread(x, A) if initial == "a" else 0


def solve(rows: list[tuple[str, int]]) -> list[tuple[int, str] | None]:
    """For each entry * 4 + exit: least cost and least audit of a block of (initial, fault), or None.

    ``layers[k][i]``: bit exit * 4 + state is set if the block's end is reached in ``exit`` from ``state`` before row i at cost k.
    """
    n = len(rows)
    out: list[tuple[int, str] | None] = [None] * 16
    layers: list[list[int]] = []
    none = [0] * (n + 1)
    wanted = 0
    for entry, reach in ((START, (START, U, A)), (S, (S, U, A)), (U, (U, A)), (A, (U, A))):
        for end in reach:
            wanted |= 1 << end * 4 + entry
    if any(i == "s" and f in (0, 3) for i, f in rows):
        wanted |= 1 << S * 4 + START
    k = 0
    while wanted:
        now = [0] * (n + 1)
        layers.append(now)
        below = lambda cost: layers[k - cost] if cost <= k else none  # noqa: B023, E731
        if k == 0:
            now[n] = sum(1 << s * 5 for s in range(4))
        gone, put = below(DELETE), below(INSERT)
        stay = [(now, below(REROLE)), (below(TRUNCATED), below(TRUNCATED + REROLE))]
        for i in range(n - 1, -1, -1):
            initial, fault = rows[i]
            x = gone[i + 1]
            if fault in (0, 3):
                keep, other = stay[fault == 3]
                x |= kept(keep[i + 1], initial) | spread(other[i + 1], U) | spread(other[i + 1], A)
            now[i] = x | spread(put[i], U) | spread(put[i], A)
        for bit in range(16):
            if now[0] & wanted & 1 << bit:
                out[bit % 4 * 4 + bit // 4] = (k, trace(rows, layers, bit % 4, bit // 4, k))
                wanted &= ~(1 << bit)
        k += 1
    return out


def trace(rows: list[tuple[str, int]], layers: list[list[int]], state: int, end: int, k: int) -> str:
    """Letters of the least audit, found along the bits of the layers: Delete, Insert, Keep, Rerole in ASCII order."""
    out, i = [], 0
    has = lambda cost, at, s: 0 <= k - cost and layers[k - cost][at] >> end * 4 + s & 1
    while i < len(rows):
        initial, fault = rows[i]
        more = TRUNCATED * (fault == 3)
        to = {"s": S, "u": U, "a": A}.get(initial) if fault in (0, 3) else None
        if to is not None and (state != START if to == S else NEXT[state] != to):
            to = None
        if has(DELETE, i + 1, state):
            out.append("D")
            k, i = k - DELETE, i + 1
        elif has(INSERT, i, NEXT[state]):
            out.append("I")
            k, state = k - INSERT, NEXT[state]
        elif to is not None and has(more, i + 1, to):
            out.append("K")
            k, i, state = k - more, i + 1, to
        else:
            out.append("R")
            k, i, state = k - more - REROLE, i + 1, NEXT[state]
    return "".join(out)


def solved(slim: DataFrame, size: int = BLOCK) -> DataFrame:
    """conv_id, part, block, costs, audits (entry * 4 + exit; null where there is no way) of each block of ``size`` sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, conv, held, more = TaskContext.get().partitionId(), 0, None, [], 0
        cache: dict[tuple, list] = {}

        def flush() -> pa.RecordBatch:
            key = tuple(held)
            got = cache.get(key) or solve(held)
            if len(cache) < 100_000 and len(key) <= 16:
                cache[key] = got
            tail = "D" * more
            costs, audits = [g and g[0] + DELETE * more for g in got], [g and g[1] + tail for g in got]
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([costs], pa.list_(pa.int64())), pa.array([audits], pa.list_(pa.string()))], ["conv_id", "part", "block", "costs", "audits"])

        for batch in batches:
            for c, initial, fault, copies in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and (c != conv or len(held) >= size or more):
                    yield flush()
                    block, held, more = block + 1, [], 0
                conv = c
                held.append((initial, fault))
                more = copies - 1  # further copies are duplicates (or blank): deleted
        if held:
            yield flush()

    return slim.select("conv_id", F.substring("role", 1, 1).alias("initial"), "fault", "copies").mapInArrow(run, "conv_id bigint, part int, block bigint, costs array<bigint>, audits array<string>")


def chained(blocks: DataFrame) -> DataFrame:
    """conv_id, cost, audit of each conversation, its blocks taken in order. What is held grows with the audit alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ways = None, None  # ways: state -> (cost, rank among the states' audits, (parts before, part))

        def finish() -> pa.RecordBatch:
            ends = [(cost + INSERT * lack, rank, chain, "I" * lack) for s, lack in ((START, 0), (S, 2), (U, 1), (A, 0)) if s in ways for cost, rank, chain in [ways[s]]]
            cost, _, chain, more = min(ends, key=lambda e: e[:2])
            parts = [more]
            while chain:
                chain, part = chain
                parts.append(part)
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([cost], pa.int64()), pa.array(["".join(reversed(parts))])], ["conv_id", "cost", "audit"])

        for batch in batches:
            for c, costs, audits in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if ways is None or c != conv:
                    if ways is not None:
                        yield finish()
                    conv, ways = c, {START: (0, 0, None)}
                best = {}
                for s, (cost, rank, chain) in ways.items():
                    for e in range(4):
                        if costs[s * 4 + e] is not None:
                            best[e] = min([*([best[e]] if e in best else []), (cost + costs[s * 4 + e], rank, audits[s * 4 + e], chain)], key=lambda w: w[:3])
                ranked = sorted(best, key=lambda e: best[e][1:3])
                ways = {e: (best[e][0], ranked.index(e), (best[e][3], best[e][2])) for e in best}
        if ways is not None:
            yield finish()

    ordered = blocks.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "part", "block")
    return ordered.select("conv_id", "costs", "audits").mapInArrow(run, "conv_id bigint, cost bigint, audit string")


RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def repaired(stream: DataFrame) -> DataFrame:
    """One row for each conversation: counts, audit and the hash of the repaired turns, as its header row and turns stream by."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    class Talk:
        def __init__(self, conv: int | None, cost: int, audit: str):
            self.conv, self.cost, self.audit = conv, cost, audit
            self.at, self.state, self.hash, self.some = 0, START, hashlib.sha256(), False
            self.low, self.high, self.turns, self.before = None, None, 0, None
            self.count, self.illegal = [0, 0, 0, 0], 0

        def put(self, role: str, text: str) -> None:
            self.hash.update(("\n" * self.some + f"{role}:{text}").encode())
            self.some = True

        def inserts(self) -> None:
            while self.audit[self.at : self.at + 1] == "I":
                self.state = NEXT[self.state]
                self.put("user" if self.state == U else "assistant", "")
                self.at += 1

        def row(self, turn: int | None, role: str, text: str, copies: int, fault: int) -> None:
            initial = role[:1]
            if self.before is not None:
                self.illegal += self.before + initial not in ("su", "ua", "au")
            self.illegal += copies - 1  # a row and its copy
            self.before = initial
            self.count[fault] += 1
            self.count[1 if fault == 1 else 2] += copies - 1
            if turn is not None:
                self.turns += turn != self.high
                self.low, self.high = turn if self.low is None else self.low, turn
            self.inserts()
            letter = self.audit[self.at]
            if letter == "K":
                self.state = {"s": S, "u": U, "a": A}[initial]
                self.put(role, text)
            elif letter == "R":
                self.state = NEXT[self.state]
                self.put("user" if self.state == U else "assistant", text)
            self.at += copies

        def end(self) -> list:
            self.inserts()
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            return [self.conv, gaps, *self.count[1:], self.illegal, self.cost, self.audit, self.hash.hexdigest()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk, done, size = None, [], 0

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for conv, head, turn, role, text, copies, fault in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not head:
                    talk.row(turn, role, text, copies, fault)
                    continue
                if talk:
                    done.append(talk.end())
                    size += len(talk.audit) + 200
                if size > 1 << 20:
                    yield flush()
                    done, size = [], 0
                talk = Talk(conv, copies, text)
        if talk:
            done.append(talk.end())
            yield flush()

    return stream.select("conv_id", "head", "turn", "role", "text", "copies", "fault").mapInArrow(run, RESULT)


def repair(rows: DataFrame, original: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``rows``: as numbered() gives them. ``original``: the table whose conv_ids are all returned, ``rows`` unless given.
    """
    marked = materialise(faults(rows), "turns")
    slim = marked.select("conv_id", "turn", "role", "digest", "copies", "fault")
    blocks = solved(slim.repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest"), block)
    audits = chained(blocks).withColumnRenamed("conv_id", "c")
    convs = (rows if original is None else original).select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    zero, nothing = F.lit(0).cast("bigint"), F.lit("")
    # a header before the turns of each conversation: its audit stands in text, its cost in copies
    heads = convs.join(audits, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", F.lit(True).alias("head"), F.lit(None).cast("bigint").alias("turn"), nothing.alias("role"), nothing.alias("digest"),
        F.coalesce("audit", nothing).alias("text"), F.coalesce("cost", zero).alias("copies"), F.lit(0).alias("fault"),
    )
    turns = marked.select("conv_id", F.lit(False).alias("head"), "turn", "role", "digest", "text", "copies", "fault")
    order = ["conv_id", F.desc("head"), "turn", "role", "digest"]
    return repaired(heads.unionByName(turns).repartition(F.col("conv_id")).sortWithinPartitions(*order))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(table(spark, sf_dir, "conversations"))
    return repair(damage(rows), rows)


def _sql() -> str:
    """The same in DuckDB: a fold over a conversation's turns that keeps for each grammar state cost, audit and repaired turns as one string."""
    start, s, u, a = (f"acc[{i}]" for i in range(1, 5))

    def edit(x: str, cost: str, letter: str, add: str = "''") -> str:
        grown = f"lpad((left(z, 9)::bigint + {cost})::varchar, 9, '0') || substr(z, 10, strpos(z, chr(10)) - 10) || '{letter}' || substr(z, strpos(z, chr(10))) || {add}"
        return f"list_transform([{x}], lambda z: case when z is not null then {grown} end)[1]"

    least = lambda *x: f"least({', '.join([*x, 'null'])})"
    in_u, in_a = edit(least(start, s, a), "5", "I", "chr(10) || 'user:'"), edit(u, "5", "I", "chr(10) || 'assistant:'")
    before = f"[{start}, {s}, {least(u, in_u)}, {least(a, in_a)}]"
    own, more = "chr(10) || row[3] || ':' || row[4]", "case when row[2] = '3' then 5 else 0 end"
    stays = lambda i, x: f"case when row[2] in ('0', '3') and row[1] = '{i}' then {edit(x, more, 'K', own)} end"
    turned = lambda role, x: f"case when row[2] in ('0', '3') then {edit(x, f'({more} + 1)', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || row[4]')} end"
    to_u, to_a = least("b[1]", "b[2]", "b[4]"), "b[3]"
    gone = [edit(x, "2", "D") for x in (start, s, u, a)]
    after = ", ".join([gone[0], least(gone[1], stays("s", "b[1]")), least(gone[2], stays("u", to_u), turned("user", to_u)), least(gone[3], stays("a", to_a), turned("assistant", to_a))])
    step = f"list_transform([{before}], lambda b: [{after}])[1]"
    ends = least("f[1]", edit(edit("f[2]", "5", "I", "chr(10) || 'user:'"), "5", "I", "chr(10) || 'assistant:'"), edit("f[3]", "5", "I", "chr(10) || 'assistant:'"), "f[4]")
    crc = sql_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")
    return f"""
with o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as hit from conversations),
d as (select conv_id, turn, case when hit = 4 then 'user' else role end as role, case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when hit = 3 then 2 else 1 end)) as copy from o where hit <> 0),
l as (select *, sha256(text) as digest, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth from d),
t as (select *, case when last = '' then 1 when nth > 1 then 2 when last not in ('.', '!', '?') then 3 else 0 end as fault, left(role, 1) as initial,
  lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, digest, copy) as previous from l),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate, count(*) filter (where fault = 3) as truncated,
  count(*) filter (where previous is not null and previous || initial not in ('su', 'ua', 'au')) as illegal, list([initial, fault::varchar, role, text] order by turn nulls first, role, digest, copy) as turns from t group by conv_id),
f as (select conv_id, gaps, blank, duplicate, truncated, illegal, list_reduce(turns, lambda acc, row: {step}, ['000000000' || chr(10), null, null, null]) as f from c),
e as (select *, {ends} as best from f),
g as (select *, left(best, 9)::bigint as cost, substr(best, 10, strpos(best, chr(10)) - 10) as audit, substr(best, strpos(best, chr(10)) + 2) as repaired from e)
select i.conv_id, coalesce(g.gaps, 0)::bigint as gaps, coalesce(g.blank, 0)::bigint as blank, coalesce(g.duplicate, 0)::bigint as duplicate, coalesce(g.truncated, 0)::bigint as truncated, coalesce(g.illegal, 0)::bigint as illegal,
  coalesce(g.cost, 0)::bigint as cost, coalesce(g.audit, '') as audit, sha256(coalesce(g.repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join g on g.conv_id is not distinct from i.conv_id"""


SQL = _sql()
