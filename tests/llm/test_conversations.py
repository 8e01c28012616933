"""Conversation repair, WARC archives and the prefix trie: brute force, SQL, round trips and the defined cases."""

import base64
import hashlib
import itertools
import random
import re
import uuid
import zlib

import duckdb
import pandas as pd
import pytest
import zstandard

from wattroute.llm import repair, trie, warc
from wattroute.llm.common import shared_dir

TALK = "conv_id bigint, turn bigint, role string, text string"


def same_rows(df, rows):
    order = lambda r: [(x is not None, x) for x in r]
    assert sorted((tuple(r) for r in df.collect()), key=order) == sorted((tuple(None if x is pd.NA or x != x else x for x in r) for r in rows), key=order)


def by_sql(sql, columns, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(f"select {', '.join(columns)} from ({sql})").fetchall()


def talks(n, seed, turns=8):
    """Random conversations: odd roles, nulls, blanks, repeats, equal turns, gaps."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randrange(turns)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["One.", "Two!", "two", "Wait?  \n", "", " \t", None, "ü.", f"{rng.random()}."])
            rows.append((c, rng.choice([t, t, t, t + 1, None, 2 * t]), role, text))
    return rows


def frame(rows):
    return pd.DataFrame({"conv_id": pd.array([r[0] for r in rows], "Int64"), "turn": pd.array([r[1] for r in rows], "Int64"), "role": pd.Series([r[2] for r in rows], dtype="object"), "text": pd.Series([r[3] for r in rows], dtype="object")})


def edits(rows):
    """Every edit of a few (initial, fault) rows, by plain enumeration: the cheapest, then least audit."""
    gaps = [("", "")] + [("I" * k, "".join(x)) for k in (1, 2) for x in itertools.product("ua", repeat=k)]
    ways = []
    for initial, fault in rows:
        keep = [] if fault in (1, 2) else [(5 * (fault == 3), "K", initial or "-"), *[(5 * (fault == 3) + 1, "R", x) for x in "ua"]]
        ways.append([(2, "D", ""), *keep])
    best = None
    for chosen in itertools.product(*ways):
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(w[0] for w in chosen) + 5 * sum(len(g[0]) for g in between)
            if best and cost > best[0]:
                continue
            letters = "".join(g[0] + w[1] for g, w in zip(between, chosen, strict=False)) + between[-1][0]
            roles = "".join(g[1] + w[2] for g, w in zip(between, chosen, strict=False)) + between[-1][1]
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, letters) < best):
                best = cost, letters
    return best


def test_repair_costs_and_audits_by_enumeration(spark):
    rng, rows, expected = random.Random(5), [], {}
    for c in range(40):
        shape = [(rng.choice("usaxua"), rng.choice([0, 0, 0, 1, 3])) for _ in range(rng.randrange(1, 4))]
        expected[c] = edits(shape)
        role = {"u": "user", "s": "system", "a": "assistant", "x": "tool"}
        rows += [(c, i, role[x], " " if f == 1 else f"text {i}" + "." * (f == 0)) for i, (x, f) in enumerate(shape)]
    for block in (1, 2, 256):
        got = repair.repair(repair.numbered(spark.createDataFrame(rows, TALK)), block=block)
        assert {r.conv_id: (r.cost, r.audit) for r in got.collect()} == expected


@pytest.mark.parametrize("block", [2, 256])
def test_repair_against_sql(spark, block):
    rows = talks(120, 3) + [(500, t, "user", "Same.") for t in range(40)] + [(501, 1, "user", "Same.")] * 9 + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho.")]
    given = repair.numbered(spark.createDataFrame(rows, TALK))
    got = repair.repair(repair.damage(given), given, block)
    same_rows(got, by_sql(repair.SQL, got.columns, conversations=frame(rows)))


def test_repair_of_one_long_conversation(spark):
    """Dealt over many blocks, the same audit as in one block."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", f"{t}."])) for t in range(700)]
    given = repair.numbered(spark.createDataFrame(rows, TALK))
    small, whole = (repair.repair(given, block=b).collect() for b in (16, 1000))
    assert small == whole and len(whole[0].audit.replace("I", "")) == 700


def test_repair_of_odd_tables(spark):
    assert repair.repair(repair.numbered(spark.createDataFrame([], TALK))).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    given = repair.numbered(spark.createDataFrame([(dropped, 0, "user", "Hi.", 1, True)], TALK + ", fault int, head boolean"))
    assert [tuple(r) for r in repair.repair(repair.damage(given), given).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    long = "x" * 3_000_000 + "."
    row = repair.repair(repair.numbered(spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "Ok.")], TALK))).first()
    assert (row.cost, row.audit, row.repaired_sha256) == (0, "KK", hashlib.sha256(f"user:{long}\nassistant:Ok.".encode()).hexdigest())


PAGE = "page_id bigint, url string, html string"


def archive(spark, rows, schema=PAGE, **more):
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    warc.write_warc(spark.createDataFrame(rows, schema), path, **more)
    return path


def test_warc_round_trip(spark):
    rng = random.Random(1)
    pages = [(i, f"http://a.example/{i} x", "".join(rng.choice(["<p>", "wörd ", "\r\n\r\n", "\0"]) for _ in range(rng.randrange(400)))) for i in range(60)]
    pages += [(100 + i, "u", pages[i % 3][2]) for i in range(30)] + [(200, "u", ""), (201, None, None), (None, "u", ""), (None, "n", "only"), (7, "again", pages[7][2])]
    path = archive(spark, pages)
    got = warc.read_warc(spark, path, with_payload=True).collect()
    least = {}
    for i, _, html in pages:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    expected = []
    for i, url, html in pages:
        raw, first = (html or "").encode(), least.get(html or "")
        other = None if first is None or first == i else first
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        expected.append((i, "".join((url or "").split()), len(raw), digest, "response" if other is None else "revisit", other, b"" if other is not None else raw))
    key = lambda r: [(x is not None, x) for x in r]
    assert sorted(((*r[:6], bytes(r[6])) for r in got), key=key) == sorted(expected, key=key)
    same_rows(spark.createDataFrame([r[:1] + r[2:6] for r in got], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), by_sql(warc.SQL, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], pages=pd.DataFrame({"page_id": pd.array([p[0] for p in pages], "Int64"), "html": [p[2] for p in pages]})))


def test_warc_file_format(spark):
    """The dictionary leads each file; every record is a frame of its own that the plain library expands."""
    path = archive(spark, [(i, "http://a.example/", f"<html><body>page {i} " + "some words of the same page " * 20) for i in range(200)])
    for row in spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).collect():
        raw = bytes(row.content)
        assert raw[:4] == (0x184D2A5D).to_bytes(4, "little")
        end = 8 + int.from_bytes(raw[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(raw[8:end])
        with zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(raw[end:], read_across_frames=True) as r:
            text = r.read()
        assert text.count(b"WARC/1.1\r\n") == len(list(warc.frames(raw))) and text == b"".join(warc.frames(raw))
        with pytest.raises(ValueError):
            list(warc.frames(raw[:-20]))


def test_warc_of_odd_tables(spark):
    assert warc.read_warc(spark, archive(spark, [])).count() == 0
    rows = [(1, "u", "a" * 50, "x", "y"), (2, "u", "a" * 50, "x", "y"), (3, "u", "b", "x", "y"), (4, "u", "b", "x", "y")]
    got = warc.read_warc(spark, archive(spark, rows, PAGE + ", digest string, refers_to string", least_bytes=10)).collect()
    assert sorted((r.page_id, r.refers_to) for r in got) == [(1, None), (2, 1), (3, None), (4, None)]
    large = "<p>" + "long text " * 500_000
    assert [r.payload_bytes for r in warc.read_warc(spark, archive(spark, [(1, "u", large)])).collect()] == [len(large)]


def plain_trie(rows):
    """All beginnings of the rebuilt conversations in a dictionary."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    below = lambda top: [p for p in nodes if p[: len(top)] == top]
    for p, members in nodes.items():
        children = [q for q in below(p) if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes) for q in below(p))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below(p) if q)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        yield (min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())


def shared_talks(seed):
    """Conversations with common beginnings, copies, very long common runs and lonely ones."""
    rng, rows = random.Random(seed), []
    run = [(rng.choice(["user", "assistant"]), f"turn {i}") for i in range(30)]
    for c in rng.sample(range(-150, 400), 90):
        kind = rng.random()
        if kind < 0.3:
            turns = run[: rng.choice([0, 12, 30])] + [("user", rng.choice("abc")) for _ in range(rng.randrange(3))]
        else:
            turns = [(rng.choice(["user", None, ""]), rng.choice(["a", "b", "", None, "ä"])) for _ in range(rng.randrange(5))]
        rows += [(c, rng.choice([t, None]) if kind > 0.95 else t, *x) for t, x in enumerate(turns)]
    return rows + [(None, 0, "user", "a")]


@pytest.mark.parametrize("local", [1, 6, 60, 50_000])
def test_trie_against_plain_prefixes(spark, local):
    rows = shared_talks(2)
    unique = trie.distinct_sequences(trie.rebuilt(trie.sequences(trie.encoded(spark.createDataFrame(rows, TALK)))))
    got = trie.trie(unique, local)
    same_rows(got, list(plain_trie(rows)))
    if local == 6:
        same_rows(got, by_sql(trie.SQL, got.columns, conversations=frame(rows)))


def test_trie_of_odd_tables(spark):
    whole = lambda rows, schema=TALK: trie.trie(trie.distinct_sequences(trie.rebuilt(trie.sequences(trie.encoded(spark.createDataFrame(rows, schema))))))
    assert whole([]).count() == 0 and whole([(None, 1, "user", "x")]).count() == 0
    alone = next(c for c in range(1, 90) if zlib.crc32(str(c).encode()) % 6 > 1)  # its only turn is replaced by none
    assert [tuple(r) for r in whole([(alone, 0, "user", "x")]).collect()] == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    rows = [(100, 0, "user", "x" * 2_000_000, 9, "q"), (100, 0, "user", "x" * 2_000_000, 9, "q")]
    assert sorted(r.depth for r in whole(rows, TALK + ", id int, seq string").collect()) == [0, 1, 2]
