"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every k-gram of words (GRAM = 5) gets a hash; of each run of WINDOW - GRAM + 1 consecutive hashes the least is kept (the
rightmost on ties). Two texts that share WINDOW = 10 consecutive words share such a run and so keep the same k-gram of it: every
shared span of 10 or more words gives a joined fingerprint, and with it the diagonal on which the span lies. Each hit is
extended by comparing the words of the (at most six) windows around it, so what is reported is exact.

Items of fewer than 10 words, which winnowing does not guarantee, are joined whole: for each of their lengths (nine at
most, none as a rule) the documents' n-grams of that length.

Scale: one pass over the texts; a document's row is split into fingerprints with 15 words of context, so no text is
shuffled. The benchmark's fingerprints are counted and broadcast up to BROADCAST rows, else joined by shuffle. Only
hits and one small row a document are shuffled, by document.

Defined cases: null and wordless texts have no words and are clean; items without words never occur; an item without id
hits words but is not counted; repeated rows give repeated result rows; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattroute.llm.common import alnum_words, table

GRAM, WINDOW = 5, 10
RUN = WINDOW - GRAM + 1
PLACE = 25  # bits of a sort key that hold the position
BROADCAST = 500_000  # benchmark fingerprints


def gram_hash(words: str, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + j) for j in range(n)])


def winnowed(df: DataFrame) -> DataFrame:
    """Adds ``places``: positions of the kept k-grams of the column ``words`` (empty below WINDOW words), and ``grams``."""
    none = F.array().cast("array<bigint>")
    top = (1 << PLACE) - 1
    long = F.size("words") >= WINDOW
    df = df.withColumn("grams", F.when(long, F.transform(F.sequence(F.lit(0), F.size("words") - GRAM), lambda i: gram_hash("words", i, GRAM))).otherwise(none))
    df = df.withColumn("keys", F.transform("grams", lambda g, i: F.shiftleft(F.shiftrightunsigned(g, PLACE + 1), PLACE).bitwiseOR(F.lit(top) - i)))
    least = F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.least(*[F.get("keys", i + j) for j in range(RUN)]))
    df = df.withColumn("kept", F.when(long, F.array_distinct(least)).otherwise(none))
    return df.withColumn("places", F.transform("kept", lambda c: (F.lit(top) - c.bitwiseAND(F.lit(top))).cast("int"))).drop("keys", "kept")


def marks(df: DataFrame, keys: list[str], short: list[int], lead: bool) -> DataFrame:
    """The keys, n_words and a row for each fingerprint: n (words it stands for), p, fp, and the words around, to verify by.

    ``near`` starts min(p, RUN - 1) words before p for a winnowed k-gram, at p for a whole short n-gram. With ``lead`` each
    row of ``df`` also gives a row of p = -1 and fp null. Hashes are taken after the explode, where words and k-grams
    are columns already computed.
    """
    spot = lambda n: lambda p: F.struct(F.lit(n).alias("n"), p.alias("p"))
    none = F.array().cast("array<struct<n:int,p:int>>")
    whole = [F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(0), F.size("words") - n), spot(n))).otherwise(none) for n in short]
    first = F.array(F.struct(F.lit(0).alias("n"), F.lit(-1).alias("p"))) if lead else none
    spots = df.withColumn("spots", F.concat(first, F.transform("places", spot(WINDOW)), *whole))  # a column of its own keeps the explode in generated code; _outer, as a filter on its size would repeat all this
    each = spots.select(*keys, "words", "grams", F.explode_outer("spots").alias("m"))
    fp = F.when(F.col("m.n") == WINDOW, F.get("grams", F.col("m.p")))
    for n in short:
        fp = fp.when(F.col("m.n") == n, gram_hash("words", F.col("m.p"), n))
    from_ = F.when(F.col("m.n") == WINDOW, F.greatest(F.col("m.p") - (RUN - 1), F.lit(0))).otherwise(F.greatest(F.col("m.p"), F.lit(0)))
    wide = F.when(F.col("m.n") == WINDOW, F.lit(WINDOW + RUN - 1)).otherwise(F.col("m.n"))
    return each.select(*keys, F.size("words").alias("n_words"), "m.n", "m.p", fp.alias("fp"), F.slice("words", from_ + 1, wide).alias("near"))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, copies, n_words, item_ids, and spans: the [start, end) of every occurrence of a window."""
    items = benchmark.select("item_id", alnum_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    short = sorted(r.n for r in items.select(F.size("words").alias("n")).where(f"n < {WINDOW}").distinct().collect())  # nine at most
    own = marks(winnowed(items), ["item_id"], short, lead=False).where(f"n = n_words or (n = {WINDOW} and n_words >= {WINDOW})")
    own = own.where("p is not null").select("item_id", "n", F.col("p").alias("q"), "fp", F.col("near").alias("item_near"))
    small = own.count() <= BROADCAST

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), alnum_words(F.col("text")).alias("words"))
    each = marks(winnowed(rows), ["doc_id", "text_hash"], short, lead=True)
    hits = each.join(F.broadcast(own) if small else own, ["n", "fp"], "left").where("q is not null or p < 0")

    # o: how far before the shared k-gram a window starts; both contexts begin min(position, 5) words before it
    def same(o: Column) -> Column:
        doc_at, item_at = F.least("p", F.lit(RUN - 1)) - o, F.least("q", F.lit(RUN - 1)) - o
        ours, theirs = F.slice("near", doc_at + 1, F.col("n")), F.slice("item_near", item_at + 1, F.col("n"))
        return (F.size(ours) == F.col("n")) & (ours == theirs)

    most = F.when(F.col("n") == WINDOW, F.least("p", "q", F.lit(RUN - 1))).otherwise(F.lit(0))
    aligned = F.when(F.col("n") == WINDOW, F.filter(F.sequence(F.lit(0), most), same)).otherwise(F.when(F.col("near") == F.col("item_near"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
    spans = F.transform(aligned, lambda o: F.struct((F.col("p") - o).alias("s"), (F.col("p") - o + F.col("n")).alias("e")))
    hits = hits.withColumn("spans", F.when(F.col("p") < 0, F.array().cast("array<struct<s:int,e:int>>")).otherwise(spans)).where("p < 0 or size(spans) > 0")
    found = hits.groupBy("doc_id", "text_hash").agg(
        F.sum(F.when(F.col("p") < 0, 1).otherwise(0)).alias("copies"), F.max("n_words").cast("bigint").alias("n_words"),
        F.collect_set("item_id").alias("item_ids"), F.flatten(F.collect_set("spans")).alias("spans"),
    )
    return found


def covered(spans: str) -> Column:
    """Number of positions in the union of [s, e) intervals."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n"))
    return F.aggregate(F.array_sort(F.array_distinct(spans)), start, step, lambda a: a["n"])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find(docs, benchmark).withColumn("n_hit", covered("spans"))
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text holds no window of any benchmark item; all their columns."""
    leaks = find(docs, benchmark).where("size(spans) > 0").select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash"))
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leak_id"]) & (F.xxhash64(docs["text"]) == leaks["leak_hash"]), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with dw as (select row_number() over () r, doc_id, {WORDS_SQL} w from documents),
iw as (select item_id, {WORDS_SQL} w from benchmark),
win as (select distinct item_id, least(len(w), 10) k, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') g
        from iw, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(s) where len(w) > 0),
dg as (select r, k, s, array_to_string(w[s : s + k - 1], ' ') g
       from dw join (select distinct k from win) on len(w) >= k, unnest(range(1, len(w) - k + 2)) t(s)),
hit as (select r, s, k, item_id from dg join win using (k, g)),
pos as (select r, count(distinct p) n_hit from hit, unnest(range(s, s + k)) u(p) group by r),
item as (select r, count(*) n_items, string_agg(i, ',' order by i) ids from (select distinct r, cast(item_id as varchar) i from hit where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join pos using (r) left join item using (r)
"""
