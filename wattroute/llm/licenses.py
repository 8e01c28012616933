"""License scans by diagonal voting, with DataFrame functions only.

Templates are word sequences with a label. All rolling word k-grams of the documents are hashed and joined to the
template positions that hold the same k-gram; each hit votes for the diagonal (document position minus template position).
Votes are counted for each document, template and diagonal; neighbouring diagonals (a word more or less) are merged; a
merged span is verified by its number of votes and by how densely it is covered.

Short phrases are templates of 2-grams that must be covered whole, on one diagonal. License notices are templates of
4-grams, of which at least MIN_VOTES, and half of the span, must agree.

Scale: one pass over the texts; the templates are a fixed table (broadcast: its size never depends on the data); only
hits and one small row a document are shuffled, after partial aggregation.

Defined cases: null and wordless texts have no words, no labels, score 0; repeated rows give repeated result rows;
other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattroute.llm.common import alnum_words, table
from wattroute.llm.decontaminate import WORDS_SQL

PHRASE_GRAM, NOTICE_GRAM = 2, 4
NEAR = 3  # diagonals at most so far apart are merged
MIN_VOTES, DENSE = 8, 0.5

# Phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# The customary notices of public licenses, in words.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unlicense"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc"),
]


def templates(spark: SparkSession) -> DataFrame:
    """template, base, label, grams (their number), k, q (position) and gram, of the fixed templates."""
    rows = [(i, base, label, text.split(), k) for i, (base, text, label, k) in enumerate([(True, t, x, PHRASE_GRAM) for t, x in PHRASES] + [(False, t, x, NOTICE_GRAM) for t, x in NOTICES])]
    flat = [(i, base, label, len(w) - k + 1, q, w[q : q + k]) for i, base, label, w, k in rows for q in range(len(w) - k + 1)]
    df = spark.createDataFrame(flat, "template int, base boolean, label string, grams int, q int, gram array<string>")
    k2, k4 = ([F.get("gram", F.lit(j)) for j in range(k)] for k in (PHRASE_GRAM, NOTICE_GRAM))
    return df.withColumn("fp", F.when(F.col("base"), F.xxhash64(*k2)).otherwise(F.xxhash64(*k4))).drop("gram")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, copies, n_words and found: array of (base, label, start, end, score) spans, one row for each distinct text of an id."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), alnum_words(F.col("text")).alias("words"))
    at = F.explode_outer(F.sequence(F.lit(-1), F.greatest(F.size("words") - PHRASE_GRAM, F.lit(-1))))
    each = rows.select("doc_id", "text_hash", "words", F.size("words").alias("n_words"), at.alias("p"))
    get = lambda j: F.get("words", F.col("p") + j)
    pair = F.when(F.col("p") >= 0, F.xxhash64(get(0), get(1)))
    four = F.when((F.col("p") >= 0) & (F.col("p") + NOTICE_GRAM <= F.col("n_words")), F.xxhash64(*[get(j) for j in range(NOTICE_GRAM)]))
    each = each.select("doc_id", "text_hash", "n_words", "p", F.explode(F.array(pair, four)).alias("fp")).where("fp is not null or p < 0")
    votes = each.join(F.broadcast(templates(spark)), "fp", "left").where("q is not null or p < 0").withColumn("diagonal", F.col("p") - F.col("q"))
    keys = ["doc_id", "text_hash", "template", "base", "label", "grams"]
    # each position of a diagonal votes once, whatever the copies of the row: at most ``grams`` positions
    agreed = F.when(F.col("template").isNull(), F.count(F.lit(1))).otherwise(F.size(F.collect_set("p"))).alias("votes")
    votes = votes.groupBy(*keys, "diagonal").agg(agreed, F.min("p").alias("start"), F.max("p").alias("last"), F.max("n_words").alias("n_words"))
    # votes of the row that stands for the document itself (template null): two for each copy of the row
    w = Window.partitionBy(*keys).orderBy("diagonal")
    far = F.col("base") | F.col("template").isNull() | (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(w), F.col("diagonal") - NEAR - 1) > NEAR)
    merged = votes.withColumn("far", far.cast("int")).withColumn("run", F.sum("far").over(w))
    spans = merged.groupBy(*keys, "run").agg(F.sum("votes").alias("votes"), F.min("start").alias("start"), F.max("last").alias("last"), F.max("n_words").alias("n_words"))
    good = F.col("base") & (F.col("votes") == F.col("grams")) | ~F.col("base") & (F.col("votes") >= MIN_VOTES) & (F.col("votes") >= DENSE * (F.col("last") - F.col("start") + 1))
    spans = spans.where(F.col("template").isNull() | good)
    width = F.when(F.col("base"), PHRASE_GRAM).otherwise(NOTICE_GRAM)
    span = F.struct("base", "label", "start", (F.col("last") + width).alias("end"), F.least(F.lit(1.0), F.col("votes") / F.col("grams")).alias("score"))
    return spans.groupBy("doc_id", "text_hash").agg(
        F.sum(F.when(F.col("template").isNull(), F.col("votes"))).alias("rows"), F.max("n_words").cast("bigint").alias("n_words"),
        F.collect_list(F.when(F.col("template").isNotNull(), span)).alias("found"),
    ).select("doc_id", (F.col("rows") / 2).cast("bigint").alias("copies"), "n_words", "found")


def labels_of(spans) -> F.Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("found", lambda s: s["base"])
    found = scan(table(spark, sf_dir, "documents")).withColumn("base", base)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    starts = F.transform("base", lambda s: s["start"].cast("bigint"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels_of("base").alias("base_labels"), labels_of("found").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


_VALUES = ", ".join(f"({i}, {base}, '{label}', string_split('{text}', ' '), {k})" for i, (base, text, label, k) in enumerate([("true", t, x, PHRASE_GRAM) for t, x in PHRASES] + [("false", t, x, NOTICE_GRAM) for t, x in NOTICES]))
SQL = f"""
with dw as (select row_number() over () r, doc_id, {WORDS_SQL} w from documents),
tw(template, base, label, w, k) as (values {_VALUES}),
tg as (select template, base, label, len(w) - k + 1 grams, k, q, array_to_string(w[q + 1 : q + k], ' ') g from tw, unnest(range(0, len(w) - k + 1)) t(q)),
dg as (select r, k, p, array_to_string(w[p + 1 : p + k], ' ') g from dw join (select distinct k from tg) on len(w) >= k, unnest(range(0, len(w) - k + 1)) t(p)),
votes as (select r, template, base, label, grams, k, p - q diagonal, count(*) votes, min(p) s, max(p) l from dg join tg using (k, g) group by all),
far as (select *, case when base or diagonal - coalesce(lag(diagonal) over w, diagonal - {NEAR + 1}) > {NEAR} then 1 else 0 end far from votes window w as (partition by r, template order by diagonal)),
run as (select *, sum(far) over (partition by r, template order by diagonal) run from far),
span as (select r, template, base, label, grams, run, sum(votes) votes, min(s) s, max(l) l from run group by all),
good as (select * from span where (base and votes = grams) or (not base and votes >= {MIN_VOTES} and votes >= {DENSE} * (l - s + 1))),
found as (select r, count(*) filter (base) n_base, min(s) filter (base) first_word, max(s) filter (base) last_word,
  string_agg(distinct label, ',' order by label) filter (base) base_labels, string_agg(distinct label, ',' order by label) labels,
  max(least(1.0::double, cast(votes as double) / grams)) score from good group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_base, 0) as bigint) n_base, cast(first_word as bigint) first_word, cast(last_word as bigint) last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0.0::double) score
from dw left join found using (r)
"""
