"""License scans by diagonal voting, in DataFrame operations only.

Every template is cut into rolling word k-grams. All rolling k-grams of the
documents are joined by hash to the templates' positions; a match at document
position p and template position t votes for the diagonal p - t. Votes are
gathered per diagonal, neighbouring diagonals (words inserted or lost) are
merged, and the spans are verified by the share of the template they cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut

#: Fixed value: words of the scan, before A-Z are lower-cased.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words in a k-gram, diagonals merged when so near, share of a template's
#: k-grams that a verified span covers, and its length against the template's.
K, SLACK, COVER, STRETCH = 2, 3, 0.8, 1.5

#: Base phrases, matched exactly, with their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Further short phrases, matched exactly.
MORE_PHRASES = [
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("bsd license", "bsd"),
    ("isc license", "isc"),
    ("all rights reserved", "reserved"),
]
#: Opening sentences of public licenses, matched with gaps.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
]


def templates(spark: SparkSession, exact: list[tuple[str, str]], gapped: list[tuple[str, str]], base: int) -> DataFrame:
    """One row per k-gram of each template: a table as small as the lists. The first ``base`` exact ones are base phrases."""
    rows = []
    for n, (phrase, label) in enumerate([*exact, *gapped]):
        words = phrase.split()
        if not K <= len(words) <= 63 + K - 1:
            raise ValueError(f"a template has {K} to {62 + K} words: {phrase!r}")
        grams = len(words) - K + 1
        rows += [(n, label, n < len(exact), n < base, grams, len(words), t, *words[t:t + K]) for t in range(grams)]
    df = spark.createDataFrame(rows, "template int, label string, exact boolean, base boolean, grams int, n_template int, t int, w1 string, w2 string")
    return df.withColumn("gram", F.xxhash64("w1", "w2"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] = PHRASES,
         more: list[tuple[str, str]] = MORE_PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """``(id_col, n_words, spans, score)``, one row per row of ``docs``.

    ``spans`` is an array of (template, label, base, first, last, coverage), the
    verified places by words counted from 0, in order of their first word;
    empty where there is none. ``score`` is the largest share of a template
    found on a diagonal or merged span, whether verified or not. Null and empty
    texts have no words. Rows repeated whole give repeated results; rows that
    share an id with another text are told apart by the text's hash.

    The join is a broadcast of the templates' k-grams (fixed, a few hundred
    rows) and is verified word by word. Texts are read and cut into words once;
    only votes are shuffled, by document.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)).alias("w"))
    low = lambda c: F.translate(c, UPPER, LOWER)
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    # the first entry of each array is no k-gram: it carries the number of words
    entries = F.concat(F.array(F.lit(None).cast("struct<a:string,b:string>")), pairs)
    grams = (src.select("id", "h", F.size("w").cast("long").alias("n_words"), F.posexplode(entries).alias("at", "g"))
             .select("id", "h", "n_words", (F.col("at") - 1).alias("p"), F.col("g")["a"].alias("a"), F.col("g")["b"].alias("b")).where("p < 0 or b is not null")
             .withColumn("key", F.when(F.col("p") >= 0, F.xxhash64(F.lower("a"), F.lower("b")))))
    known = F.broadcast(templates(docs.sparkSession, [*phrases, *more], notices, len(phrases)))
    same = (F.col("key") == F.col("gram")) & (low(F.col("a")) == F.col("w1")) & (low(F.col("b")) == F.col("w2"))
    hits = cut(grams.join(known, same, "left").where("p < 0 or template is not null").drop("a", "b", "key", "gram", "w1", "w2"))
    votes = (hits.where("p >= 0")
             .groupBy("id", "h", "template", "label", "exact", "base", "grams", "n_template", (F.col("p") - F.col("t")).alias("diagonal"))
             .agg(F.bit_or(F.expr("shiftleft(1L, t)")).alias("mask"), F.min("p").alias("first"), (F.max("p") + K - 1).alias("last")))
    near = Window.partitionBy("id", "h", "template").orderBy("diagonal")
    broken = F.col("exact") | (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near), F.lit(SLACK + 1)) > SLACK)
    islands = votes.withColumn("island", F.sum(broken.cast("int")).over(near))
    group = ["id", "h", "template", "label", "exact", "base", "grams", "n_template"]
    spans = islands.groupBy(*group, "island").agg(
        F.bit_count(F.bit_or("mask")).alias("hit"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.max(F.struct(F.bit_count("mask").alias("hit"), (-F.col("first")).alias("first"), "last")).alias("best"))
    # a merged span that is stretched too far counts by its best diagonal
    whole = F.col("last") - F.col("first") + 1 <= STRETCH * F.col("n_template")
    pick = lambda c, other: F.when(whole, F.col(c)).otherwise(other)
    spans = spans.select(*group, pick("hit", F.col("best.hit")).alias("hit"), pick("first", -F.col("best.first")).alias("first"),
                         pick("last", F.col("best.last")).alias("last")).withColumn("coverage", F.col("hit") / F.col("grams"))
    found = F.when(F.col("coverage") >= F.when(F.col("exact"), 1.0).otherwise(COVER),
                   F.struct(F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "template", "label", "base", "coverage"))
    per_doc = spans.groupBy("id", "h").agg(F.sort_array(F.collect_list(found)).alias("spans"), F.max("coverage").alias("score"))
    per_doc = per_doc.select(F.col("id").alias("i"), F.col("h").alias("j"), "spans", "score")
    counted = hits.where("p < 0").select("id", "h", "n_words")
    none = F.array().cast(per_doc.schema["spans"].dataType)
    return (counted.join(per_doc, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j")), "left")
            .select(F.col("id").alias(id_col), "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("score", F.lit(0.0)).alias("score")))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The base phrases' counts and first and last starts, and both label lists."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scanned.select(id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                          F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("spans")).alias("labels"), "score")


def _rows() -> str:
    """The k-grams of all templates as SQL rows (template, label, exact, base, grams, n_template, t, w1, w2)."""
    out = []
    for n, (phrase, label) in enumerate([*PHRASES, *MORE_PHRASES, *NOTICES]):
        words, exact = phrase.split(), n < len(PHRASES) + len(MORE_PHRASES)
        out += [f"({n}, '{label}', {exact}, {n < len(PHRASES)}, {len(words) - 1}, {len(words)}, {t}, '{words[t]}', '{words[t + 1]}')" for t in range(len(words) - 1)]
    return ", ".join(out)


#: The same digests in DuckDB.
SQL = rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
t as (select * from (values {_rows()}) t(template, label, exact, base, grams, n_template, t, w1, w2)),
g as (select doc_id, w[i] as a, w[i + 1] as b, i - 1 as p from (select doc_id, w, unnest(range(1, len(w))) as i from w)),
v as (select doc_id, template, label, exact, base, grams, n_template, p - t as diagonal, bit_or(1::bigint << t) as mask, min(p) as first, max(p) + 1 as last
  from g join t on a = w1 and b = w2 group by all),
i as (select *, sum(broken) over (partition by doc_id, template order by diagonal) as island from (
  select *, case when exact or coalesce(diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal), {SLACK + 1}) > {SLACK} then 1 else 0 end as broken from v)),
m as (select doc_id, template, label, exact, base, grams, n_template, bit_count(bit_or(mask)) as hit, min(first) as first, max(last) as last,
    max(struct_pack(hit := bit_count(mask), first := -first, last := last)) as best
  from i group by doc_id, template, label, exact, base, grams, n_template, island),
s as (select doc_id, template, label, exact, base, case when last - first + 1 <= {STRETCH} * n_template then first else -best.first end as first,
    (case when last - first + 1 <= {STRETCH} * n_template then hit else best.hit end)::double / grams as coverage from m),
d as (select doc_id, max(coverage) as score, count(*) filter (where ok and base)::bigint as n_base, min(first) filter (where ok and base)::bigint as first_word,
    max(first) filter (where ok and base)::bigint as last_word, string_agg(distinct label, ',' order by label) filter (where ok and base) as base_labels,
    string_agg(distinct label, ',' order by label) filter (where ok) as labels
  from (select *, coverage >= case when exact then 1.0 else {COVER} end as ok from s) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
  coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from w left join d using (doc_id)
"""
