"""Licence scan by a positional index of rare words.

Templates are short licence texts, each with a mandatory key phrase. Their words, but for the commonest, form the vocabulary;
one scan of the texts keeps where words of the vocabulary stand. Document frequencies over all texts give each word its
rarity.

1. Look-up: of the words that a file shares with a template's key phrase, the rarest proposes: a place of it in the file
   names a start of the template there (position less the word's position in the template). A file without the rarest word
   of a key phrase cannot hold the phrase, so the word to look up is known per template and nothing else is proposed.
2. Postings: only those of proposed starts are joined. They must stand at the same relative position, and each votes with
   its rarity.
3. A proposal is a match if its key phrase stands complete and enough of the template's rarity has voted.

The base phrases are templates of which every word is mandatory, so each place of them is found: no text, place or
template is left out, and nothing is capped. Every step after the scan is a join with the index, whose size is that of the
templates, or an equi-join and an aggregate by row, template and start.

Defined cases: a null or empty text has no words and no labels; rows have keys of their own, so rows with a null or repeated
id are each reported with the findings of their own text; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import lower_ascii
from barloom.session import stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases that count as the base, and their labels.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
# (label, text, mandatory key phrase).
TEMPLATES = (
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "binary forms with"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "creative commons zero cc0 public domain dedication", "creative commons zero"),
    ("gpl", "licensed under the gnu general public license version 3", "general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "distribute this software"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free"),
    ("mpl", "mozilla public license version 2 0", "mozilla public license"),
    ("proprietary", "all rights reserved no part may be reproduced", "all rights reserved"),
    ("unlicense", "free and unencumbered software released into the public domain", "unencumbered software released"),
)
# Words too common to be in the index, unless a key phrase holds them.
COMMON = frozenset(
    ("a", "and", "any", "are", "be", "by", "for", "in", "is", "it", "may", "no", "of", "or", "part", "the", "this", "to", "use", "with")
)
ENOUGH = 0.6
DIGITS = 6


def _places(text: str, phrase: str) -> set[int]:
    """Positions in the template that the phrase covers."""
    words, key = text.split(), phrase.split()
    return next({*range(i, i + len(key))} for i in range(len(words)) if words[i : i + len(key)] == key)


def postings(templates=TEMPLATES) -> list[tuple[str, int, str, int, int, bool]]:
    """(word, template, label, position, bit, mandatory) of all indexed words; the base phrases come first."""
    every = [(label, p, p) for label, p in BASE.items()] + list(templates)
    out = []
    for n, (label, text, phrase) in enumerate(every):
        key = _places(text, phrase)
        kept = [(i, w) for i, w in enumerate(text.split()) if i in key or w not in COMMON]
        out += [(w, n, label, i, bit, i in key) for bit, (i, w) in enumerate(kept)]
    return out


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)
    return f"(values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) as t({names})"


def located(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """row, doc_id, n_words and hits (position and word of every word of the vocabulary) of the whole text. The row keys
    hold as long as the result is staged."""
    text = lower_ascii(F.coalesce("text", F.lit("")))
    words = docs.select("doc_id", F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("_words"))
    placed = F.transform("_words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("p"), w.alias("w"))))
    hits = F.filter(placed, lambda x: x.isNotNull()).alias("hits")
    return words.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("_words").cast("long").alias("n_words"), hits)


def weighted_index(spark: SparkSession, texts: DataFrame, n_docs: int, templates=TEMPLATES) -> DataFrame:
    """The postings with each word's rarity over all texts, and whether it is the one to look up for its template: the
    rarest of the key phrase. As large as the templates."""
    distinct = texts.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w"))
    seen = {r.w: r.n for r in distinct.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per word at most
    rarity = {w: round(math.log((n_docs + 1) / (seen.get(w, 0) + 1)) + 1, DIGITS) for w, *_ in postings(templates)}
    rarest = {}
    for w, n, _, p, _, key in postings(templates):
        if key and (n not in rarest or (-rarity[w], p) < rarest[n]):
            rarest[n] = (-rarity[w], p)
    rows = [(w, n, label, p, 1 << bit, (1 << bit) * key, rarity[w], rarest[n][1] == p) for w, n, label, p, bit, key in postings(templates)]
    return spark.sql(f"select * from {_values(rows, 'w, template, label, pos, bit, key, rarity, looked_up')}")


def matches(hits: DataFrame, index: DataFrame, enough: float = ENOUGH) -> DataFrame:
    """row, template, label, start and score of every verified place; hits has row, p and w, one row per place."""
    whole = index.groupBy("template").agg(F.sum("rarity").alias("all"), F.sum("key").alias("keys"))
    keys = F.broadcast(index.where("looked_up").select("w", "template", "pos"))
    proposed = hits.join(keys, "w").select("row", "template", (F.col("p") - F.col("pos")).alias("start"))
    wanted = proposed.join(F.broadcast(index.drop("looked_up")), "template").withColumn("p", F.col("start") + F.col("pos"))
    tally = wanted.join(hits, ["row", "p", "w"]).groupBy("row", "template", "label", "start").agg(
        F.sum(F.col("rarity").cast("decimal(18,6)")).cast("double").alias("voted"), F.bit_or("bit").alias("bits")
    )
    score = F.round(F.col("voted") / F.col("all"), DIGITS)
    full = F.col("bits").bitwiseAND(F.col("keys")) == F.col("keys")
    return (
        tally.join(F.broadcast(whole), "template").where(full).withColumn("score", F.least(score, F.lit(1.0)))
        .where((F.col("template") < len(BASE)) | (F.col("score") >= enough))
        .select("row", "template", "label", "start", "score")
    )


def scanned(docs: DataFrame, templates=TEMPLATES, enough: float = ENOUGH) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    spark = docs.sparkSession
    vocabulary = sorted({w for w, *_ in postings(templates)})
    texts = stage(located(docs, vocabulary))
    index = weighted_index(spark, texts, texts.count(), templates)
    hits = texts.select("row", F.explode("hits").alias("h")).select("row", "h.p", "h.w")
    base = F.col("template") < len(BASE)
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    found = matches(hits, index, enough).groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        names(F.when(base, F.col("label"))).alias("base_labels"),
        names("label").alias("labels"),
        F.max("score").alias("score"),
    )
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return texts.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "doc_id", "n_words", *[F.coalesce(c, none[c]).alias(c) if c in none else F.col(c)
                               for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")]
    )


def oracle(templates=TEMPLATES, enough: float = ENOUGH) -> str:
    """DuckDB SQL for `scanned`."""
    rows = [(w, n, label, p, 1 << bit, (1 << bit) * key) for w, n, label, p, bit, key in postings(templates)]
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with d as (select row_number() over () as row, doc_id, regexp_extract_all({lower}, '{WORD}') as words from documents),
post as (select * from {_values(rows, "w, template, label, pos, bit, key")}),
hits as (select row, w, p from (select row, unnest(words) as w, generate_subscripts(words, 1) - 1 as p from d)
  where w in (select w from post)),
df as (select w, count(distinct row) as n from hits group by w),
idx as (select post.*, round(ln(((select count(*) from d) + 1) / (coalesce(n, 0) + 1)) + 1, {DIGITS}) as rarity from post left join df using (w)),
whole as (select template, sum(rarity) as everything, sum(key) as keys from idx group by template),
tally as (select row, template, label, p - pos as start, sum(cast(rarity as decimal(18, 6))) as voted, bit_or(bit) as bits
  from hits join idx using (w) group by all),
found as (select row, template, label, start, least(round(cast(voted as double) / everything, {DIGITS}), 1.0) as score
  from tally join whole using (template) where (bits & cast(keys as bigint)) = cast(keys as bigint)),
good as (select * from found where template < {len(BASE)} or score >= {enough}),
per as (select row, count_if(template < {len(BASE)}) as n_base, min(case when template < {len(BASE)} then start end) as first_word,
    max(case when template < {len(BASE)} then start end) as last_word,
    string_agg(distinct case when template < {len(BASE)} then label end, ',' order by case when template < {len(BASE)} then label end) as base_labels,
    string_agg(distinct label, ',' order by label) as labels, max(score) as score from good group by row)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word,
  cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score
from d left join per using (row)"""
