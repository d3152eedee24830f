"""Licence scan by a positional index of rare words; DataFrame functions only.

A template is a sequence of words with a mandatory key phrase inside. Its anchor is the word of the key phrase
with the highest inverse document frequency over all texts, so a word that is common in some language ("mit"
in German) is not looked up where a rarer one will do. Only texts that hold some anchor are cut into words;
each anchor's positions are moved back by its place in the template, the key phrase is verified at that
relative position, and the share of template words standing at their places decides.

Base labels come from four phrases that must match whole. The method's own labels come from longer notices,
of which `MIN_SHARE` of the words must stand at their places around the key phrase; a template's share is its
best match.

Words are maximal runs of digits, letters a-z and characters beyond ASCII, after lower-casing A-Z. Null texts
count as empty: no words, no labels, score 0. Rows are independent; extra columns stay aside. Without rows the
result is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Base phrases and their labels (fixed by contract).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: The method's own templates: label, whole notice, key phrase within it.
NOTICES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0 international", "creative commons attribution 4 0"),
    ("mit-notice", "released under the mit license", "under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files", "permission is hereby granted free of charge"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
]
MIN_SHARE = 0.7
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[tuple[str, list[str], int, int, bool]]:
    """(label, words, start of the key phrase, its length, whether it is a base phrase) of every template."""
    out = [(label, phrase.split(), 0, len(phrase.split()), True) for phrase, label in PHRASES.items()]
    for label, notice, key in NOTICES:
        words, inner = notice.split(), key.split()
        place = next(i for i in range(len(words)) if words[i:i + len(inner)] == inner)
        out.append((label, words, place, len(inner), False))
    return out


def lowered(text: Column) -> Column:
    """A-Z in lower case. Of other letters only the Kelvin sign would turn into an ASCII one; it is kept apart."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9")))


def words_of(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def document_frequency(docs: DataFrame) -> dict[str, int]:
    """Texts that hold each key word, counted over all rows."""
    keys = sorted({w for _, words, at, n, _ in templates() for w in words[at:at + n]})
    held = F.array_intersect(words_of(lowered(F.col("text"))), F.array(*map(F.lit, keys)))
    rows = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()  # at most the key words
    return {w: 0 for w in keys} | {r.word: r["count"] for r in rows}


def _starts(words: list[str], at: int, n: int, anchor: int) -> Column:
    """Template starts at which the key phrase stands, from the positions of the anchor word."""
    def moved(hit: Column) -> Column:
        return hit["place"] - anchor

    def key_stands(start: Column) -> Column:
        first = start + at
        return (first >= 0) & (F.slice("words", F.greatest(first, F.lit(0)) + 1, n) == F.array(*map(F.lit, words[at:at + n])))

    hits = F.filter("rare", lambda hit: hit["word"] == words[anchor])
    return F.filter(F.transform(hits, moved), key_stands)


def _share(words: list[str]):
    def share(start: Column) -> Column:
        same = [F.coalesce((F.get("words", start + i) == w).cast("int"), F.lit(0)) for i, w in enumerate(words)]
        return reduce(lambda a, b: a + b, same) / len(words)

    return share


def _listed(labels: list[Column]) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    frequency, known = document_frequency(docs), templates()
    anchors = [min(range(at, at + n), key=lambda i: (frequency[words[i]], i)) for _, words, at, n, _ in known]
    rare_words = sorted({words[a] for (_, words, *_), a in zip(known, anchors)})
    low = F.col("low")
    some = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in rare_words])
    located = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("place")))
    base = [i for i, t in enumerate(known) if t[4]]
    own = [i for i, t in enumerate(known) if not t[4]]
    rows = docs.select("doc_id", lowered(F.col("text")).alias("low")) \
        .select("doc_id", F.regexp_count(low, F.lit(WORD)).cast("long").alias("n_words"),
                F.when(some, words_of(low)).otherwise(F.array().cast("array<string>")).alias("words")) \
        .withColumn("rare", F.filter(located, lambda h: h["word"].isin(rare_words))) \
        .withColumns({f"s{i}": _starts(words, at, n, anchors[i]) for i, (_, words, at, n, _) in enumerate(known)}) \
        .withColumns({f"m{i}": F.coalesce(F.array_max(F.transform(f"s{i}", _share(known[i][1]))), F.lit(0.0))
                      for i in own}) \
        .withColumn("places", F.flatten(F.array(*[f"s{i}" for i in base])))
    found_base = [F.when(F.size(f"s{i}") > 0, F.lit(known[i][0])) for i in base]
    found_own = [F.when(F.col(f"m{i}") >= MIN_SHARE, F.lit(known[i][0])) for i in own]
    shares = [F.when(F.size("places") > 0, 1.0).otherwise(0.0)]
    shares += [F.when(F.col(f"m{i}") >= MIN_SHARE, F.col(f"m{i}")).otherwise(0.0) for i in own]
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        _listed(found_base).alias("base_labels"), _listed(found_base + found_own).alias("labels"),
        F.greatest(*shares).alias("score"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same result by trying every position of every text."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    columns = []
    for i, (_, words, at, n, is_base) in enumerate(templates()):
        key = "[" + ", ".join(f"'{w}'" for w in words[at:at + n]) + "]"
        columns.append(f"list_filter(range(len(w)), lambda p: w[p + 1:p + {n}] = {key}) AS k{i}")
    shares = []
    for i, (_, words, at, n, is_base) in enumerate(templates()):
        if not is_base:
            same = " + ".join(f"CASE WHEN p - {at} + {j} >= 0 AND w[p - {at} + {j} + 1] = '{x}' THEN 1 ELSE 0 END"
                              for j, x in enumerate(words))
            shares.append(f"coalesce(list_max(list_transform(k{i}, lambda p: ({same}) / {len(words)}.0::DOUBLE)), 0) AS m{i}")
    base = [i for i, t in enumerate(templates()) if t[4]]
    own = [i for i, t in enumerate(templates()) if not t[4]]
    base_labels = ", ".join(f"CASE WHEN len(k{i}) > 0 THEN '{templates()[i][0]}' END" for i in base)
    own_labels = ", ".join(f"CASE WHEN m{i} >= {MIN_SHARE} THEN '{templates()[i][0]}' END" for i in own)
    best = ", ".join(f"CASE WHEN m{i} >= {MIN_SHARE} THEN m{i} ELSE 0 END" for i in own)
    join = "array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL))), ',')"
    places = " || ".join(f"k{i}" for i in base)
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS w FROM documents),
keys AS (SELECT doc_id, w, {', '.join(columns)} FROM words),
shares AS (SELECT *, {places} AS places, {', '.join(shares)} FROM keys)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word,
  list_max(places)::BIGINT AS last_word, {join.format(base_labels)} AS base_labels,
  {join.format(base_labels + ', ' + own_labels)} AS labels,
  greatest(CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE 0 END, {best})::DOUBLE AS score
FROM shares"""


OP5_SQL = _sql()
