import random
import re

from tidemark.llm import license_scan as ls

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places, base, own, best = [], set(), set(), 0.0
    for label, phrase, at, n, is_base in ls.templates():
        for p in range(len(words)):
            if words[p:p + n] == phrase[at:at + n]:
                if is_base:
                    places.append(p)
                    base.add(label)
                    best = 1.0
                else:
                    s = p - at
                    share = sum(0 <= s + j < len(words) and words[s + j] == w for j, w in enumerate(phrase)) / len(phrase)
                    if share >= ls.MIN_SHARE:
                        own.add(label)
                        best = max(best, share)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | own)), best)


def result(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as words", "2 as s0")
    return {r.doc_id: tuple(r)[1:] for r in ls.scan(docs).collect()}


def test_scan_equals_every_position(spark):
    pick = random.Random(1)
    pool = ["GNU", "general", "Public", "LICENSE", "apache", "cc", "by", "MIT", "nc", "4", "0", "x", "é", "K", "the",
            "under", "version", "3", "Released"]
    texts = [None, "", " \n", "cc by", "mit-license MIT  License.", "by cc", "Licensed under CC BY-NC 4.0.",
             "This work is licensed under the GNU General Public License, version 3.", "version 2.0 apache license version 2 0",
             "der mit dem mit mit license", "Kelvin cc by x", "ccéby cc_by cc0by CC\tBY " * 400,
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this thing"]
    texts += [pick.choice([" ", ", ", "-"]).join(pick.choice(pool) for _ in range(pick.randint(1, 60))) for _ in range(150)]
    texts += [texts[5]] * 3
    assert result(spark, texts) == {i: brute(t) for i, t in enumerate(texts)}
    assert result(spark, [None]) == {0: brute(None)}


def test_empty_table(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_common_words_are_not_anchors(spark):
    docs = spark.createDataFrame([(i, "mit der mit") for i in range(5)] + [(9, "MIT License")], "doc_id long, text string")
    counts = ls.document_frequency(docs)
    assert counts["mit"] == 6 and counts["license"] == 1 and counts["gnu"] == 0
