import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tidemark.llm import packing


def best_fit(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms[rooms.index(min(fits))] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    pick = random.Random(seed)
    capacity = pick.choice([10, 37, 64])
    lengths = [pick.randint(1, capacity) for _ in range(pick.randint(0, 120))]
    lengths += [pick.randint(1, capacity)] * pick.randint(0, 60)
    histogram = {n: lengths.count(n) for n in set(lengths)}
    spans, seen = {}, {n: 0 for n in histogram}
    for length, rank, count, per, first, used in packing.plan(histogram, capacity):
        assert rank == seen[length]
        seen[length] += count
        for nth in range(count):
            spans.setdefault(first + nth // per, []).append((used + nth % per * length, length))
    assert seen == histogram
    for held in spans.values():
        held.sort()
        assert [a for a, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
    assert sorted(capacity - sum(n for _, n in held) for held in spans.values()) == best_fit(lengths, capacity)
    assert sorted(spans) == list(range(len(spans)))


def test_the_merge_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    encoder = packing.TextEncoder(packing.tokenizer_path())
    texts = ["", " ", "It's THE end…　naïve é ǅ ΑΣ ΑΣ. 1234 'll", "a\x1cb \x1f c\x85d\xa0e f​g",
             "<|endoftext|> x<|startoftext|>y", "x" * 5000, "tab\tnew\nline\r\n", "İstanbul ß ﬁ 日本語 🎉 x",
             "Straße. ÉTÉ!! e\u0301te\u0301, don't. a's, x). (x #1 ÿ\u0308 word*** K\u212a. n\u0303 µ×÷ª Ω'S",
             "It'S we'LL. he'd!! 's 't. ''s x_'s 1's s's't", "ab" * 200 + " " + "ab" * 201, "\u0939\u093f\u0928 \uac00\u1161 \u1100\u1161"]
    pick = random.Random(9)
    signs = [*"abcest'\u2019.,!?-_ \n\t019AC\u00c0\u00e9\u00fc\u00df\u0416\u044f\u0391\u03c3\u03c2\u03a3\u4e2d\u3042\ud55c\u0301\u0308\u200d\x1c\x85\xa0\u3000\u0130\u0131\ufb01\u00b2\u2167<|>\U0001f600",
             "<|startoftext|>", "<|endoftext|>", "'re", "the ", "ing"]
    texts += ["".join(pick.choices(signs, k=pick.randint(0, 40))) for _ in range(5000)]
    texts += ["".join(pick.choices("etaoinshrdlu", k=pick.randint(1, 30))) for _ in range(5000)]
    for text in texts:
        assert encoder(text) == b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids)


def test_texts_beyond_the_block_size(monkeypatch):
    encoder = packing.TextEncoder(packing.tokenizer_path())
    text = "Some w\u00f6rds, \U0001f600 don't <|endoftext|> " * 300 + "y" * 3000
    whole = encoder._exact(text)
    for size in (1, 50, 1000):
        monkeypatch.setattr(packing, "TOGETHER", size)
        assert encoder(text) == whole


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    texts = {1: None, 2: "", 3: "one two", 4: "word " * 9000, 5: "one two", 6: "tail " * 4095}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("length", F.lit("clash"))
    rows = packing.pack_documents(docs).collect()
    by_doc = {d: sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece) for d in texts}
    for doc_id, text in texts.items():
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        assert sum(r.length for r in by_doc[doc_id]) == len(ids)
        for r in by_doc[doc_id]:
            part = ids[r.start:r.start + r.length]
            assert r.start == r.piece * 4096
            assert r.ids_crc32 == crc32(b"".join(i.to_bytes(4, "little") for i in part))
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:]))
        assert sum(n for _, n in held) <= 4096
    assert sorted(4096 - sum(n for _, n in h) for h in places.values()) == best_fit([r.length for r in rows], 4096)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_one_length_is_ranked_in_lanes(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 7)
    cut = spark.range(100).selectExpr("id as doc_id", "0 as piece", "cast(if(id < 80, 5, id % 9 + 1) as long) as length")
    rows = packing.pack(cut, 16).collect()
    assert len(rows) == 100 and len({(r.sequence_id, r.offset) for r in rows}) == 100
