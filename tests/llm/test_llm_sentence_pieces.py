import random
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import sentence_pieces as sp

VOCABULARY = sp.load_vocabulary(sp.model_path())


@pytest.fixture(scope="module")
def encoder():
    return sp.Encoder(VOCABULARY)


def whole(text):
    """Plain Viterbi over the whole text at once."""
    if not text:
        return []
    s, plain = sp.SPACE + text.replace(" ", sp.SPACE), set(VOCABULARY["plain"])
    ids = {VOCABULARY["pieces"][i]: i for i in plain}
    best, back = [0.0] + [None] * len(s), [None] * (len(s) + 1)
    for a in range(len(s)):
        steps = [(b, ids[s[a:b]], VOCABULARY["scores"][ids[s[a:b]]]) for b in range(a + 1, min(len(s), a + 16) + 1) if s[a:b] in ids]
        if not any(b == a + 1 for b, _, _ in steps):
            steps.append((a + 1, None, VOCABULARY["unknown"]))
        for b, i, score in steps:
            if best[b] is None or best[a] + score > best[b]:
                best[b], back[b] = best[a] + score, (a, i)
    out, end = [], len(s)
    while end:
        a, i = back[end]
        out[:0] = [i] if i is not None else [VOCABULARY["bytes"][x] for x in s[a:end].encode()]
        end = a
    return out


def samples():
    pick = random.Random(3)
    signs = "aabcdeeinorst  .,'\n\té日🎉ß" + sp.SPACE
    return ["", " ", "  a  b ", "Hello world", "naïve\n\n日本語 🎉", "a" * 500, "ab" * 300, " " * 40, "\x00", "x" + sp.SPACE] + [
        "".join(pick.choice(signs) for _ in range(pick.randint(1, 90))) for _ in range(200)]


def test_stream_equals_whole_text_search(encoder):
    for text in samples():
        assert encoder(text) == whole(text)
        marked = sp.SPACE + text.replace(" ", sp.SPACE)
        assert not text or [i for part in encoder.stream(marked) for i in part] == whole(text)


def test_scores_no_less_than_the_library_as_a_unigram_model(encoder):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(sp.model_path(), "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    score = dict(zip(VOCABULARY["pieces"], VOCABULARY["scores"]))
    for text in ["Hello world", "the quick brown fox jumps", "La maison est ici", "Umbau der Anlage", "a b c", "thththe"]:
        own, other = ([VOCABULARY["pieces"][i] for i in ids] for ids in (encoder(text), library.encode(text)))
        assert "".join(own) == "".join(other)
        assert sum(map(score.__getitem__, own)) >= sum(map(score.__getitem__, other))


def test_parts_are_final_and_memory_stays_small(encoder):
    parts = list(encoder.stream(sp.SPACE + "the house of an other " .replace(" ", sp.SPACE) * 2000))
    assert len(parts) > 2000 and max(map(len, parts)) < 40


def test_round_trip(encoder):
    decoder = sp.Decoder(VOCABULARY)
    for text in samples():
        assert decoder(encoder(text)) == text.replace(sp.SPACE, " ")


def test_frames(spark):
    texts = [None, *samples()[:12]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_ids")
    rows = {r.doc_id: r for r in sp.decode(sp.encode(docs)).collect()}
    sums = {r.doc_id: r for r in sp.summary(docs).collect()}
    for i, text in enumerate(texts):
        assert rows[i].ids == whole(text) and rows[i].decoded == (text or "").replace(sp.SPACE, " ")
        assert (sums[i].n_ids, sums[i].ids_crc32) == (len(whole(text)), crc32(np.array(whole(text), "<u4").tobytes()))
        assert sums[i].round_trip == (sp.SPACE not in (text or ""))
    assert sp.summary(docs.limit(0)).count() == 0
