import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id as li
from tidemark.llm import toxicity as tx
from tidemark.llm.common import held_out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_language_accuracy(spark, docs):
    found = li.predict(docs.select("doc_id", "text"), li.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    rate = found.where(held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert rate > 0.98


@pytest.fixture(scope="module")
def small(spark):
    rows = [("the cat sat on the mat", "en"), ("the dog and the cat", "en"), ("der hund und die katze", "de"), ("das haus", "de")]
    return li.train(spark.createDataFrame(rows, "text string, lang string"))


def by_hand(model, text):
    """Score by the rule itself: known words, else the longest n-grams of which half are known."""
    total = np.array(model["prior"], float)
    for word in li.words_of(text):
        if word in model["index"]:
            total += model["matrix"][model["index"][word]]
            continue
        for n in range(li.LONGEST_GRAM, 0, -1):
            grams = li.grams_of(word, n)
            own = [model["matrix"][model["grams"][g]] for g in grams if g in model["grams"]]
            if own and 2 * len(own) >= len(grams):
                total += np.sum(own, axis=0)
                break
    return model["langs"][int(np.argmax(total))]


def test_language_rules(spark, small):
    texts = ["the hat", "ein hunde haus", "CAT!", None, "", "123 -- 4", "кот", "katzen und hunde " * 3000, "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as score", "2 as lang")
    rows = {r.doc_id: r for r in li.predict(docs, small).collect()}
    for i, text in enumerate(texts):
        assert rows[i].lang_pred == (by_hand(small, text) if li.words_of(text) else "und")
        assert 0 <= rows[i].score <= 1
    assert rows[6].score == 0 and rows[3].score == 0
    none = li.train(docs.select("text", F.lit(None).cast("string").alias("lang")))
    assert {r.lang_pred for r in li.predict(docs, none).collect()} == {"und"}
    assert li.predict(docs.limit(0), small).count() == 0


def test_unknown_texts_go_and_others_stay(spark, docs):
    more = spark.createDataFrame([(None, None, None, "s", 0), (-1, "12 34", None, "s", 5)], docs.schema)
    kept = li.keep_known(docs.unionByName(more))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    more = spark.createDataFrame([(-2, "αλλά εδώ δεν ξέρει τίποτα", None, "s", 5), (-3, "² ½ Ⅷ ①", None, "s", 5)], docs.schema)
    clash = docs.limit(20).unionByName(more).withColumns({c: F.lit("clash") for c in ("score", "known", "lang_pred", "_lang")})
    kept = li.keep_known(clash)
    assert kept.columns == clash.columns
    assert {tuple(r)[-4:] for r in kept.collect()} == {("clash",) * 4} and kept.count() == 20


def test_numerals_are_no_letters(spark, small):
    assert li.words_of("m² Ⅷ½ Ünder x①y 一二 _a9b") == ["m", "ünder", "x", "y", "一二", "a", "b"]
    docs = spark.createDataFrame([(1, "² ½ Ⅷ ① 12")], "doc_id long, text string")
    assert [(r.lang_pred, r.score, r.known) for r in li.predict(docs, small).collect()] == [("und", 0.0, 0.0)]


@pytest.fixture(scope="module")
def cost(docs):
    return tx.language_model(docs)


def test_character_model_counts_every_script(spark):
    words = ["żółć gęś кот αβγ"] * 50
    cost = tx.language_model(spark.createDataFrame([(w,) for w in words], "text string"))
    other = tx.SYMBOLS - 1
    assert cost[other, other, other] < cost[other, other, 0] + 1 and cost[0, other, other] < 0.5  # no letter is a boundary
    counts = np.full((tx.SYMBOLS,) * 3, 0.1)
    for w in words:
        marks = [tx._symbol(c) if c.isalpha() else 0 for c in w]
        for a, b, c in zip(marks, marks[1:], marks[2:]):
            counts[a, b, c] += 1
    assert np.argmin(cost[other, other]) == np.argmax(counts[other, other])


def test_restoration(cost):
    for hidden, word in {"1d10t": "idiot", "i.d.i.o.t": "idiot", "stuuuupid": "stupid", "p4thet1c": "pathetic", "m0r0n": "moron",
                         "$tupid": "stupid", "l0$er": "loser", "s-c-u-m": "scum", "w0rthless": "worthless", "tr@sh": "trash"}.items():
        assert tx.restore(hidden, cost) == word
        assert word in tx.restored_words(hidden, cost)
    assert tx.restored_words("stupid", cost) == ["stupid"] and tx.restored_words("--- 12", cost) == []


def test_restoration_is_the_cheapest_reading(cost):
    """Against every reading of short stretches."""
    def readings(stretch):
        done = [(0.0, "")]
        for at, sign in enumerate(stretch):
            if sign.isalpha():
                options = [(sign, 0.0)] + ([("", tx.REPEAT)] if at and sign == stretch[at - 1] else [])
            else:
                options = [(" ", tx.SIGN if sign in tx.LOOKALIKES else 0.0)]
                options += [(x, tx.LOOKALIKE) for x in tx.LOOKALIKES.get(sign, "")] + ([] if sign.isalnum() else [("", tx.DROP)])
            done = [(c + price, text + x) for c, text in done for x, price in options]
        for spent, text in done:
            a = b = 0
            for letter in text + " ":
                k = 0 if letter == " " else tx._symbol(letter)
                if k or b:
                    spent, a, b = spent + cost[a, b, k], b, k
            yield spent, " ".join(text.split())

    for stretch in ["1d10t", "a.b", "llll", "s$s", "x1-0y", "a!b@c", "5-5"]:
        assert " ".join(tx.restore(stretch, cost).split()) in [t for c, t in readings(stretch) if c <= min(readings(stretch))[0] + 1e-9]


def test_toxic_texts_are_found(spark, cost):
    words = "alle meine enten schwimmen auf dem see und der wind weht kalt heute morgen wieder sehr leise".split()
    rows = []
    for i in range(240):
        text = " ".join(words[(i * k + k * k + i // 16) % len(words)] for k in range(1, 12)) + f" w{i}"
        rows.append((text + (" grumpf" + "abcdefgh"[i % 8] if i % 6 == 0 else ""), int(i % 6 == 0)))
    model = tx.train(spark.createDataFrame(rows, "text string, toxic int"), cost)
    texts = ["ein grumpfz im see", "GRUMPFA!", "g r u m p f e ist da", "gr0mpf", "enten im see", None, "", "gruuuumpfa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as score")
    got = {r.doc_id: r.predicted for r in tx.score(docs, cost, model).collect()}
    assert [got[i] for i in (0, 1, 2, 4, 5, 6)] == [1, 1, 1, 0, 0, 0]
    assert tx.score(docs.limit(0), cost, model).count() == 0


def test_without_labels(spark, docs, cost):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cost, model = tx.learn(docs, none)
    assert tx.score(docs, cost, model).where("score <> 0 or predicted <> 0").count() == 0
    assert tx.keep_clean(docs, none).count() == docs.count()


def test_held_out_toxicity(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = tx.score(docs, *tx.learn(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id")))
    rows = found.select("toxic", "predicted").collect()
    assert sum(r.predicted for r in rows if not r.toxic) <= 1
    assert sum(r.predicted for r in rows if r.toxic) >= 0.3 * sum(r.toxic for r in rows)


def test_single_repeats_and_signs_set_apart(cost):
    reader = tx.Reader(cost)
    for hidden, word in {"stuupid": "stupid", "iddiot": "idiot", "moronn": "moron", "morron": "moron", "traash": "trash",
                         "m 0 r o n": "moron", "1 d 1 o t": "idiot", "i d i o t": "idiot", "$ t u p i d": "stupid",
                         "i  d  i  o  t": "idiot", "i\td\ti\to\tt": "idiot", "i\nd\ni\no\nt": "idiot", "an i, d, i, o, t!": "idiot",
                         "5 c u m": "scum", "(m o r o n  i d i o t)": "moron", "a s s": "ass", "1 0 5 e r": "loser"}.items():
        assert f"<{word}>" in reader(hidden), hidden
    assert list(tx.spaced_out("1 2 3 4 and x y, no")) == []


def test_hidden_toxic_texts_are_found(spark, cost):
    words = "alle meine enten schwimmen auf dem see und der wind weht kalt heute morgen wieder sehr leise".split()
    rows = []
    for i in range(240):
        text = " ".join(words[(i * k + k * k + i // 16) % len(words)] for k in range(1, 12)) + f" w{i}"
        rows.append((text + (" grumpf" + "abcdefgh"[i % 8] if i % 6 == 0 else ""), int(i % 6 == 0)))
    model = tx.train(spark.createDataFrame(rows, "text string, toxic int"), cost)
    # the eight texts of test_toxic_texts_are_found ("grompf" is another word), then more ways to hide it
    texts = ["ein grumpfz im see", "GRUMPFA!", "g r u m p f e ist da", "gr0mpf", "enten im see", None, "", "gruuuumpfa",
             "ein grrumpfe", "g  r  u  m  p  f  e", "g\tr\tu\tm\tp\tf\t4", "g r u m p f 3", "seen und wellen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in tx.score(docs, cost, model).collect()}
    assert [got[i] for i in range(len(texts))] == [1, 1, 1, 0, 0, 0, 0, 1, 1, 1, 1, 1, 0]


def test_skipped_words_have_no_wanted_feature():
    import random

    pick = random.Random(8)
    cost = np.array([pick.random() * 9 for _ in range(tx.SYMBOLS ** 3)]).reshape((tx.SYMBOLS,) * 3)
    wanted = {f: i for i, f in enumerate(["<idiot>", "<moro", "<aab", "<abb>", "<ooab", "<a>", "<abaab"])}
    reader = tx.Reader(cost, wanted)
    words = ["".join(pick.choices("aabbom", k=pick.randint(1, 7))) for _ in range(3000)]
    words += [pick.choice(["", "(", "."]) + w + pick.choice(["", ",", "!", "0", "..", "-b"]) for w in words]
    words += ["iddiiot", "IDIOT,".lower(), "mmorron", "moorön"]
    for word in words:
        found = tx.features_of(tx.restored_words(word, cost))
        assert reader._chunk(word) == tuple(sorted(wanted[f] for f in found & wanted.keys()))
    assert sum(map(reader._hopeless, words)) > 100
