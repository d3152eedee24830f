"""Language ID, word first: known words score by their log frequency per language, unseen words by n-grams.

A word of the learned vocabulary adds its log frequency in each language. Any other word backs off to its
character n-grams, from five letters down to one: the longest length at which at least half of the word's
n-grams are known decides. Words without a single known letter say nothing.

The model is fitted on a bounded sample of labelled texts and its vocabulary is bounded, so its size does
not follow the corpus; prediction reads every whole text.

`known` is the share of a text's words that have a known n-gram, 0 without a word. The stage of the pipeline goes by it,
not by the score: a low score only says that learned languages are close.

Null texts and texts without a letter are `und` with score 0. If nothing could be learned, every text is
`und`. A text in whose words nothing is known gets the most frequent language with score 0. Equal scores go
to the language that sorts first. Rows are independent; extra columns stay; `lang_pred`, `score`, `known` are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, bounded_sample, by_rows, held_out, table, written

#: Labelled texts that the model is fitted on, and the words it keeps.
SAMPLE_TEXTS, VOCABULARY = 20_000, 50_000
LONGEST_GRAM, SMOOTHING = 5, 0.5
#: Words that the score takes as independent evidence at most; keeps long texts from all scoring 1.
EVIDENCE_WORDS = 25
#: Share of known words from which on a text counts as one in a learned language.
MIN_KNOWN = 0.5
#: Unseen words remembered by a worker before it forgets them.
REMEMBERED = 150_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case; signs such as superscript and Roman numerals part words like digits do."""
    words = _WORD.findall(text.lower()) if text else []
    if words and not "".join(words).isalpha():
        words = "".join(c if c.isalpha() else " " for word in words for c in f"{word} ").split()
    return words


def grams_of(word: str, n: int) -> list[str]:
    padded = f"<{word}>" if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def _word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in by_rows(frames):
        counts: Counter = Counter()
        for text, lang in zip(frame["text"], frame["lang"]):
            counts.update((w, lang) for w in words_of(text))
        yield pd.DataFrame([(w, lang, n) for (w, lang), n in counts.items()], columns=["word", "lang", "n"])


def _centred(counts: np.ndarray, totals: np.ndarray, kinds: int) -> np.ndarray:
    logs = np.log(counts + SMOOTHING) - np.log(totals + SMOOTHING * kinds)
    return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def train(labelled: DataFrame) -> dict:
    """The model from (text, lang) rows: languages, priors, and rows of a matrix by word and by n-gram."""
    rows = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counted = written(bound_batches(bounded_sample(rows, SAMPLE_TEXTS)).repartition("text").mapInPandas(
        _word_counts, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")))
    per_lang = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(per_lang)
    if not langs:
        return {"langs": [], "index": {}, "grams": {}, "matrix": np.zeros((1, 0), np.float32), "prior": np.zeros(0)}
    best = counted.groupBy("word").agg(F.sum("n").alias("total"), F.map_from_entries(
        F.collect_list(F.struct("lang", "n"))).alias("by")).orderBy(F.desc("total"), "word").limit(VOCABULARY).collect()
    place = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((len(best), len(langs)))
    for i, row in enumerate(best):
        for lang, n in row.by.items():
            counts[i, place[lang]] = n
    totals = np.array([per_lang[lang] for lang in langs], float)
    blocks, grams = [np.zeros((1, len(langs)), np.float32), _centred(counts, totals, len(best))], {}
    used = 1 + len(best)
    for n in range(1, LONGEST_GRAM + 1):
        pairs = [(gram, i) for i, row in enumerate(best) for gram in grams_of(row.word, n)]
        if pairs:
            codes, own = pd.factorize(np.array([gram for gram, _ in pairs], dtype=object))
            weights = counts[[i for _, i in pairs]]
            block = np.stack([np.bincount(codes, weights[:, k], len(own)) for k in range(len(langs))], axis=1)
            blocks.append(_centred(block, block.sum(axis=0), len(own)) / n)
            grams |= {gram: used + i for i, gram in enumerate(own)}
            used += len(own)
    return {"langs": langs, "index": {row.word: i + 1 for i, row in enumerate(best)}, "grams": grams,
            "matrix": np.concatenate(blocks), "prior": np.log(totals / totals.sum())}


class Scorer:
    """Adds up word rows; rows of unseen words are made once by back-off and remembered for a while."""

    def __init__(self, model: dict) -> None:
        self.model, self.langs = model, model["langs"]
        self._forget()

    def _forget(self) -> None:
        self.place = dict(self.model["index"])
        self.matrix, self.used = self.model["matrix"], len(self.model["matrix"])
        self.matrix = np.concatenate([self.matrix, np.zeros((1024, len(self.langs)), np.float32)])

    def _add(self, words: list[str]) -> None:
        """Matrix rows of words outside the vocabulary; row 0, all zero, for those with no known letter."""
        place, known, rows, starts, found = self.place, self.model["grams"], [], [], []
        for word in words:
            place[word] = 0
            for n in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
                grams = grams_of(word, n)
                own = [known[g] for g in grams if g in known]
                if own and 2 * len(own) >= len(grams):
                    starts.append(len(rows))
                    rows += own
                    found.append(word)
                    break
        if found:
            while self.used + len(found) > len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[self.used:self.used + len(found)] = np.add.reduceat(self.matrix[rows], starts, axis=0)
            for word in found:
                place[word] = self.used
                self.used += 1

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        lists = [words_of(t) for t in texts]
        if self.langs:
            if len(self.place) > len(self.model["index"]) + REMEMBERED:
                self._forget()
            self._add([w for w in dict.fromkeys(w for words in lists for w in words) if w not in self.place])
        return [self._one(words) for words in lists]

    def _one(self, words: list[str]) -> tuple[str, float, float]:
        if not words or not self.langs:
            return UNKNOWN, 0.0, 0.0
        rows = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        known = int(np.count_nonzero(rows))
        if not known:
            return self.langs[int(np.argmax(self.model["prior"]))], 0.0, 0.0
        total = self.model["prior"] + self.matrix[rows].sum(axis=0, dtype=np.float64)
        best = int(np.argmax(total))
        tempered = (total - total[best]) * min(1.0, EVIDENCE_WORDS / known)
        return self.langs[best], 1.0 / float(np.exp(tempered).sum()), known / len(words)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` with `lang_pred`, `score` and `known`."""
    shared = bound_batches(docs).sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            found = [x for at in range(0, len(texts), 128) for x in scorer(texts.iloc[at:at + 128].tolist())]
            yield pd.DataFrame(found, columns=["lang_pred", "score", "known"])

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(scored, "lang_pred string, score double, known double")
    return docs.withColumn("_lang", udf("text")).withColumns(
        {"lang_pred": F.col("_lang.lang_pred"), "score": F.col("_lang.score"), "known": F.col("_lang.known")}).drop("_lang")


def learn(docs: DataFrame) -> dict:
    """The model from the two thirds of `docs` that may be learned from."""
    return train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))


def keep_known(docs: DataFrame, min_known: float = MIN_KNOWN) -> DataFrame:
    """`docs` without texts that are `und` or in no learned language; a missing `lang` is filled in.

    A text is in no learned language if less than `min_known` of its words have a known n-gram.
    """
    found = predict(docs.select(F.struct("*").alias("doc"), "text"), learn(docs)).where(
        (F.col("lang_pred") != UNKNOWN) & (F.col("known") >= min_known))
    return found.select([F.coalesce("doc.lang", "lang_pred").alias("lang") if c == "lang" else F.col("doc")[c].alias(c)
                         for c in docs.columns])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
