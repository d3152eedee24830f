"""Toxicity: noisy-channel deobfuscation, then a score over the restored words.

Writers hide words by look-alike characters, separators between letters and repeated letters. Each such
stretch becomes a character lattice: a sign stands for itself or for the letters it resembles, a separator
for a word boundary or for nothing, a repeated letter for itself or for nothing. A Viterbi search finds the
cheapest reading under a character trigram model whose counts cover every text. A stretch of plain letters,
none of them next to its equal, has one reading only and passes through. Three or more single signs set apart, by
whatever white space or separators, are one stretch.

The score comes from features of restored words (the word, or its first four to six letters). Features are
chosen on a bounded sample of labelled texts by covering: the feature that explains most toxic texts not
explained yet, again and again, while a significant and precise one is left. Covering keeps the ordinary words
that copies of one toxic text share from counting as evidence. A text's score is the chance that at least
one of its features is right (noisy or); a text without any gets the rate left among such texts.

Null and empty texts have no features. If there are no labels, all scores are 0. Rows are independent;
extra columns stay; `score`, `predicted` are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Memory, bound_batches, bounded_sample, by_rows, held_out, table, written

#: Labelled texts that features are chosen on, and candidate features considered.
SAMPLE_TEXTS, CANDIDATES = 20_000, 3000
PREFIXES = (4, 5, 6)
MIN_PRECISION, THRESHOLD = 0.9, 0.7
#: Restored stretches that a worker keeps per generation.
REMEMBERED = 100_000

#: Look-alikes, a fixed table: sign to the letters it may stand for.
LOOKALIKES = {"0": "o", "1": "il", "!": "i", "|": "il", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s",
              "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "(": "c"}
#: Costs in nats of a look-alike, of a sign that is none, of a dropped separator and of a dropped repeat.
LOOKALIKE, SIGN, DROP, REPEAT = 1.0, 7.0, 1.0, 5.0
#: Symbols of the trigram model: 0 a boundary, 1 to 26 the letters a to z, 27 any other letter.
SYMBOLS = 28

#: Between signs set apart: anything that is neither a letter, a digit nor a look-alike.
_GAP = re.compile(rf"(?:(?![{re.escape(''.join(LOOKALIKES))}])[\W_])+")
_SIGN = rf"[^\W\d_{re.escape(''.join(LOOKALIKES))}]|[{re.escape(''.join(LOOKALIKES))}]"
_SPACED = re.compile(rf"(?<![^\W_])(?:{_SIGN})(?:{_GAP.pattern}(?:{_SIGN})(?![^\W_])){{2,}}")
_EDGES = re.compile(r"^[^\w@$!|+(]+|[^\w@$!|+(]+$")
_REPEAT, _REPEATS = re.compile(r"(.)\1"), re.compile(r"(.)\1+")
_WIDE = re.compile(r" {2,}")
_LETTERS = re.compile(r"[^\W\d_]+")


def _symbol_table() -> np.ndarray:
    """Symbols of the first 256 code points."""
    kinds = np.zeros(256, np.int64)
    for code in range(256):
        letter = chr(code)
        if "a" <= letter <= "z":
            kinds[code] = code - 96
        elif letter.isalpha():
            kinds[code] = SYMBOLS - 1
    return kinds


def _trigrams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram counts of all texts of a partition: at most SYMBOLS cubed rows, however long the input."""
    kinds, counts = _symbol_table(), np.zeros(SYMBOLS ** 3, np.int64)
    for frame in by_rows(frames, 256):
        joined = "\n\n".join(t.lower() for t in frame["text"] if t)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes, wide = kinds[np.minimum(points, 255)], np.flatnonzero(points > 255)
        own, place = np.unique(points[wide], return_inverse=True)
        codes[wide] = np.array([(SYMBOLS - 1) * chr(c).isalpha() for c in own], np.int64)[place]
        if len(codes) > 2:
            counts += np.bincount((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:], minlength=SYMBOLS ** 3)
    seen = np.flatnonzero(counts)
    yield pd.DataFrame({"gram": seen, "n": counts[seen]})


def language_model(docs: DataFrame) -> np.ndarray:
    """Cost in nats of a symbol after two others, from the texts of all rows."""
    rows = bound_batches(docs).select("text").mapInPandas(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.full(SYMBOLS ** 3, 0.1)
    for row in rows.collect():  # at most SYMBOLS cubed
        counts[row.gram] += row.n
    cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return (-np.log(cube / cube.sum(axis=2, keepdims=True))).astype(np.float64)


def _symbol(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else SYMBOLS - 1


def restore(stretch: str, cost: np.ndarray) -> str:
    """The cheapest reading of a lower-case stretch; boundaries become spaces. Ties: fewer changes first."""
    paths: dict[tuple[int, int], tuple[float, object]] = {(0, 0): (0.0, None)}
    previous = ""
    for sign in [*stretch, "\n"]:
        if sign == "\n":
            options = [("", " ", 0.0)]
        elif sign.isalpha():
            options = [(sign, sign, 0.0)]
            if sign == previous:
                options.append(("", "", REPEAT))
        else:
            options = [("", " ", SIGN if sign in LOOKALIKES else 0.0)]
            options += [(letter, letter, LOOKALIKE) for letter in LOOKALIKES.get(sign, "")]
            if not sign.isalnum():
                options.append(("", "", DROP))
        following: dict[tuple[int, int], tuple[float, object]] = {}
        for (a, b), (spent, trail) in paths.items():
            for letter, written, price in options:
                if not written:  # nothing is written: the context stays
                    state, total, end = (a, b), spent + price, trail
                else:
                    k = _symbol(letter) if letter else 0
                    if k == 0 and b == 0:
                        state, total, end = (a, b), spent + price, trail
                    else:
                        state, total, end = (b, k), spent + price + cost[a, b, k], (trail, written)
                if state not in following or total < following[state][0]:
                    following[state] = (total, end)
        paths, previous = following, sign
    trail = min(paths.items(), key=lambda p: (p[1][0], p[0]))[1][1]
    out = []
    while trail:
        trail, letter = trail
        out.append(letter)
    return "".join(reversed(out)).strip()


def restored_words(chunk: str, cost: np.ndarray) -> list[str]:
    """Words of one lower-case chunk without white space, restored if anything in it could hide a letter.

    A restored stretch also counts as its letters are written, and without any repeat: the character model
    knows no words, so it may keep a repeat that hides one.
    """
    if chunk.isalpha() and not _REPEAT.search(chunk):
        return [chunk]
    core = _EDGES.sub("", chunk)
    letters = _LETTERS.findall(core)
    if not letters:
        return []
    if len(letters) == 1 and core == letters[0] and not _REPEAT.search(core):
        return letters
    read = _LETTERS.findall(restore(core, cost))
    if read == letters and not _REPEAT.search(core):
        return read
    return [*dict.fromkeys([*read, *letters, *(_REPEATS.sub(r"\1", word) for word in read)])]


def spaced_out(text: str) -> Iterator[str]:
    """Stretches of a lower-case text whose signs stand apart, one space for the narrowest gap, more for wider ones."""
    for m in _SPACED.finditer(text):
        run = m[0]
        if _LETTERS.search(run):
            least = min(len(gap) for gap in _GAP.findall(run))
            yield _GAP.sub(lambda gap: " " * (len(gap[0]) - least + 1), run)


def features_of(words: list[str]) -> set[str]:
    out = set()
    for word in words:
        out.add(f"<{word}>")
        out.update(f"<{word[:n]}" for n in PREFIXES if len(word) >= n)
    return out


class Reader:
    """Features of whole texts; stretches seen before are not decoded again."""

    def __init__(self, cost: np.ndarray, wanted: dict[str, int] | None = None) -> None:
        self.cost, self.wanted, self.known = cost, wanted, Memory(REMEMBERED)
        #: What a word with a wanted feature begins with, repeats left out.
        self.heads = {_REPEATS.sub(r"\1", f.strip("<>")[:min(PREFIXES)]) for f in wanted or ()}
        self.head_sizes = sorted({len(head) for head in self.heads})

    def _hopeless(self, chunk: str) -> bool:
        """True if the chunk is a word of which no reading has a wanted feature: readings differ in repeats only."""
        core = chunk if chunk.isalpha() else _EDGES.sub("", chunk)
        if self.wanted is None or not core.isalpha():
            return False
        if _REPEAT.search(core):
            core = _REPEATS.sub(r"\1", core)
        return not any(core[:n] in self.heads for n in self.head_sizes)

    def _chunk(self, chunk: str) -> tuple:
        if self._hopeless(chunk):
            return ()
        found = features_of(restored_words(chunk, self.cost))
        return tuple(sorted(found) if self.wanted is None else sorted(
            {self.wanted[f] for f in found if f in self.wanted}))

    def __call__(self, text: str | None) -> set:
        """All features of the text, or the numbers of the wanted ones."""
        if not text:
            return set()
        low = text.lower()
        chunks = set(low.split())
        apart: set = set()
        for run in spaced_out(low):  # the whole run is one stretch; closed up, its wider gaps part words
            for word in {*_LETTERS.findall(restore(run, self.cost)), *_WIDE.split(run)}:
                apart.update(self._chunk(word.replace(" ", "")))
        for chunk in self.known.recall(chunks):
            self.known.new[chunk] = self._chunk(chunk)
        known, out = self.known.new, apart
        for found in map(known.__getitem__, chunks):
            if found:
                out.update(found)
        return out


def _gain(hits: np.ndarray, misses: np.ndarray, base: float) -> np.ndarray:
    """Twice the log-likelihood ratio of a feature's own rate of toxic texts against the base rate."""
    total = hits + misses
    rate = np.clip(hits / np.maximum(total, 1), 1e-12, 1 - 1e-12)
    return 2 * np.where(rate > base, hits * np.log(rate / base) + misses * np.log((1 - rate) / (1 - base)), 0.0)


def choose(rows: list[tuple[str, int]], incidence: list[list[int]], misses: np.ndarray, positives: int,
           negatives: int, tested: int) -> list[tuple[str, float]]:
    """(feature, precision) chosen by covering. rows: candidates; incidence: candidates of each toxic text."""
    hits = np.zeros(len(rows))
    holders: dict[int, list[int]] = {}
    for text, found in enumerate(incidence):
        for f in found:
            hits[f] += 1
            holders.setdefault(f, []).append(text)
    left, covered = hits.copy(), np.zeros(len(incidence), bool)
    base = positives / (positives + negatives)
    usable = _gain(hits, misses, base) >= 10 + 2 * math.log(max(tested, 2))  # significant among all tested
    out: list[tuple[str, float]] = []
    while True:
        gain = np.where(usable & (left > 0), 1e-9 + _gain(left, misses, base), 0.0)
        if not len(gain) or gain.max() <= 0:
            return out
        best = int(np.flatnonzero(gain == gain.max())[0])
        out.append((rows[best][0], float((hits[best] + 2 * base) / (hits[best] + misses[best] + 2))))
        for text in holders[best]:
            if not covered[text]:
                covered[text] = True
                for f in incidence[text]:
                    left[f] -= 1


def _sketches(texts: pd.Series) -> pd.Series:
    """The smallest hash of a text's runs of three words: equal for copies, and for near copies in most cases."""
    def smallest(text: str) -> int:
        words = text.lower().split()
        return min((crc32(" ".join(words[i:i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 2))))

    return texts.map(smallest).astype("int64")


def train(labelled: DataFrame, cost: np.ndarray) -> dict:
    """Feature probabilities from a bounded table of (text, toxic) rows; of near copies mostly one text counts."""
    shared = bound_batches(labelled).sparkSession.sparkContext.broadcast(cost)
    sample = written(labelled.where(F.col("text").isNotNull() & F.col("toxic").isNotNull()).withColumn(
        "sketch", F.pandas_udf(_sketches, "long")("text")).groupBy("sketch", F.col("toxic").cast("int").alias("toxic")).agg(
        F.min("text").alias("text")).select("text", "toxic"))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value)
        for frame in by_rows(frames):
            hits, misses = Counter(), Counter()
            for text, toxic in zip(frame["text"], frame["toxic"]):
                (hits if toxic == 1 else misses).update(reader(text))
            both = list(hits.keys() | misses.keys())
            yield pd.DataFrame({"feature": both, "hits": [hits[f] for f in both], "misses": [misses[f] for f in both]})

    sizes = {r.toxic: r["count"] for r in sample.groupBy(F.col("toxic") == 1).count().toDF("toxic", "count").collect()}
    positives, negatives = sizes.get(True, 0), sizes.get(False, 0)
    if not positives or not negatives:
        return {"wanted": {}, "chance": np.zeros(0), "rest": float(positives > 0)}
    base = positives / (positives + negatives)
    rows = written(sample.mapInPandas(counted, "feature string, hits long, misses long").groupBy("feature").agg(
        F.sum("hits").alias("hits"), F.sum("misses").alias("misses")))
    tested = rows.count()
    rate = F.col("hits") / (F.col("hits") + F.col("misses"))
    odds = F.col("hits") * F.log(rate / base) + F.when(
        F.col("misses") > 0, F.col("misses") * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    best = rows.where((F.col("hits") >= 2) & (rate >= MIN_PRECISION)).orderBy(
        F.desc(odds), "feature").limit(CANDIDATES).collect()
    wanted = {r.feature: i for i, r in enumerate(best)}
    misses = np.array([r.misses for r in best], float)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value, wanted)
        for frame in by_rows(frames):
            yield pd.DataFrame({"toxic": frame["toxic"] == 1, "found": [sorted(reader(t)) for t in frame["text"]]})

    incidence = [r.found for r in sample.where("toxic = 1").mapInPandas(
        placed, "toxic boolean, found array<int>").collect()]  # at most the sample's rows
    chosen = choose([(r.feature, r.hits) for r in best], incidence, misses, positives, negatives, tested)
    numbers = {wanted[f] for f, _ in chosen}
    rest = sum(not numbers.intersection(found) for found in incidence)
    return {"wanted": {f: i for i, (f, _) in enumerate(chosen)}, "chance": np.array([p for _, p in chosen]),
            "rest": rest / (rest + negatives)}


def score(docs: DataFrame, cost: np.ndarray, model: dict) -> DataFrame:
    """`docs` with `score` and `predicted`."""
    shared = bound_batches(docs).sparkSession.sparkContext.broadcast((cost, model))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cost, model = shared.value
        reader, safe = Reader(cost, model["wanted"]), 1.0 - model["chance"]
        for texts in batches:
            out = []
            for text in texts:
                found = sorted(reader(text))
                out.append(1.0 - (1.0 - model["rest"]) * float(np.prod(safe[found])) if found else model["rest"])
            yield pd.Series(out, dtype=float)

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    out = docs.withColumn("score", F.pandas_udf(scored, "double")("text"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict]:
    """The character model of all texts, and features from the labels that may be learned from."""
    cost = language_model(docs)
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    known = bounded_sample(usable, SAMPLE_TEXTS, "doc_id")
    return cost, train(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic"), cost)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the texts predicted toxic."""
    return score(docs, *learn(docs, labels)).where("predicted = 0").select(docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, *learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
