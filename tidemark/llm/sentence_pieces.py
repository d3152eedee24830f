"""SentencePiece encoding by streaming Viterbi, and decoding.

The best segmentation of a text is the one whose pieces have the largest sum of scores. The search goes
through the text once. It keeps scores for the places that a piece may still reach, a window no longer than
the longest piece, and back pointers for what is not decided yet. Whenever all surviving paths pass through
one boundary, the ids up to it are final: they are given out and their back pointers dropped. Characters
outside the vocabulary become byte ids. A tie goes to the longer last piece.

No piece continues after a space, so all paths meet in front of every run of spaces: the search starts anew
there, and a word seen before is not searched again. New words of many texts are searched in sorted order;
scores up to a place depend on what stands before it only, so a word starts where it parts from the one before.
Words longer than `LONGEST_WORD` go through the streaming search.

The model at hand was trained as byte-pair pieces. Its library joins pieces by merges, so the best segmentation
by scores, which is what this operator gives, has other ids than the library's.

Null texts count as empty; empty texts have no ids. Decoding gives the text back, except that U+2581, the
sign for a space within pieces, comes back as a space (`round_trip` is then false). Rows are independent;
repeated rows and null ids stay; extra columns are left alone, output columns replace columns of their name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from struct import pack
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Memory, bound_batches, table

SPACE = "▁"
#: Words that a worker keeps per generation, and the longest kept.
WORDS, LONGEST_WORD = 250_000, 64

_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_vocabulary(path: str) -> dict:
    """Pieces, scores and byte ids of a model file, as plain values."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = [i for i in range(len(pieces))
             if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = [float(model.get_score(i)) for i in range(len(pieces))]
    return {"pieces": pieces, "plain": plain, "scores": scores, "unknown": min(scores) - 10,
            "bytes": [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]}


class Encoder:
    def __init__(self, vocabulary: dict) -> None:
        pieces, self.scores = vocabulary["pieces"], vocabulary["scores"]
        self.bytes, self.unknown = vocabulary["bytes"], vocabulary["unknown"]
        self.ids: dict[str, int] = {}  # every beginning of a piece; -1 if it is no piece itself
        for i in vocabulary["plain"]:
            for end in range(1, len(pieces[i])):
                self.ids.setdefault(pieces[i][:end], -1)
        for i in vocabulary["plain"]:
            self.ids[pieces[i]] = i
        self.longest = max(len(pieces[i]) for i in vocabulary["plain"])
        self.endings: dict[str, int] = {}  # every ending of a piece, likewise
        for i in vocabulary["plain"]:
            for start in range(1, len(pieces[i])):
                self.endings.setdefault(pieces[i][start:], -1)
        for i in vocabulary["plain"]:
            self.endings[pieces[i]] = i
        self.splits = not any(SPACE in pieces[i].lstrip(SPACE) for i in vocabulary["plain"])
        self.memory = Memory(WORDS)

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of `text` (spaces already written as U+2581), in parts as soon as they are final."""
        find, scores, unknown, longest, n = self.ids.get, self.scores, self.unknown, self.longest, len(text)
        best: dict[int, float] = {0: 0.0}  # of the places that surviving paths end at
        back: dict[int, tuple[int, int]] = {}
        base, patience = 0, 4 * longest
        for place in range(n):
            score = best.pop(place, None)
            if score is None:
                continue
            single = False
            for end in range(place + 1, min(place + longest, n) + 1):
                i = find(text[place:end])
                if i is None:
                    break
                if i >= 0:
                    single = single or end == place + 1
                    total = score + scores[i]
                    if end not in best or total > best[end]:
                        best[end], back[end] = total, (place, i)
            if not single:
                total = score + unknown
                if place + 1 not in best or total > best[place + 1]:
                    best[place + 1], back[place + 1] = total, (place, -1)
            if len(best) == 1:  # one place survives: everything before it is final
                boundary = next(iter(best))
                yield self._path(text, back, base, boundary)
                back.clear()
                base, patience = boundary, 4 * longest
            elif len(back) > patience:
                boundary = self._meeting(back, base, best)
                if boundary > base:
                    yield self._path(text, back, base, boundary)
                    back = {end: link for end, link in back.items() if end > boundary}
                    base = boundary
                patience = max(4 * longest, 2 * len(back))

    @staticmethod
    def _meeting(back: dict, base: int, live: dict) -> int:
        """The last boundary that the paths to all live places pass through."""
        common = None
        for at in live:
            passed = {at}
            while at > base:
                at = back[at][0]
                passed.add(at)
            common = passed if common is None else common & passed
        return max(common)

    def _path(self, text: str, back: dict, base: int, end: int) -> list[int]:
        out: list[int] = []
        while end > base:
            start, i = back[end]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.bytes[b] for b in reversed(text[start:end].encode("utf-8", "replace")))
            end = start
        return out[::-1]

    def _search(self, words: list[str]) -> None:
        """Remembers the ids of sorted words; what two neighbours begin with is searched once."""
        find, scores, unknown, longest, known = self.endings.get, self.scores, self.unknown, self.longest, self.memory.new
        best, back, before = [0.0], [(0, -1)], ""  # by place: score, and where the last piece starts and which it is
        for word in words:
            place, most = 0, min(len(word), len(before))
            while place < most and word[place] == before[place]:
                place += 1
            del best[place + 1:], back[place + 1:]
            for end in range(place + 1, len(word) + 1):
                start = end - 1
                i = find(word[start:end])
                if i is not None and i >= 0:
                    top, link = best[start] + scores[i], (start, i)
                else:
                    top, link = best[start] + unknown, (start, -1)
                if i is not None:
                    for start in range(end - 2, max(end - longest, 0) - 1, -1):
                        i = find(word[start:end])
                        if i is None:
                            break
                        if i >= 0:
                            total = best[start] + scores[i]
                            if total >= top:  # a tie goes to the longer piece
                                top, link = total, (start, i)
                best.append(top)
                back.append(link)
            out, end = [], len(word)
            while end:
                start, i = back[end]
                if i >= 0:
                    out.append(i)
                else:
                    out.extend(self.bytes[b] for b in reversed(word[start:end].encode("utf-8", "replace")))
                end = start
            out.reverse()
            known[word] = pack(f"<{len(out)}i", *out)
            before = word

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit bytes, with the space that SentencePiece puts in front."""
        lists = []
        for text in texts:
            marked = SPACE + text.replace(" ", SPACE) if text else ""
            lists.append(_WORD.findall(marked) if self.splits else [marked])
        fresh = self.memory.recall(set().union(*lists))
        known = self.memory.new
        long = [word for word in fresh if len(word) > LONGEST_WORD]
        for word in long:
            known[word] = np.fromiter(chain.from_iterable(self.stream(word)), "<i4").tobytes()
        self._search(sorted(word for word in fresh if len(word) <= LONGEST_WORD))
        out = [b"".join(map(known.__getitem__, words)) for words in lists]
        for word in long:
            del known[word]
        return out

    def __call__(self, text: str | None) -> list[int]:
        return np.frombuffer(self.many([text])[0], "<i4").tolist()


class Decoder:
    def __init__(self, vocabulary: dict) -> None:
        self.pieces = [p.replace(SPACE, " ") for p in vocabulary["pieces"]]
        self.bytes = {i: b for b, i in enumerate(vocabulary["bytes"])}
        self.byte_ids = frozenset(self.bytes)

    def __call__(self, ids: list[int]) -> str:
        if self.byte_ids.isdisjoint(ids):
            return "".join(map(self.pieces.__getitem__, ids))[1:]
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)[1:]


def _mapped(df: DataFrame, vocabulary: dict, make, source: str, kind: str):
    """A column of `make(vocabulary)` applied to `source`; workers keep one instance per task."""
    shared = bound_batches(df).sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary

    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        function = make(shared.value)
        for batch in batches:
            yield pd.Series([function(x) for x in batch], dtype=object)

    mapped.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(mapped, kind)(source)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`docs` with the array column `ids` of `text`."""
    return docs.withColumn("ids", _mapped(docs, load_vocabulary(path or model_path()), Encoder, "text", "array<int>"))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """`rows` with the column `decoded` of the array column `ids`."""
    def decoder(vocabulary: dict):
        own = Decoder(vocabulary)
        return lambda ids: own([]) if ids is None else own(list(ids))

    return rows.withColumn("decoded", _mapped(rows, load_vocabulary(path or model_path()), decoder, "ids", "string"))


def summary(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`docs` with n_ids, n_byte_ids, ids_crc32 (little-endian 32-bit ids) and round_trip, without the ids."""
    def summed(vocabulary: dict):
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        is_byte = np.zeros(len(vocabulary["pieces"]), bool)
        is_byte[vocabulary["bytes"]] = True

        def some(texts: list[str | None]) -> Iterator[tuple]:
            for text, packed in zip(texts, encoder.many(texts)):
                ids = np.frombuffer(packed, "<i4")
                yield len(ids), int(is_byte[ids].sum()), crc32(packed), decoder(ids.tolist()) == (text or "")

        return some

    vocabulary = load_vocabulary(path or model_path())
    shared = bound_batches(docs).sparkSession.sparkContext.broadcast(vocabulary)
    kept = docs.sparkSession.sparkContext.broadcast({})  # a worker's encoder, kept from task to task

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if "some" not in kept.value:
            kept.value["some"] = summed(shared.value)
        for batch in batches:
            yield pd.DataFrame(kept.value["some"](batch.tolist()), columns=["n_ids", "n_byte_ids", "ids_crc32", "round_trip"])

    rows.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(rows, "n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean")
    names = ("n_ids", "n_byte_ids", "ids_crc32", "round_trip")
    return docs.withColumn("_sums", udf("text")).withColumns({c: F.col(f"_sums.{c}") for c in names}).drop("_sums")


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
