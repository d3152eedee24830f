"""Best-fit decreasing packing of tokenised documents into sequences of a fixed capacity.

Documents become pieces of at most `CAPACITY` token ids. Best-fit decreasing places pieces from the longest
to the shortest, each into the open sequence with the least room that still holds it. The order among equal
lengths does not matter, so the decisions depend on the number of pieces per length alone: a histogram of at
most `CAPACITY` rows, whatever the corpus holds. The plan is made on the histogram: sequences with equal
contents are one interval of numbers, kept by remaining room in a segment tree that finds the tightest fit
in logarithmic time. Each step places a whole run of pieces. Spark then ranks pieces within their length and
joins them to the runs, so the result is the exact global packing and no task ever holds it.

A null text counts as empty; an empty document is the end id alone. Repeated rows and null ids are packed
like any other; ties among equal lengths go by (doc_id, piece) hash. An empty table gives no rows. Extra
columns of the input are not carried; the pieces' own payload columns are.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, by_rows, table, written

CAPACITY, END_ID = 4096, 1
#: Pieces of one length that are ranked together; longer runs are split.
RANKED_TOGETHER = 1000
#: Characters encoded at once, and the longest word that the rank encoder merges itself.
TOGETHER, LONGEST_WORD = 1_000_000, 400

#: The tokenizer's white space; str.split() knows more.
_SPACE = re.compile(
    r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")
#: Kinds of characters; `OTHER` ones are left to the tokenizer itself.
BLANK, LETTER, NUMBER, MARK, OTHER = range(5)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _kinds() -> np.ndarray:
    """The kind of every code point below U+A000; the last entry stands for all beyond.

    A character has a kind if lower-casing and composition change it by itself alone: no marks, no controls,
    nothing unassigned, no Hangul letters.
    """
    kinds = np.full(0xA001, OTHER, np.uint8)
    for code in [*range(0x1100), *range(0x1200, 0x3000), *range(0x4E00, 0xA000)]:
        sign = chr(code)
        category = unicodedata.category(sign)[0]
        if _SPACE.fullmatch(sign):
            kinds[code] = BLANK
        elif category in "LNPS" and unicodedata.normalize("NFC", sign) == sign:
            kinds[code] = {"L": LETTER, "N": NUMBER}.get(category, MARK)
    return kinds


class TextEncoder:
    """Ids of whole texts as little-endian 32-bit bytes: those of the tokenizer, from a merge by ranks.

    The tokenizer cuts a lower-case text into words (runs of letters, single digits, runs of marks, English
    contractions), writes them as bytes, the last one of each word as a sign of its own, and joins neighbours in
    the order of its merges. All merges make different pieces, so a merge is known by what it makes, which is
    how tiktoken works. Each of the 512 signs (a byte, last or not) is written as one character, and words are cut
    by array operations over the whole text. Nothing is remembered from text to text.

    The tokenizer never joins anything across white space. Runs between white space that hold an `OTHER`
    character, a special token or a very long word are therefore given to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer, self.kinds = Tokenizer.from_file(path), _kinds()
        # letters, last letters and digits are one byte each, all other signs two
        self.signs = np.arange(0x100, 0x300, dtype="<u4")
        self.signs[97:123] = np.arange(97, 123)
        self.signs[256 + 97:256 + 123] = np.arange(65, 91)
        self.signs[256 + 48:256 + 58] = np.arange(48, 58)
        vocabulary = json.loads(self.tokenizer.to_str())["model"]["vocab"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible}
        byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
        ranks, ids = {bytes([b]): b for b in range(256)}, [0] * 256
        for piece, number in sorted(vocabulary.items(), key=lambda x: x[1]):
            last = piece.endswith("</w>") and len(piece) > 4
            places = [byte_of[c] for c in (piece[:-4] if last else piece)]
            places[-1] += 256 * last
            written = "".join(chr(self.signs[p]) for p in places).encode()
            if written in ranks:
                ids[ranks[written]] = number
            else:
                ranks[written] = len(ids)
                ids.append(number)
        self.ids = np.array(ids, "<u4")
        ends = "A-Z0-9\u0200-\u02ff"
        self.core = Encoding("words", pat_str=f"[^{ends}]*[{ends}]", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def _merged(self, text: str) -> bytes | None:
        """Ids of `text`; None if it holds something for the tokenizer."""
        if "<|" in text or "\u03a3" in text:  # special tokens; a sigma's lower case depends on its neighbours
            return None
        low = text.lower()
        codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = self.kinds[np.minimum(codes, len(self.kinds) - 1)]
        if (kinds == OTHER).any():
            return None
        ends = kinds == NUMBER
        ends[:-1] |= kinds[:-1] != kinds[1:]
        ends[-1:] = True
        if "'" in low:
            for m in _CONTRACTION.finditer(low):
                if not m.start() or kinds[m.start() - 1] != MARK:
                    ends[m.start()], ends[m.end() - 1] = False, True
        if np.diff(np.flatnonzero(ends), prepend=-1).max(initial=0) > LONGEST_WORD:
            return None
        kept = kinds != BLANK
        if not low.isascii():
            width = 1 + (codes >= 0x80) + (codes >= 0x800).astype(np.int64)
            codes = np.frombuffer(low.encode(), np.uint8)
            last = np.zeros(len(codes), bool)
            last[np.cumsum(width) - 1] = ends
            ends, kept = last, np.repeat(kept, width)
        signs = self.signs[(codes + ends * np.uint32(256))[kept]].tobytes().decode("utf-32-le")
        return self.ids[np.frombuffer(self.core.encode_to_tiktoken_buffer(signs, set()), "<u4")].tobytes()

    def _exact(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        found = self._merged(text) if len(text) <= TOGETHER else None
        if found is not None:
            return found
        out, held, size = [], [], 0
        for run in [*_SPACE.split(text), None]:  # runs in a row that the merge can take stay together
            plain = run is not None and len(run) <= TOGETHER and self._plain(run)
            if held and (not plain or size > TOGETHER):
                out.append(self._merged(" ".join(held)))
                held, size = [], 0
            if plain:
                held.append(run)
                size += len(run) + 1
            elif run:
                out.append(self._exact(run))
        return b"".join(out)

    def _plain(self, run: str) -> bool:
        if run.isascii() and run.isalnum() and len(run) <= LONGEST_WORD:
            return True
        return self._merged(run) is not None


def pieces(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of every document; ids as little-endian bytes."""
    path, end = path or tokenizer_path(), END_ID.to_bytes(4, "little")
    kept = docs.sparkSession.sparkContext.broadcast({})  # a worker's encoder, kept from task to task

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if "encoder" not in kept.value:
            kept.value["encoder"] = TextEncoder(path)
        encoder = kept.value["encoder"]
        for frame in by_rows(frames, 256):
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids = (encoder(text) if isinstance(text, str) else b"") + end
                for piece, at in enumerate(range(0, len(ids), 4 * CAPACITY)):
                    part = ids[at:at + 4 * CAPACITY]
                    out.append((doc_id, piece, at // 4, len(part) // 4, crc32(part), part))
            made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            yield made.astype({"doc_id": "Int64"}) if with_ids else made.drop(columns="ids").astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return bound_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, schema)


class TightestFit:
    """Segment tree over remaining room 0 to capacity; each leaf holds intervals of equally filled sequences."""

    def __init__(self, capacity: int) -> None:
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.open = [0] * (2 * self.size)
        self.leaves: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]

    def _count(self, room: int, change: int) -> None:
        at = room + self.size
        while at:
            self.open[at] += change
            at //= 2

    def put(self, room: int, first: int, count: int, used: int) -> None:
        if count:
            self.leaves[room].append((first, count, used))
            self._count(room, 1)

    def take(self, length: int) -> tuple[int, int, int, int] | None:
        """The interval with the least room that holds `length`, as (room, first, count, used)."""
        at = length + self.size
        while not self.open[at]:
            while at & 1:  # a right child: everything to its right lies under its ancestors' siblings
                at //= 2
                if not at:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        room = at - self.size
        self._count(room, -1)
        return room, *self.leaves[room].pop()


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, pieces per sequence, first sequence, offset), by best-fit decreasing.

    Piece `rank` of a run goes to sequence first + (rank - first rank) // per, at offset plus length times the
    remainder. Filling one sequence until nothing of this length fits any more is what best fit does: after a
    piece, that sequence is the tightest that still holds the next one.
    """
    tree, runs, sequences = TightestFit(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            taken = tree.take(length)
            if taken is None:
                per = capacity // length
                room, first, count, used = capacity, sequences, -(-left // per), 0
                sequences += count
            else:
                room, first, count, used = taken
                per = room // length
            full = min(count, left // per)
            placed = min(left, count * per)
            runs.append((length, rank, placed, per, first, used))
            tree.put(room - per * length, first, full, used + per * length)
            rest = placed - full * per
            if rest:
                tree.put(room - rest * length, first + full, 1, used + rest * length)
            tree.put(room, first + full + (rest > 0), count - full - (rest > 0), used)
            rank, left = rank + placed, left - placed
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, length, any payload) with `sequence_id` and `offset`."""
    spark = cut.sparkSession
    counted = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(counted, capacity)
    assert len(runs) <= 64 * capacity  # bounded by the capacity: each step halves an interval's room or ends a length
    lanes = [(n, -(-count // RANKED_TOGETHER)) for n, count in counted.items()]
    lanes = spark.createDataFrame(lanes, "length long, lanes int")  # at most `capacity` rows
    mark = F.xxhash64("doc_id", "piece")
    laned = cut.join(F.broadcast(lanes), "length").withColumn("_lane", F.pmod(mark, F.col("lanes")).cast("int"))
    offsets = laned.groupBy("length", "_lane").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(
        F.sum("_n").over(Window.partitionBy("length").orderBy("_lane").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("length", "_lane").orderBy(mark, "doc_id", "piece"))
    ranked = laned.withColumn("_within", within).join(offsets.drop("_n"), ["length", "_lane"]) \
        .withColumn("_rank", F.col("_before") + F.col("_within") - 1)
    table_of_runs = spark.createDataFrame(
        runs, "length long, _first long, _count long, _per long, _sequence long, _used long")
    placed = ranked.join(F.broadcast(table_of_runs), "length").where(
        (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count")))
    nth = F.col("_rank") - F.col("_first")
    return placed.select(
        *cut.columns, (F.col("_sequence") + F.floor(nth / F.col("_per")).cast("long")).alias("sequence_id"),
        (F.col("_used") + (nth % F.col("_per")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place; `with_ids` carries the ids along."""
    return pack(written(pieces(docs, path, with_ids)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
