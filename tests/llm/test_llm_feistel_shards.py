import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import feistel_shards as shards


def hashed(*values):
    """Chained hash of whole numbers, 4 or 8 bytes wide."""
    seed = 42
    for kind, value in values:
        seed = xxhash.xxh64_intdigest(struct.pack(kind, value), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def walked(number, rows, seed):
    a, b = shards.sides(rows)
    while True:
        left, right = divmod(number, b)
        for i in range(shards.ROUNDS):
            left = (left + hashed(("<i", seed), ("<i", 2 * i), ("<q", right)) % a) % a
            right = (right + hashed(("<i", seed), ("<i", 2 * i + 1), ("<q", left)) % b) % b
        number = left * b + right
        if number < rows:
            return number


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 99, 100, 101, 1000, 4097])
def test_permutation_equals_walks_by_hand(spark, rows):
    a, b = shards.sides(rows)
    assert a * b >= rows and a * b - rows < a
    numbers = spark.range(rows).withColumnRenamed("id", "n")
    got = {r.n: r.p for r in shards.placed(numbers, "n", "p", rows, 5).collect()}
    assert got == {n: walked(n, rows, 5) for n in range(rows)}
    assert sorted(got.values()) == list(range(rows))
    # One row's place needs no other row.
    assert shards.placed(numbers.where(F.col("n") == rows // 2), "n", "p", rows, 5).first().p == got[rows // 2]


def test_shuffle_is_spread(spark):
    got = [r.p for r in shards.placed(spark.range(4000).withColumnRenamed("id", "n"), "n", "p", 4000).orderBy("n").collect()]
    steps = Counter((b - a) // 400 for a, b in zip(got, got[1:]))
    assert max(steps.values()) < 800 and len(set(a % 8 * 8 + b % 8 for a, b in zip(got, got[1:]))) == 64


def write(spark, path, rows, partitions):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "7 as shard", "'x' as slot", "0L as row_number", "1 as place", "2 as size")
    frame.repartition(partitions).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("partitions", [1, 7])
def test_query_by_hand(spark, tmp_path, partitions):
    rows = [(i, f"text {i} äöü" * (i % 4), "en") for i in range(90)] + [(None, None, None)] * 3 + [(5, "other", "de"), (4, None, "fr")]
    rows += [(77, "same", "en")] * 60  # one row repeated: neighbours, split over partitions
    rows += [(500, "long " * 200_000, "en")]
    got = [tuple(r) for r in shards.op12_feistel_shards(spark, write(spark, tmp_path, rows, partitions)).collect()]
    text = lambda t: (t or "").encode()
    known = sorted([(i, len(text(t)) + 1, zlib.crc32(text(t))) for i, t, _ in rows], key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    want = []
    for number, row in enumerate(known):
        place = walked(number, len(rows), shards.SEED)
        want.append((*row, "rows", place % 8, place // 8, None, number))
    assert sorted(got, key=lambda r: r[7]) == want
    for shard in range(8):
        slots = sorted(r[5] for r in got if r[4] == shard)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / 8) < 1


def test_shard_files_hold_whole_rows(spark, tmp_path):
    rows = [(i, f"text {i}", "en") for i in range(50)]
    docs = spark.read.parquet(write(spark, tmp_path, rows, 3) + "/documents.parquet").select("doc_id", "text", "lang")
    sharded = shards.shard_rows(docs, [F.col("doc_id")], shards=4)
    shards.write_shards(sharded, f"{tmp_path}/out", file_rows=5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.text, r.lang) for r in back.collect()) == rows
    assert sorted((r.shard, r.slot) for r in back.collect()) == sorted((r.shard, r.slot) for r in sharded.collect())


def test_empty_table(spark, tmp_path):
    assert shards.op12_feistel_shards(spark, write(spark, tmp_path, [], 1)).count() == 0
