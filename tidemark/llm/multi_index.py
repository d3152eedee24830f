"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has one bit per component, set if the component is positive. Codes are cut into segments of
eight bits, and each segment has a table from its 256 values to the rows that hold them. A search looks up the
query's own values, then values at one bit's distance, and so on, one segment at a time. With search radii r1,
r2, ... every row not met so far differs by more than ri bits in each segment, so by at least the sum of
(ri + 1) bits. Once the k-th verified distance is below that sum, nothing nearer or tied is left.

Rules for rows that take no part, repeated ids, ties and empty tables are those of `blocks.usable_vectors`
and `blocks.search`. The distance is the number of differing bits.
"""

from __future__ import annotations

import io
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.blocks import keys_of, matrix_of, search, usable_vectors
from tidemark.llm.common import table

NEIGHBOURS = 20


def codes_of(frame: pd.DataFrame) -> np.ndarray:
    """Bytes of each row's code; unused bits of the last byte are 0."""
    return np.packbits(matrix_of(frame) > 0, axis=1)


def _flips() -> list[np.ndarray]:
    """Bit patterns of eight bits by the number of bits set."""
    return [np.array([sum(1 << b for b in bits) for bits in combinations(range(8), r)], np.uint8) for r in range(9)]


def build(frame: pd.DataFrame) -> bytes:
    """Codes of a shard in order of id, and per segment the rows sorted by value with the values' offsets."""
    frame = frame.sort_values("vec_id")
    codes = codes_of(frame)
    rows = np.argsort(codes, axis=0, kind="stable").astype(np.int32)
    counts = np.stack([np.bincount(codes[:, s], minlength=256) for s in range(codes.shape[1])])
    offsets = np.concatenate([np.zeros((codes.shape[1], 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
    out = io.BytesIO()
    np.savez(out, ids=frame["vec_id"].to_numpy(np.int64), own=keys_of(frame), codes=codes, rows=rows, offsets=offsets)
    return out.getvalue()


def look_up(index: bytes, block: pd.DataFrame, k: int = NEIGHBOURS):
    with np.load(io.BytesIO(index)) as held:
        ids, own, codes, rows, offsets = held["ids"], held["own"], held["codes"], held["rows"], held["offsets"]
    segments, flips = codes.shape[1], _flips()
    found: tuple[list, list, list] = ([], [], [])
    for query, code in zip(keys_of(block), codes_of(block)):
        met = np.zeros(len(ids), bool)
        met[own == query] = True
        distances = np.full(len(ids), 8 * segments + 1)
        unmet, covered = len(ids) - int(met.sum()), 0
        wanted = min(k, unmet)
        histogram = np.zeros(8 * segments + 1, np.int64)
        for radius in range(9):
            for s in range(segments):
                values = code[s] ^ flips[radius]
                starts, ends = offsets[s, values], offsets[s, values.astype(np.int64) + 1]
                sizes = ends - starts
                places = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                fresh = rows[places, s]
                fresh = fresh[~met[fresh]]  # a row stands once in a segment's table, so there are no repeats
                met[fresh] = True
                apart = np.bitwise_count(codes[fresh] ^ code).sum(axis=1, dtype=np.int64)
                distances[fresh] = apart
                histogram += np.bincount(apart, minlength=len(histogram))
                covered += 1
                if histogram[:covered].sum() >= wanted:  # the k-th verified distance is below `covered`
                    break
            else:
                continue
            break
        distances[own == query] = 8 * segments + 1
        best = np.argsort(distances, kind="stable")[:wanted]  # rows are in order of id: ties by id
        found[0].append(np.full(len(best), query))
        found[1].append(ids[best])
        found[2].append(distances[best])
    return tuple(np.concatenate(part) if part else np.zeros(0, np.int64) for part in found)


def hamming_top_k(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, distance) for the queries among (vec_id, vector) rows."""
    return search(vectors, build, lambda index, block: look_up(index, block, k), k, "distance", largest=False)


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_top_k(usable_vectors(table(spark, sf_dir, "embeddings")))


#: Every query against every row; a sign test per component gives the code.
OP7_SQL = """
WITH sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
codes AS (
  SELECT row_number() OVER () AS own, vec_id, len(v) AS size, array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS code
  FROM sound),
pairs AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INTEGER AS distance
  FROM codes q JOIN codes c ON q.own <> c.own AND q.size = c.size WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY distance, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, distance FROM ranked WHERE rank <= 20"""
