"""Exact top-k search over binary codes by incremental multi-index hashing.

Vectors become 64-bit codes of signs. Equal codes collapse first, to one entry with its k + 1 smallest ids, so a vector that a third of
all rows repeat is one entry. Codes are cut into m segments of about log2(n) bits, so a bucket holds about one code at any size. Queries probe
all buckets within radius r of each of their segments, for r = 0, 1, ...: a code within Hamming distance m (r + 1) - 1 differs by at most r bits in some
segment, so a query is done once its kth neighbour is that near. Each ring is one hash join. Cost decides where rings end: a probe crosses a shuffle, which
costs about as much as comparing with ``SCAN`` codes, so where the next ring would cost a query more than all codes do, and has over ``RING`` probes, the queries
left are compared with all codes, which is exact too: codes are dealt into blocks, and the queries pass each block as a stream, so no task holds more than a
block and nothing comes to the driver. The more codes there are, the further rings go.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS, TOP, EVERY = 64, 10, 20
#: Probes of one query in a ring that are always made; codes that cost as much as a probe; codes of a block of the scan at most, and at least where there are
#: more blocks than slots; probes of a task, about.
RING, SCAN, BLOCK, LEAST, PROBES = 4096, 64, 1 << 20, 4096, 200_000


def sign_code(vector: Column) -> Column:
    """Bit i says whether element i is positive; elements beyond 64 are left out, missing and null ones count as not positive."""
    bits = F.transform(F.slice(vector, 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m segments that cover all bits."""
    return [(BITS * i // m, BITS * (i + 1) // m - BITS * i // m) for i in range(m)]


def masks(width: int, r: int, size: int = 4096) -> Iterator[np.ndarray]:
    """All numbers of r of width bits, so many at once."""
    flips = (sum(1 << b for b in c) for c in combinations(range(width), r))
    while len(some := np.fromiter(islice(flips, size), np.int64)):
        yield some


def _piece(code: Column, shift: int, width: int) -> Column:
    return F.call_function("shiftrightunsigned", code, F.lit(shift)).bitwiseAND(F.lit((1 << width) - 1))


def _probes(queries: DataFrame, parts: list[tuple[int, int]], r: int) -> DataFrame:
    """(q, part, value): the buckets that differ from a query's (q) in r bits of one of its segments."""

    def run(batches):
        for b in batches:
            q = b.column(0).to_numpy()
            for part, (shift, width) in enumerate(parts):
                own = ((q.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
                for some in masks(width, r):
                    step = max(1, 65_536 // len(some))
                    for lo in range(0, len(q), step):
                        value = (own[lo : lo + step, None] ^ some[None, :]).ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q[lo : lo + step], len(some))), pa.array(np.full(len(value), part, np.int32)), pa.array(value)], names=["q", "part", "value"])

    return queries.select("q").mapInArrow(run, "q long, part int, value long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k + 1 nearest codes of each query: by distance, then smallest id. No further code can hold one of the k + 1 nearest ids."""
    w = Window.partitionBy("q").orderBy("d", "low")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).drop("_r")


def _nearest(q: int, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k + 1 nearest of codes that are in order of their smallest id."""
    d = np.bitwise_count((code ^ np.int64(q)).view(np.uint64))
    reach = int(np.searchsorted(np.cumsum(np.bincount(d, minlength=BITS + 1)), min(k + 1, len(code))))
    at = np.flatnonzero(d <= reach)
    at = at[np.argsort(d[at], kind="stable")][: k + 1]
    return at, d[at].astype(np.int32)


def _scan(index: DataFrame, left: DataFrame, n: int, k: int) -> DataFrame:
    """(q, code, low, n, d): the k + 1 nearest codes of each query of left (q) in each block of the n rows of index (code, low, n)."""
    slots = index.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil(n / BLOCK), min(2 * slots, math.ceil(n / LEAST)), 1)
    codes = index.select(F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "low", "code", F.col("n").cast("long").alias("n"))
    asked = left.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("low"), F.col("q").alias("code"), F.lit(0).cast("long").alias("n"))

    def run(batches):
        held: list[list[np.ndarray]] = [[], [], []]
        own, ready = -1, None
        for b in batches:
            block, kind, low, code, size = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            edges = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])])).tolist() if len(block) else []
            for s, e in zip(edges, [*edges[1:], len(block)], strict=True):
                if block[s] != own:
                    own, held, ready = block[s], [[], [], []], None
                if kind[s] == 0:
                    for x, y in zip(held, (code, low, size), strict=True):
                        x.append(y[s:e])
                    continue
                if not held[0]:
                    continue
                ready = ready or [np.concatenate(x) for x in held]
                for lo in range(s, e, 1024):
                    found = [(q, *_nearest(q, ready[0], k)) for q in code[lo : min(lo + 1024, e)].tolist()]
                    at = np.concatenate([x for _, x, _ in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(np.array([q for q, _, _ in found], np.int64), [len(x) for _, x, _ in found])), *(pa.array(x[at]) for x in ready), pa.array(np.concatenate([d for _, _, d in found]))], names=["q", "code", "low", "n", "d"]
                    )

    work = codes.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind", "low")
    return work.mapInArrow(run, "q long, code long, low long, n long, d int")


def top_k(rows: DataFrame, k: int = TOP, every: int = EVERY, vec_id: str = "vec_id", vector: str = "embedding", ring: int = RING) -> DataFrame:
    """(query_id, rank, vec_id, distance): for each row whose id is divisible by ``every``, its k nearest others by (Hamming distance of the codes, id).

    Null ids and null vectors are left out; an empty or shorter vector has a code like any other. Repeated rows count once; an id with several codes
    is several rows, and no row is its own neighbour, nor is another of its id. Fewer than k other rows give fewer results. An empty table gives an
    empty one; other columns are ignored.
    """
    spark = rows.sparkSession
    points = cut(rows.select(F.col(vec_id).cast("long").alias("id"), F.when(F.col(vector).isNotNull(), sign_code(F.col(vector))).alias("code")).where("id is not null and code is not null").distinct())
    some = points.withColumn("_r", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("_r") <= 2 * k + 2)
    index = cut(some.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("low", F.element_at("ids", 1)))
    n = index.count()
    m = max(1, min(BITS // 4, round(BITS / max(math.log2(max(n, 2)), 1))))
    queries = points.where(F.col("id") % every == 0)
    left = cut(queries.select(F.col("code").alias("q")).distinct())
    waiting = left.count()
    parts = segments(m)
    table = index.select("code", "low", F.size("ids").alias("n"), F.posexplode(F.array(*[_piece(F.col("code"), s, w) for s, w in parts])).alias("part", "value"))
    done, found = [], None
    for r in range(max(w for _, w in parts) + 1):
        probes = sum(math.comb(w, r) for _, w in parts)
        if probes > max(ring, n // SCAN):
            break
        # probes are many where queries are few
        tasks = math.ceil(waiting * probes / PROBES)
        new = _probes(left.repartition(max(tasks, 1), "q"), parts, r)
        # probes are far more rows than the queries that statistics see: never broadcast them
        new = new.join(table.hint("merge"), ["part", "value"])
        new = new.select("q", "code", "low", "n", distance(F.col("q"), F.col("code")).alias("d"))
        found = _best((new if found is None else new.unionByName(found)).dropDuplicates(["q", "code"]), k)
        near = m * (r + 1) - 1
        # as many ids as k others and the row itself; an id may have several codes, so its own ones count for nothing more
        sure = F.sum(F.when(F.col("d") <= near, F.col("n")).otherwise(0)).over(Window.partitionBy("q")) >= k + 1
        found = cut(found.withColumn("sure", sure))
        done.append(found.where("sure").drop("sure"))
        left = cut(left.join(found.where("not sure").select("q").distinct().unionByName(left.join(found, "q", "left_anti")), "q", "left_semi"))
        found = found.where("not sure").drop("sure")
        waiting = left.count()
        if not waiting:
            break
    answers = None
    for x in done:
        answers = x if answers is None else answers.unionByName(x)
    if waiting:
        hits = _best(_scan(index.select("code", "low", F.size("ids").alias("n")), left, n, k), k).withColumn("n", F.col("n").cast("int"))
        answers = hits if answers is None else answers.unionByName(hits)
    if answers is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance int")
    flat = answers.join(index.select("code", "ids"), "code").select("q", F.explode(F.transform("ids", lambda v: F.struct(F.col("d").alias("d"), v.alias("id")))).alias("x"))
    lists = flat.groupBy("q").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    out = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(lists, "q")
    others = F.slice(F.filter("xs", lambda x: x["id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(others).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("distance"))


ORACLE = """
WITH b AS (SELECT vec_id, unnest(embedding[1:64]) AS x, unnest(range(0, least(len(embedding), 64))) AS i FROM embeddings),
c AS (SELECT vec_id, coalesce(sum(CASE WHEN x > 0 AND i < 32 THEN 1::BIGINT << i::INT ELSE 0 END), 0)::BIGINT AS lo, coalesce(sum(CASE WHEN x > 0 AND i >= 32 THEN 1::BIGINT << (i - 32)::INT ELSE 0 END), 0)::BIGINT AS hi FROM b GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, c.vec_id, (bit_count(xor(q.lo, c.lo)) + bit_count(xor(q.hi, c.hi)))::INT AS distance FROM c AS q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
