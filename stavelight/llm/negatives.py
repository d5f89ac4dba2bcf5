"""Hard negatives by dual-tree search over integer vectors.

Anchors and candidates hang in two trees that share their splits, which are planned on a bounded sample; distances to the centres are of all rows, so bounds
hold for every row. Of a pair of nodes the inner products lie in an interval around the centres' product; a pair is dropped, with all anchors below it, if
its interval misses what those anchors still want. Pairs of leaves that are left are scored exactly, in rounds of growing length and the most promising
first, and each round's results narrow what the next ones want. Candidates of one vector and label keep their smallest ids, all that any list can hold, so
copies of a vector are one entry; a leaf is cut into blocks of bounded size, so a crowded region is many tasks.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, released, written
from .vectors import as_integers, matrix, usual_length

SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256.0, 100, 5, 10, 30, 90
#: Rows that plan the splits at most, 512 bytes each at 64 dimensions; rows of a sample a leaf; candidates and anchors of a block, about; splits between two levels.
SAMPLE, EACH, BLOCK, GROUP, FAN = 32_768, 16, 1024, 128, 2
#: Pairs of blocks of an anchor block in the first round; each round has so many times as many.
GROWTH = 8
FAR = 1 << 62


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2.0**63:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def plan_splits(x: np.ndarray, depth: int) -> list[tuple[np.ndarray, float]]:
    """2**depth - 1 planes in heap order: at plane i, a row whose product with the direction is over the bound goes to plane 2 i + 2, else to 2 i + 1."""
    planes: list[tuple[np.ndarray, float]] = []
    level = [x.astype(np.float64)]
    for _ in range(depth):
        below = []
        for rows in level:
            direction, bound = np.zeros(x.shape[1]), 0.0
            if len(rows) > 1:
                c = rows - rows.mean(axis=0)
                far = c[np.argmax((c * c).sum(axis=1))]
                for _ in range(4):  # towards the main axis
                    far = c.T @ (c @ far)
                    far = far / max(float(np.sqrt(far @ far)), 1e-300)
                direction, bound = far, float(np.median(rows @ far))
            planes.append((direction, bound))
            over = rows @ direction > bound
            below += [rows[~over], rows[over]]
        level = below
    return planes


def leaves(x: np.ndarray, planes: list[tuple[np.ndarray, float]], depth: int) -> np.ndarray:
    """The leaf of each row, from 0 to 2**depth - 1."""
    at = np.zeros(len(x), np.int64)
    x = x.astype(np.float64)
    for level in range(depth):
        for node in np.unique(at).tolist():
            rows = np.flatnonzero(at == node)
            direction, bound = planes[(1 << level) - 1 + node]
            at[rows] = 2 * node + (x[rows] @ direction > bound)
    return at


def _routed(rows: DataFrame, planes, depth: int, dim: int) -> DataFrame:
    """rows (id, label, x) with leaf."""
    told = rows.sparkSession.sparkContext.broadcast(planes)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaves(matrix(b.column(2), dim), told.value, depth))], names=["id", "label", "x", "leaf"])

    return rows.select("id", "label", "x").mapInArrow(run, "id long, label long, x binary, leaf long")


def _blocks(rows: DataFrame, size: int, dim: int, folder: str | None = None) -> DataFrame:
    """Written blocks of about size rows of one leaf: (leaf, block, n, ids, labels, x, centre, radius, norm)."""
    parts = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    dealt = rows.join(parts, "leaf").select("leaf", F.pmod(F.xxhash64("id", "x"), "parts").alias("part"), "id", "label", "x")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x = matrix(group.column("x").combine_chunks(), dim)
        order = np.argsort(group.column("id").to_numpy(), kind="stable")
        ids, labels, x = group.column("id").to_numpy()[order], group.column("label").to_numpy()[order], x[order]
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
        leaf, part = group.column("leaf")[0].as_py(), group.column("part")[0].as_py()
        cells = [[leaf], [f"{leaf}-{part}"], [len(x)], [ids.tobytes()], [labels.tobytes()], [x.tobytes()], [centre.tolist()], [radius]]
        types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=["leaf", "block", "n", "ids", "labels", "x", "centre", "radius"])

    return written(dealt.groupBy("leaf", "part").applyInArrow(run, "leaf long, block string, n long, ids binary, labels binary, x binary, centre array<double>, radius double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Intervals are widened by this share of the norms' product and by one, far beyond the rounding of doubles.
SLACK = 1e-9


def _within(pairs: DataFrame) -> DataFrame:
    """Pairs (a_centre, a_radius, c_centre, c_radius, least, most) whose interval of inner products meets what the anchors want, with most_product, its upper end.

    With a = p + u and c = q + v the product is p q + p v + u q + u v.
    """
    a, c, ra, rc = F.col("a_centre"), F.col("c_centre"), F.col("a_radius"), F.col("c_radius")
    na, nc = F.sqrt(_dot(a, a)), F.sqrt(_dot(c, c))
    reach = na * rc + nc * ra + ra * rc + (na + ra) * (nc + rc) * SLACK + 1
    df = pairs.withColumns({"_mid": _dot(a, c), "_reach": reach})
    df = df.withColumns({"most_product": F.col("_mid") + F.col("_reach"), "_least": F.col("_mid") - F.col("_reach")})
    return df.where("most_product >= least and _least <= most").drop("_mid", "_reach", "_least")


class Balls:
    """A tree's nodes on the driver, at most SAMPLE / EACH leaves: by level (how many splits lie below), centres, radii and numbers of rows below."""

    def __init__(self, blocks: DataFrame, levels: list[int], depth: int, dim: int):
        rows = blocks.select("leaf", "n", "centre", "radius")
        mean = rows.select("leaf", "n", F.posexplode("centre").alias("pos", "c")).groupBy("leaf", "pos").agg((F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("c"))
        mean = mean.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda s: s["c"]).alias("mean"))
        gap = F.aggregate(F.zip_with("centre", "mean", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        balls = rows.join(mean, "leaf").groupBy("leaf").agg(F.first("mean").alias("mean"), F.max(F.sqrt(gap) + F.col("radius")).alias("radius"), F.sum("n").alias("n")).collect()
        n, centre, radius = np.zeros(1 << depth), np.zeros((1 << depth, dim)), np.zeros(1 << depth)
        for r in balls:
            n[r.leaf], centre[r.leaf], radius[r.leaf] = r.n, r["mean"], r.radius
        self.at = {0: (centre, radius, n)}
        for above in levels:
            up = np.arange(1 << depth) >> above
            total = np.bincount(up, n, 1 << depth - above)
            middle = np.stack([np.bincount(up, n * centre[:, d], 1 << depth - above) for d in range(dim)], axis=1) / np.maximum(total, 1)[:, None]
            reach = np.where(n > 0, np.sqrt(((centre - middle[up]) ** 2).sum(axis=1)) + radius, 0.0)
            far = np.zeros(1 << depth - above)
            np.maximum.at(far, up, reach)
            self.at[above] = (middle, far, total)


class Trees:
    """The two trees: blocks below leaves as tables, the nodes above them on the driver."""

    def __init__(self, candidates: DataFrame, anchors: DataFrame, n: int, dim: int, block: int, group: int):
        self.spark, self.dim = candidates.sparkSession, dim
        self.depth = depth = max(0, min(math.ceil(math.log2(max(n, 1) / block)), int(math.log2(SAMPLE / EACH))))
        sample = candidates.orderBy(F.xxhash64("id", "x"), "id", "x").select("x").limit(min(SAMPLE, EACH * 4 << depth)).collect() if depth else []
        planes = plan_splits(np.array([np.frombuffer(r.x, np.int64) for r in sample]).reshape(-1, dim), depth)
        self.candidates = _blocks(_routed(candidates, planes, depth, dim), block, dim)
        self.anchors = _blocks(_routed(anchors, planes, depth, dim), group, dim)
        self.levels = [*range(depth, 0, -FAN), 0]
        self.a_balls, self.c_balls = Balls(self.anchors, self.levels, depth, dim), Balls(self.candidates, self.levels, depth, dim)

    def leaf_pairs(self, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves left by a walk from the two roots down; what each leaf's anchors want, (inf, -inf) where nothing."""
        a = c = np.zeros(1, np.int64)
        before = self.levels[0]
        for above in self.levels:
            step = before - above
            down = np.arange(1 << step)
            a, c = ((a[:, None, None] << step) + down[None, :, None] + 0 * down).ravel(), ((c[:, None, None] << step) + 0 * down[:, None] + down[None, None, :]).ravel()
            (p, ra, na), (q, rc, nc) = self.a_balls.at[above], self.c_balls.at[above]
            lo, hi = np.full(len(ra), np.inf), np.full(len(ra), -np.inf)
            up = np.arange(1 << self.depth) >> above
            np.minimum.at(lo, up, least)
            np.maximum.at(hi, up, most)
            kept = np.zeros(len(a), bool)
            for s in range(0, len(a), 1 << 16):
                i, j = a[s : s + (1 << 16)], c[s : s + (1 << 16)]
                size_a, size_c = np.sqrt((p[i] ** 2).sum(axis=1)), np.sqrt((q[j] ** 2).sum(axis=1))
                mid = (p[i] * q[j]).sum(axis=1)
                reach = size_a * rc[j] + size_c * ra[i] + ra[i] * rc[j] + (size_a + ra[i]) * (size_c + rc[j]) * SLACK + 1
                kept[s : s + (1 << 16)] = (na[i] > 0) & (nc[j] > 0) & (mid + reach >= lo[i]) & (mid - reach <= hi[i])
            a, c, before = a[kept], c[kept], above
        return a, c

    def pairs(self, wanted: DataFrame) -> DataFrame:
        """(a_block, c_block, most_product) of pairs of blocks that may hold what anchors want; wanted: (a_block, least, most)."""
        own = self.anchors.select("leaf", "block", "centre", "radius").join(wanted.withColumnRenamed("a_block", "block"), "block")
        least, most = np.full(1 << self.depth, np.inf), np.full(1 << self.depth, -np.inf)
        for r in own.groupBy("leaf").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect():
            least[r.leaf], most[r.leaf] = r.least, r.most
        a, c = self.leaf_pairs(least, most)
        order = np.argsort(a, kind="stable")
        told = self.spark.sparkContext.broadcast((np.searchsorted(a[order], np.arange((1 << self.depth) + 1)), c[order].astype(np.int32)))

        def run(batches):
            first, met = told.value
            for b in batches:
                leaf = b.column(0).to_numpy()
                n = first[leaf + 1] - first[leaf]
                which = np.repeat(np.arange(len(leaf)), n)
                ends = np.concatenate([np.zeros(0, np.int64), *[met[first[x] : first[x + 1]].astype(np.int64) for x in leaf.tolist()]])
                for s in range(0, len(which), 4096):
                    part = b.take(pa.array(which[s : s + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(ends[s : s + 4096]), *part.columns[1:]], names=["leaf", *part.schema.names[1:]])

        asked = own.select("leaf", F.col("block").alias("a_block"), F.col("centre").alias("a_centre"), F.col("radius").alias("a_radius"), "least", "most")
        asked = asked.mapInArrow(run, "leaf long, a_block string, a_centre array<double>, a_radius double, least long, most long")
        others = self.candidates.select("leaf", F.col("block").alias("c_block"), F.col("centre").alias("c_centre"), F.col("radius").alias("c_radius"))
        return _within(asked.join(others, "leaf")).select("a_block", "c_block", "most_product")

    def scored(self, pairs: DataFrame, wants: DataFrame, k: int, same: bool) -> DataFrame:
        """(a_block, at, want, id, score): for each pair and each of its anchors' wants, the k best candidates of the block between its bounds.

        wants: (a_block, at, want, least, most), at being the anchor's place in its block. same: candidates of the anchor's label, else those of others. A task
        holds one block of candidates at a time; the anchor blocks that meet it pass as a stream.
        """
        packed = wants.groupBy("a_block").agg(F.array_sort(F.collect_list(F.struct("at", "want", "least", "most"))).alias("wants"))
        none = F.lit(None)
        asked = pairs.join(self.anchors.select(F.col("block").alias("a_block"), "ids", "labels", "x"), "a_block").join(packed, "a_block")
        asked = asked.select(F.col("c_block").alias("key"), F.lit(1).alias("kind"), "a_block", "ids", "labels", "x", "wants")
        held = self.candidates.join(pairs.select(F.col("c_block").alias("block")).distinct(), "block", "left_semi")
        held = held.select(F.col("block").alias("key"), F.lit(0).alias("kind"), none.cast("string").alias("a_block"), "ids", "labels", "x", none.cast(asked.schema["wants"].dataType).alias("wants"))
        tasks = 4 * self.spark.sparkContext.defaultParallelism
        work = held.unionByName(asked).repartition(tasks, "key").sortWithinPartitions("key", "kind", "a_block")
        dim = self.dim

        def run(batches):
            ids = labels = x = None
            for b in batches:
                for i in range(b.num_rows):
                    cell = [np.frombuffer(b.column(c)[i].as_buffer(), np.int64) for c in (3, 4, 5)]
                    if b.column(1)[i].as_py() == 0:
                        ids, labels, x = cell[0], cell[1], cell[2].reshape(-1, dim)
                        continue
                    own, own_labels = cell[0], cell[1]
                    s = inner(cell[2].reshape(-1, dim), x)
                    rows: list[tuple[np.ndarray, ...]] = []
                    for at, some in groupby(b.column(6)[i].as_py(), key=lambda w: w["at"]):
                        wanted = list(some)
                        fit = np.flatnonzero(((labels == own_labels[at]) == same) & (ids != own[at]) & (s[at] >= min(w["least"] for w in wanted)))
                        fit = fit[np.lexsort((ids[fit], -s[at][fit]))]
                        falling = -s[at][fit]
                        for w in wanted:
                            lo = int(np.searchsorted(falling, -w["most"], side="left"))
                            hi = min(lo + k, int(np.searchsorted(falling, -w["least"], side="right")))
                            if hi > lo:
                                rows.append((np.full(hi - lo, at, np.int32), np.full(hi - lo, w["want"], np.int32), ids[fit[lo:hi]], -falling[lo:hi].astype(np.int64)))
                    if rows:
                        columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array([b.column(2)[i].as_py()] * len(columns[0])), *map(pa.array, columns)], names=["a_block", "at", "want", "id", "score"])

        return work.mapInArrow(run, "a_block string, at int, want int, id long, score long")

    def search(self, wants: DataFrame, k: int, same: bool) -> DataFrame:
        """Written (a_block, at, want, id, score, rank): the k best of all candidates for each want (a_block, at, want, least, most), ties by smaller id."""
        key = ["a_block", "at", "want"]
        best = Window.partitionBy(*key).orderBy(F.desc("score"), "id")

        def top(rows: DataFrame) -> DataFrame:
            return written(rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))

        def narrowed(found: DataFrame) -> DataFrame:
            full = found.where(F.col("rank") == k).select(*key, F.col("score").alias("_kth"))
            return wants.join(full, key, "left").select(*key, F.greatest("least", F.coalesce("_kth", "least")).alias("least"), "most")

        def by_block(now: DataFrame) -> DataFrame:
            return now.groupBy("a_block").agg(F.min("least").alias("least"), F.max("most").alias("most"))

        # the anchors' own leaves come first, one block for each anchor block
        mine = self.anchors.join(wants.select(F.col("a_block").alias("block")).distinct(), "block", "left_semi").select(F.col("block").alias("a_block"), "leaf")
        homes = self.candidates.groupBy("leaf").agg(F.count(F.lit(1)).alias("parts"))
        first = mine.join(homes, "leaf").select("a_block", F.concat_ws("-", "leaf", F.pmod(F.xxhash64("a_block"), "parts")).alias("c_block"))
        first = written(first.join(self.candidates.select(F.col("block").alias("c_block")), "c_block", "left_semi"))
        found = top(self.scored(first, wants, k, same))
        rest = self.pairs(by_block(narrowed(found))).join(first, ["a_block", "c_block"], "left_anti")
        rest = written(rest.withColumn("turn", F.row_number().over(Window.partitionBy("a_block").orderBy(F.desc("most_product"), "c_block"))))
        turns = rest.agg(F.max("turn")).head()[0] or 0
        done, size = 0, GROWTH
        while done < turns:
            now = narrowed(found)
            some = rest.where((F.col("turn") > done) & (F.col("turn") <= done + size)).join(by_block(now), "a_block").where("most_product >= least").select("a_block", "c_block")
            more = top(found.drop("rank").unionByName(self.scored(some, now, k, same)))
            released(found)
            found, done, size = more, done + size, size * GROWTH
        released(first, rest)
        return found


def mine(
    rows: DataFrame, scale: float = SCALE, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    block: int = BLOCK, group: int = GROUP,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), written.

    Scores are inner products of floor(scale * component). Anchors are rows whose id is divisible by ``every``; an anchor's positives are its best others of its
    label, and for each the best rows of other labels count whose score is low to high percent of the positive's. Ties go to the smaller id.

    Rows with a null id, label or vector, or null or non-finite components take no part, nor do vectors of another length than the most frequent, and
    components beyond 2**28 after scaling. Repeated rows count once; an id with several vectors or labels is several rows, none of which is another's
    positive or negative. Anchors without positives, and positives without negatives in reach, have no rows; those of negative scores have none in reach.
    An empty table gives an empty one; other columns are ignored.
    """
    spark: SparkSession = rows.sparkSession
    ensure_checkpoint_dir(spark)
    used = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")).where("id is not null and label is not null and v is not null")
    dim = usual_length(used, "v")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not dim:
        return spark.createDataFrame([], schema)
    points = written(as_integers(used, "v", dim, scale).distinct())
    kept = Window.partitionBy("label", "x").orderBy("id")
    candidates = written(points.withColumn("_r", F.row_number().over(kept)).where(F.col("_r") <= max(positives + 1, negatives)).drop("_r"))
    trees = Trees(candidates, points.where(F.col("id") % every == 0), candidates.count(), dim, block, group)
    released(points, candidates)
    asked = trees.anchors.select(F.col("block").alias("a_block"), F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("at"))
    every_score = asked.select("a_block", "at", F.lit(0).alias("want"), F.lit(-FAR).alias("least"), F.lit(FAR).alias("most"))
    near = trees.search(every_score, positives, True)
    score = F.col("score")
    reach = near.select("a_block", "at", F.col("rank").alias("want"), (-_percent(low, -score)).alias("least"), _percent(high, score).alias("most"))
    hard = trees.search(reach.where("least <= most"), negatives, False)
    ids = trees.anchors.select(F.col("block").alias("a_block"), "ids", "n").mapInArrow(_anchor_ids, "a_block string, at int, anchor_id long")
    both = hard.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(near.select("a_block", "at", F.col("rank").alias("want"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["a_block", "at", "want"])
    out = written(both.join(ids, ["a_block", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    released(near, hard, trees.anchors, trees.candidates)
    return out


def _percent(percent: int, score: Column) -> Column:
    """floor(percent * score / 100), in integers."""
    x = score * percent
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def _anchor_ids(batches):
    for b in batches:
        for i in range(b.num_rows):
            ids = np.frombuffer(b.column(1)[i].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(ids)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["a_block", "at", "anchor_id"])


ORACLE = """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, [floor(256 * x) FOR x IN embedding::DOUBLE[]] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id))::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
