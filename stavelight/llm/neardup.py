"""Near-duplicate texts by Order MinHash.

1. Exact copies collapse to one node, the MD5 of the text.
2. Sketch: 5-word shingles carry their occurrence number; for each of ``VECTORS`` hash functions the ``ELL`` smallest are kept in text
   order. Two texts meet in a bucket where such a vector is equal: if they share s of their shingles that has probability about s ** ELL each time, and
   needs the same order, so it follows edit similarity. Of texts with one word in ten replaced s is about 0.42.
3. Each text is compared at home first, in the largest of its buckets: with the bucket's leader, the member that meets most others anywhere, and
   with all others of its block of about ``BLOCK`` bytes. So a group of n copies becomes one component at a cost in proportion to n.
4. Buckets whose members still lie in several components are compared whole: every pair of members of different components, a block against a
   block, but for pairs whose lengths rule similarity out. So each similar pair that shares a bucket is compared or already connected.
5. Banded alignment of whole texts decides: word edit similarity of at least ``THRESHOLD``. Within a block an index of each text's rarest words finds the
   pairs that can reach it, so memory follows the texts and not their pairs.
6. Connected components by minimum labels with pointer jumping, all as joins; each round is a table in the shared folder, which goes when the next
   one is written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, CHUNK, GRAM_BASE, Words, chunks, grams, kept, mix, packed, released, unpacked, written

SHINGLE, THRESHOLD = 5, 0.8
VECTORS, ELL = 16, 2
#: Bytes of texts of a block, about, and its members at most; results don't depend on them.
BLOCK, MEMBERS = 1_000_000, 2000
#: Texts whose numbers of words lie further apart than one power of this can't reach 0.8; a bit over 1 / 0.8, so that rounding does no harm.
BAND = 1.2501
#: Texts of more shingles than the first have vectors of ELL, those of at most the second have vectors of one.
SHORT = (10, 16)
_SEEDS = mix(np.arange(1, 1025, dtype=np.uint64))


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of runs of n words; of all words if there are fewer."""
    return grams(h, min(n, len(h))) if len(h) else h


def occurrences(g: np.ndarray) -> np.ndarray:
    """Items labelled by how often they stood before, so that they are a set."""
    order = np.argsort(g, kind="stable")
    s = g[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(g) else np.zeros(0, np.int64)
    occurrence = np.empty(len(g), np.uint64)
    occurrence[order] = (np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))).astype(np.uint64)
    return mix(g + occurrence * np.uint64(0x9FB21C651E98DF25))


def order_min_hash(g: np.ndarray, vectors: int = VECTORS, ell: int = ELL) -> np.ndarray:
    """One number for each vector: the ell smallest occurrence-labelled shingles in text order, hashed."""
    if not len(g):
        return np.zeros(0, np.uint64)
    x = occurrences(g)
    ell = min(ell, len(x))  # a text of fewer shingles has them all
    out = np.empty(vectors, np.uint64)
    step = max(1, 1_000_000 // len(x))
    for lo in range(0, vectors, step):
        seeds = _SEEDS[lo : min(lo + step, vectors), None]
        y = (x[None, :] ^ seeds) * (seeds | np.uint64(1))
        y = (y ^ (y >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        at = np.sort(np.argpartition(y, ell - 1, axis=1)[:, :ell], axis=1) if ell < len(x) else np.tile(np.arange(len(x)), (len(seeds), 1))
        v = np.zeros(len(seeds), np.uint64)
        for i in range(at.shape[1]):
            v = v * np.uint64(GRAM_BASE) + x[at[:, i]]
        out[lo : lo + len(seeds)] = mix(v ^ (seeds[:, 0] >> np.uint64(1)) ^ np.uint64(ell))
    return out


def edit_distance(a: list, b: list, most: int) -> int | None:
    """Insertions, deletions and replacements from a to b inside the band of ``most`` diagonals on either side; None if there are more.

    A column of the band is two numbers of 2 * most + 1 bits, which say where distances rise and fall from row to row; the next column follows from them and
    the places of its item by a few operations on whole numbers, so time is the length times the band's width over the bits of a machine word.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return None
    if not m or not most:
        return n if not m else 0 if a == b else None
    most = min(most, n)
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << width - 1
    up, down = full ^ ((1 << most) - 1), 0  # in column 0 distances rise by one from row to row
    distance, last = most, 1 << width - 2  # of the band's lowest row, which ends at row n
    worst = most + m - (n - most)
    for j, x in enumerate(b):
        match = ((place.get(x, 0) << most) >> j) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        rise = down | (full ^ (diagonal | up))
        fall = diagonal & up
        if j < n - most:
            distance += not diagonal & top
        else:
            distance += bool(rise & last) - bool(fall & last)
            last >>= 1
        if distance > worst:
            return None
        up = fall | (full ^ ((diagonal >> 1) | rise))
        down = (diagonal >> 1) & rise
    return distance if distance <= most else None


def allowed(n: int, threshold: float) -> int:
    """Edits between texts of at most n words."""
    return int(np.floor((1 - threshold) * n + 1e-9))


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether two texts, as word hashes, are near duplicates: edit similarity of their words."""
    return bool(len(a) and len(b)) and edit_distance(a.tolist(), b.tolist(), allowed(max(len(a), len(b)), threshold)) is not None


def bucket_keys(g: np.ndarray, vectors: int = VECTORS, ell: int = ELL) -> list[int]:
    """Keys of a text's buckets. Short texts have too few shingles for ``ell`` common ones, so they also or only agree in single ones; both kinds overlap."""
    parts = ([order_min_hash(g, vectors, 1)] if len(g) <= SHORT[1] else []) + ([order_min_hash(g, vectors, ell)] if len(g) > SHORT[0] else [])
    return np.concatenate(parts).view(np.int64).tolist() if len(g) else []


def sketches(docs: DataFrame, text: str, doc_id: str, vectors: int, ell: int) -> DataFrame:
    """(_id, node, keys, words, size): keys of the buckets a text belongs to, none for texts without words; its words and bytes."""
    schema = T.StructType([T.StructField("_id", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("words", T.LongType()), T.StructField("size", T.LongType())])

    def run(batches):
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(2)), 0).to_pylist()
            for lo, hi in chunks(sizes):
                w, keys = Words([x or b"" for x in b.column(2)[lo:hi].to_pylist()], ALNUM), []
                for d in range(hi - lo):
                    keys.append(bucket_keys(shingles(w.hash[w.first[d] : w.first[d + 1]]), vectors, ell))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(keys, pa.list_(pa.int64())), pa.array(np.diff(w.first), pa.int64()), pa.array(sizes[lo:hi], pa.int64())], names=schema.names
                )

    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.unhex(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))).alias("node"), F.col(text).cast("binary").alias("_raw")).mapInArrow(run, schema)


def connecting(words: list[np.ndarray], labels: list, threshold: float = THRESHOLD) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(pairs, stars) of a group of texts: similar pairs (i, j) that connect all of its components that similar pairs connect, and for each new component
    pairs of one text with one of every label in it, which connect as much in two steps.

    Texts of at most n words that k edits separate share n - k words, counting repeats. With words in order of their frequency in the group, two such texts share
    one of the first n - (n - k) + 1 of either: only those are indexed, by component, so what is connected already is passed over at once. What shares one is
    tested by length, by its words, and by alignment.
    """
    to = {x: x for x in labels}

    def find(x):
        while to[x] != x:
            to[x] = to[to[x]]
            x = to[x]
        return x

    size = [len(w) for w in words]
    _, rank, count = np.unique(np.concatenate([occurrences(w) for w in words]), return_inverse=True, return_counts=True)
    place = np.empty(len(count), np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(len(count))
    sets = [np.sort(x) for x in np.split(place[rank], np.cumsum(size)[:-1])]
    index: dict[int, dict] = {}
    out = []
    for i in sorted(range(len(words)), key=lambda i: size[i]):
        if not size[i]:
            continue
        most = allowed(size[i], threshold)
        first = sets[i][: most + 1].tolist()
        own = find(labels[i])
        met: dict = {}
        for k in first:
            held = index.get(k)
            if held is None:
                continue
            for x in [x for x in held if to[x] != x]:  # components that have joined since
                held.setdefault(find(x), []).extend(held.pop(x))
            for x, texts in held.items():
                if x != own:
                    met.setdefault(x, set()).update(texts)
        for texts in met.values():
            for j in sorted(texts):
                # i is the longer one
                if size[i] - size[j] <= most and len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= size[i] - most and similar(words[i], words[j], threshold):
                    to[find(labels[j])] = own
                    out.append((i, j))
                    break
        for k in first:
            index.setdefault(k, {}).setdefault(own, []).append(i)
    one: dict = {}
    for i, x in enumerate(labels):
        one.setdefault(x, i)
    centre: dict = {}
    stars = [(centre[find(x)], i) for x, i in one.items() if centre.setdefault(find(x), i) != i]
    return out, stars


def _connected(rows: list[tuple], threshold: float) -> pa.RecordBatch:
    """connecting() for rows (group, node, label, packed text), groups together."""
    texts = {r[1]: r[3] for r in rows}
    blobs, words = [unpacked(z) for z in texts.values()], []
    for lo, hi in chunks([len(x) for x in blobs]):
        w = Words(blobs[lo:hi], ALNUM)
        words += [w.hash[w.first[d] : w.first[d + 1]] for d in range(hi - lo)]
    words = dict(zip(texts, words, strict=True))
    pairs, lo = [], 0
    for hi in range(1, len(rows) + 1):
        if hi == len(rows) or rows[hi][0] != rows[lo][0]:
            nodes = [r[1] for r in rows[lo:hi]]
            for star, found in enumerate(connecting([words[x] for x in nodes], [r[2] for r in rows[lo:hi]], threshold)):
                pairs += [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j]), bool(star)) for i, j in found]
            lo = hi
    return pa.RecordBatch.from_arrays([*(pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)), pa.array([p[2] for p in pairs], pa.bool_())], names=["a", "b", "star"])


def _compared(work: DataFrame, threshold: float) -> DataFrame:
    """connecting() for each group of work (group, node, label, size, _z): pairs (a, b, star), a < b."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(4)[i].as_py())
                if size > CHUNK and row[0] != held[-1][0]:
                    yield _connected(held, threshold)
                    held, size = [], 0
                held.append(row)
                size += int.from_bytes(row[3][:8], "little")
        if held:
            yield _connected(held, threshold)

    return work.select("group", "node", "label", "size", "_z").repartition("group").sortWithinPartitions("group", "node").mapInArrow(run, "a binary, b binary, star boolean")


def _parts(size, n, block: int):
    """Blocks of so many bytes and members."""
    return F.greatest(F.ceil(size / block), F.ceil(n / MEMBERS))


def _at_home(buckets: DataFrame, texts: DataFrame, threshold: float, block: int) -> DataFrame:
    """Similar pairs (a, b) of texts at home in one bucket: each block of members is compared whole, together with the bucket's leader.

    A text is at home in the largest of its buckets, so it is read once, and a group of n copies costs n times a block at most.
    """
    # a node has a few buckets only, so this group is narrow
    home = buckets.groupBy("node").agg(F.max(F.struct("n", "key")).alias("h"), F.sum("n").alias("meets"), F.first("size").alias("size")).select("node", "h.key", "meets", "size")
    groups = home.groupBy("key").agg(F.count(F.lit(1)).alias("c"), _parts(F.sum("size"), F.count(F.lit(1)), block).alias("parts"), F.max_by("node", F.struct("meets", "node")).alias("lead")).where("c > 1")
    rows = home.join(groups, "key").where("node <> lead").select("key", "node", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    leads = groups.select("key", F.col("lead").alias("node"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    work = rows.unionByName(leads).select(F.xxhash64("key", "part").alias("group"), "node", F.col("node").alias("label"))
    return _compared(work.join(texts, "node"), threshold)


def _across(buckets: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float, block: int) -> DataFrame:
    """Similar pairs (a, b) of buckets whose members have several labels; all pairs of members of different labels are compared, or connected by others."""
    rows = written(buckets.join(labels, "node", "left").select("key", "node", "size", "band", F.coalesce("label", "node").alias("label")))
    parts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    whole = parts.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("m").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    # of buckets of the same members one is enough
    whole = whole.where("labels > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    # large labels have blocks of their own, which needn't be compared with each other; small ones share blocks
    mixed = F.lit(b"")
    parts = parts.join(whole, "key").select("key", "label", F.when((F.col("bytes") >= block) | (F.col("m") >= MEMBERS), F.col("label")).otherwise(mixed).alias("of"))
    open_ = written(rows.join(parts, ["key", "label"]).select("key", "node", "label", "of", "band", "size"))
    blocks = open_.groupBy("key", "of", "band").agg(_parts(F.sum("size"), F.count(F.lit(1)), block).alias("blocks"))
    salt = F.xxhash64(F.when(F.col("of") == mixed, F.col("label")).otherwise(F.col("node")))
    members = written(open_.join(blocks, ["key", "of", "band"]).select("key", "node", "label", F.struct("of", "band", F.pmod(salt, "blocks").alias("part")).alias("block")))
    blocks = members.select("key", "block").distinct()
    two = blocks.withColumnRenamed("block", "left").join(blocks.withColumnRenamed("block", "right"), "key").where("left < right and abs(left.band - right.band) <= 1")
    two = two.where((F.col("left.of") != F.col("right.of")) | (F.col("left.of") == mixed))
    sides = two.select("key", F.xxhash64("key", "left", "right").alias("group"), F.explode(F.array("left", "right")).alias("block"))
    # a block that is compared with another one is compared with itself there
    alone = blocks.where(F.col("block.of") == mixed).join(sides.select("key", "block").distinct(), ["key", "block"], "left_anti")
    sides = sides.unionByName(alone.withColumn("group", F.xxhash64("key", "block")))
    found = written(_compared(members.join(sides, ["key", "block"]).select("group", "node", "label").join(texts, "node"), threshold))
    released(rows, open_, members)
    return found


def links(buckets: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b, star), a < b, from buckets (key, node, n, size) of n members, two or more: any two similar members of a bucket are connected by verified pairs; stars connect the same texts."""
    found = written(_at_home(buckets, texts, threshold, block))
    labels = components(found.where("star"))
    more = _across(buckets, labels, texts, threshold, block)
    out = written(found.unionByName(more).distinct())
    released(found, labels, more)
    return out


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component."""
    edges = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = edges.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        step = written(step.join(jump, "new").select("node", "label", F.least("new", "far").alias("new")))
        released(labels)
        if step.where("label <> new").isEmpty():
            released(edges)
            return kept(step, step.select("node", "label"))
        labels = kept(step, step.select("node", F.col("new").alias("label")))


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, vectors: int = VECTORS, ell: int = ELL
) -> DataFrame:
    """(doc_id, class_id, links, text_md5, label): one row per row of docs. label names the class, null without words. class_id is the smallest id of the class, links the number of distinct other texts
    verified as similar to this one by the comparisons made (a class is connected by them).

    Words are lower-cased runs of letters and digits. Texts are linked if the edit similarity of their words, 1 less edits over the longer one's words, is at least
    ``threshold``; texts of fewer than five words have all their words as one shingle. Classes are the connected components over exact
    copies and links. Null texts and texts without words belong to no class: class_id is their own id, links 0. Null ids join classes but
    name none unless alone, so unlike texts of one id, or without any, have equal class_ids, but not labels. Repeated rows are exact copies. Texts of any length are read whole. An empty table gives an empty one; other columns are ignored.
    Two texts that share s of their shingles meet in no bucket, and are missed unless others connect them, with probability about (1 - s ** ell) ** vectors: 5 % if one word in ten
    is replaced, 1e-4 for one in twenty, for texts of the same order. Pairs that share a bucket are never missed, whatever its size.
    """
    rows = written(sketches(docs, text, doc_id, vectors, ell))
    nodes = rows.where(F.size("keys") > 0).groupBy("node").agg(F.min("_id").alias("rep"), F.first("keys").alias("keys"), F.first("words").alias("words"), F.first("size").alias("size"))
    spread = nodes.select("node", "size", F.floor(F.log(BAND, "words")).cast("int").alias("band"), F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(spread.join(shared, "key").select("key", "node", "n", "size", "band"))
    involved = buckets.select("node").distinct()
    chosen = nodes.select("node", "rep").join(involved, "node")
    own = docs.select(F.unhex(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))).alias("node"), F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("binary").alias("_raw"))

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([packed(x.as_py()) for x in b.column(2)], pa.binary())], names=["node", "_id", "_z"])

    own = own.mapInArrow(pack, "node binary, _id bigint, _z binary")
    texts = own.join(chosen, "node").where(F.col("_id").eqNullSafe(F.col("rep"))).select("node", "_z")
    sizes = buckets.groupBy("node").agg(F.first("size").alias("size"))
    texts = written(texts.dropDuplicates(["node"]).join(sizes, "node").select("node", "size", "_z"))
    found = links(buckets, texts, threshold)
    released(buckets, texts)
    labels = components(found.where("star"))
    degree = found.where("not star").select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    reps = nodes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    classes = reps.groupBy("label").agg(F.min("rep").alias("class_id"))
    table = reps.join(classes, "label").join(degree, "node", "left").select("node", "class_id", "links", "label")
    out = rows.select("_id", "node", (F.size("keys") > 0).alias("worded")).join(table, "node", "left")
    return out.select(
        F.col("_id").alias("doc_id"), F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("_id")).alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.hex("node").alias("text_md5"),
        F.hex("label").alias("label"),
    )


def keep_one(docs: DataFrame, classes: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stand for their class (label): the one of the smallest id, once. Rows without an id stay only if their class has no id; of ties,
    texts of one class and id, that of the smallest MD5. All columns are carried, whatever their names; an empty table gives an empty one. Texts without words belong to no class and stay, once for each id; those without an id all stay."""
    md5 = F.hex(F.unhex(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("_cid"), F.col("text_md5").alias("_cmd5"))).alias("f")
    best = classes.where("label is not null").groupBy("label").agg(first).select("f._cid", "f._cmd5", F.lit(False).alias("_each"))
    loose = classes.where("label is null").select(F.col("doc_id").alias("_cid"), F.col("text_md5").alias("_cmd5"), F.col("doc_id").isNull().alias("_each")).distinct()
    # the row as one value, so that no name of its columns matters
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col(doc_id).cast("long").alias("_id"), md5.alias("_md5"))
    rows = rows.join(best.unionByName(loose), F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_md5") == F.col("_cmd5")))
    rows = rows.withColumn("_copy", F.when(F.col("_each"), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long")))
    return rows.dropDuplicates(["_cid", "_cmd5", "_copy"]).select("_row.*")
