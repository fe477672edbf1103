"""Problem 2: the most similar vectors for every vector.

Method: a forest of random-projection trees searched through a shared priority queue, then exact
reranking of leaf candidates.

* The trees are fitted on a sample of at most ``SAMPLE`` distinct vectors (chosen by the hash of
  their key); a node is split by the direction between two centroids of its sample, at the median.
  Dense places get more splits.  Every vector is indexed: it belongs to one leaf of each tree.
* A sample of fixed size can't split a growing table for ever: a leaf of more than ``INNER`` vectors is
  split further by a tree of its own, fitted where its vectors lie, and each query searches the best
  ``INNER_LEAVES`` parts of it, so that the work for a vector stays the same however many there are.
* A query starts with the roots of all trees in one queue.  The best entry is taken, followed to its
  leaf, and the branches not taken enter the queue by the distance to their planes; this goes on
  until ``LEAVES`` leaves of the whole forest are found.  Batches of queries advance together.
* One shuffle by leaf brings a leaf's vectors, in bytes a value, together with the queries that
  reached it.  A leaf is handled in blocks of bounded size.  Within it every query keeps its best
  ``SPARE`` x k candidates by approximate cosine, with ``min_cosine`` only those that aren't under it by
  more than the rounding; only ids of candidates leave.
* Exact cosines of the distinct candidates rerank them.

Equal vectors are one point of the index, whatever the number of their keys; at most k + 1 of these
keys stand as neighbours of others, the rest have the same neighbours, so a group of copies that
holds a third of all rows costs k rows a key and never meets in one task.

Defined cases: null vectors, vectors of another length, all zero, with NaN, infinite or null values
and null keys take no part; keys that are repeated count once (with different vectors: the one of the
greatest hash; the others aren't neighbours of anything); ties in cosine go to the smaller key; fewer than two valid keys give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.plans.cut import cut, partitions

SAMPLE = 20_000
TREES = 5
LEAVES = 10
LEAF = 128
BLOCK = 2048
#: What rounding to bytes may change in a cosine of 64 values, with a margin.
ROUNDING = 0.02
#: Candidates of a query in a leaf, as a multiple of k.
SPARE = 3
#: Vectors of a leaf beyond which it is split further, the size of its parts, and how many of them a query searches.
INNER, INNER_LEAF, INNER_LEAVES = 4096, 512, 4


class Forest:
    """Planes of all trees in common arrays; children below zero are leaves."""

    def __init__(self, planes: np.ndarray, cuts: np.ndarray, children: np.ndarray, roots: np.ndarray):
        self.planes, self.cuts, self.children, self.roots = planes, cuts, children, roots

    @classmethod
    def fit(cls, sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        few = max(8, int(leaf * len(sample) / max(total, 1)))
        planes, cuts, children, roots, leaves = [], [], [], [], 0
        for _ in range(trees):
            pending, top = [(np.arange(len(sample)), None, 0)], None
            while pending:
                rows, parent, side = pending.pop()
                split = cls._split(sample[rows], rng) if len(rows) > few else None
                if split is None:
                    leaves += 1
                    me = -leaves
                else:
                    me = len(planes)
                    normal, at, right = split
                    planes.append(normal)
                    cuts.append(at)
                    children.append([0, 0])
                    pending += [(rows[~right], me, 0), (rows[right], me, 1)]
                if parent is None:
                    top = me
                else:
                    children[parent][side] = me
            roots.append(top)
        width = sample.shape[1]
        return cls(
            np.array(planes, np.float32).reshape(-1, width), np.array(cuts, np.float32), np.array(children, np.int64).reshape(-1, 2), np.array(roots, np.int64)
        )

    @staticmethod
    def _split(x: np.ndarray, rng: np.random.Generator):
        for _ in range(4):
            a, b = x[rng.choice(len(x), 2, replace=False)]
            for _ in range(3):
                near = x @ (a - b) > (a @ a - b @ b) / 2
                if near.all() or not near.any():
                    break
                a, b = x[near].mean(0), x[~near].mean(0)
            normal = a - b
            size = np.linalg.norm(normal)
            if size > 1e-6:
                normal = normal / size
                along = x @ normal
                at = np.median(along)
                right = along > at
                if right.any() and not right.all():
                    return normal, at, right
        return None

    def search(self, x: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
        """Leaves (1, 2, ...) of each row of x, best first, 0 for none; the first of them are its own leaf of each tree."""
        n, trees = len(x), len(self.roots)
        leaves = max(leaves, trees)
        queue = np.full((n, trees + 1), -np.inf, np.float32)
        nodes = np.zeros((n, trees + 1), np.int64)
        queue[:, :trees] = np.inf
        nodes[:, :trees] = self.roots
        found = np.zeros((n, leaves), np.int64)
        every = np.arange(n)
        for turn in range(leaves):
            best = queue.argmax(1)
            rank, node = queue[every, best], nodes[every, best]
            queue[every, best] = -np.inf
            live = every[rank > -np.inf]
            node = node.copy()
            pushed_rank, pushed_node = [], []
            while True:
                go = live[node[live] >= 0]
                if not len(go):
                    break
                at = node[go]
                margin = np.einsum("ij,ij->i", x[go], self.planes[at]) - self.cuts[at]
                right = (margin > 0).astype(np.int64)
                r, k = np.full(n, -np.inf, np.float32), np.zeros(n, np.int64)
                r[go] = np.minimum(rank[go], -np.abs(margin))
                k[go] = self.children[at, 1 - right]
                pushed_rank.append(r)
                pushed_node.append(k)
                node[go] = self.children[at, right]
            found[live, turn] = -node[live]
            if pushed_rank:
                queue = np.concatenate([queue, np.stack(pushed_rank, 1)], 1)
                nodes = np.concatenate([nodes, np.stack(pushed_node, 1)], 1)
                width = max(leaves - turn + trees, 1)
                if queue.shape[1] > 2 * width:  # what can't be reached any more
                    keep = np.argpartition(-queue, width, 1)[:, :width]
                    queue, nodes = np.take_along_axis(queue, keep, 1), np.take_along_axis(nodes, keep, 1)
        return found


def points(cache: DataFrame, key_col: str, vector_col: str, width: int) -> DataFrame:
    """(key, code, vector) of the valid rows: the unit vector as 4-byte floats and its 128-bit hash."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            top = np.abs(flat).max(1, initial=0)
            good = np.isfinite(top) & (top > 0)
            x = flat[good] / top[good][:, None]
            unit = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32) + np.float32(0)
            raw = [row.tobytes() for row in unit]
            yield pa.RecordBatch.from_arrays(
                [keys.filter(pa.array(good)), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())],
                names=["key", "code", "vector"],
            )

    rows = cache.select(F.col(key_col).cast("string").alias("key"), F.col(vector_col).cast("array<double>").alias("v"))
    # the size first: the other two conditions read the values
    rows = rows.where(F.col("key").isNotNull() & (F.size("v") == width) & ~F.exists("v", lambda x: x.isNull()))
    return rows.mapInArrow(run, "key string, code binary, vector binary")


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """The rows of a binary column whose values all have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), width)


def postings(vectors: DataFrame, forest: Forest, width: int, leaves: int) -> DataFrame:
    """(leaf, tag, short): each vector at the leaves it belongs to (tag = 2 id + 1) or only searches (2 id)."""
    shipped = vectors.sparkSession.sparkContext.broadcast((forest.planes, forest.cuts, forest.children, forest.roots))  # bounded by SAMPLE
    trees = len(forest.roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest(*shipped.value)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = matrix(batch.column(1), width, np.float32)
            for at in range(0, len(ids), BLOCK):
                part = x[at : at + BLOCK]
                found = f.search(part, leaves)
                short = np.rint(part * (127 / np.abs(part).max(1))[:, None]).astype(np.int8)
                row, turn = np.nonzero(found)
                tag = ids[at : at + BLOCK][row] * 2 + (turn < trees)
                raw = np.ascontiguousarray(short[row]).tobytes()
                ends = pa.py_buffer(np.arange(0, len(raw) + 1, width, dtype=np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[row, turn]), pa.array(tag), pa.Array.from_buffers(pa.binary(), len(row), [None, ends, pa.py_buffer(raw)])],
                    names=["leaf", "tag", "short"],
                )

    return vectors.select("id", "vector").mapInArrow(run, "leaf bigint, tag bigint, short binary")


def _best(ids: np.ndarray, x: np.ndarray, index: np.ndarray, y: np.ndarray, most: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) ids of the best ``most`` candidates of each query, by the rows of x and y."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(ids), BLOCK):
        best_value, best_id = None, None
        for b in range(0, len(index), BLOCK):
            s = x[a : a + BLOCK] @ y[b : b + BLOCK].T
            s[ids[a : a + BLOCK, None] == index[None, b : b + BLOCK]] = -np.inf
            names = np.broadcast_to(index[b : b + BLOCK], s.shape)
            keep = np.argpartition(-s, most - 1, 1)[:, :most] if s.shape[1] > most else None
            if keep is not None:
                s, names = np.take_along_axis(s, keep, 1), np.take_along_axis(names, keep, 1)
            if best_value is not None:
                s, names = np.concatenate([best_value, s], 1), np.concatenate([best_id, names], 1)
                if s.shape[1] > most:
                    keep = np.argpartition(-s, most - 1, 1)[:, :most]
                    s, names = np.take_along_axis(s, keep, 1), np.take_along_axis(names, keep, 1)
            best_value, best_id = s, names
        if best_value is not None:
            i, j = np.nonzero(best_value >= least)
            left.append(ids[a + i])
            right.append(best_id[i, j])
    return np.concatenate(left), np.concatenate(right)


def _leaf_pairs(tags: np.ndarray, short: np.ndarray, k: int, min_cosine: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    own = tags & 1 == 1
    ids, index = tags >> 1, tags[own] >> 1
    least = -2.0 if min_cosine is None else min_cosine - ROUNDING
    x = short.astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x[own]
    if len(index) <= INNER:
        yield _best(ids, x, index, y, SPARE * k, least)
        return
    inner = Forest.fit(y, len(y), 1, INNER_LEAF)
    where = np.concatenate([inner.search(y[a : a + BLOCK], 1)[:, 0] for a in range(0, len(y), BLOCK)])
    asked = np.concatenate([inner.search(x[a : a + BLOCK], INNER_LEAVES) for a in range(0, len(x), BLOCK)])
    row, turn = np.nonzero(asked)
    part = asked[row, turn]
    order, there = np.argsort(part, kind="stable"), np.argsort(where, kind="stable")
    row, part = row[order], part[order]
    names, first = np.unique(where[there], return_index=True)
    ends = np.append(first[1:], len(there))
    for name, a, b in zip(names, first, ends):
        q = row[np.searchsorted(part, name) : np.searchsorted(part, name, side="right")]
        yield _best(ids[q], x[q], index[there[a:b]], y[there[a:b]], SPARE * k, least)


def candidates(posted: DataFrame, width: int, k: int, min_cosine: float | None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ids that meet in a leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handle(leaf: np.ndarray, tags: np.ndarray, short: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.concatenate([[0], np.flatnonzero(np.diff(leaf)) + 1, [len(leaf)]])
            for p, q in zip(edges[:-1], edges[1:]):
                for x, y in _leaf_pairs(tags[p:q], short[p:q], k, min_cosine):
                    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        rest: list[tuple] = []  # of the last leaf, which may go on in the next batch
        for batch in batches:
            now = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), width, np.int8))
            if not len(now[0]):
                continue
            if rest and rest[-1][0][-1] == now[0][-1]:
                rest.append(now)
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))
            if rest or last:
                yield from handle(*(np.concatenate(x) for x in zip(*rest, tuple(x[:last] for x in now))))
            rest = [tuple(x[last:] for x in now)]
        if rest:
            yield from handle(*(np.concatenate(x) for x in zip(*rest)))

    spread = posted.repartition(partitions(posted), "leaf").sortWithinPartitions("leaf")
    return spread.mapInArrow(run, "a bigint, b bigint").distinct()


def rerank(pairs: DataFrame, vectors: DataFrame, width: int, min_cosine: float | None) -> DataFrame:
    """(a, b, cosine), exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (matrix(batch.column(c), width, np.float32).astype(np.float64) for c in (2, 3))
            cosine = np.einsum("ij,ij->i", x, y) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1), 1e-300)
            keep = pa.array(np.flatnonzero(cosine >= (-2 if min_cosine is None else min_cosine)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), batch.column(1).take(keep), pa.array(cosine).take(keep)], names=["a", "b", "cosine"]
            )

    v = vectors.select("id", "vector")
    both = pairs.join(v.toDF("a", "x"), "a").join(v.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a bigint, b bigint, cosine double")


def neighbours(
    cache: DataFrame,
    k: int = 5,
    min_cosine: float | None = None,
    key_col: str = "checksum",
    vector_col: str = "embedding",
    width: int = 64,
    trees: int = TREES,
    leaves: int = LEAVES,
    leaf: int = LEAF,
    sample: int = SAMPLE,
) -> DataFrame:
    """(key, neighbour, cosine, rank) of the k most similar other keys of every key, of those with at least ``min_cosine``."""
    valid = points(cache, key_col, vector_col, width)
    keys = cut(valid.groupBy("key").agg(F.max("code").alias("code")), "keys")
    vectors = cut(
        valid.groupBy("code").agg(F.first("vector").alias("vector")).join(keys.select("code"), "code", "left_semi").withColumn("id", F.monotonically_increasing_id()),
        "vectors",
    )
    total = vectors.count()
    # the code is a hash, so its first byte picks rows at random before the few that remain are ordered
    rows = vectors.select("code", "vector")
    if total > 4 * sample:
        share = min(256, -(-256 * 2 * sample // total))
        rows = rows.where(F.conv(F.substring(F.hex("code"), 1, 2), 16, 10).cast("int") < share)
    picked = np.array([np.frombuffer(r["vector"], np.float32) for r in rows.orderBy("code").limit(sample).collect()], np.float32).reshape(-1, width)
    forest = Forest.fit(picked, total, trees, leaf)
    near = rerank(candidates(postings(vectors, forest, width, leaves), width, k, min_cosine), vectors, width, min_cosine)
    both = near.select(F.col("a").alias("x"), F.col("b").alias("y"), "cosine").union(near.select("b", "a", "cosine"))
    best = Window.partitionBy("x").orderBy(F.desc("cosine"))  # ties stay until the keys decide them
    both = both.withColumn("n", F.rank().over(best)).where(F.col("n") <= k).drop("n")
    # keys of equal vectors: only the first k + 1 of a group can be anyone's neighbours
    order = Window.partitionBy("code").orderBy("key")
    few = keys.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    names = vectors.select("id", "code")
    target = few.join(names, "code").select(F.col("id").alias("y"), F.col("key").alias("neighbour"))
    own = keys.join(names, "code").select(F.col("id").alias("x"), "key")
    other = both.join(target, "y").join(own, "x").select("key", "neighbour", "cosine")
    repeated = keys.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code")
    same = (
        keys.join(repeated, "code", "left_semi")
        .join(few.select("code", F.col("key").alias("neighbour")), "code")
        .where("key <> neighbour")
        .select("key", "neighbour", F.lit(1.0).alias("cosine"))
    )
    rank = Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour")
    return other.union(same).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def found(cache: DataFrame) -> DataFrame:
    """(checksum_a, checksum_b): pairs with cosine >= 0.9 of which one is among the five nearest of the other."""
    got = neighbours(cache, k=5, min_cosine=0.9)
    return got.select(F.least("key", "neighbour").alias("checksum_a"), F.greatest("key", "neighbour").alias("checksum_b")).distinct()
