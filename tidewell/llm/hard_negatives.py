"""Hard negatives of anchors by exact inner products, found by cover trees over norm-augmented vectors.

One more coordinate, the root of what a vector lacks of the longest one's squared norm, puts all candidates on a sphere, on which
inner products with an anchor (whose own further coordinate is 0) order candidates as angles do. A tree over a block of candidates covers each
node's points by a net of its own points at a smaller radius, level by level; a node keeps its covering radius, the
true distance of its farthest point, and so bounds the inner products of all its points from above and below. The descent takes the
node with the highest bound first, skips nodes that lie outside all windows of scores that are asked for, ends when no
bound reaches the worst of the best scores so far (equal scores go on, since ids break ties), and computes the scores at leaves exactly.

Blocks are parts of the table by hash of the id, so none is large, whatever the vectors. Anchors, the stated query set, are sent to
every block, and each block gives its few best for each window; windows of Spark merge them. The first pass finds each
anchor's positives, the second the negatives in the window that each positive sets.

Defined results: rows with a null id, label, vector or component, or one that isn't finite, take no part. Rows that share an id are one: that with the
smallest label, then vector. Vectors of different lengths count as followed by zeros; an empty one has the score 0 with all. Components
beyond +-2**20 count as that. A positive with a negative score has no negatives. An empty table gives nothing. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialized, partitions

#: Candidates of a block, about.
BLOCK = 8192
#: Candidates of a leaf at most, and what a level's radius is divided by.
LEAF = 128
EXPANSION = 1.15
#: Partial sums below this are exact as doubles.
EXACT = 1 << 53
NO_BOUND = 1 << 62


def inner(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exact: as doubles where these can hold every sum."""
    most = max(1, int(np.abs(rows).max(initial=0))) * max(1, int(np.abs(others).max(initial=0))) * max(1, rows.shape[-1])
    if most < EXACT:
        return (rows.astype(np.float64) @ others.T.astype(np.float64)).astype(np.int64)
    return rows @ others.T


class CoverTree:
    """Candidates (id, label, integer vector) of one block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        x = vectors.astype(np.float64)
        norms = (x * x).sum(1)
        self.longest = float(np.sqrt(norms.max()))
        space = np.column_stack([x, np.sqrt(np.maximum(norms.max() - norms, 0))])
        leaves: list[np.ndarray] = []
        center, radius, children, leaf = [], [], [], []

        def distances(points: np.ndarray, to: int) -> np.ndarray:
            return np.sqrt(((space[points] - space[to]) ** 2).sum(1))

        def node(points: np.ndarray, at: int, far: np.ndarray) -> int:
            center.append(at)
            radius.append(float(far.max()))
            children.append([])
            leaf.append(-1)
            return len(center) - 1

        everything = np.argsort(ids, kind="stable")
        waiting = [(node(everything, int(everything[0]), distances(everything, int(everything[0]))), everything)]
        while waiting:
            here, points = waiting.pop()
            if len(points) <= LEAF or radius[here] == 0:
                for a in range(0, len(points), LEAF):
                    # Many equal points are leaves beside each other.
                    k = here if len(points) <= LEAF else node(points, center[here], np.zeros(1))
                    if k != here:
                        children[here].append(k)
                    leaf[k] = len(leaves)
                    leaves.append(points[a : a + LEAF])
                continue
            # A net of this level: each center takes what is left within the next level's radius. The node's own center is the first.
            reach, at, small = radius[here] / EXPANSION, center[here], []
            while len(points):
                far = distances(points, at)
                own = far <= reach
                part = points[own]
                if len(part) >= LEAF // 4:
                    waiting.append((node(part, at, far[own]), part))
                    children[here].append(waiting[-1][0])
                else:
                    small.append(part)
                points = points[~own]
                at = int(points[0]) if len(points) else at
            # Parts of a few points share leaves, which have covering radii of their own.
            rest = np.concatenate([np.zeros(0, np.int64), *small])
            for a in range(0, len(rest), LEAF):
                part = rest[a : a + LEAF]
                k = node(part, int(part[0]), distances(part, int(part[0])))
                children[here].append(k)
                leaf[k] = len(leaves)
                leaves.append(part)
        order = np.concatenate(leaves)
        self.bounds = np.append(0, np.cumsum([len(p) for p in leaves]))
        self.centers, self.radius, self.leaf = vectors[center], np.array(radius), leaf
        self.children = [np.array(c, np.int64) for c in children]
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.largest = int(np.abs(vectors).max(initial=0))
        self.doubles = self.vectors.astype(np.float64)

    def widen(self, width: int) -> None:
        """Zeros behind all vectors, up to so many components."""
        if self.vectors.shape[1] < width:
            self.vectors, self.centers = _wide(self.vectors, width), _wide(self.centers, width)
            self.doubles = self.vectors.astype(np.float64)

    def node_bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) inner product of each anchor with any point of each node: by the angles to its center and across its radius."""
        length = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))[:, None] * self.longest
        angle = np.arccos(np.clip(inner(anchors, self.centers) / np.where(length > 0, length, 1), -1, 1))
        spread = 2 * np.arcsin(np.clip(self.radius / (2 * self.longest or 1), 0, 1))
        slack = 1e-6 * length + 1e-3
        return length * np.cos(np.minimum(angle + spread, np.pi)) - slack, length * np.cos(np.maximum(angle - spread, 0)) + slack

    def search(self, anchor: int, label: int, vector: np.ndarray, same: bool, windows: list[tuple[int, int]], k: int, least: np.ndarray, most: np.ndarray) -> tuple[list[list[tuple[int, int]]], int]:
        """The k best (score, id) in each window of scores (both ends included) among points of the same label, or of others; and the points read."""
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        need = [low for low, _ in windows]
        top, read = max(high for _, high in windows), 0
        exact = max(1, int(np.abs(vector).max(initial=0))) * max(1, self.largest) * max(1, len(vector)) < EXACT
        table = self.doubles if exact else self.vectors
        vector = vector.astype(table.dtype)
        queue = [(-float(most[0]), 0)]
        while queue:
            bound, here = heapq.heappop(queue)
            # Below every window, or below the worst of k in all of them: so is all that waits.
            if -bound < min(need):
                break
            if self.leaf[here] < 0:
                kids = self.children[here]
                inside = kids[(most[kids] >= min(need)) & (least[kids] <= top)]
                for kid in inside.tolist():
                    heapq.heappush(queue, (-float(most[kid]), kid))
                continue
            a, b = self.bounds[self.leaf[here]], self.bounds[self.leaf[here] + 1]
            read += b - a
            score = table[a:b] @ vector
            some = np.flatnonzero((score >= min(need)) & (score <= top) & ((self.labels[a:b] == label) == same) & (self.ids[a:b] != anchor))
            if not len(some):
                continue
            score, ids = score[some].astype(np.int64), self.ids[a:b][some]
            order = np.lexsort((ids, -score))
            score, ids = score[order], ids[order]
            for w, (_, high) in enumerate(windows):
                inside = np.flatnonzero((score >= need[w]) & (score <= high))[:k]
                if len(inside):
                    best[w] = sorted([*best[w], *zip(score[inside].tolist(), ids[inside].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
                    if len(best[w]) == k:
                        need[w] = best[w][-1][0]
        return best, int(read)


def _vectors(column: pa.ListArray) -> np.ndarray:
    """Integer vectors of a list column, followed by zeros up to the longest."""
    first = column.offsets.to_numpy()
    size = np.diff(first)
    flat = column.flatten().to_numpy().astype(np.int64)
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(first[:-1] - first[0], size)] = flat
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def _best(rows: DataFrame, anchors: DataFrame, blocks: int, same: bool, k: int, low_percent: int) -> DataFrame:
    """The best of each block for each window of each anchor. anchors: vec_id, label, q, positives (array of structs s, id; null: no bounds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if block[a] != now:
                    now, tree, parts = block[a], None, []
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    parts.append(part)
                    continue
                if tree is None and parts:
                    own = pa.Table.from_batches(parts)
                    tree = CoverTree(own["vec_id"].to_numpy(), own["label"].to_numpy(), _vectors(own["q"].combine_chunks()))
                    parts = []
                if tree is not None:
                    yield from searched(tree, part)

    def searched(tree: CoverTree, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vectors = _vectors(part.column(4))
        width = max(vectors.shape[1], tree.vectors.shape[1])
        vectors = _wide(vectors, width)
        tree.widen(width)
        least, most = tree.node_bounds(vectors)
        out: list[tuple] = []
        ids, labels, positives = (part.column(c).to_pylist() for c in (2, 3, 5))
        for i, anchor in enumerate(ids):
            held = [(None, None)] if same else [(p["id"], p["s"]) for p in positives[i] if p["s"] >= 0]
            if not held:
                continue
            # Of a positive score s the window is from low_percent % of s, rounded up, to s.
            windows = [(-NO_BOUND, NO_BOUND) if s is None else (-(-low_percent * s // 100), s) for _, s in held]
            best, _ = tree.search(anchor, labels[i], vectors[i], same, windows, k, least[i], most[i])
            out += [(anchor, *p, i, s) for p, few in zip(held, best, strict=True) for s, i in few]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in FOUND.split(", ")])

    number = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    one = rows.select(number.alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "q", F.lit(None).cast("array<struct<s:bigint,id:bigint>>").alias("positives"))
    two = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "label", "q", "positives")
    tasks = min(blocks, partitions(rows.sparkSession))
    dealt = one.unionByName(two).repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions("block", "kind", "vec_id")
    return dealt.mapInArrow(run, FOUND)


def mined(vectors: DataFrame, every: int = 100, k: int = 5, low_percent: int = 80, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, embedding, label; anchors have ids that ``every`` divides."""
    component = "CAST(floor(256 * greatest(-1048576D, least(1048576D, CAST(x AS DOUBLE)))) AS INT)"
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("e"))
    good = good.filter("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = good.select("vec_id", F.struct(label.alias("label"), F.expr(f"transform(e, x -> {component})").alias("q")).alias("r"))
    rows = materialized(rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.q"), "vectors")
    n = rows.count()
    blocks = max(1, -(-n // block), min(partitions(rows.sparkSession), n // (4 * LEAF)))
    anchors = rows.filter(F.col("vec_id") % every == 0)
    found = _best(rows, anchors.withColumn("positives", F.lit(None).cast("array<struct<s:bigint,id:bigint>>")), blocks, True, k, low_percent)
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    positives = found.withColumn("rank", first).filter(F.col("rank") <= k).groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("score").alias("s"), "id")).alias("positives"))
    asking = materialized(anchors.join(positives, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "q", "positives"), "positives")
    negatives = _best(rows, asking, blocks, False, k, low_percent)
    place = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id"))
    return negatives.withColumn("rank", place).filter(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
