"""Hard negatives: for an anchor and one of its positives, the different-label rows whose scores lie in a window below it.

Vectors get one more component so that all of a shard have its longest one's length; then a score (inner product) and
a distance from the anchor determine each other, and a window of scores is an annulus. Each shard's vectors form a
vantage-point tree: a node holds its rows' distances from a vantage point, nearer half and farther half apart. A
traversal takes nodes by the least distance their rows may have, leaves out those that cannot meet the annulus, and
ends when the rows found so far are nearer than any node left. The tree only ever bounds; scores are exact whole
numbers. (Yianilos, 1993; Hjaltason and Samet, 1999; Bachrach et al., 2014.)
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm import tiles
from copse.llm.common import cut
from copse.llm.exact_search import one_query

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Percent of the positive's score between which a negative's lies.
LEAST, MOST = 30, 90
#: Rows of a leaf; share by which bounds are widened, far above the rounding of distances.
LEAF, SLACK = 256, 1e-9


class Tree:
    """A vantage-point tree over whole-number vectors; rows are kept in the order of its leaves."""

    def __init__(self, vectors: np.ndarray):
        self.scale = tiles.size(vectors)
        points = vectors / self.scale
        lengths = (points**2).sum(axis=1)
        self.longest = float(lengths.max())
        points = np.c_[points, np.sqrt(np.maximum(0, self.longest - lengths))]
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, list]] = []  # first row, end, and children: node, least and greatest distance
        vantage: list[np.ndarray] = []

        def split(start: int, end: int) -> int:
            node, children = len(self.nodes), []
            self.nodes.append((start, end, children))
            rows = self.order[start:end]
            center = points[rows].mean(axis=0)
            vantage.append(points[rows[((points[rows] - center) ** 2).sum(axis=1).argmax()]])
            if end - start > LEAF:
                apart = np.sqrt(((points[rows] - vantage[node]) ** 2).sum(axis=1))
                half = (end - start) // 2
                by = np.argpartition(apart, half)
                self.order[start:end], apart = rows[by], apart[by]
                for a, b in ((0, half), (half, end - start)):
                    children.append((split(start + a, start + b), float(apart[a:b].min()), float(apart[a:b].max())))
            return node

        split(0, len(points))
        self.vantage = np.stack(vantage)
        self.vectors = vectors[self.order]

    def ask(self, query: np.ndarray, able: np.ndarray, ids: np.ndarray, windows: list[tuple[float, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least and most score) the places and exact scores of its first ``k`` able rows, highest first, ties to the smaller id.

        ``able`` and ``ids`` are in the order of the tree.
        """
        length = tiles.size(query)
        q, unit = query / length, int(self.scale) * int(length)
        around = float(q @ q) + self.longest
        slack = SLACK * (1 + around)
        apart = np.sqrt(np.maximum(0, ((self.vantage - np.r_[q, 0.0]) ** 2).sum(axis=1))).tolist()
        score = lambda distance: (around - distance * distance) / 2
        scaled = lambda s: s if abs(s) == np.inf else int(s) / unit
        least, most = [low for low, _ in windows], [scaled(high) for _, high in windows]
        bounds = [scaled(low) for low in least]
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in windows]
        heap = [(-np.inf, 0, 0.0, np.inf)]
        while heap:
            best, node, near, far = heapq.heappop(heap)
            # of the windows, those that rows of this node may still enter
            needed = [j for j in range(len(windows)) if -best >= bounds[j] and (far == np.inf or score(far) - slack <= most[j])]
            start, end, children = self.nodes[node]
            if needed and not children:
                scores = tiles.products(query[None], self.vectors[start:end])[0]
                fit = np.flatnonzero(able[start:end] & (scores >= min(least[j] for j in needed)))
                scores = scores[fit]
                for j in needed if len(fit) else ():
                    here = np.flatnonzero((scores >= least[j]) & (scores <= windows[j][1]))
                    if len(here):
                        rows, s = np.concatenate((found[j][0], fit[here] + start)), np.concatenate((found[j][1], scores[here]))
                        first = tiles.ordered(s, ids[rows])[:k]
                        found[j] = rows[first], s[first]
                        if len(first) == k:  # what follows must at least reach the last of these
                            least[j], bounds[j] = s[first[-1]], scaled(s[first[-1]])
            for child, low, high in children if needed else ():
                d = apart[node]
                nearer, farther = max(near, d - high, low - d), min(far, d + high)
                heapq.heappush(heap, (-(score(nearer) + slack), child, nearer, farther))
        return found


def _positives(k: int, scale: int):
    def run(asked: pa.Table, held: pa.Table) -> list[pa.Table]:
        tree, ids, labels = _tree(held, scale)
        out = []
        for query, label, vector in zip(asked["query_id"].to_numpy(), asked["label"].to_numpy(), tiles.whole(asked["vector"], scale), strict=True):
            ((rows, scores),) = tree.ask(vector, (labels == label) & (ids != query), ids, [(-np.inf, np.inf)], k)
            out.append(pa.table({"query_id": np.full(len(rows), query), "vec_id": ids[rows], "score": scores.astype(np.int64)}))
        return out

    return run


def _negatives(k: int, scale: int, least: int, most: int):
    def run(asked: pa.Table, held: pa.Table) -> list[pa.Table]:
        tree, ids, labels = _tree(held, scale)
        out = []
        asking = zip(asked["query_id"].to_numpy(), asked["label"].to_numpy(), tiles.whole(asked["vector"], scale), asked["positive_scores"].to_pylist(), strict=True)
        for query, label, vector, positives in asking:
            windows = [(-(-least * p // 100), most * p // 100) for p in positives]
            for at, (rows, scores) in enumerate(tree.ask(vector, (labels != label) & (ids != query), ids, windows, k)):
                out.append(pa.table({"query_id": np.full(len(rows), query), "at": np.full(len(rows), at, dtype=np.int32), "vec_id": ids[rows], "score": scores.astype(np.int64)}))
        return out

    return run


def _tree(held: pa.Table, scale: int) -> tuple[Tree, np.ndarray, np.ndarray]:
    tree = Tree(tiles.whole(held["vector"], scale))
    return tree, held["vec_id"].to_numpy()[tree.order], held["label"].to_numpy()[tree.order]


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the inner product of two vectors (``vec_id, embedding, label``) after each component becomes
    ``floor(scale * x)``. An anchor's positives are its highest-scoring other rows of its label; the negatives of each are
    the highest-scoring rows of other labels with ``least * positive_score <= 100 * negative_score <= most *
    positive_score``, ties to the smaller id. No row has a negative below a positive score of less than zero. Scores
    beyond 64 bits count as the largest or smallest long.

    Rows with a null label or vector, or a null or non-finite component, take no part, and vectors meet vectors of their
    own length only. A row with the anchor's id is its own; of rows that share an id the least vector, then the least
    label, is the anchor, and all are candidates of other anchors, once each. A null id is no anchor and comes last
    among ties. An empty table gives an empty result, and other columns are left out.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"), is_anchor.alias("asks"))
    rows = tiles.numbered(rows.where(tiles.finite(F.col("vector")) & F.col("label").isNotNull()))
    base = rows.select("dim", "row", F.coalesce("vec_id", F.lit(tiles.NO_ID)).cast("long").alias("vec_id"), "vector", "label")
    anchors = one_query(rows.where("asks"), "label")
    row = F.struct((-F.col("score")).alias("s"), "vec_id")
    found, shards = tiles.dealt(anchors, base, _positives(positives, scale), "query_id long, vec_id long, score long")
    lists = cut(tiles.merged(found, ["query_id"], row, positives, shards, "shard").withColumnRenamed("list", "positives"))
    asked = anchors.join(lists, "query_id").withColumn("positive_scores", F.transform("positives", lambda p: -p["s"])).drop("positives")
    found, shards = tiles.dealt(asked, base, _negatives(negatives, scale, least, most), "query_id long, at int, vec_id long, score long")
    mined = tiles.merged(found, ["query_id", "at"], row, negatives, shards, "shard")
    ranked = mined.join(lists, "query_id").select("query_id", F.element_at("positives", F.col("at") + 1).alias("p"), F.posexplode("list").alias("place", "x"))
    known = lambda c: F.when(F.col(c) != tiles.NO_ID, F.col(c))
    return ranked.select(
        F.col("query_id").alias("anchor_id"), known("p.vec_id").alias("positive_id"), (F.col("place") + 1).cast("int").alias("rank"), known("x.vec_id").alias("negative_id"),
        (-F.col("p.s")).alias("positive_score"), (-F.col("x.s")).alias("negative_score"),
    )
