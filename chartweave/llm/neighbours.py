"""Approximate nearest neighbours by inner product, through a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is put into a leaf. A query walks the
tree best bin first: a priority queue holds the open bins by the inner product with their
centre, and leaves are taken from it until their number reaches what a calibration on the
sample found to give the wanted recall. Leaves meet their queries in a join, in blocks of
bounded size. Equal vectors are searched once: a class of them keeps its smallest ids, which
are all that an answer can show, so a large group of copies costs no more than one vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartweave.llm.common import spread_rows, stage

#: Vectors that the tree is fitted on at most, children of a node, and sample vectors of a leaf.
SAMPLE, BRANCH, LEAF = 20_000, 8, 64
#: Recall on the sample that the number of visited leaves is widened to, and queries used for it.
TARGET, CALIBRATION = 0.97, 300
#: Vectors or queries of a leaf in one block.
BLOCK = 4096
K = 20


@dataclass
class Tree:
    """``centres[i]`` of node ``i``; ``children[i]`` are nodes, or None for a leaf; ``points[i]`` a leaf's sample vectors."""

    centres: list = field(default_factory=list)
    children: list = field(default_factory=list)
    points: list = field(default_factory=list)
    visits: int = 1

    def leaves_of(self, x):
        """The leaf of each vector: at each node the nearest child."""
        import numpy as np

        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.children[node] is None:
                out[rows] = node
                continue
            c = self.centres[self.children[node][0] : self.children[node][-1] + 1]
            near = ((c**2).sum(1)[None, :] - 2 * x[rows] @ c.T).argmin(1)
            todo += [(child, rows[near == i]) for i, child in enumerate(self.children[node])]
        return out

    def bins(self, q) -> Iterator[int]:
        """Leaves of a query, best bin first."""
        import heapq

        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.children[node] is None:
                yield node
                continue
            first, last = self.children[node][0], self.children[node][-1]
            for child, score in zip(range(first, last + 1), (self.centres[first : last + 1] @ q).tolist(), strict=True):
                heapq.heappush(heap, (-score, child))

    def packed(self):
        return self.centres, self.children, self.points, self.visits


def k_means(x, k: int, rng, rounds: int = 12):
    """Cluster numbers of ``x``; empty clusters are dropped."""
    import numpy as np

    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        used, near = np.unique(near, return_inverse=True)
        centres = np.stack([x[near == i].mean(0) for i in range(len(used))])
    return near


def grow(x, seed: int = 11) -> Tree:
    """The tree over sample vectors ``x``; children of a node have consecutive numbers."""
    import numpy as np

    rng, tree = np.random.default_rng(seed), Tree()
    tree.centres, tree.children, tree.points = [x.mean(0) if len(x) else np.zeros(1)], [None], [x]
    at = 0
    while at < len(tree.centres):
        rows = tree.points[at]
        if len(rows) > LEAF:
            near = k_means(rows, BRANCH, rng)
            if near.max() > 0:
                tree.children[at] = list(range(len(tree.centres), len(tree.centres) + int(near.max()) + 1))
                for i in range(int(near.max()) + 1):
                    tree.centres.append(rows[near == i].mean(0))
                    tree.children.append(None)
                    tree.points.append(rows[near == i])
                tree.points[at] = rows[:0]
        at += 1
    tree.centres = np.array(tree.centres)
    return tree


def calibrate(tree: Tree, x, k: int = K) -> int:
    """The fewest leaves whose visits reach ``TARGET`` recall at ``k`` over sample queries, against brute force."""
    import numpy as np

    if len(x) <= k:
        return sum(c is None for c in tree.children)
    step = max(len(x) // CALIBRATION, 1)
    leaf, places = tree.leaves_of(x), []
    for i in range(0, len(x), step):
        scores = x @ x[i]
        scores[i] = -np.inf
        best = np.argpartition(-scores, k - 1)[:k]
        order = {node: n for n, node in enumerate(tree.bins(x[i]))}
        places += [order[n] for n in leaf[best].tolist()]
    return int(np.quantile(np.array(places), TARGET, method="higher")) + 1


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec, cls)`` of the vectors that take part: no null, finite components, not zero, of the commonest length."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(~bad & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("vec") == (sizes[0].n if sizes else 0)).withColumn("cls", F.xxhash64("vec"))


def exact_scores(q, x):
    """Inner products of pairs of rows in double precision, summed from left to right."""
    import numpy as np

    return np.cumsum(q.astype(np.float64) * x.astype(np.float64), axis=1)[:, -1]


def _matrix(column, kind=None):
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind or np.float64)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every`` its ``k`` best others.

    Best means largest inner product, ties go to the smaller id. Null, zero and non-finite
    vectors take no part, nor do those of another length than most. A repeated id counts once
    for each different vector. Fewer than ``k`` others give fewer rows; an empty table none.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col).dropDuplicates(["id", "cls"])
    low = Window.partitionBy("cls").orderBy("id")
    # What an answer can show of equal vectors: the k smallest ids, and one more for a query among them.
    few = rows.withColumn("n", F.row_number().over(low)).filter(F.col("n") <= k + 1)
    classes = stage(few.groupBy("cls").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec")), "classes")
    queries = stage(rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "cls"), "queries")
    import numpy as np

    sample = classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("vec").toPandas()["vec"]
    x = np.array(sample.tolist(), np.float64) if len(sample) else np.zeros((0, 1))
    tree = grow(x)
    tree.visits = calibrate(tree, x, k)
    held = spark.sparkContext.broadcast(tree.packed())

    def place(batches: Iterator):
        import pyarrow as pa

        t = Tree(*held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(t.leaves_of(_matrix(b.column(1))), pa.int64())], ["cls", "vec", "leaf"])

    def ask(batches: Iterator):
        import pyarrow as pa

        t = Tree(*held.value)
        for b in batches:
            bins, least = [], []
            for q in _matrix(b.column(1)):
                found, best = [], np.full(0, -np.inf)
                for leaf in t.bins(q):
                    found.append(leaf)
                    # Sample vectors are candidates too: the best k+1 of them are a bound for the rest.
                    best = np.concatenate((best, t.points[leaf] @ q))
                    if len(best) > k + 1:
                        best = np.partition(best, len(best) - k - 1)[-k - 1 :]
                    if len(found) >= t.visits and len(best) > k:
                        break
                bins.append(found)
                least.append(float(best.min()) if len(best) > k else float("-inf"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bins, pa.list_(pa.int64())), pa.array(least)], ["cls", "vec", "bins", "least"])

    kind = classes.schema["vec"].dataType.simpleString()
    placed = stage(spread_rows(classes.select("cls", "vec")).mapInArrow(place, f"cls long, vec {kind}, leaf long"), "leaves")
    asked = spread_rows(classes.join(queries.select("cls").distinct(), "cls", "left_semi").select("cls", "vec")).mapInArrow(ask, f"cls long, vec {kind}, bins array<long>, least double")
    asks = stage(asked.select("cls", "vec", "least", F.explode("bins").alias("leaf")), "asks")
    # Both sides of a leaf are cut into blocks of bounded size, and each pair of blocks meets once.
    cut = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    blocks = cut(placed, "nv").join(cut(asks, "nq"), "leaf")
    # Both sides number blocks as int: a cogroup deals keys by their hash, which depends on the type.
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(blocks, "leaf").withColumn("bv", F.pmod("cls", F.col("nv")).cast("int")).withColumn("bq", every_of("nq")).select("leaf", "bv", "bq", "cls", "vec")
    right = asks.join(blocks, "leaf").withColumn("bq", F.pmod(F.xxhash64("cls"), F.col("nq")).cast("int")).withColumn("bv", every_of("nv")).select("leaf", "bv", "bq", "cls", "vec", "least")

    def meet(v, q):
        import pandas as pd

        out: dict = {"q": [], "c": [], "score": []}
        if len(v) and len(q):
            xs, names = np.array(v["vec"].tolist(), np.float64), v["cls"].to_numpy()
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                qs, least = np.array(part["vec"].tolist(), np.float64), part["least"].to_numpy()
                s = qs @ xs.T
                floor = np.maximum(least, np.partition(s, s.shape[1] - k - 2, axis=1)[:, s.shape[1] - k - 2] if s.shape[1] > k + 2 else -np.inf)
                # Rounding of the fast product must not lose a tie, so a little more is taken and scored exactly.
                i, j = np.nonzero(s >= (floor - 1e-9 * (1 + np.abs(floor)))[:, None])
                out["q"].append(part["cls"].to_numpy()[i])
                out["c"].append(names[j])
                out["score"].append(exact_scores(qs[i], xs[j]))
        empty = {"q": np.int64, "c": np.int64, "score": np.float64}
        return pd.DataFrame({n: np.concatenate(a) if a else np.zeros(0, empty[n]) for n, a in out.items()})

    keys = ["leaf", "bv", "bq"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "q long, c long, score double")
    shown = classes.select(F.col("cls").alias("c"), "ids")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    near = pairs.join(shown.select("c", F.col("ids")[0].alias("first")), "c").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("q", "c", "score")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    entries = near.join(shown, "c").select("q", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).select(F.col("q").alias("cls"), "vec_id", "score")
    own = Window.partitionBy("query_id", "cls").orderBy(F.desc("score"), "vec_id")
    answers = queries.join(entries, "cls").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    return answers.select("query_id", "rank", "vec_id", "score")
