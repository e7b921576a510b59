"""Approximate nearest neighbours by learned partitions: a balanced cut of a neighbour graph, and a classifier that routes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.plans.staging import ship, stage

#: Vectors that the partitions are learned on, about (by a hash of vec_id): SAMPLE, growing with the root of their number
#: from GROWS vectors on, and MOST at most.
SAMPLE, GROWS, MOST = 4096, 100_000, 32_768
#: Rows and queries that one task multiplies at a time.
ROWS, QUERIES = 16_384, 1024
_PER_PART = 128


class Router:
    """A hidden layer and a softmax over partitions; probes: partitions that a query visits."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]], probes: int, parts: int):
        self.layers, self.probes, self.parts = layers, probes, parts

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        (a, b), (c, d) = self.layers
        return np.maximum(x @ a + b, 0) @ c + d


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k vectors of largest inner product for each, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 256):
        s = x[a : a + 256] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        out[a : a + 256] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _cut(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A partition of the graph into parts of at most 5 % over the mean: halving by main directions, then moves of
    vectors to where most of their neighbours are, those that gain most first."""
    n = len(x)
    label = np.zeros(n, np.int64)
    groups = [np.arange(n)]
    rng = np.random.default_rng(3)
    while len(groups) < parts:
        groups.sort(key=len)
        g = groups.pop()
        v = x[g] - x[g].mean(0)
        d = rng.normal(size=x.shape[1])
        for _ in range(10):
            d = v.T @ (v @ d)
            d /= np.linalg.norm(d) + 1e-30
        order = g[np.argsort(v @ d, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for i, g in enumerate(groups):
        label[g] = i
    most = int(np.ceil(1.05 * n / parts))
    i = np.repeat(np.arange(n), near.shape[1])
    j = near.ravel()
    for _ in range(rounds):
        pull = np.zeros((n, parts))
        np.add.at(pull, (i, label[j]), 1)
        np.add.at(pull, (j, label[i]), 1)
        best = pull.argmax(1)
        gain = pull[np.arange(n), best] - pull[np.arange(n), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[best[v]] < most:
                size[label[v]] -= 1
                size[best[v]] += 1
                label[v] = best[v]
                moved += 1
        if not moved:
            break
    return label


def _classifier(x: np.ndarray, label: np.ndarray, parts: int, hidden: int = 64, epochs: int = 40) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(5)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    w = [rng.normal(size=(x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]) * 2, np.zeros(hidden), rng.normal(size=(hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            at = order[a : a + 256]
            h = np.maximum(x[at] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), label[at]] -= 1
            p /= len(at)
            back = (p @ w[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((x[at].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return [(w[0], w[1]), (w[2], w[3])]


def learn(x: np.ndarray, k: int = 20, aim: float = 0.95) -> Router:
    """Partitions and router from sample vectors. The number of probes is the least with which the sample's own
    queries find `aim` of their k nearest in the sample."""
    n = len(x)
    parts = max(1, n // _PER_PART)
    if parts == 1:
        return Router([(np.zeros((x.shape[1], 1)), np.zeros(1)), (np.zeros((1, 1)), np.zeros(1))], 1, 1)
    x = x.astype(np.float64)
    label = _cut(x, _graph(x, 10), parts)
    router = Router(_classifier(x, label, parts), parts, parts)
    own = np.concatenate([router.logits(x[a : a + 1024]) for a in range(0, n, 1024)])
    home = own.argmax(1)
    some = np.random.default_rng(9).permutation(n)[:1024]
    truth = _graph_of(x, some, min(k, n - 1))
    rank = np.argsort(np.argsort(-own[some], axis=1), axis=1)  # of each partition for each query
    need = rank[np.arange(len(some))[:, None], home[truth]]
    recall = [(need < p).mean() for p in range(1, parts + 1)]
    router.probes = next(p for p, r in enumerate(recall, 1) if r >= aim)
    return router


def _graph_of(x: np.ndarray, some: np.ndarray, k: int) -> np.ndarray:
    s = x[some] @ x.T
    s[np.arange(len(some)), some] = -np.inf
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part: with an id, not zero, all components finite numbers."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def _route(router: Router, probes: int):
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                part = b.slice(a, 2048)
                col = part.column("v")
                x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
                z = router.logits(x)
                best = np.argsort(-z, axis=1, kind="stable")[:, :probes].astype("i4")
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), col, pa.array(list(best), pa.list_(pa.int32()))], names=["vec_id", "v", "parts"])

    return run


def _multiply(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            side = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            ids, q = right.column("vec_id").to_numpy(), left.column("query_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x, y = ids[order], side(right)[order], side(left)
            for a in range(0, len(q), 256):
                s = y[a : a + 256] @ x.T
                s[q[a : a + 256, None] == ids[None, :]] = -np.inf
                least = -np.partition(-s, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                for r in range(len(s)):
                    # the product's rounding may differ by place: take what is near the k-th, then multiply alike
                    at = np.flatnonzero((s[r] >= least[r] - 1e-9 * (1 + abs(least[r]) if np.isfinite(least[r]) else 1)) & (s[r] > -np.inf))
                    exact = (x[at] * y[a + r]).sum(1)
                    top = np.argsort(-exact, kind="stable")[:k]
                    got["query_id"].append(np.full(len(top), q[a + r]))
                    got["vec_id"].append(ids[at[top]])
                    got["score"].append(exact[top])
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, t) for (c, v), t in zip(got.items(), kinds, strict=True)})

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, sample: int | None = None) -> DataFrame:
    """For each vector with is_query (a Column over vec_id), the k others found with the largest inner product.

    Partitions are learned on about `sample` vectors (see SAMPLE), chosen by a hash of vec_id, one for each 128 of them; then
    every vector is indexed in its most probable partition and every query visits its most probable ones, or all where
    these hold fewer than k candidates. Result: query_id long, rank int (from 1), vec_id long, score double (in double
    precision on the original vectors), ties to the smaller vec_id.

    Vectors that are null, zero, or hold nulls or non-finite numbers, those of another length than most of the sample,
    and rows without vec_id take no part. Rows that share a vec_id are each a candidate, and never their own id's.
    An empty table gives an empty result; fewer candidates than k are all returned. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors.select("vec_id", "embedding"))
    dims = [r[0] for r in rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()]
    if not dims:
        return empty
    rows = rows.filter(F.size("v") == dims[0])
    total = rows.count()
    sample = sample or int(min(MOST, SAMPLE * max(1.0, total / GROWS) ** 0.5))
    draw = F.pmod(F.xxhash64(F.lit(13), "vec_id"), F.lit(1_000_000)) / 1e6
    some = rows.filter(draw < min(1.0, sample / total)).orderBy("vec_id").limit(2 * sample).select("v").toArrow()
    x = some.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1) if some.num_rows else np.zeros((0, dims[0]))
    router = learn(x, k)
    ddl = "vec_id long, v array<double>, parts array<int>"
    homes = stage(rows.mapInArrow(_route(router, 1), ddl).select("vec_id", "v", F.col("parts")[0].alias("part")), "homes")
    visits = rows.filter(is_query).mapInArrow(_route(router, router.probes), ddl)
    asks = stage(visits.select(F.col("vec_id").alias("query_id"), "v", F.explode("parts").alias("part")), "asks")
    top = stage(_search(homes, asks, k), "top")
    if router.probes < router.parts:
        enough = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k, total - 1))
        short = stage(asks.join(enough, "query_id", "left_anti").select("query_id", "v").distinct(), "short")
        if not short.isEmpty():
            everywhere = short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(router.parts - 1))))
            top = top.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(_search(homes, everywhere, k))
    return top


def _search(homes: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """The k largest products of each query (asks: query_id, v, part) with the vectors (homes: vec_id, v, part) of its
    parts. A part of any size is cut into chunks of rows, and its queries into chunks; each pair is one small product."""
    chunks = lambda df, size, name: df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    grid = F.broadcast(chunks(homes, ROWS, "nr").join(chunks(asks, QUERIES, "nq"), "part"))  # a row for each part
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    right = homes.join(grid, "part").withColumn("r", F.pmod(F.xxhash64("vec_id"), "nr").cast("int")).withColumn("q", upto("nq")).select("part", "r", "q", "vec_id", "v")
    left = asks.join(grid, "part").withColumn("q", F.pmod(F.xxhash64("query_id"), "nq").cast("int")).withColumn("r", upto("nr")).select("part", "r", "q", "query_id", "v")
    found = left.groupBy("part", "r", "q").cogroup(right.groupBy("part", "r", "q")).applyInArrow(_multiply(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
