"""Approximate nearest neighbours by learned partitions (operator 2).

On a bounded sample a graph of nearest neighbours is built and divided into
partitions of equal size that cut few of its edges. A small classifier learns
which partitions the neighbours of a vector are in. Every vector is indexed in
the partition that the classifier holds most probable for it, and a query is sent
to as many of its most probable partitions as gave the wanted recall on queries
of the sample that the classifier hadn't seen; what it meets there is reranked by
exact distance.

The number of partitions grows with the root of the number of vectors, alike at
every size, up to what the sample can tell apart; where more are wanted, each
partition is divided again by a sample of its own. Each partition is searched block
by block, so that neither a large partition nor many queries meet in one task. A
block is as large as a task can well hold, as vectors are sent to as many tasks as
there are blocks of what they are compared with. Vectors without clusters have
neighbours everywhere: for these most partitions must be searched to reach a
recall, and the index saves little.

Cases: vectors that are null, empty or zero, or hold null or non-finite
components, and rows with a null vec_id, take no part. A query finds only vectors
of its own length. Rows with the same vec_id: each is a candidate, but never of a
query with that id. With fewer than k candidates all are returned; ties go to the
smaller vec_id. An empty table gives an empty result. Columns beside vec_id and
embedding aren't read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnow.llm.shared import dropped, ship, written
from winnow.llm.vectors import is_usable, matrix, sample_vectors

#: Vectors of the sample that partitions and classifier are fitted to, at most.
SAMPLE = 8_000
#: Partitions: one for so many roots of the number of vectors, at most; and vectors of the sample for each.
ROOTS, PARTITIONS, LEAST = 5, 256, 30
K, RECALL = 10, 0.96
#: Numbers in a block of candidates or queries.
BLOCK_NUMBERS = 1 << 21


def neighbours(x: np.ndarray, q: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """The k rows of x nearest to each row of q; own: a row of x that a query may not find."""
    out = []
    xx = (x * x).sum(axis=1)
    for i in range(0, len(q), 128):
        d = q[i : i + 128] @ x.T
        d *= -2
        d += xx
        if own is not None:
            d[np.arange(len(d)), own[i : i + 128]] = np.inf
        out.append(np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, :k])
    return np.concatenate(out)


def balanced_partitions(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """Partitions of equal size (to one row) of a graph of neighbours.

    Starts from balanced nearest centroids; then rows move to the partition that
    most of their neighbours are in, those that gain most first, as far as there
    is room, by trading places.
    """
    n, rng = len(x), np.random.Generator(np.random.PCG64(seed))
    room = -(-n // parts)
    c = x[np.sort(rng.choice(n, parts, replace=False))]
    for _ in range(8):
        near = ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        for p in range(parts):
            if (near == p).any():
                c[p] = x[near == p].mean(axis=0)
    d = (c * c).sum(axis=1)[None, :] - 2 * x @ c.T
    part, left = np.full(n, -1), np.full(parts, room)
    choice = np.argsort(d, axis=1)
    for i in np.argsort(d.min(axis=1) - np.sort(d, axis=1)[:, min(1, parts - 1)], kind="stable"):
        p = next(p for p in choice[i] if left[p] > 0)
        part[i], left[p] = p, left[p] - 1
    both = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    ends = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (ends, part[both]), 1)
        gain = votes - votes[np.arange(n), part][:, None]
        wish = gain.argmax(axis=1)
        best = gain[np.arange(n), wish]
        queues: dict[tuple[int, int], list[int]] = {}
        for i in np.argsort(-best, kind="stable"):
            if best[i] > 0:
                queues.setdefault((int(part[i]), int(wish[i])), []).append(int(i))
        moved = 0
        for (a, b), there in queues.items():
            if a < b:
                for i, j in zip(there, queues.get((b, a), []), strict=False):
                    part[i], part[j] = b, a
                    moved += 1
        if moved < max(1, n // 500):
            break
    return part


@dataclass
class Router:
    """Partitions of vectors of one length: a classifier with one hidden layer, and how many to search."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def most_probable(self, x: np.ndarray) -> np.ndarray:
        """The partition that each vector is indexed in."""
        return self.logits(x).argmax(axis=1) if len(x) else np.zeros(0, dtype=np.int64)


def train(x: np.ndarray, wanted: np.ndarray, hidden: int = 96, epochs: int = 25, seed: int = 11) -> Router:
    """Fits the classifier to the shares of each vector's neighbours in the partitions."""
    rng = np.random.Generator(np.random.PCG64(seed))
    mean = x.mean(axis=0)
    scale = float((x - mean).std()) or 1.0
    d, parts = x.shape[1], wanted.shape[1]
    z = (x - mean) / scale
    weights = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for i in range(0, len(z), 256):
            a, t = z[order[i : i + 256]], wanted[order[i : i + 256]]
            h = np.maximum(a @ weights[0] + weights[1], 0)
            o = h @ weights[2] + weights[3]
            p = np.exp(o - o.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            e = (p - t) / len(a)
            back = (e @ weights[2].T) * (h > 0)
            step += 1
            for w, g, mm, vv in zip(weights, [a.T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0)], m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                w -= 0.003 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, *weights)


def partitions(total: int, sample: int, most: int = PARTITIONS) -> int:
    """How many partitions `total` vectors are divided into."""
    return max(1, min(most, sample // LEAST, round(total**0.5 / ROOTS)))


def fit(x: np.ndarray, total: int, k: int = K, recall: float = RECALL, most: int = PARTITIONS) -> Router:
    """Partitions and classifier for `total` vectors, from a sample.

    A tenth of the sample is held out: its vectors are queries whose neighbours in
    the rest tell how many partitions reach the recall.
    """
    d = x.shape[1]
    parts = partitions(total, len(x), most)
    if parts == 1:
        return Router(np.zeros(d), 1.0, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    held = np.arange(len(x)) % 10 == 0
    seen, asked = x[~held], x[held]
    graph = neighbours(seen, seen, k, np.arange(len(seen)))
    part = balanced_partitions(seen, graph, parts)
    wanted = np.zeros((len(seen), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(seen)), k), part[graph].ravel()), 1.0 / (k + 1))
    wanted[np.arange(len(seen)), part] += 1.0 / (k + 1)
    router = train(seen, wanted)
    index = router.most_probable(seen)
    true = index[neighbours(seen, asked, k)]
    ranks = np.empty((len(asked), parts), dtype=np.int64)
    ranks[np.arange(len(asked))[:, None], np.argsort(-router.logits(asked), axis=1)] = np.arange(parts)
    found = np.take_along_axis(ranks, true, axis=1)
    router.probes = next((p for p in range(1, parts + 1) if (found < p).mean() >= recall), parts)
    return router


def top(q: np.ndarray, x: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query row, candidate row and exact distance of the k nearest of each query, ties to smaller ids."""
    xx, rows, cols, dist = (x * x).sum(axis=1), [], [], []
    for i in range(0, len(q), 128):
        part = q[i : i + 128]
        d = xx[None, :] - 2 * part @ x.T + (part * part).sum(axis=1)[:, None]
        d[q_ids[i : i + 128][:, None] == ids[None, :]] = np.inf
        kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        # products round differently from differences: whatever could be as near is measured exactly
        slack = 1e-9 * (1 + np.abs(xx).max() + (part * part).sum(axis=1))
        for r in range(len(part)):
            near = np.flatnonzero(np.isfinite(d[r]) & (d[r] <= kth[r] + slack[r]))
            exact = np.sqrt(((x[near] - part[r]) ** 2).sum(axis=1))
            order = np.lexsort((ids[near], exact))[:k]
            rows += [i + r] * len(order)
            cols += near[order].tolist()
            dist += exact[order].tolist()
    return np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64), np.array(dist, dtype=np.float64)


def divided(sent: DataFrame, k: int = K, recall: float = RECALL, sample: int = SAMPLE, most: int = PARTITIONS) -> DataFrame:
    """sent (vec_id, v, dim, part, asked) with `sub`: the partition within the partition.

    Each partition's own sample, drawn by a hash, is fitted in a task like the whole
    one's on the driver; a query is sent to the most probable of its partition's
    partitions. The routers, at most as many as there are partitions, go to all tasks.
    """
    there = sent.where(~F.col("asked"))
    counts = there.groupBy("dim", "part").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("vec_id", F.lit("second")), F.lit(1 << 30)) < 1.2 * sample / F.col("n") * (1 << 30)
    drawn = there.join(counts, ["dim", "part"]).where(draw).select("dim", "part", "n", "vec_id", "v")

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").slice(0, sample)
        router = fit(matrix(table.column("v")), table.column("n")[0].as_py(), k, recall, most)
        return pa.table({"dim": table.column("dim")[:1], "part": table.column("part")[:1], "router": pa.array([pickle.dumps(router)], pa.binary())})

    found = drawn.groupBy("dim", "part").applyInArrow(fitted, "dim int, part int, router binary").collect()
    routers = {(r["dim"], r["part"]): pickle.loads(r["router"]) for r in found}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], axis=1)
            asked = batch.column(4).to_numpy(zero_copy_only=False)
            for dim, part in np.unique(where, axis=0).tolist():
                own = np.flatnonzero((where == (dim, part)).all(axis=1))
                router = routers.get((dim, part))
                if router is None:  # no candidate is there
                    continue
                o = router.logits(matrix(batch.column(1).take(pa.array(own))))
                asks, rest = np.flatnonzero(asked[own]), np.flatnonzero(~asked[own])
                to = np.argsort(-o[asks], axis=1, kind="stable")[:, : router.probes]
                who = own[np.append(rest, np.repeat(asks, to.shape[1]))]
                sub = np.append(o[rest].argmax(axis=1) if len(rest) else np.zeros(0, np.int64), to.ravel()).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(who)) for c in batch.columns), pa.array(sub)], names=[*batch.schema.names, "sub"])

    return sent.select("vec_id", "v", "dim", "part", "asked").mapInArrow(assign, "vec_id long, v array<double>, dim int, part int, asked boolean, sub int")


def search(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL, sample: int = SAMPLE, most: int = PARTITIONS) -> DataFrame:
    """The k nearest found for each query row: query_id, rank (from 1), vec_id and score
    (the Euclidean distance in double precision), against all rows but those with its id."""
    ship(vectors.sparkSession)
    good = vectors.select("vec_id", F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & is_usable("v"))
    good = written(good.select("vec_id", F.col("v").cast("array<double>").alias("v")), "vectors")
    total = good.count()
    nested = round(total**0.5 / ROOTS) > min(most, sample // LEAST)
    each = recall**0.5 if nested else recall  # found on both levels
    routers = {d: fit(x, total, k, each, most) for d, x in sample_vectors(good, "vec_id", "v", sample).items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query = batch.column(2).to_numpy(zero_copy_only=False)
            dims = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = matrix(batch.column(1).take(pa.array(own)))
                router = routers.get(dim)
                if router is None:  # a length that the sample doesn't hold: one partition
                    router = fit(x[:1], 1)
                o = router.logits(x)
                asks = np.flatnonzero(query[own])
                to = np.argsort(-o[asks], axis=1, kind="stable")[:, : router.probes]
                who = np.append(own, np.repeat(own[asks], to.shape[1]))
                part = np.append(o.argmax(axis=1), to.ravel()).astype(np.int32)
                asked = np.arange(len(who)) >= len(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who)), pa.array(np.full(len(who), dim, dtype=np.int32)), pa.array(part), pa.array(asked)], names=["vec_id", "v", "dim", "part", "asked"])

    sent = written(good.withColumn("q", F.coalesce(is_query, F.lit(False))).select("vec_id", "v", "q").mapInArrow(assign, "vec_id long, v array<double>, dim int, part int, asked boolean"), "routed")
    dropped(good)
    sent = written(divided(sent, k, each, sample, most), "divided") if nested else sent.withColumn("sub", F.lit(0))
    key = ["dim", "part", "sub"]
    counts = sent.groupBy(*key).agg(F.count_if("asked").alias("nq"), F.count_if(~F.col("asked")).alias("nx")).where("nq > 0 and nx > 0")
    blocks = lambda n: F.ceil(F.col(n) * F.col("dim") / BLOCK_NUMBERS).cast("int").alias(n)
    counts = counts.select(*key, blocks("nq"), blocks("nx"))
    sent = sent.join(counts, key)
    own = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.when(F.col("asked"), F.col("nq")).otherwise(F.col("nx"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("asked"), F.col("nx")).otherwise(F.col("nq")) - 1))
    sent = sent.select(*key, "vec_id", "v", "asked", own.alias("own"), other.alias("other"))
    sent = sent.select(*key, "vec_id", "v", "asked", F.when(F.col("asked"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("asked"), F.col("other")).otherwise(F.col("own")).alias("j"))

    def rerank(table: pa.Table) -> pa.Table:
        asked = table.column("asked").to_numpy()
        v, ids = matrix(table.column("v")), table.column("vec_id").to_numpy()
        if asked.all() or not asked.any():
            r, c, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            r, c, d = top(v[asked], v[~asked], ids[asked], ids[~asked], k)
        return pa.table({"query_id": ids[asked][r], "vec_id": ids[~asked][c], "score": d})

    found = sent.groupBy(*key, "i", "j").applyInArrow(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
