"""Near-duplicate embeddings within labels (operator 7).

Spherical k-means puts each vector in the cell of its nearest centroid. A pair
of vectors as near as is asked can still lie in two cells; a vector is therefore
also sent, as a guest, to each cell of a smaller number whose border is no
farther than such a pair can reach: if x and y are at most r apart, and y is
nearest to centroid d, then x . (c - d) <= r |c - d| for any c. So no link is
lost, whatever the cells. How many cells pay off is measured on the sample that
they are fitted to: where vectors have no clusters, borders are everywhere near,
and the least number of cells is cheapest. One sample can't tell more cells apart
than CELLS has; a cell of a label with more than LARGE vectors is therefore divided
again, by k-means over a sample of its own, if that pays off, and by the same bound.

Vectors with equal label and components are one class, which counts as often as
it occurs. Cells are compared block by block, as products of matrices in double
precision; a pair of blocks gives the number of links of each class, and edges
that span what it links, never the pairs themselves. Blocks grow with the cell, so
that a vector is sent to some BLOCKS tasks at most, until a block is as large as a
task can well hold.

Cases: vectors that are null, empty or zero, or hold null or non-finite
components, and rows with a null label or vec_id, link with nothing: they have 0
links and their own vec_id as component_id, and are kept. Vectors of different
lengths don't link. Rows with the same vec_id are vectors of their own. An empty
table gives an empty result. Columns beside vec_id, embedding and label aren't
read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.shared import Scratch, components, ship, written
from winnow.llm.vectors import is_usable, matrix, sample_vectors, spherical_k_means, unit

#: Vectors that cells are fitted to, at most.
SAMPLE = 8_000
#: Rows of a block at least, numbers in it at most, and blocks of a cell that lies between.
BLOCK, BLOCK_NUMBERS, BLOCKS = 2048, 1 << 21, 16
#: Numbers of cells that are tried.
CELLS = (2, 8, 32, 128, 512)
#: What it costs to send a vector to one cell more, in comparisons.
SENDING = 1000
#: Vectors of a cell beyond which it is divided again, and vectors that a task places then.
LARGE, PLACED = 100_000, 50_000
_TILE = 512


def within(x: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row of x, and for each row which cells may hold vectors as near to it as is asked, its own among them."""
    near = x @ c.T
    home = near.argmax(axis=1)
    reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
    # of centroids that are the same but for rounding, either may be the nearest
    return home, near[np.arange(len(x)), home][:, None] - near <= reach * apart[home] + 1e-9


def guests(x: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row of x, and for each row which other cells it must be sent to."""
    home, to = within(x, c, least)
    return home, to & (np.arange(len(c))[None, :] < home[:, None])


def fit_cells(x: np.ndarray, least: float, total: float, choices: Sequence[int] = CELLS, sending: int = SENDING) -> np.ndarray:
    """Centroids, as many as make comparisons and sendings of `total` vectors of a label cheapest."""
    best, cells = np.inf, x[:1]
    for k in choices:
        if k * 8 > len(x):
            break
        c = spherical_k_means(x, k)
        home, to = guests(x, c, least)
        own = np.bincount(home, minlength=len(c)) / len(x)
        cost = (own * (own + to.mean(axis=0))).sum() * total + sending * to.sum() / len(x)
        if cost < 0.8 * best:
            best, cells = cost, c
    return cells


def spanning(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join all that a matrix of links joins, at most one for each row and column."""
    out = []
    open_rows, open_columns = links.any(axis=1), links.any(axis=0)
    while open_rows.any():
        front = [int(open_rows.argmax())]
        open_rows[front[0]] = False
        root = rows[front[0]]
        while front:
            hit = np.flatnonzero(links[front].any(axis=0) & open_columns)
            open_columns[hit] = False
            out += [(root, c) for c in columns[hit] if c != root]
            front = np.flatnonzero(links[:, hit].any(axis=1) & open_rows)
            open_rows[front] = False
            out += [(root, r) for r in rows[front] if r != root]
            front = front.tolist()
    return out


def compare(x, y, x_ids, y_ids, x_times, y_times, least: float, same: bool):
    """Links of each row of x and of y, weighed by how often the other occurs, and
    edges that span them. same: x and y are one block, each pair of which counts once for each end."""
    xs, ys = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
    edges = []
    for i in range(0, len(x), _TILE):
        for j in range(0, len(y), _TILE):
            if same and j < i:
                continue
            near = x[i : i + _TILE] @ y[j : j + _TILE].T >= least
            if same and i == j:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            xs[i : i + _TILE] += near @ y_times[j : j + _TILE]
            if not (same and i == j):
                ys[j : j + _TILE] += x_times[i : i + _TILE] @ near
            edges += spanning(near, x_ids[i : i + _TILE], y_ids[j : j + _TILE])
    return xs, ys, edges


def divided(sent: DataFrame, key: list[str], least: float, large: int, sample: int, choices: Sequence[int], sending: int = SENDING) -> DataFrame | None:
    """Vectors sent to cells, with a cell within each cell (`sub`); None if no cell has more than `large` of its own.

    A cell's sample, drawn by a hash, is fitted in one task. Its own vectors lie in
    one sub-cell and are guests in those of smaller numbers that are near; its guests
    are guests in each that is near, as they must meet all of its own vectors.
    """
    sizes = sent.groupBy(*key).agg(F.count_if(~F.col("guest")).alias("n"))
    if sizes.where(F.col("n") > large).isEmpty():
        return None
    sized = sent.join(sizes, key)
    rows = sized.where(F.col("n") > large)
    draw = F.pmod(F.xxhash64("cls", F.lit("second")), F.lit(1 << 30)) * F.col("n") < int(1.2 * sample) * (1 << 30)

    def fit(table: pa.Table) -> pa.Table:
        drawn = table.sort_by("cls").slice(0, sample)
        c = fit_cells(matrix(drawn.column("v")), least, drawn.column("n")[0].as_py(), (1, *choices), sending)
        out = {f"of_{k}": pa.array([drawn.column(k)[0].as_py()] * len(c), pa.int32()) for k in key}
        return pa.table(out | {"n": pa.array([drawn.column("n")[0].as_py()] * len(c), pa.int64()), "number": np.arange(len(c)), "c": pa.array(list(c), pa.list_(pa.float64()))})

    def place(table: pa.Table, fitted: pa.Table) -> pa.Table:
        who, sub, guest = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=bool)]
        if len(table):
            x, visits = matrix(table.column("v")), table.column("guest").to_numpy(zero_copy_only=False)
            c = matrix(fitted.sort_by("number").column("c")) if len(fitted) else x[:1] * 0
            for at in range(0, len(x), 4096):
                home, to = within(x[at : at + 4096], c, least)
                mine = ~visits[at : at + 4096]
                to &= (np.arange(len(c))[None, :] < home[:, None]) | ~mine[:, None]
                r, d = np.nonzero(to)
                who += [np.flatnonzero(mine) + at, r + at]
                sub += [home[mine], d]
                guest += [np.zeros(mine.sum(), dtype=bool), np.ones(len(r), dtype=bool)]
        out = table.select(["cls", "label", "times", "dim", "cell", "v"]).take(pa.array(np.concatenate(who)))
        out = out.append_column("guest", pa.array(np.concatenate(guest)))
        return out.append_column("sub", pa.array(np.concatenate(sub).astype(np.int32)))

    tasks = F.ceil(F.col("n") / PLACED).cast("int")
    fitted = rows.where(draw & ~F.col("guest")).groupBy(*key).applyInArrow(fit, ", ".join(f"of_{k} int" for k in key) + ", n long, number long, c array<double>")
    fitted = fitted.select(*(f"of_{k}" for k in key), "number", "c", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("to_task"))
    dealt = rows.withColumn("task", F.pmod(F.xxhash64("cls"), tasks).cast("int"))
    grouped = dealt.groupBy(*key, "task").cogroup(fitted.groupBy(*(f"of_{k}" for k in key), "to_task"))
    again = grouped.applyInArrow(place, "cls long, label int, times long, dim int, cell int, v array<double>, guest boolean, sub int")
    return again.unionByName(sized.where(F.col("n") <= large).drop("n").withColumn("sub", F.lit(0)))


def near_embeddings(vectors: DataFrame, least: float = 0.93, sample: int = SAMPLE, block: int = BLOCK, choices: Sequence[int] = CELLS, large: int = LARGE, sending: int = SENDING) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row; links have equal labels and a cosine of at least `least`."""
    ship(vectors.sparkSession)
    scratch = Scratch()
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("v"))
    linkable = is_usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # a zero of either sign is one value
    part = rows.where(linkable).withColumn("v", F.transform(F.col("v").cast("array<double>"), lambda x: x + F.lit(0.0)))
    classes = part.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"))
    classes = scratch.written(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "classes")
    fitted = sample_vectors(classes, "cls", "v", sample)
    # vectors of the label that a vector has on the average
    by_label = classes.groupBy("label").agg(F.count("*").cast("double").alias("n"))
    total = by_label.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n")).first()["n"] or 0.0
    cells = {k: fit_cells(unit(x), least, total, choices, sending) for k, x in fitted.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                x = unit(matrix(own.column(4)))
                c = cells.get(dim, x[:1])
                for at in range(0, len(x), 4096):
                    home, to = guests(x[at : at + 4096], c, least)
                    who, cell = np.nonzero(to)
                    who, cell = np.append(np.arange(len(home)), who) + at, np.append(home, cell)
                    guest = np.arange(len(who)) >= len(home)
                    yield pa.RecordBatch.from_arrays([*(own.column(i).take(pa.array(who)) for i in range(4)), pa.array(cell.astype(np.int32)), pa.array(guest), pa.array(list(x[who]), pa.list_(pa.float64()))], names=["cls", "label", "times", "dim", "cell", "guest", "v"])

    sent = classes.select("cls", "label", "times", "dim", "v").mapInArrow(assign, "cls long, label int, times long, dim int, cell int, guest boolean, v array<double>")
    sent = scratch.written(sent, "cells")
    key = ["label", "dim", "cell"]
    if (again := divided(sent, key, least, large, sample, choices, sending)) is not None:
        sent, key = scratch.written(again, "divided"), [*key, "sub"]
    counts = sent.groupBy(*key).agg(F.count_if(~F.col("guest")).alias("own"), F.count_if("guest").alias("guests"))
    size = F.greatest(F.lit(1), F.least(F.greatest(F.lit(block), F.col("own") / BLOCKS), F.floor(BLOCK_NUMBERS / F.col("dim"))))
    counts = counts.select(*key, F.greatest(F.lit(1), F.ceil(F.col("own") / size)).cast("int").alias("own"), F.ceil(F.col("guests") / size).cast("int").alias("guests"))
    sent = sent.join(counts, key)
    # blocks are numbered from 0 for a cell's own vectors, and on from there for guests
    mine = F.pmod(F.xxhash64("cls", F.lit("block")), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("own"))).cast("int")
    sent = sent.withColumn("mine", F.when(F.col("guest"), F.col("own")).otherwise(F.lit(0)) + mine)
    other = F.when(F.col("guest"), F.sequence(F.lit(0), F.col("own") - 1)).otherwise(F.sequence(F.lit(0), F.col("own") + F.col("guests") - 1))
    sent = sent.select(*key, "cls", "times", "v", "mine", F.explode(other).alias("other"))
    sent = sent.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))

    def links(table: pa.Table) -> pa.Table:
        ids, times, mine = (table.column(n).to_numpy() for n in ("cls", "times", "mine"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        order = np.argsort(ids, kind="stable")
        ids, times, mine, v = ids[order], times[order], mine[order], matrix(table.column("v"))[order]
        a, b = mine == i, mine == j
        xs, ys, edges = compare(v[a], v[b], ids[a], ids[b], times[a], times[b], least, i == j)
        n = xs + ys if i == j else np.append(xs, ys)
        who = ids[a] if i == j else np.append(ids[a], ids[b])
        some = n > 0
        e = np.array(edges, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": np.append(who[some], e[:, 0]), "b": np.append(np.full(some.sum(), -1), e[:, 1]), "n": np.append(n[some], np.zeros(len(e), dtype=np.int64))})

    found = scratch.written(sent.groupBy(*key, "i", "j").applyInArrow(links, "a long, b long, n long"), "links")
    labels = scratch.own(components(found.where("b >= 0").select("a", "b")))
    per = found.where("b < 0").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    named = classes.select("cls", F.col("label").alias("of"), "v", "least", "times").join(per, "cls", "left").join(labels, F.col("cls") == F.col("node"), "left")
    n_links = (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links")
    named = scratch.written(named.select("of", "v", "least", n_links, F.coalesce("label", "cls").alias("root")), "named")
    lowest = scratch.written(named.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    named = written(named.join(lowest, "root").select("of", F.col("v").alias("w"), "n_links", "component_id"), "named")
    scratch.drop()
    keyed = part.join(named, (F.col("label") == F.col("of")) & (F.col("v") == F.col("w"))).select("vec_id", "n_links", "component_id")
    alone = rows.where(~linkable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return keyed.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
