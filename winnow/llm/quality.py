"""Quality of documents by a generalised additive model with pairwise interactions (operator 12).

Each text has measures of its size, letters, marks, words and lines. Shallow trees,
boosted one measure at a time in turn, fit the labels; as every tree looks at one
measure, their sum is a lookup table over that measure's bins. Pairs of measures with
most left to explain get tables of their own in the same way, from trees that cut
either measure once. A score is the logistic of the intercept and one cell of each
table, looked up for many texts at a time.

The model is fitted on the driver to at most `sample` labelled rows, drawn by a hash of
doc_id; texts are read and measured once, and scored whole.

Cases: a null text is measured as empty, and scored. Null doc_ids are held out and
scored; repeated ones are scored row by row. Labels without a doc_id or quality don't
count; if `labels` repeats a doc_id, one good row makes it good. Rows equal in doc_id
and measures are learnt from once. Without labelled rows all scores are 0.5; with
labels of one value the score is near it. An empty table gives an empty result. Other
columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.language import held_out_id
from winnow.llm.shared import ship, written

#: Labelled rows, at most, that the model is fitted to.
SAMPLE = 30_000
GOOD_FROM = 0.3
BINS = 48
#: Bins of each measure in a table of two.
PAIR_BINS = 12
PAIRS = 8
RATE = 0.15
ROUNDS = 150
#: Rounds without a better held-back loss, after which boosting ends.
PATIENCE = 15
LEAVES = 4
LEAST_IN_LEAF = 10
#: Models on other splits of the sample, whose tables are averaged.
BAGS = 3
_KEEP = 1.0  # added to second derivatives

MEASURES = (
    "bytes words word_bytes longest_word spread distinct top_word lines distinct_lines longest_line upper digits high marks commas stops "
    "shouts bars hashes brackets capitalised plain_words odd_ends entropy repeated twice_running"
).split()
#: All but ASCII becomes a letter.
_LETTERED = bytes(c if c < 128 else 97 for c in range(256))
_FINE_ENDS = bytes(c for c in range(128) if chr(c).isalnum() or chr(c) in ".,;:!?)\"'")
_CAPITALS = bytes(range(65, 91))
_LETTER_OR_HIGH = np.array([chr(c).isalpha() or c >= 128 for c in range(256)])
_MARK = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])


def measures(text: bytes) -> list[float]:
    """MEASURES of a whole text in UTF-8; 0 where there is nothing to measure."""
    n = len(text)
    if not n:
        return [0.0] * len(MEASURES)
    codes = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(codes[_LETTER_OR_HIGH].sum()))
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    times = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    here = codes[codes > 0] / n
    after = words[1:]
    lettered = text.translate(_LETTERED).split()
    firsts, ends = bytes(map(itemgetter(0), lettered)), bytes(map(itemgetter(-1), lettered))
    share = lambda chars: int(codes[list(chars)].sum()) / n
    return [
        np.log1p(n),
        np.log1p(len(words)),
        float(sizes.mean()),
        np.log1p(float(sizes.max())),
        float(sizes.std()),
        len(times) / w,
        max(times.values(), default=0) / w,
        np.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(max(map(len, lines), default=0)),
        int(codes[65:91].sum()) / letters,
        int(codes[48:58].sum()) / n,
        int(codes[128:].sum()) / n,
        int(codes[_MARK].sum()) / n,
        share(b",;:"),
        share(b"."),
        share(b"!?"),
        share(b"|/\\_~^"),
        share(b"#$%&*@+=<>"),
        share(b"()[]{}"),
        (len(firsts) - len(firsts.translate(None, _CAPITALS))) / w,
        sum(map(bytes.isalpha, lettered)) / w,
        len(ends.translate(None, _FINE_ENDS)) / w,
        float(-(here * np.log2(here)).sum()),
        1 - len(set(zip(words, after, strict=False))) / max(1, len(after)),
        sum(map(eq, words, after)) / max(1, len(after)),
    ]


@dataclass
class Model:
    """An intercept, a table over the bins of each measure, and tables over two measures'."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities that the rows of measures are labelled good."""
        out = np.full(len(x), self.intercept)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, i], side="right")]
        wide = {k: np.searchsorted(self.pair_edges[k], x[:, k], side="right") for i, j, _ in self.pairs for k in (i, j)}
        for i, j, table in self.pairs:
            out += table[wide[i], wide[j]]
        return 1 / (1 + np.exp(-out))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Between which values of a measure the bins change: quantiles, and each value if there are few."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1), method="higher")[1:-1])
        return values
    return (values[1:] + values[:-1]) / 2


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + _KEEP)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Steps for each bin of one measure: a tree of LEAVES leaves at most, grown where it gains most."""
    cg, ch, cn = (np.concatenate([[0.0], np.cumsum(v)]) for v in (g, h, n))

    def cut(a: int, b: int) -> tuple[float, int]:
        at = np.arange(a + 1, b)
        if not len(at):
            return 0.0, a
        gains = _gain(cg[at] - cg[a], ch[at] - ch[a]) + _gain(cg[b] - cg[at], ch[b] - ch[at]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
        gains[(cn[at] - cn[a] < LEAST_IN_LEAF) | (cn[b] - cn[at] < LEAST_IN_LEAF)] = 0
        best = int(np.argmax(gains))
        return float(gains[best]), int(at[best])

    leaves = [(0, len(g), *cut(0, len(g)))]
    while len(leaves) < LEAVES:
        best = max(range(len(leaves)), key=lambda i: leaves[i][2])
        a, b, gain, at = leaves[best]
        if gain <= 1e-9:
            break
        leaves[best : best + 1] = [(a, at, *cut(a, at)), (at, b, *cut(at, b))]
    out = np.zeros(len(g))
    for a, b, _, _ in leaves:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + _KEEP)
    return out


def _quadrants(v: np.ndarray) -> list[np.ndarray]:
    """Sums of a table below and above each cut of either measure."""
    c = v.cumsum(axis=0).cumsum(axis=1)
    low, left, top, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
    return [low, left - low, top - low, all_ - left - top + low]


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """How much the best cut of both measures gains over none, and where it is."""
    if 1 in g.shape:
        return 0.0, 0, 0
    gains = sum(_gain(a, b) for a, b in zip(_quadrants(g), _quadrants(h), strict=True)) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gains))
    i, j = np.unravel_index(at, gains.shape)
    return float(gains.flat[at]), int(i), int(j)


def _square(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Steps for each cell of two measures: one leaf for each quadrant of the best cut."""
    out = np.zeros(g.shape)
    _, i, j = _best_cut(g, h)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for columns in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, columns] = -g[rows, columns].sum() / (h[rows, columns].sum() + _KEEP)
    return out


class _Boosting:
    """The logits of a split of the sample, and how one table after another is boosted on it."""

    def __init__(self, y: np.ndarray, held_back: np.ndarray, intercept: float):
        self.y, self.fit, self.back = y, ~held_back, held_back
        self.logit = np.full(len(y), intercept)

    def slopes(self) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-self.logit))
        return (p - self.y) * self.fit, p * (1 - p) * self.fit

    def loss(self) -> float:
        z = self.logit[self.back]
        return float(np.mean(np.logaddexp(0, z) - z * self.y[self.back])) if len(z) else 0.0

    def run(self, cells: list[np.ndarray], shapes: list[tuple[int, ...]], step) -> list[np.ndarray]:
        """Tables for the cells of each term, in turns of one step each, as they were at the least held-back loss."""
        tables = [np.zeros(s) for s in shapes]
        best, kept, since = self.loss(), [t.copy() for t in tables], 0
        counts = [np.bincount(c, weights=self.fit, minlength=t.size) for c, t in zip(cells, tables, strict=True)]
        for _ in range(ROUNDS):
            for c, t, n in zip(cells, tables, counts, strict=True):
                g, h = self.slopes()
                g, h = (np.bincount(c, weights=v, minlength=t.size).reshape(t.shape) for v in (g, h))
                move = RATE * step(g, h, n)
                t += move
                self.logit += move.ravel()[c]
            now, since = self.loss(), since + 1
            if now < best - 1e-6:
                best, kept, since = now, [t.copy() for t in tables], 0
            elif since >= PATIENCE:
                break
        for c, t, k in zip(cells, tables, kept, strict=True):
            self.logit += (k - t).ravel()[c]
        return kept


def fit(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Model:
    """A model of labels (0 or 1) by rows of measures; the order of the rows matters only for the splits."""
    if not len(y):
        return Model()
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(rate / (1 - rate))))
    if y.min() == y.max():
        return model
    k = x.shape[1]
    model.edges, model.pair_edges = ([_edges(x[:, i], bins) for i in range(k)] for bins in (BINS, PAIR_BINS))
    bins, wide = ([np.searchsorted(e[i], x[:, i], side="right") for i in range(k)] for e in (model.edges, model.pair_edges))
    sizes = [len(e) + 1 for e in model.pair_edges]
    draw = np.random.default_rng(seed).permutation(len(y))
    bags = [_Boosting(y, draw % (BAGS + 3) == b, model.intercept) for b in range(BAGS)]
    shapes = [(len(e) + 1,) for e in model.edges]
    each = [b.run(bins, shapes, _tree) for b in bags]
    model.tables = [np.mean(t, axis=0) for t in zip(*each, strict=True)]
    # where the mean of the bags leaves most to explain
    whole = _Boosting(y, np.zeros(len(y), dtype=bool), model.intercept)
    whole.logit += sum(t[c] for t, c in zip(model.tables, bins, strict=True))
    g, h = whole.slopes()
    gains = []
    for i in range(k):
        for j in range(i + 1, k):
            cell, shape = wide[i] * sizes[j] + wide[j], (sizes[i], sizes[j])
            gh = [np.bincount(cell, weights=v, minlength=shape[0] * shape[1]).reshape(shape) for v in (g, h)]
            gains.append((-_best_cut(*gh)[0], i, j))
    chosen = [(i, j) for gain, i, j in sorted(gains)[:PAIRS] if gain < 0]
    cells = [wide[i] * sizes[j] + wide[j] for i, j in chosen]
    each = [b.run(cells, [(sizes[i], sizes[j]) for i, j in chosen], lambda g, h, n: _square(g, h)) for b in bags]
    model.pairs = [(i, j, np.mean(t, axis=0)) for (i, j), t in zip(chosen, zip(*each, strict=True), strict=True)]
    return model


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each text, as an array of floats."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measures(x.as_py()) for x in batch.column(1)], dtype=np.float32).reshape(-1, len(MEASURES))
            lists = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(MEASURES), dtype=np.int32), rows.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "measures"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select("doc_id", text.alias("text")).mapInArrow(run, f"doc_id {kind}, measures array<float>")


def labelled(rows: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """measures and good of at most `sample` labelled rows outside the held-out fold."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out_id(folds)).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"))
    share = min(1.0, 1.5 * sample / max(1, known.count()))  # at least the sample, but for labels without documents
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))
    drawn = rows.where(draw < share * (1 << 30)).join(known.where(draw < share * (1 << 30)), "doc_id").dropDuplicates(["doc_id", "measures"])
    return drawn.withColumn("draw", draw).orderBy("draw", "doc_id", "measures").limit(sample).select("measures", "good")


def scored(rows: DataFrame, model: Model, good_from: float = GOOD_FROM) -> DataFrame:
    """doc_id, score and predicted, for rows of `measured`."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES)).astype(np.float64)
            score = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= good_from).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.select("doc_id", "measures").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def learn(rows: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> Model:
    """The model of the labelled rows outside the held-out fold."""
    own = labelled(rows, labels, folds, sample).toArrow()
    x = own["measures"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES)).astype(np.float64)
    return fit(x, own["good"].to_numpy().astype(np.float64))


def predict_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    rows = written(measured(docs), "measures")
    model = learn(rows, labels, folds, sample)
    return scored(rows, model).select("doc_id", held_out_id(folds).alias("held_out"), "score", "predicted")
