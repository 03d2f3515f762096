"""Gradient boosting by distributed histograms: softmax loss for several classes, squared loss for numbers.

Inputs are binned and rows with equal bins become one cell: its weight per label, or its count and sums of the number.
So the fit works on distinct cells and not on rows. For every level of a round's trees, tasks add up gradients and
curvatures of their cells per tree, node, input and bin; Spark sums these histograms and only they reach the driver,
which chooses the splits. Their size depends on the parameters alone. Scores of the cells are stored every few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.session import cut_lineage

STORED_EVERY = 8  # rounds whose trees tasks evaluate anew before the scores are stored


@dataclass(frozen=True)
class Inputs:
    """Bins of each input: bin 0 is NULL, number b holds values up to edge b, or the b-th listed text.

    Values above the last edge share a last bin, as do texts that the fit has not listed.
    """

    names: list[str]
    edges: dict[str, list[float]]
    texts: dict[str, list[str]]

    def bin_of(self, name: str) -> Column:
        value = F.col(name)
        if name in self.texts:
            listed = self.texts[name]
            place = F.array_position(F.array(*[F.lit(v) for v in listed]), value.cast("string"))
            found = F.when(place > 0, place).otherwise(len(listed) + 1)
        else:
            edges = F.array(*[F.lit(float(e)) for e in self.edges[name]])
            found = F.size(F.filter(edges, lambda e: e < value.cast("double"))) + 1
        return F.when(value.isNull(), 0).otherwise(found).cast("int")

    def bins(self) -> Column:
        return F.array(*[self.bin_of(n) for n in self.names])

    def width(self) -> int:
        return 2 + max(len(v) for v in [*self.edges.values(), *self.texts.values()])


def fit_inputs(rows: DataFrame, names: list[str], bins: int) -> Inputs:
    """Bins of the inputs. Numbers with up to ``bins`` different values get one bin each, others ``bins`` quantiles;
    of texts the ``bins`` most frequent are listed."""
    kinds = dict(rows.dtypes)
    texts = [n for n in names if kinds[n] == "string"]
    numbers = [n for n in names if n not in texts]
    listed = {}
    for name in names:
        counts = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        listed[name] = [r[0] for r in counts.orderBy(F.desc("n"), name).limit(bins + 1).collect()]
    wide = [n for n in numbers if len(listed[n]) > bins]
    quantiles = {}
    if wide:
        shares = [(i + 1) / bins for i in range(bins)]
        found = rows.agg(*[F.percentile_approx(F.col(n).cast("double"), shares, 10_000).alias(n) for n in wide]).first()
        quantiles = {n: sorted(set(found[n])) for n in wide}
    edges = {n: quantiles.get(n, sorted(float(v) for v in listed[n])) for n in numbers}
    return Inputs(names, edges, {n: listed[n][:bins] for n in texts})


@dataclass
class Tree:
    """Nodes in heap order: ``feature`` is -1 for a leaf; ``left[node]`` marks the bins that go left."""

    output: int  # the label it belongs to
    feature: np.ndarray
    left: np.ndarray
    value: np.ndarray
    share: np.ndarray  # of the cells, by hash, that the tree has learned from: [first, last)

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[node]
            inner = f >= 0
            goes_left = self.left[node, bins[np.arange(len(bins)), np.maximum(f, 0)]]
            node = np.where(inner, 2 * node + np.where(goes_left, 1, 2), node)
        return node

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.node_of(bins)]


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Boosted:
    """Rounds of trees; ``losses``: mean training loss before each round and at the end."""

    inputs: Inputs
    start: list[float]  # score of every output before the first round
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def _scored(self, rows: DataFrame, drop: list[str], added: str, finish) -> DataFrame:
        trees, start, inputs = [t for r in self.rounds for t in r], np.array(self.start), len(self.inputs.names)
        each = len(self.rounds[0]) // len(start) if self.rounds else 1

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = _lists(batch.column("_bins"), inputs)
                scores = np.tile(start, (len(bins), 1))
                for tree in trees:
                    scores[:, tree.output] += tree(bins) / each
                more = finish(scores)
                names = [n for n in batch.schema.names if n != "_bins"]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *more.values()], [*names, *more])

        given = rows.drop(*drop)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
        return given.withColumn("_bins", self.inputs.bins()).mapInArrow(score, f"{schema}, {added}")


@dataclass
class BoostedClassifier(Boosted):
    labels: list[str] = field(default_factory=list)

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``probability``, one number per label in the order of ``labels``, and ``predicted_label``.

        Unseen texts and NULL have bins of their own; equal probabilities go to the first label.
        """
        names = self.labels

        def finish(scores: np.ndarray) -> dict[str, pa.Array]:
            p = softmax(scores)
            ends = pa.array(np.arange(0, p.size + 1, len(names)), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(p.ravel()))
            return {"probability": lists, "predicted_label": pa.array(names).take(pa.array(p.argmax(axis=1)))}

        return self._scored(
            rows, ["probability", "predicted_label"], "probability array<double>, predicted_label string", finish
        )


@dataclass
class BoostedRegressor(Boosted):
    def predict(self, rows: DataFrame, output: str = "prediction") -> DataFrame:
        """``rows`` with the predicted number."""
        return self._scored(rows, [output], f"{output} double", lambda scores: {output: pa.array(scores[:, 0])})


def _best_split(g: np.ndarray, h: np.ndarray, is_text: bool, penalty: float, least: float) -> tuple[float, np.ndarray]:
    """(gain, bins that go left) of one input's histogram; a gain of 0 is no split.

    Bins of texts are ordered by their mean gradient, bins of numbers as they are; bins without weight go right.
    """
    used = np.flatnonzero(h > 0)
    if len(used) < 2:
        return 0.0, np.zeros(len(g), bool)
    order = used[np.lexsort((used, np.round(g[used] / h[used], 12)))] if is_text else used
    gl, hl = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
    gr, hr = g[used].sum() - gl, h[used].sum() - hl
    whole = (gl[0] + gr[0]) ** 2 / (hl[0] + hr[0] + penalty)
    gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - whole
    gain[(hl < least) | (hr < least)] = 0.0
    gain = np.round(gain, 9)  # sums of tasks may differ in their last places
    best = int(gain.argmax())
    left = np.zeros(len(g), bool)
    left[order[: best + 1]] = True
    return float(max(gain[best], 0.0)), left


def _softmax_parts(w: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    q, total = softmax(score)[:, k], w.sum(axis=1)
    return total * q - w[:, k], total * q * (1 - q)


def _softmax_loss(w: np.ndarray, score: np.ndarray) -> tuple[float, float]:
    return float(-(w * np.log(np.maximum(softmax(score), 1e-300))).sum()), float(w.sum())


def _square_parts(w: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return w[:, 0] * score[:, 0] - w[:, 1], w[:, 0]


def _square_loss(w: np.ndarray, score: np.ndarray) -> tuple[float, float]:
    s = score[:, 0]
    return float((w[:, 2] - 2 * s * w[:, 1] + w[:, 0] * s * s).sum()), float(w[:, 0].sum())


@dataclass(frozen=True)
class Shape:
    """Parameters of a fit: ``rate`` scales a leaf, ``penalty`` is added to its curvature, ``least`` is the curvature a
    side of a split must have; with several parallel trees each learns from the share ``sample`` of the cells, by hash."""

    rounds: int
    trees: int
    depth: int
    rate: float
    penalty: float
    least: float
    sample: float


def _boost(cells: DataFrame, model: Boosted, shape: Shape, parts, loss) -> None:
    """Add ``shape.rounds`` rounds to ``model``, fitted on ``cells`` (bins, w)."""
    outputs, trees, width, n_inputs = len(model.start), shape.trees, model.inputs.width(), len(model.inputs.names)
    held = cells.select(F.size("w")).first()
    if held is None:
        return
    n_w, context = held[0], cells.sparkSession.sparkContext
    start = F.array(*[F.lit(float(x)) for x in model.start])
    cells = cells.withColumns({"u": F.pmod(F.xxhash64("bins"), F.lit(1 << 20)) / (1 << 20), "score": start})
    # a few MB of cells would be one task; by "u", as rows that lie by "bins" already would stay as they are
    cells = cut_lineage(cells.repartition(context.defaultParallelism, "u"))
    texts = [n in model.inputs.texts for n in model.inputs.names]
    pending: list[Tree] = []

    def moved(b: np.ndarray, score: np.ndarray, new: list[Tree]) -> np.ndarray:
        score = score.copy()
        for tree in new:
            score[:, tree.output] += tree(b) / trees
        return score

    def histograms(growing: list[Tree], level: int) -> tuple[np.ndarray, tuple[float, float]]:
        """((tree, node of the level, input, bin, 2) sums of gradients and curvatures, loss and weight) of all cells."""
        first, nodes = (1 << level) - 1, 1 << level
        grid = (len(growing), nodes, n_inputs, width)
        sent = context.broadcast((growing, pending))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, lost = np.zeros((2, int(np.prod(grid)))), np.zeros(2)
            for batch in batches:
                b, w = _lists(batch.column("bins"), n_inputs), _lists(batch.column("w"), n_w)
                s = moved(b, _lists(batch.column("score"), outputs), sent.value[1])
                u = batch.column("u").to_numpy()
                lost += loss(w, s)
                for i, tree in enumerate(sent.value[0]):
                    node, (low, high) = tree.node_of(b) - first, tree.share
                    # a share may pass the end of the circle
                    rows = np.flatnonzero((node >= 0) & ((high - low >= 1) | (((u - low) % 1.0) < high - low)))
                    g, h = parts(w[rows], s[rows], tree.output)
                    # leaves of the last level need their sums only, which any one input has
                    for f in range(1 if level == shape.depth else n_inputs):
                        base, cells_of = (i * nodes * n_inputs) * width, (node[rows] * n_inputs + f) * width + b[rows, f]
                        size = nodes * n_inputs * width
                        sums[0, base : base + size] += np.bincount(cells_of, g, size)
                        sums[1, base : base + size] += np.bincount(cells_of, h, size)
            some = np.flatnonzero(sums.any(axis=0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(some, -1)), *[pa.array(np.append(sums[i, some], lost[i])) for i in (0, 1)]], ["at", "g", "h"]
            )

        found = cells.mapInArrow(add, "at long, g double, h double").groupBy("at").agg(F.sum("g"), F.sum("h")).toArrow()
        at, g, h = (found.column(i).to_numpy() for i in range(3))
        out = np.zeros((int(np.prod(grid)), 2))
        out[at[at >= 0]] = np.column_stack([g, h])[at >= 0]
        return out.reshape(*grid, 2), (g[at < 0].sum(), h[at < 0].sum())

    def grow(number: int) -> list[Tree]:
        size = (1 << (shape.depth + 1)) - 1
        growing = []
        for i in range(trees):
            low = (0.37 * (number * trees + i)) % 1.0
            share = np.array([low, low + shape.sample] if trees > 1 and shape.sample < 1 else [0.0, 1.0])
            for y in range(outputs):
                growing.append(Tree(y, np.full(size, -1), np.zeros((size, width), bool), np.zeros(size), share))
        for level in range(shape.depth + 1):
            sums, lost = histograms(growing, level)
            if level == 0:
                model.losses.append(lost[0] / lost[1] if lost[1] else 0.0)
            going = False
            for i, tree in enumerate(growing):
                for j in range(1 << level):
                    node = (1 << level) - 1 + j
                    g, h = sums[i, j, 0].sum(axis=0)
                    if h <= 0:
                        continue
                    tree.value[node] = -shape.rate * g / (h + shape.penalty)
                    if level == shape.depth:
                        continue
                    tried = [_best_split(*sums[i, j, f].T, texts[f], shape.penalty, shape.least) for f in range(n_inputs)]
                    best = int(np.argmax([t[0] for t in tried]))
                    if tried[best][0] > 0:
                        tree.feature[node], tree.left[node] = best, tried[best][1]
                        going = True
            if not going:
                break
        return growing

    def after(new: list[Tree]) -> DataFrame:
        sent = context.broadcast(new)

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = _lists(batch.column("bins"), n_inputs)
                s = moved(b, _lists(batch.column("score"), outputs), sent.value)
                ends = pa.array(np.arange(0, s.size + 1, outputs), pa.int32())
                kept = [batch.column(c) for c in ("bins", "w", "u")]
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(ends, pa.array(s.ravel()))], ["bins", "w", "u", "score"])

        return cut_lineage(cells.mapInArrow(move, "bins array<int>, w array<double>, u double, score array<double>"))

    for number in range(shape.rounds):
        new = grow(number)
        model.rounds.append(new)
        pending.extend(new)
        if len(model.rounds) % STORED_EVERY == 0:
            cells = after(pending)
            pending.clear()
    _, lost = histograms([], 0) if shape.rounds else (None, (0.0, 0.0))
    model.losses.append(lost[0] / lost[1] if lost[1] else 0.0)


def fit_boosted(
    rows: DataFrame, names: list[str], rounds: int = 20, trees: int = 4, depth: int = 6, rate: float = 0.3,
    penalty: float = 1.0, least: float = 1.0, sample: float = 0.8, bins: int = 64, label: str = "label", weight: str = "weight",
) -> BoostedClassifier:
    """Boosted trees for the labels of ``rows``: per round and label ``trees`` parallel ones whose mean is added.

    See :class:`Shape` for the parameters. Rows with a NULL label and those without weight are ignored; no rows
    give a model without labels.
    """
    inputs = fit_inputs(rows, names, bins)
    known = rows.where(F.col(label).isNotNull())
    labels = [r[0] for r in known.select(label).distinct().orderBy(label).collect()]
    model = BoostedClassifier(inputs, [0.0] * len(labels), labels=labels)
    if labels:
        per_label = [F.sum(F.when(F.col(label) == y, F.col(weight)).otherwise(0.0)).cast("double") for y in labels]
        cells = known.groupBy(inputs.bins().alias("bins")).agg(F.array(*per_label).alias("w"))
        _boost(cells, model, Shape(rounds, trees, depth, rate, penalty, least, sample), _softmax_parts, _softmax_loss)
    return model


def fit_boosted_regression(
    rows: DataFrame, names: list[str], label: str, rounds: int = 30, trees: int = 1, depth: int = 4, rate: float = 0.3,
    penalty: float = 1.0, least: float = 1.0, sample: float = 0.8, bins: int = 64,
) -> BoostedRegressor:
    """Boosted trees for a number, from its mean on. Rows with a NULL number are ignored; no rows give 0."""
    inputs = fit_inputs(rows, names, bins)
    y = F.col(label).cast("double")
    known = rows.where(y.isNotNull())
    cells = known.groupBy(inputs.bins().alias("bins")).agg(
        F.array(F.count(F.lit(1)).cast("double"), F.sum(y), F.sum(y * y)).alias("w")
    )
    cells = cut_lineage(cells)
    total = cells.agg(F.sum(F.col("w")[1]) / F.sum(F.col("w")[0])).first()[0]
    model = BoostedRegressor(inputs, [total or 0.0])
    if total is not None:
        _boost(cells, model, Shape(rounds, trees, depth, rate, penalty, least, sample), _square_parts, _square_loss)
    return model
