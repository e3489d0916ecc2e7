"""Feature importance: random-forest importance and the loss from shuffling a column.

The forest grows level by level: values become codes (at most ``_BINS`` per feature), rows are laid out by their codes, and
one pass per level returns the sums per open node, feature and code.  Bootstrap weights are hashes of the row number, so
nothing is kept per row and tree.  A shuffle moves codes, not rows: two bytes of address and one of code per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import settings
from plumbline.functions.columns import categorical_columns, nan_to_null, numeric_columns, ref
from plumbline.functions.ordering import ordered_index, stage_table

_ROUNDS = 4
# codes of a feature; rows of a block, whose places fit 16 bits; rows whose codes are sent together
_BINS, _BLOCK, _SENT_ROWS = 32, 1 << 16, 1 << 20
# rows, drawn by hash, whose quantiles are the cuts of features with many values; all rows are split by these cuts
_CUT_ROWS = 32_768
# most numbers in the sums of one pass, and most cells of a table that holds the prediction of every combination of codes
_SUMS, _CELLS = 1 << 23, 1 << 22
# rows of different codes that a pass sends through the trees at once; features shuffled in one job
_WALKED, _SHUFFLED = 2048, 8


def _training(df: DataFrame, target: str, cols: Sequence[str]) -> tuple[DataFrame, bool]:
    """(rows with x and y, whether the target is a class); rows with a gap are left out."""
    is_class = target in categorical_columns(df)
    clean = nan_to_null(df.select(ref(target).alias("_t"), *[ref(c).cast("double").alias(c) for c in cols])).dropna()
    if is_class:
        text = clean.withColumn("_t", F.col("_t").cast("string"))
        clean = StringIndexer(inputCol="_t", outputCol="y").fit(text).transform(text)
    else:
        clean = clean.withColumn("y", F.col("_t").cast("double"))
    return clean.select(F.array(*[ref(c) for c in cols]).alias("x"), "y"), is_class


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def keyed_places(rows: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where each row number 0..n-1 goes under the permutation named by ``key``: Feistel rounds, walked until inside the range.

    Every task can place its own rows; nothing is sorted or exchanged to draw a shuffle.
    """
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, open_ = rows.astype(np.uint64), np.arange(len(rows))
    while len(open_):
        left, right = out[open_] >> np.uint64(half), out[open_] & mask
        for turn in range(_ROUNDS):
            x = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * _ROUNDS + turn) * 0xD1B54A32D192ED03 % (1 << 64))
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x >> np.uint64(32)) & mask)
        out[open_] = left << np.uint64(half) | right
        open_ = open_[out[open_] >= n]
    return out.astype(np.int64)


def _poisson_table() -> np.ndarray:
    """The Poisson(1) count for each 16-bit draw."""
    chances = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(chances, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def bootstrap_weights(rows: np.ndarray, trees: int, seed: int, counts: np.ndarray) -> np.ndarray:
    """How often each tree draws each row number: ``counts`` of 16 bits of a hash of row and tree (four trees per hash)."""
    words = np.arange(-(-trees // 4), dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64((seed * 0x632BE59BD9B4E019 + 1) % (1 << 64))
    drawn = _mixed(_mixed(rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None] + words)
    return counts[drawn.view(np.uint16)][:, :trees]


def _run_sums(w: np.ndarray, targets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over runs of rows: (weight then weighted targets, run, tree)."""
    factors = np.concatenate([np.ones((1, len(w))), targets])
    if len(starts) * 16 > len(w):
        return np.stack([np.add.reduceat(w * f[:, None], starts) for f in factors])
    return np.stack([factors[:, a:b] @ w[a:b] for a, b in zip(starts, [*starts[1:], len(w)])], axis=1)


def _coded(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """A byte per value: how many cuts lie below it."""
    return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """All bytes of a binary column, end to end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray) or not len(column):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    wide = pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]


def _binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose items are ``sizes`` consecutive values each."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes * values.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


@dataclass
class Forest:
    """Trees as flat arrays: a node sends codes up to ``cut`` of ``feature`` to ``left``, others to the node after; -1 is a leaf."""

    cuts: list[np.ndarray]
    trees: int
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    featureImportances: np.ndarray
    is_class: bool

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The node of each row (of codes) in each tree."""
        node = np.broadcast_to(np.arange(self.trees, dtype=np.int32), (len(codes), self.trees)).copy()
        at = np.arange(len(codes))[:, None]
        while True:
            f = self.feature[node]
            if (f < 0).all():
                return node
            node = np.where(f < 0, node, self.left[node] + (codes[at, np.maximum(f, 0)] > self.cut[node])).astype(np.int32)

    def predict(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        for at in range(0, len(codes), _WALKED):
            total = self.value[self.leaves(codes[at:at + _WALKED])].mean(axis=1)
            out[at:at + _WALKED] = total.argmax(axis=1) if self.is_class else total[:, 0]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``p``, the prediction from the vector ``v``."""
        plain = df.withColumn("v", vector_to_array("v"))
        d = len(self.cuts)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = self.predict(_coded(_matrix(batch.column("v"), d), self.cuts))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "p"])

        return plain.mapInArrow(add, T.StructType([*plain.schema.fields, T.StructField("p", T.DoubleType())]))


def _numbered(rows: DataFrame) -> DataFrame:
    return stage_table(ordered_index(rows.withColumn("g", F.lit("r")), "g", ["y", "x"]).drop("g"))


def _cuts(numbered: DataFrame, d: int) -> list[np.ndarray]:
    """At most ``_BINS`` - 1 cuts per feature: all values but the largest where they are few, else quantiles."""
    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * d
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            seen = [s if len(s) > _BINS else np.union1d(s, x[:, j])[:_BINS + 1] for j, s in enumerate(seen)]
        yield pa.RecordBatch.from_pydict({"j": pa.array(range(d), pa.int32()), "values": pa.array(s.tolist() for s in seen)},
                                         schema=pa.schema([("j", pa.int32()), ("values", pa.list_(pa.float64()))]))

    held = {r.j: r.vs for r in numbered.select("x").mapInArrow(few, "j int, values array<double>").groupBy("j").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))), 1, _BINS + 1).alias("vs")).collect()}
    if all(len(held.get(j, [])) <= _BINS for j in range(d)):
        return [np.array(held.get(j, [0.0])[:-1], float) for j in range(d)]
    n = numbered.count()
    drawn = numbered.where(F.pmod(F.xxhash64("idx"), F.lit(n)) < _CUT_ROWS) if n > _CUT_ROWS else numbered
    x = _matrix(drawn.select("x").toArrow().column("x").combine_chunks(), d)
    probs = [k / _BINS for k in range(1, _BINS)]
    return [np.unique(np.quantile(x[:, j], probs)) if len(held[j]) > _BINS else np.array(held[j][:-1]) for j in range(d)]


def _level_sums(coded: DataFrame, forest: Forest, slot: np.ndarray, subset: np.ndarray, classes: int, centre: float, seed: int) -> np.ndarray:
    """Sums per open node: (slot, drawn feature, code, weight then weighted targets), in one pass over the rows."""
    d, trees, m, k = len(forest.cuts), forest.trees, subset.shape[1], max(classes, 1)
    shape = (1 + k, len(subset), m, _BINS)
    piece = max(1, (1 << 16) // (m * _BINS))  # slots summed together

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, waiting, counts = np.zeros((1 + k, len(subset) * m * _BINS)), [], 0, _poisson_table()

        def flush() -> None:
            codes, parts = np.concatenate([c for c, _ in held]), np.concatenate([p for _, p in held], axis=1)
            own = slot[forest.leaves(codes)]
            row, tree = np.nonzero(own >= 0)
            own, parts = own[row, tree], parts[:, row, tree]
            for s in range(m):
                key = (own * m + s) * _BINS + codes[row, subset[own, s]]
                for i in range(1 + k):
                    total[i] += np.bincount(key, weights=parts[i], minlength=total.shape[1])

        for batch in batches:
            codes = _bytes(batch.column("codes")).reshape(-1, d)
            if not len(codes):
                continue
            starts = np.concatenate([[0], np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1])
            w = bootstrap_weights(batch.column("idx").to_numpy(), trees, seed, counts).astype(np.float64)
            y = batch.column("y").to_numpy()
            targets = np.stack([y == c for c in range(classes)] if classes else [y - centre])
            held.append((codes[starts], _run_sums(w, targets, starts)))
            waiting += len(starts)
            if waiting >= _WALKED:
                flush()
                held, waiting = [], 0
        if held:
            flush()
        made = total.reshape(1 + k, len(subset), -1)
        at = list(range(0, len(subset), piece))
        yield pa.RecordBatch.from_pydict({"piece": pa.array(at, pa.int32()), "sums": pa.array(
            [np.ascontiguousarray(made[:, a:a + piece]).tobytes() for a in at], pa.binary())})

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py()) for v in parts.column("sums"))
        return pa.table({"piece": parts.column("piece")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "piece int, sums binary"
    found = coded.select("codes", "idx", "y").mapInArrow(sums, schema).groupBy("piece").applyInArrow(add, schema).collect()
    out = np.zeros(shape)
    for r in found:
        out[:, r.piece:r.piece + piece] = np.frombuffer(r.sums).reshape(1 + k, -1, m, _BINS)
    return out


def _fitted(rows: DataFrame, is_class: bool, trees: int, max_depth: int, seed: int) -> Forest:
    """A random forest: bootstrap rows per tree, a third (classes: the root) of the features per node, largest gain (variance, Gini)."""
    numbered = rows if "idx" in rows.columns else _numbered(rows)
    d = numbered.select(F.size("x").alias("d")).first().d
    cuts = _cuts(numbered, d)
    totals = numbered.agg(F.avg("y").alias("mean"), F.max("y").alias("most")).first()
    classes, centre = (int(totals.most) + 1, 0.0) if is_class else (0, totals.mean)
    k = max(classes, 1)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _coded(_matrix(batch.column("x"), d), cuts)
            yield pa.RecordBatch.from_arrays([_binaries(made, np.full(len(made), d)), batch.column("idx"), batch.column("y")], names=["codes", "idx", "y"])

    coded = stage_table(numbered.select("x", "idx", "y").mapInArrow(code, "codes binary, idx long, y double")
                        .repartitionByRange("codes", "idx").sortWithinPartitions("codes"))
    rng = np.random.default_rng(seed)
    m = min(d, math.ceil(math.sqrt(d)) if is_class else math.ceil(d / 3))
    forest = Forest(cuts, trees, np.full(trees, -1, np.int32), np.zeros(trees, np.int32), np.zeros(trees, np.int32), np.zeros((trees, k)),
                    np.zeros(d), is_class)
    tree_of, weights = np.arange(trees), np.zeros((trees, d))
    open_ = np.arange(trees)
    for _ in range(max(max_depth, 1)):
        born: list[int] = []
        batch = max(1, _SUMS // ((1 + k) * m * _BINS))
        for at in range(0, len(open_), batch):
            nodes = open_[at:at + batch]
            subset = np.argsort(rng.random((len(nodes), d)), axis=1)[:, :m]
            slot = np.full(len(forest.feature), -1, np.int32)
            slot[nodes] = np.arange(len(nodes))
            sums = _level_sums(coded, forest, slot, subset, classes, centre, seed)
            whole = sums[:, :, 0].sum(axis=-1)
            forest.value[nodes] = np.where(whole[:1] > 0, whole[1:] / np.maximum(whole[:1], 1), 0).T + centre
            if max_depth < 1:
                continue
            low = np.cumsum(sums, axis=-1)
            high = whole[:, :, None, None] - low
            inner = [(v[1:] ** 2).sum(axis=0) / np.maximum(v[0], 1) for v in (low, high, whole[:, :, None, None])]
            gain = np.where((low[0] > 0.5) & (high[0] > 0.5), inner[0] + inner[1] - inner[2], 0.0).reshape(len(nodes), -1)
            best = gain.argmax(axis=1)
            for i in np.flatnonzero(gain[np.arange(len(nodes)), best] > 1e-12 * (np.abs(sums[1:]).sum() / (1 + sums[0].sum())) ** 2 * whole[0]):
                node, s, cut = nodes[i], best[i] // _BINS, best[i] % _BINS
                forest.feature[node], forest.cut[node], forest.left[node] = subset[i, s], cut, len(forest.feature)
                weights[tree_of[node], subset[i, s]] += gain[i, best[i]]
                born += [len(forest.feature), len(forest.feature) + 1]
                sides = [v[1:, i, s, cut] / v[0, i, s, cut] + centre for v in (low, high)]
                forest.value = np.concatenate([forest.value, sides])
                for name, fill in (("feature", -1), ("cut", 0), ("left", 0)):
                    setattr(forest, name, np.concatenate([getattr(forest, name), np.full(2, fill, np.int32)]))
                tree_of = np.concatenate([tree_of, np.full(2, tree_of[node])])
        open_ = np.array(born, int)
        if not born:
            break
    each = weights.sum(axis=1, keepdims=True)
    shares = (weights / np.where(each > 0, each, 1)).sum(axis=0)
    forest.featureImportances = shares / shares.sum() if shares.sum() > 0 else shares
    return forest


def _packed(numbered: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Rows as runs of neighbours: (block, place of the first in it, codes feature by feature, targets)."""
    d = len(cuts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            idx, y, codes = batch.column("idx").to_numpy(), batch.column("y").to_numpy(), _coded(_matrix(batch.column("x"), d), cuts)
            starts = np.concatenate([[0], np.flatnonzero((np.diff(idx) != 1) | (idx[1:] % _BLOCK == 0)) + 1, [len(idx)]])
            for a, b in zip(starts, starts[1:]):
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([idx[a] // _BLOCK], pa.int64()), "first": pa.array([idx[a] % _BLOCK], pa.int32()),
                    "codes": pa.array([np.ascontiguousarray(codes[a:b].T).tobytes()], pa.binary()), "y": pa.array([y[a:b].tobytes()], pa.binary())})

    return stage_table(numbered.mapInArrow(pack, "block long, first int, codes binary, y binary"))


def sent_codes(packed: DataFrame, n: int, d: int, features: Sequence[int], repeats: int, seed: int) -> DataFrame:
    """Rows (block, feature, turn, places, codes): the codes that each block of rows receives in each shuffle of each feature."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            codes = np.concatenate([c for _, c in held], axis=1)
            for at in features:
                for turn in range(repeats):
                    key = (seed * 1009 + at) * 1009 + turn
                    places = np.concatenate([keyed_places(i, n, key) for i, _ in held])
                    to = places // _BLOCK
                    order = np.argsort(to.astype(np.uint16) if n <= _BLOCK << 16 else to, kind="stable")
                    to = to[order]
                    starts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1])
                    sizes = np.diff(np.append(starts, len(to)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(to[starts], pa.int64()), pa.array(np.full(len(starts), at, np.int32)), pa.array(np.full(len(starts), turn, np.int32)),
                        _binaries((places[order] % _BLOCK).astype(np.uint16), sizes), _binaries(codes[at][order], sizes)],
                        names=["block", "feature", "turn", "places", "codes"])

        held, n_held = [], 0
        for batch in batches:
            for block, first, codes in zip(batch.column("block").to_pylist(), batch.column("first").to_pylist(), batch.column("codes").to_pylist()):
                made = np.frombuffer(codes, np.uint8).reshape(d, -1)
                held.append((block * _BLOCK + first + np.arange(made.shape[1]), made))
                n_held += made.shape[1]
                if n_held >= _SENT_ROWS:
                    yield from sent(held)
                    held, n_held = [], 0
        if held:
            yield from sent(held)

    return packed.select("block", "first", "codes").mapInArrow(send, "block long, feature int, turn int, places binary, codes binary")


def _losses(packed: DataFrame, n: int, forest: Forest, features: Sequence[int], repeats: int, seed: int) -> dict[tuple[int, int], float]:
    """Wrong rows, or the squared error, for each (feature, turn); (-1, -1) is without a shuffle."""
    d = len(forest.cuts)
    sizes = [len(c) + 1 for c in forest.cuts]
    steps = np.array([math.prod(sizes[j + 1:]) for j in range(d)], object)
    whole = None
    if math.prod(sizes) <= _CELLS:  # the prediction of every combination of codes
        steps = steps.astype(np.int64)
        cells = np.arange(math.prod(sizes))
        whole = forest.predict(np.stack([cells // steps[j] % sizes[j] for j in range(d)], axis=1).astype(np.uint8))
    sent = packed.sparkSession.sparkContext.broadcast(whole)

    def judge(own: pa.Table, other: pa.Table) -> pa.Table:
        known = sent.value
        first, lengths = own.column("first").to_numpy(), [len(v.as_py()) // 8 for v in own.column("y")]
        at = np.concatenate([f + np.arange(m) for f, m in zip(first, lengths)])
        order = np.argsort(at)
        codes = np.concatenate([np.frombuffer(v.as_py(), np.uint8).reshape(d, -1) for v in own.column("codes")], axis=1)[:, order]
        y = np.frombuffer(b"".join(own.column("y").to_pylist()))[order]

        def loss(p: np.ndarray) -> float:
            return float((p != y).sum()) if forest.is_class else float(((p - y) ** 2).sum())

        base = (steps[:, None] * codes).sum(axis=0) if known is not None else None
        found = [(-1, -1, loss(known[base] if known is not None else forest.predict(codes.T)))]
        name = other.column("feature").to_numpy().astype(np.int64) * repeats + other.column("turn").to_numpy()
        for value in np.unique(name):
            f, turn = divmod(int(value), repeats)
            some = other.take(pa.array(np.flatnonzero(name == value)))
            new = np.zeros(len(y), np.uint8)
            new[_bytes(some.column("places")).view(np.uint16)] = _bytes(some.column("codes"))
            if known is not None:
                p = known[base + steps[f] * (new.astype(np.int64) - codes[f])]
            else:
                changed = codes.copy()
                changed[f] = new
                p = forest.predict(changed.T)
            found.append((f, turn, loss(p)))
        return pa.table({k: pa.array(v, t) for k, v, t in zip(("feature", "turn", "loss"), zip(*found), (pa.int32(), pa.int32(), pa.float64()))})

    codes_sent = sent_codes(packed, n, d, features, repeats, seed).withColumnRenamed("block", "to")
    judged = packed.groupBy("block").cogroup(codes_sent.groupBy("to")).applyInArrow(judge, "feature int, turn int, loss double")
    return {(r.feature, r.turn): r.loss for r in judged.groupBy("feature", "turn").agg(F.sum("loss").alias("loss")).collect()}


def forest_importance(df: DataFrame, target: str, cols: Sequence[str] | None = None,
                      trees: int = settings.FOREST_TREES, min_importance: float = settings.MIN_IMPORTANCE,
                      repeats: int = settings.PERMUTATION_REPEATS, max_depth: int = 5, seed: int = settings.SEED) -> DataFrame:
    """Rows (feature, importance, permutation_mean, permutation_std) of at least ``min_importance``, largest first.

    ``permutation_mean`` is the mean drop in accuracy (or R-squared) over ``repeats`` shuffles of the feature's values over
    the rows, ``permutation_std`` its population spread; null without repeats.  Shuffles of several features share a job.
    """
    cols = list(cols) if cols is not None else [c for c in numeric_columns(df) if c != target]
    rows, is_class = _training(df, target, cols)
    numbered = _numbered(rows)
    forest = _fitted(numbered, is_class, trees, max_depth, seed)
    table = [(c, float(w), None, None) for c, w in zip(cols, forest.featureImportances) if w >= min_importance]
    if repeats:
        packed = _packed(numbered, forest.cuts)
        around = numbered.agg(F.count("*").alias("n"), F.var_pop("y").alias("var")).first()
        whole = around.n if is_class else around.var * around.n
        for start in range(0, len(table), _SHUFFLED):
            some = [cols.index(t[0]) for t in table[start:start + _SHUFFLED]]
            lost = _losses(packed, around.n, forest, some, repeats, seed)
            for k, at in enumerate(some, start):
                drops = [(lost[at, turn] - lost[-1, -1]) / whole if whole else math.nan for turn in range(repeats)]
                table[k] = (*table[k][:2], float(np.mean(drops)), float(np.std(drops)))
    table.sort(key=lambda t: -t[1])
    return df.sparkSession.createDataFrame(table, "feature string, importance double, permutation_mean double, permutation_std double")
