"""Near-duplicate vectors by product quantisation: coarse lists, residual codes, table-lookup distances, exact rerank.

A bounded sample fits the coarse centres and the codebooks; every vector is
indexed.  A vector lies in the list of its nearest centre, coded by its
residual in SUBSPACES parts.  It asks every list that can hold a neighbour, by
the plane half-way between two centres and the list's radius; no other list
can.  Distances to the codes come from lookup tables; since each code's own
error is stored, a candidate is dropped only if the true distance cannot reach
the threshold.  The cosine of what remains is computed in double precision and
decides, so the links are those of a comparison of all pairs.

Equal vectors are one entry.  Lists are laid end to end, near ones together,
and cut into blocks of bounded size.  A pair of vectors is handled in the one
tile of its two blocks, so link counts are exact sums; a tile returns counts
and a spanning forest, and never holds the pairs of more than one step.

Defined results: null or zero vectors, those with null or non-finite
components, and rows with a null vec_id link with nothing; vectors of different length are not comparable.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordering import stage_table
from plumbline.llm.components import components, lowest_members
from plumbline.llm.sizing import hot_join

THRESHOLD = 0.9
SAMPLE = 20_000        # vectors, in hash order, that centres and codebooks are fitted on
MOST_LISTS = 4096
SUBSPACES, CODES = 16, 256
TILE = 16_384          # most vectors of a block
_TILE_VALUES = 1 << 21 # most components of a block
_BLOCKS = 12           # a small table is cut into this many blocks
_ENTRIES, _ASKERS = 1024, 512  # vectors of a tile that are compared in one step
_ROUNDS = 12
_REACH = (2 - 2 * THRESHOLD) ** 0.5


@dataclass
class Index:
    centres: np.ndarray
    books: list[np.ndarray]
    parts: list[np.ndarray]

    def codes(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code per subspace, and the length of what the codes leave out."""
        code = np.empty((len(residuals), len(self.parts)), np.uint8)
        lost = np.zeros(len(residuals))
        for m, (part, book) in enumerate(zip(self.parts, self.books)):
            d = _squares(residuals[:, part], book)
            code[:, m] = d.argmin(1)
            lost += ((residuals[:, part] - book[code[:, m]]) ** 2).sum(1)
        return code, np.sqrt(lost)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :], 0)


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = _ROUNDS) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_squares(x[a: a + 4096], centres).argmin(1) for a in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, n: int) -> Index:
    """Centres (about the square root of the ``n`` vectors to index) and residual codebooks from unit vectors."""
    rng = np.random.default_rng(0)
    centres = _centres(sample, int(min(MOST_LISTS, max(1, round(n ** 0.5)))), rng)
    near = np.concatenate([_squares(sample[a: a + 4096], centres).argmin(1) for a in range(0, len(sample), 4096)])
    residual = sample - centres[near]
    parts = [p for p in np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1])) if len(p)]
    return Index(centres, [_centres(residual[:, p], CODES, rng, 6) for p in parts], parts)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(batch.num_rows, -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass
class Layout:
    """Lists end to end, cut into blocks: where each list starts, its vectors and radius; a block has ``size`` vectors on average."""

    start: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    size: int

    def block(self, home: np.ndarray, spread: np.ndarray) -> np.ndarray:
        return (self.start[home] + spread % self.count[home]) // self.size

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """List and block of every part of a list, by block."""
        lists = np.flatnonzero(self.count)
        lists = lists[np.argsort(self.start[lists])]
        first, last = self.start[lists] // self.size, (self.start[lists] + self.count[lists] - 1) // self.size
        parts = last - first + 1
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.repeat(lists, parts), np.repeat(first, parts) + within


def lay_out(centres: np.ndarray, count: np.ndarray, radius: np.ndarray, most: int) -> Layout:
    """Each list is followed by the nearest one that is left."""
    order, left, at = [], np.ones(len(centres), bool), 0
    for _ in range(len(centres)):
        order.append(at)
        left[at] = False
        at = int(np.where(left, ((centres - centres[at]) ** 2).sum(1), np.inf).argmin())
    start = np.zeros(len(centres), np.int64)
    start[order] = np.cumsum(count[order]) - count[order]
    n = int(count.sum())
    return Layout(start, count, radius, -(-n // max(min(_BLOCKS, n), -(-n // most))))


def _reachable(x: np.ndarray, centres: np.ndarray, home: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Lists (columns) that can hold a vector within the threshold's distance of each row of ``x``.

    A vector of list j is no farther from centre j than from the row's own centre, so it lies beyond the plane
    half-way between them; and it is no farther from centre j than the list's radius.
    """
    d = _squares(x, centres)
    own = np.take_along_axis(d, home[:, None], 1)
    apart = np.sqrt(_squares(centres[home], centres))
    return (d - own <= 2 * _REACH * apart + 1e-6) & (np.sqrt(d) <= radius + _REACH + 1e-6)


def _place(sent):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value[0]
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                home, gap = [], []
                for a in range(0, len(x), 1024):
                    d = _squares(x[a: a + 1024], centres)
                    home.append(d.argmin(1))
                    gap.append(np.sqrt(d.min(1)))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_id"), "v": batch.column("v"), "copies": batch.column("copies"),
                    "home": pa.array(np.concatenate(home).astype(np.int32)), "gap": pa.array(np.concatenate(gap))})

    return step


def _ask(sent, told):
    """The block of each vector and the blocks, up to its own, that it has to ask."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value[0]
        layout = Layout(*told.value)
        lists, blocks = layout.held()
        named, first = np.unique(blocks, return_index=True)
        for batch in batches:
            if batch.num_rows:
                x, home = _matrix(batch), batch.column("home").to_numpy()
                own = layout.block(home, batch.column("spread").to_numpy())
                asks = []
                for a in range(0, len(x), 512):
                    can = _reachable(x[a: a + 512], centres, home[a: a + 512], layout.radius)
                    can = np.logical_or.reduceat(can[:, lists], first, axis=1) & (named[None, :] < own[a: a + 512, None])
                    asks += [named[c].astype(np.int32) for c in can]
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_id"), "v": batch.column("v"), "copies": batch.column("copies"), "home": batch.column("home"),
                    "block": pa.array(own.astype(np.int32)), "asks": pa.array(asks, pa.list_(pa.int32()))})

    return step


def _linked(x: np.ndarray, q: np.ndarray, e: np.ndarray, dense: np.ndarray | None) -> np.ndarray:
    """Whether the cosine of rows q and e reaches the threshold; ``dense`` has the cosines up to rounding, if they are there."""
    if dense is not None:
        out = dense >= THRESHOLD
        ask = np.flatnonzero(np.abs(dense - THRESHOLD) < 1e-12)
    else:
        out = np.zeros(len(q), bool)
        ask = np.arange(len(q))
    for a in range(0, len(ask), 16_384):
        i = ask[a: a + 16_384]
        out[i] = (x[q[i]] * x[e[i]]).sum(1) >= THRESHOLD
    return out


def _tile(sent):
    def step(key: tuple, rows: pa.Table) -> pa.Table:
        index = Index(*sent.value)
        rows = rows.sort_by("vec_id").combine_chunks()
        x = _matrix(pa.RecordBatch.from_arrays([rows.column("v").combine_chunks()], ["v"]))
        ids, copies, home = (rows.column(c).to_numpy() for c in ("vec_id", "copies", "home"))
        is_entry = rows.column("entry").to_numpy(zero_copy_only=False)
        entry = np.flatnonzero(is_entry)
        within = key[0].as_py() == key[1].as_py()  # the tile of a block with itself
        asker = entry if within else np.flatnonzero(~is_entry)
        links, low = np.zeros(len(ids)), np.arange(len(ids))
        lists, list_of = np.unique(home[entry], return_inverse=True)
        code, lost = index.codes(x[entry] - index.centres[home[entry]])
        coded = index.centres[home[entry]]
        for m, (part, book) in enumerate(zip(index.parts, index.books)):
            coded[:, part] += book[code[:, m]]
        # |x - coded| <= reach + lost, as a bound on the product of the two; tables are in single precision
        least = ((1 + (coded * coded).sum(1) - (_REACH + lost) ** 2) / 2 - 1e-4).astype(np.float32)
        del coded
        for a in range(0, len(asker), _ASKERS):
            ask = asker[a: a + _ASKERS]
            to_list = (index.centres[lists] @ x[ask].T).astype(np.float32)
            tables = [(book @ x[ask][:, part].T).astype(np.float32) for part, book in zip(index.parts, index.books)]
            for b in range(0, len(entry), _ENTRIES):
                if within and entry[b] > ask[-1]:
                    break
                some = slice(b, b + _ENTRIES)
                product = to_list[list_of[some]]
                for m, table in enumerate(tables):
                    product += table[code[some, m]]
                e, q = np.nonzero(product >= least[some, None])
                fits = ids[ask[q]] > ids[entry[some][e]] if within else ids[ask[q]] != ids[entry[some][e]]  # in a block a pair counts from its larger id
                e, q = e[fits], q[fits]
                if not len(q):
                    continue
                dense = (x[entry[some]] @ x[ask].T)[e, q] if 16 * len(q) > product.size else None
                e, q = entry[some][e], ask[q]
                exact = _linked(x, q, e, dense)
                e, q = e[exact], q[exact]
                links += np.bincount(q, copies[e], len(ids)) + np.bincount(e, copies[q], len(ids))
                one, two = low[q], low[e]
                new = one != two
                if new.any():
                    low = lowest_members(len(ids), one[new], two[new])[low]
        used = np.flatnonzero(links)
        return pa.table({"vec_id": pa.array(ids[used]), "links": pa.array(links[used].astype(np.int64)), "root": pa.array(ids[low[used]])})

    return step


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("v"))
    rows = rows.withColumn("usable", F.coalesce(_usable(F.col("v")) & F.col("vec_id").isNotNull(), F.lit(False)))
    keyed = rows.where("usable").withColumn("key", F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))
    classes = stage_table(keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")))
    found = None
    for r in classes.groupBy(F.size("v").alias("dim")).count().collect():  # one row per vector length
        own = classes.where(F.size("v") == r.dim).select(F.col("rep").alias("vec_id"), "v", "copies")
        sample = own.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        index = fit(_matrix(sample.combine_chunks().to_batches()[0]), r["count"])
        sent = spark.sparkContext.broadcast((index.centres, index.books, index.parts))  # plain arrays; at most MOST_LISTS centres
        placed = stage_table(own.mapInArrow(_place(sent), f"vec_id long, v {kind}, copies long, home int, gap double"))
        count, radius = np.zeros(len(index.centres), np.int64), np.zeros(len(index.centres))
        for s in placed.groupBy("home").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).collect():  # at most MOST_LISTS rows
            count[s.home], radius[s.home] = s.n, s.gap
        layout = lay_out(index.centres, count, radius, max(1, min(TILE, _TILE_VALUES // r.dim)))
        told = spark.sparkContext.broadcast((layout.start, layout.count, layout.radius, layout.size))
        spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 62)).alias("spread")
        asking = stage_table(placed.select("vec_id", "v", "copies", "home", spread).mapInArrow(
            _ask(sent, told), f"vec_id long, v {kind}, copies long, home int, block int, asks array<int>"))
        askers = asking.select(F.explode("asks").alias("held"), F.col("block").alias("asking"), "vec_id", "v", "copies", "home", F.lit(False).alias("entry"))
        # a block meets itself and those that have askers for it
        tiles = askers.select("held", "asking").distinct().unionByName(asking.select(F.col("block").alias("held"), F.col("block").alias("asking")).distinct())
        per_block = tiles.groupBy("held").agg(F.collect_list("asking").alias("asked"))
        entries = (asking.join(per_block, F.col("block") == F.col("held"))
                   .select("held", F.explode("asked").alias("asking"), "vec_id", "v", "copies", "home", F.lit(True).alias("entry")))
        part = entries.unionByName(askers).groupBy("held", "asking").applyInArrow(_tile(sent), "vec_id long, links long, root long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "vec_id long, links long, root long")
    found = stage_table(found)
    counted = found.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "rep")
    joined = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    named = (classes.select("key", "rep", "copies").join(counted, "rep", "left").join(joined, "rep", "left")
             .select("key", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    placed = hot_join(keyed.select("vec_id", "key"), named, "key", "copies", classes.agg(F.sum("copies")).first()[0] or 0)
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = placed.select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
