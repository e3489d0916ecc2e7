"""Hard negatives: rows of another label that score a little less than a positive, found through a multiway tree.

Rows with the same vector and label are one unit that keeps its smallest ids, as
many as a result can name; a vector that a third of all rows share is one unit.
Split points come from a bounded sample (SAMPLE_ROWS units, or SAMPLE_BYTES); all
units are placed and the distance ranges between siblings are taken over all.

Units that hold an anchor ask in blocks of at most ASKERS from one leaf, in four
rounds: their own leaf for positives, every other leaf that may beat the last of
them, their own leaf for negatives, and every other leaf whose ranges meet the
window of a positive, narrowed by the negatives known so far.  A leaf answers with
exact whole-number products of all its rows, tile by tile; tiles are met by at
most GROUP blocks at once.  Nothing is approximate: the tree only drops leaves
that cannot hold an answer.  Asking and answering rows are (block, leaf) pairs.

Defined results: rows without id, label or vector, or with a null or non-finite
component, take no part; shorter vectors count as filled up with zeros;
repeated rows count once, and a row is never its own anchor's positive or
negative, by id; an anchor without positives, and a positive without negatives,
has no rows.  Products are exact below 2^53.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordering import stage_table
from plumbline.llm.gnat import Gnat
from plumbline.llm.sizing import hot_join, pieces

POSITIVES, NEGATIVES = 5, 3
FLOOR, CEILING = 50, 95  # a negative's share of the positive's score, in hundredths
SAMPLE_ROWS, SAMPLE_BYTES = 8192, 16 << 20
LEAF_ROWS, LEAST_SAMPLE = 4096, 8
TILE_ROWS, ASKERS, GROUP = 8192, 64, 128
_STATE = ("block long, unit string, label long, q binary, leaf long, "
          "pos_score array<long>, pos_id array<long>, neg_slot array<long>, neg_score array<long>, neg_id array<long>")
_ASK = "leaf long, chunk long, block long, member array<long>, q binary, label array<long>, least array<double>, most array<double>"
_TOLD = "block long, member array<long>, slot array<long>, score array<long>, id array<long>"


def whole_numbers(embedding: Column, times: int = 256) -> Column:
    """floor(times * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * times).cast("double"))


def usable(rows: DataFrame) -> DataFrame:
    """Rows with an id, a label and a vector of finite components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where("vec_id is not null and label is not null and embedding is not null").where(~bad)


def _unpack(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors packed as 2 or 8 bytes a component, possibly several in a value."""
    out = []
    for value in column:
        raw = value.as_buffer()
        out.append(np.frombuffer(raw[1:], "<i2" if raw[:1].to_pybytes() == b"2" else "<f8").astype(np.float64).reshape(-1, width))
    return np.concatenate(out) if out else np.zeros((0, width))


def _packed(rows: np.ndarray) -> bytes:
    small = np.abs(rows).max(initial=0) < 1 << 15
    return (b"2" if small else b"8") + rows.astype("<i2" if small else "<f8").tobytes()


def _bit(labels: np.ndarray) -> np.ndarray:
    """One of 64 bits for each label."""
    return np.uint64(1) << (labels.astype(np.int64) % 64).astype(np.uint64)


def _unit() -> Column:
    return F.concat_ws(":", F.md5(F.array_join(F.col("q").cast("array<string>"), ",").cast("binary")), F.col("label").cast("string"))


def _units(rows: DataFrame, asks: Column, ids: int) -> DataFrame:
    """One row per vector and label: its smallest ``ids`` ids among anchors and among others, and whether an anchor is in it."""
    marked = rows.select("vec_id", F.col("label").cast("long").alias("label"), "q", asks.alias("asks"), _unit().alias("unit"))
    spot = F.dense_rank().over(Window.partitionBy("unit", "asks").orderBy("vec_id"))
    return marked.withColumn("spot", spot).where(F.col("spot") <= ids).groupBy("unit").agg(
        F.first("label").alias("label"), F.first("q").alias("q"), F.sort_array(F.collect_set("vec_id")).alias("ids"), F.max("asks").alias("asks"))


def _placed(units: DataFrame, tree: Gnat, width: int) -> DataFrame:
    """Units with their leaf, the vector as bytes."""
    sent = units.sparkSession.sparkContext.broadcast((tree.points, tree.children, tree.leaves))

    def step(batches):
        known = Gnat(*sent.value)
        for batch in batches:
            rows = np.zeros((len(batch), width))
            lists = batch.column("q")
            sizes = np.diff(lists.offsets.to_numpy())
            rows[np.repeat(np.arange(len(batch)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
            made = {c: batch.column(c) for c in ("unit", "label", "ids", "asks")}
            yield pa.RecordBatch.from_pydict(made | {"q": pa.array([_packed(r) for r in rows], pa.binary()), "leaf": pa.array(known.place(rows), pa.int64())})

    return units.mapInArrow(step, "unit string, label long, ids array<long>, asks boolean, q binary, leaf long")


def _learn(placed: DataFrame, tree: Gnat, width: int) -> None:
    """Distance ranges, lengths and label bits of every subtree over all rows; the tree's size bounds what is collected."""
    sent = placed.sparkSession.sparkContext.broadcast((tree.points, tree.children, tree.leaves))
    slots = tree.slots()

    def step(batches):
        known, n = Gnat(*sent.value), int(slots[-1])
        low, high, bits = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.uint64)
        for batch in batches:
            rows = _unpack(batch.column("q"), width)
            length, bit = (rows * rows).sum(axis=1), _bit(batch.column("label").to_numpy())

            def visit(node, child, at, away, length=length, bit=bit):
                m = away.shape[1]
                pairs, own = slice(slots[node] + child * m, slots[node] + child * m + m), slots[node] + m * m + child
                low[pairs], high[pairs] = np.minimum(low[pairs], away.min(axis=0)), np.maximum(high[pairs], away.max(axis=0))
                low[own], high[own] = min(low[own], length[at].min()), max(high[own], length[at].max())
                bits[own] |= np.bitwise_or.reduce(bit[at])

            known.place(rows, visit)
        seen = np.flatnonzero(low <= high)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(seen, pa.int64()), "low": pa.array(low[seen]), "high": pa.array(high[seen]),
                                          "bits": pa.array(bits[seen].view(np.int64))})

    found = placed.select("q", "label").mapInArrow(step, "slot long, low double, high double, bits long").groupBy("slot").agg(
        F.min("low"), F.max("high"), F.bit_or("bits")).collect()
    low, high, bits = np.full(slots[-1], np.inf), np.full(slots[-1], -np.inf), np.zeros(slots[-1], np.uint64)
    for slot, a, b, c in found:
        low[slot], high[slot], bits[slot] = a, b, np.int64(c).view(np.uint64)
    tree.learn(low, high, bits)


def _best(member: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best entries of each (member, slot), in order; an entry that is there twice counts once."""
    by = np.lexsort((ids, -score, slot, member))
    same = np.zeros(len(by), bool)
    same[1:] = np.logical_and.reduce([np.diff(x[by]) == 0 for x in (member, slot, score, ids)])
    by = by[~same]
    head = np.ones(len(by), bool)
    head[1:] = (np.diff(member[by]) != 0) | (np.diff(slot[by]) != 0)
    start = np.flatnonzero(head)[np.cumsum(head) - 1] if len(by) else by
    return by[np.arange(len(by)) - start < most]


def _windows(scores: list[int]) -> list[tuple[float, float]]:
    return [(float(-(-FLOOR * s // 100)), float(CEILING * s // 100)) for s in scores]


def _ask(sent, width: int, chunks: int, positive: bool, home: bool, kept: int, spare: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """A block's questions: one row per leaf that some of its members must ask."""
    def step(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("unit")
        q, label, leaf = _unpack(rows.column("q"), width), rows.column("label").to_numpy(), rows.column("leaf").to_numpy()
        wins = []
        for r in range(len(rows)):
            scores = rows.column("pos_score")[r].as_py()
            if positive:
                wins.append([(float(scores[kept - 1]) if len(scores) >= kept else -np.inf, np.inf)])
                continue
            own = [list(w) for w in _windows(scores)]
            slots, known = rows.column("neg_slot")[r].as_py(), rows.column("neg_score")[r].as_py()
            for w in range(len(own)):
                have = [s for i, s in zip(slots, known) if i == w]
                if len(have) >= spare:
                    own[w][0] = float(min(have))
            wins.append(own)
        most_windows = max((len(w) for w in wins), default=0) or 1
        least, most = np.full((len(rows), most_windows), np.nan), np.full((len(rows), most_windows), np.nan)
        for r, w in enumerate(wins):
            for k, (a, b) in enumerate(w):
                if a <= b:
                    least[r, k], most[r, k] = a, b
        if home:
            asked = {int(leaf[0]): np.flatnonzero(~np.isnan(least).all(axis=1))}
        else:
            tree = Gnat(*sent.value)
            bits = _bit(label) if positive else np.full(len(rows), np.uint64(0xFFFFFFFFFFFFFFFF))
            meets = tree.reach(q, least, most, bits)
            meets[np.arange(len(rows)), leaf] = False
            asked = {int(x): np.flatnonzero(meets[:, x]) for x in np.flatnonzero(meets.any(axis=0))}
        asked = {x: m for x, m in asked.items() if len(m)}
        block = key[0].as_py()
        return pa.table({
            "leaf": pa.array(list(asked), pa.int64()), "chunk": pa.array([block % chunks] * len(asked), pa.int64()), "block": pa.array([block] * len(asked), pa.int64()),
            "member": pa.array([m.tolist() for m in asked.values()], pa.list_(pa.int64())), "q": pa.array([_packed(q[m]) for m in asked.values()], pa.binary()),
            "label": pa.array([label[m].tolist() for m in asked.values()], pa.list_(pa.int64())),
            "least": pa.array([least[m].ravel().tolist() for m in asked.values()], pa.list_(pa.float64())),
            "most": pa.array([most[m].ravel().tolist() for m in asked.values()], pa.list_(pa.float64()))})

    return step


def _answer(width: int, positive: bool, kept: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best rows of a tile in each window of each member that asks: one row per block."""
    def step(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in _TOLD.split(", ")}
        lists = rows.column("ids").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy()) if len(rows) else np.zeros(0, np.int64)
        ids, unit = lists.flatten().to_numpy(), np.repeat(np.arange(len(rows)), sizes)
        by = np.argsort(ids, kind="stable")  # equal scores then come in order of ids
        ids, unit = ids[by], unit[by]
        x, labels = _unpack(rows.column("q"), width), rows.column("label").to_numpy()[unit] if len(rows) else np.zeros(0, np.int64)
        for a in range(len(asks) if len(ids) else 0):
            member, label = np.array(asks.column("member")[a].as_py()), asks.column("label")[a].as_py()
            least, most = (np.array(asks.column(c)[a].as_py(), dtype=np.float64).reshape(len(member), -1) for c in ("least", "most"))
            scores = (_unpack(asks.column("q").slice(a, 1), width) @ x.T)[:, unit]
            found: list[tuple] = []
            floor, ceiling = np.nanmin(least, axis=1), np.nanmax(most, axis=1)
            for r in range(len(member)):
                own = scores[r]
                able = np.flatnonzero((own >= floor[r]) & (own <= ceiling[r]) & ((labels == label[r]) == positive))
                able = able[np.argsort(-own[able], kind="stable")]
                falling = own[able]
                from_, to = np.searchsorted(-falling, -most[r]), np.searchsorted(-falling, -least[r], side="right")
                spot = from_[:, None] + np.arange(kept)
                w, k = np.nonzero(spot < to[:, None])
                pick = able[spot[w, k]]
                found.append((np.full(len(pick), member[r]), w, own[pick].astype(np.int64), ids[pick]))
            parts = [np.concatenate(c) for c in zip(*found)]
            if len(parts[0]):
                for name, value in zip(out, [asks.column("block")[a].as_py(), *[p.tolist() for p in parts]]):
                    out[name].append(value)
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4]
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    return step


def _merge(positive: bool, kept: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's state with the answers of all leaves taken in."""
    names = ("pos_score", "pos_id") if positive else ("neg_slot", "neg_score", "neg_id")

    def step(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows = rows.sort_by("unit")
        known = [[], [], [], []]
        for r in range(len(rows)):
            have = [rows.column(c)[r].as_py() for c in names]
            n = len(have[0])
            for part, values in zip(known, [[r] * n, [0] * n if positive else have[0], *have[-2:]]):
                part.extend(values)
        for c, part in zip(("member", "slot", "score", "id"), known):
            part.extend(v for values in told.column(c).to_pylist() for v in values)
        member, slot, score, ids = (np.array(part, dtype=np.int64) for part in known)
        keep = _best(member, slot, score, ids, kept)
        cuts = np.searchsorted(member[keep], np.arange(len(rows) + 1))
        new = dict(zip(names, ([score, ids] if positive else [slot, score, ids])))
        for c, values in new.items():
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values[keep], pa.int64()))
            rows = rows.set_column(rows.schema.get_field_index(c), c, lists)
        return rows

    return step


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, label, q) where ``anchor`` is true.

    ``q`` holds whole numbers as doubles.  Positives: the ``positives`` best other rows of the label; negatives: the best rows of
    other labels that score between FLOOR and CEILING hundredths of the positive; equal scores in order of ids.
    """
    spark, kept = rows.sparkSession, positives + 1
    units = stage_table(_units(rows, anchor, kept))
    size = units.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("d")).first()
    n, width = size.n, max(1, size.d or 1)
    taken = min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * width)))
    sample = np.zeros((0, width))
    if n:  # md5 order: a sample by hash
        lists = [r.q for r in units.orderBy("unit").select("q").limit(taken).collect()]
        sample = np.array([v + [0.0] * (width - len(v)) for v in lists])
    tree = Gnat.fit(sample, max(LEAST_SAMPLE, len(sample) * LEAF_ROWS // max(n, 1)))
    placed = stage_table(_placed(units, tree, width))
    _learn(placed, tree, width)
    sent = spark.sparkContext.broadcast((tree.points, tree.children, tree.leaves, tree.near, tree.far, tree.short, tree.long, tree.bits))
    counts = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).collect()  # a row per leaf
    blocks = sum(pieces(r.asks, ASKERS) for r in counts)
    chunks = pieces(blocks, GROUP)
    leaves = F.broadcast(spark.createDataFrame([(r.leaf, pieces(r.n, TILE_ROWS), pieces(r.asks, ASKERS)) for r in counts], "leaf long, tiles long, parts long"))
    dealt = placed.join(leaves, "leaf")
    tiles = dealt.select("leaf", "label", "ids", "q", F.pmod(F.xxhash64("unit"), F.col("tiles")).alias("tile"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    none = F.array().cast("array<long>")
    state = stage_table(dealt.where("asks").select(
        (F.col("leaf") * (1 << 32) + F.pmod(F.xxhash64("unit"), F.col("parts"))).alias("block"), "unit", "label", "q", "leaf",
        *[none.alias(c) for c in ("pos_score", "pos_id", "neg_slot", "neg_score", "neg_id")]))
    for positive in (True, False):
        most = kept if positive else negatives + 1  # one to spare: the anchor's own id goes
        for home in (True, False):
            asks = state.groupBy("block").applyInArrow(_ask(sent, width, chunks, positive, home, kept, negatives + 1), _ASK).join(leaves, "leaf")
            asks = asks.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).drop("tiles", "parts")
            told = (tiles.groupBy("leaf", "tile", "chunk").cogroup(asks.groupBy("leaf", "tile", "chunk"))
                    .applyInArrow(_answer(width, positive, most), _TOLD))
            state = stage_table(state.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_merge(positive, most), _STATE))
    asking = rows.where(anchor).select("vec_id", _unit().alias("unit")).distinct()
    sizes = asking.groupBy("unit").agg(F.count("*").alias("copies"))
    found = hot_join(asking, state.join(sizes, "unit"), "unit", "copies", asking.count())
    pairs = found.select("vec_id", "neg_slot", "neg_score", "neg_id", F.filter(F.transform(
        F.arrays_zip("pos_score", "pos_id"), lambda p, i: F.struct(i.cast("long").alias("slot"), p["pos_score"].alias("score"), p["pos_id"].alias("id"))),
        lambda p: p["id"] != F.col("vec_id")).alias("pos")).select("*", F.explode(F.slice("pos", 1, positives)).alias("p"))
    held = F.filter(F.arrays_zip("neg_slot", "neg_score", "neg_id"), lambda m: (m["neg_slot"] == F.col("p.slot")) & (m["neg_id"] != F.col("vec_id")))
    return pairs.select("vec_id", "p", F.posexplode(F.slice(held, 1, negatives)).alias("at", "m")).select(
        F.col("vec_id").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("m.neg_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("m.neg_score").alias("negative_score"))
