"""Documents whose sets of word n-grams have a Jaccard similarity over a threshold, by vertical partitioning.

The global order of n-grams is that of their hashes.  It is cut into fragments,
and a document's set into its segments of them.

* **Pruning.**  n-grams that no other document has are in no overlap, and a set that
  has a partner with similarity t shares at least that part of its n-grams.  The first fragment of the order, wide enough to show more than that, goes to
  shards by n-gram as short fingerprints; they count lone ones per document.
* **Candidates.**  For what is left, the order is cut into more fragments than a pair may have
  differences, so one fragment is left in which the two segments are the same.
  The number of fragments is fixed per class of sizes (growing by 1 / t, so
  that partners are in the same or the next class); sets that share a segment's key are candidates.
* **Counting.**  The overlap of a candidate pair is counted in each fragment of
  a coarser cut separately and summed per pair; the exact rule then decides.

Equal sets are one class from the start.  Inside a group with one key only the
pairs with its least altered member, the hub, are counted first; then only pairs whose
members these links have not joined yet and whose differences from the hub are not farther apart
than a pair's may be (the number of differences is a metric): a few rounds with one more hub
per key, and then all pairs that are left: those of small groups once each, those of large groups inside tiles that return no more rows than they
have sets.  So components are exact, and no group is spelt out into all its pairs.

Sets are named by a 64-bit hash of their content, n-grams by 64-bit hashes.
Defined results: a null or empty text, or one of white space alone, has an empty set and is linked
with nothing; so is a row with a null doc_id (its component is null); repeated
rows share their component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.ordering import stage_table
from plumbline.llm.arrow_steps import add_columns
from plumbline.llm.components import components, lowest_members
from plumbline.llm.sizing import hot_join, pieces, text_size
from plumbline.llm.words import byte_slices, mix, tokenise, window_hashes

# five words and a similarity of 0.8 unless the caller says otherwise
WORDS, SHARE, OF = 5, 80, 100
COUNT_FRAGMENTS = 8
# rounds in which every key's members meet one more hub before what is left is counted pair by pair: in groups of at
# most SMALL sets each pair once, in larger ones inside tiles of so many sets (the results are the same either way)
STARS = 2
TILE, SMALL = 512, 64
_SHARD_BYTES = 24 << 20
# how much of the order is looked at for lone n-grams, in multiples of what must be exceeded
_LOOK = 2.5


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after the other, and where each text's begin (and the end).

    A text with fewer words than ``words`` has its whole word sequence as its only n-gram.
    """
    parts, sizes = [], []
    for _, piece in byte_slices(texts):
        w = tokenise(piece, lower=True)
        one = w.hashes()[0]
        grams = window_hashes(one, words)
        for a, b in zip(w.first[:-1], w.first[1:]):
            if b - a >= words:
                own = np.unique(grams[a: b - words + 1])
            else:
                own = window_hashes(one[a:b], int(b - a)) if b > a else one[:0]
            parts.append(own)
            sizes.append(len(own))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return upto[first[1:]] - upto[first[:-1]]


def set_names(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit name per set, equal for equal sets."""
    return mix(_sums(mix(flat + np.uint64(0x632BE59BD9B4E019)), first) + mix(np.diff(first).astype(np.uint64))).view(np.int64)


def size_classes(most: int, share: int) -> np.ndarray:
    """Smallest size of each class, up to the one after the class that holds ``most``."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(starts[-1] * OF // share + 1)
    return np.array([*starts, starts[-1] * OF // share + 1], dtype=np.int64)


def segment_keys(flat: np.ndarray, first: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """(set index, key) of each segment, in the cuts of the set's own size class and of the one below.

    A set that has so few full segments that all might differ from a partner's also gets keys for its empty ones.
    """
    size = np.diff(first)
    starts = size_classes(int(size.max(initial=0)), share)
    klass = np.searchsorted(starts, size, side="right") - 1
    owner = np.repeat(np.arange(len(size)), size)
    spread = mix(flat ^ np.uint64(0xD6E8FEB86659FD93))
    high = flat >> np.uint64(32)
    index, keys = [], []
    for back in (0, 1):
        k = klass - back
        usable = (size > 0) & (k >= 0)
        base = (starts[np.maximum(k, 0) + 1] - 1) * (OF - share) // share + 1
        cuts = (base + 1 + base // 16).astype(np.uint64)
        at = (high * cuts[owner]) >> np.uint64(32)
        if not len(at):
            continue
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(fresh)
        total = _sums(spread, np.append(heads, len(at)))
        who = owner[heads]
        tag = mix((k[who].astype(np.uint64) << np.uint64(40)) + at[heads])
        keep = usable[who]
        index.append(who[keep])
        keys.append(mix(total ^ tag)[keep])
        full = np.bincount(who, minlength=len(size))
        for i in np.flatnonzero(usable & (full * share <= size * (OF - share))):
            a, b = np.searchsorted(who, [i, i + 1])
            empty = np.setdiff1d(np.arange(int(cuts[i])), at[heads[a:b]].astype(np.int64)).astype(np.uint64)
            index.append(np.full(len(empty), i))
            keys.append(mix(mix((np.uint64(k[i]) << np.uint64(40)) + empty) + np.uint64(1)))
    if not index:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(index), np.concatenate(keys)


def _named_sets(words: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, first = shingle_sets(batch.column("text"), words)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "sid": pa.array(set_names(flat, first)),
                                              "n": pa.array(np.diff(first), pa.int64())})

    return step


def _to_lone_shards(words: int, shards: int, part: float):
    """Short fingerprints of the n-grams in the first ``part`` of the order, to shards; the sets' names, to shard -1."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 24
        for number, batch in enumerate(batches):
            flat, first = shingle_sets(batch.column("text"), words)
            names, once = np.unique(set_names(flat, first), return_index=True)  # copies within a batch are one set
            size = np.diff(first)
            lone = np.zeros(len(size), bool)
            lone[once] = True
            place = np.zeros(len(size), np.int64)
            place[once] = np.arange(len(once))
            owner = np.repeat(np.arange(len(size)), size)
            look = lone[owner] & (flat < np.uint64(int(part * 2.0 ** 64) - 1))
            spread = mix(flat[look])
            who = place[owner[look]].astype(np.int32)
            shard = (spread % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            short = (spread >> np.uint64(32)).astype(np.uint32)
            used = np.flatnonzero(np.diff(bounds))
            bodies = [names.tobytes() + size[once].astype(np.int64).tobytes()]
            for s in used:
                pick = order[bounds[s]: bounds[s + 1]]
                heads = np.flatnonzero(np.diff(who[pick], prepend=-1))
                runs = np.diff(np.append(heads, len(pick))).astype(np.int32)
                bodies.append(len(heads).to_bytes(8, "little") + np.diff(who[pick][heads], prepend=np.int32(0)).astype(np.int32).tobytes()
                              + runs.tobytes() + short[pick].tobytes())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([-1 - (base + number), *used], pa.int64()),
                                              "unit": pa.array([base + number] * len(bodies), pa.int64()), "body": pa.array(bodies, pa.binary())})

    return step


def _count_lone(key: tuple, rows: pa.Table) -> pa.Table:
    """Per unit, the sets with lone n-grams in this shard and how many; names pass through (kind 1)."""
    if key[0].as_py() < 0:
        return pa.table({"unit": rows.column("unit"), "kind": pa.array([1] * rows.num_rows, pa.int32()), "body": rows.column("body")})
    unit, who, short = [], [], []
    for u, body in zip(rows.column("unit").to_pylist(), rows.column("body")):
        raw = body.as_py()
        k, raw = int.from_bytes(raw[:8], "little"), raw[8:]
        sets = np.cumsum(np.frombuffer(raw[: 4 * k], np.int32), dtype=np.int32)
        runs = np.frombuffer(raw[4 * k: 8 * k], np.int32)
        who.append(np.repeat(sets, runs))
        short.append(np.frombuffer(raw[8 * k:], np.uint32))
        unit.append(np.full(len(who[-1]), u, np.int64))
    unit, who, short = np.concatenate(unit), np.concatenate(who), np.concatenate(short)
    order = np.argsort(short, kind="stable")
    ordered = short[order]
    alone = np.ones(len(ordered), bool)
    alone[1:] &= ordered[1:] != ordered[:-1]
    alone[:-1] &= ordered[1:] != ordered[:-1]
    hit = np.sort(order[alone])
    out: dict[str, list] = {"unit": [], "body": []}
    for u in np.unique(unit[hit]):
        sets, n = np.unique(who[hit[unit[hit] == u]], return_counts=True)
        out["unit"].append(int(u))
        out["body"].append(sets.astype(np.int32).tobytes() + n.astype(np.int32).tobytes())
    return pa.table({"unit": pa.array(out["unit"], pa.int64()), "kind": pa.array([0] * len(out["unit"]), pa.int32()),
                     "body": pa.array(out["body"], pa.binary())})


def _alive(share: int):
    """The sets of a unit that have few enough lone n-grams for a partner."""

    def step(rows: pa.Table) -> pa.Table:
        kinds, bodies = rows.column("kind").to_pylist(), [b.as_py() for b in rows.column("body")]
        both = np.frombuffer(bodies[kinds.index(1)], np.int64)
        names, size = both[: len(both) // 2], both[len(both) // 2:]
        lone = np.zeros(len(names), np.int64)
        for kind, raw in zip(kinds, bodies):
            if kind == 0:
                half = np.frombuffer(raw, np.int32)
                lone[half[: len(half) // 2]] += half[len(half) // 2:]
        return pa.table({"sid": pa.array(names[(lone * OF <= size * (OF - share)) & (size > 0)])})

    return step


def _keys_to_shards(shards: int, share: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("sid").to_numpy()
            lists = batch.column("segments")
            inner = lists.flatten()
            flat = inner.flatten().to_numpy().view(np.uint64)
            size = np.array([sum(map(len, x)) for x in lists.to_pylist()], dtype=np.int64)
            where, keys = segment_keys(flat, np.concatenate([[0], np.cumsum(size)]).astype(np.int64), share)
            shard = (keys % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            used = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(used, pa.int32()),
                "keys": pa.array([keys[order[bounds[s]: bounds[s + 1]]].tobytes() for s in used], pa.binary()),
                "sids": pa.array([names[where[order[bounds[s]: bounds[s + 1]]]].tobytes() for s in used], pa.binary())})

    return step


def _shared_keys(rows: pa.Table) -> pa.Table:
    """The (key, set) pairs of keys that two different sets have."""
    keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.uint64)
    sids = np.frombuffer(b"".join(rows.column("sids").to_pylist()), np.int64)
    order = np.lexsort((sids, keys))
    keys, sids = keys[order], sids[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])
    keys, sids = keys[new], sids[new]
    same = np.zeros(len(keys), bool)
    same[1:] = keys[1:] == keys[:-1]
    same[:-1] |= same[1:]
    return pa.table({"key": pa.array(keys[same].view(np.int64)), "sid": pa.array(sids[same])})


def _segments(words: int):
    """The sets that the rows ask for by ``sid``, as their segments in the coarse cut."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, COUNT_FRAGMENTS, dtype=np.uint64) << np.uint64(61)
        for batch in batches:
            flat, first = shingle_sets(batch.column("text"), words)
            names = set_names(flat, first)
            wanted = np.flatnonzero(names == batch.column("sid").to_numpy())
            made = []
            for i in wanted:
                own = flat[first[i]: first[i + 1]]
                made.append([x.view(np.int64) for x in np.split(own, np.searchsorted(own, edges))])
            yield pa.RecordBatch.from_pydict({"sid": pa.array(names[wanted]), "n": pa.array(np.diff(first)[wanted], pa.int64()),
                                              "segments": pa.array(made, pa.list_(pa.list_(pa.int64())))})

    return step


def _may_link(a: str, b: str, share: int) -> Column:
    """Sizes and lone n-grams leave room for the threshold: lone ones are in no overlap."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(n - F.col(f"{a}.lone"), m - F.col(f"{b}.lone"))
    return most * (OF + share) >= share * (n + m)


def _counted(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs (a, b, n, m) with ``common``: overlaps counted in each fragment separately and summed."""
    left = segments.select(F.col("sid").alias("a"), F.col("segments").alias("sa"))
    right = segments.select(F.col("sid").alias("b"), F.col("segments").alias("sb"))
    partial = F.zip_with("sa", "sb", lambda x, y: F.size(F.array_intersect(x, y)).cast("bigint"))
    both = (pairs.join(left, "a").join(right, "b")
            .select("a", "b", "n", "m", F.aggregate(partial, F.lit(0).cast("bigint"), lambda s, c: s + c).alias("common")))
    # a repeated row of documents repeats its set
    return both.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.max("common").alias("common"))


def _linked(counted: DataFrame, share: int) -> DataFrame:
    return counted.where(F.col("common") * OF >= share * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b")


def _tile_links(members: DataFrame, segments: DataFrame, share: int) -> DataFrame:
    """Links (a, b) that join all members of a key which are linked: every pair of different components is counted.

    A key's members are dealt over tiles of bounded size; a task has two tiles and returns a spanning forest of the links it finds.
    """
    tiles = F.ceil(F.col("size") / TILE)
    own = F.pmod(F.xxhash64("sid"), tiles)
    dealt = (members.select("key", "sid", "n", "component", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1)).alias("other"))
             .select("key", "sid", "n", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))

    def tile(key: tuple, rows: pa.Table) -> pa.Table:
        sids, at = np.unique(rows.column("sid").to_numpy(), return_index=True)  # a repeated row of documents is one set
        rows = rows.take(pa.array(at))
        size, component, own = (rows.column(c).to_numpy() for c in ("n", "component", "own"))
        sets = rows.column("segments").to_pylist()
        common = np.zeros((len(sids), len(sids)), np.float32)
        for f in range(COUNT_FRAGMENTS):
            parts = [np.array(x[f], np.int64) for x in sets]
            owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            grams, code = np.unique(np.concatenate(parts), return_inverse=True)
            for a in range(0, len(grams), 4096):
                pick = (code >= a) & (code < a + 4096)
                has = np.zeros((len(parts), min(4096, len(grams) - a)), np.float32)
                has[owner[pick], code[pick] - a] = 1
                common += has @ has.T
        enough = common * OF >= share * (size[:, None] + size[None, :] - common)
        wanted = (component[:, None] != component[None, :]) & ((own[:, None] != own[None, :]) | (key[1].as_py() == key[2].as_py()))
        x, y = np.nonzero(enough & wanted)
        low = lowest_members(len(sids), x, y)
        hit = np.flatnonzero(low != np.arange(len(sids)))
        return pa.table({"a": pa.array(sids[low[hit]]), "b": pa.array(sids[hit])})

    return (dealt.join(segments.select("sid", "segments"), "sid").groupBy("key", "i", "j")
            .applyInArrow(tile, "a long, b long"))


def _classes(docs: DataFrame, words: int, share: int) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, sid, n), and per set (sid, copies, class, first): a number for its class and the class's first member.

    ``first`` is the smallest (doc_id, sid) of the class.
    """
    shards = pieces(text_size(docs)[1], _SHARD_BYTES)
    sets = stage_table(docs.mapInArrow(_named_sets(words), "doc_id long, sid long, n long"))
    linkable = sets.where("doc_id is not null and n > 0")
    classes = linkable.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"))

    part = min(1.0, _LOOK * (OF - share) / OF)
    units = (docs.where("doc_id is not null").mapInArrow(_to_lone_shards(words, shards, part), "shard long, unit long, body binary")
             .groupBy("shard").applyInArrow(_count_lone, "unit long, kind int, body binary"))
    alive = units.groupBy("unit").applyInArrow(_alive(share), "sid long").distinct()
    asked = classes.join(alive, "sid", "left_semi")
    found = docs.join(asked.select(F.col("rep").alias("doc_id"), "sid"), "doc_id").select("text", "sid")
    segments = stage_table(found.mapInArrow(_segments(words), "sid long, n long, segments array<array<long>>"))
    fragments = segments.select("sid", F.posexplode("segments").alias("fragment", "tokens")).where(F.size("tokens") > 0)

    packed = segments.mapInArrow(_keys_to_shards(shards, share), "shard int, keys binary, sids binary")
    members = stage_table(packed.groupBy("shard").applyInArrow(_shared_keys, "key long, sid long"))
    asked = members.select("sid").distinct()
    # n-grams that only one candidate has
    lone = (fragments.join(asked, "sid", "left_semi").select("sid", F.explode("tokens").alias("t")).groupBy("t")
            .agg(F.min("sid").alias("sid"), F.max("sid").alias("other")).where("sid = other").groupBy("sid").agg(F.count("*").alias("lone")))
    sized = (segments.select("sid", "n").distinct().join(lone, "sid", "left").select("sid", "n", F.coalesce("lone", F.lit(0)).alias("lone"))
             .where(F.col("lone") * OF <= F.col("n") * (OF - share)))
    members = stage_table(members.join(sized, "sid"))
    total = members.count()

    best = (members.groupBy("key").agg(F.min(F.struct("lone", "sid", "n")).alias("hub"), F.count("*").alias("size"))
            .where("size > 1"))
    members = stage_table(hot_join(members, best, "key", "size", total).where("hub is not null").drop("size"))
    first = stage_table(members.where("hub.sid <> sid").select(F.struct("sid", "n", "lone").alias("x"), F.col("hub").alias("y"))
                        .where(_may_link("x", "y", share))
                        .select(F.col("y.sid").alias("a"), F.col("x.sid").alias("b"), F.col("y.n").alias("n"), F.col("x.n").alias("m"))
                        .distinct())
    counted = stage_table(_counted(first, segments))
    joined = components(_linked(counted, share))

    # what is left: members of one key in different components, whose distances to the key's hub leave room for a link
    gap = counted.select(F.struct("a", "b").alias("pair"), (F.col("n") + F.col("m") - 2 * F.col("common")).alias("gap"))
    members = stage_table(members.withColumn("pair", F.struct(F.col("hub.sid").alias("a"), F.col("sid").alias("b"))).join(gap, "pair", "left")
                          .select("key", "sid", "n", "lone", F.when(F.col("hub.sid") == F.col("sid"), 0).otherwise(F.col("gap")).alias("gap")))
    for turn in range(STARS + 1):
        labelled = (members.join(joined.withColumnRenamed("node", "sid"), "sid", "left")
                    .withColumn("component", F.coalesce("component", "sid")))
        apart = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
        members = stage_table(labelled.join(apart.select("key", "size"), "key"))
        if members.isEmpty():
            break
        x, y = members.alias("x"), members.alias("y")
        room = F.coalesce(F.abs(F.col("x.gap") - F.col("y.gap")) * (OF + share) <= (OF - share) * (F.col("x.n") + F.col("y.n")), F.lit(True))
        if turn < STARS:  # another hub per key, drawn from the members of components that are small there
            held = members.groupBy("key", "component").agg(F.count("*").alias("held"), F.min(
                F.struct(F.xxhash64("sid", "key", F.lit(turn)).alias("draw"), "sid", "n", "lone", "gap", "component")).alias("pick"))
            hubs = held.groupBy("key").agg(F.min(F.struct("held", "pick")).alias("p")).select("key", "p.pick.*")
            y, within = hubs.alias("y"), F.col("x.sid") != F.col("y.sid")
        else:  # the rest: pairs of small groups once each, whatever number of keys they share; large groups in tiles
            x, y = (members.where(F.col("size") <= SMALL).alias(t) for t in ("x", "y"))
            within = F.col("x.sid") > F.col("y.sid")
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & within & (F.col("x.component") != F.col("y.component"))
                       & _may_link("x", "y", share) & room)
        pairs = pairs.select(F.col("y.sid").alias("a"), F.col("x.sid").alias("b"), F.col("y.n").alias("n"), F.col("x.n").alias("m")).distinct()
        links = _linked(_counted(stage_table(pairs), segments), share)
        if turn == STARS:
            links = links.unionByName(_tile_links(members.where(F.col("size") > SMALL), segments, share))
        joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
        members = members.drop("component", "size")

    roots = classes.join(joined.withColumnRenamed("node", "sid"), "sid")
    lowest = roots.groupBy("component").agg(F.min(F.struct(F.col("rep").alias("doc_id"), "sid")).alias("lowest"))
    named = classes.join(joined.withColumnRenamed("node", "sid"), "sid", "left").join(lowest, "component", "left")
    own = F.struct(F.col("rep").alias("doc_id"), "sid")
    return sets, named.select("sid", "copies", F.coalesce("component", "sid").alias("class"), F.coalesce("lowest", own).alias("first"))


def similar_classes(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of ``docs`` (doc_id, text); component_id is the smallest doc_id linked.

    Sets are linked from a similarity of ``share`` / 100 on.
    """
    sets, named = _classes(docs.select("doc_id", "text"), words, share)
    placed = hot_join(sets.where("doc_id is not null and n > 0"), named, "sid", "copies", sets.count())
    alone = sets.where("doc_id is null or n = 0").withColumn("component_id", F.col("doc_id"))
    return (placed.select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))
            .unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), "component_id")))


def _with_sets(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with the name (sid) and size (n) of each row's set."""
    name = _named_sets(words)

    def make(batch: pa.RecordBatch) -> dict:
        made = pa.Table.from_batches(list(name(iter([batch.select(["doc_id", "text"])]))))
        return {"_sid": made.column("sid").combine_chunks(), "_n": made.column("n").combine_chunks()}

    return add_columns(docs, make, [T.StructField("_sid", T.LongType()), T.StructField("_n", T.LongType())])


def keep_one(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """One row of each class of similar ones, that of the smallest doc_id; rows without links stay, columns unchanged.

    Rows are judged by their texts, also where a doc_id occurs with several: of (1, a) (1, a) (2, a) (2, b) one row (1, a)
    and the row (2, b) stay.  Rows of a class that share its smallest doc_id: the one with the smallest hash of all its
    columns stays.  Rows with an empty set or a null doc_id all stay.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    sets, named = _classes(docs.select("doc_id", "text"), words, share)
    judged = hot_join(sets.where("doc_id is not null and n > 0"), named, "sid", "copies", sets.count())
    spare = judged.where(F.struct("doc_id", "sid") != F.col("first")).select("doc_id").distinct()
    # ids that occur more than once are settled row by row
    again = stage_table(sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = docs.join(spare.unionByName(again), "doc_id", "left_anti").select(*columns)
    if again.isEmpty():
        return kept
    rows = _with_sets(docs.join(again, "doc_id", "left_semi").select(*columns), words)
    first = named.select(F.col("first.doc_id").alias("doc_id"), F.col("first.sid").alias("_sid")).distinct()
    pick = Window.partitionBy("doc_id", "_sid").orderBy(F.xxhash64(*columns))
    chosen = rows.where("_n > 0").join(first, ["doc_id", "_sid"], "left_semi").withColumn("_place", F.row_number().over(pick)).where("_place = 1")
    return kept.unionByName(rows.where("_n = 0").select(*columns)).unionByName(chosen.select(*columns))
