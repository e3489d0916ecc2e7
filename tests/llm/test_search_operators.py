"""FM-index decontamination, ranked search and hard negatives against plain versions on awkward rows."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain import awkward_docs
from plumbline.llm import decontaminate, hard_negatives, queries, ranked_search
from plumbline.llm.fm_index import FmIndex
from plumbline.llm.gnat import Gnat


@pytest.fixture(scope="module")
def docs(spark):
    return awkward_docs(spark).cache()


def bare(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.fixture(scope="module")
def items(spark, docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = [("a", texts[9]), ("b", " ".join(bare(texts[0])[20:45])), ("c", "one"), ("c", " ".join(bare(texts[8])[5:30])), ("d", None), ("e", " .,! "),
            (None, texts[0]), ("f", "nowhere to be found"), ("b", " ".join(bare(texts[0])[20:45])), ("10", " ".join(bare(texts[8])[:12]).upper())]
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id string, text string, doc_id int")


# ---- FM-index -----------------------------------------------------------------

@pytest.mark.parametrize("seed", range(4))
def test_fm_index_counts_and_places_equal_a_scan(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 25, 60) * (rng.random(60) < 0.8)
    hashes = rng.integers(1, 4 + seed * 3, counts.sum()).astype(np.uint64)
    index = FmIndex.load(FmIndex.build(hashes, counts).dump())
    text, at = [], 0
    for n in counts:
        text += [*hashes[at: at + n].tolist(), 0]
        at += n
    phrases, lengths = rng.integers(1, 6, (200, 5)).astype(np.uint64), rng.integers(1, 6, 200)
    which, low, high = index.search(phrases, lengths)
    got = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high)}
    for k in range(200):
        p = phrases[k, 5 - lengths[k]:].tolist()
        assert got.get(k, []) == [i for i in range(len(text)) if text[i: i + len(p)] == p]


def plain_hits(rows, items, window):
    phrases = {}
    for name, text in items:
        w = bare(text)
        if name is not None and w:
            for i in range(max(1, len(w) - window + 1)):
                phrases.setdefault(tuple(w[i: i + window]), set()).add(name)
    out = []
    for doc_id, text in rows:
        w, hit, named = bare(text), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if tuple(w[i: i + n]) in phrases:
                    hit.update(range(i, i + n))
                    named |= phrases[tuple(w[i: i + n])]
        out.append((str(doc_id), len(w), sorted(hit), sorted(named)))
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(1 << 22, 1 << 20), (3000, 1 << 20), (3000, 120)])
def test_decontamination_equals_a_scan(spark, docs, items, monkeypatch, shard, block):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    monkeypatch.setattr(decontaminate, "PHRASE_BYTES", block)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_hits(rows, [(r.item_id, r.text) for r in items.collect()], 10)
    got = decontaminate.find(docs, items).collect()
    found = []
    for r in got:
        covered = [x for s in r.spans for x in range(s["start"], s["start"] + s["length"])]
        assert covered == sorted(set(covered)) and len(covered) == r.n_hit and r.contaminated == (r.n_hit > 0)
        assert all(a["start"] + a["length"] < b["start"] for a, b in zip(r.spans, r.spans[1:]))
        found.append((str(r.doc_id), r.n_words, covered, list(r["items"])))
    assert sorted(found) == want
    assert any(len(w[3]) > 1 for w in want) and any(not w[2] and w[1] for w in want)


def test_decontamination_of_empty_tables(spark, docs, items):
    assert decontaminate.find(docs.limit(0), items).count() == 0
    clean = decontaminate.find(docs, items.limit(0)).collect()
    assert len(clean) == docs.count() and not any(r.n_hit or r["items"] or r.contaminated for r in clean)


def test_cut_takes_the_spans_out(spark):
    rows = spark.createDataFrame([("One, two; THREE four.", [(1, 2)], 1), ("é b", [], 2), (None, [], 3), ("a b", [(0, 2)], 4)],
                                 "text string, spans array<struct<start:long,length:long>>, other int")
    assert {r.other: r.text for r in decontaminate.cut(rows).collect()} == {1: "One, four.", 2: "é b", 3: None, 4: ""}


# ---- ranked search --------------------------------------------------------------

def plain_ranking(rows, items, k):
    texts = [(i, bare(t)) for i, t in rows if i is not None]
    n, length, holders = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts), {}
    for _, w in texts:
        for term in set(w):
            holders[term] = holders.get(term, 0) + 1
    wanted = {}
    for name, text in items:
        if name is not None:
            wanted.setdefault(name, set()).update(bare(text))
    out = []
    for name, terms in wanted.items():
        scored = []
        for doc_id, w in texts:
            m = 50 + (50 * len(w) * n) // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * holders[t] + 1))) * ((1_000_000_000 * w.count(t)) // (1000 * w.count(t) + 20 * m))
                        for t in terms & set(w))
            if score > 0:
                scored.append((-score, doc_id))
        out += [(name, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard,block,run,k", [(1 << 23, 1 << 20, 512, 50), (2000, 120, 4, 7), (9000, 1 << 20, 8, 3)])
def test_ranking_equals_scoring_everything(spark, docs, items, monkeypatch, shard, block, run, k):
    for name, value in (("SHARD_BYTES", shard), ("QUERY_BYTES", block), ("RUN", run)):
        monkeypatch.setattr(ranked_search, name, value)
    got = sorted(tuple(r) for r in ranked_search.search(docs, items, k).collect())
    assert got == plain_ranking([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], k)
    assert got


def test_ranking_of_empty_tables(spark, docs, items):
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0
    assert ranked_search.search(docs.where("text is null"), items).count() == 0


def test_skipping_asks_fewer_entries_than_it_holds(monkeypatch):
    """Runs whose bounds cannot reach the limit are not read."""
    rng = np.random.default_rng(3)
    n, terms = 64 * 512, 6
    lists = ranked_search.ShardLists.__new__(ranked_search.ShardLists)
    holders = [np.flatnonzero(rng.random(n) < p) for p in (0.5, 0.5, 0.4, 0.3, 0.001, 0.0005)]
    lists.ids, lists.runs = np.arange(n), n // 512
    lists.size = np.array([len(h) for h in holders])
    lists.begin, lists.docs = np.cumsum(lists.size) - lists.size, np.concatenate(holders)
    lists.part = rng.integers(1, 100, len(lists.docs)) * np.repeat([1, 1, 1, 1, 50, 50], lists.size)
    cell = np.repeat(np.arange(terms), lists.size) * lists.runs + lists.docs // 512
    lists.cell = np.searchsorted(cell, np.arange(terms * lists.runs + 1))
    lists.top = np.zeros(terms * lists.runs, np.int64)
    np.maximum.at(lists.top, cell, lists.part)
    weight = np.array([1, 1, 2, 3, 4, 5])
    whole = np.zeros(n, np.int64)
    for t in range(terms):
        whole[holders[t]] += lists.part[lists.begin[t]: lists.begin[t] + lists.size[t]] * weight[t]
    read, real = [], ranked_search.spread
    monkeypatch.setattr(ranked_search, "spread", lambda flat, begin, size: (read.append(size.sum()), real(flat, begin, size))[1])
    scores, names = ranked_search.search_shard(lists, np.arange(terms), weight, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 5)
    want = np.lexsort((np.arange(n), -whole))[:5]
    assert names.tolist() == want.tolist() and scores.tolist() == whole[want].tolist()
    assert sum(read) < len(lists.docs) / 10


# ---- hard negatives ---------------------------------------------------------------

def plain_negatives(rows, anchor, positives=5, negatives=3):
    rows = [(i, x, np.array(q, dtype=np.int64)) for i, x, q in {(i, x, tuple(q)) for i, x, q in rows}]
    out = []
    for i, x, q in rows:
        if not anchor(i):
            continue
        scored = sorted({(-int(q @ w), j, y) for j, y, w in rows if j != i})
        for s, j, y in [r for r in scored if r[2] == x][:positives]:
            good = [r for r in scored if r[2] != x and -50 * s <= -100 * r[0] <= -95 * s][:negatives]
            out += [(i, j, k, g[1], -s, -g[0]) for k, g in enumerate(good, 1)]
    return sorted(out)


def vectors(rng, n):
    """Unstructured vectors, a group of equal ones, a group of near ones, zeros, few labels."""
    base = rng.integers(-40, 40, (n, 6))
    base[n // 3: n // 2] = base[0]
    base[n // 2: 2 * n // 3] = base[1] + rng.integers(-2, 3, (2 * n // 3 - n // 2, 6))
    base[-3:] = 0
    return [(int(i), int(rng.integers(0, 3)), v.astype(float).tolist()) for i, v in enumerate(base)]


@pytest.mark.parametrize("seed,leaf,tile,askers,group", [(0, 4096, 8192, 64, 128), (1, 16, 8, 3, 2), (2, 30, 1000, 1, 1)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, leaf, tile, askers, group):
    for name, value in (("LEAF_ROWS", leaf), ("TILE_ROWS", tile), ("ASKERS", askers), ("GROUP", group), ("LEAST_SAMPLE", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(np.random.default_rng(seed), 300)
    rows += [rows[5], rows[10], (10, 2, [9.0] * 6)]  # repeated rows, and an id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, label int, q array<double>").repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 5 == 0).collect())
    want = plain_negatives(rows, lambda i: i % 5 == 0)
    assert sorted(set(got)) == sorted(set(want)) and len(want) > 100
    assert len(got) == len(want)


def test_hard_negatives_of_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [0.5, 0.5]), (7, None, [1.0]), (None, 1, [1.0, 1.0]), (14, 1, None), (21, 2, [0.1, None]), (3, 2, [nan, 1.0]), (4, 2, [inf, 1.0]),
            (50, 1, [0.5]), (5, 1, [0.4, 0.6]), (6, 2, [0.4, 0.3]), (8, 2, [0.35, 0.35]), (9, 3, [])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, label int, embedding array<double>, unit string, leaf int")
    used = hard_negatives.usable(df)
    assert sorted(r.vec_id for r in used.collect()) == [0, 5, 6, 8, 9, 50]
    whole = used.withColumn("q", hard_negatives.whole_numbers(F.col("embedding")))
    got = sorted(tuple(r) for r in hard_negatives.mine(whole, F.col("vec_id") % 50 == 0).collect())
    filled = [(r.vec_id, r.label, [*r.q, 0.0, 0.0][:2]) for r in whole.collect()]
    assert got == plain_negatives(filled, lambda i: i % 50 == 0) and got
    assert hard_negatives.mine(whole.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_drops_only_leaves_without_answers():
    rng = np.random.default_rng(7)
    centres = rng.integers(-300, 300, (12, 8))
    rows = (centres[rng.integers(0, 12, 2000)] + rng.integers(-20, 20, (2000, 8))).astype(float)
    tree = Gnat.fit(rows[:400], 20)
    slots = tree.slots()
    low, high, bits = np.full(slots[-1], np.inf), np.full(slots[-1], -np.inf), np.full(slots[-1], np.uint64(1))
    length = (rows * rows).sum(axis=1)

    def visit(node, child, at, away):
        m = away.shape[1]
        pairs, own = slice(slots[node] + child * m, slots[node] + child * m + m), slots[node] + m * m + child
        low[pairs], high[pairs] = np.minimum(low[pairs], away.min(axis=0)), np.maximum(high[pairs], away.max(axis=0))
        low[own], high[own] = min(low[own], length[at].min()), max(high[own], length[at].max())

    leaf = tree.place(rows, visit)
    tree.learn(low, high, bits)
    scores = rows[:50] @ rows.T
    most = np.partition(scores, -30, axis=1)[:, -30][:, None]
    least = np.floor(most * 0.9)
    meets = tree.reach(rows[:50], least, most, np.full(50, np.uint64(1)))
    inside = (scores >= least) & (scores <= most)
    for r in range(50):
        assert set(leaf[inside[r]]) <= set(np.flatnonzero(meets[r]))
    assert meets.mean() < 0.5


@pytest.mark.parametrize("name,columns", [("op11_decontaminate", {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}),
                                          ("op12_ranked_search", {"item_id", "rank", "doc_id", "score"}),
                                          ("op13_hard_negatives", {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"})])
def test_queries_carry_the_agreed_columns(spark, name, columns):
    made = queries.registry()[name](spark, "/root/testdata/sf0.001")
    assert columns <= set(made.columns)
    kinds = dict(made.dtypes)
    assert all(kinds[c] == "bigint" for c in columns & {"n_words", "n_hit", "n_items", "doc_id", "score", "positive_score", "negative_score"})
    if name == "op11_decontaminate":
        assert made.where("not contaminated").first().items_sha256 == hashlib.sha256(b"").hexdigest()
