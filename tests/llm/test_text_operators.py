"""Operators on texts against plain versions, awkward rows included."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plain import awkward_docs, components, cut_repeats, shingles, similar, words
from plumbline.llm import elias_fano, lm_trie, mil_toxicity, ngram_join, packing, substring_dedup, viterbi_pieces
from plumbline.llm.words import byte_slices, tokenise


@pytest.fixture(scope="module")
def docs(spark):
    return awkward_docs(spark).cache()


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_tokenise_equals_bytes_split():
    texts = ["", "a b", "  Ab\tcd\n é\x0bx ", "z", " "]
    for _, piece in byte_slices(pa.array([*texts, None])):
        w = tokenise(piece, lower=True)
        got = [[bytes(w.data[a:b]) for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.first, w.first[1:])]
        assert got == [words(t, lower=True) for t in [*texts, ""]]


def test_tokenise_in_small_slices():
    texts = [f"w{i} x{i % 3} y" for i in range(50)]
    whole = np.concatenate([tokenise(p).hashes()[0] for _, p in byte_slices(pa.array(texts))])
    cut = np.concatenate([tokenise(p).hashes()[0] for _, p in byte_slices(pa.array(texts), 10)])
    assert (whole == cut).all() and len(set(whole.tolist())) == 54


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (5, 9), (800, 1000), (3000, 1 << 60)])
def test_elias_fano_sequence(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
    s = elias_fano.Sequence.build(values)
    assert (s.access(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, rng.integers(0, top, 300, dtype=np.uint64), np.array([0, top], np.uint64)])
    have = {int(v): i for i, v in enumerate(values)}
    assert s.find(asked).tolist() == [have.get(int(x), -1) for x in asked]


def test_trie_finds_what_it_holds_from_a_mapped_file(tmp_path):
    rng = np.random.default_rng(3)
    size = 60
    grams = np.unique(rng.integers(0, size, (4000, 3)), axis=0)
    one, i1 = np.unique(grams[:, 0], return_inverse=True)
    two, i2 = np.unique(i1 * size + grams[:, 1], return_inverse=True)
    three = i2 * size + grams[:, 2]
    built = elias_fano.Trie.build([(None, one), (two // size, two % size), (three // size, three % size)],
                                  [{}, {}, {"x": np.arange(len(three)) / 10}])
    (tmp_path / "trie").write_bytes(built.to_bytes())
    trie = elias_fano.Trie.from_buffer(np.memmap(tmp_path / "trie", np.uint8, "r"))
    asked = rng.integers(0, size, (5000, 3))
    at = trie.child(2, trie.child(1, trie.child(0, None, asked[:, 0]), asked[:, 1]), asked[:, 2])
    have = {tuple(g): i for i, g in enumerate(grams.tolist())}
    assert at.tolist() == [have.get(tuple(a), -1) for a in asked.tolist()]
    assert np.abs(trie.value(2, "x", np.arange(len(three))) - np.arange(len(three)) / 10).max() <= three.size / 10 / 256


@pytest.mark.parametrize("shard_bytes", [1 << 20, 4000])
def test_lm_scores(spark, docs, monkeypatch, shard_bytes):
    monkeypatch.setattr(lm_trie, "_SHARD_BYTES", shard_bytes)
    rows = texts_of(docs)
    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    got = lm_trie.score(docs, ~lm_trie.held_out(F.col("doc_id"))).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    END = "</end>"
    tokens = lambda t: [*words(t, lower=True), END]
    one, two, three = Counter(), Counter(), Counter()
    train = [t for i, t in rows if i not in held]
    for t in train:
        path = ["<1>", "<1>", *tokens(t)]
        one.update(path[2:])
        two.update(zip(path[1:], path[2:]))
        three.update(zip(path, path[1:], path[2:]))
    total, types = sum(one.values()), len(one)
    base = lambda t: sum(math.log10((one[w] + 1) / (total + types + 1)) for w in tokens(t))
    want = Counter((i, len(tokens(t)), sum(one[w] > 0 for w in tokens(t)), round(base(t), 6)) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}
    # the model, written out; counts of the table are exact while its cells are not shared
    facts = lm_trie.gather_facts(docs.where(~lm_trie.held_out(F.col("doc_id"))), 3)
    discount = facts.single / types
    chance = lambda w: (one[w] - discount) / total if one[w] else discount * types / total
    assert abs(sum(chance(w) for w in one) + chance("?") - 1) < 1e-9

    def spread(v):
        c = len(train) if v == "<1>" else one[v]
        if v != "<1>":
            c = math.expm1(round(math.log1p(c) * 8) / 8)
        return lm_trie.SCALE * (1 + c) ** lm_trie.POWER

    def score(t):
        path, s = ["<1>", "<1>", *tokens(t)], 0.0
        for u, v, w in zip(path, path[1:], path[2:]):
            cuv, cv = (len(train), len(train)) if v == "<1>" else (two[u, v], one[v])
            s += math.log10((lm_trie.A * three[u, v, w] + two[v, w] + spread(v) * chance(w)) / (lm_trie.A * cuv + cv + spread(v)))
        return s

    by = {}
    for i, t in rows:
        by.setdefault((i, len(tokens(t))), []).append(score(t))
    for r in got:
        assert min(abs(r.score - s) for s in by[r.doc_id, r.n_tokens]) <= 0.02 * r.n_tokens
    fresh = [r for r in got if r.doc_id in held and r.n_tokens > 20]
    assert fresh and sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def test_lm_context_counts_are_the_words_own(spark, monkeypatch):
    """Words of two training texts that agree in the 22 upper bits of their hashes, one rare and one frequent, in many shards."""
    monkeypatch.setattr(lm_trie, "_SHARD_BYTES", 3000)
    some = tokenise(pa.array([" ".join(f"w{i}" for i in range(6000))], pa.large_string())).hashes()[0] >> np.uint64(42)
    order = np.argsort(some, kind="stable")
    at = int(np.flatnonzero(some[order][1:] == some[order][:-1])[0])
    rare, common = (f"w{i}" for i in order[at: at + 2])
    texts = [f"a {rare} b", " ".join([common, "x"] * 20), *(f"f{i} g{i} h{i} k{i} l{i}" for i in range(800))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, f"a {rare} b")], "doc_id long, text string")
    one = spark.createDataFrame([(i, t.replace(common, "q")) for i, t in enumerate(texts)] + [(-1, f"a {rare} b")], "doc_id long, text string")
    apart = {r.doc_id: r.score for r in lm_trie.score(one, F.col("doc_id") >= 0).collect()}
    got = {r.doc_id: r.score for r in lm_trie.score(df, F.col("doc_id") >= 0).collect()}
    assert abs(got[-1] - apart[-1]) < 0.02 and abs(got[0] - apart[0]) < 0.02


def test_lm_tries_are_kept_and_read_back(spark, docs):
    rows = lm_trie.train_tries(docs).collect()
    assert rows and all(elias_fano.Trie.from_buffer(r.trie).words[0].n > 0 for r in rows)


@pytest.mark.parametrize("k,share", [(3, 90), (5, 80), (1, 50)])
def test_similar_classes(spark, docs, k, share):
    rows = texts_of(docs)
    want = similar(rows, k, share)
    got = ngram_join.similar_classes(docs, k, share).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all(r.component_id == (None if r.doc_id is None else want[r.doc_id]) for r in got)


def test_similar_classes_of_many_near_copies(spark):
    """A family in which most pairs are just under or over the threshold, and sizes of one to sixty n-grams."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(250):
        w = list(base)
        for j in rng.choice(len(w), rng.integers(0, 5), replace=False):
            w[j] = f"x{rng.integers(0, 30)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[: 3 + i % 60] + [f"y{i // 60}"])) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = similar(rows, 3, 90)
    assert {r.doc_id: r.component_id for r in ngram_join.similar_classes(df, 3, 90).collect()} == want


def test_segment_keys_of_empty_fragments():
    """Sets within the threshold share a key, whatever their sizes: the pigeonhole holds."""
    rng = np.random.default_rng(2)
    for share in (80, 90):
        for n in (1, 2, 4, 5, 9, 10, 19, 40, 200):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                most = len(a) * (100 - share) // share
                drop = rng.integers(0, most + 1)
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, most - drop, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both < share * (len(a) + len(b) - both):
                    continue
                where, keys = ngram_join.segment_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), share)
                assert set(keys[where == 0].tolist()) & set(keys[where == 1].tolist())


def plain_keep_one(rows, words, share):
    """(doc_id, set) of the row that stays of each class, by comparing all sets; and the rows without a set or id, counted."""
    free = Counter((i, shingles(t, words)) for i, t in rows if i is None or not shingles(t, words))
    first = {}
    for i, t in rows:
        s = shingles(t, words)
        if i is not None and s:
            first[s] = min(first.get(s, i), i)
    sets = list(first)
    links = [(x, y) for x in range(len(sets)) for y in range(x) if 100 * len(sets[x] & sets[y]) >= share * len(sets[x] | sets[y])]
    classes = {}
    for x, root in components(range(len(sets)), links).items():
        classes.setdefault(root, []).append(sets[x])
    return [min(first[s] for s in own) for own in classes.values()], free


def test_keep_one_keeps_one_row_of_each_class(spark, docs):
    kept = ngram_join.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    want, free = plain_keep_one(texts_of(docs), 5, 80)
    got = [(r.doc_id, shingles(r.text, 5)) for r in kept.collect()]
    assert Counter(g for g in got if g[0] is None or not g[1]) == free
    assert Counter(i for i, s in got if i is not None and s) == Counter(want)


def test_keep_one_judges_rows_not_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    rows = [(1, a), (1, a), (2, a), (2, b), (3, c), (3, c.upper()), (4, b), (None, a), (5, ""), (5, b), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), (r.text or "").lower()) for r in ngram_join.keep_one(df).collect())
    assert got == sorted([("1", a), ("2", b), ("3", c), ("None", a), ("5", ""), ("5", "")])


def test_substring_dedup_of_large_ids_beside_nulls(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(2 ** 60 + 1, passage), (2 ** 60, passage), (None, passage), (2 ** 60 + 2, None)]
    out = substring_dedup.parse(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in out) == sorted([(str(2 ** 60), 0), (str(2 ** 60 + 1), 40), ("None", 0), (str(2 ** 60 + 2), 0)])


@pytest.mark.parametrize("k,block_bytes", [(13, 6 << 20), (13, 3000), (50, 3000)])
def test_substring_dedup(spark, docs, monkeypatch, k, block_bytes):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block_bytes)
    rows = texts_of(docs)
    want = Counter((i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest())
                   for i, w, g in cut_repeats(rows, k))
    out = substring_dedup.parse(docs, window=k).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == want
    source = {i: words(t) for i, t in rows if i is not None}
    for r in out:
        assert r.score == "x" and r.n == 1
        if not r.n_removed:
            assert (r.doc_id, r.text) in rows or not r.text
        else:
            assert hashlib.sha256(b" ".join(words(r.text))).hexdigest() == r.kept_sha256
        for f in r.factors:
            assert f.source < r.doc_id and f.length >= k
            assert source[f.source][f.source_start: f.source_start + f.length] == source[r.doc_id][f.start: f.start + f.length]


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary_path())
    rows = Counter((i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in texts_of(docs))
    got = packing.pack(docs, window=64).collect()
    places = Counter()
    pieces = {}
    for r in got:
        assert len(r.ids) == r.length > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        places.update((r.sequence_id, r.offset + x) for x in range(r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(r.ids)))
    assert max(places.values()) == 1 and max(x for _, x in places) < 64
    full = Counter(s for s, _ in places)
    assert all(max(x for s2, x in places if s2 == s) == n - 1 for s, n in full.items())  # gapless
    assert sum(n < 64 for n in full.values()) <= docs.rdd.getNumPartitions()
    copies = Counter()
    for (i, ids), n in rows.items():
        copies[i, len(ids)] += n
        parts = pieces[i, len(ids)]
        covered = Counter((s + x, v) for s, p in parts for x, v in enumerate(p))
        assert all(covered[x, v] >= n for x, v in enumerate(ids))
    assert {k: sum(len(p) for _, p in v) for k, v in pieces.items()} == {k: k[1] * n for k, n in copies.items()}


def test_best_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(0)
    w = packing.Windows(32, 0)
    for _ in range(300):
        size = int(rng.integers(1, 32))

        def cost(level):
            n = w.counts.copy()
            if level:
                n[level] -= 1
            if level + size < 32:
                n[level + size] += 1
            return int((n[1:] ** 2).sum())

        allowed = [0, *[h for h in range(1, 33 - size) if w.counts[h]]]
        assert cost(w.best_level(size)) == min(map(cost, allowed))
        w.add(0, np.zeros(size, np.int32))


def test_open_windows_end_in_parts():
    w = packing.Windows(4096, 0)
    for i in range(600):
        w.add(i, np.full(2100 + i, i, np.int32))
    parts = []
    for _ in w.finish():
        parts.append(w.done)
        w.done = []
    assert len(parts) > 3 and max(sum(len(p[2]) for p in part) for part in parts) < packing._GIVEN + 2 * 4096
    pieces = sorted((p for part in parts for p in part), key=lambda p: (p[4], p[5]))
    held, fill = Counter(), {}
    for doc, _, ids, _, number, offset in pieces:
        held[doc] += len(ids)
        assert offset == fill.get(number, 0)
        fill[number] = offset + len(ids)
    assert held == {i: 2100 + i for i in range(600)} and sum(n < 4096 for n in fill.values()) <= 1


def test_words_are_kept_from_task_to_task():
    import pyarrow as pa

    path = packing.vocabulary_path()
    texts = pa.array(["kept words, once", "once", ""], pa.large_string())
    first = packing.word_ids(path).encode(texts)
    words = packing.word_ids(path)
    words.tokenizer, tokenizer = None, words.tokenizer  # a known word does not go through the tokenizer again
    again = words.encode(texts)
    words.tokenizer = tokenizer
    assert first[0].tolist() == again[0].tolist() and first[1].tolist() == again[1].tolist()
    plain = [i for t in texts.to_pylist() for i in [*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID]]
    assert first[0].tolist() == plain


def test_pieces_equal_the_library_and_come_back(spark, docs, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as model_pb

    model = model_pb.ModelProto()
    model.ParseFromString(open(viterbi_pieces.vocabulary_path(), "rb").read())
    model.trainer_spec.model_type = 1  # the same scores, summed as a unigram model's
    for p in model.pieces:
        p.score = max(p.score, -40000.0)  # the library adds up in single precision
    path = str(tmp_path / "unigram.model")
    open(path, "wb").write(model.SerializeToString())
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), viterbi_pieces.Pieces(path)
    texts = [t or "" for _, t in texts_of(docs)]
    texts = [line for t in texts for line in t.split("\n")[:3]] + ["  a   b", " é日本語😀 x\t\ny", "a" * 70, "́", "x" * 400 + " y"]
    ids, at = ours.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t) for t in texts]
    assert ours.decode(ids, at) == texts
    coded = viterbi_pieces.encode(docs)
    back = viterbi_pieces.decode(coded)
    assert back.columns == [*docs.columns, "ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert [r.decoded for r in viterbi_pieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).collect()] == ["", ""]


def test_toxicity_learns_sentences_from_documents(spark):
    rng = np.random.default_rng(4)
    bad = ["grumble", "snarlwort", "vexing"]
    rows = []
    for i in range(600):
        s = [" ".join(f"w{rng.integers(0, 300)}" for _ in range(8)) for _ in range(6)]
        toxic = i % 4 == 0
        if toxic:
            at = int(rng.integers(0, 6))
            s[at] = s[at] + " " + bad[i // 4 % 3]
        rows.append((i, ". ".join(s) + ".", int(toxic)))
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(None, None, "c"), (900, "", "c"), (901, "w1 " * 20000, "c")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1), (7777, 1)], "doc_id long, toxic int")
    model = mil_toxicity.train(docs, labels)
    got = mil_toxicity.score(docs, model).collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "score", "predicted", "n_sentences", "offending"}
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.predicted == truth[r.doc_id] for r in held)
    for r in got:
        if not r.text:
            assert r.score == 0 and r.predicted == 0 and r.n_sentences == 0
        for span in r.offending:
            assert any(b in r.text[span.start: span.start + span.length] for b in bad)
        if r.predicted:
            assert len(r.offending) == 1
    kept = mil_toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 603 - 150
    none = mil_toxicity.train(docs, labels.where("toxic = 0"))
    assert {r.score for r in mil_toxicity.score(docs, none).collect()} == {0.0} or max(r.score for r in mil_toxicity.score(docs, none).collect()) < 1e-9


def test_rows_visit_the_toxicity_filter_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"fair speech {i}" if i % 2 else f"snarlwort {i}", "kept", None) for i in range(40)] + [(None, None, None, 7)],
                                 "doc_id long, text string, score string, predicted long")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int")
    sent, real = [], type(docs).mapInArrow

    def spy(self, *args):
        sent.append(self.schema.simpleString())
        return real(self, *args)

    monkeypatch.setattr(type(docs), "mapInArrow", spy)
    kept = mil_toxicity.drop_toxic(docs, labels)
    assert sent[-1].count("text:string") == 1  # twice, a batch took twice the memory
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.where("doc_id % 2 = 1 or doc_id is null").collect()))
    assert kept.schema == docs.schema


def plain_chance(model, text):
    """Noisy-or over the sentences of one text, word by word."""
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    clean = 1.0
    for sentence in re.split(r"[.!?\n]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
        found = set()
        for word in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence):
            raw = word.encode()
            found.update(int(part_hash(raw, kind)) for kind in range(1 + len(mil_toxicity.PREFIXES)))
        if found:
            clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(weight.get(f, 0.0) for f in found))))
    return 1 - clean


def part_hash(raw, kind=0):
    """The feature hash of a word (kind 0) or of one of its beginnings."""
    n = len(raw)
    texts = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, n], np.int64).tobytes()), pa.py_buffer(raw))
    return tokenise(texts, breaks=np.zeros(256, bool)).hashes(*mil_toxicity.PREFIXES)[kind][0]


def test_toxicity_scores_are_the_noisy_or_of_the_weights(spark, docs):
    rng = np.random.default_rng(9)
    texts = [(" ".join(f"w{rng.integers(0, 60)}" for _ in range(5)) + rng.choice([". ", "! ", "\n"])) * 3 + (" grumbling é" if i % 3 == 0 else "") for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = mil_toxicity.train(df, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int"))
    assert len(model.keys) and set(np.sort(model.keys).tolist()) == set(model.keys.tolist())
    for rows in (df.collect(), docs.collect()):
        got = mil_toxicity.score_texts(model, pa.array([r.text or "" for r in rows], pa.large_string()))[0]
        assert np.allclose(got, [plain_chance(model, r.text) for r in rows], atol=1e-12)


def test_toxicity_screening_equals_counting_by_hand(spark):
    """The features kept are the best by document counts; the driver gets hits on them alone."""
    rows = [(i, ("bad thing. " if i % 2 else "good thing. ") + f"word{i}", i % 2) for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = mil_toxicity.train(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert model.keys.tolist() == sorted(int(part_hash(b"bad", kind)) for kind in range(4))


def test_toxicity_of_one_id_with_two_texts_is_reproducible(spark):
    rows = [(i, f"{'foul' if i % 2 else 'fair'} words here {i}") for i in range(60)] + [(1, "another text"), (3, None)]
    labels = [(i, i % 2) for i in range(60)] + [(4, 1)]
    made = [mil_toxicity.train(spark.createDataFrame(rows[::step], "doc_id long, text string").repartition(n),
                               spark.createDataFrame(labels[::step], "doc_id long, toxic int")) for step, n in ((1, 1), (-1, 5))]
    assert made[0].keys.tolist() == made[1].keys.tolist() and np.allclose(made[0].weights, made[1].weights)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert lm_trie.score(none, F.lit(True)).count() == 0
    assert ngram_join.similar_classes(none).count() == 0
    assert substring_dedup.parse(none).count() == 0
    assert packing.pack(none).count() == 0
    assert viterbi_pieces.decode(viterbi_pieces.encode(none)).count() == 0
    assert mil_toxicity.score(none, mil_toxicity.train(none, labels)).count() == 0
    assert lm_trie.score(docs, F.lit(False)).where("n_known = 0").count() == docs.count()
