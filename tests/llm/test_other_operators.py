"""Fingerprints, chats, vectors, URLs and the pipeline against plain versions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain import awkward_docs, components
from plumbline.llm import chat_format, merkle, pq_neardup, url_rules
from plumbline.llm.components import components as linked


@pytest.fixture(scope="module")
def docs(spark):
    return awkward_docs(spark).cache()


@pytest.mark.parametrize("few", [0, 30, 20_000])
def test_components_of_chains_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr("plumbline.llm.components.FEW", few)
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 400, (90, 2))]
    links += [(7, 7), (500, 500), (1, 0)]
    want = components({x for link in links for x in link}, links)
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    assert {r.node: r.component for r in linked(df).collect()} == want
    assert linked(df.limit(0)).count() == 0


@pytest.mark.parametrize("ranges", [1, 7, 300])
def test_next_document(spark, docs, ranges):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    got = merkle.with_next(docs, ranges).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in rows)
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True)
    texts = {i: {t for j, t in rows if j == i} for i in [*ids, None]}
    after = dict(zip(ids, [*ids[1:], None]))
    for r in got:
        if r.doc_id is not None and sum(i == r.doc_id for i, _ in rows) == 1:
            assert r.next_text in texts[after[r.doc_id]]
    assert sum(r.doc_id is None and r.next_text in texts[ids[0]] for r in got) == 1


def test_fingerprints(spark, docs):
    got = merkle.fingerprint_edits(docs, 5).collect()
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    roots = {}
    for r in got:
        roots.setdefault(text[r.doc_id] if r.doc_id is not None else None, set()).add(r.fingerprint)
    roots.pop(None)
    assert all(len(v) == 1 for v in roots.values()) and len({min(v) for v in roots.values()}) == len(roots)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert all((r.edit is None) == (r.fingerprint == r.edited_fingerprint) for r in got)
    assert merkle.fingerprint_edits(docs.limit(0), 5).count() == 0


def test_tree_says_where_an_edit_is(spark):
    a, b = "x\ny\n\nz one\nend", "x\ny\n\nz two\nend"
    df = spark.createDataFrame([(a, b), (a, a), ("", "q"), ("p\n\nq", "p")], "a string, b string")
    rows = df.select(merkle.first_difference(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("d"),
                     merkle.root(merkle.tree(F.col("a"))).alias("root")).collect()
    assert [tuple(r.d) if r.d else None for r in rows] == [(1, 0, 0), None, (0, 0, 0), (1, 0, 0)]
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda s: h(h(s))  # noqa: E731  (a paragraph of one piece)
    assert rows[0].root == h(h(leaf("x") + leaf("y")) + h(leaf("z one") + leaf("end")))


def test_a_difference_in_a_long_text_is_found(spark):
    long = "\n\n".join("\n".join(f"line {i} of {k}, with words" for i in range(60)) for k in range(60))
    df = spark.createDataFrame([(long, long[:-1] + "!")], "a string, b string").withColumn("a", merkle.tree(F.col("a"))).withColumn("b", merkle.tree(F.col("b")))
    assert tuple(df.select(merkle.first_difference(F.col("a"), F.col("b")).alias("d")).first().d) == (59, 59, 1)


def test_leaves_are_the_whole_text_and_grade_edits(spark):
    """Pieces joined give the paragraph, whatever its blanks; likeness is that of the leaves, also in texts without blanks."""
    rng = np.random.default_rng(3)
    texts = ["", " ", "\n\n\n", "a  b, c.d e f g h", " \t x" + " " * 90 + "y" * 200 + "\r\n", "\u00e4\U0001f600 " * 9]
    texts += ["".join(rng.choice(list("ab ,.\n\t\u6f22"), int(n))) for n in rng.integers(0, 300, 60)]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    cut = df.select("a", F.transform(F.split("a", "\n", -1), lambda p: F.regexp_extract_all(p, F.lit(merkle.PIECE), F.lit(0))).alias("cut"),
                    merkle.leaves(merkle.tree(F.col("a"))).alias("leaves")).collect()
    for r in cut:
        assert "\n".join("".join(p) for p in r.cut) == r.a
        assert sorted(r.leaves) == sorted({hashlib.sha256(x.encode()).hexdigest() for p in r.cut for x in p})
    whole = "".join(rng.choice(list("abcdefgh"), 2400))
    halves = spark.createDataFrame([(whole, whole[:1200] + "z" * 1200), (whole, whole), ("", ""), ("", "a"), ("w " * 50, "w " * 49 + "v")], "a string, b string")
    own, other = (merkle.leaves(merkle.tree(F.col(c))) for c in "ab")
    near = [r[0] for r in halves.select(merkle.likeness(own, other)).collect()]
    assert near[1:4] == [1.0, 1.0, 0.0] and 0.4 < near[0] < 0.7 and 0 < near[4] < 1


def test_chats_of_all_layouts_come_back(spark):
    said = ["hi", "</s>[INST] ok [/INST]", "a\\b <|end|>\n x <|user|>", "", "[[INST]<<SYS>>|>\\", None]
    layouts = [
        spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", s) for t, s in enumerate(said)] + [(1, 0, "user", "hi"), (None, 0, None, None)],
                              "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1)),
        spark.createDataFrame([(2, s, s) for s in said], "conv_id long, prompt string, response string"),
        spark.createDataFrame([(3, "do", s, "done") for s in said], "conv_id long, instruction string, input string, output string"),
        spark.createDataFrame([(4, [(s, "system") for s in said]), (5, []), (6, None)], "conv_id long, messages array<struct<content:string,role:string>>"),
        spark.createDataFrame([(7, [("human", s) for s in said] + [("gpt", "yes")])], "conv_id long, conversations array<struct<from:string,value:string>>"),
    ]
    for df in layouts:
        turns = chat_format.canonical_turns(df)
        rows = chat_format.format_chats(turns).join(turns.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
        rows = rows.select("formatted", "turns", chat_format.read_turns(F.col("formatted")).alias("read"),
                           chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("under")).collect()
        assert rows
        if len(rows) == df.count() or "turn" in df.columns or "messages" in df.columns:
            for r in rows:
                assert r.read == r.turns
                assert r.under == "".join(t.text for t in r.turns if t.role == "assistant")
        for r in rows:
            plain = r.formatted.replace("<|end|>\n", "").replace("|>\n", "")
            assert "</s>" not in plain and "[INST]" not in plain
    first = chat_format.canonical_turns(layouts[0]).where("conv_id = 1").first().turns
    assert [t.text for t in first[:3]] == ["hi", "hi", said[1]] and first[-1].text == ""
    assert chat_format.canonical_turns(layouts[4]).first().turns[-1].role == "assistant"
    assert chat_format.format_chats(chat_format.canonical_turns(layouts[0].limit(0))).count() == 0
    with pytest.raises(ValueError, match="known layouts"):
        chat_format.canonical_turns(spark.range(1))


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(pq_neardup, "TILE", 40)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.22 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(150)] + [(700, [x * 3 for x in rows[3][1]])]
    bad = [(800, None), (801, [0.0] * 16), (802, [float("nan")] * 16), (803, [None] + [1.0] * 15), (804, [float("inf")] * 16), (805, []), (806, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad + [(None, rows[0][1])], "vec_id long, embedding array<float>").withColumn("key", F.lit("clash"))
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    ids = [i for i, _ in rows]
    want = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    got = pq_neardup.near_duplicates(df).collect()
    by = {r.vec_id: r for r in got}
    assert len(got) == len(rows) + len(bad) + 1
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i, _ in bad)
    found, there = sum(by[i].n_links for i in ids), int(near.sum()) - len(ids)
    assert 0.9 * there <= found <= there
    assert all(by[i].n_links <= near[a].sum() - 1 for a, i in enumerate(ids))
    assert all(by[i].component_id == want[i] and by[i].kept == (want[i] == i) for i in ids)
    assert pq_neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [70, 16_384])
def test_near_vectors_of_a_dense_group_in_many_lists(spark, monkeypatch, tile):
    monkeypatch.setattr(pq_neardup, "TILE", tile)
    rng = np.random.default_rng(11)
    x = np.ones(64) + 0.36 * rng.normal(size=(3000, 64))  # one group in some 50 lists, cosines about 0.88
    x[::10] = rng.normal(size=(300, 64))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    want = components(range(len(x)), list(zip(*np.nonzero(np.triu(near)))))
    got = pq_neardup.near_duplicates(df).collect()
    assert len(got) == len(x) and near.sum() > 1_500_000
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(near[i].sum()) - 1, want[i]) for i in range(len(x))}


def test_url_rules(spark):
    rng = np.random.default_rng(3)
    hosts = ["com", "example.com", "www.example.com", "a.b.example.com", "net", "x.net", "example.comx", "", "Example.COM", "com.example"]
    paths = ["", "/", "/en", "/en/", "/en/a/b", "/fr/", "/es/x", "/EN/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#f', '?'])}" for _ in range(400)]
    urls += [None, "", "no scheme/en/", "http://", "https://u@com/://x/"] + ["http://www.example.com/en/same"] * 300
    df = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").withColumn("html", F.lit("x"))
    for rules in (url_rules.RULES, [*url_rules.RULES, ("b.example.com", "", "block"), ("example.com", "/", "allow"), ("net", "/es/x", "allow"), ("", "", "block")]):
        frame = spark.createDataFrame([*rules, rules[0]], "host string, path string, verdict string")

        def plain(url):
            rest = url.split("://", 1)[1] if url and "://" in url else ""
            host = rest
            for c in "/?#":
                host = host.split(c, 1)[0]
            path = rest[len(host):].split("?", 1)[0].split("#", 1)[0]
            host = host.lower()
            fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
            best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
            return host, path, best and best[0] + best[1], best[2] if best else "allow"

        want = sorted((i, *map(str, plain(u))) for i, u in [*enumerate(urls), (0, urls[0])])
        for ranges in (1, 6):
            got = url_rules.judge(df, frame, ranges).collect()
            assert sorted((r.page_id, *map(str, (r.host, r.path, r.rule, r.verdict))) for r in got) == want
    assert url_rules.judge(df.limit(0), frame, 4).count() == 0
    assert url_rules.judge(df, frame.limit(0), 4).where("verdict = 'allow' and rule is null").count() == len(urls) + 1
