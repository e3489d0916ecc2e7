"""The whole pipeline against its stages written out plainly, on awkward and on empty tables."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from plain import awkward_docs, cut_repeats
from plumbline.llm import packing
from test_text_operators import plain_keep_one, shingles


def folder_of(path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("toxic", [False, True])
def test_run_equals_the_stages_by_hand(spark, tmp_path, toxic):
    docs = awkward_docs(spark)
    bad = spark.createDataFrame([(1000 + i, f"some words {i} and snarlwort grumbling {i * 7}", "x", "y", 1, None) for i in range(40)], docs.schema)
    clean = spark.createDataFrame([(2000 + i, f"only fair speech number {i} of {i * i} here", "x", "y", 1, None) for i in range(60)], docs.schema)
    docs = docs.unionByName(clean)
    labels = spark.createDataFrame([(1000 + i, 1) for i in range(40)] + [(2000 + i, 0) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    path = folder_of(tmp_path, docs.unionByName(bad) if toxic else docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]  # the toxic ones go, all others stay
    first, free = plain_keep_one(rows, 5, 80)
    keep, left = Counter(first), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if i is None or not shingles(t, 5):
            left.append((i, t))
        elif keep[i]:
            keep[i] -= 1
            left.append((i, t))
    assert sum(free.values()) + len(first) == len(left)
    kept = [(i, [w for w, g in zip(own, gone) if not g]) for i, own, gone in cut_repeats(left, 50) if not own or not all(gone)]
    got = corpus_pipeline.run(spark, path).collect()

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter((i, len(tokenizer.encode(" ".join(w.decode() for w in own), add_special_tokens=False).ids) + 1) for i, own in kept)
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    pieces, sequences = defaultdict(int), defaultdict(list)
    for r in got:
        pieces[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == r.length
    assert {i: sum(n * c for (j, n), c in want.items() if j == i) for i, _ in want} == dict(pieces)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_run_on_empty_tables(spark, tmp_path):
    docs = awkward_docs(spark)
    path = folder_of(tmp_path, docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert corpus_pipeline.run(spark, path).count() == 0


def test_stages_are_the_agreed_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "sequences"]
