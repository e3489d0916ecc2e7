"""Document fingerprints: a Merkle tree over the sections, paragraphs and pieces of a text, and the likeness of two trees, in column expressions.

Sections are parted by an empty line, paragraphs by a line break, and a paragraph
is cut into pieces of up to four words, also after punctuation and inside words of
more than 24 characters; the parts joined again give the text.  A piece's digest,
the leaf, is the SHA-256 of its text, a paragraph's that of its leaves, a section's that of its
paragraphs' digests, the root's that of its sections' digests: equal roots mean
equal texts, and where roots differ, the branches that differ say where the edit is, down
to the piece.  The likeness of two trees is the share of distinct leaves they have in
common (twice the common ones over the sum of both).

Defined results: a null text is empty, and an empty text has one empty section
and paragraph and no leaves; trees without leaves are alike to degree 1 among themselves and 0 to
others; equal rows get equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# up to three words that end in no punctuation with the gaps after them, then one word or 24 characters of it, and its gap
_GAP = r" \t\r\f\x0B"
PIECE = (rf"(?:[^{_GAP}\n]{{0,23}}[^{_GAP}\n.!?,;][{_GAP}]{{1,24}}){{0,3}}[^{_GAP}\n]{{1,24}}[{_GAP}]{{0,24}}|[{_GAP}]{{1,24}}")


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def tree(text: Column) -> Column:
    """Sections with their digests and paragraphs; each paragraph has a digest and its leaves, the pieces' digests."""
    def paragraph(p: Column) -> Column:
        return F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda piece: F.sha2(piece, 256))

    def with_digests(leaves: Column) -> Column:
        return F.transform(leaves, lambda own: F.struct(_digest(own).alias("digest"), own.alias("leaves")))

    paragraphs = F.transform(F.split(text, "\n\n", -1), lambda s: with_digests(F.transform(F.split(s, "\n", -1), paragraph)))
    return F.transform(paragraphs, lambda s: F.struct(_digest(s["digest"]).alias("digest"), s.alias("paragraphs")))


def root(sections: Column) -> Column:
    return _digest(sections["digest"])


def leaves(sections: Column) -> Column:
    """The distinct leaves of a tree."""
    return F.array_distinct(F.flatten(F.transform(sections, lambda s: F.flatten(s["paragraphs"]["leaves"]))))


def likeness(a: Column, b: Column) -> Column:
    """Share of common leaves, 0 to 1, of two arrays of distinct leaves."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / both)


def _bound(body, **values: Column) -> Column:
    """``body`` of a struct of the values, each of which is worked out once, however often the body reads it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 0)


def _first(a: Column, b: Column) -> Column:
    """Place, from 0, of the first entry in which two arrays differ, the longer one's rest included; null when equal."""
    def place(v: Column) -> Column:
        last = F.greatest(F.coalesce(F.size(v["a"]), F.lit(0)), F.coalesce(F.size(v["b"]), F.lit(0))) - 1
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.get(F.filter(places, lambda i: ~F.get(v["a"], i).eqNullSafe(F.get(v["b"], i))), 0)

    return _bound(place, a=a, b=b)


def first_difference(a: Column, b: Column) -> Column:
    """Struct (section, paragraph, piece), from 0, of the first differing branch of two trees; null when equal.

    Only the first branch whose digests differ is opened on each level; the piece is null where one
    tree has no such paragraph or it has no leaves there.
    """
    def in_section(v: Column) -> Column:
        return _bound(in_paragraph, a=F.get(v["a"], v["s"])["paragraphs"], b=F.get(v["b"], v["s"])["paragraphs"], s=v["s"])

    def in_paragraph(v: Column) -> Column:
        return _bound(in_leaves, a=v["a"], b=v["b"], s=v["s"], p=_first(v["a"]["digest"], v["b"]["digest"]))

    def in_leaves(v: Column) -> Column:
        piece = _first(F.get(v["a"], v["p"])["leaves"], F.get(v["b"], v["p"])["leaves"])
        return F.when(v["s"].isNotNull(), F.struct(v["s"].alias("section"), v["p"].alias("paragraph"), piece.alias("piece")))

    return _bound(in_section, a=a, b=b, s=_first(a["digest"], b["digest"]))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (doc_id, text, next_text): the text after it in descending doc_id, and the first one's after the last.

    Rows are dealt over ranges of doc_id; the top row of each range is also sent to the range above it, so no
    window spans the table and texts are shuffled once.  Rows of one doc_id follow each other by text hash;
    null ids come last.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    borders = sorted({int(c) for c in cuts})
    steps = [1 << i for i in reversed(range(len(borders).bit_length()))]
    table = F.array(*[F.lit(b) for b in borders])
    place = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda low, s: F.when(
        (low + s <= len(borders)) & (F.get(table, low + s - 1) <= F.col("doc_id")), low + s).otherwise(low)) if borders else F.lit(0)
    placed = docs.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(place))
    tops = placed.groupBy("range").agg(F.max("doc_id").alias("top")).orderBy("range").collect()  # one row per range
    if not tops:
        return docs.select("doc_id", "text", F.lit("").alias("next_text"))
    filled = [t.range for t in tops]
    above = dict(zip(filled, filled[1:] + filled[:1]))
    top, target = ({t.range: v for t, v in zip(tops, values)} for values in ([t.top for t in tops], [above[r] for r in filled]))
    size = len(borders) + 1
    top_of = F.get(F.array(*[F.lit(top.get(r)).cast("bigint") for r in range(size)]), F.col("range"))
    target_of = F.get(F.array(*[F.lit(target.get(r)).cast("int") for r in range(size)]), F.col("range"))
    here = F.struct(F.col("range"), F.lit(0).alias("sent"))
    sent = F.struct(target_of.alias("range"), F.lit(1).alias("sent"))
    dealt = (placed.withColumn("to", F.explode(F.when(F.col("doc_id").eqNullSafe(top_of), F.array(here, sent)).otherwise(F.array(here))))
             .select("doc_id", "text", "to.*"))
    order = Window.partitionBy("range").orderBy("sent", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("sent = 0").select("doc_id", "text", "next_text")


def fingerprint_edits(docs: DataFrame, ranges: int) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the beginning of the next document."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    made = (with_next(docs, ranges)
            .withColumn("edited", edited)
            .withColumn("tree", tree(F.col("text"))).withColumn("edited_tree", tree(F.col("edited")))
            .withColumn("own", leaves(F.col("tree"))).withColumn("other", leaves(F.col("edited_tree")))
            .withColumn("following", leaves(tree(F.col("next_text")))))
    return made.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        root(F.col("tree")).alias("fingerprint"), root(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
        first_difference(F.col("tree"), F.col("edited_tree")).alias("edit"))
