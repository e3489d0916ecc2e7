"""The registered queries: each applies one operator to its whole table and derives the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import chat_format, decontaminate, hard_negatives, lm_trie, merkle, mil_toxicity, ngram_join, packing, pq_neardup, ranked_search, substring_dedup, url_rules, viterbi_pieces


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_trie.held_out(F.col("doc_id"))
    return lm_trie.score(docs, ~out).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = merkle.fingerprint_edits(table(spark, sf_dir, "documents"), ranges)
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                       F.col("edit.section").alias("edit_section"), F.col("edit.paragraph").alias("edit_paragraph"),
                       F.col("edit.piece").alias("edit_piece"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(said).alias("prompt"), F.lit(said).alias("response"))
    turns = chat_format.canonical_turns(rows).unionByName(chat_format.canonical_turns(extra))
    made = chat_format.format_chats(turns)
    read = made.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"),
                       chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("under_loss"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
                       F.length("under_loss").cast("bigint").alias("loss_chars"), F.sha2("under_loss", 256).alias("loss_sha256"),
                       "formatted_chars")


def op4_pq_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_neardup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(table(spark, sf_dir, "documents"), words=3, share=90)


def op6_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mil_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return mil_toxicity.score(docs, model).select(
        "doc_id", mil_toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_sentences", "offending")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules, ranges)


def op8_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(text, 256).alias("text_sha256"))
    coded = viterbi_pieces.encode(docs).select("doc_id", "text_sha256", "ids")
    return viterbi_pieces.decode(coded).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.parse(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256", "factors")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("spans").cast("bigint").alias("n_spans"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.usable(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = rows.select("vec_id", label.alias("label"), hard_negatives.whole_numbers(F.col("embedding")).alias("q"))
    return hard_negatives.mine(whole, F.col("vec_id") % 50 == 0)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
