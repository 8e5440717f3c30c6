"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from hazeflow.llm import decontaminate, divergence, merkle, mil_quality, paragraph_sketch, reply_trees, simhash, spelling, suffix_dedup, twins, url_reputation, virtual_slots, warc, word_bpe
from hazeflow.llm.queries import query, table
from hazeflow.scratch import scratch_path


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_benchmark_decontamination")
def op9_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.col("found")["items"]
    return found.select(
        "doc_id",
        F.col("found")["n_words"].alias("n_words"),
        decontaminate.n_hit(F.col("found")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("found")).alias("contaminated"),
    )


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file, of bounded size; by default the public one that the query is defined by."""
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def token_digests(docs, path=None):
    return word_bpe.encode(docs, tokenizer_json(path), decoded=True).select(
        "doc_id",
        word_bpe.n_tokens(F.col("ids")).alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_bpe_encoding_and_decoding")
def op8_bpe_encoding_and_decoding(spark, sf_dir):
    return token_digests(table(spark, sf_dir, "documents"))


@query("op10_suffix_array_dedup")
def op10_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("version")


@query("op7_attention_quality_classifier")
def op7_attention_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mil_quality.scored(docs, mil_quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op6_distribution_divergence", twins.DIVERGENCE)
def op6_distribution_divergence(spark, sf_dir):
    return divergence.judged(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


@query("op1_host_reputation", twins.URL_REPUTATION)
def op1_host_reputation(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    outcomes = url_reputation.page_outcomes(pages, table(spark, sf_dir, "labels"))
    return url_reputation.judged(pages, outcomes).drop("rate", "upper")


@query("op5_virtual_slot_sharding")
def op5_virtual_slot_sharding(spark, sf_dir):
    return virtual_slots.sharded(table(spark, sf_dir, "documents"), scratch_path(spark, "slot-map"))


@query("op3_warc_transactions")
def op3_warc_transactions(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"), scratch_path(spark, "archives"))


CONTROL_STRINGS = "<|im_end|><|im_start|>assistant ok"


@query("op4_reply_trees", twins.REPLY_TREES)
def op4_reply_trees(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", CONTROL_STRINGS), (-1, 1, "assistant", CONTROL_STRINGS)], rows.schema)
    formatted = reply_trees.formatted_branches(reply_trees.turns_as_trees(rows.unionByName(added)))
    turns, loss = reply_trees.read_back(F.col("formatted")), reply_trees.loss_text(F.col("formatted"), F.col("loss_spans"))
    read = formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op13_spelling_variants")
def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), drop_every=spelling.DROP_EVERY)


@query("op11_merkle_manifest", twins.MERKLE)
def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(merkle.TAMPER_EVERY)) == 0)


@query("op12_paragraph_sketches")
def op12_paragraph_sketches(spark, sf_dir):
    return paragraph_sketch.fingerprints(table(spark, sf_dir, "documents"))
