"""The registered queries ``opN_<name>`` and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from velocis.llm import (
    byte_bpe, cover_substring, digest_merge, gram_spelling, jump_align, learned_ann, pareto_mix, pii_bilstm,
    simhash_trie, token_counts, vector_pack, warc_zst, weak_quality,
)
from velocis.sources.tables import read_table


def op1_weak_quality(spark, sf_dir):
    return weak_quality.quality(read_table(spark, sf_dir, "documents"))


def op2_simhash_trie(spark, sf_dir):
    return simhash_trie.simhash_components(read_table(spark, sf_dir, "documents"))


def op3_warc_zst(spark, sf_dir):
    return warc_zst.round_trip(read_table(spark, sf_dir, "pages"))


def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_byte_bpe(spark, sf_dir):
    out = byte_bpe.encode_texts(read_table(spark, sf_dir, "documents"),
                                public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


def op6_learned_ann(spark, sf_dir):
    return learned_ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op7_pii_bilstm(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return pii_bilstm.digest(pii_bilstm.find_pii(docs, pii_bilstm.fit(docs)))


def op8_digest_merge(spark, sf_dir):
    return digest_merge.exact_dedup(read_table(spark, sf_dir, "documents"))


def op9_pareto_mix(spark, sf_dir):
    return pareto_mix.mix(read_table(spark, sf_dir, "documents"))


def op10_cover_substring(spark, sf_dir):
    out = cover_substring.substring_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_vector_pack(spark, sf_dir):
    out = vector_pack.pack_documents(read_table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                      "offset")


def op12_gram_spelling(spark, sf_dir):
    return gram_spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_jump_align(spark, sf_dir):
    return jump_align.align_tokenizers(read_table(spark, sf_dir, "documents"),
                                       public_tokenizers.path("byte_bpe_50k.json"),
                                       public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_weak_quality, op2_simhash_trie, op3_warc_zst, op4_token_counts, op5_byte_bpe,
    op6_learned_ann, op7_pii_bilstm, op8_digest_merge, op9_pareto_mix,
    op10_cover_substring, op11_vector_pack, op12_gram_spelling,
    op13_jump_align)}

ORACLE = {
    "op3_warc_zst": warc_zst.ORACLE,
    "op8_digest_merge": digest_merge.ORACLE,
    "op9_pareto_mix": pareto_mix.ORACLE,
    "op10_cover_substring": cover_substring.ORACLE,
}
