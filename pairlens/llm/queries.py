"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import ball_tree_search, bpe_trie, chat_events, line_join, line_rules, pack_nnls, phrase_tries, pii_crf, png_column, simhash_ball
from pairlens.llm import token_resync, url_lm, warc_chunks
from pairlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_pii_crf(spark, sf):
    return pii_crf.detect(table(spark, sf, "documents"))


@query
def op2_pack_nnls(spark, sf):
    return pack_nnls.pack(table(spark, sf, "documents"))


@query
def op3_token_resync(spark, sf):
    return token_resync.count_tokens(table(spark, sf, "documents"))


@query
def op4_warc_chunks(spark, sf):
    read = warc_chunks.read_records(warc_chunks.write_records(table(spark, sf, "pages")))
    return warc_chunks.intact(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_line_join(spark, sf):
    return line_join.line_classes(table(spark, sf, "documents"))


@query
def op6_png_column(spark, sf):
    return png_column.features(png_column.store(table(spark, sf, "documents")))


@query
def op7_bpe_trie(spark, sf):
    return bpe_trie.round_trip(table(spark, sf, "documents"))


@query
def op8_simhash_ball(spark, sf):
    found = simhash_ball.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash_ball.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op9_url_lm(spark, sf):
    return url_lm.judged(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op10_line_rules(spark, sf):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return line_rules.judged(table(spark, sf, "documents")).select(*names)


@query
def op11_chat_events(spark, sf):
    given = table(spark, sf, "conversations")
    own = spark.createDataFrame([(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(["user", "assistant"])], "conv_id long, turn long, role string, text string")
    log = chat_events.log_of(given).unionByName(chat_events.log_of(own, part=1))
    return chat_events.read_back(chat_events.render(chat_events.messages(log)))


@query
def op12_ball_tree(spark, sf):
    return ball_tree_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op13_phrase_tries(spark, sf):
    return phrase_tries.collocations(table(spark, sf, "documents"))
