"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from . import bpe, ctw, langid, merkle, mixing, quality, simhash, tokens_out, viterbi, warc
from .common import table


def op1_quality_rules(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op2_warc_archives(spark, sf_dir):
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op3_bpe_encode_decode(spark, sf_dir):
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op4_token_output(spark, sf_dir):
    return tokens_out.round_trip(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return viterbi.token_counts(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark, sf_dir):
    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    model = langid.TextModel.fit(table(spark, sf_dir, "documents"))
    return langid.identify_pages(table(spark, sf_dir, "pages"), model)


def op9_document_fingerprints(spark, sf_dir):
    return merkle.document_fingerprints(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_ALL = (
    op1_quality_rules,
    op2_warc_archives,
    op3_bpe_encode_decode,
    op4_token_output,
    op5_source_mixing,
    op6_token_counts,
    op7_lm_scoring,
    op8_language_id,
    op9_document_fingerprints,
    op10_simhash_near_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op1_quality_rules": quality.ORACLE_SQL, "op2_warc_archives": warc.ORACLE_SQL}
