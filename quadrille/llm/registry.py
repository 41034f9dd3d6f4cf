"""The corpus queries and their SQL."""

from __future__ import annotations

from quadrille.llm import bpe, chat, exact_dedup, html, langid, minhash, mixing, quality, statements, substring, suffixes
from quadrille.session import table


def tokenizer_path(name="byte_bpe_multi_50k.tiktoken"):
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85, shingle=3)


def op2_language_id(spark, sf_dir):
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op4_substring_dedup(spark, sf_dir):
    return substring.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_chat_format(spark, sf_dir):
    return chat.render(table(spark, sf_dir, "conversations"))


def op6_suffix_array_dedup(spark, sf_dir):
    return suffixes.suffix_dedup_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_html_extraction(spark, sf_dir):
    return html.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_quality_rules(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def language_id_of_pages(spark, sf_dir):
    return langid.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


QUERIES = (
    op1_minhash_near_dedup,
    op2_language_id,
    op3_byte_bpe,
    op4_substring_dedup,
    op5_chat_format,
    op6_suffix_array_dedup,
    op7_mixing,
    op8_exact_dedup,
    op9_html_extraction,
    op10_quality_rules,
    language_id_of_pages,
)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return {
        "op1_minhash_near_dedup": statements.NEAR,
        "op4_substring_dedup": statements.WINDOWS,
        "op5_chat_format": chat.ORACLE,
        "op6_suffix_array_dedup": statements.BYTES,
        "op7_mixing": mixing.ORACLE,
        "op8_exact_dedup": exact_dedup.ORACLE,
        "op10_quality_rules": statements.QUALITY,
    }
