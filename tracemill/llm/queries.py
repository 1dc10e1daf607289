"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, lang_id, line_dedup, minhash, packing, pii, quality, toxicity, url_filter
from .common import table

#: File of ranks below public_tokenizers; a parameter of the operators.
RANKS = "byte_bpe_multi_50k.tiktoken"


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def op1_decontaminate(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark, sf_dir):
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.verdicts(url_filter.sample_captures(pages), url_filter.sample_entries(pages))


def op5_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), ranks_path())


def op6_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op7_minhash(spark, sf_dir):
    return minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_first")


def op8_pii(spark, sf_dir):
    return pii.digests(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), ranks_path())


def queries():
    return {f.__name__: f for f in (op1_decontaminate, op2_language_id, op3_quality_rules, op4_url_filter, op5_packing, op6_line_dedup, op7_minhash, op8_pii, op9_toxicity, op10_bpe)}


def oracle_sql():
    return {"op4_url_filter": url_filter.SQL}
