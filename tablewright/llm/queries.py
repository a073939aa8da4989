"""Registered queries of the operators, one opN_<name> for each, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

import corpus_pipeline
from tablewright.llm import collocations, mixing, ranked_search, url_filter
from tablewright.llm.decontaminate import benchmark_hits
from tablewright.llm.knn_quality import neighbour_scores
from tablewright.llm.licenses import license_scan
from tablewright.llm.line_align import drop_aligned_lines
from tablewright.llm.near_dup import near_duplicates
from tablewright.llm.quality_rules import quality_votes
from tablewright.llm.repeats import remove_repeats
from tablewright.llm.shared import shared_folder
from tablewright.llm.surrogates import replace_personal_data
from tablewright.llm.token_output import token_digests
from workload.base import read, register


@register("op2_quality_rules")
def op2(spark, sf_dir):
    return quality_votes(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good")


@register("op5_mixing", mixing.ORACLE)
def op5(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op7_near_duplicates")
def op7(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"), words=4)


@register("op8_licenses")
def op8(spark, sf_dir):
    return license_scan(read(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op9_token_output")
def op9(spark, sf_dir):
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return token_digests(read(spark, sf_dir, "documents"), tokenizer_path(), folder)


@register("op10_repeats")
def op10(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register("op1_decontamination")
def op1(spark, sf_dir):
    return benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register("op6_quality_classifier")
def op6(spark, sf_dir):
    return neighbour_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register("op3_surrogates")
def op3(spark, sf_dir):
    return replace_personal_data(read(spark, sf_dir, "documents"), "key of the registered query", all_rows=True)


@register("op4_line_alignment")
def op4(spark, sf_dir):
    return drop_aligned_lines(read(spark, sf_dir, "documents"))


@register("op11_url_filter", url_filter.ORACLE)
def op11(spark, sf_dir):
    return url_filter.url_verdicts(read(spark, sf_dir, "pages"))


@register("op12_collocations", collocations.ORACLE)
def op12(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents"))


@register("op13_ranked_search", ranked_search.ORACLE)
def op13(spark, sf_dir):
    return ranked_search.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


register("pipeline")(corpus_pipeline.run)
