"""Registry of the driver queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.plans import evaluation, files, judging, preference, reports, roundtrip, semantic, sft

_PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_stage_counts": evaluation.parse_stage_counts,
    "parsed_tag_rows": evaluation.parsed_tag_rows,
    "exact_prf_by_doc": evaluation.exact_prf_by_doc,
    "file_metrics_exact": evaluation.file_metrics_exact,
    "overall_macro": evaluation.overall_macro,
    "failed_cases": evaluation.failed_cases,
    "normalise_tags": preference.normalise_tags,
    "tag_variant_map": preference.tag_variant_map,
    "tag_freq": preference.tag_freq,
    "rare_filter_kept": preference.rare_filter_kept,
    "rare_filter_reasons": preference.rare_filter_reasons,
    "rare_filter_stats": preference.rare_filter_stats,
    "tag_distribution": reports.tag_distribution,
    "topic_top30": reports.topic_top30,
    "generation_quality": reports.generation_quality,
    "position_compare": reports.position_compare,
    **{f.__name__: f for f in (
        files.json_document_rows, files.tolerant_reader_rows, files.tolerant_reader_rejects, files.judge_input_rows,
        files.preference_dir_rows, files.positional_record_rows,
        files.row_range_rows, files.concat_counts, files.evaluate_files_metrics, files.resume_twice,
        files.running_tag_counts, files.generation_record_rows, files.sft_run_record,
        files.resume_failed_rounds, files.generation_job, files.first_failed_cases, sft.subword_truncation, sft.subword_budget,
        sft.template_prompts, roundtrip.concurrent_responses, semantic.embedding_cache_reuse)},
    "judge_model_outcomes": judging.judge_model_outcomes,
    "semantic_missing_vectors": semantic.semantic_missing_vectors,
    "encoded_tags": semantic.encoded_tags,
    "judge_outcomes": judging.judge_outcomes,
    "judge_kept_scores": judging.judge_kept_scores,
    "judge_averages": judging.judge_averages,
    "export_dpo": judging.export_dpo,
    "export_weighted": judging.export_weighted,
    "export_ppo": judging.export_ppo,
    "weighted_loss": judging.weighted_loss,
    "rule_judge_outcomes": judging.rule_judge_outcomes,
    "semantic_by_record": semantic.semantic_by_record,
    "semantic_best_match": semantic.semantic_best_match,
    "semantic_file_metrics": semantic.semantic_file_metrics,
    "prompt_build": sft.prompt_build,
    "truncate_head_tail": sft.truncate_head_tail,
    "token_budget": sft.token_budget,
    "per_file_limit": sft.per_file_limit,
    "hash_split": sft.hash_split,
    "prefix_split": sft.prefix_split,
    "eval_sample": sft.eval_sample,
    "difference_score_top": sft.difference_score_top,
    "resume_remaining": sft.resume_remaining,
    "run_delta": sft.run_delta,
    "sft_extract_f1": sft.sft_extract_f1,
    "two_temperature_responses": roundtrip.two_temperature_responses,
    "jsonl_roundtrip": roundtrip.jsonl_roundtrip,
    "preference_file_load": roundtrip.preference_file_load,
    "labelled_judgements": judging.labelled_judgements,
    "filter_top_tags": preference.filter_top_tags,
    "report_long_form": reports.report_long_form,
    "rows_per_file": reports.rows_per_file,
    "sft_targets": sft.sft_targets,
    "semantic_doc_file_metrics": semantic.semantic_doc_file_metrics,
    "prompt_truncation_counts": sft.prompt_truncation_counts,
    "preference_load_reasons": roundtrip.preference_load_reasons,
}


def _bigint_outputs(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Output contract of the registry: integer columns are BIGINT."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        return df.select(*[F.col(f.name).cast("bigint").alias(f.name)
                           if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else F.col(f.name)
                           for f in df.schema.fields])
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _bigint_outputs(v) for k, v in _PLANS.items()}

