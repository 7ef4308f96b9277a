"""Preference-data plan, first half: clean the sampled responses, count tags
by position, drop samples with rare tags (SURVEY 3.2 steps 2-3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.operators import freq, parse
from tagweave.sources import derived


def r6(c):
    return F.round(F.col(c), 6).alias(c)


def cleaned_records(spark, sf_dir):
    return parse.clean_responses(derived.generation_records(spark, sf_dir))


def normalise_tags(spark, sf_dir):
    return parse.normalised_tags(derived.generation_records(spark, sf_dir))


def tag_variant_map(spark, sf_dir):
    return parse.variant_map(normalise_tags(spark, sf_dir))


def _filter(spark, sf_dir, min_freq=2):
    return freq.rare_filter(cleaned_records(spark, sf_dir), min_freq=min_freq)


def tag_freq(spark, sf_dir):
    return _filter(spark, sf_dir)["freq"]


def rare_filter_kept(spark, sf_dir):
    return _filter(spark, sf_dir)["kept"].select("index", "file_name")


def rare_filter_reasons(spark, sf_dir):
    return _filter(spark, sf_dir)["removed"]


def rare_filter_stats(spark, sf_dir):
    s = _filter(spark, sf_dir)["stats"]
    return s.select("original_count", "kept_count", "removed_count", r6("retention_pct"))


def filter_top_tags(spark, sf_dir):
    """O-T1 for the filter report: positions 0-2 are checked (every tag with
    its pass flag), position 3 is not (its 10 most frequent tags)."""
    checked = [0, 1, 2]
    f = freq.rare_filter(preference_cleaned(spark, sf_dir), min_freq=2, positions=checked)
    return freq.top_tags(f["freq"], 10, checked=checked, min_freq=2).select("pos", "rank", "tag", "n", "passes")


def preference_cleaned(spark, sf_dir):
    return cleaned_records(spark, sf_dir)
