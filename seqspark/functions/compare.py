"""Sums of floating-point numbers depend on their order: where a compared column is such a sum, the comparison sees it to ten digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Significant digits that are compared.
DIGITS = 10

#: Columns that are sums, means, logarithms or interpolations of floating-point numbers. All others are compared as they are.
INEXACT = {
    "aai_one_way": "identity sd",
    "aai_two_way": "identity sd",
    "aasubs_bootstrap": "ratio",
    "aasubs_permutation": "ratio",
    "aasubs_ratio": "ratio",
    "alpha_diversity": "shannon inv_simpson qd",
    "alpha_qd": "qd",
    "alpha_rao": "rao",
    "ani_corrected": "identity sd",
    "ani_two_way": "identity sd",
    "anir": "anir",
    "barplot_top": "percent",
    "chao1": "chao1 lower upper",
    "cov_tad": "tad",
    "cov_tad_total": "tad",
    "cov_zip": "mean variance lam pi",
    "fastq_expected_error": "mu var",
    "fastq_observed_error": "mu var",
    "gmm_one_peak": "mean sd",
    "haai": "haai sd",
    "hits_weighted_sum_norm": "total",
    "identity_by_pair": "identity sd",
    "kaks": "n_sites s_sites ka ks ratio",
    "og_core_pan_random": "core_sd pan_sd",
    "og_stats": "entropy",
    "prefscore": "expected score",
    "rand_index": "rand adjusted",
    "recplot_anir": "anir",
    "recplot_compare": "hellinger bhattacharyya kl euclidean",
    "recplot_legacy": "mean q25 median q75",
    "sample_moments": "mean var sd skewness kurtosis",
    "sarle_bimodality": "sarle",
    "snp_filter": "shannon",
    "snp_summary": "information",
    "tree_placements": "d",
    "trib_hist": "p_over p_under",
    "trib_whole": "median",
    "truncated_mean": "mean",
}


def rounded(name: str, f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query with its inexact columns at ten significant digits."""
    columns = INEXACT.get(name, "").split()
    if not columns:
        return f
    near = lambda c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{DIGITS - 1}e", F.col(c).cast("double")).cast("double"))
    return lambda spark, folder: f(spark, folder).withColumns({c: near(c) for c in columns})


def rounded_sql(name: str, sql: str) -> str:
    columns = INEXACT.get(name, "").split()
    if not columns:
        return sql
    near = ", ".join(f"CAST(printf('%.{DIGITS - 1}e', CAST({c} AS double)) AS double) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({near}) FROM ({sql})"
