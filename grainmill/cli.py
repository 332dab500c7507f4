"""Command line: writes the reports of one study as CSV tables, a folder each.

    python -m grainmill quality --tables /data/sf --out /data/reports
    python -m grainmill list

Studies are groups of the registered queries; ``--only`` picks some of a study's reports.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from grainmill.plans import registry
from grainmill.sources.tables import write_csv

#: Reports of each study.
STUDIES: dict[str, tuple[str, ...]] = {
    "quality": ("decode_issues", "source_audit", "identity_conflicts", "membership_masks", "balanced_reference", "weighted_bounds", "domain_medians", "utility_audit", "utility_coverage", "critic_weights", "quality_scores", "domain_summary", "domain_intervals", "scenario_means", "extension_comparison", "conflict_pairs_datasets", "permutation_pairs", "factor_analysis", "correlation_matrix"),
    "schemes": ("scheme_weights", "scheme_weight_intervals", "scheme_scores", "scheme_summary", "scheme_comparison", "scheme_extension", "shrinkage_sensitivity", "inner_sensitivity", "normalisation_sensitivity", "group_redundancy", "rank_map"),
    "baseline": ("equal_baseline", "baseline_comparison"),
    "mixtures": ("pair_audit", "mixture_pairs", "domain_support", "pair_support", "grid_cv", "model_evaluation", "ranking_regret", "fitted_replacement", "fitted_combination", "combination_extremes", "extrapolation_ratios", "extrapolation_errors", "quality_bridge", "text_coverage"),
    "signals": ("sample_coverage", "signal_join_audit", "signal_audit", "signal_audit_by_domain", "accepted_signals", "profile_missingness", "text_signals"),
    "transfer": ("domain_profiles", "similarity_weights", "similarity_sensitivity", "completed_map", "anchor_validation", "lodo_transfer", "transfer_gate", "proxy_calibration"),
    "bridge": ("bridge_profiles", "bridge_weights", "bridge_sensitivity", "bridge_anchors", "bridge_gate", "bridge_domains", "direct_lodo", "direct_gate", "direct_domain_stats", "quality_routes"),
    "losses": ("variant_cv", "variant_metrics", "variant_output_metrics", "ranking_stability", "gain_intervals", "gain_decision", "placebo_quality", "alternative_refits", "recipe_coverage"),
    "design": ("design_audit", "centred_benchmark", "near_duplicates", "median_bandwidth"),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="grainmill", description=__doc__.split("\n")[0])
    p.add_argument("study", choices=[*STUDIES, "list"])
    p.add_argument("--tables", help="folder of the Parquet tables")
    p.add_argument("--out", help="folder of the reports; existing reports of the same name are replaced")
    p.add_argument("--only", nargs="+", metavar="REPORT", help="reports of the study to write")
    p.add_argument("--master", help="Spark master; by default that of the environment")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs one study; returns the names of the reports written."""
    args = parser().parse_args(argv)
    if args.study == "list":
        print("\n".join(f"{k}: {' '.join(v)}" for k, v in STUDIES.items()))
        return []
    if not args.tables or not args.out:
        parser().error("--tables and --out are needed")
    names = args.only or STUDIES[args.study]
    if unknown := set(names) - set(STUDIES[args.study]):
        parser().error(f"not in {args.study}: {' '.join(sorted(unknown))}")
    builder = SparkSession.builder.appName(f"grainmill {args.study}").config("spark.sql.session.timeZone", "UTC")
    spark = spark or (builder.master(args.master) if args.master else builder).getOrCreate()
    for name in names:
        began = time.time()
        write_csv(registry.queries()[name](spark, args.tables), f"{args.out}/{name}")
        print(f"{name} {time.time() - began:.1f} s", flush=True)
    return list(names)
