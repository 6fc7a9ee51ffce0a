"""The four stages as one call each; every function takes frames and returns frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.config import PanelConfig
from gridloom.functions.lineage import cut
from gridloom.operators import classify, cluster, eda, features, panel, stats, temporal
from gridloom.schema import nan_to_null, numeric_columns, resolve_columns, to_long


class Tables(Mapping):
    """Tables by name, each made when it is first asked for: some take passes over the rows before they are read."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def build_panel(months: list[DataFrame], static: list[DataFrame], census: DataFrame | None, units: DataFrame | None = None, monthly: list[DataFrame] = ()) -> DataFrame:
    """Stage 1: months together, further sensors by (unit, month), static attributes and census by unit, one row
    per (unit, month): the first, in the order of the months' frames. Joins check their keys; a join that leaves almost everything missing is an error."""
    base = nan_to_null(panel.union_all(months)).withColumn("__row", F.monotonically_increasing_id())
    for extra in monthly:
        base = panel.join_many_to_one(base, extra, ["unit_id", "month"])
    for table in static:
        base = panel.join_many_to_one(base, table, ["unit_id"])
    if census is not None:
        joined = [c for c in census.columns if c not in base.columns]
        base = panel.join_many_to_one(base, census, ["unit_id"])
        if joined and not panel.join_health(base, joined).first()["passes"]:
            raise ValueError("the census join matched almost no unit")
    base = panel.collapse_suffixes(base)
    if units is not None:
        base = base.join(units.select("unit_id"), "unit_id", "left_semi")
    return panel.keep_first(base, ["unit_id", "month"], ["__row"]).drop("__row")


def explore(df: DataFrame, config: PanelConfig, group: str = "pref_name") -> dict[str, DataFrame]:
    """Stage 2: all exploratory tables of a panel."""
    columns = numeric_columns(df)
    pairs = eda.correlation_matrix(df, columns)
    out = {
        "basic_statistics": eda.describe(df, columns),
        "distribution_statistics": eda.distribution_summary(df, columns),
        "missing_data_summary": eda.missing_summary(df, columns, config.missing_flag_pct),
        "outlier_summary": eda.outlier_summary(df, columns, config.iqr_factor),
        "correlations": pairs,
        "high_correlations": eda.high_correlations(pairs, config.high_correlation),
        "temporal_coverage": temporal.coverage(df, resolve_columns(df, config.temporal) or columns, gap_days=config.gap_days),
        "heatmap": eda.heatmap(df, group, columns) if group in df.columns else eda.missing_summary(df, columns),
        "unit_trends": temporal.with_days(df).groupBy("unit_id").agg(*temporal.trend_slopes(resolve_columns(df, config.temporal) or columns, config.min_trend_points)),
    }
    if group in df.columns:
        out |= {"statistics_by_group": eda.group_stats(df, group, columns), "missing_by_group": eda.missing_summary(df, columns, config.missing_flag_pct, [group])}
    amplitude = temporal.seasonal_amplitude(df, resolve_columns(df, config.temporal) or columns)
    expected = [*config.identifiers, *config.temporal, *config.static]
    texture = [c for c in df.columns if "_contrast" in c or "_entropy" in c or "_homogeneity" in c]
    out["quality_checks"] = eda.quality_checks(out["missing_data_summary"], pairs, out["outlier_summary"], out["temporal_coverage"], out["distribution_statistics"], expected, df.columns, texture, config.missing_flag_pct, config.high_correlation)
    out["key_findings"] = eda.key_findings(out["missing_data_summary"], out["distribution_statistics"], pairs, amplitude, pairs, config.high_correlation)
    out["quality_flags"] = eda.quality_flags(out["missing_data_summary"], out["outlier_summary"], out["temporal_coverage"], config.missing_flag_pct, texture=texture)
    return out


def preprocess(df: DataFrame, config: PanelConfig, ratio: str | None = None) -> dict[str, DataFrame]:
    """Stage 3: cross-section, ratios, target, drops, transforms: ``ready``, ``parameters``, ``metadata``."""
    ratio = ratio or config.target_ratio
    kept = panel.drop_columns(df, config.drop)
    varying = resolve_columns(kept, config.temporal)
    flat = temporal.cross_section(kept, varying, resolve_columns(kept, config.static), min_points=config.min_trend_points)
    labelled = features.build_target(features.demographic_ratios(flat), ratio, config.target_thresholds, config.target_labels)
    columns = numeric_columns(labelled, ["unit_id", "target_code", ratio])
    ready, parameters, logged = features.transform(labelled, columns, config.log1p)
    metadata = features.feature_metadata(ready, ["unit_id", "pref_name"], ["target_class", "target_code"], logged, columns)
    return {"ready": ready, "parameters": parameters, "metadata": metadata}


def evaluate(df: DataFrame, columns: list[str], models: list[str] | None = None, folds: int = 5, group: str | None = None, repeats: int = 5) -> dict[str, DataFrame]:
    """Stage 4a: models (all that are registered, if none are named) on ``df (id, label, columns)``, cross-validated over
    ``repeats`` splits; models that can fit all folds in the same passes do."""
    split = classify.group_folds(df, group, "label", folds, repeats) if group else classify.stratified_folds(df, "label", F.xxhash64("id"), folds, repeats=repeats)
    predictions = classify.cross_validate(split, columns, classify.batched_models(models or list(classify.REGISTRY)))
    metrics = classify.fold_metrics(predictions, ["model", "fold"])
    return {
        "predictions": predictions,
        "fold_metrics": metrics,
        "model_comparison": classify.comparison(metrics),
        "per_class_metrics": classify.per_class(predictions, ["model"]),
        "confusion": classify.confusion(predictions, ["model"]),
        "pairwise_tests": stats.pairwise_tests(metrics, "model", "fold", "balanced_accuracy"),
    }


def typology(df: DataFrame, columns: list[str], k: int) -> Mapping[str, DataFrame]:
    """Stage 4b: clusters of ``df (id, columns)`` with their evaluation."""
    scaled = cut(features.scale(df, features.scaler_parameters(df, columns, "standard")))
    labelled = cut(cluster.assigned(scaled, columns, cluster.best_fits(scaled, columns, [k])[k]))
    raw = df.join(labelled.select("id", "cluster"), "id")
    return Tables(
        {
            "assignments": lambda: labelled.select("id", "cluster").join(cluster.silhouette_samples(labelled, columns).select("id", "silhouette"), "id"),
            "profiles": lambda: cluster.profiles(raw, columns),
            "kruskal_wallis": lambda: stats.kruskal_p(stats.kruskal_wallis(to_long(raw, ["cluster"], columns), "cluster")),
            "correlations": lambda: stats.correlation_p(eda.correlation_matrix(df, columns)),
        }
    )
