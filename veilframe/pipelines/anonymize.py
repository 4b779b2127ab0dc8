"""The pipelines: a configuration and a frame in, named frames out. No action runs in here but the k-anonymity width's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from veilframe.config import Config
from veilframe.functions.columns import clip_lower, clip_upper
from veilframe.operators import aggregates, kanon, privacy, transforms


def common(df: DataFrame, config: Config) -> DataFrame:
    """Duplicates go, then suppression and pseudonyms as asked for. Rows come in the order of ``_row``, made here."""
    scope = ["file"] if config.dedup_scope == "file" and "file" in df.columns else []
    out = transforms.deduplicate(df.withColumn("_row", F.monotonically_increasing_id()), ["_row"], scope).drop("_row")
    if "suppress" in config.operations:
        out = transforms.suppress(out, config.suppress)
    if "pseudonymize" in config.operations:
        out = transforms.pseudonymize(out, config.pseudonymize, salt=config.salt, separator=config.separator, strict=config.strict_pseudonyms, key=config.pseudonym_key.encode())
    return out.drop("file")


def tiles(df: DataFrame, config: Config) -> DataFrame:
    """Rows of a batch or a stream with their tile and ``license_plate``; hours are filtered before cells are made."""
    p = config.privacy
    rows = transforms.filter_hours(transforms.generalize_time(df, config.time), *config.hours)
    if p.clamp:
        rows = rows.withColumn(p.output_attribute, clip_lower(clip_upper(F.col(f"`{p.output_attribute}`"), p.most), p.least))
    placed = transforms.generalize_place(rows, config.place, config.resolution, indexer=transforms.INDEXERS[config.cells])
    return transforms.add_tile(placed).withColumnRenamed(config.plate, "license_plate")


def grain(df: DataFrame, config: Config) -> DataFrame:
    """Accumulated rows per tile, date and plate of supported tiles."""
    return aggregates.supported(aggregates.accumulate(tiles(df, config), config.privacy.output_attribute), config.events_per_day)


def _noise(config: Config, *keys: str) -> privacy.Uniform:
    """Fresh noise, or by the secret key, the query with its bounds, and the rows' group."""
    p = config.privacy
    return privacy.secret(config.noise_key.encode(), f"{config.data_type}|{p}", *keys) if config.noise_key else privacy.fresh()


def spatiotemporal(df: DataFrame, config: Config, uniform: privacy.Uniform | None = None, seen: dict[str, Observation] | None = None) -> dict[str, DataFrame]:
    out: dict[str, DataFrame] = {}
    if {"suppress", "pseudonymize"} & set(config.operations):
        out["anonymized"] = aggregates.observed(common(df, config), seen, "anonymized")
    if "dp" in config.operations:
        p, uniform = config.privacy, uniform or _noise(config, "HAT")
        rows = aggregates.observed(grain(df.drop("file"), config), seen, "supported", ["HAT", "Date"])
        grid = privacy.epsilon_grid(df.sparkSession, 1.0, 30.0, config.privacy.epsilon_step)
        if p.query == "mean":
            means = privacy.with_sensitivity(aggregates.mean_query(rows), p.least, p.most)
            noisy = privacy.noised_tile_mean(means, p.epsilon, uniform)
            out["errors_by_tile"] = privacy.scale_table(means, grid, "HAT")
            out["errors"] = privacy.mean_scale(out["errors_by_tile"])
        else:
            noisy = privacy.noised_count(aggregates.count_query(rows, p.threshold), p.epsilon, uniform)
            out["errors"] = privacy.count_scale(grid)
        done = privacy.post_process(noisy, p.query).select("HAT", "query_output", "noisy_output")
        out["noisy"] = privacy.published(done, p.query, p.output_attribute, p.redact_true)
    return out


def medical(df: DataFrame, config: Config, uniform: privacy.Uniform | None = None, seen: dict[str, Observation] | None = None) -> dict[str, DataFrame]:
    out: dict[str, DataFrame] = {}
    if {"suppress", "pseudonymize"} & set(config.operations):
        out["anonymized"] = aggregates.observed(common(df, config), seen, "anonymized")
    if "k_anonymize" in config.operations:
        k = config.k_anonymize
        hist = aggregates.histogram(df, k.attribute, k.least, k.most)
        bins = kanon.width(hist, k.k, k.attribute, k.least)
        out["k_anonymous"] = aggregates.observed(kanon.assign(df.drop("file"), k.attribute, bins, k.least, k.most, k.strict), seen, "k_anonymous", [f"{k.attribute} Bin"])
        out["k_counts"] = kanon.assign(hist, k.attribute, bins, k.least, k.most, k.strict)
    if "dp" in config.operations:
        p, uniform = config.privacy, uniform or _noise(config, *config.privacy.aggregate)
        (group,), grid = p.aggregate, privacy.epsilon_grid(df.sparkSession, 0.01, 10.0, p.epsilon_step)
        if p.query == "count":
            noisy = privacy.noised_count(aggregates.category_count(df, group, p.output_attribute, p.selected), p.epsilon, uniform)
            out["errors"] = privacy.count_scale(grid)
        else:
            means = aggregates.category_mean(df, group, p.output_attribute, p.most, 0.0 if p.clamp else None)
            noisy = privacy.noised_category_mean(means, p.epsilon, p.most, uniform)
            out["errors"] = privacy.mean_error_simulated(means, grid, p.most, p.draws) if p.draws else privacy.mean_error_analytic(means, grid, p.most, p.halved)
        out["noisy"] = privacy.published(privacy.post_process(noisy, p.query), p.query, p.output_attribute, p.redact_true)
    return out


def run(df: DataFrame, config: Config, uniform: privacy.Uniform | None = None, seen: dict[str, Observation] | None = None) -> dict[str, DataFrame]:
    """The frames by name. ``seen``, if given, is filled with observations that the first action on a frame completes."""
    return (medical if config.data_type == "medical" else spatiotemporal)(df, config, uniform, seen)
