"""Validated configuration of the two datasets' pipelines."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

OPERATIONS = ("suppress", "pseudonymize", "k_anonymize", "dp")


@dataclass(frozen=True)
class Privacy:
    """Differential privacy of one grouped query.

    ``clamp``: values are brought into the range that the sensitivity assumes. ``halved``: errors of category
    means at the scales that the mechanism uses. ``draws``: these errors by so many draws instead of the closed
    form. ``redact_true``: true answers are not published.
    """

    query: str = "mean"
    epsilon: float = 1.0
    epsilon_step: float = 0.1
    output_attribute: str = ""
    aggregate: tuple[str, ...] = ()
    selected: str | None = None
    least: float = 0.0
    most: float = 50.0
    threshold: float = 60.0
    clamp: bool = False
    halved: bool = False
    draws: int = 0
    redact_true: bool = False

    def __post_init__(self):
        if self.query not in ("mean", "count"):
            raise ValueError("query is mean or count")
        if self.epsilon <= 0 or self.epsilon_step <= 0:
            raise ValueError("epsilon and its step are positive")
        if not self.output_attribute or not self.aggregate:
            raise ValueError("a query needs an output attribute and what to group by")
        if self.draws < 0 or (self.draws and self.halved):
            raise ValueError("draws are not negative, and drawn errors are at whole epsilons")


@dataclass(frozen=True)
class KAnonymity:
    attribute: str = "Age"
    k: int = 500
    least: int = 0
    most: int = 101
    strict: bool = False

    def __post_init__(self):
        if self.k < 1 or self.most - self.least < 2:
            raise ValueError("k is positive and the domain not empty")


@dataclass(frozen=True)
class Config:
    """``data_type`` chooses the pipeline, ``operations`` what it does; nothing else runs.

    ``pseudonym_key``: pseudonyms by HMAC, of any number of columns. ``noise_key``: noise that this secret and the query decide, the same at each read.
    """

    data_type: str
    operations: tuple[str, ...]
    suppress: tuple[str, ...] = ()
    pseudonymize: tuple[str, ...] = ()
    k_anonymize: KAnonymity | None = None
    privacy: Privacy | None = None
    time: str = "observationDateTime"
    place: str = "location.coordinates"
    resolution: int = 7
    hours: tuple[int, int] = (9, 20)
    plate: str = "license_plate"
    events_per_day: int = 30
    dedup_scope: str = "file"
    salt: str = ""
    separator: str = ""
    strict_pseudonyms: bool = False
    cells: str = "grid"
    pseudonym_key: str = ""
    noise_key: str = ""
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.data_type not in ("medical", "spatioTemporal"):
            raise ValueError("data_type is medical or spatioTemporal")
        unknown = set(self.operations) - set(OPERATIONS)
        if unknown or not self.operations:
            raise ValueError(f"operations are some of {', '.join(OPERATIONS)}")
        needs = {"suppress": self.suppress, "pseudonymize": self.pseudonymize, "k_anonymize": self.k_anonymize, "dp": self.privacy}
        if missing := [o for o in self.operations if not needs[o]]:
            raise ValueError(f"no settings for {', '.join(missing)}")
        if "k_anonymize" in self.operations and self.data_type != "medical":
            raise ValueError("k_anonymize is for medical data")
        if self.dedup_scope not in ("file", "global"):
            raise ValueError("dedup_scope is file or global")
        if self.cells not in ("grid", "hex", "h3"):
            raise ValueError("cells are grid, hex or h3")

    @classmethod
    def load(cls, path: str, **choice) -> Config:
        return cls.of(json.loads(Path(path).read_text()), **choice)

    @classmethod
    def of(cls, raw: dict, dataset: str | None = None, operations: tuple[str, ...] = (), query: str | None = None) -> Config:
        """From fields of this class, or from sections ``medical`` and ``spatioTemporal`` of a dataset each.

        ``dataset`` chooses another section than ``data_type`` does, ``operations`` some of what is set, ``query`` a
        preset: for medical data with its attributes, else the kind of query.
        """
        raw = dict(raw)
        if dataset:
            raw["data_type"] = dataset
        kind = raw.get("data_type")
        if isinstance(raw.get(kind), dict):
            raw = _fields(kind, raw[kind])
        if operations:
            raw["operations"] = tuple(operations)
        if query and "privacy" in raw:
            raw["privacy"] = {**raw["privacy"], **({"query": query} if kind != "medical" else MEDICAL[query])}
        for name, kind in (("k_anonymize", KAnonymity), ("privacy", Privacy)):
            if isinstance(raw.get(name), dict):
                raw[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw[name].items()})
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})

    def only(self, *operations: str) -> Config:
        return replace(self, operations=operations)


def _given(section: dict, **names: str) -> dict:
    return {ours: section[theirs] for ours, theirs in names.items() if theirs in section}


def _fields(kind: str, section: dict) -> dict:
    """A dataset's section under the names of the fields of ``Config``; its operations are all that it has settings for."""
    out = {"data_type": kind, **_given(section, suppress="suppress", pseudonymize="pseudonymize")}
    if bins := section.get("k_anonymize"):
        out["k_anonymize"] = {**_given(section, attribute="generalize"), **_given(bins, attribute="generalize", k="k", least="min_bin_value", most="max_bin_value", strict="strict")}
    if place := section.get("spatial_generalize"):
        out |= _given(place, place="spatial_attribute", resolution="h3_resolution", plate="filter_attribute", events_per_day="filter_event_occurences", cells="cells")
        if set(place.get("filter_attribute_by", TILE_DAY)) != set(TILE_DAY):
            raise ValueError(f"tiles are supported by {' and '.join(TILE_DAY)}")
    if time := section.get("temporal_generalize"):
        out |= _given(time, time="temporal_attribute")
        out["hours"] = (time.get("start_time", 9), time.get("end_time", 20))
    if dp := section.get("differential_privacy"):
        group = dp.get("dp_aggregate_attribute", ())
        found = _given(dp, query="dp_query", output_attribute="dp_output_attribute", selected="dp_selected_output", epsilon="dp_epsilon", epsilon_step="dp_epsilon_step",
                       threshold="dp_query_value_threshold", least="global_min_value", clamp="clamp", halved="halved", draws="draws", redact_true="redact_true")
        for name in ("dp_max_value_sensitivity", "dp_max_value_output_attribute", "global_max_value"):
            found |= _given(dp, most=name)
        out["privacy"] = found | {"aggregate": [group] if isinstance(group, str) else list(group)}
        if kind == "spatioTemporal" and {*group} != {*TILE_DAY, out.get("plate", "license_plate")}:
            raise ValueError("events are grouped by tile, date and the attribute that supports tiles")
    out["operations"] = tuple(o for o in OPERATIONS if out.get("privacy" if o == "dp" else o))
    return out


#: What the pipeline itself makes for the support of a tile.
TILE_DAY = ("HAT", "Date")
#: The query presets of medical data.
MEDICAL = {
    "count": {"query": "count", "output_attribute": "Test Result", "aggregate": ("PIN Code",), "selected": "Positive"},
    "mean": {"query": "mean", "output_attribute": "Days To Negative", "aggregate": ("Gender",)},
}
MEDICAL_COUNT = Privacy(**MEDICAL["count"])
MEDICAL_MEAN = Privacy(**MEDICAL["mean"], most=50.0)
