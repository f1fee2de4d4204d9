"""Driver-side options, built from already parsed configuration dictionaries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Mapping

SampleCount = int | str | None  # a number, or "all" / None for everything


def safe_name(name: str) -> str:
    """A dataset or model name as one filesystem-safe path segment."""
    return name.translate(str.maketrans("/:", "__"))


def dataset_path(name: str, base_dir: str) -> str:
    return f"{base_dir.rstrip('/')}/{safe_name(name)}"


@dataclass(frozen=True)
class FieldMap:
    """Which source column plays which role."""

    input: str = "NER"
    output: str = "directions"
    title: str = "title"
    ingredients: str = "ingredients"

    @classmethod
    def from_config(cls, mapping: Mapping[str, str] | None) -> "FieldMap":
        known = cls.__dataclass_fields__
        return cls(**{k: v for k, v in (mapping or {}).items() if k in known})


@dataclass(frozen=True)
class PrepOptions:
    """Where the samples come from and how many of each split are wanted."""

    name: str
    train: SampleCount = "all"
    validation: SampleCount = "all"
    test: SampleCount = "all"
    seed: int = 42
    val_size: float = 0.05
    filter_invalid: bool = True
    require_test: bool = True
    base_model: str = ""
    max_length: int | None = 512
    fields: FieldMap = field(default_factory=FieldMap)

    @classmethod
    def from_config(cls, config: Mapping[str, Any]) -> "PrepOptions":
        """Read either configuration dialect; ``dataset`` wins over ``datasets``."""
        if "dataset" in config:
            source = config["dataset"]
            counts = source.get("splits", {})
            read = dict(
                name=source["name"],
                train=counts.get("train", "all"),
                validation=counts.get("validation", "all"),
                test=counts.get("test", "all"),
                seed=source.get("seed", 42),
            )
        elif isinstance(config.get("datasets"), list):
            source = config["datasets"][0]
            read = dict(
                name=source["path"],
                train=config.get("train_samples", "all"),
                validation=config.get("val_samples", "all"),
                test=config.get("test_samples", "all"),
                seed=config.get("seed", 42),
            )
        else:
            raise KeyError("configuration names neither 'dataset' nor 'datasets'")
        return cls(
            val_size=source.get("val_size", 0.05),
            fields=FieldMap.from_config(source.get("field_map")),
            base_model=config.get("base_model", ""),
            max_length=config.get("sequence_len", 512),
            **read,
        )


@dataclass(frozen=True)
class SuiteOptions:
    """Which evaluation phases run, and how many items per task."""

    enable_benchmarks: bool = False
    enable_domain: bool = False
    enable_operational: bool = False
    per_subject: int = 0
    subjects: tuple[str, ...] = ()
    completion_items: int = 0

    @classmethod
    def from_config(cls, config: Mapping[str, Any]) -> "SuiteOptions":
        return cls(
            enable_benchmarks=bool(config.get("enable_benchmarks", False)),
            enable_domain=bool(config.get("enable_domain", False)),
            enable_operational=bool(config.get("enable_operational", False)),
            per_subject=int(config.get("mmlu_samples", 0)),
            subjects=tuple(config.get("mmlu_subjects", ())),
            completion_items=int(config.get("hellaswag_samples", 0)),
        )

    @property
    def configured_items(self) -> int:
        """The nominal item count: limit times number of subjects."""
        return self.per_subject * len(self.subjects)
