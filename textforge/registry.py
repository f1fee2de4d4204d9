"""Model registry: how each model family wants its chat prompt."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ModelConfig:
    model_key: str
    path: str
    supports_system: bool
    system_message: str
    user_message_template: str
    include_title_in_user: bool = False
    title_prefix: str = "Title:"


# Instruction texts and the model list, in lookup order.
SYSTEM_MESSAGE = (
    "You will generate one cooking recipe. List all necessary ingredients and give detailed steps."
)
USER_TEMPLATE = "Include ingredients: {ner}"
DEFAULT_REGISTRY: tuple[ModelConfig, ...] = (
    ModelConfig("llama", "meta-llama/Llama-3.2-1B-Instruct", True, SYSTEM_MESSAGE, USER_TEMPLATE),
    ModelConfig("mistral", "mistralai/Mistral-7B-Instruct-v0.3", False, SYSTEM_MESSAGE, USER_TEMPLATE),
    ModelConfig("gemma", "google/gemma-2-9b-it", False, SYSTEM_MESSAGE, USER_TEMPLATE),
    ModelConfig("qwen", "Qwen/Qwen2.5-7B-Instruct", True, SYSTEM_MESSAGE, USER_TEMPLATE),
    ModelConfig("olmo", "allenai/OLMoE-1B-7B-0924-Instruct", False, SYSTEM_MESSAGE, USER_TEMPLATE),
)
DEFAULT_KEY = "llama"


def get_model(key: str, registry: Sequence[ModelConfig] = DEFAULT_REGISTRY) -> ModelConfig:
    """Driver-side exact lookup, ignoring case."""
    for entry in registry:
        if entry.model_key == key.lower():
            return entry
    names = ", ".join(e.model_key for e in registry)
    raise ValueError(f"unknown model {key!r}; the registry has: {names}")


def get_model_for_path(path: str, registry: Sequence[ModelConfig] = DEFAULT_REGISTRY) -> ModelConfig:
    """Driver-side substring lookup; the first registry key found in the path wins."""
    lowered = path.lower()
    hits = [e for e in registry if e.model_key in lowered]
    return hits[0] if hits else get_model(DEFAULT_KEY, registry)


def as_struct(entry: ModelConfig) -> Column:
    return F.struct(*[F.lit(value).alias(name) for name, value in asdict(entry).items()])


def registry_array(registry: Sequence[ModelConfig] = DEFAULT_REGISTRY) -> Column:
    """The whole registry as one array literal; explode it to pair each row with each model."""
    return F.array(*[as_struct(e) for e in registry])


def _as_map(registry: Sequence[ModelConfig]) -> Column:
    return F.create_map(*[part for e in registry for part in (F.lit(e.model_key), as_struct(e))])


def config_for_key(name: Column, registry: Sequence[ModelConfig] = DEFAULT_REGISTRY) -> Column:
    """Exact lookup per row as a literal map: no join, no shuffle. Unknown names fail the job."""
    found = F.try_element_at(_as_map(registry), F.lower(name))
    names = ", ".join(e.model_key for e in registry)
    message = F.concat(
        F.lit("unknown model "), F.coalesce(name, F.lit("null")), F.lit(f"; the registry has: {names}")
    )
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(message))


def key_for_path(path: Column, registry: Sequence[ModelConfig] = DEFAULT_REGISTRY) -> Column:
    """Registry key contained in a model path, first match in registry order; null if none."""
    lowered = F.lower(path)
    return F.coalesce(*[F.when(lowered.contains(e.model_key), F.lit(e.model_key)) for e in registry])


def config_for_path(path: Column, registry: Sequence[ModelConfig] = DEFAULT_REGISTRY) -> Column:
    """Substring lookup per row; paths without a hit get the default model (see ``is_default_path``)."""
    key = F.coalesce(key_for_path(path, registry), F.lit(DEFAULT_KEY))
    return F.element_at(_as_map(registry), key)


def is_default_path(path: Column, registry: Sequence[ModelConfig] = DEFAULT_REGISTRY) -> Column:
    return key_for_path(path, registry).isNull()
