"""Plugin boundary for models and media: a provider is a callable on batches, run in Arrow batches next to the data.

Nothing is downloaded or bundled; the deterministic provider serves tests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[pd.Series], pd.Series]
_REGISTRY: dict[str, Callable[..., Provider]] = {}


def register(name: str) -> Callable:
    def keep(factory: Callable[..., Provider]) -> Callable[..., Provider]:
        _REGISTRY[name] = factory
        return factory

    return keep


def provider(name: str, **options) -> Provider:
    """The provider of a name; an unknown name is an error that lists the known ones."""
    if name not in _REGISTRY:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name](**options)


@register("echo")
def _echo(prefix: str = "") -> Provider:
    """Deterministic: a prefix and a digest of the prompt."""
    return lambda prompts: prompts.map(lambda p: None if p is None else f"{prefix}{hashlib.sha256(p.encode()).hexdigest()[:8]}")


def applied(rows: DataFrame, prompt: str, into: str, name: str, **options) -> DataFrame:
    """rows with what a provider makes of each prompt. The provider is built once per task, not once per row."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = provider(name, **options)
        for pdf in batches:
            yield pdf.assign(**{into: made(pdf[prompt])})

    return rows.mapInPandas(run, f"{fields}, `{into}` string")


def parsed_json(answer: Column, schema: str) -> Column:
    """A model's answer as a struct: parsed as it is, else from its first block in braces; null if neither parses."""
    whole = F.from_json(answer, schema)
    block = F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), schema)
    ok = lambda s: F.coalesce(F.size(F.filter(F.map_values(F.from_json(F.to_json(s), "map<string,string>")), lambda v: v.isNotNull())), F.lit(0)) > 0
    return F.when(ok(whole), whole).otherwise(block)
