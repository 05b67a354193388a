"""Settings of runs: reading, checking and choosing them, on the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql import Column, SparkSession, functions as F

from tagweave.plans import files


@dataclass(frozen=True)
class Field:
    """What a setting may be: its type, bounds, choices, pattern, and whether a list of it must not repeat."""

    kind: type | tuple[type, ...]
    default: object = None
    required: bool = False
    low: float | None = None
    high: float | None = None
    choices: tuple = ()
    pattern: str | None = None
    items: Field | None = None
    unique: bool = False

    def faults(self, name: str, value) -> list[str]:
        if value is None:
            return [f"{name} is missing"] if self.required else []
        if not isinstance(value, self.kind) or isinstance(value, bool) and bool not in (self.kind if isinstance(self.kind, tuple) else (self.kind,)):
            return [f"{name} has the wrong type"]
        out = []
        if self.low is not None and value < self.low or self.high is not None and value > self.high:
            out.append(f"{name} is out of range")
        if self.choices and value not in self.choices:
            out.append(f"{name} must be one of {', '.join(map(str, self.choices))}")
        if self.pattern and not re.fullmatch(self.pattern, value):
            out.append(f"{name} holds characters that it may not")
        if self.items is not None:
            out += [f for v in value for f in self.items.faults(f"{name} item", v)]
            if self.unique and len(set(value)) < len(value):
                out.append(f"{name} repeats an item")
            if self.required and not value:
                out.append(f"{name} is empty")
        return out


@dataclass(frozen=True)
class Settings:
    """Fields by name, and rules over several of them, each a message and a test that must hold."""

    fields: Mapping[str, Field]
    rules: Sequence[tuple] = field(default=())

    def checked(self, given: Mapping) -> dict:
        """The settings with defaults filled in; all faults at once as one error."""
        faults = [f"{k} is unknown" for k in given if k not in self.fields]
        whole = {k: given.get(k, f.default) for k, f in self.fields.items()}
        faults += [x for k, f in self.fields.items() for x in f.faults(k, whole[k])]
        if not faults:
            faults = [message for message, holds in self.rules if not holds(whole)]
        if faults:
            raise ValueError("; ".join(faults))
        return whole

    def read(self, spark: SparkSession, path: str) -> dict:
        given = json.loads(files.read_text(spark, path))
        if not isinstance(given, dict):
            raise ValueError("settings must be a JSON object")
        return self.checked(given)

    def without_defaults(self, settings: Mapping) -> dict:
        """Settings that differ from their default, so that a plan stays the same when a setting is added."""
        return {k: v for k, v in settings.items() if k not in self.fields or v != self.fields[k].default or self.fields[k].required}


def chosen(names: Sequence[str], patterns: Sequence[str]) -> list[str]:
    """Names that fit any of the patterns, in their order; all without patterns. A pattern that fits none is an error."""
    for p in patterns:
        if not any(fnmatchcase(n, p) for n in names):
            raise ValueError(f"no name fits {p}")
    return [n for n in names if not patterns or any(fnmatchcase(n, p) for p in patterns)]


def problems(spark: SparkSession, configs: Sequence[Mapping], paths: Sequence[str]) -> list[str]:
    """What keeps configurations from running together: names that repeat, files (under the keys ``paths``) that are missing."""
    names = [c["name"] for c in configs]
    out = [f"{n} is the name of several" for n in sorted({n for n in names if names.count(n) > 1})]
    return out + [f"{c['name']} needs {c[p]}" for c in configs for p in paths if c.get(p) and not files.exists(spark, c[p])]


def averaged(average: Column, new: Column, weight: float) -> Column:
    """Weights of a running average, element by element: a share ``weight`` of the new ones."""
    return F.zip_with(average, new, lambda a, b: a + (b - a) * weight)


def schedule_factor(step: Column, total: int, warm_up: int) -> Column:
    """Factor of the learning rate: rises to 1 over the warm-up, then falls to 0 at the last step."""
    rising = step / F.lit(max(1, warm_up))
    return F.when(step < warm_up, rising).otherwise(F.greatest(F.lit(0.0), (F.lit(total) - step) / F.lit(max(1, total - warm_up)))).cast("double")
