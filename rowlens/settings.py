"""Settings: the option groups as one JSON file, with values of the environment and of the Spark session on top."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import fields
from pathlib import Path

from pyspark.sql import SparkSession

from .options import CompareOptions, MatchOptions, NormalizeOptions, ReadOptions, ValidationOptions

GROUPS = {"compare": CompareOptions, "match": MatchOptions, "normalize": NormalizeOptions, "read": ReadOptions, "validation": ValidationOptions}
#: Options that hold functions or schemas: they are set in code only.
CODE_ONLY = {"comparators", "schema"}


def _names(group: str) -> set[str]:
    return {f.name for f in fields(GROUPS[group])} - CODE_ONLY


def _plain(value):
    """A value as JSON has it: sets in order, tuples as lists."""
    if isinstance(value, (set, frozenset)):
        return sorted(value)
    return list(value) if isinstance(value, tuple) else value


def _typed(group: str, name: str, value):
    """A JSON value as the option's default has it."""
    default = getattr(GROUPS[group](), name)
    if isinstance(default, (tuple, frozenset)):
        if not isinstance(value, list):
            raise ValueError(f"{group}.{name} must be a list")
        return type(default)(value)
    kinds = (int, float) if isinstance(default, float) else type(default)
    if default is not None and (not isinstance(value, kinds) or isinstance(value, bool) != isinstance(default, bool)):
        raise ValueError(f"{group}.{name} must be of type {type(default).__name__}")
    return value


def _parsed(text: str):
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


def problems(settings: Mapping) -> list[str]:
    """What is wrong with settings ({group: {option: value}}): unknown groups and options, wrong types, values out of range."""
    out = []
    for group, values in settings.items():
        if group not in GROUPS:
            out.append(f"unknown group {group!r}")
            continue
        if not isinstance(values, Mapping):
            out.append(f"{group} must be an object")
            continue
        for name, value in values.items():
            try:
                if name not in _names(group):
                    raise ValueError(f"unknown option {group}.{name}")
                GROUPS[group](**{name: _typed(group, name, value)})
            except ValueError as e:
                out.append(str(e))
    return out


class Settings:
    """The option groups by name: ``settings.compare`` is a CompareOptions, and so on."""

    def __init__(self, values: Mapping | None = None):
        self.reset()
        for group, own in (values or {}).items():
            self.update(group, **own)

    def reset(self) -> None:
        """All options back to their defaults."""
        for group, kind in GROUPS.items():
            setattr(self, group, kind())

    def update(self, group: str, **changes) -> None:
        """Change options of a group; on any error (ValueError) nothing changes."""
        found = problems({group: changes})
        if found:
            raise ValueError("; ".join(found))
        setattr(self, group, getattr(self, group).with_changes(**{k: _typed(group, k, v) for k, v in changes.items()}))

    def as_dict(self) -> dict:
        return {g: {n: _plain(getattr(getattr(self, g), n)) for n in sorted(_names(g))} for g in GROUPS}

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.as_dict(), indent=2) + "\n", encoding="utf-8")

    def with_overrides(self, named: Mapping[str, str]) -> Settings:
        """Texts by "group.option" (JSON, or a plain string) on top of these settings."""
        for name, text in named.items():
            group, _, option = name.partition(".")
            self.update(group, **{option: _parsed(text)})
        return self


def environment(variables: Mapping[str, str] = os.environ) -> str:
    """The environment's name (ROWLENS_ENV; "dev" where it is unset)."""
    return variables.get("ROWLENS_ENV") or "dev"


def load(path: str | None = None, variables: Mapping[str, str] = os.environ, spark: SparkSession | None = None) -> Settings:
    """Settings from a JSON file, and over them, each where it is present:

    the file's neighbour for the environment (``settings.prod.json`` beside
    ``settings.json``), variables such as ROWLENS_COMPARE_FLOAT_TOLERANCE, and
    the session's ``spark.rowlens.compare.float_tolerance``.
    """
    out = Settings()
    if path:
        base = Path(path)
        own = base.with_name(f"{base.stem}.{environment(variables)}{base.suffix}")
        for file in (base, own) if own.exists() else (base,):
            read = json.loads(file.read_text(encoding="utf-8"))
            found = problems(read) if isinstance(read, dict) else ["not an object"]
            if found:
                raise ValueError(f"{file}: {'; '.join(found)}")
            for group, values in read.items():
                out.update(group, **values)
    options = [(g, n) for g in GROUPS for n in sorted(_names(g))]
    named = {f"{g}.{n}": variables[v] for g, n in options if (v := f"ROWLENS_{g}_{n}".upper()) in variables}
    if spark is not None:
        named |= {f"{g}.{n}": v for g, n in options if (v := spark.conf.get(f"spark.rowlens.{g}.{n}", None)) is not None}
    return out.with_overrides(named)
