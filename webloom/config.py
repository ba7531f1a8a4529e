"""Settings from JSON or YAML files into dataclasses; unknown and missing keys and wrong types are errors."""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from pathlib import Path
from typing import Any, TypeVar

C = TypeVar("C")


def _checked(value: Any, kind: Any, where: str) -> Any:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if dataclasses.is_dataclass(kind):
        return settings(value, kind, where)
    if origin in (typing.Union, types.UnionType):
        for option in args:
            try:
                return _checked(value, option, where)
            except TypeError:
                continue
        raise TypeError(f"{where}: {value!r} is no {kind}")
    if origin is tuple or origin is list:
        if not isinstance(value, (list, tuple)):
            raise TypeError(f"{where}: {value!r} is no list")
        return origin(_checked(v, args[0], f"{where}[{i}]") for i, v in enumerate(value))
    if origin is dict:
        if not isinstance(value, dict):
            raise TypeError(f"{where}: {value!r} is no table")
        return {k: _checked(v, args[1], f"{where}.{k}") for k, v in value.items()}
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if kind is Any or kind is type(None) and value is None or isinstance(kind, type) and isinstance(value, kind) and (kind is bool or not isinstance(value, bool)):
        return value
    raise TypeError(f"{where}: {value!r} is no {getattr(kind, '__name__', kind)}")


def settings(values: Any, kind: type[C], where: str = "settings") -> C:
    """A ``kind`` (a dataclass) of the values, checked against its fields."""
    if not isinstance(values, dict):
        raise TypeError(f"{where}: {values!r} is no table")
    kinds = typing.get_type_hints(kind)
    if unknown := [k for k in values if k not in kinds]:
        raise TypeError(f"{where}: unknown key {unknown[0]}")
    missing = [f.name for f in dataclasses.fields(kind) if f.name not in values and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
    if missing:
        raise TypeError(f"{where}: no {missing[0]}")
    return kind(**{k: _checked(v, kinds[k], f"{where}.{k}") for k, v in values.items()})


def load(path: str | Path, kind: type[C]) -> C:
    """The settings of a file; YAML needs its library, JSON none."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        import yaml

        return settings(yaml.safe_load(text), kind, Path(path).name)
    return settings(json.loads(text), kind, Path(path).name)
