"""Extension points by kind and name: adapters, parsers, extractors, channels."""

from __future__ import annotations

from collections.abc import Callable

KINDS = ("adapter", "parser", "extractor", "channel")
_REGISTRY: dict[str, dict[str, Callable]] = {kind: {} for kind in KINDS}


def register(kind: str, name: str, fn: Callable) -> Callable:
    """Make fn (on Columns or DataFrames) known; a name can be taken once."""
    if kind not in _REGISTRY:
        raise ValueError(f"unknown kind {kind}")
    if name in _REGISTRY[kind]:
        raise ValueError(f"{kind} {name} is already registered")
    _REGISTRY[kind][name] = fn
    return fn


def registered(kind: str) -> dict[str, Callable]:
    return dict(_REGISTRY[kind])


def resolve(kind: str, name: str) -> Callable:
    if name not in _REGISTRY.get(kind, {}):
        raise KeyError(f"unknown {kind}: {name}")
    return _REGISTRY[kind][name]
