"""Names of operations that saved plans may use."""

from __future__ import annotations

import functools
from collections.abc import Callable

REGISTRY: dict[str, Callable] = {}


def operation(name: str, version: int = 1):
    """Register a method under a name; a saved plan calls it by name with its keyword parameters."""

    def register(method):
        @functools.wraps(method)
        def call(self, *args, **kwargs):
            out = method(self, *args, **kwargs)
            return remember(out, self, name, version, method, args, kwargs)

        REGISTRY[name] = call
        call.operation = (name, version)
        return call

    return register


def remember(out, source, name: str, version: int, method, args: tuple, kwargs: dict):
    """Lineage of the outermost registered call: its name and its parameters as given."""
    import inspect
    from dataclasses import replace

    from ..frame import Step

    bound = inspect.signature(method).bind(source, *args, **kwargs)
    params = dict(list(bound.arguments.items())[1:])  # the first is the signal
    out.header = replace(out.header, lineage=Step(name, params, (source.header.lineage or source.header.label or "input",), version))
    return out


def register_operation(name: str, function: Callable, version: int = 1) -> None:
    """Add an operation of one's own: function(signal, **params) to a signal."""
    if name in REGISTRY:
        raise ValueError(f"{name!r} is registered")
    REGISTRY[name] = operation(name, version)(function)


def get_operation(name: str) -> Callable:
    if name not in REGISTRY:
        raise KeyError(f"no operation {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]
