"""Saved plans: a signal's lineage as a graph of named operations, as JSON, and replayed on other inputs."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from ..frame import Step
from .registry import REGISTRY, get_operation

SCHEMA = 1


class RecipeError(ValueError):
    """A plan that cannot be extracted, read or run."""


def encode(value):
    if isinstance(value, float) and not math.isfinite(value):
        return {"$number": repr(value)}
    if isinstance(value, (list, tuple)):
        return [encode(v) for v in value]
    if isinstance(value, dict):
        return {str(k): encode(v) for k, v in value.items()}
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise RecipeError(f"a plan holds numbers, texts, lists and tables, not {type(value).__name__}")


def decode(value):
    if isinstance(value, dict):
        return float(value["$number"]) if set(value) == {"$number"} else {k: decode(v) for k, v in value.items()}
    return [decode(v) for v in value] if isinstance(value, list) else value


#: Operations of two signals, or with operators of their own.
BINARY = {"add": "__add__", "sub": "__sub__", "mul": "__mul__", "div": "__truediv__", "pow": "__pow__"}


@dataclass(frozen=True)
class Node:
    id: str
    operation: str
    version: int
    params: dict = field(default_factory=dict)
    inputs: tuple = ()


@dataclass(frozen=True)
class Recipe:
    """Inputs by name, nodes in an order in which each finds its inputs, and the output's id."""

    inputs: tuple
    nodes: tuple
    output: str

    @staticmethod
    def from_signal(signal) -> Recipe:
        """The plan that made a signal; shared parts occur once."""
        nodes, names, seen = [], [], {}

        def visit(at) -> str:
            if not isinstance(at, Step):
                if at not in names:
                    names.append(at)
                return f"in:{at}"
            if id(at) not in seen:
                if at.name not in REGISTRY and at.name not in BINARY and at.name not in ("concat_frame", "mix"):
                    raise RecipeError(f"{at.name!r} cannot be saved")
                inputs = tuple(visit(i) for i in at.inputs)
                seen[id(at)] = f"n{len(nodes)}"
                nodes.append(Node(seen[id(at)], at.name, at.version, encode(at.params), inputs))
            return seen[id(at)]

        if signal.header.lineage is None:
            raise RecipeError("nothing was done to this signal")
        output = visit(signal.header.lineage)
        return Recipe(tuple(names), tuple(nodes), output).checked()

    def checked(self) -> Recipe:
        known = {f"in:{n}" for n in self.inputs}
        used = set()
        for n in self.nodes:
            if n.id in known or not set(n.inputs) <= known:
                raise RecipeError(f"node {n.id} is repeated or comes before its inputs")
            known.add(n.id)
            used |= set(n.inputs)
        if self.output not in known or known - used - {self.output}:
            raise RecipeError("an output is missing, or parts are not used")
        return self

    def to_json(self) -> str:
        return json.dumps({"schema": SCHEMA, "inputs": list(self.inputs), "nodes": [{**n.__dict__, "inputs": list(n.inputs)} for n in self.nodes], "output": self.output}, sort_keys=True, allow_nan=False)

    @staticmethod
    def from_json(text: str) -> Recipe:
        d = json.loads(text)
        if d.get("schema") != SCHEMA:
            raise RecipeError(f"unknown plan schema {d.get('schema')!r}")
        return Recipe(tuple(d["inputs"]), tuple(Node(n["id"], n["operation"], n["version"], n["params"], tuple(n["inputs"])) for n in d["nodes"]), d["output"]).checked()

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    @staticmethod
    def load(path: str) -> Recipe:
        with open(path, encoding="utf-8") as f:
            return Recipe.from_json(f.read())

    def apply(self, signals):
        """Run the plan on a signal, or on signals by input name; the result is a plan still."""
        by = signals if isinstance(signals, dict) else {self.inputs[0]: signals}
        if set(by) != set(self.inputs):
            raise RecipeError(f"inputs are {list(self.inputs)}")
        made = {f"in:{k}": v for k, v in by.items()}
        for n in self.nodes:
            args, params = [made[i] for i in n.inputs], decode(n.params)
            if n.operation in BINARY:
                if len(args) == 2:
                    made[n.id] = getattr(args[0], BINARY[n.operation])(args[1])
                else:
                    made[n.id] = args[0]._arith(params["scalar"], n.operation, params["reverse"])
            elif n.operation in ("concat_frame", "mix"):
                made[n.id] = getattr(args[0], n.operation)(args[1], **params)
            else:
                made[n.id] = get_operation(n.operation)(args[0], **params)
        return made[self.output]
