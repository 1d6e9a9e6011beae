"""Functions that users add: vectorised ones over Arrow, and expressions with parameters; and procedures in Python."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from grafloom.errors import GraphError


@dataclass
class Udf:
    name: str
    returns: str
    arg_types: list[str]
    call: Callable


class UdfRegistry:
    def __init__(self) -> None:
        self.known: dict[str, Udf] = {}

    def udf(self, returns: str, arg_types: list[str], name: str | None = None) -> Callable:
        """Decorator of a function of Arrow arrays that returns one; arguments are cast to the declared types."""

        def add(f: Callable) -> Udf:
            n = name or f.__name__
            if n in self.known:
                raise GraphError(6132, f"function {n} exists")
            made = F.arrow_udf(f, returns)

            def call(*args: Column) -> Column:
                if len(args) != len(arg_types):
                    raise GraphError(6130, f"{n} takes {len(arg_types)} arguments")
                return made(*[a.cast(t) for a, t in zip(args, arg_types, strict=True)])

            self.known[n] = Udf(n, returns, arg_types, call)
            return self.known[n]

        return add

    def expression(self, name: str, parameters: list[str], build: Callable[..., Column]) -> Callable:
        """A function that is an expression of its arguments: Catalyst sees through it."""
        if name in self.known:
            raise GraphError(6132, f"function {name} exists")

        def call(*args: Column) -> Column:
            if len(args) != len(parameters):
                raise GraphError(6130, f"{name} takes {len(parameters)} arguments")
            return build(*args)

        self.known[name] = Udf(name, "expression", parameters, call)
        return call

    def __getitem__(self, name: str) -> Callable:
        if name not in self.known:
            raise GraphError(6020, f"unknown function {name}")
        return self.known[name].call


MOST_ROUNDS = 10_000


class Procedure:
    """Steps on the driver over an environment of names: `("assign", name, f)`, `("call", f)`, `("if", f, then, else)`,
    `("for", name, f, body)`, `("while", f, body)`; each `f` takes the environment."""

    def __init__(self, name: str, parameters: list[str], body: list[tuple]) -> None:
        self.name, self.parameters, self.body = name, parameters, body

    def __call__(self, **args):  # noqa: ANN003, ANN204
        if set(args) != set(self.parameters):
            raise GraphError(6140, f"{self.name} takes {self.parameters}")
        env = dict(args)
        self._run(self.body, env)
        return env

    def _run(self, body: list[tuple], env: dict) -> None:
        for op, *rest in body:
            if op == "assign":
                env[rest[0]] = rest[1](env)
            elif op == "call":
                rest[0](env)
            elif op == "if":
                self._run(rest[1] if rest[0](env) else rest[2], env)
            elif op == "for":
                for x in rest[1](env):
                    env[rest[0]] = x
                    self._run(rest[2], env)
            elif op == "while":
                rounds = 0
                while rest[0](env):
                    rounds += 1
                    if rounds > MOST_ROUNDS:
                        raise GraphError(6141, f"more than {MOST_ROUNDS} rounds")
                    self._run(rest[1], env)
            else:
                raise GraphError(6140, f"unknown step {op}")
