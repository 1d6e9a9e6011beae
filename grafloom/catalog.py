"""Classes, properties and their closures; small, kept on the driver and saved as JSON."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from grafloom.errors import GraphError


def local_name(iri: str) -> str:
    """The last segment of an IRI after `/`, `#` or `:`."""
    return re.split(r"[/#:]", iri)[-1]


@dataclass
class ClassDef:
    name: str
    iri: str
    parents: list[str] = field(default_factory=list)
    fields: dict[str, str] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)


@dataclass
class PropertyDef:
    name: str
    iri: str
    kind: str = "OBJECT"
    domain: list[str] = field(default_factory=list)
    range: list[str] = field(default_factory=list)
    parents: list[str] = field(default_factory=list)
    characteristics: list[str] = field(default_factory=list)


@dataclass
class IndexDef:
    name: str
    kind: str
    node_type: str
    columns: list[str]
    options: dict = field(default_factory=dict)


class Catalog:
    def __init__(self) -> None:
        self.classes: dict[str, ClassDef] = {}
        self.properties: dict[str, PropertyDef] = {}
        self.indexes: dict[str, IndexDef] = {}
        self.prefixes: dict[str, str] = {}

    def define_class(self, name: str, iri: str | None = None, parents: list[str] | None = None, fields: dict[str, str] | None = None, required: list[str] | None = None) -> ClassDef:
        """Idempotent: parents and fields of a second definition are added to those of the first."""
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_\-]*", name):
            raise GraphError(7010, f"{name!r} is no class name")
        c = self.classes.setdefault(name, ClassDef(name, iri or f"local:{name}"))
        c.parents += [p for p in map(local_name, parents or []) if p not in c.parents]
        c.fields |= fields or {}
        c.required += [r for r in required or [] if r not in c.required]
        self.order()
        return c

    def define_property(self, name: str, iri: str | None = None, **more) -> PropertyDef:  # noqa: ANN003
        old = self.properties.get(name)
        self.properties[name] = PropertyDef(**(asdict(old) if old else {"name": name, "iri": iri or f"local:{name}"}) | more)
        return self.properties[name]

    def find(self, ref: str) -> ClassDef:
        for c in self.classes.values():
            if ref in (c.iri, c.name):
                return c
        if (c := self.classes.get(local_name(ref))) is not None:
            return c
        raise GraphError(6070, f"unknown class {ref}")

    def order(self) -> list[str]:
        """Names, parents first; a cycle is an error."""
        out: list[str] = []
        now: set[str] = set()

        def visit(n: str) -> None:
            if n in out:
                return
            if n in now:
                raise GraphError(9505, f"the classes above {n} form a cycle")
            now.add(n)
            for p in self.classes[n].parents if n in self.classes else []:
                visit(p)
            now.discard(n)
            out.append(n)

        for n in self.classes:
            visit(n)
        return out

    def ancestors(self, ref: str, reflexive: bool = True) -> list[str]:
        start, seen = self.find(ref).name, []
        todo = [start]
        while todo:
            n = todo.pop(0)
            if n not in seen:
                seen.append(n)
                todo += self.classes[n].parents if n in self.classes else []
        return seen if reflexive else seen[1:]

    def descendants(self, ref: str, reflexive: bool = True) -> list[str]:
        """In order of definition, the class itself first."""
        base = self.find(ref).name
        rest = [n for n in self.classes if n != base and base in self.ancestors(n)]
        return [base, *rest] if reflexive else rest

    def subproperties(self, ref: str) -> list[str]:
        """A property and all below it."""
        out, todo = [], [local_name(ref)]
        while todo:
            n = todo.pop(0)
            if n not in out:
                out.append(n)
                todo += [p.name for p in self.properties.values() if n in map(local_name, p.parents)]
        return out

    def is_a(self, ref: str, base: str) -> bool:
        return self.find(base).name in self.ancestors(ref)

    def to_json(self) -> str:
        return json.dumps({"classes": [asdict(c) for c in self.classes.values()], "properties": [asdict(p) for p in self.properties.values()], "indexes": [asdict(i) for i in self.indexes.values()], "prefixes": self.prefixes})

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        d, out = json.loads(text), cls()
        out.classes = {c["name"]: ClassDef(**c) for c in d["classes"]}
        out.properties = {p["name"]: PropertyDef(**p) for p in d["properties"]}
        out.indexes = {i["name"]: IndexDef(**i) for i in d["indexes"]}
        out.prefixes = d["prefixes"]
        return out
