"""Extraction schemas: a tree of fields that compiles to columns. Driver side only."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

FIELD_TYPES = ("string", "number", "boolean", "object", "array")


@dataclass(frozen=True)
class FieldSpec:
    key: str
    field_type: str = "string"
    required: bool = False
    multiple: bool = False
    children: tuple[FieldSpec, ...] = ()
    hints: tuple[str, ...] = ()

    def labels(self) -> list[str]:
        """The key and the hints: trimmed, not blank, distinct, in order."""
        return list(dict.fromkeys(x.strip() for x in (self.key, *self.hints) if x.strip()))

    @staticmethod
    def of(data: dict) -> FieldSpec:
        return FieldSpec(
            data["key"],
            data.get("field_type", "string"),
            bool(data.get("required", False)),
            bool(data.get("multiple", False)),
            tuple(FieldSpec.of(c) for c in data.get("children") or ()),
            tuple(data.get("hints") or ()),
        )

    def to_dict(self) -> dict:
        return {
            "key": self.key,
            "field_type": self.field_type,
            "required": self.required,
            "multiple": self.multiple,
            "children": [c.to_dict() for c in self.children],
            "hints": list(self.hints),
        }


@dataclass(frozen=True)
class SchemaSpec:
    name: str
    version: str
    fields: tuple[FieldSpec, ...] = field(default_factory=tuple)

    @staticmethod
    def from_json(text: str) -> SchemaSpec:
        data = json.loads(text)
        return SchemaSpec(data["name"], data["version"], tuple(FieldSpec.of(f) for f in data["fields"]))

    def to_json(self) -> str:
        data = {"name": self.name, "version": self.version, "fields": [f.to_dict() for f in self.fields]}
        return json.dumps(data, ensure_ascii=False)

    def validate(self) -> SchemaSpec:
        """Raise ValueError on the first violation; return self otherwise."""
        if not self.name.strip():
            raise ValueError("schema name is blank")
        if not self.version.strip():
            raise ValueError("schema version is blank")
        if not self.fields:
            raise ValueError("schema has no fields")
        _validate(self.fields, "fields")
        return self

    def holds_lists_inside(self) -> bool:
        """Whether a list of objects lies inside another field."""
        return any(_lists_below(f) for f in self.fields)

    def leaves(self) -> list[tuple[tuple[str, ...], FieldSpec]]:
        """(path, field) of every leaf, depth first."""
        return _leaves(self.fields, ())


def _lists_below(f: FieldSpec) -> bool:
    return any(c.children and (c.field_type == "array" or _lists_below(c)) for c in f.children)


def _validate(fields: tuple[FieldSpec, ...], scope: str) -> None:
    seen = set()
    for f in fields:
        key = f.key.strip()
        if not key:
            raise ValueError(f"{scope}: a key is blank")
        if key in seen:
            raise ValueError(f"{scope}: duplicate key {key}")
        seen.add(key)
        if f.field_type not in FIELD_TYPES:
            raise ValueError(f"{scope}.{key}: unknown type {f.field_type}")
        if f.children:
            if f.field_type not in ("object", "array"):
                raise ValueError(f"{scope}.{key}: only object and array fields have children")
            _validate(f.children, f"{scope}.{key}")


def _leaves(fields: tuple[FieldSpec, ...], path: tuple[str, ...]) -> list[tuple[tuple[str, ...], FieldSpec]]:
    out = []
    for f in fields:
        here = (*path, f.key)
        out += _leaves(f.children, here) if f.children else [(here, f)]
    return out


def prompt(path: tuple[str, ...], spec: FieldSpec) -> str:
    """The model's prompt for a leaf: its path, then its other names."""
    hints = [h.strip() for h in spec.hints if h.strip()]
    return "/".join(path) + ("；别名：" + "，".join(hints) if hints else "")
