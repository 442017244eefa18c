"""Names and types of a graph: labels, edge types, and one type per property key."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import NotFound, SchemaError

#: Engine type -> Spark type.
TYPES = {"int": "bigint", "double": "double", "bool": "boolean", "string": "string"}


def type_of(value: object) -> str | None:
    """The column type a Python value asks for; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "double"
    if isinstance(value, str):
        return "string"
    raise SchemaError(f"a property can't hold {type(value).__name__}")


def box(value: object, want: str, key: str = "") -> object:
    """``value`` as a ``want``: an int becomes a double, null stays null, anything else must match."""
    have = type_of(value)
    if have is None or have == want:
        return value
    if have == "int" and want == "double":
        return float(value)  # type: ignore[arg-type]
    raise SchemaError(f"property {key!r} is {want}, not {have}")


@dataclass
class Catalog:
    node_keys: dict[str, str] = field(default_factory=dict)
    edge_keys: dict[str, str] = field(default_factory=dict)
    labels: list[str] = field(default_factory=list)
    edge_types: list[str] = field(default_factory=list)
    version: int = 0

    def copy(self) -> Catalog:
        return Catalog(dict(self.node_keys), dict(self.edge_keys), list(self.labels), list(self.edge_types), self.version)

    def keys(self, owner: str) -> dict[str, str]:
        return self.node_keys if owner == "node" else self.edge_keys

    def declare(self, owner: str, key: str, value_type: str) -> bool:
        """Reserve a column; declaring it alike again changes nothing, otherwise is an error."""
        if value_type not in TYPES:
            raise SchemaError(f"unknown type {value_type!r}")
        have = self.keys(owner).get(key)
        if have is None:
            self.keys(owner)[key] = value_type
            self.version += 1
            return True
        if have != value_type:
            raise SchemaError(f"{owner} property {key!r} is {have}, not {value_type}")
        return False

    def drop(self, owner: str, key: str) -> None:
        if self.keys(owner).pop(key, None) is not None:
            self.version += 1

    def fit(self, owner: str, key: str, value: object) -> object:
        """Box a value for its key; the first value of a key fixes the type."""
        t = type_of(value)
        if key not in self.keys(owner):
            if t is None:
                return None
            self.declare(owner, key, t)
        return box(value, self.keys(owner)[key], key)

    def _intern(self, names: list[str], name: str) -> int:
        if name not in names:
            names.append(name)
            self.version += 1
        return names.index(name)

    def intern_label(self, name: str) -> int:
        return self._intern(self.labels, name)

    def intern_edge_type(self, name: str) -> int:
        return self._intern(self.edge_types, name)

    def label_id(self, name: str) -> int | None:
        return self.labels.index(name) if name in self.labels else None

    def edge_type_id(self, name: str) -> int | None:
        return self.edge_types.index(name) if name in self.edge_types else None

    def label_name(self, i: int) -> str:
        if not 0 <= i < len(self.labels):
            raise NotFound(f"no label {i}")
        return self.labels[i]

    def edge_type_name(self, i: int) -> str:
        if not 0 <= i < len(self.edge_types):
            raise NotFound(f"no edge type {i}")
        return self.edge_types[i]
