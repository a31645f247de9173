"""Schemas, keys, options, statuses and errors."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

KINDS = ("uint", "sint", "f32", "f64", "bytes", "text")
SPARK_TYPES = {"uint": "bigint", "sint": "bigint", "f32": "float", "f64": "double", "bytes": "binary", "text": "string"}
UINT_MAX = 2**64 - 1


class BuildError(ValueError):
    """The declared schema, the options or the records cannot make a dataset."""


class Status(Enum):
    """Why a dataset does or does not open."""

    OK = "opened"
    TOO_SMALL = "the folder has no manifest"
    BAD_MAGIC = "the manifest is of another format"
    BAD_VERSION = "the manifest is of a version that this engine does not read"
    BAD_SIZE = "the records are missing, or not as many as the manifest says"
    BAD_DIRECTORY = "the directory disagrees with the records"
    BAD_SCHEMA = "the manifest's schema or key does not describe the tables"
    BAD_DICTIONARY = "values or texts have gaps, or are missing where records refer to them"


class FormatError(ValueError):
    """A dataset failed validation; ``status`` says how."""

    def __init__(self, status: Status):
        super().__init__(status.value)
        self.status = status


@dataclass(frozen=True)
class Field:
    """A field of one of the six kinds; ``width`` is declared for bytes only."""

    name: str
    kind: str
    width: int = 0

    def __post_init__(self):
        if not self.name:
            raise BuildError("a field needs a name")
        if "\0" in self.name:
            raise BuildError(f"the name {self.name!r} holds a NUL")
        if self.kind not in KINDS:
            raise BuildError(f"{self.name}: no kind {self.kind!r}")
        if self.kind == "bytes" and not 1 <= self.width <= 8:
            raise BuildError(f"{self.name}: bytes are 1 to 8 wide; longer values are text")


@dataclass(frozen=True)
class Schema:
    """Ordered fields of unique names."""

    fields: tuple[Field, ...] = ()

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(names) != len(set(names)):
            raise BuildError(f"names repeat: {sorted(n for n in set(names) if names.count(n) > 1)}")

    @classmethod
    def of(cls, **kinds: str) -> Schema:
        """``Schema.of(country="text", mac="bytes6")``."""
        return cls(tuple(Field(n, "bytes", int(k[5:])) if k.startswith("bytes") else Field(n, k) for n, k in kinds.items()))

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def find(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def to_dict(self) -> list[dict]:
        return [{"name": f.name, "kind": f.kind, "width": f.width} for f in self.fields]

    @classmethod
    def from_dict(cls, rows: list[dict]) -> Schema:
        return cls(tuple(Field(r["name"], r["kind"], r.get("width", 0)) for r in rows))


#: Stands for ``address_bits`` where a dataset has no key space.
NO_KEY_SPACE = 0xFF


@dataclass(frozen=True)
class Key:
    """How a record's place is found: ``keyed`` splits one number by bits, ``split`` and ``wide`` take two columns.

    In ``wide`` the address is binary and is ordered byte by byte.
    """

    mode: str
    columns: tuple[str, ...]
    bits: int = 32

    def __post_init__(self):
        if self.mode not in ("keyed", "split", "wide"):
            raise BuildError(f"no key mode {self.mode!r}")
        if len(self.columns) != (1 if self.mode == "keyed" else 2):
            raise BuildError(f"{self.mode} keys do not have {len(self.columns)} columns")
        if self.mode == "keyed" and not 0 <= self.bits <= 64:
            raise BuildError("address bits are 0 to 64")

    @property
    def has_mapping(self) -> bool:
        return self.mode == "keyed"


def keyed(column: str, bits: int = 32) -> Key:
    return Key("keyed", (column,), bits)


def split(partition: str, address: str) -> Key:
    return Key("split", (partition, address))


def wide(partition: str, address: str) -> Key:
    return Key("wide", (partition, address))


@dataclass(frozen=True)
class Options:
    interning: str = "automatic"  # or always, never
    order: str = "sort"  # or assume_sorted, which needs ``sequence``, the column of arrival order
    sequence: str | None = None
    remap: bool = True
    trim: bool = True
    align: bool = False
    dedup_sample: int = 1 << 20
    dedup_ratio: float = 0.9
    emulate_give_up: bool = False
    most_dense_slots: int = 1 << 20

    def __post_init__(self):
        if self.interning not in ("automatic", "always", "never"):
            raise BuildError(f"no interning policy {self.interning!r}")
        if self.order not in ("sort", "assume_sorted"):
            raise BuildError(f"no input order {self.order!r}")


@dataclass
class Measures:
    """What the layout is decided from; all of it is aggregated from the records."""

    records: int = 0
    distinct: int = 0
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)  # of uint and sint fields
    texts: dict[str, tuple[int, int]] = field(default_factory=dict)  # entries and bytes of text fields
    address_width: int = 1
    partitions: int = 0
    most_partition: int = 0
    most_count: int = 0
    address_bytes: int = 0  # trimmed
    narrowed: int = 0
    most_skip: int = 0
    any_trimmed: bool = False
    remapped: int = 0
    remap_savings: int = 0
    remap_entries: int = 0
    remap_reference_bytes: int = 0  # record bytes that references take where remaps are used
    most_remap: int = 0
    last_partition_bytes: int = 0  # of the last partition, remap table included, if interned
    last_inline_bytes: int = 0
    dedup_abandoned: bool = False
