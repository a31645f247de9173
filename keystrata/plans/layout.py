"""The layout's cost model: pure functions of what was measured."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from ..functions.widths import align_up, width_for
from .model import Measures, Options, Schema


@dataclass(frozen=True)
class FieldLayout:
    name: str
    kind: str
    width: int
    bias: int
    offset: int


@dataclass(frozen=True)
class Remap:
    """A partition's local reference width (0: none) and the bytes it saves beyond its table."""

    width: int
    savings: int


def plan_remap(distinct: int, count: int, ref_width: int, enabled: bool = True) -> Remap:
    if not enabled or not distinct:
        return Remap(0, 0)
    local = width_for(distinct - 1)
    saved = count * (ref_width - local) - 4 * distinct
    return Remap(local, saved) if local < ref_width and local <= 2 and saved > 0 else Remap(0, 0)


def trim(used: list[bool]) -> tuple[int, int]:
    """(skip, width) of the stretch from the first used byte to the last; none used: (0, 0)."""
    at = [i for i, x in enumerate(used) if x]
    return (at[0], at[-1] - at[0] + 1) if at else (0, 0)


def field_layouts(schema: Schema, m: Measures, align: bool = False) -> list[FieldLayout]:
    out, offset = [], 0
    for f in schema.fields:
        low, high = m.ranges.get(f.name, (0, 0))
        width = {"f32": 4, "f64": 8, "bytes": f.width}.get(f.kind) or (width_for(max(m.texts.get(f.name, (0, 0))[0] - 1, 0)) if f.kind == "text" else width_for(high - low))
        offset = align_up(offset, width) if align else offset
        out.append(FieldLayout(f.name, f.kind, width, low if f.kind in ("uint", "sint") else 0, offset))
        offset += width
    return out


def ref_width(distinct: int) -> int:
    return width_for(max(distinct - 1, 0))


def is_dense(most_partition: int, partitions: int, most_slots: int = 1 << 20) -> bool:
    """Whether a slot for every partition up to the last is worth its gaps."""
    return partitions > 0 and most_partition + 1 <= min(most_slots, 4 * partitions + 16)


def dictionary_size(entries: int, payload: int, fixed: bool) -> int:
    return 16 + payload if fixed else 16 + 4 * (entries + 1) + payload


@dataclass(frozen=True)
class Report:
    """What was decided and what it was decided from."""

    records: int
    distinct_values: int
    partitions: int
    interned: bool
    dedup_abandoned: bool
    sorted_during_finish: bool
    has_key_mapping: bool
    address_width: int
    ref_width: int
    value_stride: int
    record_stride: int
    remapped_partitions: int
    remap_saved_bytes: int
    address_bytes_total: int
    address_saved_bytes: int
    narrowed_partitions: int
    directory_stride: int
    inline_estimate: int
    interned_estimate: int
    image_bytes: int

    def to_dict(self) -> dict:
        return asdict(self)


def decide(schema: Schema, m: Measures, options: Options, has_key_mapping: bool = True, resorted: bool = False) -> tuple[Report, list[FieldLayout]]:
    fields = field_layouts(schema, m, options.align)
    stride = max((f.offset + f.width for f in fields), default=0)
    ref = ref_width(m.distinct)
    address = m.address_bytes if options.trim else m.records * m.address_width
    savings = m.remap_savings if options.remap else 0
    inline = address + m.records * stride
    interned = address + m.records * ref + dictionary_size(m.distinct, m.distinct * stride, True)
    interned -= min(interned, savings)
    use = {"always": True, "never": False}.get(options.interning, interned < inline)
    remapped = m.remapped if use and options.remap else 0
    dense = is_dense(m.most_partition, m.partitions, options.most_dense_slots)
    slots = m.most_partition + 1 if dense else m.partitions
    # The image, part by part: header, dictionaries, blocks, directory, schema, footer.
    at = 16
    texts = [m.texts.get(f.name, (0, 0)) for f in schema.fields if f.kind == "text"]
    for entries, size in texts:
        at = align_up(at, 8) + dictionary_size(entries, size, False)
    if use:
        at = align_up(at, 8) + dictionary_size(m.distinct, m.distinct * stride, True)
    at = align_up(at, 8)
    if use:
        blocks = address + (m.remap_reference_bytes + 4 * m.remap_entries if options.remap else m.records * ref)
        last = m.last_partition_bytes
    else:
        blocks, last = address + m.records * stride, m.last_inline_bytes
    most_offset = at + blocks - last if m.partitions else 0
    has_remap = remapped > 0
    trimmed, skipped = options.trim and m.any_trimmed, options.trim and m.most_skip > 0
    directory = (0 if dense else width_for(m.most_partition)) + width_for(most_offset) + width_for(m.most_count)
    directory += (1 + width_for(m.most_remap) if has_remap else 0) + bool(trimmed) + bool(skipped)
    at = align_up(at + blocks, 8) + slots * directory
    at = align_up(at, 8) + 40 + 24 * len(fields) + 16 * (len(texts) + use) + sum(len(f.name.encode()) + 1 for f in schema.fields) + 64
    report = Report(
        m.records, m.distinct, m.partitions, use, m.dedup_abandoned, resorted, has_key_mapping, m.address_width, ref, stride, m.address_width + (ref if use else stride),
        remapped, savings if use else 0, address, m.records * m.address_width - address, m.narrowed if options.trim else 0, directory, inline, interned, at,
    )
    return report, fields
