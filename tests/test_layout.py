"""The cost model against hand-computed values; no Spark."""

import pytest

from keystrata.functions.widths import align_up, exact_width_for, is_valid_width, mask_for_width, width_for
from keystrata.plans.layout import decide, field_layouts, is_dense, plan_remap, ref_width, trim
from keystrata.plans.model import BuildError, Field, Key, Measures, Options, Schema, keyed

UINT = Schema.of(v="uint")


@pytest.mark.parametrize("lo,hi,width", [(0, 255, 1), (0, 256, 2), (0, 65535, 2), (0, 65536, 4), (10**6, 1000255, 1), (10**6, 1000256, 2), (0, 2**32 - 1, 4), (0, 2**32, 8)])
def test_width_and_bias(lo, hi, width):
    (f,) = field_layouts(UINT, Measures(ranges={"v": (lo, hi)}))
    assert (f.width, f.bias) == (width, lo)


def test_signed_span():
    (f,) = field_layouts(Schema.of(v="sint"), Measures(ranges={"v": (-1000000, -999900)}))
    assert (f.width, f.bias) == (1, -1000000)


@pytest.mark.parametrize("entries,width", [(0, 1), (1, 1), (256, 1), (257, 2), (65537, 4)])
def test_text_width(entries, width):
    assert field_layouts(Schema.of(s="text"), Measures(texts={"s": (entries, 0)}))[0].width == width


def test_helpers():
    assert [exact_width_for(x) for x in (0, 1, 255, 256, 2**24 - 1, 2**40 - 1, 2**48 - 1, 2**56 - 1, 2**64 - 1)] == [1, 1, 1, 2, 3, 5, 6, 7, 8]
    assert [width_for(x) for x in (0, 255, 256, 65536, 2**32)] == [1, 1, 2, 4, 8]
    assert mask_for_width(8) == 2**64 - 1 and is_valid_width(4) and not is_valid_width(3)
    assert [align_up(x, 4) for x in (0, 1, 4, 5)] == [0, 4, 4, 8]


def test_align():
    s, m = Schema.of(a="bytes1", b="uint"), Measures(ranges={"b": (0, 100000)})
    assert sum(f.width for f in field_layouts(s, m)) == 5
    last = field_layouts(s, m, align=True)[-1]
    assert last.offset + last.width == 8


def test_remap():
    # 400 partitions of 100 records with 10 distinct values among 4 000: one byte each saved, less a table of 40.
    assert (plan_remap(10, 100, 2).width, plan_remap(10, 100, 2).savings) == (1, 60)
    assert plan_remap(4, 200, 2).savings == 184 and plan_remap(200, 200, 2).width == 0
    assert plan_remap(10, 100, 2, enabled=False).width == 0 and plan_remap(0, 0, 2).width == 0 and plan_remap(70000, 10**6, 8).width == 0


def test_trim():
    assert trim([False, False, True, True]) == (2, 2) and trim([True, True]) == (0, 2) and trim([False, False, False, True]) == (3, 1) and trim([False] * 4) == (0, 0)


def test_density():
    assert is_dense(7, 8) and not is_dense(2**40 + 1, 2) and not is_dense(0, 0) and not is_dense(2**64 - 1, 1) and is_dense(19, 1) and not is_dense(20, 1)


def routes(distinct, interning):
    schema = Schema.of(next_hop="uint", asn="uint", metric="uint", interface="text", region="text")
    m = Measures(records=499375, distinct=distinct, ranges={"next_hop": (0, 60000), "asn": (0, 511), "metric": (0, 89)}, texts={"interface": (8, 37), "region": (6, 47)}, address_width=2, partitions=4096, most_partition=4095, most_count=300, address_bytes=2 * 499375, remap_reference_bytes=2 * 499375)
    return decide(schema, m, Options(interning=interning, remap=False))[0]


def test_published_sizes():
    """Half a million routes of 7-byte values behind 2-byte addresses, 3 000 of them distinct, in 4 096 dense slots."""
    inline, interned = routes(3000, "never"), routes(3000, "always")
    assert (inline.value_stride, inline.record_stride, interned.record_stride, interned.ref_width) == (7, 9, 4, 2)
    assert inline.directory_stride == interned.directory_stride == 6
    assert inline.inline_estimate == 9 * 499375 and inline.interned_estimate == 4 * 499375 + 16 + 21000
    assert routes(3000, "automatic").interned and not routes(490000, "automatic").interned
    assert (inline.image_bytes, interned.image_bytes) == (4519453, 2043613)


def test_empty():
    report, _ = decide(UINT, Measures(), Options())
    assert (report.records, report.partitions, report.interned, report.address_width) == (0, 0, False, 1)
    assert ref_width(0) == 1


def test_schema_errors():
    for bad in (lambda: Field("", "uint"), lambda: Field("a\0b", "uint"), lambda: Field("a", "bytes", 0), lambda: Field("a", "bytes", 9), lambda: Field("a", "blob"), lambda: Schema((Field("a", "uint"), Field("a", "text"))), lambda: keyed("k", 65), lambda: Key("split", ("a",)), lambda: Options(interning="maybe")):
        with pytest.raises(BuildError):
            bad()
    assert UINT.find("v").kind == "uint" and UINT.find("w") is None
