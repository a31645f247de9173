"""Byte widths and key arithmetic, as numbers and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def width_for(most: int) -> int:
    """The least of 1, 2, 4 and 8 bytes that holds ``most``."""
    return next((w for w in (1, 2, 4) if most < 1 << 8 * w), 8)


def exact_width_for(most: int) -> int:
    """The least of 1 to 8 bytes that holds ``most``; zero takes one."""
    return max(1, -(-int(most).bit_length() // 8))


def mask_for_width(width: int) -> int:
    return (1 << 8 * width) - 1


max_for_width = mask_for_width


def is_valid_width(width: int) -> bool:
    return width in (1, 2, 4, 8)


def align_up(offset: int, to: int) -> int:
    return -(-offset // to) * to if to > 1 else offset


def width_column(most: Column) -> Column:
    """``width_for`` of a column of non-negative numbers."""
    out = F.lit(8)
    for w in (4, 2, 1):
        out = F.when(most < F.lit(1 << 8 * w), F.lit(w)).otherwise(out)
    return out


def partition_of(key: Column, bits: int) -> Column:
    """The part of a key above ``bits``.  Shifts count modulo 64, so 64 is a case of its own."""
    return F.lit(0).cast("bigint") if bits >= 64 else F.shiftrightunsigned(key, bits)


def address_of(key: Column, bits: int) -> Column:
    if bits >= 64:
        return key.cast("bigint")
    return key.bitwiseAND(F.lit((1 << bits) - 1)) if bits < 63 else key.bitwiseAND(F.lit(2**63 - 1))


def key_of(partition: Column, address: Column, bits: int) -> Column:
    return address if bits >= 64 else F.shiftleft(partition, bits).bitwiseOR(address)


def integral_div(value: Column, by: int) -> Column:
    """Exact division of whole numbers, DECIMAL(20,0) included; the result is a BIGINT."""
    return F.call_function("div", value, F.lit(str(by)).cast("decimal(20,0)"))


def decimal_partition_of(key: Column, bits: int) -> Column:
    """For unsigned 64-bit keys held as DECIMAL(20,0), which has no shifts."""
    if bits >= 64:
        return F.lit(0).cast("decimal(20,0)")
    return key if bits == 0 else integral_div(key, 1 << bits).cast("decimal(20,0)")


def decimal_address_of(key: Column, bits: int) -> Column:
    return (key % F.lit(str(1 << bits)).cast("decimal(20,0)")).cast("decimal(20,0)") if bits < 64 else key


def decimal_key_of(partition: Column, address: Column, bits: int) -> Column:
    return address if bits >= 64 else (partition * F.lit(str(1 << bits)).cast("decimal(20,0)") + address).cast("decimal(20,0)")


def byte_used(address: Column, at: int, kind: str = "bigint") -> Column:
    """Whether byte ``at`` of an address of type ``kind``, in memory order, is not zero."""
    if kind == "binary":
        return F.substring(address, at + 1, 1) != F.lit(b"\0")
    if kind.startswith("decimal"):
        return (address if at == 0 else integral_div(address, 1 << 8 * at)) % 256 != 0
    return F.shiftrightunsigned(address, 8 * at).bitwiseAND(F.lit(0xFF)) != 0


def trimmed(address: Column, skip: Column, width: Column, binary: bool) -> Column:
    """The stored stretch of an address."""
    if binary:
        return address.substr(skip + 1, width)
    return F.call_function("shiftrightunsigned", address, (8 * skip).cast("int"))


def untrimmed(stored: Column, skip: Column, width: Column, whole: int, binary: bool) -> Column:
    """The full address: zeros where the stretch was cut."""
    if binary:
        zero = F.lit(b"\0")
        return F.call_function("rpad", F.call_function("lpad", stored, (skip + width).cast("int"), zero), F.lit(whole), zero)
    return F.call_function("shiftleft", stored, (8 * skip).cast("int"))


def le_bytes_to_long(raw: Column, width: int) -> Column:
    """A little-endian byte string of exactly ``width`` bytes as a number; another length gives null."""
    digits = F.hex(raw)
    value = F.lit(0).cast("bigint")
    for i in range(width):
        byte = F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("bigint")
        value = value.bitwiseOR(F.shiftleft(byte, 8 * i))
    return F.when(F.octet_length(raw) == width, value)


def ipv4(text: Column) -> Column:
    """A dotted quad as a number; null if it is none."""
    part = F.split(text, r"\.")
    octets = [F.try_element_at(part, F.lit(i + 1)).try_cast("int") for i in range(4)]
    ok = F.size(part) == 4
    for o in octets:
        ok = ok & o.between(0, 255)
    value = octets[0].cast("bigint") * (1 << 24) + octets[1].cast("bigint") * (1 << 16) + octets[2].cast("bigint") * (1 << 8) + octets[3]
    return F.when(ok, value)


def negative_zero(value: Column) -> Column:
    """Whether a float is -0.0, which grouping and joining take for 0.0.  Their other values differ where their bits do, NaNs aside."""
    return (value == 0) & value.cast("string").startswith("-")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")
