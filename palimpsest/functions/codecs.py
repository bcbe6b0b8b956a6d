"""Binary forms of keys and values as column expressions, and their checksums.

Memory form of a key: namespace (8 bytes, little endian), key bytes, complement of the
version time (16 bytes, little endian). Storage form: checksum and length (4 bytes each) in
front. Values: namespace and payload, with the same front. The forms are for export; the
engine itself compares columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes of the parts of an encoded key or value.
NS_BYTES = 8
TS_BYTES = 16
FRONT_BYTES = 8


def _bytes(x: Column, width: int) -> Column:
    """A bigint's low ``width`` bytes, little endian."""
    h = F.lpad(F.hex(x), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(width))))


def _number(raw: Column, start: int, width: int = 8) -> Column:
    """The bigint of ``width`` little-endian bytes from the 1-based ``start``; negative for a set top bit."""
    h = F.hex(F.substring(raw, start, width))
    big = F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))))
    return F.conv(big, 16, -10).cast("long")


def encode_key(ns: Column, key: Column, ts: Column) -> Column:
    return F.concat(_bytes(ns, 8), key, _bytes(F.bitwise_not(ts), 8), F.lit(bytearray(b"\xff" * 8)))


def encode_pointer(ns: Column, key: Column) -> Column:
    """The form that stands for a key's newest version, all bytes of the time set."""
    return F.concat(_bytes(ns, 8), key, F.lit(bytearray(b"\xff" * TS_BYTES)))


def decode_ns(raw: Column) -> Column:
    return _number(raw, 1)


def decode_key(raw: Column) -> Column:
    return raw.substr(F.lit(NS_BYTES + 1), F.octet_length(raw) - (NS_BYTES + TS_BYTES))


def decode_ts(raw: Column) -> Column:
    tail = raw.substr(F.octet_length(raw) - (TS_BYTES - 1), F.lit(8))
    return F.bitwise_not(_number(tail, 1))


def encode_value(ns: Column, value: Column) -> Column:
    return F.concat(_bytes(ns, 8), value)


def decode_value(raw: Column) -> Column:
    return raw.substr(F.lit(NS_BYTES + 1), F.octet_length(raw) - NS_BYTES)


def store_key(ns: Column, key: Column, ts: Column) -> Column:
    """Storage form; the length counts everything after it."""
    return F.concat(_bytes(F.crc32(key), 4), _bytes(F.octet_length(key).cast("long") + NS_BYTES + TS_BYTES, 4), encode_key(ns, key, ts))


def store_value(ns: Column, value: Column) -> Column:
    return F.concat(_bytes(F.crc32(value), 4), _bytes(F.octet_length(value).cast("long") + NS_BYTES, 4), encode_value(ns, value))


def stored_crc(raw: Column) -> Column:
    return F.conv(F.concat(*(F.substring(F.hex(F.substring(raw, 1, 4)), 2 * i + 1, 2) for i in reversed(range(4)))), 16, 10).cast("long")


def load_value(raw: Column) -> Column:
    """The payload of a stored value, null where its checksum does not hold."""
    body = decode_value(raw.substr(F.lit(FRONT_BYTES + 1), F.octet_length(raw) - FRONT_BYTES))
    return F.when(F.crc32(body) == stored_crc(raw), body)


def load_key(raw: Column) -> Column:
    """The key bytes of a stored key, null where its checksum does not hold."""
    body = decode_key(raw.substr(F.lit(FRONT_BYTES + 1), F.octet_length(raw) - FRONT_BYTES))
    return F.when(F.crc32(body) == stored_crc(raw), body)


def raw_length(key: Column) -> Column:
    return F.octet_length(key) + (NS_BYTES + TS_BYTES)


def run_bytes(key: Column, value: Column) -> Column:
    """What a version takes of a run's limit: its key three times (version, pointer, pointer's
    target), its value, and the pointer's time."""
    return (3 * raw_length(key) + NS_BYTES + F.coalesce(F.octet_length(value), F.lit(0)) + TS_BYTES).cast("long")


def le_hex(x: Column) -> Column:
    """A bigint as upper-case hex of its 8 bytes, little endian."""
    h = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(8)))


def le_numbers(raw: Column, first: Column, n: Column) -> Column:
    """``n`` little-endian numbers of 8 bytes of a binary from number ``first`` (0-based) on."""
    def one(i: Column) -> Column:
        h = F.hex(raw.substr(((first + i) * 8 + 1).cast("int"), F.lit(8)))
        return F.conv(F.concat(*(F.substring(h, 15 - 2 * k, 2) for k in range(8))), 16, -10).cast("long")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), one)).otherwise(F.array().cast("array<bigint>"))
