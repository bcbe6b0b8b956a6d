"""Slotted blocks of 4096 bytes: layout, cutting of long payloads, and the byte form.

A block holds a count (2 bytes), an end offset per entry (2 bytes each), then each entry's
flag byte and payload. All numbers are little endian.
"""

from __future__ import annotations

from palimpsest.errors import BlockFull, CorruptBlock, EntryTooLarge

# The layout, and the flags of whole and cut entries.
BLOCK_BYTES = 4096
COUNT_BYTES = 2
OFFSET_BYTES = 2
FLAG_BYTES = 1
ENTRY_BYTES = OFFSET_BYTES + FLAG_BYTES
MAX_PAYLOAD = 4090
COMPLETE, START, MIDDLE, END = 0, 1, 2, 3

#: What entries may take of a block together where it is filled in order: one entry of the longest payload fills it.
CAPACITY = MAX_PAYLOAD + ENTRY_BYTES
#: What entries can take of a block together: all but its count.
ROOM = BLOCK_BYTES - COUNT_BYTES


def cut(length: int, first: int = MAX_PAYLOAD) -> list[tuple[int, int, int]]:
    """``(start, end, flag)`` of the pieces of a payload; the first piece takes ``first`` bytes at most."""
    if length <= first:
        return [(0, length, COMPLETE)]
    at = [0, *range(first, length, MAX_PAYLOAD), length]
    return [(a, b, START if not a else END if b == length else MIDDLE) for a, b in zip(at[:-1], at[1:])]


def check_fit(used: int, payload: int) -> None:
    """Raise if a payload does not fit into a block whose entries take ``used`` bytes."""
    if payload > MAX_PAYLOAD:
        raise EntryTooLarge(f"{payload} bytes in a block for {MAX_PAYLOAD}")
    if used + payload + ENTRY_BYTES > ROOM:
        raise BlockFull("entry does not fit")


def page(flags: list[int], entries: list[bytes]) -> bytes:
    """The bytes of one block."""
    used, ends, end = 0, [], 0
    for e in entries:
        check_fit(used, len(e))
        used += len(e) + ENTRY_BYTES
        end += len(e) + FLAG_BYTES
        ends.append(end)
    head = len(entries).to_bytes(COUNT_BYTES, "little") + b"".join(x.to_bytes(OFFSET_BYTES, "little") for x in ends)
    return (head + b"".join(bytes([f]) + bytes(e) for f, e in zip(flags, entries))).ljust(BLOCK_BYTES, b"\0")


def read_page(raw: bytes) -> list[tuple[int, bytes]]:
    """``(flag, payload)`` of every entry of a block; :class:`CorruptBlock` if the bytes are none."""
    raw = bytes(raw)
    if len(raw) != BLOCK_BYTES:
        raise CorruptBlock(f"{len(raw)} bytes")
    n = int.from_bytes(raw[:COUNT_BYTES], "little")
    start = COUNT_BYTES + OFFSET_BYTES * n
    ends = [0, *(int.from_bytes(raw[i : i + OFFSET_BYTES], "little") for i in range(COUNT_BYTES, start, OFFSET_BYTES))]
    if start + ends[-1] > BLOCK_BYTES or any(a >= b for a, b in zip(ends, ends[1:])):
        raise CorruptBlock("offsets do not ascend within the block")
    return [(raw[start + a], raw[start + a + FLAG_BYTES : start + b]) for a, b in zip(ends, ends[1:])]
