"""Reading ZIP packages by their directories, without extraction."""

from __future__ import annotations

import struct
from typing import NamedTuple

# Fixed values of the public ZIP format: signatures, and the marks "see ZIP64".
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64, LOCATOR64, EXTRA64 = b"PK\x06\x06", b"PK\x06\x07", 1
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


class Member(NamedTuple):
    name: str
    method: int
    stored_size: int
    size: int
    header: int


def _end(file, size: int) -> tuple[int, int, int]:
    """(members, size, offset) of the central directory, from the end records."""
    tail_at = max(0, size - 22 - FULL16)
    tail = bytes(file.read_at(size - tail_at, tail_at))
    at = tail.rfind(END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(END, 0, at)  # the bytes of a comment may look like a record
    if at < 0:
        raise ValueError("no end of central directory: this is not a ZIP file")
    count, length, offset = struct.unpack("<HLL", tail[at + 10 : at + 20])
    locator = bytes(file.read_at(20, tail_at + at - 20)) if tail_at + at >= 20 else b""
    if locator[:4] == LOCATOR64 and (count == FULL16 or FULL32 in (length, offset)):
        record = bytes(file.read_at(56, struct.unpack("<Q", locator[8:16])[0]))
        if record[:4] != END64:
            raise ValueError("the ZIP64 locator points at no record")
        count, length, offset = struct.unpack("<QQQ", record[32:56])
    return count, length, offset


def members(file) -> dict[str, Member]:
    """The members of an open archive by name, from its central and ZIP64 directories."""
    count, length, offset = _end(file, file.size())
    raw, at, found = bytes(file.read_at(length, offset)), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", raw[at + 8 : at + 12])
        stored, size, name, extra, comment = struct.unpack("<LLHHH", raw[at + 20 : at + 34])
        header = struct.unpack("<L", raw[at + 42 : at + 46])[0]
        label = raw[at + 46 : at + 46 + name].decode("utf-8" if flags & 0x800 else "cp437")
        fields = raw[at + 46 + name : at + 46 + name + extra]
        while len(fields) >= 4:
            kind, held = struct.unpack("<HH", fields[:4])
            if kind == EXTRA64:  # only what did not fit, in this order
                wide = iter(struct.unpack(f"<{held // 8}Q", fields[4 : 4 + held // 8 * 8]))
                size = next(wide) if size == FULL32 else size
                stored = next(wide) if stored == FULL32 else stored
                header = next(wide) if header == FULL32 else header
            fields = fields[4 + held :]
        found[label] = Member(label, method, stored, size, header)
        at += 46 + name + extra + comment
    return found


def data_offset(file, member: Member) -> int:
    """Where a stored member's bytes begin; refuses compressed members, which allow no range reads."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed inside the package")
    head = bytes(file.read_at(30, member.header))
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    return member.header + 30 + sum(struct.unpack("<HH", head[26:30]))
