"""Test payloads: whole containers around records."""

from __future__ import annotations

import struct

from unspool.kernels import unpack
from unspool.kernels.container import GUID, JB01_PASSPHRASE_XOR, TAG
from unspool.kernels.records import encode

PLAIN, UNICODE, TOKENIZED, AHK, AHK_ICON = ">AUTOIT SCRIPT<", ">AUTOIT UNICODE SCRIPT<", ">>>AUTOIT SCRIPT<<<", ">AUTOHOTKEY SCRIPT<", ">AHK WITH ICON<"
SALT = bytes(range(16))


def container(encoding: str, records: bytes, salted: bool = False, filler: bytes = b"") -> bytes:
    """A raw stream of the encoding's own kind around encoded records; filler stands before it."""
    if encoding == "Ea04":
        return filler + b"stub" + records
    if encoding == "Jb01":
        passphrase = b"none"
        return filler + GUID + b"\x03" + struct.pack("<I", len(passphrase) ^ JB01_PASSPHRASE_XOR) + passphrase + records
    return filler + GUID + TAG + encoding.upper().encode() + (SALT if salted else b"") + records


def packed(encoding: str, data: bytes) -> bytes:
    return unpack.deflate_adaptive(data) if encoding == "Jb01" else unpack.deflate_lz(data, encoding.upper().encode())


def script_payload(encoding: str, text: str, compress: bool, name: str = "script", subtype: str = PLAIN, blob: bytes | None = None) -> bytes:
    """A stream of one script and one other record; blob: what packed() makes of the script, where it is known."""
    salted = encoding == "Ea05"
    salt = sum(SALT) if salted else 0
    raw = text.encode("utf-16-le") if subtype == UNICODE else text.encode()
    data = (blob if blob is not None else packed(encoding, raw)) if compress else raw
    script = encode(encoding, subtype, name, data, packed=compress, full_size=len(raw), salt=salt, created=1, written=2)
    other = encode(encoding, "payload", name + ".bin", b"bytes of " + name.encode(), salt=salt)
    return container(encoding, script + other, salted)


def pe_with_resource(content: bytes) -> bytes:
    """A PE file whose RT_RCDATA resource SCRIPT (language 1033) is content."""
    base, rva, raw = 0x200, 0x1000, 0x200
    head = bytearray(0x200)
    head[:2] = b"MZ"
    struct.pack_into("<I", head, 0x3C, 0x80)
    head[0x80:0x84] = b"PE\0\0"
    struct.pack_into("<HH12xHH", head, 0x84, 0x14C, 1, 0xE0, 0x102)
    struct.pack_into("<H", head, 0x98, 0x10B)
    struct.pack_into("<II", head, 0x98 + 96 + 16, rva, 0x100)
    span = 0x200 + len(content)
    struct.pack_into("<8sIIII", head, 0x98 + 0xE0, b".rsrc", span, rva, span, raw)
    body = bytearray(0x100)
    struct.pack_into("<HHII", body, 12, 0, 1, 10, 0x80000000 | 0x18)
    struct.pack_into("<HHII", body, 0x18 + 12, 1, 0, 0x80000000 | 0x60, 0x80000000 | 0x30)
    struct.pack_into("<HHII", body, 0x30 + 12, 0, 1, 1033, 0x48)
    struct.pack_into("<IIII", body, 0x48, rva + 0x100, len(content), 0, 0)
    struct.pack_into("<H", body, 0x60, 6)
    body[0x62:0x6E] = "SCRIPT".encode("utf-16-le")
    assert len(head) == base
    return bytes(head) + bytes(body) + content
