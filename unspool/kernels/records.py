"""Records of a payload stream: layout, keys per encoding, limits, and the encoder that inverts them."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from unspool.kernels import ciphers, unpack
from unspool.kernels.unpack import LIMIT, TRUNCATED


@dataclass(frozen=True)
class Layout:
    """Keys of one encoding; size: bytes of a metadata character."""

    cipher: str
    size: int
    file_key: int
    subtype_xor: int
    subtype_key: int
    name_xor: int
    name_key: int
    size_xor: int
    data_key: int
    checksum_xor: int | None
    salted: bool = False


#: The keys of the four encodings.
_TWISTER = (ciphers.MT, 1, 0x16FA, 0x29BC, 0xA25E, 0x29AC, 0xF25E, 0x45AA, 0x22AF)
LAYOUTS = {
    "Ea04": Layout(*_TWISTER, None),
    "Ea05": Layout(*_TWISTER, 0xC3D2, True),
    "Ea06": Layout(ciphers.LAME, 2, 0x18EE, 0xADBC, 0xB33F, 0xF820, 0xF479, 0x87BC, 0x2477, 0xA685),
    "Jb01": Layout(*_TWISTER, None),
}
#: How an encrypted FILE marker looks under each cipher.
MARKER = {ciphers.MT: bytes.fromhex("ff6db0ce"), ciphers.LAME: bytes.fromhex("6b43ca52")}
COMPRESSION = {b"EA04": "Ea04", b"EA05": "Ea05", b"EA06": "Ea06", b"JB00": "Jb00", b"JB01": "Jb01"}


@dataclass(frozen=True)
class Limits:
    max_records: int = 256
    max_encrypted_blob_size: int = 64 << 20
    max_metadata_string_bytes: int = 1 << 20
    max_decompressed_blob_size: int = 64 << 20


class _Stop(Exception):
    pass


class _Cursor:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise _Stop(TRUNCATED)
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")


def salt_of(data: bytes, offset: int, encoding: str) -> int:
    """What the bytes before an EA05 stream add to its data key: their sum, if a version tag stands before them."""
    if LAYOUTS[encoding].salted and offset >= 20 and data[offset - 20 : offset - 16] == b"EA05":
        return sum(data[offset - 16 : offset])
    return 0


def _text(cursor: _Cursor, layout: Layout, count: int, key: int, limits: Limits) -> tuple[bytes, str]:
    if count * layout.size > limits.max_metadata_string_bytes:
        raise _Stop(LIMIT)
    raw = ciphers.crypt(layout.cipher, cursor.take(count * layout.size), key + count)
    return raw, raw.decode("utf-8" if layout.size == 1 else "utf-16-le", "replace")


def _one(cursor: _Cursor, encoding: str, index: int, salt: int, limits: Limits, later: list[dict] | None) -> dict | None:
    layout, offset = LAYOUTS[encoding], cursor.at
    if offset >= len(cursor.data):
        return None
    if cursor.take(4) != MARKER[layout.cipher]:
        return None
    subtype = _text(cursor, layout, cursor.number(4) ^ layout.subtype_xor, layout.subtype_key, limits)
    name = _text(cursor, layout, cursor.number(4) ^ layout.name_xor, layout.name_key, limits)
    compressed = cursor.number(1) != 0
    stored, full = cursor.number(4) ^ layout.size_xor, cursor.number(4) ^ layout.size_xor
    checksum = cursor.number(4) ^ layout.checksum_xor if layout.checksum_xor is not None else 0
    created, written = cursor.number(8), cursor.number(8)
    if stored > limits.max_encrypted_blob_size:
        raise _Stop(LIMIT)
    encrypted = cursor.take(stored)
    plain = ciphers.crypt(layout.cipher, encrypted, layout.data_key + salt)
    record = {
        "record_index": index,
        "offset": offset,
        "subtype_bytes": subtype[0],
        "subtype": subtype[1],
        "name_bytes": name[0],
        "name": name[1],
        "compressed": compressed,
        "compressed_size": stored,
        "uncompressed_size": full,
        "checksum": checksum,
        "checksum_valid": layout.checksum_xor is None or zlib.adler32(plain) == checksum,
        "creation_time": created,
        "last_write_time": written,
        "encrypted_data": encrypted,
        "decrypted_data": plain,
        "decompressed_data": None,
        "decompression": {"kind": "NotCompressed", "reason": None},
        "profile": {"encoding": encoding, "encryption": layout.cipher, "compression": COMPRESSION.get(plain[:4], "Unknown") if compressed else "None"},
    }
    if compressed and later is None:
        settle([record], limits)
    elif compressed:
        later.append(record)
    return record


def settle(later: list[dict], limits: Limits = Limits()) -> None:
    """Decompress what parse() has put off; many blobs at once take less time."""
    for record, (out, reason) in zip(later, unpack.inflate_many([r["decrypted_data"] for r in later], limits.max_decompressed_blob_size), strict=True):
        record["decompressed_data"] = out
        record["decompression"] = {"kind": "Decompressed" if reason is None else "Failed", "reason": reason}


def parse(data: bytes, offset: int, encoding: str, limits: Limits = Limits(), later: list[dict] | None = None) -> tuple[list[dict], dict | None]:
    """Records from offset on, and the diagnostic where parsing stopped before the stream's end.

    later: takes the compressed records, which settle() decompresses.
    """
    cursor, salt, found = _Cursor(data, offset), salt_of(data, offset, encoding), []
    while len(found) < limits.max_records:
        at = cursor.at
        try:
            record = _one(cursor, encoding, len(found), salt, limits, later)
        except _Stop as stop:
            return found, {"record_index": len(found), "offset": at, "reason": str(stop)}
        if record is None:
            return found, None
        found.append(record)
    return found, {"record_index": limits.max_records, "offset": cursor.at, "reason": LIMIT}


def encode(encoding: str, subtype: str, name: str, data: bytes, *, packed: bool = False, full_size: int | None = None, salt: int = 0, created: int = 0, written: int = 0) -> bytes:
    """One record; data is what the record stores before encryption, packed tells if it is a compressed blob."""
    layout = LAYOUTS[encoding]

    def text(value: str, xor: int, key: int) -> bytes:
        raw = value.encode("utf-8" if layout.size == 1 else "utf-16-le")
        count = len(raw) // layout.size
        return struct.pack("<I", count ^ xor) + ciphers.crypt(layout.cipher, raw, key + count)

    head = MARKER[layout.cipher] + text(subtype, layout.subtype_xor, layout.subtype_key) + text(name, layout.name_xor, layout.name_key)
    head += struct.pack("<BII", packed, len(data) ^ layout.size_xor, (len(data) if full_size is None else full_size) ^ layout.size_xor)
    if layout.checksum_xor is not None:
        head += struct.pack("<I", zlib.adler32(data) ^ layout.checksum_xor)
    return head + struct.pack("<QQ", created, written) + ciphers.crypt(layout.cipher, data, layout.data_key + salt)
