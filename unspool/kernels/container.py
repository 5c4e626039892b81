"""Where a payload stands within a file: signatures, carved streams, PE resources, and their observations."""

from __future__ import annotations

import struct

from unspool.kernels import ciphers
from unspool.kernels.records import LAYOUTS, MARKER, Limits, parse

#: The two spellings of the signature's identifier, its tag, versions, and subtypes that prove a stream.
GUID = bytes.fromhex("a3484bbe986c4aa9994c530a86d6487d")
OTHER_GUID = bytes.fromhex("a3484bbe986ca94a994c530a86d6487d")
TAG = b"AU3!"
VERSIONS = {b"EA05": "Ea05", b"EA06": "Ea06", b"JB01": "Jb01"}
LOOSE_ORDER = (b"EA06", b"EA05", b"JB01")
ANCHORS = (b"AU3!", b"AutoIt", b"SCRIPT")
PROVING_SUBTYPES = {b">AUTOIT SCRIPT<", b">AUTOIT UNICODE SCRIPT<", b">>>AUTOIT SCRIPT<<<", b">>>AUTOIT NO CMDEXECUTE<<<", b">AUTOHOTKEY SCRIPT<", b">AHK WITH ICON<"}
KNOWN_SUBTYPES = {">>>AUTOIT SCRIPT<<<": "TokenizedScript", ">AUTOIT UNICODE SCRIPT<": "UnicodeScript", ">AUTOIT SCRIPT<": "PlainScript"}
JB01_PASSPHRASE_XOR, LONGEST_PASSPHRASE, LONGEST_SUBTYPE = 0xFAC1, 1024, 64
_RCDATA, _RESOURCE_NAME = 10, "SCRIPT"


def find(data: bytes, needle: bytes) -> int | None:
    at = data.find(needle) if needle else -1
    return at if at >= 0 else None


def _u(data: bytes, at: int, n: int) -> int | None:
    return int.from_bytes(data[at : at + n], "little") if 0 <= at and at + n <= len(data) else None


def starts_stream(data: bytes, offset: int, encoding: str) -> bool:
    return data[offset : offset + 4] == MARKER[LAYOUTS[encoding].cipher]


def stream_after_version(data: bytes, version_offset: int, encoding: str) -> int:
    """The stream follows the version tag, or 16 bytes later where only there a record begins."""
    direct = version_offset + 4
    if encoding in ("Ea05", "Ea06") and not starts_stream(data, direct, encoding) and starts_stream(data, direct + 16, encoding):
        return direct + 16
    return direct


def signature(data: bytes) -> dict | None:
    """The first signature, if a known version follows it; later ones are not looked at."""
    hits = [at for guid in (GUID, OTHER_GUID) if (at := data.find(guid + TAG)) >= 0]
    if not hits:
        return None
    version = min(hits) + len(GUID) + len(TAG)
    encoding = VERSIONS.get(data[version : version + 4])
    if encoding is None:
        return None
    return {"offset": min(hits), "version_offset": version, "encoding": encoding, "stream": stream_after_version(data, version, encoding)}


def _proven(data: bytes, offset: int) -> bool:
    """Whether a Twister-keyed record at offset has a subtype that is known."""
    count = _u(data, offset + 4, 4)
    layout = LAYOUTS["Ea04"]
    if count is None or not 1 <= (count := count ^ layout.subtype_xor) <= LONGEST_SUBTYPE or offset + 8 + count > len(data):
        return False
    return ciphers.crypt(layout.cipher, data[offset + 8 : offset + 8 + count], layout.subtype_key + count) in PROVING_SUBTYPES


def _hits(data: bytes, needle: bytes):
    at = data.find(needle)
    while at >= 0:
        yield at
        at = data.find(needle, at + 1)


def carve_ea04(data: bytes) -> int | None:
    return next((at for at in _hits(data, MARKER[ciphers.MT]) if _proven(data, at)), None)


def carve_jb01(data: bytes) -> int | None:
    for at in _hits(data, GUID):
        size = _u(data, at + 17, 4)
        if data[at + 16 : at + 17] == b"\x03" and size is not None and (size := size ^ JB01_PASSPHRASE_XOR) <= LONGEST_PASSPHRASE:
            stream = at + 21 + size
            if _proven(data, stream):
                return stream
    return None


def loose_version(data: bytes) -> tuple[str, int] | None:
    if not any(a in data for a in ANCHORS):
        return None
    return next(((VERSIONS[v], at) for v in LOOSE_ORDER if (at := data.find(v)) >= 0), None)


def script_resource(data: bytes) -> dict | None:
    """The RT_RCDATA resource named SCRIPT of a PE file."""
    try:
        return _script_resource(data)
    except (struct.error, ValueError):
        return None


def _script_resource(data: bytes) -> dict | None:
    if data[:2] != b"MZ":
        return None
    (pe,) = struct.unpack_from("<I", data, 0x3C)
    if data[pe : pe + 4] != b"PE\0\0":
        return None
    sections, optional_size = struct.unpack_from("<H12xH", data, pe + 6)
    optional = pe + 24
    (magic,) = struct.unpack_from("<H", data, optional)
    directories = {0x10B: 96, 0x20B: 112}.get(magic)
    if directories is None or optional + optional_size > len(data):
        return None
    rva, size = struct.unpack_from("<II", data, optional + directories + 16)
    if not rva or not size:
        return None
    table = []
    for k in range(sections):
        if optional + optional_size + 40 * (k + 1) > len(data):
            return None
        vsize, va, raw_size, raw = struct.unpack_from("<IIII", data, optional + optional_size + 40 * k + 8)
        table.append((va, max(vsize, raw_size), raw))

    def place(address: int) -> int | None:
        for va, span, raw in table:
            if va + span > 0xFFFFFFFF:
                return None
            if va <= address < va + span:
                return raw + address - va
        return None

    base = place(rva)
    if base is None or base + size > len(data):
        return None

    def entries(at: int):
        named, ids = struct.unpack_from("<HH", data, at + 12)
        return [struct.unpack_from("<II", data, at + 16 + 8 * k) for k in range(named + ids)]

    def name_of(value: int) -> str | None:
        if not value >> 31:
            return None
        at = base + (value & 0x7FFFFFFF)
        count = _u(data, at, 2)
        if count is None or len(raw := data[at + 2 : at + 2 + 2 * count]) < 2 * count:
            return None
        try:
            return raw.decode("utf-16-le")
        except UnicodeDecodeError:
            return None

    types = next((base + (to & 0x7FFFFFFF) for own, to in entries(base) if own == _RCDATA), None)
    kind_to = next((to for own, to in entries(base) if own == _RCDATA), None)
    if types is None or not kind_to >> 31:
        return None
    name_to = next((to for own, to in entries(types) if name_of(own) == _RESOURCE_NAME), None)
    if name_to is None or not name_to >> 31:
        return None
    leaf = next(((own, to) for own, to in entries(base + (name_to & 0x7FFFFFFF)) if not to >> 31), None)
    if leaf is None:
        return None
    language, to = leaf
    data_rva, data_size, _, _ = struct.unpack_from("<IIII", data, base + to)
    offset = place(data_rva)
    if offset is None or offset + data_size > len(data):
        return None
    stream = None
    if data_size >= 0x18:
        version = VERSIONS.get(data[offset + 20 : offset + 24])
        stream = stream_after_version(data, offset + 20, version) if version else offset + 0x18
    # A language is an id only while it has no name and fits sixteen bits.
    return {"type_id": _RCDATA, "type_name": "RT_RCDATA", "name": _RESOURCE_NAME, "language_id": language if language <= 0xFFFF else None, "rva": data_rva, "offset": offset, "size": data_size, "stream": stream}


def analyse(data: bytes, limits: Limits = Limits(), packed_in_stream: bool = True, later: list[dict] | None = None) -> dict:
    """One file: failure or kind, encoding, ordered observations, records and at most one diagnostic.

    packed_in_stream: whether a packed marker counts from the stream's start on, where encrypted bytes
    hold one by chance (three bytes: one in 16 MB). later: see records.parse.
    """
    raw, resource, loose, packed = signature(data), script_resource(data), loose_version(data), find(data, b"UPX")
    ea04 = jb01 = None
    if raw is None and resource is None:
        ea04, jb01 = carve_ea04(data), carve_jb01(data)
    is_pe = data[:2] == b"MZ"
    if raw is None and resource is None and ea04 is None and jb01 is None and not (is_pe and packed is not None and loose):
        return {"failure": "NotRecognized", "observations": [], "records": []}
    if not packed_in_stream and packed is not None:
        start = resource["stream"] if resource and resource["stream"] is not None else raw["stream"] if raw else jb01 if jb01 is not None else ea04
        if start is not None and packed + 3 > start:
            packed = None
    seen: list[dict] = []

    def note(kind: str, **what) -> None:
        seen.append({"kind": kind, **what})

    def note_stream(offset: int, encoding: str | None, certain: bool = False) -> None:
        note("PayloadStreamStartFound", offset=offset)
        if encoding and (certain or starts_stream(data, offset, encoding)):
            note("FirstFileRecordDecrypted", encoding=encoding, offset=offset)

    if is_pe:
        note("OuterPeHeaderFound")
    if packed is not None:
        note("PackedMarkerFound", name="UPX", offset=packed)
    if resource:
        note("PeScriptResourceFound", **{k: v for k, v in resource.items() if k != "stream"})
        if resource["stream"] is not None:
            note_stream(resource["stream"], "Ea06")
    if raw:
        note("AutoItSignatureFound", offset=raw["offset"])
        note("VersionMarkerFound", encoding=raw["encoding"], offset=raw["version_offset"])
        note_stream(raw["stream"], raw["encoding"])
    elif jb01 is not None:
        note_stream(jb01, "Jb01", True)
    elif ea04 is not None:
        note_stream(ea04, "Ea04", True)
    elif loose:
        note("VersionMarkerFound", encoding=loose[0], offset=loose[1])
    first = lambda kind, what: next((o[what] for o in seen if o["kind"] == kind), None)
    encoding = raw["encoding"] if raw else first("FirstFileRecordDecrypted", "encoding") or (loose[0] if loose else None)
    stream = first("PayloadStreamStartFound", "offset")
    found, diagnostic = parse(data, stream, encoding, limits, later) if encoding and stream is not None else ([], None)
    if found and (subtype := KNOWN_SUBTYPES.get(found[0]["subtype"])):
        note("KnownSubtypeDecrypted", encoding=encoding, offset=found[0]["offset"], subtype=subtype)
    return {
        "failure": None,
        "input_kind": "Pe" if is_pe else "A3x" if raw and raw["offset"] == 0 else "RawStream",
        "encoding": encoding,
        "observations": seen,
        "records": found,
        "diagnostic": diagnostic,
    }
