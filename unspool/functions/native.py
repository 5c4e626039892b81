"""Byte functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from unspool.kernels import container as scan

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lowered and nothing else."""
    return F.translate(text, UPPER, LOWER)


def latin1(data: Column) -> Column:
    """Bytes as text with one character a byte."""
    return F.decode(data, "ISO-8859-1")


def find_bytes(data: Column, needle: bytes) -> Column:
    """Offset of the first match, null without one or for an empty needle."""
    if not needle:
        return F.lit(None).cast("long")
    return F.nullif(F.instr(latin1(data), F.lit(needle.decode("latin-1"))), F.lit(0)).cast("long") - 1


def has_mz_header(data: Column) -> Column:
    return F.coalesce(F.substring(data, 1, 2) == F.lit(bytearray(b"MZ")), F.lit(False))


def little_endian(data: Column, offset: Column | int, size: int) -> Column:
    """An unsigned number of up to seven bytes, null where data ends before."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    digits = F.hex(F.substring(data, at + 1, F.lit(size)))
    turned = F.concat(*[F.substring(digits, F.lit(2 * k + 1), F.lit(2)) for k in range(size - 1, -1, -1)])
    return F.when(F.length(digits) == 2 * size, F.conv(turned, 16, 10).cast("long"))


def loose_version(data: Column) -> Column:
    """struct(encoding, offset) of the first version tag in order of preference, if an anchor is there too."""
    text = latin1(data)
    anchored = F.lit(False)
    for anchor in scan.ANCHORS:
        anchored |= text.contains(anchor.decode())
    found = [F.when(find_bytes(data, v).isNotNull(), F.struct(F.lit(scan.VERSIONS[v]).alias("encoding"), find_bytes(data, v).alias("offset"))) for v in scan.LOOSE_ORDER]
    return F.when(anchored, F.coalesce(*found))


def raw_signature_offset(data: Column) -> Column:
    """Offset of the first signature of either spelling."""
    return F.least(*[find_bytes(data, guid + scan.TAG) for guid in (scan.GUID, scan.OTHER_GUID)])


def byte_sum(data: Column) -> Column:
    digits = F.hex(data)
    size = F.octet_length(data)
    each = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))
    return F.when(size > 0, F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)).otherwise(F.lit(0).cast("long"))
