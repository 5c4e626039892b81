"""Kernels as Arrow functions and table functions, and their SQL names."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DecimalType, DoubleType, IntegerType, LongType, StringType, StructType

from unspool.kernels import ciphers, records, tokens, unpack


@F.arrow_udf(StructType().add("data", BinaryType()).add("reason", StringType()))
def decompress(blob: pa.Array) -> pa.Array:
    """The blob's bytes, or the reason why there are none."""
    out = [unpack.inflate(b) if b is not None else (None, None) for b in blob.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["data", "reason"])


def _xor(cipher: str, data: pa.Array, seed: pa.Array) -> pa.Array:
    return pa.array([None if d is None or s is None else ciphers.crypt(cipher, d, s) for d, s in zip(data.to_pylist(), seed.to_pylist(), strict=True)], pa.binary())


@F.arrow_udf(BinaryType())
def mt_xor(data: pa.Array, seed: pa.Array) -> pa.Array:
    return _xor(ciphers.MT, data, seed)


@F.arrow_udf(BinaryType())
def lame_xor(data: pa.Array, seed: pa.Array) -> pa.Array:
    return _xor(ciphers.LAME, data, seed)


@F.arrow_udf(LongType())
def adler32(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else zlib.adler32(d) for d in data.to_pylist()], pa.int64())


_RECORD = StructType().add("record_index", LongType()).add("offset", LongType()).add("subtype", StringType()).add("name", StringType()).add("payload", BinaryType()).add("checksum_valid", BooleanType()).add("reason", StringType())
_TOKEN = StructType().add("pos", IntegerType()).add("kind", StringType()).add("text", StringType()).add("i", IntegerType()).add("u", DecimalType(20, 0)).add("f", DoubleType()).add("error", StringType())


@F.udtf(returnType=_RECORD)
class ParseRecords:
    """parse_records(content, offset, encoding): a row for each record, and one with a reason where parsing stopped early."""

    def eval(self, content: bytes, offset: int, encoding: str) -> Iterator[tuple]:
        found, stop = records.parse(bytes(content), offset, encoding)
        for r in found:
            data = r["decompressed_data"] if r["decompressed_data"] is not None else r["decrypted_data"]
            yield r["record_index"], r["offset"], r["subtype"], r["name"], data, r["checksum_valid"], None
        if stop:
            yield stop["record_index"], stop["offset"], None, None, None, None, stop["reason"]


@F.udtf(returnType=_TOKEN)
class ParseTokens:
    """parse_tokens(bytes): a row for each token, or one with the error."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        _, found, error = tokens.parse(bytes(data))
        if error:
            yield None, None, None, None, None, None, error
        for pos, (kind, text, i, u, f) in enumerate(found or []):
            yield pos, kind, text, i, None if u is None else Decimal(u), f, None


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL: decompress, mt_xor, lame_xor, adler32_bytes, parse_records, parse_tokens."""
    for name, function in (("decompress", decompress), ("mt_xor", mt_xor), ("lame_xor", lame_xor), ("adler32_bytes", adler32)):
        spark.udf.register(name, function)
    spark.udtf.register("parse_records", ParseRecords)
    spark.udtf.register("parse_tokens", ParseTokens)
