"""Files to tables: one kernel call for each file, everything after it in DataFrame operations."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from unspool.batches import small_batches
from unspool.kernels import container as scan
from unspool.kernels import records as rec
from unspool.kernels import tokens as tok
from unspool.schema import PARSED, TOKENS

BLOBS = ("encrypted_data", "decrypted_data", "decompressed_data")
#: Which subtypes are scripts, and of what kind.
SCRIPT_KINDS = {">>>AUTOIT SCRIPT<<<": "Tokenized", ">AUTOIT UNICODE SCRIPT<": "UnicodeText", ">AUTOIT SCRIPT<": "PlainText", ">AUTOHOTKEY SCRIPT<": "PlainText", ">AHK WITH ICON<": "PlainText"}
SCRIPT_SUBTYPES = [*SCRIPT_KINDS]


#: Bytes that a row's Python objects take beside its value, and bytes of rows that a kernel gets at once.
_ROW_BYTES, _PIECE_BYTES = 2048, 1 << 20


def map_column(df: DataFrame, column: str, out: str, kernel, keep: list[str], most: int = _PIECE_BYTES) -> DataFrame:
    """df's keep columns and the fields of the struct type `out` that kernel gives, as dicts or a batch, for a list of values of the binary column.

    Large rows: batches are small, and a kernel gets pieces of them of some `most` bytes, so a worker's memory
    doesn't depend on the number of rows.
    """
    small_batches(df.sparkSession, 4 << 20)
    schema = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _struct(df, out).fields))
    kept = StructType([df.schema[c] for c in keep])
    made = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + _ROW_BYTES)
            cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), batch.num_rows]
            for a, b in itertools.pairwise(cuts):
                if a < b:
                    piece = batch.slice(a, b - a)
                    new = kernel(piece.column(column).to_pylist())
                    if not isinstance(new, pa.RecordBatch):
                        new = pa.RecordBatch.from_pylist(new, schema=made)
                    old = piece.select(keep)
                    yield pa.RecordBatch.from_arrays([*old.columns, *new.columns], schema=pa.schema([*old.schema, *made]))

    return df.select(*dict.fromkeys([*keep, column])).mapInArrow(run, StructType([*kept.fields, *schema.fields]))


def _struct(df: DataFrame, ddl: str) -> StructType:
    return StructType.fromDDL(f"x {ddl}").fields[0].dataType


def parse(binaries: DataFrame, limits: rec.Limits = rec.Limits(), blobs: tuple[str, ...] = BLOBS, packed_in_stream: bool = True, most: int = _PIECE_BYTES) -> DataFrame:
    """binary_id, length and what was found in content; a file that isn't recognised has a failure and nothing else.

    blobs: which of a record's byte columns to carry; payload bytes need decrypted and decompressed data.
    packed_in_stream: whether packed markers count within the stream, where encrypted bytes hold some by chance.
    most: bytes of files read together; adaptive codes are read faster the more there are.
    """

    def kernel(contents: list[bytes | None]) -> list[dict]:
        later: list[dict] = []
        many = [scan.analyse(c or b"", limits, packed_in_stream, later) for c in contents]
        rec.settle(later, limits)
        for found in many:
            for seq, o in enumerate(found["observations"]):
                o["seq"] = seq
            for r in found["records"]:
                r["creation_time"], r["last_write_time"] = Decimal(r["creation_time"]), Decimal(r["last_write_time"])
                for b in BLOBS:
                    if b not in blobs:
                        r[b] = None
        return many

    sized = binaries.select("binary_id", F.octet_length("content").cast("long").alias("length"), "content")
    return map_column(sized, "content", PARSED, kernel, ["binary_id", "length"], most)


def parse_strict(binaries: DataFrame, limits: rec.Limits = rec.Limits()) -> DataFrame:
    """As parse, but a file whose records stop early fails with that reason and keeps no records."""
    parsed = parse(binaries, limits)
    stopped = F.col("diagnostic.reason")
    return parsed.withColumn("failure", F.coalesce("failure", stopped)).withColumn("records", F.when(stopped.isNull(), F.col("records")).otherwise(F.slice("records", 1, 0)))


def parse_records(streams: DataFrame, limits: rec.Limits = rec.Limits()) -> DataFrame:
    """Records of streams (binary_id, content, offset, encoding) whose place is known."""
    packed = streams.select("binary_id", F.concat(F.encode(F.concat_ws(";", F.col("offset").cast("string"), "encoding", F.lit("")), "UTF-8"), F.col("content")).alias("content"))

    def one(value: bytes) -> dict:
        offset, encoding, content = value.split(b";", 2)
        found, stop = rec.parse(content, int(offset), encoding.decode(), limits)
        for r in found:
            r["creation_time"], r["last_write_time"] = Decimal(r["creation_time"]), Decimal(r["last_write_time"])
        return {"records": found, "diagnostic": stop, "observations": [], "encoding": encoding.decode()}

    return map_column(packed, "content", PARSED, lambda values: [one(v) for v in values], ["binary_id"])


def observations(parsed: DataFrame) -> DataFrame:
    return parsed.select("binary_id", F.explode("observations").alias("o")).select("binary_id", "o.*")


def payload() -> Column:
    """The bytes a record stands for: decompressed, or decrypted where they are not or can't be."""
    return F.coalesce("decompressed_data", "decrypted_data")


def records(parsed: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a record; carry: more columns of the file's to keep."""
    return parsed.select("binary_id", *carry, F.explode("records").alias("r")).select("binary_id", *carry, "r.*").withColumn("payload_data", payload())


def record_diagnostics(parsed: DataFrame) -> DataFrame:
    return parsed.where("diagnostic is not null").select("binary_id", "diagnostic.*")


def container(seen: DataFrame) -> DataFrame:
    """Observations folded to one row a file: the last signature, version and resource, and lists in order."""
    last = lambda kind, value: F.max_by(value, F.when(F.col("kind") == kind, F.col("seq")))
    in_order = lambda kind, value: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", value.alias("v"))))), lambda x: x["v"])
    return seen.groupBy("binary_id").agg(
        last("AutoItSignatureFound", F.col("offset")).alias("signature_offset"),
        last("VersionMarkerFound", F.struct("encoding", "offset")).alias("version_marker"),
        in_order("PayloadStreamStartFound", F.col("offset")).alias("payload_stream_offsets"),
        last("PeScriptResourceFound", F.struct("type_id", "type_name", "name", "language_id", "rva", "offset", "size")).alias("pe_script_resource"),
        in_order("PackedMarkerFound", F.struct("name", "offset")).alias("packed_markers"),
    )


def first_of(seen: DataFrame) -> DataFrame:
    """The first stream start and the encoding of the first decrypted record of each file."""
    first = lambda kind, value: F.min_by(value, F.when(F.col("kind") == kind, F.col("seq")))
    return seen.groupBy("binary_id").agg(first("PayloadStreamStartFound", "offset").alias("first_stream_offset"), first("FirstFileRecordDecrypted", "encoding").alias("first_file_encoding"))


def folded() -> list[Column]:
    """container() of a row of parse() out of its own array, which is in order: no rows are dealt out or met again."""
    of = lambda kind: F.filter("observations", lambda o: o["kind"] == kind)
    last = lambda kind, value: F.get(F.transform(F.reverse(of(kind)), value), F.lit(0))
    some = lambda value: F.when(F.size("observations") > 0, value)
    struct = lambda *names: lambda o: F.struct(*[o[n].alias(n) for n in names])
    return [
        last("AutoItSignatureFound", lambda o: o["offset"]).alias("signature_offset"),
        last("VersionMarkerFound", struct("encoding", "offset")).alias("version_marker"),
        some(F.transform(of("PayloadStreamStartFound"), lambda o: o["offset"])).alias("payload_stream_offsets"),
        last("PeScriptResourceFound", struct("type_id", "type_name", "name", "language_id", "rva", "offset", "size")).alias("pe_script_resource"),
        some(F.transform(of("PackedMarkerFound"), struct("name", "offset"))).alias("packed_markers"),
    ]


def binaries(parsed: DataFrame) -> DataFrame:
    """One row a file, those not recognised included."""
    return parsed.select("binary_id", "length", "failure", "input_kind", "encoding", *folded())


def script_kind(subtype: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kind in SCRIPT_KINDS.items():
        out = F.when(subtype == name, kind).otherwise(out)
    return out


def known_subtype(subtype: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kind in scan.KNOWN_SUBTYPES.items():
        out = F.when(subtype == name, kind).otherwise(out)
    return out


def utf8_lossy(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


@F.arrow_udf(StringType())
def utf16_lossy(data: pa.Array) -> pa.Array:
    """UTF-16LE with U+FFFD for what is no character; null for an odd number of bytes."""
    return pa.array([None if v is None or len(v) % 2 else v.decode("utf-16-le", "replace") for v in data.to_pylist()], pa.string())


def scripts(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The records that are scripts, decoded; a tokenised script's text comes from render(). carry: more columns to keep."""
    found = rows.where(F.col("subtype").isin(SCRIPT_SUBTYPES)).select("binary_id", *carry, "record_index", "name", script_kind(F.col("subtype")).alias("kind"), F.col("payload_data").alias("bytes"), "creation_time", "last_write_time")
    odd = (F.col("kind") == "UnicodeText") & (F.octet_length("bytes") % 2 == 1)
    wide = F.when(F.col("kind") == "UnicodeText", F.col("bytes"))
    return found.select(
        "*",
        F.when(F.col("kind") == "PlainText", utf8_lossy(F.col("bytes"))).when(F.col("kind") == "UnicodeText", utf16_lossy(wide)).alias("text"),
        F.when(F.col("kind") == "PlainText", "Utf8Lossy").when((F.col("kind") == "UnicodeText") & ~odd, "Utf16LeLossy").alias("text_encoding"),
        F.when(odd, F.struct(F.lit("OddUtf16ByteLength").alias("kind"), F.lit(None).cast("string").alias("reason"))).alias("decode_error"),
    )


def artifacts(rows: DataFrame) -> DataFrame:
    """The records that are no scripts. Being a script follows from the subtype alone, so no join is needed."""
    found = rows.where(~F.col("subtype").isin(SCRIPT_SUBTYPES))
    return found.select("binary_id", "record_index", "subtype", "name", F.col("payload_data").alias("bytes"), "creation_time", "last_write_time", "checksum_valid", "decompression")


def artifacts_by_join(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The same by an anti-join with the scripts; tests hold the two against each other."""
    rest = rows.join(found.select("binary_id", "record_index"), ["binary_id", "record_index"], "left_anti")
    return rest.select("binary_id", "record_index", "subtype", "name", F.col("payload_data").alias("bytes"), "creation_time", "last_write_time", "checksum_valid", "decompression")


def file_time(value: Column) -> Column:
    """100 ns ticks since 1601 as a timestamp; null beyond the range of BIGINT."""
    micros = F.floor((value - F.lit(116444736000000000)) / 10).cast("bigint")
    return F.when(value.try_cast("bigint").isNotNull(), F.timestamp_micros(micros))


def decode_tokens(found: DataFrame, keep: tuple[str, ...] = ("binary_id", "record_index")) -> DataFrame:
    """keep, line_count, tokens, error of tokenised scripts (bytes); nulls where bytes is null."""

    made = to_arrow_schema(StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _struct(found, TOKENS).fields)))
    rows = made.field("tokens").type
    fields = [*rows.value_type]

    def many(values: list[bytes | None]) -> pa.RecordBatch:
        # Tokens of all scripts one behind the other, a list a field: no token is an object of its own for long.
        lines, errors, ends, columns = [], [], [0], [[] for _ in fields]
        for data in values:
            count, tokens, error = (None, None, None) if data is None else tok.parse(data)
            lines.append(count)
            errors.append(error)
            ends.append(ends[-1] + len(tokens or ()))
            for column, part in zip(columns, zip(*tokens or (), strict=True), strict=False):
                column += part
        columns[3] = [None if u is None else Decimal(u) for u in columns[3]]
        flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, rows, mask=pa.array([n is None for n in lines], pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), tokens, pa.array(errors, pa.string())], schema=made)

    # A token takes some ten times its bytes as objects.
    return map_column(found, "bytes", TOKENS, many, [*keep], _PIECE_BYTES // 8)


def _runs(rows: DataFrame, keys: list[str], data: Column, passes: list[tuple[int, bool]], least: int, most: int | None) -> DataFrame:
    """keys, pass, offset, value: the printable runs of each pass (its number, whether wide), `most` for each row and pass.

    The pattern keeps only runs that are long enough, so nothing is made of what lies between, and
    a row's search ends with its last wanted run.
    """
    kept = StructType([rows.schema[c] for c in keys])
    fields = "pass int, offset long, value string"
    patterns = {wide: re.compile((b"(?:[\\x20-\\x7e\\t]\\x00)" if wide else b"[\\x20-\\x7e\\t]") + b"{%d,}" % max(1, least)) for _, wide in passes}
    arrow = to_arrow_schema(StructType([*kept.fields, *StructType.fromDDL(fields).fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others, contents = batch.select(keys), batch.column("__data")
            row, number, offset, value, held = [], [], [], [], 0

            def out() -> pa.RecordBatch:
                again = others.take(pa.array(row, pa.int32()))
                return pa.RecordBatch.from_arrays([*again.columns, pa.array(number, pa.int32()), pa.array(offset, pa.int64()), pa.array(value, pa.binary()).cast(pa.string())], schema=arrow)

            for i in range(batch.num_rows):
                content = contents[i].as_py() or b""
                for which, wide in passes:
                    found = 0
                    for m in itertools.islice(patterns[wide].finditer(content), None if wide else most):
                        # A wide run's pass follows its alignment, and each has its own limit.
                        row.append(i)
                        number.append(which + (m.start() & 1 if wide else 0))
                        offset.append(m.start())
                        value.append(m[0][::2] if wide else m[0])
                        found += 1
                        held += len(value[-1]) + 32
                        if held > 8 << 20:
                            yield out()
                            row, number, offset, value, held = [], [], [], [], 0
                        if wide and most is not None and found >= 2 * most:
                            break
                    if not wide and most is not None and found >= most:
                        # Later passes come after these, and there is no room for them.
                        break
            if row:
                yield out()

    return rows.select(*keys, data.alias("__data")).mapInArrow(run, StructType([*kept.fields, *StructType.fromDDL(fields).fields]))


def text_runs(rows: DataFrame, keys: list[str], data: Column, wide: bool = False, least: int = 4) -> DataFrame:
    """keys, offset, value of every run of printable characters in data, of one or (wide) two bytes each."""
    return _runs(rows, keys, data, [(0, wide)], least, None).drop("pass")


def strings(rows: DataFrame, least: int = 4, most: int = 4096) -> DataFrame:
    """binary_id, seq, record_index, offset, encoding, value: text in payloads, at most `most` a file in order of discovery."""
    found = _runs(rows, ["binary_id", "record_index"], F.col("payload_data"), [(0, False), (1, True)], least, most)
    order = W.partitionBy("binary_id").orderBy("record_index", "pass", "offset")
    found = found.withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= most)
    return found.select("binary_id", (F.col("seq") - 1).alias("seq"), "record_index", "offset", F.when(F.col("pass") == 0, "Ascii").otherwise("Utf16Le").alias("encoding"), "value")
