"""Sources and sinks: files to rows, token name tables, and the text report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unspool.operators.extract import folded
from unspool.schema import FAILURES

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_binaries(spark: SparkSession, path: str, pattern: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """One row for each file: binary_id (its path), length, content. most_bytes is pushed to the scan."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    return files.select(F.col("path").alias("binary_id"), "length", "content")


def read_names(spark: SparkSession, path: str, with_id: bool = True) -> DataFrame:
    """A table of token names: `id<TAB>name` or `name` lines; `#` starts a comment; an empty name stays empty."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    if not with_id:
        return lines.select(F.col("value").alias("name"))
    at = F.instr("value", "\t")
    return lines.where(at > 0).select(F.substring("value", F.lit(1), at - 1).cast("int").alias("id"), F.substring("value", at + 1, F.length("value")).alias("name"))


def failure_message(failure: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, message in FAILURES.items():
        out = F.when(failure == name, message).otherwise(out)
    return out


def escape_inline(text: Column) -> Column:
    """Text on one line: \\n, \\r and \\t by name, other control characters by number."""
    out = F.replace(F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    chars = F.transform(F.split(out, ""), lambda c: F.when(c.rlike("^\\p{Cc}$"), F.concat(F.lit("\\u{"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"), F.lit("}"))).otherwise(c))
    return F.when(out.rlike("\\p{Cc}"), F.array_join(chars, "")).otherwise(out)


def report(parsed: DataFrame, scripts: DataFrame, artifacts: DataFrame, strings: DataFrame) -> DataFrame:
    """(binary_id, section, seq, line): the text report, in the order of the section's number and seq."""
    num = lambda c: F.col(c).cast("string")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    none = lambda c: F.coalesce(c, F.lit("none"))
    counts = lambda name, df: df.groupBy("binary_id").agg(F.count("*").alias(name))
    ok = parsed.where("failure is null")
    head = lambda df, number, title: df.groupBy("binary_id").agg(F.count("*").alias("n")).select("binary_id", F.lit(number).alias("section"), F.lit(-1).alias("seq"), text(f"== {title} (", num("n"), ") ==").alias("line"))
    overview = ok.select("binary_id", "input_kind", "encoding", F.size("records").alias("records"), F.when(F.col("diagnostic").isNotNull(), 1).otherwise(0).alias("diagnostics"))
    for name, df in (("scripts", scripts), ("artifacts", artifacts), ("strings", strings)):
        overview = overview.join(counts(name, df), "binary_id", "left")
    fields = [text("  input kind: ", F.col("input_kind")), text("  encoding: ", none(F.col("encoding"))), *[text(f"  {n}: ", F.coalesce(num(n), F.lit("0"))) for n in ("records", "scripts", "artifacts", "strings")], text("  record diagnostics: ", num("diagnostics"))]
    sections = [overview.select("binary_id", F.lit(1).alias("section"), F.posexplode(F.array(F.lit("== overview =="), *fields)).alias("seq", "line"))]
    facts = ok.select("binary_id", *folded())
    version, resource = F.col("version_marker"), F.col("pe_script_resource")
    fields = F.array(
        F.lit("== container =="),
        text("  signature offset: ", none(num("signature_offset"))),
        text("  version marker: ", none(text(version["encoding"], " @ offset ", version["offset"].cast("string")))),
        text("  payload stream offsets: ", F.when(F.size("payload_stream_offsets") > 0, text("[", F.array_join(F.col("payload_stream_offsets").cast("array<string>"), ", "), "]")).otherwise("none")),
        text("  pe script resource: ", none(text(resource["name"], " type ", resource["type_id"].cast("string"), " language ", none(resource["language_id"].cast("string")), " rva 0x", F.lower(F.hex(resource["rva"])), " offset ", resource["offset"].cast("string"), " size ", resource["size"].cast("string")))),
        text("  packed markers: ", F.when(F.size("packed_markers") > 0, F.array_join(F.transform("packed_markers", lambda m: text(m["name"], " @ offset ", m["offset"].cast("string"))), ", ")).otherwise("none")),
    )
    sections.append(facts.select("binary_id", F.lit(2).alias("section"), F.posexplode(fields).alias("seq", "line")))
    seen = ok.select("binary_id", F.posexplode("observations").alias("seq", "o"))
    sections.append(head(seen, 3, "observations"))
    sections.append(seen.select("binary_id", F.lit(3).alias("section"), "seq", text("  ", F.col("o.kind"), F.coalesce(text(" ", F.col("o.encoding")), F.lit("")), F.coalesce(text(" @ offset ", F.col("o.offset").cast("string")), F.lit(""))).alias("line")))
    rows = ok.select("binary_id", F.explode("records").alias("r")).select("binary_id", "r.*")
    sections.append(head(rows, 4, "records"))
    size = lambda c: none(F.octet_length(c).cast("string"))
    lines = F.array(
        text("  #", num("record_index"), " @ offset ", num("offset")),
        text("    subtype: ", escape_inline(F.col("subtype"))),
        text("    name: ", escape_inline(F.col("name"))),
        text("    profile: encoding=", F.col("profile.encoding"), " encryption=", F.col("profile.encryption"), " compression=", F.col("profile.compression")),
        text("    compressed: ", num("compressed"), " (compressed_size=", num("compressed_size"), ", uncompressed_size=", num("uncompressed_size"), ")"),
        text("    checksum: 0x", F.lpad(F.lower(F.hex("checksum")), 8, "0"), F.when(F.col("checksum_valid"), " (valid)").otherwise(" (invalid)")),
        text("    timestamps: created=", num("creation_time"), " last_write=", num("last_write_time")),
        text("    data sizes: encrypted=", size("encrypted_data"), " decrypted=", size("decrypted_data"), " decompressed=", size("decompressed_data")),
        text("    decompression: ", F.col("decompression.kind"), F.coalesce(text(" ", F.col("decompression.reason")), F.lit(""))),
    )
    sections.append(rows.select("binary_id", F.lit(4).alias("section"), "record_index", F.posexplode(lines).alias("k", "line")).select("binary_id", "section", (F.col("record_index") * 16 + F.col("k")).cast("int").alias("seq"), "line"))
    stops = ok.where("diagnostic is not null").select("binary_id", F.lit(5).alias("section"), F.lit(0).alias("seq"), text("  record #", F.col("diagnostic.record_index").cast("string"), " @ offset ", F.col("diagnostic.offset").cast("string"), ": ", F.col("diagnostic.reason")).alias("line"))
    sections += [head(stops, 5, "record diagnostics"), stops]
    sections += [head(scripts, 6, "scripts"), head(artifacts, 7, "artifacts"), head(strings, 8, "strings")]
    source = F.transform(F.split(F.coalesce("text", F.lit("<unavailable>")), "\\r?\\n"), lambda x: text("    | ", x))
    sections.append(scripts.select("binary_id", F.lit(6).alias("section"), "record_index", F.posexplode(source).alias("k", "line")).select("binary_id", "section", (F.col("record_index") * 100_000_000 + F.col("k") + 1).cast("long").alias("seq"), "line"))
    sections.append(scripts.select("binary_id", F.lit(6).alias("section"), (F.col("record_index") * 100_000_000).cast("long").alias("seq"), text("  record #", num("record_index"), " ", escape_inline(F.col("name")), " ", F.col("kind"), " ", F.octet_length("bytes").cast("string"), " bytes").alias("line")))
    sections.append(artifacts.select("binary_id", F.lit(7).alias("section"), F.col("record_index").cast("int").alias("seq"), text("  record #", num("record_index"), " ", escape_inline(F.col("name")), " ", F.octet_length("bytes").cast("string"), " bytes").alias("line")))
    sections.append(strings.select("binary_id", F.lit(8).alias("section"), F.col("seq").cast("int").alias("seq"), text("  record #", num("record_index"), " offset ", num("offset"), " ", F.col("encoding"), ": ", escape_inline(F.col("value"))).alias("line")))
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out
