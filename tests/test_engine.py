"""The tables over Spark, and every query against its SQL."""

import struct

import pytest
from pyspark.sql import functions as F

from tests.conftest import agree
from unspool.functions import native, udfs
from unspool.kernels import ciphers, container, payloads, records
from unspool.kernels import tokens as tok
from unspool.operators import extract, render
from unspool.plans import queries
from unspool.sources import binaries
from unspool.streaming import extract as streaming


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, duck, data_dir, name):
    agree(queries.QUERIES[name](spark, data_dir), duck, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_runs(spark, data_dir, name):
    assert queries.QUERIES[name](spark, data_dir).count() > 0


def files(spark, *contents):
    return spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, c in enumerate(contents)], "binary_id long, content binary")


def test_strings_of_both_widths(spark):
    data = b"\0abcd\x01\x01" + "WXYZ".encode("utf-16-le") + b"\0"
    whole = payloads.container("Ea06", records.encode("Ea06", "payload", "p", data))
    found = extract.strings(extract.records(extract.parse(files(spark, whole)))).orderBy("seq").collect()
    assert [(r.offset, r.encoding, r.value) for r in found] == [(1, "Ascii", "abcd"), (7, "Utf16Le", "WXYZ")]


def test_wide_runs_equal_a_plain_scan(spark):
    import random

    rng = random.Random(5)
    datas = [bytes(rng.choice(b"aZ\t\x00\x00\x00\x01\xff") for _ in range(rng.randrange(60))) for _ in range(200)]

    def scan(data):
        found = set()
        for start in (0, 1):
            run = []
            for at in range(start, len(data) + 2, 2):
                unit = data[at : at + 2]
                if len(unit) == 2 and unit[1] == 0 and (0x20 <= unit[0] <= 0x7E or unit[0] == 9):
                    run.append(chr(unit[0]))
                else:
                    if len(run) >= 4:
                        found.add((at - 2 * len(run), "".join(run)))
                    run = []
        return found

    rows = extract.text_runs(files(spark, *datas), ["binary_id"], F.col("content"), wide=True).collect()
    for k, data in enumerate(datas):
        assert {(r.offset, r.value) for r in rows if r.binary_id == k} == scan(data)


def test_failures_are_rows(spark):
    parsed = extract.parse(files(spark, b"", None, b"not autoit", payloads.script_payload("Ea06", "x", False)))
    assert [r.failure for r in extract.binaries(parsed).orderBy("binary_id").collect()] == ["NotRecognized"] * 3 + [None]
    assert extract.parse(files(spark)).count() == 0


def test_scripts_of_each_kind(spark):
    rows = [records.encode("Ea06", s, "n", d) for s, d in ((payloads.PLAIN, b"a\xff"), (payloads.UNICODE, "ü".encode("utf-16-le")), (payloads.UNICODE, b"abc"), (payloads.TOKENIZED, tok.stream([tok.string_token(0x33, "x")])), (payloads.TOKENIZED, b"\1\0\0\0"), (payloads.AHK, b"ahk"), ("other", b"o"))]
    rows = extract.records(extract.parse(files(spark, payloads.container("Ea06", b"".join(rows)))))
    found = render.with_sources(extract.scripts(rows)).orderBy("record_index").collect()
    assert [(r.kind, r.text, r.text_encoding) for r in found] == [("PlainText", "a�", "Utf8Lossy"), ("UnicodeText", "ü", "Utf16LeLossy"), ("UnicodeText", None, None), ("Tokenized", "$x\r\n", "TokenRender"), ("Tokenized", None, None), ("PlainText", "ahk", "Utf8Lossy")]
    assert found[2].decode_error.kind == "OddUtf16ByteLength" and found[4].decode_error == ("Token", "Truncated")
    left = extract.artifacts(rows).collect()
    assert [r.subtype for r in left] == ["other"] == [r.subtype for r in extract.artifacts_by_join(rows, extract.scripts(rows)).collect()]


def rendered(spark, lines, functions=None):
    found = spark.createDataFrame([(1, 0, bytearray(tok.stream(lines)))], "binary_id long, record_index long, bytes binary")
    out = render.render(render.tokens(extract.decode_tokens(found), functions)).collect()
    return out[0].source if out else ""


def test_functions_of_the_whole_table(spark):
    """Without a table of the caller's, ids and spellings of all known functions are looked up."""
    s, n = tok.string_token, tok.number_token
    names = tok.FUNCTIONS
    assert len(names) == 405 == len({x.lower() for x in names}) and [names[k] for k in (0, 2, 3, 248, 404)] == ["Abs", "AdlibRegister", "AdlibUnRegister", "MsgBox", "WinWaitNotActive"]
    assert rendered(spark, [n(0x01, k) for k in range(406)]).split("\r\n")[:-1] == [*names, "<function:405>"]
    assert rendered(spark, [s(0x31, x.upper()) for x in (*names, "other")]).split("\r\n")[:-1] == [*names, "OTHER"]


def test_rendering(spark):
    s, n, op = tok.string_token, tok.number_token, tok.operator_token
    key = lambda name: n(0x00, tok.KEYWORDS.index(name))
    names = spark.createDataFrame([(248, "MsgBox")], "id int, name string")
    call = n(0x01, 248) + op("(") + n(0x05, 0) + op(",") + s(0x36, "title") + op(",") + s(0x36, "text") + op(")")
    assert rendered(spark, [call], names) == 'MsgBox(0, "title", "text")\r\n'
    odd = key("If") + s(0x32, "scriptname") + s(0x36, 'a"b') + n(0x00, 999) + n(0x01, 999)
    assert rendered(spark, [odd], names) == 'If @ScriptName "a""b" <keyword:999> <function:999>\r\n'
    x = s(0x33, "x")
    block = [key("If") + x + key("Then"), x + op("=") + n(0x05, 1), b"", key("EndIf")]
    assert rendered(spark, block) == "If $x Then\r\n\t$x = 1\r\n\t\r\nEndIf\r\n"
    assert rendered(spark, [key("If") + x + key("Then") + x + op("=") + n(0x05, 1), s(0x33, "y") + op("=") + n(0x05, 2)]) == "If $x Then $x = 1\r\n$y = 2\r\n"
    assert rendered(spark, [key("EndIf"), x]) == "EndIf\r\n$x\r\n"
    assert rendered(spark, [key("And") + op("("), s(0x35, "p") + n(0x20, 1e21) + n(0x10, 2**64 - 1)]) == "And(\r\n.p 1000000000000000000000 18446744073709551615\r\n"


def test_sources_equal_those_of_rows(spark):
    """Rendering script by script equals rendering by joins and windows, for streams of all kinds of tokens."""
    import random

    rng = random.Random(4)
    texts = ["", "If", "Then", "WEnd", "while", "msgbox", "CR", "scriptname", 'a"b', "(", "[", ",", "x", "Else", "İf", "Ⅷ"]

    def token():
        opcode = rng.choice([0x00, 0x01, 0x05, 0x10, 0x20, *range(0x30, 0x38), *range(0x40, 0x59), 0x90])
        if opcode in tok.NUMBERS:
            return tok.number_token(opcode, rng.choice((0, 3, 4, 9, 10, 248, 404, 405, 999)) if opcode != 0x20 else rng.choice((0.5, 1e21, -0.0)))
        return tok.string_token(opcode, rng.choice(texts)) if opcode in tok.STRINGS else bytes([opcode])

    streams = [tok.stream([b"".join(token() for _ in range(rng.randrange(7))) for _ in range(rng.randrange(12))]) for _ in range(150)]
    rows = [records.encode("Ea06", payloads.TOKENIZED, "n", s) for s in streams]
    found = extract.scripts(extract.records(extract.parse(files(spark, *(payloads.container("Ea06", r) for r in rows)))))
    names = spark.createDataFrame([(3, "Three"), (248, "MsgBox"), (9, None)], "id int, name string")
    for functions in (None, names):
        want = {r.binary_id: r.source for r in render.render(render.tokens(extract.decode_tokens(found), functions)).collect()}
        got = {r.binary_id: r.text for r in render.with_sources(found, functions).collect()}
        assert len(got) == 150 and got == {k: want.get(k, "") for k in range(150)}


def test_ordered_fold(spark):
    seen = [(1, 0, "AutoItSignatureFound", 5), (1, 1, "PayloadStreamStartFound", 9), (1, 2, "AutoItSignatureFound", 7), (1, 3, "PayloadStreamStartFound", 8)]
    row = spark.createDataFrame(seen, "binary_id long, seq int, kind string, offset long")
    for c, t in (("encoding", "string"), ("subtype", "string"), ("name", "string"), ("type_id", "int"), ("type_name", "string"), ("language_id", "int"), ("rva", "long"), ("size", "long")):
        row = row.withColumn(c, F.lit(None).cast(t))
    found = extract.container(row).first()
    assert (found.signature_offset, found.payload_stream_offsets, found.packed_markers) == (7, [9, 8], [])
    assert extract.first_of(row).first().first_stream_offset == 9


def marked(encoding):
    """A text of which the encoding's encrypted bytes hold the three bytes of a packed marker."""
    layout = records.LAYOUTS[encoding]
    key = ciphers.keystream(layout.cipher, layout.data_key + (sum(payloads.SALT) if layout.salted else 0), 4000)
    for at in range(3990):
        part = bytes(a ^ b for a, b in zip(key[at:], b"UPX"))
        if all(0x20 <= c < 0x7F for c in part):
            return "x" * at + part.decode()


def documents(tmp_path, *rows):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}), tmp_path / "documents.parquet")
    return str(tmp_path)


def own_tables(path):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet'")
    return con


def test_chance_markers_in_encrypted_bytes(spark, tmp_path):
    """A marker in the whole file is noted, as ever; container_fold takes none from encrypted bytes."""
    texts = [marked(e) for e in ("Ea06", "Ea05", "Ea04", "Jb01")]
    path = documents(tmp_path, *enumerate(texts), *((k + 4, t) for k, t in enumerate(texts)))
    agree(queries.QUERIES["container_fold"](spark, path), own_tables(path), queries.ORACLES["container_fold"])
    whole = payloads.script_payload("Ea06", texts[0], False)
    assert [m.name for m in extract.binaries(extract.parse(files(spark, whole))).first().packed_markers] == ["UPX"]
    assert extract.binaries(extract.parse(files(spark, whole), packed_in_stream=False)).first().packed_markers == []
    before = payloads.container("Ea06", records.encode("Ea06", payloads.PLAIN, "s", b"x"), filler=b"..UPX..")
    assert extract.binaries(extract.parse(files(spark, before), packed_in_stream=False)).first().packed_markers == [("UPX", 2)]


def test_report_of_chance_markers(spark, tmp_path):
    path = documents(tmp_path, (1, marked("Ea06")), (2, "text"), (3, None))
    agree(queries.QUERIES["text_report"](spark, path), own_tables(path), queries.ORACLES["text_report"])


def test_fold_of_arrays_equals_the_fold_of_rows(spark):
    contents = [payloads.script_payload(e, "text", False) for e in ("Ea04", "Ea05", "Ea06", "Jb01")] + [payloads.pe_with_resource(payloads.script_payload("Ea06", "x", False)), b"MZ stubUPX! AutoIt EA06", b"nothing", None]
    parsed = extract.parse(files(spark, *contents))
    apart = parsed.select("binary_id").join(extract.container(extract.observations(parsed)), "binary_id", "left").orderBy("binary_id")
    assert extract.binaries(parsed).select(apart.columns).orderBy("binary_id").collect() == apart.collect()


def test_kernels_get_small_pieces(spark):
    """What a kernel holds at once doesn't depend on the number of rows."""
    frame = spark.range(4000).select("id", F.expr("case when id % 7 > 0 then cast(repeat('x', 4000) as binary) end").alias("b")).coalesce(1)

    def kernel(values):
        return [{"n": sum(len(v or b"") for v in values)}] * len(values)

    made = extract.map_column(frame, "b", "struct<n:bigint>", kernel, ["id"]).agg(F.count("*"), F.countDistinct("id"), F.max("n")).first()
    assert made[:2] == (4000, 4000) and 500_000 < made[2] <= 1 << 20


@pytest.mark.parametrize("name", ["pe_resource", "artifacts_antijoin", "token_counts"])
def test_queries_over_files_hold_small_pieces(spark, data_dir, monkeypatch, name):
    """Every kernel of the query gets at most a piece, of batches of a few pieces."""
    held, whole = [], extract.map_column

    def noted(df, column, out, kernel, keep, most=extract._PIECE_BYTES):
        held.append(most)
        return whole(df, column, out, kernel, keep, most)

    monkeypatch.setattr(extract, "map_column", noted)
    queries.QUERIES[name](spark, data_dir)
    assert len(held) > 1 and max(held) <= 1 << 20
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20


@pytest.mark.parametrize("name", ["pe_resource", "artifacts_antijoin"])
def test_workers_hold_a_piece_of_a_batch(spark, tmp_path, monkeypatch, name):
    """What the query's Python makes of a batch of 4,000 rows, both steps, takes the memory of a piece beside the batch."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.compute as pc

    path, runs = documents(tmp_path, (1, "x")), []
    frame = type(spark.range(1))
    whole = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, *a, **b: (runs.append(run), whole(self, run, *a, **b))[1])
    queries.QUERIES[name](spark, path)
    build, parse = runs

    def through(run, batch):
        """What leaves, without the peak that keeping it takes."""
        tracemalloc.start()
        made = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert made == batch.num_rows and peak < 5 << 20
        return pa.Table.from_batches(list(run(iter([batch])))).combine_chunks().to_batches()[0]

    ids = pa.array(range(4000), pa.int64())
    built = through(build, pa.record_batch([ids, pa.array([b"%d\n" % k + b"text " * 200 for k in range(4000)], pa.binary())], ["binary_id", "source"]))
    content = built.column("content")
    parsed = through(parse, pa.record_batch([ids, pc.binary_length(content).cast(pa.int64()), content], ["binary_id", "length", "content"]))
    assert parsed.column("binary_id").equals(ids) and {len(r) for r in parsed.column("records").to_pylist()} == {2}


def test_decoded_tokens_take_little_memory(spark, monkeypatch):
    """Tokens of one byte, as many as a piece holds, with broken scripts and nulls between them."""
    import tracemalloc

    grabbed, whole = [], extract.map_column
    monkeypatch.setattr(extract, "map_column", lambda df, column, out, kernel, keep, most: (grabbed.append((kernel, most)), whole(df, column, out, kernel, keep, most))[1])
    script = tok.stream([tok.operator_token("+") * 1000])
    values = [script, None, script[:-1], tok.stream([tok.number_token(0x10, 2**64 - 1) + tok.number_token(0x20, 0.5) + tok.string_token(0x34, "w")]), tok.stream([])]
    frame = spark.createDataFrame([(k, 0, v and bytearray(v)) for k, v in enumerate(values)], "binary_id long, record_index long, bytes binary")
    rows = extract.decode_tokens(frame).orderBy("binary_id").collect()
    assert [(r.line_count, r.tokens and len(r.tokens), r.error) for r in rows] == [(1, 1001, None), (None, None, None), (None, None, "Truncated"), (1, 4, None), (0, [], None)]
    assert [(t.kind, t.text, t.i, t.u, t.f) for t in rows[3].tokens] == [("U64", None, None, 2**64 - 1, None), ("F64", "0.5", None, None, 0.5), ("BareString", "w", None, None, None), ("LineEnd", None, None, None, None)]
    kernel, most = grabbed[0]
    tracemalloc.start()
    kernel([script] * (most // len(script)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 << 20


def test_known_place(spark):
    content = b"??" + records.encode("Ea05", payloads.PLAIN, "s", b"legacy")
    streams = spark.createDataFrame([(1, bytearray(content), 2, "Ea05")], "binary_id long, content binary, offset long, encoding string")
    found = extract.records(extract.parse_records(streams)).first()
    assert bytes(found.payload_data) == b"legacy" and found.offset == 2 and found.checksum_valid


def test_sql_functions(spark):
    udfs.register(spark)
    spark.createDataFrame([(bytearray(tok.stream([tok.string_token(0x33, "x")])),)], "b binary").createOrReplaceTempView("streams")
    assert [r.kind for r in spark.sql("select t.* from streams, lateral parse_tokens(b) t order by pos").collect()] == ["Variable", "LineEnd"]
    row = spark.sql("select decompress(X'4541303600000000') as d, mt_xor(X'ff6db0ce', 5882L) as m, lame_xor(X'6b43ca52', 6382L) as l, adler32_bytes(X'') as a, decompress(null) as n").first()
    assert (bytes(row.d["data"]), bytes(row.m), bytes(row.l), row.a, row.n["data"]) == (b"", b"FILE", b"FILE", 1, None)


def test_native_bytes(spark):
    row = files(spark, b"MZ\x01\x02\x03\x04AU3!..EA05").select(native.has_mz_header(F.col("content")).alias("mz"), native.little_endian(F.col("content"), 2, 4).alias("n"), native.little_endian(F.col("content"), 30, 2).alias("none"), native.loose_version(F.col("content")).alias("v"), native.find_bytes(F.col("content"), b"").alias("e"), native.raw_signature_offset(F.col("content")).alias("s")).first()
    assert (row.mz, row.n, row.none, row.v.encoding, row.v.offset, row.e, row.s) == (True, 0x04030201, None, "Ea05", 12, None, None)
    whole = files(spark, b"--" + container.GUID + container.TAG).select(native.raw_signature_offset(F.col("content"))).first()
    assert whole[0] == 2


def test_file_time(spark):
    row = spark.sql("select cast(133000000000000000 as decimal(20,0)) as t, cast(18446744073709551615 as decimal(20,0)) as far").select(extract.file_time(F.col("t")).cast("string").alias("t"), extract.file_time(F.col("far")).alias("far")).first()
    assert (row.t, row.far) == ("2022-06-18 04:26:40", None)


def test_files_names_and_report(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.a3x").write_bytes(payloads.script_payload("Ea06", "line\n\x01", False))
    (tmp_path / "names.tsv").write_text("# id\tname\n0\t\n\n248\tMsgBox\n")
    assert [(r.id, r.name) for r in binaries.read_names(spark, str(tmp_path / "names.tsv")).orderBy("id").collect()] == [(0, ""), (248, "MsgBox")]
    read = binaries.read_binaries(spark, str(tmp_path / "in"), "*.a3x", 1 << 20)
    parsed = extract.parse(read)
    rows = extract.records(parsed)
    lines = [r.line for r in binaries.report(parsed, extract.scripts(rows), extract.artifacts(rows), extract.strings(rows)).orderBy("section", "seq").collect()]
    assert lines[0] == "== overview ==" and "  input kind: A3x" in lines and any("bytes of script" in x for x in lines)
    escaped = spark.createDataFrame([("a\n\t\x01é",)], "t string").select(binaries.escape_inline(F.col("t"))).first()[0]
    assert escaped == "a\\n\\t\\u{0001}é"
    query = streaming.stream_records(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_report_line_by_line(spark):
    """Every line of the report of one file, written out."""
    import zlib

    whole = payloads.script_payload("Ea06", "line one\n\x01two", False, "s")
    parsed = extract.parse(files(spark, whole))
    rows = extract.records(parsed)
    lines = [r.line for r in binaries.report(parsed, extract.scripts(rows), extract.artifacts(rows), extract.strings(rows)).orderBy("section", "seq").collect()]
    text, other = b"line one\n\x01two", b"bytes of s"
    second = 24 + len(records.encode("Ea06", payloads.PLAIN, "s", text))
    fact = lambda k, at, subtype, name, data, made: [
        f"  #{k} @ offset {at}", f"    subtype: {subtype}", f"    name: {name}", "    profile: encoding=Ea06 encryption=Ea06Lame compression=None", f"    compressed: false (compressed_size={len(data)}, uncompressed_size={len(data)})",
        f"    checksum: 0x{zlib.adler32(data):08x} (valid)", f"    timestamps: created={made[0]} last_write={made[1]}", f"    data sizes: encrypted={len(data)} decrypted={len(data)} decompressed=none", "    decompression: NotCompressed",
    ]
    seen = [r.line for r in parsed.select(F.explode("observations").alias("o")).selectExpr("concat('  ', o.kind, coalesce(concat(' ', o.encoding), ''), coalesce(concat(' @ offset ', o.offset), '')) as line").collect()]
    want = ["== overview ==", "  input kind: A3x", "  encoding: Ea06", "  records: 2", "  scripts: 1", "  artifacts: 1", "  strings: 2", "  record diagnostics: 0"]
    want += ["== container ==", "  signature offset: 0", "  version marker: Ea06 @ offset 20", "  payload stream offsets: [24]", "  pe script resource: none", "  packed markers: none", f"== observations ({len(seen)}) ==", *seen]
    want += ["== records (2) ==", *fact(0, 24, ">AUTOIT SCRIPT<", "s", text, (1, 2)), *fact(1, second, "payload", "s.bin", other, (0, 0))]
    want += ["== scripts (1) ==", f"  record #0 s PlainText {len(text)} bytes", "    | line one", "    | \x01two"]
    want += ["== artifacts (1) ==", f"  record #1 s.bin {len(other)} bytes", "== strings (2) ==", "  record #0 offset 0 Ascii: line one", "  record #1 offset 0 Ascii: bytes of s"]
    assert lines == want


@pytest.mark.parametrize("most", [1, 2, 3, 5, 9, 4096])
def test_capped_strings_are_the_first_ones(spark, most):
    """The cap of a file holds over its records and passes, in order of discovery."""
    import random
    import re

    rng = random.Random(11)
    wide = lambda t: t.encode("utf-16-le")
    datas = [b"".join(rng.choice((b"abcd\x01", wide("WXYZ"), b"\x00", b"\x02", wide("longer text"), b"tab\there ")) for _ in range(rng.randrange(12))) for _ in range(30)]
    rows = [(k // 3, k % 3, bytearray(d)) for k, d in enumerate(datas)]
    frame = spark.createDataFrame(rows, "binary_id long, record_index long, payload_data binary").repartition(5)
    want = []
    for file in range(10):
        own = []
        for _, index, data in rows[3 * file : 3 * file + 3]:
            found = [(0, m.start(), "Ascii", m[0].decode()) for m in re.finditer(rb"[\x20-\x7e\t]{4,}", bytes(data))]
            found += [(1 + m.start() % 2, m.start(), "Utf16Le", m[0][::2].decode()) for m in re.finditer(rb"(?:[\x20-\x7e\t]\x00){4,}", bytes(data))]
            own += [(index, *f) for f in sorted(found)]
        want += [(file, seq, x[0], x[2], x[3], x[4]) for seq, x in enumerate(own[:most])]
    got = extract.strings(frame, most=most).select("binary_id", "seq", "record_index", "offset", "encoding", "value").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_large_payload_of_text(spark):
    """A payload of 64 MiB of text and of wide text is searched in one pass; the cap ends the search early."""
    frame = spark.createDataFrame([(1, 0, bytearray(b"some text of a line\n" * 3_300_000))], "binary_id long, record_index long, payload_data binary")
    assert extract.text_runs(frame, ["binary_id"], F.col("payload_data")).agg(F.count("*"), F.sum(F.length("value"))).first()[:] == (3_300_000, 3_300_000 * 19)
    assert extract.strings(frame).agg(F.count("*"), F.max("offset")).first()[:] == (4096, 4095 * 20)


def test_command_line_prints_names(tmp_path, capsys, spark):
    from unspool.__main__ import main

    stream = tok.stream([tok.number_token(0x01, 248) + tok.operator_token("(") + tok.operator_token(")")])
    (tmp_path / "a.a3x").write_bytes(payloads.container("Ea06", records.encode("Ea06", payloads.TOKENIZED, "t", stream)))
    (tmp_path / "b.bin").write_bytes(b"nothing")
    assert main([str(tmp_path)]) == 0
    said = capsys.readouterr()
    assert "    | MsgBox()" in said.out and "nothing in the input marks a compiled script" in said.err
    (tmp_path / "names.tsv").write_text("248\tOther\n")
    assert main([str(tmp_path / "a.a3x"), str(tmp_path / "names.tsv")]) == 0 and "    | Other()" in capsys.readouterr().out
    assert main([]) == 2


def test_shared_folder(spark, monkeypatch):
    """Written tables are deleted by name; a cluster without a shared folder is refused."""
    from pathlib import Path

    from unspool import storage

    one, two = storage.materialize(spark.range(3), "one"), storage.materialize(spark.range(4), "two")
    paths = storage.written(spark)[-2:]
    storage.delete(spark, paths[:1])
    assert storage.written(spark)[-1] == paths[1] and not Path(paths[0]).exists() and two.count() == 4 and one is not two
    assert storage.shared_dir(spark) in paths[1]

    class Elsewhere:
        conf = {}

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Elsewhere)


def test_damaged_rows_dont_fail(spark):
    whole = payloads.script_payload("Ea06", "text " * 20, True)
    cuts = [whole[:k] for k in range(0, len(whole), 7)] + [struct.pack("<I", 7) + whole, bytes(40) + records.MARKER[ciphers.MT] * 3]
    parsed = extract.parse(files(spark, *cuts))
    assert parsed.count() == len(cuts)
    extract.strings(extract.records(parsed)).count()
