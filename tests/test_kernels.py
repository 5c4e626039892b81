"""Known vectors, round trips and random damage."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from unspool.kernels import ciphers, container, payloads, records, tokens, unpack


def bits(*parts):
    out = unpack.BitWriter()
    for value, n in parts:
        out.put(value, n)
    return out.bytes()


def blob(magic, size, *parts):
    return magic + struct.pack(">I", size) + bits(*parts)


def test_known_streams():
    assert ciphers.crypt(ciphers.MT, bytes.fromhex("ff6db0ce"), 0x16FA) == b"FILE"
    assert ciphers.keystream(ciphers.MT, 0x16FA, 16).hex() == "b924fc8bfde8ba7f87b0d1525830669c"
    assert ciphers.crypt(ciphers.LAME, bytes.fromhex("6b43ca52"), 0x18EE) == b"FILE"
    assert ciphers.keystream(ciphers.LAME, 0x18EE, 16).hex() == "2d0a8617b6b371a0071084f7e5bae729"


def test_stream_grows_in_steps():
    ciphers._made.clear()
    ciphers._state.clear()
    whole = ciphers.keystream(ciphers.LAME, 77, 3000)
    ciphers._made.clear()
    ciphers._state.clear()
    for n in (1, 5, 64, 65, 700, 3000):
        assert ciphers.keystream(ciphers.LAME, 77, n) == whole[:n]


def test_literals_and_overlap():
    literal = lambda bit, c: [(bit, 1), (ord(c), 8)]
    assert unpack.inflate(blob(b"EA06", 3, *literal(1, "A"), *literal(1, "B"), *literal(1, "C"))) == (b"ABC", None)
    assert unpack.inflate(blob(b"EA05", 2, *literal(0, "H"), *literal(0, "I"))) == (b"HI", None)
    assert unpack.inflate(blob(b"EA06", 5, *literal(1, "A"), *literal(1, "B"), (0, 1), (2, 15), (0, 2))) == (b"ABABA", None)


def test_broken_blobs():
    assert unpack.inflate(blob(b"EA06", 5, (1, 1), (65, 8), (0, 1), (0, 15), (0, 2))) == (None, "CompressionError")
    assert unpack.inflate(blob(b"EA06", 3, (1, 1), (0, 1))) == (None, "Truncated")
    assert unpack.inflate(blob(b"EA06", 3), limit=1) == (None, "LimitExceeded")
    assert unpack.inflate(blob(b"XX06", 3)) == (None, "CompressionError")
    assert unpack.inflate(b"EA06") == (None, "Truncated")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 40))
def test_blob_round_trip(data, times):
    data = data + data[:30] * times
    for magic in (b"EA04", b"EA05", b"EA06"):
        assert unpack.inflate(unpack.deflate_lz(data, magic)) == (data, None)
    for magic in (b"JB00", b"JB01"):
        assert unpack.inflate(unpack.deflate_adaptive(data, magic)) == (data, None)


def test_long_adaptive_round_trip():
    data = b"".join(b"word%d line %d\r\n" % (k * k % 977, k) for k in range(4000))
    assert unpack.inflate(unpack.deflate_adaptive(data)) == (data, None)


def test_record_fields():
    whole = records.encode("Ea06", payloads.PLAIN, "näme", b"payload", created=0x0102030405060708, written=0x1112131415161718)
    found, stop = records.parse(whole, 0, "Ea06")
    assert stop is None and len(found) == 1
    r = found[0]
    assert (r["name"], r["decrypted_data"], r["checksum_valid"], r["creation_time"], r["last_write_time"]) == ("näme", b"payload", True, 0x0102030405060708, 0x1112131415161718)
    assert r["profile"] == {"encoding": "Ea06", "encryption": "Ea06Lame", "compression": "None"}


@pytest.mark.parametrize("encoding", ["Ea04", "Ea05", "Ea06", "Jb01"])
@pytest.mark.parametrize("packed", [False, True])
def test_every_encoding(encoding, packed):
    found = container.analyse(payloads.script_payload(encoding, "héllo " * 50, packed))
    assert found["failure"] is None and found["encoding"] == encoding and len(found["records"]) == 2
    r = found["records"][0]
    assert (r["decompressed_data"] if packed else r["decrypted_data"]).decode() == "héllo " * 50
    assert r["checksum_valid"] and r["decompression"]["kind"] == ("Decompressed" if packed else "NotCompressed")


def test_failed_decompression_keeps_the_record():
    whole = records.encode("Ea06", payloads.PLAIN, "s", b"EA06\0\0\0\x09x", packed=True)
    r = records.parse(whole, 0, "Ea06")[0][0]
    assert r["decompression"]["kind"] == "Failed" and r["decompressed_data"] is None and r["decrypted_data"]


def test_where_parsing_stops():
    one = records.encode("Ea06", payloads.PLAIN, "s", b"x")
    found, stop = records.parse(one + records.MARKER[ciphers.LAME], 0, "Ea06")
    assert len(found) == 1 and stop == {"record_index": 1, "offset": len(one), "reason": "Truncated"}
    assert records.parse(one + b"abcd", 0, "Ea06")[1] is None
    assert records.parse(one + b"abc", 0, "Ea06")[1]["reason"] == "Truncated"
    found, stop = records.parse(one * 3, 0, "Ea06", records.Limits(max_records=3))
    assert len(found) == 3 and stop == {"record_index": 3, "offset": 3 * len(one), "reason": "LimitExceeded"}


def test_prefix_only():
    found = container.analyse(container.GUID + container.TAG + b"EA06")
    assert (found["input_kind"], found["encoding"], len(found["observations"]), found["records"]) == ("A3x", "Ea06", 3, [])
    wrapped = container.analyse(b"MZ" + bytes(8) + container.GUID + container.TAG + b"EA05")
    assert (wrapped["input_kind"], wrapped["encoding"], len(wrapped["observations"])) == ("Pe", "Ea05", 4)
    assert container.analyse(b"not autoit")["failure"] == "NotRecognized"


def test_first_signature_decides():
    later = container.GUID + container.TAG + b"EA06"
    assert container.signature(container.GUID + container.TAG + b"EA99" + later) is None
    assert container.signature(b"xx" + container.OTHER_GUID + container.TAG + b"EA05" + later)["encoding"] == "Ea05"


def test_resource():
    page = payloads.pe_with_resource(bytes(0x40))
    found = container.script_resource(page)
    assert (found["language_id"], found["rva"], found["offset"], found["size"], found["stream"]) == (1033, 0x1100, 0x300, 0x40, 0x318)
    whole = container.analyse(page)
    assert (whole["input_kind"], whole["encoding"], len(whole["observations"])) == ("Pe", None, 3)


def test_packed_only():
    found = container.analyse(b"MZ..UPX..AutoIt..JB01..EA05")
    assert (found["encoding"], found["records"]) == ("Ea05", [])
    assert container.analyse(b"MZ..UPX..EA05")["failure"] == "NotRecognized"


def test_token_vectors():
    s = tokens.string_token
    one = tokens.stream([s(0x33, "x") + tokens.operator_token("=") + tokens.number_token(0x05, 1)])
    assert tokens.parse(one) == (1, [("Variable", "x", None, None, None), ("Operator", "=", None, None, None), ("U32", None, None, 1, None), ("LineEnd", None, None, None, None)], None)
    assert tokens.parse(bytes([1, 0, 0, 0, 0xFF, 0x7F]))[1][0] == ("UnknownOpcode", None, 0xFF, None, None)
    assert tokens.parse(struct.pack("<IBI", 1, 0x33, 0xFFFFFFFF))[2] == "Truncated"
    assert tokens.parse(struct.pack("<IBIH", 1, 0x33, 0x10000, 7))[2] == "BadString"
    assert tokens.parse(struct.pack("<I", 0) + b"junk") == (0, [], None)
    assert [tokens.float_text(x) for x in (1.0, 1e21, -0.0, float("nan"), float("inf"), 0.1)] == ["1", "1000000000000000000000", "-0", "NaN", "inf", "0.1"]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["Ea04", "Ea05", "Ea06", "Jb01"]), st.booleans(), st.integers(0, 600), st.integers(0, 255), st.integers(0, 600))
def test_damage_never_raises(encoding, packed, at, value, cut):
    whole = bytearray(payloads.pe_with_resource(payloads.script_payload(encoding, "some text " * 9, packed)) if value % 2 else payloads.script_payload(encoding, "some text " * 9, packed))
    whole[at % len(whole)] = value
    found = container.analyse(bytes(whole[: max(0, len(whole) - cut)]))
    assert found["failure"] in (None, "NotRecognized")
    tokens.parse(bytes(whole))


def test_fixed_tables():
    assert (len(tokens.KEYWORDS), len(tokens.MACROS), len(tokens.OPERATORS)) == (45, 102, 25)
    assert len({k.lower() for k in tokens.KEYWORDS}) == 45 and len({m.lower() for m in tokens.MACROS}) == 102


def test_trees_equal_those_of_a_heap():
    """Two ascending queues take nodes in the order of (count, place), as a heap does."""
    import heapq
    import random

    rng = random.Random(3)
    for symbols in (2, 5, 32, 288):
        code = unpack.AdaptiveCode(symbols)
        for _ in range(20):
            code.counts = [rng.choice((1, 1, 2, 3, 7, 40)) for _ in range(symbols)]
            code._build()
            heap, kids = [(c, i) for i, c in enumerate(code.counts)], [0] * (4 * symbols - 2)
            heapq.heapify(heap)
            for node in range(symbols, 2 * symbols - 1):
                (c1, a), (c2, b) = heapq.heappop(heap), heapq.heappop(heap)
                kids[2 * node], kids[2 * node + 1] = a, b
                heapq.heappush(heap, (c1 + c2, node))
            assert code.kids == kids


def test_adaptive_stream_of_44_kilobytes_and_its_cuts():
    import random

    rng = random.Random(8)
    text = b"".join(rng.choice((b"Local $value = ", b"ConsoleWrite(", b"EndFunc\r\n", bytes([rng.randrange(256)]))) for _ in range(6000))[:44_000]
    blob = unpack.deflate_adaptive(text)
    assert unpack.inflate(blob) == (text, None)
    assert unpack.inflate(unpack.deflate_adaptive(text, b"JB00"))[0] == text
    for cut in (8, 9, 15, 16, 17, 1000, len(blob) - 2):
        assert unpack.inflate(blob[:cut]) == (None, "Truncated")


def test_long_matches_windows_and_their_cuts():
    """Lengths that take every stage, matches over the bounds of windows, and cuts within a token."""
    import random

    rng = random.Random(2)
    data = b"a" * 5000 + rng.randbytes(20_000) + b"ab" * 900 + bytes(range(256)) * 40 + b"x" * 44 + b"y" * 299 + b"z" * 554
    for magic in (b"EA05", b"EA06"):
        blob = unpack.deflate_lz(data, magic)
        assert unpack.inflate(blob) == (data, None) == unpack.inflate(unpack.deflate_lz(data, magic, matches=False))
        assert {unpack.inflate(blob[:cut])[1] for cut in range(8, len(blob) - 1, 97)} == {"Truncated"}


def test_trees_of_many_are_built_together(monkeypatch):
    """As many rebuilds for forty blobs as for one, with the same bytes, also where trees get too deep."""
    import random

    rng, calls = random.Random(6), []
    whole = unpack.rebuild
    monkeypatch.setattr(unpack, "rebuild", lambda codes, writing: (calls.append(len(codes)), whole(codes, writing)))
    datas = [bytes(rng.choices(range(256), [2.0 ** -min(k, 40) for k in range(256)], k=9000 + k)) for k in range(20)] + [b"word %d " % k * 400 for k in range(20)]
    alone = [unpack.deflate_adaptive(d) for d in datas]
    most = max(len(d) for d in datas)
    calls.clear()
    assert unpack.deflate_adaptive_many(datas) == alone
    assert unpack.inflate_many([*alone, alone[0][:500], b"JB0"]) == [*((d, None) for d in datas), (None, "Truncated"), (None, "Truncated")]
    assert max(calls) >= 20 and len(calls) < most


def test_many_blobs_are_read_abreast(monkeypatch):
    """A symbol of each at a time gives what each gives alone, whole or damaged; only the last few are read one by one."""
    import random

    rng, calls = random.Random(11), []
    words = [rng.randbytes(rng.randrange(1, 9)) for _ in range(300)]
    datas = [b"".join(rng.choices(words, k=rng.randrange(400))) for _ in range(150)]
    datas += [b"", b"a", b"ab" * 40_000, b"\0" * 700, bytes(rng.choices(range(256), [2.0 ** -min(k, 40) for k in range(256)], k=30_000)), *(rng.randbytes(9000 + k) for k in range(70))]
    blobs = unpack.deflate_adaptive_many(datas)
    assert blobs == [unpack.deflate_adaptive(d) for d in datas]
    for k in range(120):
        bad = bytearray(blobs[k])
        bad[rng.randrange(7, len(bad))] ^= 1 << rng.randrange(8)
        blobs.append(bytes(bad[: rng.randrange(8, len(bad) + 1)] if k % 2 else bad))
    alone = [unpack.inflate(b) for b in blobs]
    one = unpack._adaptive
    monkeypatch.setattr(unpack, "_adaptive", lambda *a: (calls.append(a), one(*a))[1])
    assert unpack.inflate_many(blobs) == alone
    assert alone[: len(datas)] == [(d, None) for d in datas] and {r for _, r in alone} == {None, "Truncated", "CompressionError"}
    assert len(calls) < unpack._ABREAST
