"""The binary form: known bytes, round trips, refused input."""

import random

import pytest

from mergeloom.sources import codec as C


def test_numbers():
    for n, b in ((0, "00"), (1, "01"), (0x7F, "7f"), (0x80, "8001"), (0x3FFF, "ff7f"), (2**53 - 1, "ffffffffffffff0f")):
        assert C.uleb(n, 53).hex() == b and C.Reader(bytes.fromhex(b)).uint(53) == n
    for n, b in ((0, "00"), (-1, "7f"), (63, "3f"), (64, "c000"), (-64, "40"), (-65, "bf7f")):
        assert C.sleb(n).hex() == b and C.Reader(bytes.fromhex(b)).int() == n
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(-(2**63), 2**63 - 1)
        assert C.Reader(C.sleb(n)).int() == n and C.Reader(C.uleb(abs(n))).uint() == abs(n)
    for bad in (b"", b"\x80", b"\xff" * 11):
        with pytest.raises(C.FormatError):
            C.Reader(bad).uint()
    with pytest.raises(C.FormatError):
        C.uleb(-1)
    with pytest.raises(C.FormatError):
        C.uleb(2**53, 53)


def test_run_lengths():
    for values, b in (([1, 2, 3], "7d010203"), ([0, 1, 2, 2, 3], "7e000102027f03"), ([1] * 6, "0601"), ([None] * 5, ""), ([None, 1, None], "00017f010001")):
        assert C.encode_column(C.UINT, values).hex() == b
        assert C.decode_column(C.UINT, bytes.fromhex(b)) == ([] if not b else values)
    for bad in ("0101", "0000", "7f017f02", "020102" + "01", "7e0101", "00010001"):
        with pytest.raises(C.FormatError):
            C.decode_column(C.UINT, bytes.fromhex(bad))


def test_columns_round_trip():
    rnd = random.Random(2)
    for _ in range(60):
        n = rnd.randint(1, 40)
        numbers = [rnd.choice([None, 1, 2, rnd.randint(0, 10**9)]) for _ in range(n)]
        texts = [rnd.choice([None, "a", "é\U0001f600", ""]) for _ in range(n)]
        flags = [rnd.random() < 0.5 for _ in range(n)]
        for kind, v in ((C.UINT, numbers), (C.DELTA, numbers), (C.STRING, texts), (C.BOOL, flags)):
            got = C.decode_column(kind, C.encode_column(kind, v))
            assert got == v or all(x is None for x in v) and got == []


EDIT = {"actor": "aaaa", "seq": 1, "startOp": 1, "time": 9, "message": None, "deps": [], "ops": [
    {"action": "makeText", "obj": "_root", "key": "text", "insert": False, "pred": []},
    {"action": "set", "obj": "1@aaaa", "elemId": "_head", "insert": True, "value": "h", "pred": []},
    {"action": "del", "obj": "1@aaaa", "elemId": "2@aaaa", "insert": False, "pred": ["2@aaaa"]},
    {"action": "set", "obj": "1@aaaa", "elemId": "_head", "insert": True, "value": "H", "pred": []},
    {"action": "set", "obj": "1@aaaa", "elemId": "4@aaaa", "insert": True, "value": "i", "pred": []},
]}


def test_known_change():
    """The bytes of a text edit."""
    data, hash_ = C.encode_change(EDIT)
    assert data.hex() == (
        "856f4a83e2bdfbf5015e0002aaaa010109000" "00c010402041108130715083404420656065703700671027302"
        "000104000001040100027f0000017f000001" "7c0002" "7e04" "7f0474657874" "0004" "01010102" "7d0401030201" "7d0016000216" "684869" "02007f010200" "7f00" "7f02"
    )
    back = C.decode_change(data)
    assert back["hash"] == hash_ and [{k: v for k, v in op.items() if k != "id"} for op in back["ops"]] == EDIT["ops"]
    assert C.encode_change(back)[0] == data


def test_values_and_multiple_operations():
    ops = [{"action": "makeList", "obj": "_root", "key": "l", "pred": []}, {"action": "set", "obj": "1@aaaa", "elemId": "_head", "insert": True, "values": [1, 2.5, "x", None, True], "pred": []}]
    ops += [{"action": "set", "obj": "_root", "key": t, "datatype": t, "value": v, "pred": []} for t, v in (("counter", -5), ("timestamp", 1_600_000_000_000), ("uint", 7), ("float64", 2.0), ("13", b"\x01\x02"))]
    ops += [{"action": "del", "obj": "1@aaaa", "elemId": "2@aaaa", "multiOp": 3, "pred": ["2@aaaa"]}]
    data, _ = C.encode_change(EDIT | {"ops": ops})
    got = C.decode_change(data)["ops"]
    assert [op.get("value") for op in got[1:6]] == [1, 2.5, "x", None, True] and got[2]["elemId"] == "2@aaaa"
    assert [(op["datatype"], op["value"]) for op in got[6:11]] == [("counter", -5), ("timestamp", 1_600_000_000_000), ("uint", 7), ("float64", 2.0), ("13", b"\x01\x02")]
    assert [(op["elemId"], op["pred"]) for op in got[11:]] == [(f"{k}@aaaa", [f"{k}@aaaa"]) for k in (2, 3, 4)]


def test_sizes_and_refusals():
    long = EDIT | {"ops": [{"action": "set", "obj": "_root", "key": "x", "value": "a" * 1024, "pred": []}]}
    data, hash_ = C.encode_change(long)
    assert len(data) < 100 and C.decode_change(data)["ops"][0]["value"] == "a" * 1024
    plain, same = C.encode_change(long, compress=False)
    assert same == hash_ and len(plain) > 1024 and C.decode_change(plain)["hash"] == hash_
    for bad in (data[:-1], b"\x00" + data[1:], data[:20] + bytes([data[20] ^ 1]) + data[21:], b""):
        with pytest.raises((C.FormatError, ValueError, C.zlib.error)):
            C.decode_change(bad)
    with pytest.raises(C.FormatError):
        C.encode_change(long | {"hash": "0" * 64})
    assert len(C.encode_document([C.decode_change(data)])) < 200


def history():
    a, ha = C.encode_change(EDIT)
    b, hb = C.encode_change({"actor": "bbbb", "seq": 1, "startOp": 6, "time": 1, "message": "b", "deps": [ha], "ops": [{"action": "set", "obj": "1@aaaa", "elemId": "4@aaaa", "insert": True, "value": "!", "pred": []}, {"action": "set", "obj": "_root", "key": "k", "value": 1, "pred": []}]})
    c, hc = C.encode_change({"actor": "aaaa", "seq": 2, "startOp": 6, "time": 2, "message": None, "deps": [ha], "ops": [{"action": "del", "obj": "1@aaaa", "elemId": "4@aaaa", "pred": ["4@aaaa"]}]})
    d, _ = C.encode_change({"actor": "bbbb", "seq": 2, "startOp": 8, "time": 3, "message": None, "deps": sorted([hb, hc]), "ops": [{"action": "set", "obj": "_root", "key": "k", "value": 2, "pred": ["7@bbbb"]}, {"action": "del", "obj": "_root", "key": "k", "pred": ["7@bbbb"]}], "extraBytes": b"zz"})
    return [C.decode_change(x) for x in (a, b, c, d)]


def test_document_round_trip():
    changes = history()
    data = C.encode_document(changes)
    assert C.decode_document(data) == changes
    assert C.encode_document(C.decode_document(data)) == data
    assert [k for k, _, _ in C.containers(data + C.encode_change(EDIT)[0])] == [C.DOCUMENT, C.CHANGE]


def test_sync_messages():
    hs = sorted(f"{random.Random(k).getrandbits(256):064x}" for k in range(50))
    bloom = C.encode_bloom(hs[:40])
    assert all(C.bloom_contains(bloom, h) for h in hs[:40]) and sum(C.bloom_contains(bloom, h) for h in hs[40:]) <= 2
    m = {"heads": hs[:2], "need": [], "have": [{"lastSync": hs[3:4], "bloom": bloom}], "changes": [b"abc"]}
    assert C.decode_message(C.encode_message(m) + b"future") == m
    assert C.decode_state(C.encode_state(hs)) == hs and not C.bloom_contains(b"", hs[0])
    with pytest.raises(C.FormatError):
        C.encode_state(hs[::-1])


def test_numbers_as_expressions_over_bits(spark):
    from pyspark.sql import functions as F

    from mergeloom.functions import bits
    from mergeloom.sources import codec

    whole = sorted({s * (1 << k) + d for k in range(0, 53) for d in (-1, 0, 1) for s in (1, -1)})
    df = spark.createDataFrame([(n,) for n in whole] + [(None,)], "n long")
    n = F.col("n")
    got = df.select("n", bits.uleb(n).alias("u"), bits.sleb(n).alias("s"), bits.uleb_value(bits.uleb(n)).alias("ub"), bits.sleb_value(bits.sleb(n)).alias("sb"), bits.uleb_length(n).alias("ul"), bits.sleb_length(n).alias("sl")).collect()
    for r in got:
        if r["n"] is None:
            assert r["u"] is None and r["s"] is None
            continue
        assert bytes(r["s"]) == codec.sleb(r["n"]) and r["sb"] == r["n"] and r["sl"] == len(r["s"])
        if r["n"] >= 0:
            assert bytes(r["u"]) == codec.uleb(r["n"]) and r["ub"] == r["n"] and r["ul"] == len(r["u"])
        else:
            assert r["u"] is None
    body = spark.createDataFrame([(b"",), (b"x" * 5,), (b"y" * 300,)], "b binary").select("b", bits.container_hash(codec.CHANGE, F.col("b")).alias("h")).collect()
    assert all(r["h"] == codec.container(codec.CHANGE, bytes(r["b"]))[1] for r in body)
