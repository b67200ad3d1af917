"""Binary tables, streams of changes, and sessions."""

import random

import pytest
from pyspark.sql import functions as F

from mergeloom.operators import visibility
from mergeloom.plans.session import Document, MergeError
from mergeloom.sources import binary, codec
from mergeloom.streaming import CHANGES, OPS, Store, run


def changes():
    a, ha = codec.encode_change({"actor": "aa", "seq": 1, "startOp": 1, "time": 0, "message": "x", "deps": [], "ops": [{"action": "set", "obj": "_root", "key": "k", "value": 1, "pred": []}]})
    b, hb = codec.encode_change({"actor": "bb", "seq": 1, "startOp": 2, "time": 0, "message": None, "deps": [ha], "ops": [{"action": "set", "obj": "_root", "key": "k", "value": "v", "pred": ["1@aa"]}]})
    return [(a, ha), (b, hb)]


def test_binary_tables(spark):
    (a, ha), (b, hb) = changes()
    files = spark.createDataFrame([("d", a + b), ("e", a), ("f", None)], "doc_id string, data binary")
    assert sorted((r["doc_id"], r["hash"]) for r in binary.src_chunks(files).collect()) == sorted([("d", ha), ("d", hb), ("e", ha)])
    assert {(r["hash"], r["message"]) for r in binary.src_change_meta(files).collect()} == {(ha, "x"), (hb, None)}
    ops = binary.src_ops(files)
    seen = {(r["doc_id"], r["s"], r["value_i"]) for r in visibility.visible(ops).collect()}
    assert seen == {("d", "v", None), ("e", None, 1)}
    saved = binary.snk_save(spark.createDataFrame([("d", b), ("d", a)], "doc_id string, data binary"))
    assert {(r["s"], r["value_i"]) for r in visibility.visible(binary.src_ops(saved)).collect()} == {("v", None)}
    head = binary.src_change_meta(files).filter("doc_id = 'd'").withColumnRenamed("hash", "change_id")
    back = binary.snk_change(head, ops.filter("doc_id = 'd'").withColumnRenamed("change_hash", "change_id")).collect()
    assert {r["hash"] for r in back} == {ha, hb} and {bytes(r["data"]) for r in back} == {a, b}


def test_files_and_containers_in_sql(spark, tmp_path):
    (a, ha), (b, hb) = changes()
    (tmp_path / "one.bin").write_bytes(a + b)
    (tmp_path / "none.bin").write_bytes(b"")
    files = binary.read_files(spark, f"file://{tmp_path}/*.bin")
    assert {r["doc_id"] for r in files.collect()} == {"one.bin"}
    binary.register(spark)
    got = spark.sql("SELECT f.doc_id, c.hash, c.kind FROM {files} f, LATERAL containers(f.data) c", files=files).collect()
    assert sorted((r["doc_id"], r["hash"], r["kind"]) for r in got) == sorted([("one.bin", ha, 1), ("one.bin", hb, 1)])


def history(n, seed):
    rnd = random.Random(seed)
    out, heads = [], []
    for k in range(1, n + 1):
        deps = list(heads) if rnd.random() < 0.7 else heads[:1]
        h = f"{k:064x}"
        key = rnd.choice(["x", "y"])
        pred = [(c[4], c[2]) for c in out if c[5] == key and c[1] in deps][:1]
        out.append(("d", h, f"a{k % 3}", k, k, key, deps, pred))
        heads = [x for x in heads if x not in deps] + [h]
    return out


def frames(spark, rows):
    c = spark.createDataFrame([(d, h, a, s, deps) for d, h, a, s, _, _, deps, _ in rows], CHANGES)
    o = spark.createDataFrame([(d, h, ctr, a, "_root", key, None, False, "set", "int", ctr, None, pred) for d, h, a, _, ctr, key, _, pred in rows], OPS)
    return c, o


def test_any_arrival_order_gives_one_state(spark, tmp_path):
    rows = history(8, 1)
    want = {(r["cell"], r["ctr"]) for r in visibility.visible(frames(spark, rows)[1]).collect()}
    shuffled = rows[::-1]
    store = Store(spark, f"file://{tmp_path}/s")
    first = store.apply(*frames(spark, shuffled[:4])).collect()
    assert first == [] and store.waiting().count() == 4 and store.applied().count() == 0
    patch = store.apply(*frames(spark, shuffled[3:])).collect()  # overlaps with the first batch
    assert store.waiting().count() == 0 and store.applied().count() == 8
    assert {(r["cell"], r["ctr"]) for r in visibility.visible(store.ops()).collect()} == want
    assert {r["edit"] for r in patch} == {"insert"}
    assert store.apply(*frames(spark, rows[:2])).collect() == [] and store.ops().count() == 8


def test_a_batch_reads_the_buckets_of_its_documents(spark, tmp_path):
    from mergeloom import streaming

    rows = history(4, 4)
    store = Store(spark, f"file://{tmp_path}/s")
    for doc in ("d", "e", "f"):
        store.apply(*frames(spark, [(doc, *r[1:]) for r in rows])).collect()
    c, o = frames(spark, [("d", f"{9:064x}", "a9", 1, 9, "x", [rows[-1][1]], [])])
    patch = store.apply(c, o.withColumn("d", F.lit(2.5)).withColumn("vtype", F.lit("float64"))).collect()
    assert {r["doc_id"] for r in patch} == {"d"} and store.ops().filter("d = 2.5").count() == 1
    bucket = streaming._bucketed(c).first()["bucket"]
    assert store.applied().count() == 13 and {r["doc_id"] for r in store.applied([bucket]).collect()} >= {"d"}
    assert len(store.applied([bucket]).inputFiles()) <= len(store.applied().inputFiles())


def test_stream(spark, tmp_path):
    rows = history(5, 2)
    c, o = frames(spark, rows)
    op = F.struct(*[x for x in o.columns if x not in ("doc_id", "change_hash")])
    nested = c.join(o.groupBy("doc_id", F.col("change_hash").alias("hash")).agg(F.collect_list(op).alias("ops")), ["doc_id", "hash"])
    nested.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(nested.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    patches = []
    store = Store(spark, f"file://{tmp_path}/s")
    run(stream, store, f"{tmp_path}/cp", lambda p, n: patches.extend(p.collect())).awaitTermination()
    assert store.applied().count() == 5 and patches
    assert {(r["cell"], r["ctr"]) for r in visibility.visible(store.ops()).collect()} == {(r["cell"], r["ctr"]) for r in visibility.visible(o).collect()}


def test_session_edits_and_merge():
    a = Document("aa")
    with a.change("first") as root:
        root["n"] = 1
        root["m"] = {"z": [1, 2, 3], "b": True}
        root["t"] = a.text("hello")
        root["c"] = a.counter(10)
    b = Document("bb").merge(a)
    with a.change() as root:
        root["m"]["z"].append(4)
        root["t"].insert(5, "!")
        root["c"].increment(2)
        root["n"] = 2
    with b.change() as root:
        del root["m"]["z"][0]
        root["c"].increment(5)
        root["n"] = 3
    ab, ba = Document("cc").merge(a).merge(b), Document("dd").merge(b).merge(a)
    assert ab.value() == ba.value() == {"n": 2, "m": {"z": [2, 3, 4], "b": True}, "t": "hello!", "c": 17}
    assert sorted(ab.conflicts("n").values()) == [2, 3] and ab.conflicts("m") == {}
    assert ab.heads() == ba.heads() and len(ab.heads()) == 2
    assert Document.load(ab.save()).value() == ab.value()
    assert [h["message"] for h in a.history()][0] == "first" and a.at(1).value()["n"] == 1
    assert [len(x.changes_since(a.at(1).heads())) for x in (a, b, ab)] == [1, 1, 2] and len(ab.changes_since(ab.heads())) == 0


def test_session_rules():
    d = Document("aa")
    with d.change() as root:
        root["c"] = d.counter(1)
        root["l"] = ["a"]
    n = len(d.changes)
    with d.change() as root:
        pass
    assert len(d.changes) == n  # nothing was done
    with d.change() as root:
        root["l"][2] = "c"  # past the end: filled with nulls
    assert d.value()["l"] == ["a", None, "c"]
    for bad in (lambda r: r.__setitem__("c", 5), lambda r: r.__setitem__("", 5), lambda r: r["l"].__delitem__(9), lambda r: r["c"].increment("x")):
        with pytest.raises(MergeError), d.change() as root:
            bad(root)
    assert d.value()["c"] == 1
    with pytest.raises(MergeError):
        Document("xyz")


def test_session_sync_converges():
    rnd = random.Random(5)
    a, b = Document("aa"), Document("bb")
    with a.change() as r:
        r["l"] = [0]
    b.merge(a)
    for k in range(12):
        with rnd.choice([a, b]).change() as r:
            r["l"].append(k)
            r[f"k{k % 4}"] = k
        if k == 6:
            a.merge(b)
    sa, sb = a.sync_state(), b.sync_state()
    for _ in range(10):
        m, n = a.generate(sa), b.generate(sb)
        if m is None and n is None:
            break
        if m is not None:
            b.receive(sb, m)
        if n is not None:
            a.receive(sa, n)
    assert m is None and n is None and a.heads() == b.heads() and a.value() == b.value()


def talk_in_turn(first, second, rounds=60):
    """Messages of two replicas that speak one after the other; how many there were."""
    sides = [(first, first.sync_state()), (second, second.sync_state())]
    n = quiet = turn = 0
    while quiet < 2:
        (me, mine), (peer, theirs) = sides[turn], sides[1 - turn]
        m = me.generate(mine)
        if m is None:
            quiet += 1
        else:
            n, quiet = n + 1, 0
            assert n < rounds
            peer.receive(theirs, m)
        turn = 1 - turn
    return n


@pytest.mark.parametrize("n", [1, 2, 7, 60, 100])
def test_sync_in_turn_takes_few_messages(n):
    for full_first in (True, False):
        a, b = Document("aa"), Document("bb")
        for k in range(n):
            with a.change(seconds=0) as root:
                root["k"] = k
        assert talk_in_turn(*((a, b) if full_first else (b, a))) <= 10
        assert a.heads() == b.heads() and b.value() == a.value()
        for k in range(n):  # both go on
            with (a if k % 2 else b).change(seconds=0) as root:
                root[f"x{k}"] = k
        assert talk_in_turn(a, b) <= 10
        assert a.heads() == b.heads() and b.value() == a.value()


def test_lists_by_the_names_of_arrays():
    d = Document("aa")
    with d.change() as root:
        root["l"] = [1, 2, 3]
        x = root["l"]
        assert x.push(4, 5) == 5 and x.shift() == 1 and x.unshift(0) == 5
        x.insert_at(1, 9, 8)
        x.delete_at(3, 2)
        assert x.splice(-2, 1, "a", "b") == [4]
        x.fill(7, 3)
    assert d.value()["l"] == [0, 9, 8, 7, 7, 7]
    with d.change() as root:
        root["e"] = []
        assert root["e"].shift() is None and root["l"].splice(4) == [7, 7]
        with pytest.raises(MergeError):
            root["l"].delete_at(3, 5)
    assert d.value()["l"] == [0, 9, 8, 7]


def test_rows_get_ids_from_a_source_that_can_be_replaced():
    from mergeloom.functions import ids

    d = Document("aa")
    ids.set_source(iter(["id1", "id2"]).__next__)
    try:
        with d.change() as root:
            root["t"] = d.table()
            assert root["t"].add({"n": 1}) == "id1" and root["t"].add({"n": 2}) == "id2"
    finally:
        ids.reset_source()
    assert d.value()["t"]["id2"] == {"n": 2, "id": "id2"} and len(ids.new_id()) == 32


def test_changes_that_do_not_fit_are_taken_as_a_whole_or_not():
    a = Document("aa")
    with a.change(seconds=0) as root:
        root["x"] = 1
    with a.change(seconds=0) as root:
        root["y"] = {}
    one, two = a.changes.values()
    op = next(o for o in two["ops"])
    wrong = two | {"ops": [op | {"pred": ["1@aa"]}]}  # names an operation of another key
    b = Document("bb")
    with pytest.raises(MergeError):
        b.apply([one, wrong])
    assert b.value() == {} and not b.changes and not b.waiting and b.heads() == [] and b.max_op == 0
    assert b.apply([two]).missing() == one["deps"] + [one["hash"]] and b.apply([one]).value() == {"x": 1, "y": {}}


def test_edits_call_back_and_undo():
    seen = []
    d = Document("aa", on_change=lambda doc: seen.append(doc.value()))
    with d.change() as root:
        root["n"] = d.counter(1)
    with pytest.raises(MergeError), d.change() as root:
        root["n"].increment(5)
        root["m"] = [1, 2]
        root[""] = 1
    assert d.value() == {"n": 1} and seen == [{"n": 1}] and d.max_op == 1
    with d.change() as root:
        root["n"].increment(2)
    assert seen[-1] == {"n": 3}


def test_bytes_and_unknown_types_keep_their_bytes(spark):
    from mergeloom.sources import binary

    changes = spark.createDataFrame([("d", "c", "aa", 1, 1, 0, None, [])], "doc_id string, change_id string, actor string, seq long, start_op long, time_s long, message string, deps array<string>")
    rows = [("d", "c", 1, "_root", "b", None, False, "set", "bytes", None, None, None, bytearray(b"\x00\xff"), []), ("d", "c", 2, "_root", "u", None, False, "set", "13", None, None, None, bytearray(b"zz"), [])]
    ops = spark.createDataFrame(rows, "doc_id string, change_id string, ctr long, obj string, key string, elem string, insert boolean, action string, vtype string, i long, d double, s string, raw binary, pred array<struct<ctr:long,actor:string>>")
    files = binary.snk_change(changes, ops)
    got = {r["key"]: (r["vtype"], bytes(r["raw"])) for r in binary.src_ops(files).collect()}
    assert got == {"b": ("bytes", b"\x00\xff"), "u": ("13", b"zz")}
    saved = binary.snk_save(files)
    assert {r["key"]: bytes(r["raw"]) for r in binary.src_ops(saved).collect()} == {"b": b"\x00\xff", "u": b"zz"}
    h = binary.src_doc_header(saved)
    assert h.first()["actors"] == ["aa"] and binary.snk_doc_header(h).first()["header"] == h.first()["header"]


def _random_document(seed):
    """Changes by three actors: keys, nested lists, deletions, counters, values of all types, and bytes nobody knows."""
    rnd = random.Random(seed)
    out, top, elems, shown, heads = [], {}, [], {}, []
    n, made = 0, None
    for k in range(60):
        me, ops, start = rnd.choice(["aa", "bb", "cc"]), [], n + 1
        for _ in range(rnd.randint(0, 9)):
            n += 1
            what = rnd.random()
            if made is None or what < 0.02:
                ops.append({"action": rnd.choice(["makeList", "makeText"]), "obj": "_root", "key": f"l{k}", "pred": []})
                made, elems = f"{n}@{me}", ["_head"]
            elif what < 0.4:
                ops.append({"action": "set", "obj": made, "elemId": rnd.choice(elems), "insert": True, "value": rnd.choice(["x", "é", 1.5, 7, True]), "pred": []})
                elems.append(f"{n}@{me}")
            elif what < 0.5 and len(elems) > 1:
                e = rnd.choice(elems[1:])
                gone = shown.pop((made, e), [e])
                action = rnd.choice(["set", "del"]) if gone else "set"
                shown[made, e] = [f"{n}@{me}"] if action == "set" else []
                ops.append({"action": action, "obj": made, "elemId": e, "pred": gone} | ({"value": n} if action == "set" else {}))
            else:
                key = rnd.choice(["k", "ключ", "z", "zz"])
                gone = shown.get(key, [])
                action = "del" if gone and what > 0.9 else "set"
                shown[key] = [f"{n}@{me}"] if action == "set" else []
                value = rnd.choice([{"value": None}, {"value": False}, {"value": 2.25}, {"value": float("inf")}, {"value": "s" * rnd.randint(0, 300)}, {"value": 3, "datatype": "counter"}, {"value": b"\x00\x01", "datatype": "12"}, {"value": b"by"}, {"value": 1 << 50, "datatype": "uint"}, {"value": -5, "datatype": "timestamp"}])
                ops.append({"action": action, "obj": "_root", "key": key, "pred": gone} | (value if action == "set" else {}))
        change = {"actor": me, "seq": top.get(me, 0) + 1, "startOp": start, "time": k - 9, "message": rnd.choice([None, "m"]), "deps": heads, "ops": ops} | ({"extraBytes": b"more"} if k % 17 == 3 else {})
        data, h = codec.encode_change(change)
        top[me] = change["seq"]
        heads = sorted([h, *heads[:1]]) if k % 5 == 2 else [h]
        out.append(data)
    return out


def test_documents_are_the_same_bytes_in_pieces(spark, monkeypatch):
    """The bytes of a document, and what is read of it, do not hang on pieces: as from all changes and operations at once."""
    docs = {f"d{k}": _random_document(k) for k in range(4)}
    files = spark.createDataFrame([(d, x) for d, own in docs.items() for x in own[::-1]], "doc_id string, data binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        saved = {r["doc_id"]: bytes(r["data"]) for r in binary.snk_save(files).collect()}
        assert saved == {d: _in_memory(own) for d, own in docs.items()}
        whole = spark.createDataFrame([*saved.items(), ("both", saved["d1"] + docs["d0"][0] + saved["d1"])], "doc_id string, data binary")
        got = sorted(map(repr, binary.src_ops(whole).collect()))
        meta = sorted(map(repr, binary.src_change_meta(whole).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(map(repr, binary.src_ops(_as_changes(spark, whole)).collect()))
    assert meta == sorted(map(repr, binary.src_change_meta(_as_changes(spark, whole)).collect()))


def _in_memory(own):
    return codec.encode_document(_levels([codec.decode_change(x) for x in own]))


def _levels(decoded):
    done, todo = {}, sorted(decoded, key=lambda c: (c["startOp"], c["actor"]))
    while todo:
        done |= {c["hash"]: c for c in [c for c in todo if all(d in done for d in c["deps"])]}
        todo = [c for c in todo if c["hash"] not in done]
    return list(done.values())


def _as_changes(spark, files):
    rows = []
    for r in files.collect():
        for kind, body, _ in codec.containers(bytes(r["data"])):
            whole = codec.container(kind, body)[0]
            rows += [(r["doc_id"], codec.encode_change(c)[0]) for c in codec.decode_document(whole)] if kind == codec.DOCUMENT else [(r["doc_id"], whole)]
    return spark.createDataFrame(rows, "doc_id string, data binary")


def test_columns_in_pieces():
    """Columns fed and taken in pieces of any size have the bytes and values of whole ones, and broken ones are refused alike."""
    import numpy as np

    from mergeloom.sources import columns

    rnd = random.Random(5)
    for k in range(300):
        kind = rnd.choice([codec.UINT, codec.DELTA, codec.STRING, codec.BOOL, codec.ACTOR])
        pool = [None, 0, 1, 127, 128, 1 << 40, (1 << 53) - 1] if kind != codec.BOOL else [0, 1]
        v = [x for _ in range(rnd.randint(0, 40)) for x in [rnd.choice(pool[: rnd.randint(1, len(pool))])] * rnd.choice([1, 1, 1, 2, 3])]
        texts = [f"t{x}" for x in pool]
        want = codec.encode_column(kind, [None if x is None else f"t{x}" for x in v] if kind == codec.STRING else v)
        enc, step = columns.Encoder(kind), rnd.randint(1, 9)
        for a in range(0, len(v), step):
            x = [columns.NONE if y is None else texts.index(f"t{y}") if kind == codec.STRING else y for y in v[a : a + step]]
            enc.feed(np.array(x, np.int64), texts if kind == codec.STRING else None)
        assert enc.finish() == want, (kind, v, step)
        for data in (want, want[:-1], want + want):
            try:
                whole = codec.decode_column(kind, data)
            except codec.FormatError:
                whole = codec.FormatError
            dec, got = columns.Decoder(kind, data), []
            try:
                while len(x := dec.take(step)):
                    got += x if kind == codec.STRING else [None if y == columns.NONE else y for y in x.tolist()]
            except codec.FormatError:
                got = codec.FormatError
            assert got == whole, (kind, data)


def test_tails_of_changes_by_columns():
    """A change's bytes from columns are those from its operations, for values with fraction and for all others."""
    import pyarrow as pa

    rnd = random.Random(9)
    kinds = {"ctr": pa.int64(), "obj": pa.string(), "key": pa.string(), "elem": pa.string(), "insert": pa.bool_(), "action": pa.string(), "vtype": pa.string(), "i": pa.int64(), "d": pa.float64(), "s": pa.string(), "raw": pa.binary(), "pred": pa.list_(pa.struct({"ctr": pa.int64(), "actor": pa.string()}))}
    for k in range(200):
        ids = lambda: f"{rnd.randint(1, 300)}@{rnd.choice(['aa', 'bb', 'cc', '01'])}"
        rows = []
        for n in range(rnd.randint(1, 30)):
            key = rnd.choice(["k", "ключ", None])
            action = rnd.choice(["set", "set", "del", "inc"] + ["makeMap"] * (k % 3 == 0))
            vtype = rnd.choice(["float64", "null"] + ["int"] * (k % 5 == 0)) if action in ("set", "inc") else None
            pred = [{"ctr": int(p.split("@")[0]), "actor": p.split("@")[1]} for p in {ids() for _ in range(rnd.choice([0, 0, 1, 3]))}]
            if k % 2:
                pred.sort(key=lambda p: (p["ctr"], p["actor"]))
            rows.append({"ctr": n, "obj": rnd.choice(["_root", ids()]), "key": key, "elem": None if key else rnd.choice(["_head", ids()]), "insert": not key and rnd.random() < 0.5, "action": action, "vtype": vtype, "i": 5 if vtype == "int" else None, "d": rnd.random() if vtype == "float64" else None, "s": None, "raw": None, "pred": rnd.choice([pred, pred, None]) or None})
        want = codec.change_tail({"actor": "bb", "startOp": 0, "ops": binary._op_dicts(rows)})
        assert binary._tail("bb", pa.Table.from_pylist(rows, pa.schema(kinds))) == want
