"""Registered queries over small tables, against brute force."""

import random
from datetime import datetime, timedelta

from mergeloom import catalog, catalog_sessions
from mergeloom.sources import codec
from mergeloom.sources.derived import event_changes, event_ops


def saved(df, tmp_path, name):
    df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_whole_texts_are_encoded(spark, tmp_path):
    texts = ["", "é", "abc " * 30_000, "zażółć 😀 " * 50, None]
    d = saved(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tmp_path, "documents")
    got = {r["doc_id"]: r["h"] for r in catalog_sessions.QUERIES["enc_utf8_hex"](spark, d).collect() if r["same"]}
    assert got == {i: t.encode().hex() for i, t in enumerate(texts) if t is not None}


def test_history_has_all_entries(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(k, rnd.randrange(3), datetime(2024, 1, 1 + k // 40, 3) + timedelta(seconds=k), rnd.choice(["error", "click", "view"]), float(k)) for k in range(160)]
    d = saved(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double"), tmp_path, "events")
    got = {(r["arrival"], r["key"], r["op_id"], r["n_values"]) for r in catalog.QUERIES["dag_history"](spark, d).collect()}
    # Brute force: the past of each change by walking up, then what of it nothing in it hides.
    changes = {r["hash"]: r for r in event_changes(spark, d).collect()}
    ops = event_ops(spark, d).collect()
    want = set()
    for c in changes.values():
        past, todo = set(), [c["hash"]]
        while todo:
            h = todo.pop()
            if h not in past:
                past.add(h)
                todo += changes[h]["deps"]
        own = [o for o in ops if o["change_hash"] in past]
        gone = {(p["ctr"], p["actor"]) for o in own for p in o["pred"]}
        cells = {}
        for o in own:
            if o["action"] != "del" and (o["ctr"], o["actor"]) not in gone:
                cells.setdefault(o["key"], []).append((o["ctr"], o["actor"]))
        want |= {(c["arrival"], k, "{}@{}".format(*max(v)), len(v)) for k, v in cells.items()}
    assert len(changes) == 12 and {a for a, *_ in want} == set(range(1, 13))
    assert got == want


def test_values_of_all_types(spark, tmp_path):
    values = [("str", "zażółć"), ("str", ""), ("null", None), ("bool", True), ("bool", False), ("int", -65), ("counter", 8191), ("timestamp", 1_700_000_000_000)]
    values += [("uint", n) for n in (0, 127, 128, 16_384, 2**53 - 1)] + [("float64", x) for x in (0.1, -0.0, 1e300, 5e-324, 3.0)]
    field = {"str": "s", "bool": "b", "float64": "d"}
    rows = [(k, "set", {"vtype": t, **({field.get(t, "i"): v} if v is not None else {})}) for k, (t, v) in enumerate(values)]
    df = spark.createDataFrame([*rows, (99, "del", None)], "row_id long, action string, val struct<vtype:string,b:boolean,i:long,d:double,s:string>")
    d = saved(df, tmp_path, "op_log")
    tags = {r["row_id"]: r["tag"] for r in catalog_sessions.QUERIES["enc_value"](spark, d).collect()}
    assert tags == {k: codec.encode_value({True: "true", False: "false"}[v] if t == "bool" else t, v)[0] for k, (t, v) in enumerate(values)}
    shown = {r["row_id"]: r for r in catalog.QUERIES["prj_value"](spark, d).collect()}
    assert len(shown) == len(values)
    for k, (t, v) in enumerate(values):
        if t == "float64":
            assert shown[k]["number"] == v and shown[k]["shown"] is None
        else:
            assert (shown[k]["moment"] is not None) == (t == "timestamp") and shown[k]["shown"] == {"null": "null", "bool": str(v).lower()}.get(t, str(v))
