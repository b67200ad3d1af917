"""Scenarios of merging: data in, state out."""

import random

from pyspark.sql import functions as F

from mergeloom.operators import dag, encodings, prefix, reconcile, sequences, tables, visibility

OPS = "doc_id string, ctr long, actor string, obj string, key string, elem string, insert boolean, action string, vtype string, i long, s string, pred array<struct<ctr:long,actor:string>>"


def ops(spark, rows):
    """(ctr, actor, action, key, pred, value): keys of a map."""
    return spark.createDataFrame([("d", c, a, "_root", k, None, False, act, "counter" if act == "set" and k.startswith("#") else "int", v, None, p) for c, a, act, k, p, v in rows], OPS)


def shown(spark, rows):
    out = {}
    for r in visibility.visible(ops(spark, rows)).collect():
        out.setdefault(r["cell"], {})[f"{r['ctr']}@{r['actor']}"] = r["value_i"]
    return out


def test_assignment_conflict_and_resolution(spark):
    base = [(1, "aa", "set", "x", [], 1), (2, "bb", "set", "x", [(1, "aa")], 2), (2, "cc", "set", "x", [(1, "aa")], 3), (2, "dd", "set", "x", [(1, "aa")], 4)]
    assert shown(spark, base) == {"x": {"2@bb": 2, "2@cc": 3, "2@dd": 4}}
    assert visibility.agg_lww(visibility.visible(ops(spark, base))).first()["actor"] == "dd"
    assert shown(spark, [*base, (3, "aa", "set", "x", [(2, "bb"), (2, "cc"), (2, "dd")], 9)]) == {"x": {"3@aa": 9}}


def test_deletion_against_concurrent_set(spark):
    assert shown(spark, [(1, "aa", "set", "x", [], 1), (2, "bb", "del", "x", [(1, "aa")], None), (2, "cc", "set", "x", [(1, "aa")], 5)]) == {"x": {"2@cc": 5}}
    assert shown(spark, [(1, "aa", "set", "x", [], 1), (2, "bb", "del", "x", [(1, "aa")], None)]) == {}


def test_counters(spark):
    assert shown(spark, [(1, "aa", "set", "#n", [], 1), (2, "aa", "inc", "#n", [(1, "aa")], 2), (3, "bb", "inc", "#n", [(1, "aa")], 3)]) == {"#n": {"1@aa": 6}}
    assert shown(spark, [(1, "aa", "set", "#n", [], 1), (2, "aa", "inc", "#n", [(1, "aa")], 2), (3, "aa", "del", "#n", [(1, "aa")], None)]) == {}
    both = [(1, "aa", "set", "#n", [], 0), (1, "bb", "set", "#n", [], 100), (2, "aa", "inc", "#n", [(1, "aa")], 1), (2, "bb", "inc", "#n", [(1, "bb")], 3)]
    assert shown(spark, both) == {"#n": {"1@aa": 1, "1@bb": 103}}
    # An increment of both counts for the greater one; the other is hidden.
    assert shown(spark, [*both, (3, "aa", "inc", "#n", [(1, "aa"), (1, "bb")], 10)]) == {"#n": {"1@bb": 113}}


def test_missing_predecessor_is_found(spark):
    got = visibility.unmatched_preds(ops(spark, [(1, "aa", "set", "x", [(9, "zz")], 1), (2, "aa", "set", "y", [(1, "aa")], 1)])).collect()
    assert {(r["ctr"], r["pctr"]) for r in got} == {(1, 9), (2, 1)}


def test_convergence_under_any_order(spark):
    rnd = random.Random(3)
    rows, ids = [], []
    for c in range(1, 60):
        key = rnd.choice(["x", "y", "#n"])
        pred = [(a, b) for a, b, k in ids if k == key and rnd.random() < 0.4]
        actor = rnd.choice(["aa", "bb", "cc"])
        act = rnd.choice(["set", "set", "del"]) if key != "#n" else rnd.choice(["set", "inc"])
        rows.append((c, actor, act, key, pred, c))
        if act != "del":
            ids.append((c, actor, key))
    want = shown(spark, rows)
    for _ in range(3):
        rnd.shuffle(rows)
        assert shown(spark, rows) == want


def lists(spark, rows):
    """(ctr, actor, action, elem, insert, s, pred)"""
    return spark.createDataFrame([("d", c, a, "1@aa", None, e, ins, act, "str", None, s, p) for c, a, act, e, ins, s, p in rows], OPS)


def text(spark, rows, **kw):
    got = sequences.agg_text(sequences.crdt_list_state(lists(spark, rows))).collect()
    return got[0]["text"] if got else ""


def test_sibling_order_and_deletion(spark):
    rows = [(3, "aa", "set", "_head", True, "foo ", []), (5, "aa", "set", "3@aa", True, "bar ", []), (5, "bb", "set", "3@aa", True, "baz ", []), (6, "aa", "del", "3@aa", False, None, [(3, "aa")])]
    assert text(spark, rows) == "baz bar " and text(spark, rows[::-1]) == "baz bar "


def test_update_against_deletion_keeps_the_element(spark):
    rows = [(2, "aa", "set", "_head", True, "a", []), (3, "aa", "set", "2@aa", False, "b", [(2, "aa")]), (3, "bb", "del", "2@aa", False, None, [(2, "aa")])]
    assert text(spark, rows) == "b"


def test_runs_typed_at_one_place_do_not_mix(spark):
    rows = [(2 + k, a, "set", "_head" if k == 0 else f"{1 + k}@{a}", True, ch, []) for a, word in (("aa", "hello"), ("bb", "world")) for k, ch in enumerate(word)]
    assert text(spark, rows) == "worldhello"


def test_long_text_in_small_blocks(spark):
    word = "".join(random.Random(1).choice("abcdef ") for _ in range(700))
    rows = [(2 + k, "aa", "set", "_head" if k == 0 else f"{1 + k}@aa", True, ch, []) for k, ch in enumerate(word)]
    o = lists(spark, rows)
    placed = {r["elem"]: r["entry_rank"] for r in sequences.crdt_list_order(o, block_nodes=64).collect()}
    assert "".join(rows[int(e.split("@")[0]) - 2][5] for e in sorted(placed, key=placed.get, reverse=True)) == word
    assert text(spark, rows) == word and text(spark, []) == ""


def changes(spark, rows):
    return spark.createDataFrame([("d", h, a, s, d) for h, a, s, d in rows], "doc_id string, hash string, actor string, seq long, deps array<string>")


def test_graph_of_changes(spark):
    c = changes(spark, [("a", "x", 1, None), ("b", "x", 2, ["a"]), ("c", "y", 1, ["a"]), ("d", "x", 3, ["b", "c"]), ("f", "z", 1, ["gone"]), ("g", "z", 2, ["f", "d"])])
    got = lambda df: sorted(r["hash"] for r in df.collect())
    assert got(dag.anti_heads(c)) == ["g"]
    assert [r["dep"] for r in dag.anti_missing_deps(c).collect()] == ["gone"]
    assert got(dag.dag_ancestors(c, c.filter("hash = 'd'"))) == ["a", "b", "c", "d"]
    assert got(dag.dag_descendants(c, c.filter("hash = 'c'"))) == ["c", "d", "g"]
    assert got(dag.dag_apply(c)) == ["a", "b", "c", "d"]
    assert dag.agg_pending(c).first()["pending"] == 2
    assert got(dag.set_changes_since(c, c.filter("hash in ('a', 'c')"))) == ["b", "d", "f", "g"]  # one is an ancestor of the other
    assert got(dag.flt_causal_ready(c.filter("hash = 'a'"), c)) == ["b", "c"]
    assert dag.win_seq_check(c).count() == 0 and dag.win_seq_check(c.filter("hash <> 'b'")).first()["skipped"] == 1
    assert dag.dag_apply(c.limit(0)).count() == 0


def test_long_chain_needs_no_recursion_limit(spark):
    c = changes(spark, [(f"{k:03d}", "x", k + 1, [f"{k - 1:03d}"] if k else []) for k in range(40)])
    assert dag.dag_ancestors(c, c.filter("hash = '039'")).count() == 40


def test_bloom_has_no_false_negatives(spark):
    rnd = random.Random(2)
    hashes = [f"{rnd.getrandbits(256):064x}" for _ in range(300)]
    df = spark.createDataFrame([("d", h) for h in [*hashes, None]], "doc_id string, hash string")
    bits = reconcile.bloom_bits(df.limit(200), ["doc_id"])
    said = {r["hash"] for r in reconcile.syn_bloom_probe(df, bits, ["doc_id"]).collect()}
    assert set(hashes[:200]) <= said and len(said) < 215


def test_encodings_round_trip(spark):
    rows = spark.createDataFrame([("p", k, v) for k, v in enumerate([1, 1, None, None, 2, 2, 2, 1])] + [("q", 0, None)], "part string, k int, v long")
    runs = encodings.enc_rle(rows, ["part"], "k", "v")
    assert [(r["value"], r["n"]) for r in runs.filter("part = 'p'").orderBy("run").collect()] == [(1, 2), (None, 2), (2, 3), (1, 1)]
    assert [r["value"] for r in encodings.dec_rle(runs, ["part"]).filter("part = 'p'").orderBy("place").collect()] == [1, 1, None, None, 2, 2, 2, 1]
    d = encodings.enc_delta(rows, ["part"], "k", "v")
    assert [r["delta"] for r in d.filter("part = 'p'").orderBy("k").collect()] == [1, 0, None, None, 1, 0, 0, -1]
    assert [r["value"] for r in encodings.dec_delta(d, ["part"], "k").filter("part = 'p'").orderBy("k").collect()] == [1, 1, None, None, 2, 2, 2, 1]
    b = encodings.enc_bool(rows.withColumn("b", F.col("v") == 1), ["part"], "k", "b")
    assert [r["n"] for r in b.filter("part = 'p'").orderBy("run").collect()] == [0, 2, 5, 1]


def test_running_total_over_buckets(spark):
    rows = spark.createDataFrame([("a" if k % 3 else None, k, 1) for k in range(200)], "g string, k int, one int")
    got = prefix.running_total(rows, ["g"], "one", F.floor(F.col("k") / 17), [F.col("k")], "n")
    for g in ("a", None):
        part = [r for r in got.collect() if r["g"] == g]
        assert [r["n"] for r in sorted(part, key=lambda r: r["k"])] == list(range(1, len(part) + 1))


def test_incremental_patch(spark):
    schema = "key string, op_id string, n_values long"
    before = spark.createDataFrame([("a", "1@x", 1), ("b", "2@x", 1), ("c", "3@x", 1), ("e", "5@x", 1)], schema)
    after = spark.createDataFrame([("a", "1@x", 1), ("b", "4@x", 1), ("d", "6@x", 1), ("e", "5@x", 2)], schema)
    assert {r["key"]: r["edit"] for r in tables.crdt_inc_patch(before, after, ["key"]).collect()} == {"b": "update", "c": "remove", "d": "insert", "e": "conflict"}


CHANGES = "doc_id string, hash string, deps array<string>, arrival long"


def test_walk_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    c = spark.createDataFrame([("d", f"{k:05}", [f"{k - 1:05}"] if k else [], k) for k in range(n)], CHANGES)
    tip = c.filter(F.col("hash") == f"{n - 1:05}")
    up = dag.edges(c).withColumnRenamed("dep", "nxt")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    assert dag.reach(tip, up).count() == n
    assert len(jobs.getJobIdsForGroup("chain")) < 30
    # In blocks of 1,000 links, in the order of the chain: a round for each.
    spark.sparkContext.setJobGroup("blocks", "blocks")
    ordered = up.withColumn("at", F.col("hash").cast("long"))
    assert dag.reach(tip, ordered, order="at", block_links=1_000).count() == n
    assert len(jobs.getJobIdsForGroup("blocks")) < 200
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_walks_over_blocks_against_brute_force(spark):
    rnd = random.Random(11)
    links = sorted({("d" if rnd.random() < 0.7 else "e", rnd.randrange(60), rnd.randrange(60)) for _ in range(110)})
    df = spark.createDataFrame([(d, f"h{a}", f"h{b}") for d, a, b in links], "doc_id string, hash string, nxt string")
    start = [("d", 3, 1), ("d", 9, 2), ("e", 3, 1), ("e", 99, 5)]
    begun = spark.createDataFrame([(d, f"h{a}", e) for d, a, e in start], "doc_id string, hash string, entry long")
    want = set()
    for d, a, e in start:
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b for k, y, b in links if k == d and y == x]
        want |= {(e, d, f"h{x}") for x in seen}
    for size in (4, 1000):
        got = dag.reach(begun, df, by=("entry",), block_links=size).collect()
        assert {(r["entry"], r["doc_id"], r["hash"]) for r in got} == want and len(got) == len(want)
        plain = dag.reach(begun.filter("entry = 1"), df, block_links=size).collect()
        assert {(r["doc_id"], r["hash"]) for r in plain} == {(d, h) for e, d, h in want if e == 1}
    assert dag.reach(begun.limit(0), df).count() == 0
    assert dag.reach(begun, df.limit(0)).count() == 4


def test_parts_of_a_key_are_even_however_its_values_are_spread(spark):
    rows = [("hot", k if k < 900 else 10**12 + k) for k in range(1000)] + [("cold", 5), (None, 1)]
    got = prefix.even_parts(spark.createDataFrame(rows, "k string, v long"), "k", "v", 100).groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    hot = sorted((r["low"], r["high"], r["n"]) for r in got if r["k"] == "hot")
    assert len(hot) == 10 and all(80 <= n <= 120 for _, _, n in hot) and all(a[1] < b[0] for a, b in zip(hot, hot[1:], strict=False))
    assert {(r["k"], r["part"]) for r in got if r["k"] != "hot"} == {("cold", 0), (None, 0)}


def test_covered_and_covering_nodes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(visibility, "_CHUNK", 7)
    rnd = random.Random(13)
    up = {k: rnd.randrange(k) if k else None for k in range(80)}
    below = {k: [c for c in up if up[c] == k] for k in up}
    tour, todo = [], [(0, False)]
    while todo:
        k, left = todo.pop()
        tour.append((k, left))
        if not left:
            todo.append((k, True))
            todo += [(c, False) for c in below[k]]
    rank = {x: len(tour) - at for at, x in enumerate(tour)}
    marked = set(rnd.sample(range(1, 80), 9))
    above = lambda k: {k} if up[k] is None else {k} | above(up[k])
    rows = [("d", "r", str(k), rank[k, False], rank[k, True], rank[k, True] if k in marked else None, int(k in marked)) for k in up]
    t = spark.createDataFrame(rows, "doc_id string, root_id string, object_id string, entry_rank long, exit_rank long, gone_to long, touched int")
    assert {int(r["object_id"]) for r in visibility.uncovered(t, "gone_to").collect()} == {k for k in up if not above(k) & marked}
    assert {int(r["object_id"]) for r in visibility.covering(t, "touched").collect()} == set().union(*(above(k) for k in marked))


def _session_ops(spark, doc):
    """Operations of a session's document in the form the operators take."""
    from mergeloom.sources import binary

    df = spark.createDataFrame([("d", doc.save())], "doc_id string, data binary")
    return binary.src_ops(df).withColumn("b", F.when(F.col("vtype") == "bool", F.col("s") == "true"))


def _busy_document(seed=3):
    from mergeloom.plans.session import Document

    rnd = random.Random(seed)
    a = Document("aa")
    with a.change(seconds=0) as root:
        root["title"] = 'quo"ted \\ and\nmore'
        root["n"], root["x"], root["f"], root["no"] = 5, 2.5, True, None
        root["list"] = [1, {"deep": [[], {"er": {}}]}, "two", [3, 4]]
        root["text"], root["t"], root["hits"] = a.text("hello"), a.table(), a.counter(3)
        root["empty"] = {}
        root["t"]["row1"] = {"name": "one", "tags": ["a", "b"]}
    b = Document("bb").merge(a)
    for k in range(12):
        doc = rnd.choice([a, b])
        with doc.change(seconds=0) as root:
            root["hits"].increment(k)
            root["text"].insert(rnd.randint(0, len(root["text"])), rnd.choice("xyz") + '"')
            root["list"].insert(rnd.randint(0, len(root["list"])), k)
            root["t"][f"row{k}"] = {"name": str(k)}
            root["n"] = k
            if k % 4 == 3:
                del root["list"][0]
                root["list"][0] = {"new": k}
    return a.merge(b)


def test_whole_documents_are_what_a_session_shows(spark):
    import json

    from mergeloom.operators import documents

    doc = _busy_document()
    ops = _session_ops(spark, doc)
    want = json.loads(json.dumps(doc.value()))
    for part, block in ((20_000, 250_000), (7, 10)):
        parts = documents.whole_documents(ops, part=part, block_nodes=block).orderBy("part").collect()
        assert [r["part"] for r in parts] == list(range(len(parts))) and (part > 100 or len(parts) > 5)
        assert json.loads("".join(r["json"] for r in parts)) == want
    assert documents.whole_documents(ops.limit(0)).count() == 0


def test_list_patches_turn_one_state_into_the_other(spark, monkeypatch):
    monkeypatch.setattr(tables, "_CHUNK", 5)
    doc = _busy_document(5)
    ops = _session_ops(spark, doc)
    for upto in (12, 40, 70):
        before, after = sequences.crdt_list_state(ops.filter(F.col("ctr") <= upto)), sequences.crdt_list_state(ops)
        lists = {}
        for state, at in ((before, 0), (after, 1)):
            for r in state.orderBy("idx").collect():
                lists.setdefault(r["obj"], ([], []))[at].append((r["elem"], r["ctr"], r["actor"]))
        patch = tables.list_patch(ops.filter(F.col("ctr") <= upto), ops)
        edits = {}
        for r in patch.orderBy(F.col("place").desc()).collect():
            edits.setdefault(r["obj"], []).append(r)
        for obj, (old, new) in lists.items():
            now = [x[0] for x in old]
            for r in edits.get(obj, []):
                if r["edit"] == "insert":
                    now.insert(r["idx"], r["elem"])
                elif r["edit"] == "remove":
                    assert now.pop(r["idx"]) == r["elem"]
                else:
                    assert now[r["idx"]] == r["elem"] and old[r["before_idx"]][0] == r["elem"]
                    if r["edit"] != "keep":
                        assert r["before_id"] != r["after_id"] or r["edit"] == "conflict"
            assert now == [x[0] for x in new]
        runs = tables.multi_inserts(patch).agg(F.sum("n")).first()[0]
        assert runs == patch.filter("edit = 'insert'").count()


def test_tables_from_operations_with_conflicts(spark):
    from mergeloom.sources.derived import table_ops

    rows = spark.createDataFrame([(0, "zero", 1.5, None), (1, "one", None, 7), (2, None, 2.5, 8)], "k long, name string, x double, n int")
    types = {"k": "bigint", "name": "string", "x": "double", "n": "int"}
    ops = table_ops(rows, "t", "k", types)
    got = sorted((r["k"], r["name"], r["x"], r["n"]) for r in tables.crdt_table_state(ops, types).collect())
    assert got == [(0, "zero", 1.5, None), (1, "one", None, 7), (2, None, 2.5, 8)]
    cells = {(r["column"], r["value_i"]): r["n_values"] for r in tables.table_cells(tables.winners(ops)).filter("column = 'k'").collect()}
    assert cells == {("k", 0): 2, ("k", 1): 2, ("k", 2): 2}  # each with a value that lost
    doc = _busy_document()
    state = tables.crdt_table_state(_session_ops(spark, doc), {"name": "string"})
    assert {r["id"]: r["name"] for r in state.collect()} == {k: v["name"] for k, v in doc.value()["t"].items()}


def test_prefixes_over_many_buckets_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix, "CHUNK", 7)
    rnd = random.Random(19)
    rows = [(k, n, rnd.choice(["a", "a", "b", None]), rnd.choice([1, 5, None])) for k in ("x", "y", None) for n in rnd.sample(range(-100, 200), 80)]
    df = spark.createDataFrame(rows, "k string, n long, v string, x long")
    by_key = {k: sorted((r for r in rows if r[0] == k), key=lambda r: r[1]) for k in ("x", "y", None)}
    runs = encodings.enc_rle(df, ["k"], "n", "v").collect()
    for k, own in by_key.items():
        want = []
        for _, n, v, _ in own:
            if want and want[-1][1] == v:
                want[-1][2] += 1
            else:
                want.append([n, v, 1])
        assert [(r["start"], r["value"], r["n"]) for r in sorted((r for r in runs if r["k"] == k), key=lambda r: r["run"])] == [tuple(w) for w in want]
    back = encodings.dec_rle(encodings.enc_rle(df, ["k"], "n", "v"), ["k"]).collect()
    assert all([r["value"] for r in sorted((r for r in back if r["k"] == k), key=lambda r: r["place"])] == [v for _, _, v, _ in own] for k, own in by_key.items())
    delta = encodings.enc_delta(df, ["k"], "n", "x")
    for r in delta.collect():
        last = [x for _, n, _, x in by_key[r["k"]] if n < r["n"] and x is not None]
        assert r["delta"] == (None if r["x"] is None else r["x"] - (last[-1] if last else 0))
    assert {(r["k"], r["n"]): r["value"] for r in encodings.dec_delta(delta.drop("x"), ["k"], "n").collect()} == {(k, n): x for k, n, _, x in rows}
    got = {(r["k"], r["n"]): r["place"] for r in prefix.numbered(df, ["k"], "n", "place").collect()}
    assert got == {(k, r[1]): i + 1 for k, own in by_key.items() for i, r in enumerate(own)}


def test_rows_of_hot_keys_are_looked_up(spark):
    rows = spark.createDataFrame([("hot" if k % 3 else f"c{k}", k) for k in range(3000)], "k string, n long")
    per = rows.groupBy("k").agg(F.count(F.lit(1)).alias("many"), F.min("n").alias("least")).withColumnRenamed("many", "n_of")
    got = prefix.looked_up(rows, per, ["k"], 3000, "n_of")
    assert got.count() == 3000 and got.filter("k = 'hot'").select("least").distinct().collect()[0][0] == 1
    assert got.filter("k <> 'hot' and least <> n").count() == 0


def test_edits_of_many_documents_are_those_of_sessions(spark):
    from mergeloom.operators import edits
    from mergeloom.plans.session import Document

    rnd = random.Random(23)
    kinds = ["set", "del", "inc"]
    docs, wanted, rows = {}, {}, []
    for k in range(12):
        a, b = Document("aa"), Document("bb")
        with a.change(seconds=0) as root:
            root["n"], root["s"], root["c"], root["gone"] = k, "x", a.counter(k), 1
        b.merge(a)
        for doc, v in ((a, 1), (b, 2)):
            with doc.change(seconds=0) as root:
                root["n"] = v + rnd.randint(0, 1)
                root["c"].increment(v)
                if k % 3 == 0:
                    root["both"] = doc.counter(v)
        a.merge(b)
        docs[str(k)] = a
        edited = Document("cc").merge(a)
        with edited.change(seconds=0) as root:
            for at, key in enumerate(["n", "s", "c", "gone", "new", "nothing"]):
                action = {"c": "inc", "gone": "del", "nothing": "del", "new": "set"}.get(key) or rnd.choice(["set", "del"])
                value = rnd.choice(["x", "y"]) if key == "s" else 7
                field = ("s", "str") if isinstance(value, str) else ("i", "int")
                rows.append((str(k), at, "_root", key, action, field[1] if action == "set" else None, value if field[0] == "i" and action != "del" else None, None, value if field[0] == "s" and action == "set" else None, None))
                if action == "inc":
                    root[key].increment(value)
                elif action == "set":
                    root[key] = value
                elif key in root.keys():
                    del root[key]
        rows.append((str(k), 51, "_root", "missing", "inc", None, 1, None, None, None))
        wanted[str(k)] = [(op["id"].split("@")[0], op["key"], op["action"], op.get("value"), op["pred"]) for op in list(edited.changes.values())[-1]["ops"]]
    assert set(kinds) == {r[4] for r in rows}
    ops = _session_ops(spark, docs["0"]).limit(0)
    for k, doc in docs.items():
        ops = ops.unionByName(_session_ops(spark, doc).withColumn("doc_id", F.lit(k)))
    made = spark.createDataFrame(rows, "doc_id string, at long, obj string, key string, action string, vtype string, i long, d double, s string, b boolean")
    got = {}
    for r in edits.edit_maps(ops, made, "cc").orderBy("doc_id", "ctr").collect():
        value = r["s"] if r["s"] is not None else r["i"]
        got.setdefault(r["doc_id"], []).append((str(r["ctr"]), r["key"], r["action"], None if r["action"] == "del" else value, [f"{p['ctr']}@{p['actor']}" for p in r["pred"]]))
    assert got == wanted
    assert edits.refused(ops, made).count() == 12 and edits.edit_maps(ops, made.limit(0), "cc").count() == 0
