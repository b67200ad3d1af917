"""Small cases of the general problems: nulls, ties, repeats, loops, empty tables, extra columns."""

import datetime as dt
import random

from pyspark.sql import functions as F

from mergeloom import problems
from mergeloom.operators import changes_applied, hierarchy, redelivery, references

H = {c: c * 64 for c in "abcdef"}
FEED = "delivery_id long, received_at timestamp_ntz, doc_id string, actor string, seq long, start_op long, n_ops long, time_s long, message string, deps array<string>, hash string, ident string, bucket int"
OPS = "row_id long, arrived_at timestamp_ntz, doc_id string, change_hash string, ctr long, actor string, action string, obj struct<ctr:long,actor:string>, key string, elem struct<ctr:long,actor:string>, is_insert boolean, val struct<vtype:string,b:boolean,i:long,d:double,s:string>, pred array<struct<ctr:long,actor:string>>, op string, cell string, nid long"


def at(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def feed(spark, rows):
    """(delivery_id, day, doc, actor, seq, deps, hash); columns with the names the operators use inside are there as well."""
    return spark.createDataFrame([(i, at(t), d, a, s, 1, 1, None, None, deps, h, "x", 5) for i, t, d, a, s, deps, h in rows], FEED)


def ops(spark, rows):
    """(ctr, actor, action, obj, key, pred), optionally vtype; one document unless a row says otherwise."""
    out = []
    for k, r in enumerate(rows):
        ctr, actor, action, obj, key, pred, *more = r
        vtype = more[0] if more else "str"
        out.append((k, at(k), more[1] if len(more) > 1 else "d", H["a"], ctr, actor, action, obj, key, None, False, (vtype, None, 1, None, "v"), pred, "x", "y", 3))
    return spark.createDataFrame(out, OPS)


def gone(df):
    return sorted(r[0] for r in redelivery.repeats(df).select("delivery_id").collect())


def test_redelivery_by_hash_number_and_time(spark):
    rows = [
        (1, 3, "d", "aa", 1, None, H["a"]),
        (2, 1, "d", "AA", 1, [], "0x" + H["a"].upper()),  # the same hash, earlier: kept
        (3, 5, "d", "a a", 1, None, ""),  # no hash: carries the one of its number
        (4, 2, "d", "bb", 1, None, None),
        (5, 2, "d", "bb", 1, None, "none"),  # no hash in any: equal in document, actor and number; a tie in time
        (6, 9, "e", "bb", 1, None, None),
        (7, None, "d", "cc", 2, None, "sha256:" + H["b"] + "\n"),
        (8, 7, "d", "cc", 2, None, " " + H["b"]),  # null times come last
        (9, 1, "d", "dd", None, None, None),
        (10, 1, "d", "dd", None, None, None),  # null numbers are equal
        (None, 4, "d", "aa", 1, None, H["a"]),  # cannot be named
    ]
    assert gone(feed(spark, rows)) == [1, 3, 5, 7, 10]
    kept = {r["delivery_id"] for r in redelivery.deduplicated(feed(spark, rows)).collect()}
    assert {2, 4, 6, 8, 9} <= kept and not kept & {1, 3, 5, 7, 10}


def test_redelivery_empty_and_one_hot_change(spark):
    assert gone(feed(spark, [])) == []
    hot = [(i, i % 400, "d", "aa", 1, None, H["c"]) for i in range(900)] + [(900 + i, i, "d", "aa", 2 + i, None, f"{i:064x}") for i in range(300)]
    assert gone(feed(spark, hot)) == list(range(1, 900))


def test_redelivery_shards_and_filters_beyond_the_limit(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(40), "d", "aa", i, None, f"{rnd.randrange(500):064x}" if i % 7 else None) for i in range(1200)]
    df = feed(spark, rows)
    first = {}
    for i, t, _, _, s, _, h in rows:
        k = h or s
        first[k] = min(first.get(k, (t, i)), (t, i))
    want = sorted(i for i, t, _, _, s, _, h in rows if first[h or s] != (t, i))
    for kw in ({}, {"shard_keys": 90}, {"filter_mb": 0}, {"shard_keys": 90, "filter_mb": 0}):
        assert sorted(r[0] for r in redelivery.repeats(df, **kw).select("delivery_id").collect()) == want
        assert redelivery.deduplicated(df, **kw).count() == len(first)


def test_deduplicated_rows_without_or_with_the_same_id(spark):
    rows = [(None, 1, "d", "aa", 1, None, H["a"]), (None, 2, "d", "aa", 1, None, H["a"]), (5, 3, "d", "bb", 1, None, H["b"]), (5, 3, "d", "bb", 1, None, H["b"])]
    got = redelivery.deduplicated(feed(spark, rows))
    assert got.columns == feed(spark, rows).columns
    assert sorted((r["hash"], r["received_at"]) for r in got.collect()) == [(H["a"], at(1)), (H["b"], at(3))]
    assert redelivery.deduplicated(feed(spark, [])).count() == 0


def test_screen_passes_what_is_new(spark):
    rows = [(i, i % 300, "d", "aa", i, None, f"{i:064x}") for i in range(3000)] + [(5000 + i, 310, "d", "aa", i, None, f"{i:064x}") for i in range(50)]
    asked = redelivery.Screen(feed(spark, rows), redelivery.Workspace(spark, "screen")).rows_asked()
    n = asked.filter("maybe").count()
    assert 100 <= n < 130  # both deliveries of 50 changes, and few more


def values(spark, rows, **kw):
    return {(r["obj"], r["key"]): r["op_id"] for r in changes_applied.present_values(ops(spark, rows), **kw).collect()}


def test_present_values(spark):
    rows = [
        (1, "aa", "set", None, "x", None),
        (2, "aa", "set", None, "x", [(1, "AA")]),
        (2, "bb", "set", None, "x", [(1, "aa"), (1, "aa")]),  # concurrent: the greater actor wins
        (1, "aa", "set", None, "x", []),  # repeated row
        (3, "aa", "set", None, "y", None),
        (4, "aa", "del", None, "y", [(3, "aa")]),  # tombstone
        (5, "aa", "set", (1, "Cc"), "y", None),
        (6, "aa", "set", None, "n", None, "counter"),
        (7, "aa", "inc", None, "n", [(6, "aa")]),  # does not hide a counter
        (8, "aa", "set", None, "m", None),
        (9, "aa", "inc", None, "m", [(8, "aa")]),  # hides anything else
        (10, "aa", "set", None, "z", [(11, "aa")]),
        (11, "aa", "set", None, "z", None),  # hidden by an older operation
        (12, "aa", "set", None, None, None),
        (13, "aa", "set", None, "w", None),
        (14, "aa", "set", (1, "cc"), "w", [(13, "aa")]),  # names one of another object
        (None, "aa", "set", None, "q", None),
        (15, None, "set", None, "q", None),
        (16, "aa", None, None, "q", None),
    ]
    want = {("_root", "x"): "2@bb", ("1@cc", "y"): "5@aa", ("_root", "n"): "6@aa", ("_root", "z"): "10@aa", ("_root", "w"): "13@aa", ("1@cc", "w"): "14@aa"}
    assert values(spark, rows) == want
    assert values(spark, rows[::-1], shares=(0.1, 0.3, 0.6, 0.9)) == want
    assert values(spark, rows, shares=()) == want
    assert values(spark, []) == {}


def test_present_values_of_one_hot_key_and_null_documents(spark):
    hot = [(k, "aa", "set", None, "hot", [(k - 1, "aa")] if k > 1 else None) for k in range(1, 1500)]
    counter = [(2000, "bb", "set", None, "n", None, "counter")] + [(2001 + k, "bb", "inc", None, "n", [(2000, "bb")]) for k in range(700)]
    cold = [(3000 + k, "cc", "set", None, f"c{k}", None) for k in range(50)]
    got = values(spark, [*hot, *counter, *cold])
    assert got == {("_root", "hot"): "1499@aa", ("_root", "n"): "2000@bb"} | {("_root", f"c{k}"): f"{3000 + k}@cc" for k in range(50)}
    rows = [(1, "aa", "set", None, "x", None, "str", None), (2, "aa", "set", None, "x", [(1, "aa")], "str", None), (1, "bb", "set", None, "x", None, "str", ""), (3, "aa", "set", None, "x", None)]
    found = changes_applied.present_values(ops(spark, rows)).collect()
    assert {(r["doc_id"], r["op_id"]) for r in found} == {(None, "2@aa"), ("", "1@bb"), ("d", "3@aa")}


def brute_tree(edges):
    """edges: id -> (parent or None, label)."""
    out = {}
    for v in edges:
        seen, path, u = [v], [edges[v][1] or v], edges[v][0]
        while u in edges and u not in seen:
            seen.append(u)
            path.append(edges[u][1] or u)
            u = edges[u][0]
        out[v] = ("", -1, "") if u in seen else (seen[-1], len(seen), "/".join(reversed(path)))
    return out


def forest(n, seed):
    rnd = random.Random(seed)
    edges = {f"{i}@aa": (f"{rnd.randint(max(1, i - 9), i - 1)}@aa" if i > 1 and rnd.random() < 0.9 else None, rnd.choice(["k", "l", None])) for i in range(1, n)}
    edges["5@aa"] = ("9@aa", "p")
    edges["9@aa"] = ("12@aa", "q")
    edges["12@aa"] = ("5@aa", "r")  # a loop with trees below it
    edges["20@aa"] = ("20@aa", None)  # its own container
    edges["21@aa"] = ("999999@aa", "s")  # container not in the document
    return edges


def tree(spark, edges, **kw):
    rows = [(int(v.split("@")[0]), "AA", "makeMap", p and (int(p.split("@")[0]), "aA"), k, None) for v, (p, k) in edges.items()]
    got = hierarchy.tree_of_objects(ops(spark, rows + rows[:7]), **kw).collect()
    assert len(got) == len(edges)
    return got


def test_hierarchy_against_walking_up(spark):
    edges = forest(120, 1)
    want = brute_tree(edges)
    below = {v: sum(w != v and want[w][1] > 0 and v in chain(edges, w) for w in edges) for v in edges}
    for limit in (250_000, 11, 3):
        got = tree(spark, edges, block_nodes=limit)
        assert {r["object_id"]: (r["root_id"], r["tree_depth"], r["key_path"]) for r in got} == want
        assert all(r["n_descendants"] == (below[r["object_id"]] if r["tree_depth"] > 0 else -1) for r in got)


def chain(edges, v):
    out = []
    while v in edges and v not in out:
        out.append(v)
        v = edges[v][0]
    return out


def test_hierarchy_deep_wide_and_empty(spark):
    deep = {f"{i}@aa": (f"{i - 1}@aa" if i > 1 else None, "k") for i in range(1, 401)}
    got = {r["object_id"]: r["tree_depth"] for r in tree(spark, deep, block_nodes=50)}
    assert got == {f"{i}@aa": i for i in range(1, 401)}
    wide = {"1@aa": (None, "k")} | {f"{i}@aa": ("1@aa", "k") for i in range(2, 300)}
    assert {r["tree_depth"] for r in tree(spark, wide, block_nodes=40)} == {1, 2}
    assert hierarchy.tree_of_objects(ops(spark, [])).count() == 0


def test_descendants_by_interval(spark):
    edges = {"1@aa": (None, "a"), "2@aa": ("1@aa", "b"), "3@aa": ("2@aa", "c"), "4@aa": ("1@aa", "d")}
    rows = [(int(v[0]), "aa", "makeList", p and (int(p[0]), "aa"), k, None) for v, (p, k) in edges.items()]
    t = hierarchy.tree_of_objects(ops(spark, rows))
    assert {r["object_id"] for r in hierarchy.descendants(t, "d", "1@aa").collect()} == {"2@aa", "3@aa", "4@aa"}
    assert {r["object_id"] for r in hierarchy.descendants(t, "d", "2@aa").collect()} == {"3@aa"}


def test_dangling_references(spark):
    f = feed(spark, [
        (1, 1, "d", "aa", 1, None, H["a"]),
        (2, 2, "d", "aa", 2, [H["a"].upper(), H["b"], None, " "], H["c"]),
        (3, 0, "d", "aa", 2, ["abc", "0x" + H["b"]], None),  # carries the change of delivery 2, and came first
        (4, 9, "d", "bb", 7, [H["f"]], ""),  # nothing names it: no case
        (5, 5, "e", "aa", 1, [H["a"]], H["d"]),  # the same hash, in another document
        (6, 8, "d", "cc", 1, [H["e"]], H["b"]),  # arrives after what refers to it
        (7, 8, "d", "cc", 2, [H["d"]], H["e"]),
    ])
    purged = spark.createDataFrame([(1, "d", H["a"].upper(), at(3)), (2, None, None, None)], "purge_id long, doc_id string, hash string, purged_at timestamp_ntz")
    got = {tuple(r) for r in references.dangling_deps(f, purged).select("seen_day", "doc_id", "src_key", "ref_key").collect()}
    assert got == {
        ("2025-01-01", "d", H["c"], H["a"]), ("2025-01-01", "d", H["c"], "abc"), ("2025-01-06", "e", H["d"], H["a"]), ("2025-01-09", "d", H["e"], H["d"]),
    }
    o = ops(spark, [
        (1, "aa", "set", None, "x", [(7, "aa"), (7, "AA"), (None, "aa")]),  # one reference to nothing
        (2, "aa", "set", None, "x", [(1, "aa")]),
        (3, "aa", "del", None, "x", [(2, "aa")]),
        (4, "aa", "set", None, "x", [(3, "aa")]),  # to a deletion
        (5, "aa", "set", None, "y", [(1, "aa")]),  # to another key
        (6, "aa", "set", None, None, [(8, "aa")]),
        (8, "aa", "set", None, None, None),  # null keys are equal; it comes later
    ])
    got = {tuple(r) for r in references.dangling_preds(o).select("src_key", "ref_key").collect()}
    assert got == {("1@aa", "7@aa"), ("4@aa", "3@aa"), ("5@aa", "1@aa")}
    everything = references.dangling(f, o, purged)
    assert everything.columns == references.COLUMNS and everything.count() == 7
    assert {r["n_refs"] for r in references.report(everything).filter(F.col("src_table") == "op_log").collect()} == {1}
    assert references.dangling(feed(spark, []), ops(spark, []), purged).count() == 0
    assert references.dangling_deps(f, purged.limit(0)).count() == 3


def test_descendants_are_read_from_the_tour(spark, tmp_path):
    edges = forest(60, 2)
    rows = [(int(v.split("@")[0]), "AA", "makeMap", p and (int(p.split("@")[0]), "aA"), k, None) for v, (p, k) in edges.items()]
    ops(spark, rows).write.parquet(f"{tmp_path}/op_log.parquet")
    got = {r["object_id"]: r for r in problems.QUERIES["p4_intervals"](spark, str(tmp_path)).collect()}
    placed = {v: r for v, r in got.items() if r["root_id"]}
    assert set(got) == set(edges) and len(placed) > 20
    for v, r in placed.items():
        below = {w for w, x in placed.items() if x["root_id"] == r["root_id"] and x["entry_rank"] < r["entry_rank"] and x["exit_rank"] > r["exit_rank"]}
        assert below == {w for w in placed if w != v and v in chain(edges, w)} and len(below) == r["n_descendants"]
