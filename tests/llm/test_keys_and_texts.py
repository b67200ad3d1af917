"""Small cases of the problems on keys and texts, against brute force where there is one."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergeloom.llm import mixing, packing, ribbon, stuffing, tokens
from mergeloom.storage import Workspace

HAVE = "have_id long, message_id long, doc_id string, peer string, hash string, key string, gen int"
OFFERS = "offer_id long, doc_id string, peer string, n_bytes long, hash string, key string, gen int, a long"


def hashes(n, seed):
    rnd = random.Random(seed)
    return [f"{rnd.getrandbits(256):064x}" for _ in range(n)]


def test_ribbon_filter_answers():
    rng = np.random.default_rng(1)
    for n in (1, 2, 500, 20_000):
        a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
        seed, lanes, slots, solution = ribbon.build(a, b)
        assert ribbon.probe(solution, seed, lanes, slots, a, b).all()
        assert len(solution) == 3 * lanes * slots
    assert lanes > 1 and 8 * len(solution) / n < 32
    x, y = (rng.integers(0, 2**63, 40_000, dtype=np.uint64) for _ in range(2))
    assert ribbon.probe(solution, seed, lanes, slots, x, y).sum() <= 1


def test_rate_of_wrong_answers_follows_the_fingerprint(monkeypatch):
    """With few bits the rate can be measured: it is what the equations promise."""
    monkeypatch.setattr(ribbon, "FINGERPRINT", 8)
    monkeypatch.setattr(ribbon, "_BYTES", 1)
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 2**63, 9_000, dtype=np.uint64) for _ in range(2))
    f = ribbon.build(a, b)
    assert ribbon.probe(f[3], *f[:3], a, b).all()
    x, y = (rng.integers(0, 2**63, 100_000, dtype=np.uint64) for _ in range(2))
    assert 0.8 / 256 < ribbon.probe(f[3], *f[:3], x, y).mean() < 1.2 / 256


def test_ribbon_repeated_equation_is_solved():
    a = np.array([5, 5, 9], np.uint64)
    b = np.array([7, 7, 1], np.uint64)
    seed, lanes, slots, solution = ribbon.build(a, b)
    assert ribbon.probe(solution, seed, lanes, slots, a, b).all()


def test_a_batch_is_sealed_beside_the_others(spark, tmp_path):
    from pathlib import Path

    work = Workspace(spark, "sealed")
    sealed = ribbon.Sealed(work, 3)
    keys = lambda gen, ks: spark.createDataFrame([("have", gen, bytes.fromhex(k)) for k in ks], "origin string, gen int, key binary")
    first, second = hashes(200, 11), hashes(150, 12)
    sealed.seal(keys(0, first))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in Path(work.path("filters").removeprefix("file://")).rglob("*.parquet")}
    before = files()
    asked = spark.createDataFrame([(bytes.fromhex(k), 9, False) for k in [*first, *second, *hashes(50, 13)]], "key binary, gen int, absent boolean")
    assert {bytes(r["key"]).hex() for r in sealed.ask(asked).collect()} == set(first)
    sealed.seal(keys(1, second))
    assert before.items() <= files().items() and len(files()) > len(before)
    assert {(bytes(r["key"]).hex(), r["seen_gen"]) for r in sealed.ask(asked, every=True).collect()} == {*((k, 0) for k in first), *((k, 1) for k in second)}


def seen(spark, have, offers, **kw):
    h = spark.createDataFrame([(i, m, "d", "p", x, "z", 1) for i, (m, x) in enumerate(have)], HAVE)
    o = spark.createDataFrame([(i, "d", None, None, x, "z", 1, 2) for i, x in offers], OFFERS)
    return ribbon.SeenBefore(h, o, **kw)


def test_seen_before_against_a_set(spark):
    pool = hashes(400, 2)
    rnd = random.Random(4)
    dirty = lambda x: rnd.choice([x, x.upper(), "0x" + x, "sha256:" + x, f" {x}\n"])
    have = [(rnd.randint(0, 50), dirty(rnd.choice(pool[:200]))) for _ in range(500)] + [(3, None), (None, pool[0]), (4, "unknown")]
    offers = [(i, dirty(rnd.choice(pool[100:]))) for i in range(600)] + [(900, None), (901, ""), (902, pool[5][:40]), (903, pool[5] + "0"), (904, "unknown")]
    s = seen(spark, have, offers, shard_keys=20)
    known = {c for _, h in have if (c := clean(h))}
    want = []
    for i, h in offers:
        c = clean(h)
        if c and c in known:
            want.append(i)
        known.add(c)
    assert sorted(r[0] for r in s.seen().collect()) == want
    audit = s.audit().collect()
    assert sum(r["n_missed"] for r in audit) == 0
    asked = sum(r["n_asked"] for r in audit)
    assert asked > 2000 and sum(r["n_false"] for r in audit) == 0 and sum(r["n_wrong"] for r in audit) == 0
    assert len({r["gen"] for r in audit}) == ribbon.GENERATIONS and sum(r["n_true"] for r in audit) > 300


def clean(h):
    c = "".join((h or "").lower().split()).split(":")[-1].removeprefix("0x")
    return c if len(c) == 64 and set(c) <= set("0123456789abcdef") else None


def test_seen_before_empty_and_one_hot_key(spark):
    hot = hashes(1, 9)[0]
    assert seen(spark, [], []).seen().count() == 0
    assert sorted(r[0] for r in seen(spark, [], [(i, hot) for i in range(300)]).seen().collect()) == list(range(1, 300))
    assert seen(spark, [(1, hot)] * 200, [(0, hot), (1, None)]).seen().count() == 1
    few = seen(spark, [(i, k) for i, k in enumerate(hashes(900, 19))], [(0, hot)], shard_keys=10)  # most shards have nothing to answer
    assert few.seen().count() == 0 and sum(r["n_asked"] for r in few.audit().collect()) == 8


def test_batches_of_ids_of_any_size(spark):
    ks = hashes(160, 21)
    for base in (0, 10**9, 2**62, -(2**62)):
        s = seen(spark, [(base + i, k) for i, k in enumerate(ks[:80])], [(base + i, k) for i, k in enumerate(ks[40:] + ks[150:])])
        assert {r["gen"] for r in s.have.select("gen").distinct().collect()} == ({0} if abs(base) == 2**62 else set(range(8)))  # doubles tell such ids apart no more
        assert sorted(r[0] - base for r in s.seen().collect()) == [*range(40), *range(120, 130)]


def test_plan_uses_every_item_once():
    rnd = random.Random(5)
    for capacity in (7, 40, 256):
        histogram = Counter(min(capacity, max(1, int(rnd.lognormvariate(3, 1)))) for _ in range(2000))
        steps = packing.plan(dict(histogram), capacity)
        used = Counter()
        for lengths, n in steps:
            assert sum(lengths) <= capacity and n > 0
            for x in lengths:
                used[x] += n
        assert used == histogram
        least = -(-sum(k * v for k, v in histogram.items()) // capacity)
        alone = sum(v for k, v in histogram.items() if 2 * k > capacity)  # no two of these go together
        assert sum(n for _, n in steps) <= 1.02 * max(least, alone) + 2


def test_exact_complements_are_found():
    assert packing.plan({5: 3, 3: 3}, 8) == [((5, 3), 3)]
    assert packing.plan({6: 1, 2: 1, 1: 1, 3: 1}, 9) in ([((6, 3), 1), ((2, 1), 1)],)
    assert packing.plan({11: 2, 4: 2, 3: 2, 2: 2}, 20) == [((11, 4, 3, 2), 2)]
    assert packing.plan({}, 8) == []


def test_packing_of_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 40)  # the hot length is numbered by several tasks
    rnd = random.Random(6)
    sizes = [(i, rnd.choice([5, 5, 5, rnd.randint(1, 60)])) for i in range(300)] + [(1, 130), (1, 130), (400, 0), (401, None)]
    df = spark.createDataFrame([(i, n, 9, 9) for i, n in sizes], "doc_id long, n_tokens long, capacity_id int, number long")
    caps = spark.createDataFrame([(1, 16), (2, 64), (3, None), (4, 0)], "capacity_id int, capacity_tokens int")
    packed = packing.pack(df, caps).collect()
    for cap_id, cap in ((1, 16), (2, 64)):
        room, parts = defaultdict(int), defaultdict(list)
        for r in packed:
            if r["capacity_id"] == cap_id:
                room[r["container_id"]] += r["n_tokens"]
                parts[r["doc_id"]].append(r["n_tokens"])
        assert max(room.values()) <= cap and sorted(room) == list(range(len(room)))
        total = Counter()
        for i, n in sizes:
            total[i] += n or 0
        assert {i: sum(p) for i, p in parts.items()} == {i: n for i, n in total.items() if n}
        for i, n in sizes:
            if n and n <= cap and i != 1:
                assert parts[i] == [n]  # whole
    assert {r["capacity_id"] for r in packed} == {1, 2}
    report = {r["capacity_id"]: r for r in packing.fill_report(packing.pack(df, caps), caps).collect()}
    assert report[2]["used_share"] > 0.95 and report[2]["n_containers"] >= report[2]["least_containers"]
    assert packing.pack(df.limit(0), caps).count() == 0 and packing.pack(df, caps.limit(0)).count() == 0


def test_containers_do_not_depend_on_how_items_are_counted(spark, monkeypatch):
    rnd = random.Random(16)
    df = spark.createDataFrame([(i, rnd.choice([5, 5, rnd.randint(1, 60)])) for i in range(400)], "doc_id long, n_tokens long")
    caps = spark.createDataFrame([(1, 64)], "capacity_id int, capacity_tokens int")
    got = []
    for rows in (10, 100_000):
        monkeypatch.setattr(packing, "BUCKET_ROWS", rows)
        packed = packing.pack(df, caps)
        got.append(sorted(map(tuple, packed.collect())))
        assert [tuple(r) for r in packing.broken(packed, df, caps).collect()] == [(1, 400, 0, 0, 0)]
    assert got[0] == got[1]
    short = packing.pack(df.filter("doc_id > 3"), caps)
    assert packing.broken(short, df, caps).first()["lost_or_doubled"] == 4


def test_complements_against_all_combinations():
    rnd = random.Random(17)
    for _ in range(300):
        left = np.zeros(31, np.int64)
        for x in rnd.sample(range(1, 31), rnd.randint(1, 8)):
            left[x] = rnd.randint(1, 3)
        look = packing._Complements(left)
        items = [x for x in range(31) for _ in range(left[x])]
        for gap in range(1, 31):
            got = look.find(gap)
            able = any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(items, k))
            assert bool(got) == able and (not got or sum(got) == gap and all(Counter(got)[x] <= left[x] for x in got))


def mixture(spark, docs, targets, **kw):
    df = spark.createDataFrame([(i, s, n, 1, 1) for i, s, n in docs], "doc_id long, source string, n_tokens long, place long, pass_no int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m = mixing.mix(df, t, **kw)
    return m.orderBy("place").collect(), {r["source"]: r for r in mixing.shares(m, t).collect()}


def test_mixing_reaches_shares_and_caps_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)
    rnd = random.Random(7)
    docs = [(i, rnd.choice(["big", "Big ", "BIG"]), rnd.randint(1, 40)) for i in range(600)] + [(1000 + i, "small", rnd.randint(1, 40)) for i in range(50)]
    docs += [(2000, None, 5), (2001, "other", 5), (2002, "big", 0), (2003, "big", None)]
    rows, shares = mixture(spark, docs, [("big", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 2)])
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1))
    assert all(x["finish"] <= y["finish"] for x, y in zip(rows, rows[1:], strict=False))
    assert shares["big"]["actual_share"] == pytest.approx(2 / 3, abs=0.02) and shares["small"]["actual_share"] == pytest.approx(1 / 3, abs=0.02) and shares["absent"]["actual_share"] == 0
    assert shares["big"]["most_used"] == 1 and shares["small"]["most_used"] <= 4
    again, _ = mixture(spark, docs[::-1], [("big", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 2)])
    assert again == rows  # the order of the input does not matter
    # At half of the mixture the shares hold as well.
    half = Counter()
    for r in rows[: len(rows) // 2]:
        half[r["source"]] += r["n_tokens"]
    assert half["big"] / sum(half.values()) == pytest.approx(2 / 3, abs=0.05)


def test_what_is_broken_in_a_mixture_is_found(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", 10) for i in range(300)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs, targets)
    assert sorted(map(tuple, mixing.broken(m, docs, targets).collect())) == [("a", 200, 0, 0, False), ("b", 100, 0, 0, False)]
    one = m.filter("doc_id = 1")
    wrong = m.filter("source = 'a' or place % 3 > 0").unionByName(one).unionByName(one).unionByName(one).unionByName(m.limit(1).withColumn("doc_id", F.lit(999).cast("long")))
    found = {r["source"]: r for r in mixing.broken(wrong, docs, targets).collect()}
    assert found["a"]["over_used"] == 1 and found["b"]["over_used"] == 0
    assert found["a"]["strange"] + found["b"]["strange"] == 1 and found["b"]["share_off"]


def test_order_of_a_mixture_does_not_depend_on_buckets(spark, monkeypatch):
    rnd = random.Random(18)
    docs = [(i, rnd.choice(["a", "b"]), rnd.randint(1, 40)) for i in range(500)]
    got = []
    for rows in (7, 100_000):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
        got.append([(r["place"], r["doc_id"], r["pass_no"]) for r in mixture(spark, docs, [("a", 0.7, 2), ("b", 0.3, 1)])[0]])
    assert got[0] == got[1] and len(got[0]) > 500


def test_mixing_beyond_what_a_source_has(spark):
    docs = [(i, "a", 10) for i in range(100)] + [(500 + i, "b", 10) for i in range(10)]
    rows, shares = mixture(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)], budget=1000)
    assert shares["b"]["n_tokens"] == 200 and shares["b"]["most_used"] == 2 and shares["a"]["n_tokens"] == 500
    assert sum(r["n_tokens"] for r in rows) <= 1000
    assert mixture(spark, [], [("a", 1.0, 1)])[0] == []


SPEECH = ["Where did you put the letter?", "I was at the station before you came.", "No, it is not what they said to us.", "Come with me, she will be there.", "We have to go now, or he will see you.", "You and I were there when it was cold."]
THINGS = ["solar panels", "wool socks", "desk fan", "yoga mat", "paint set"]


def cues(lines, sep="\n"):
    return sep.join(f"{k + 1}{sep}00:00:{k % 60:02d},100 --> 00:00:{k % 60:02d},900{sep}{x}{sep}" for k, x in enumerate(lines))


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    good, bad = [], []
    for _ in range(n):
        good.append(cues([rnd.choice(SPEECH) for _ in range(rnd.randint(5, 15))]))
        kind = rnd.randrange(4)
        if kind == 0:
            word = rnd.choice(THINGS)
            bad.append(cues([" ".join([word] * rnd.randint(4, 9)) for _ in range(6)]))
        elif kind == 1:
            bad.append(cues([", ".join(rnd.choice(THINGS) for _ in range(8)) for _ in range(6)]))
        elif kind == 2:
            bad.append(cues([f"http://site{rnd.randint(1, 999)}.example/p {rnd.choice(THINGS)}" for _ in range(8)], "\r\n"))
        else:
            bad.append(cues([" ".join("#" + rnd.choice(THINGS).replace(" ", "") for _ in range(6)) for _ in range(6)]))
    return good, bad


def judged(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, 0.5, True) for i, t in enumerate(texts)], "doc_id long, text string, spam_share double, spam boolean")
    got = stuffing.stuffed(df, **kw).collect()
    assert len(got) == len(texts)
    return [r["spam"] for r in sorted(got, key=lambda r: r["doc_id"])]


def test_stuffed_texts(spark):
    good, bad = corpus()
    rnd = random.Random(8)
    adverts = cues([*SPEECH, "Come and see what we have for you at http://shop.example", *SPEECH])
    song = cues(["♪ la la la ♪"] * 20)
    sounds = cues(["[door opens]", "(sighs)"] * 10)
    mostly = cues([rnd.choice(SPEECH), *[" ".join([THINGS[0]] * 8)] * 4])
    little = cues([*[rnd.choice(SPEECH) for _ in range(10)], " ".join([THINGS[0]] * 4)])
    extra = [adverts, song, sounds, "", None, "12\n", mostly, little, cues(SPEECH * 2000)]
    got = judged(spark, [*good, *bad, *extra])
    n = len(good)
    assert sum(got[:n]) == 0 and sum(got[n : 2 * n]) >= 0.97 * n
    assert got[2 * n :] == [False, False, False, False, False, False, True, False, False]


def test_stuffed_texts_without_both_kinds(spark):
    good, bad = corpus(2, 12)
    assert sum(judged(spark, good)) == 0
    assert sum(judged(spark, bad)) >= 9
    assert judged(spark, [None, ""]) == [False, False]
    assert stuffing.stuffed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_few_stuffed_texts_among_many(spark):
    good, bad = corpus(3, 60)
    rnd = random.Random(4)
    rare = [cues([f"Where did {rnd.choice('abcdefgh')}{k}x go with the {w}?" for k in range(6)]) for w in ("map", "boat", "lamp", "key", "coat", "horse", "mill")]
    got = judged(spark, [*good, *rare, *bad[:2]])
    assert sum(got[:-2]) == 0 and sum(got[-2:]) == 2


def share(text, words=stuffing._FUNCTION):
    return stuffing.share_of(stuffing.Words(frozenset(words)), *stuffing.Reader().read(text))


def test_stuffed_text_of_terms_that_no_text_taught():
    assert share(cues([" ".join(["qorvex plimt"] * 6) for _ in range(8)])) == 1.0
    assert share(cues(["♪ qorvex plimt ♪"] * 20)) == 0  # sounds and songs are none, known or not
    assert share(cues(SPEECH * 3)) == 0
    assert share(cues(["[door creaks] [steps] [door creaks] (wind)"] * 9)) == 0


PROSE = {
    "Russian": "Вчера вечером я долго не мог уснуть. За окном шумел дождь, и ветер качал старые деревья. Потом кто-то тихо постучал в дверь. Я встал, зажёг лампу и спросил, кто там. Никто не ответил, но на пороге лежало письмо без подписи. Утром мы решили отвезти его в город и показать знакомому учителю.",
    "Finnish": "Eilen illalla minä en saanut millään unta. Ikkunan takana satoi, ja tuuli heilutti vanhoja puita. Sitten joku koputti hiljaa oveen. Nousin ylös, sytytin lampun ja kysyin, kuka siellä oli. Kukaan ei vastannut, mutta kynnyksellä oli kirje ilman nimeä. Aamulla päätimme viedä sen kaupunkiin ja näyttää sitä tutulle opettajalle.",
    "Greek": "Χθες το βράδυ δεν μπορούσα να κοιμηθώ. Έξω έβρεχε και ο αέρας κουνούσε τα παλιά δέντρα. Μετά κάποιος χτύπησε σιγά την πόρτα. Σηκώθηκα, άναψα τη λάμπα και ρώτησα ποιος είναι. Κανείς δεν απάντησε, αλλά στο κατώφλι υπήρχε ένα γράμμα χωρίς υπογραφή.",
    "Japanese": "昨日の夜はなかなか眠れませんでした。窓の外では雨が降り、風が古い木を揺らしていました。それから誰かが静かに戸をたたきました。私は起きて明かりをつけ、誰ですかと聞きました。誰も答えませんでしたが、玄関に名前のない手紙がありました。",
}


@pytest.mark.parametrize("language", PROSE)
def test_prose_of_other_languages_is_not_stuffed(language):
    text = PROSE[language]
    for lines in ([text], text.replace("。", "。 ").split(". "), text.replace("。", "。\n").split("\n")):
        assert share(cues(lines)) < 0.3
    if language != "Japanese":
        word = text.split()[4].strip(",.")
        assert share(cues([" ".join([word, "qorvex"] * 9)] * 5)) == 1.0  # regular repetition is found in any


def test_function_words_are_learned_from_all_texts(spark):
    """Of a language that the list does not know; keywords of stuffed texts are none, however many."""
    rnd = random.Random(12)
    small, large = [f"{a}{b}" for a in "bnswr" for b in ("el", "ir", "ota", "ha", "em", "uv")], [f"{a}{b}{c}" for a in "kvltmr" for b in ("ando", "ilqu", "osta", "urve", "enzi", "arpo") for c in ("k", "s", "x", "nt", "ly", "gge")]
    speech = [cues([" ".join(x for _ in range(3) for x in (rnd.choice(small), rnd.choice(large), rnd.choice(large))) for _ in range(12)]) for _ in range(400)]
    spam = [cues([", ".join(rnd.choice(THINGS) for _ in range(8)) for _ in range(6)]) for _ in range(300)]
    rows = [(i, t, "xx" if i < 400 else "en") for i, t in enumerate([*speech, *spam])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    work = Workspace(spark, "lessons")
    words = stuffing.learned(stuffing.read_texts(df, ["doc_id"], F.col("lang"), work)[1], work)
    assert {stuffing._fold(w) for w in small} - stuffing._FUNCTION <= words and not words & {"wool", "socks", "desk", "mat"}
    got = {r["doc_id"]: r["spam"] for r in stuffing.stuffed(df, language="lang").collect()}
    assert [i for i, x in sorted(got.items()) if x] == list(range(400, 700))


def test_layout_does_not_count():
    text = "﻿WEBVTT\n\n1\n00:01.000 --> 00:02.000\n<i>Hello there</i>\n{12}{40}Who is it?|{\\an8}It is me.\n"
    assert list(stuffing.shown_lines(text)) == ["Hello there", "Who is it?|It is me."]
    assert stuffing.repaired("d&amp;#39;accord Ã©tÃ©") == "d'accord été"


def test_regular_repetition_and_lists_are_told_from_speech():
    again = lambda text: stuffing.recurrent(stuffing.terms(text)).mean()
    assert again(" ".join(["wool socks"] * 60)) == 1 and again("never one term twice in all this") == 0
    even = [x for k in range(30) for x in ("oak", *(f"w{k}x{j}".replace("0", "o") for j in range(39)))]
    assert stuffing.recurrent(even).sum() == 30  # one term at gaps of 40, beyond the lags but even
    rnd = random.Random(9)
    uneven = [x for k in range(30) for x in ("oak", *(f"w{k}x{j}" for j in range(rnd.choice([13, 20, 31, 50, 80, 130, 210]))))]
    assert stuffing.recurrent(uneven).sum() == 0
    assert share(" ".join(SPEECH * 6)) == 0 and share("") == 0
    assert share(cues([", ".join(f"{w} {k}" for k, w in enumerate(["sofa", "lamp", "tent", "boots", "tea", "watch", "tyres", "drops", "case"]))])) == 1  # nouns, each once
    assert share(cues(["Sofa", "Lamp", "Tent", "Watch", "Phone case", "Tea", "Boots", "Drops"])) == 1
    assert share(cues(['<a href="http://shop.example/x">sofa</a>', "[url=http://shop.example/y]lamp[/url]", "[tent](http://a.example/z)"])) == 1


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello there, you"), (2, ""), (3, None), (4, "a b " * 30_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.with_tokens(df, ["doc_id"]).collect()}
    assert got[2] == got[3] == 0 and got[1] == tokens.count_tokens("Hello there, you") > 2 and got[4] > 50_000
