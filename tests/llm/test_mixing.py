import random
import time

from pyspark.sql import functions as F

from tidelog.llm import mixing as m


def test_shares():
    assert m.shares([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    t = m.shares([10, 1000, 0], [3, 1, 1])
    assert t == [30.0, 980.0, 0.0] and m.shares([], []) == []


def test_flow_spreads_copies_and_shares_overlaps():
    out = m.flow([(frozenset("a"), 100), (frozenset("ab"), 100), (frozenset("b"), 100)], {"a": 150, "b": 150})
    assert sum(out.values()) == 300
    by = [sum(v for (i, _), v in out.items() if i == p) for p in range(3)]
    assert by == [100, 100, 100]
    assert sum(m.flow([(frozenset("a"), 10)], {"a": 100}).values()) == 30


def brute(rows):
    import re

    size = [len(re.findall(m.WORD, t or "")) for _, t, _ in rows]
    totals = {}
    for s, (_, _, src) in zip(size, rows, strict=True):
        totals[src] = totals.get(src, 0) + s
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    return size, totals, dict(zip(order, m.shares([totals[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))


def test_report(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), ["a", "b", "c", "é", None][i % 5]) for i in range(2000)]
    rows += [(None, None, None), (1, "", "a"), (3, "x\ty\n", "big"), (3, "x\ty\n", "big")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, SIZE int").repartition(3)
    size, totals, targets = brute(rows)
    for bits in (m.LEVEL_BITS, 1):  # however many levels the descent takes, it ends at the same row
        monkeypatch.setattr(m, "LEVEL_BITS", bits)
        out = m.mix_report(docs).collect()
        assert len(out) == len(rows)
        taken: dict = {}
        for r in out:
            assert r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        assert sorted((r["size"], r["source_size"], round(r["target"], 6)) for r in out) == sorted((s, totals[x[2]], round(targets[x[2]], 6)) for s, x in zip(size, rows, strict=True))
        source = {x[0]: x[2] for x in rows[:2000] if x[0] not in (1, 3)}
        for r in out:
            if r["doc_id"] in source:
                taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
        for s in ("a", "b", "c", "é", None):
            assert abs(taken[s] - targets[s]) <= 110  # rows 1 and 3 are left out of this sum
        again = m.mix_report(docs.repartition(7)).collect()
        assert sorted(map(str, again)) == sorted(map(str, out))
    assert m.mix_report(docs.limit(0)).count() == 0


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "a b c d", ["x", "y"] if i % 2 else ["x"]) for i in range(100)], "doc_id long, text string, source array<string>")
    out = m.mix(docs, lambda totals: {"x": 200, "y": 200}).collect()
    assert sum(r["taken"] for r in out) == 400 and {r["copies"] for r in out} == {1}


def cheapest(patterns, quotas, repeats=3):
    """Most words, and the least cost of that many, by single cheapest augmenting paths of one word each."""
    names = sorted(quotas)
    arcs = {}
    for i, (members, size) in enumerate(patterns):
        for k in range(repeats):
            arcs["start", ("p", i), k] = [size, k]
        for s in members:
            if s in quotas:
                arcs[("p", i), ("s", s), 0] = [10**6, 0]
    for s in names:
        arcs[("s", s), "end", 0] = [quotas[s], 0]
    for a, b, k in list(arcs):
        arcs[b, a, k, "back"] = [0, -arcs[a, b, k][1]]
    words = cost = 0
    while True:
        dist, via = {"start": 0}, {}
        for _ in range(2 * len(patterns) + 2 * len(names) + 4):
            for key, (c, w) in arcs.items():
                if c > 0 and key[0] in dist and dist[key[0]] + w < dist.get(key[1], 10**9):
                    dist[key[1]], via[key[1]] = dist[key[0]] + w, key
        if "end" not in dist:
            return words, cost
        x = "end"
        while x != "start":
            key = via[x]
            arcs[key][0] -= 1
            back = (key[1], key[0], key[2]) if len(key) == 4 else (key[1], key[0], key[2], "back")
            arcs[back][0] += 1
            x = key[0]
        words, cost = words + 1, cost + dist["end"]


def test_flow_is_cheapest_on_random_overlaps():
    rng = random.Random(4)
    for _ in range(25):
        names = "abcd"[: rng.randint(1, 4)]
        patterns = [(frozenset(rng.sample(names, rng.randint(1, len(names)))), rng.randint(0, 6)) for _ in range(rng.randint(0, 6))]
        quotas = {s: rng.randint(0, 20) for s in names}
        out = m.flow(patterns, quotas)
        given = [sum(v for (i, _), v in out.items() if i == p) for p in range(len(patterns))]
        taken = {s: sum(v for (_, x), v in out.items() if x == s) for s in names}
        assert all(s in patterns[i][0] and v > 0 for (i, s), v in out.items())
        assert all(taken[s] <= quotas[s] for s in names) and all(g <= 3 * size for g, (_, size) in zip(given, patterns, strict=True))
        cost = sum(max(0, g - k * size) for g, (_, size) in zip(given, patterns, strict=True) for k in (1, 2))
        assert (sum(given), cost) == cheapest(patterns, quotas)


def test_flow_of_many_patterns():
    names = [f"s{i}" for i in range(3_000)]
    rng = random.Random(5)
    patterns = [(frozenset([s]), 100) for s in names] + [(frozenset(rng.sample(names, 2)), 10) for _ in range(20_000)]
    began = time.process_time()
    out = m.flow(patterns, dict.fromkeys(names, 150))
    assert time.process_time() - began < 60
    assert sum(out.values()) == 3_000 * 150


def test_choice_equals_the_plain_rule(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 2, 7, 30, 400]))) for i in range(300)] + [(7, "w w w")] * 9  # repeated rows are told apart by their numbers only
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, source string")
    for share in (0.3, 1.37, 2.9):
        quota = int(share * sum(len(t.split()) for _, t in rows))
        got = m.mix(docs, lambda totals, quota=quota: {"a": quota}).collect()
        order = docs.select("doc_id", F.size(F.filter(F.split("text", " "), lambda x: x != "")).alias("n"), F.shiftrightunsigned(F.xxhash64(F.lit(0), "doc_id", "text"), 2).alias("h")).collect()
        order = sorted([r for r in order if r["n"]], key=lambda r: r["h"])
        total = sum(r["n"] for r in order)
        base, left = divmod(quota, total)
        want = [0] * len(order)
        at = 0
        while order[at]["n"] <= left:
            left -= order[at]["n"]
            want[at] = 1
            at += 1
        first = {}
        for i in range(at, len(order)):
            first.setdefault((-order[i]["n"], order[i]["h"] % 16), i)
        over = None
        for (n, _), i in sorted(first.items(), key=lambda x: (x[0][0], x[1])):
            if -n <= left:
                left += n
                want[i] = 1
            elif over is None or -n < over[0]:
                over = (-n, i)
        if over and over[0] - left < left:
            want[over[1]] = 1
        plain = sorted((r["doc_id"], r["n"], base + w) for r, w in zip(order, want, strict=True))
        assert sorted((r["id"], r["size"], r["copies"]) for r in got if r["size"]) == plain
        assert abs(sum(r["taken"] for r in got) - quota) <= 2
