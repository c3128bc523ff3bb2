import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import jaccard
from tidelog.llm.jaccard import keep_first, report


def sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(ids, texts, percent=80):
    s = sets(texts)
    low = list(range(len(ids)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                low[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    least = {r: min((ids[i] for i in g if ids[i] is not None), default=None) for r, g in groups.items()}
    return sorted((ids[i] is None, ids[i] or 0, len(s[i]), least[find(i)] if least[find(i)] is not None else -1) for i in range(len(ids))), groups


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéXY") for _ in range(rng.randint(1, 5)))
    texts = [None, "", " \t\n", "one", "One", "a b c d", "a  b\tc D", "a b c d e", "x " * 3000, "x " * 2500]
    common = [word() for _ in range(40)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(5, 120))] + (common if rng.random() < 0.5 else [])
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            new = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                new[rng.randrange(len(new))] = word()
            texts.append("\n".join(new) if rng.random() < 0.3 else " ".join(new))
    texts += [texts[12]] * 20
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    ids[15] = ids[14]
    ids[20] = None
    return ids, texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed):
    ids, texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, TEXT string, fp int").repartition(3)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in report(docs).collect())
    want, _ = brute(ids, texts)
    assert got == want


def test_keep_first_and_empty(spark):
    rows = [(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, None, "s"), (4, "", "s"), (None, "a b c d e f", "s"), (7, "q r s t u v w", "s"), (7, "q r s t u v w", "s"), (None, "only here now", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in keep_first(docs).collect())
    assert got == sorted([("1", "a b c d e f"), ("3", "None"), ("4", ""), ("7", "q r s t u v w"), ("None", "only here now")])
    assert keep_first(docs).columns == docs.columns
    assert report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_hashes_in_blocks(spark, hot):
    """Where a hash of more than `hot` sets is dealt out in blocks, no link is lost: a dense group, chains and strangers."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(60)] = f"v{rng.randint(0, 20)}"
        texts.append(" ".join(own))
    chain = [f"c{i}" for i in range(80)]
    texts += [" ".join(chain[i : i + 50]) for i in range(0, 30, 2)] + [" ".join(base[:30] + [f"u{i}_{j}" for j in range(30)]) for i in range(10)]
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = sorted((False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in report(docs, hot=hot).collect())
    assert got == brute(ids, texts)[0]


def test_family_and_its_strangers(spark, monkeypatch):
    """Of copies that are changed too much for any link prefixes hold only hashes that another class has."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(120):
        own = list(base)
        for at in rng.sample(range(200), 1 if i % 2 else 7):  # 35 of 196 shingles at most
            own[at] = f"v{i}_{at}"
        texts.append(" ".join(own))
    seen, cut = {}, jaccard.cut

    def watched(df, name="cut"):
        out = seen[name] = cut(df, name)
        return out

    monkeypatch.setattr(jaccard, "cut", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted((False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in report(docs).collect())
    assert got == brute(list(range(len(texts))), texts)[0]
    others = np.concatenate([np.frombuffer(r["dfs"], np.uint32) for r in seen["prefixes"].select("dfs").collect()])
    assert others.min() > 1


def test_pairs_of_groups():
    """Each pair of different components once, in the reach of sizes; none inside the largest component is made."""
    rng = np.random.default_rng(4)
    for big in (40, 3_000):
        head = np.zeros(big + 60, jaccard.POSTING)
        head["h"], head["n"] = np.sort(rng.integers(1, 4, len(head))), rng.integers(80, 140, len(head))
        head["s"], head["g"] = head["n"] - rng.integers(0, 12, len(head)), np.arange(len(head))
        head["i"] = rng.integers(0, 8, len(head))
        head = head[np.lexsort((head["g"], head["n"], head["h"]))]
        sole = np.where(rng.random(len(head)) < 60 / len(head), rng.integers(2, 30, len(head)), 1)
        sole[5] = -(1 << 62)
        got = [(int(i), int(j)) for p, q in jaccard._group_pairs(head, sole, np.ones(len(head), np.int64), 80, most=5_000) for i, j in zip(p, q, strict=True)]
        i, j = np.triu_indices(len(head))
        ok = (head["h"][i] == head["h"][j]) & (sole[i] != sole[j])
        i, j = i[ok], j[ok]
        ok = jaccard._reach(head[i], head[j], 80)
        assert sorted(got) == sorted([*zip(i[ok].tolist(), j[ok].tolist(), strict=True), (5, 5)])


@pytest.mark.parametrize("deal", ["low", "whole"])
def test_dealing_hashes_costs_no_calls_for_each_bucket(deal):
    """A table of 30 GB has thousands of buckets, and every piece of text has hashes for all of them."""
    rng = random.Random(21)
    texts = [" ".join(rng.choices("abcdefghij", k=rng.choice((0, 3, 40, 300)))) for _ in range(200)] + [None]
    table = pa.table({"id": range(201), "key": range(201), "text": texts}).combine_chunks()
    sets_ = [b.select(["fp", "hashes"]) for b in jaccard.set_rows(5)(table.select(["id", "text"]).to_batches())]

    def run(n):
        calls = 0

        def count(frame, event, arg):
            nonlocal calls
            calls += event in ("call", "c_call")

        sys.setprofile(count)
        try:
            out = list(jaccard.low_hashes(n, 5, 0.5)(table.to_batches()) if deal == "low" else jaccard.dealt_hashes(n)(sets_))
        finally:
            sys.setprofile(None)
        rows = [r for b in out for r in b.to_pylist() if r.get("kind", 1) == 1]
        width = -(-(1 << 64 if deal == "whole" else 1 << 63) // n)
        assert len({r["bucket"] for r in rows}) == len(rows) <= n
        got = {}
        for r in rows:
            h, counts = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], np.uint32)
            assert {int(x) // width for x in h} == {r["bucket"]}
            for fp, x in zip(np.repeat(np.frombuffer(r["fps"], np.int64), counts).tolist(), h.tolist(), strict=True):
                got.setdefault(fp, []).append(x)
        return calls, {fp: sorted(x) for fp, x in got.items()}

    (few, one), (many, other) = run(16), run(4096)
    assert one == other and sum(map(len, one.values())) > 5_000
    assert many < 2 * few
