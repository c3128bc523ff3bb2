import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidelog.llm import decontaminate, embeddup, langid
from tidelog.llm.components import components

ALPHABET = {"en": "the and of to in is that for it was on with as his they at be this".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split(), "fr": "le de un être et à il avoir ne je son que se qui ce dans en du".split()}


def test_language(spark):
    rng = random.Random(1)
    text = lambda l, n=30: " ".join(rng.choice(ALPHABET[l]) for _ in range(n))
    rows = [(i, text(l), l) for i, l in enumerate(list(ALPHABET) * 80)] + [(1000, None, "en"), (1001, "123 !! 4", "en"), (1002, "", None), (None, text("de"), None), (1003, text("fr", 20_000), None), (1003, text("fr"), None), (1004, "я", "en"), (1005, "Z", None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, LANG string")
    got = langid.report(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t, l in rows[:240]:
        r = by[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == l
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by[None]["lang_pred"] == "de" and by[1003]["lang_pred"] == "fr"
    assert by[1004]["lang_pred"] in ALPHABET and by[1005]["lang_pred"] in ALPHABET
    nothing = docs.withColumn("lang", docs["text"].substr(1, 0)).where("false")
    assert langid.report(nothing).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.report(unlabelled).first()["lang_pred"] == "und"


def test_many_languages_fill_several_slices():
    import pyarrow as pa

    pairs = [(1000 * i + j, i) for i in range(70) for j in range(1, 50)]
    batch = pa.RecordBatch.from_pydict({"g": [g for g, _ in pairs], "i": [i for _, i in pairs]}, pa.schema([("g", pa.int64()), ("i", pa.int64())]))
    m = langid.build([f"l{i:03}" for i in range(70)], 16, langid.slot_rows(16, langid.slot_width(70))([batch]))
    assert m.table.shape == (1 << 16, 2) and m.bits == 16
    for i in (0, 63, 64, 69):
        for k in range(len(langid.SEEDS)):
            masks = m.table[langid.slots(np.array([1000 * i + 7], np.uint32), k, 16), i // 64]
            assert masks[0] >> np.uint64(i % 64) & np.uint64(1)


def test_filters_grow_with_the_n_grams(spark):
    """Every n-gram of a language is in its filter, however many it has."""
    rng = random.Random(9)
    grams = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(60_000)]
    docs = spark.createDataFrame([(0, " ".join(grams), "x"), (1, "ΑΒΓΔ ЖИЗНЬ", "y")], "doc_id long, text string, lang string")
    m = langid.fit(docs)
    assert m.langs == ["x", "y"] and langid.SLOT_BITS[0] < m.bits <= langid.SLOT_BITS[1]
    import pyarrow as pa

    names, scores, _ = m.predict(pa.array([grams[59_999], grams[0], "αβγδ", "жизнь"]))
    assert names == ["x", "x", "y", "y"] and min(scores) > 0.9


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(docs, items, window=10):
    low = lambda t: WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    grams = {}
    for item, t in items:
        w = low(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for t in docs:
        w, hit, found = low(t), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if x := grams.get(tuple(w[i : i + n])):
                    found |= x
                    hit |= set(range(i, i + n))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, block_bytes):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["É", "日本", "x_y", "A1"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, some(rng.choice([1, 3, 10, 14, 25]) + 20 * (i % 2))) for i in range(8)] + [(20, None), (21, "..."), (22, "Q-7 lone"), (3, "second with the same id " * 3)]
    texts = [None, "", "- -", "q 7 LONE", "lone q 7"]
    texts += [some(rng.randint(0, 40)) + rng.choice([" ", "."]) + items[i % 8][1].upper() + ", " + some(5) for i in range(24)] + [some(5000)] * 2
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, HITS int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.report(docs, bench, block_bytes=block_bytes).collect()}
    want = plain(texts, items)
    for i, w in enumerate(want):
        assert got[i or None] == w, texts[i]
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not w[-1] for w in want)
    spans = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs, bench, remove="spans").collect()}
    assert spans[3] == "" and spans[4] == "lone q 7" and spans[None] is None
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("edges_in_one_task", [250_000, 0])
def test_components(spark, monkeypatch, edges_in_one_task):
    from tidelog.llm import components as module

    monkeypatch.setattr(module, "ONE_TASK_EDGES", edges_in_one_task)
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 200)] + [(5, 5), (None, 3), (300, 299), (299, 300), (150, 400)]
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {i: 100 for i in range(101, 200)} | {300: 299, 400: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    rows, centre = [], rng.standard_normal((12, 16))
    for c, n in enumerate([90, 5, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1]):
        rows += [(centre[c] + 0.08 * rng.standard_normal(16), c % 3) for _ in range(n)]
    rows += [(rows[0][0], 0)] * 4 + [(-rows[0][0], 0), (rows[0][0] * 7, 1), (rows[0][0], None), (np.zeros(16), 0), (np.full(16, np.nan), 0), (None, 0), (np.array([]), 0), (rows[0][0][:8], 0)]
    data = [(i if i != 50 else None, None if v is None else [float(x) for x in v], l, 1) for i, (v, l) in enumerate(rows)]
    data.append((900, [None] + [1.0] * 15, 0, 1))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, LABEL int").repartition(3)
    got = {r["vec_id"]: r for r in embeddup.link(df).collect()}
    assert len(got) == len(data)
    ok = lambda v: v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
    for a in data:
        links, seen, todo = 0, {a[0]}, [a]
        if ok(a[1]) and a[2] is not None:
            near = lambda x: [y for y in data if y is not x and ok(y[1]) and y[2] == x[2] and len(y[1]) == len(x[1]) and np.dot(x[1], y[1]) / np.linalg.norm(x[1]) / np.linalg.norm(y[1]) >= 0.93]
            links = len(near(a))
            while todo:
                for y in near(todo.pop()):
                    if y[0] not in seen:
                        seen.add(y[0])
                        todo.append(y)
        least = min((x for x in seen if x is not None), default=None)
        r = got[a[0]]
        assert (r["n_links"], r["component_id"], r["kept"]) == (links, least, a[0] == least), a[0]
    assert embeddup.link(df.limit(0)).count() == 0


def test_embedding_links_of_isolated_pairs_in_a_crowded_label(spark):
    """Vectors around one direction, so that their signs hardly differ: each planted pair is linked, and nothing else."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(unit(rng.standard_normal(64)) + 0.9 * unit(rng.standard_normal((5_000, 64))))
    far = rng.standard_normal((300, 64))
    far = unit(far - (far * x[:300]).sum(1, keepdims=True) * x[:300])
    x = np.concatenate([x, 0.94 * x[:300] + (1 - 0.94**2) ** 0.5 * far])
    want = np.tril(x @ x.T >= 0.93, -1)
    want = set(zip(*(v.tolist() for v in np.nonzero(want)), strict=True))
    assert {(5_000 + i, i) for i in range(300)} <= want and len(want) < 400
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embeddup.link(df).collect()}
    assert sum(r["n_links"] for r in got.values()) == 2 * len(want)
    assert all(got[a]["component_id"] == got[b]["component_id"] for a, b in want)


def test_very_long_vectors_and_recall_of_a_query_set(spark):
    """Vectors of 5,000 components are compared whole; of a table with links, every vector whose id is divisible by 20 finds
    the links that all rows hold for it."""
    far = np.zeros(5_000)
    far[0] = 1
    near = far.copy()
    near[4_999] = 0.3
    docs = spark.createDataFrame([(1, far.tolist(), 0), (2, near.tolist(), 0), (3, far[::-1].tolist(), 0)], "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: r["component_id"] for r in embeddup.link(docs).collect()} == {1: 1, 2: 1, 3: 3}
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((700, 32))
    x = np.concatenate([centre, centre[rng.integers(0, 700, 1_300)] + 0.2 * rng.standard_normal((1_300, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = rng.integers(0, 2, 2_000)
    out = {r["vec_id"]: r["n_links"] for r in embeddup.link(spark.createDataFrame([(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")).collect()}
    want = ((x[::20] @ x.T >= 0.93) & (label[::20, None] == label)).sum(1) - 1
    got = np.array([out[i] for i in range(0, 2_000, 20)])
    assert want.sum() > 100 and (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_passes_grow_with_the_label():
    counts = [embeddup.passes_for(n) for n in (10, 64, 1_000, 10**5, 10**7, 10**9)]
    assert counts[:2] == [1, 1] and counts == sorted(counts) and counts[-1] < 300
    assert embeddup.passes_for(10**5, spread=0.4) > embeddup.passes_for(10**5)
