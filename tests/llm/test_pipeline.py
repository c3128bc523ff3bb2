import array
import os
import random
import subprocess
import sys
import zlib

import corpus_pipeline as p
import pytest
from pyspark import RDD, cloudpickle
from pyspark.sql import functions as F

from tidelog.llm import jaccard, mixing


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = {"en": "the and of to in is that for it was on with".split(), "de": "der die und den von zu das mit sich auf".split()}
    text = lambda l, n: " ".join(rng.choice(vocabulary[l]) + rng.choice("abcdefgh") for _ in range(n))
    leak = text("en", 14)
    rows = [(i, text(l, 30 + i % 20), l, f"s{i % 3}") for i, l in enumerate(["en", "de"] * 60)]
    rows += [(200 + i, rows[i][1], rows[i][2], "s0") for i in range(10)]  # copies
    rows += [(300, text("en", 20) + " " + leak + " " + text("en", 5), "en", "s1"), (301, "12 34 !!", "en", "s1"), (302, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, columns = {}, docs.columns
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in p.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "shards":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r["doc_id"] for r in now.collect()]
    assert sorted(kept["language"]) == sorted(r[0] for r in rows if r[0] not in (301, 302))
    assert sorted(kept["near_duplicates"]) == sorted([r[0] for r in rows[:120]] + [300])
    assert sorted(kept["decontamination"]) == list(range(120))
    sizes = {r[0]: len(r[1].split()) for r in rows[:120]}
    totals = {f"s{k}": sum(s for i, s in sizes.items() if i % 3 == k) for k in range(3)}
    for source, target in mixing.cycling_quotas(totals).items():
        taken = sum(sizes[i] for i in kept["mixture"] if f"s{i % 3}" == source)
        assert abs(taken - target) < 30
    assert max(map(kept["mixture"].count, set(kept["mixture"]))) <= 3
    assert sorted(kept["shards"]) == sorted(kept["mixture"])
    whole = p.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in whole.collect()) == sorted(kept["shards"])
    assert whole.where(F.col("shard").between(0, 15)).count() == len(kept["shards"])


def test_language_keeps_what_it_cannot_judge(spark):
    rng = random.Random(7)
    words = "the and of to in is that for it was on with".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(30))
    odd = "qxzj vkwq zzxq jqvx kkzw xqjz wvzk qqxj"
    rows = [(i, text(), "en", "s") for i in range(80)]
    rows += [(100, "A.", "en", "s"), (101, "qxzj vk", None, "s"), (102, odd, None, "s"), (103, "12 34 !!", "en", "s"), (104, None, "en", "s"), (105, "", "en", "s")]
    rare = next(i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 4 == 2)  # held out: its language is not learned
    docs = spark.createDataFrame([*rows, (rare, odd + " " + odd, "xx", "s")], "doc_id long, text string, lang string, source string")
    kept = lambda d: sorted(r["doc_id"] for r in p.language(spark, d, "").collect())
    assert kept(docs) == [*range(80), 100, 101, rare]
    assert kept(docs.withColumn("lang", F.lit(None).cast("string"))) == [*range(80), 100, 101, 102, rare]


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls everywhere, repeated rows, long texts, ties, clashing names; and no rows at all."""
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kind = "doc_id long, text string, lang string, source string, n_chars long, DOC_ID string, TEXT int, grams int, size string, p int, hits int, copies int"
    extra = ("x", 1, 2, "s", 3, 4, 5)
    rows = [(i, f"some words of text number {i} and a few more of them {i * 7}", "en" if i % 2 else None, [None, "a", "b"][i % 3], 1, *extra) for i in range(30)]
    rows += [(None, None, None, None, None, *[None] * 7), (None, "null id has words too, more than five", None, None, None, *[None] * 7), (5, "", "en", "a", 0, *extra)]
    rows += [rows[3]] * 3 + [(77, "word " * 400_000, "en", "a", 1, *extra), (78, rows[4][1], "en", "a", 1, *extra)]
    docs = spark.createDataFrame(rows, kind)
    empty = docs.limit(0)
    for name, stage in p.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "shards":
            assert out.columns == docs.columns
        ids = [r[0] for r in out.select(*[out[0]]).collect()] if name == "shards" else [r[0] for r in out.toDF(*[f"c{i}" for i in range(len(out.columns))]).select("c0").collect()]
        assert {"language": 77 in ids and ids.count(3) == 4, "near_duplicates": ids.count(3) == 1 and 78 not in ids and ids.count(None) == 2, "decontamination": len(ids) == len(rows), "mixture": set(ids) <= {r[0] for r in rows} and None in ids, "shards": len(ids) == len(rows)}[name], name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_of_a_family(spark, monkeypatch):
    """The stage compares copies by hashes that others have too: of a family one stays, and all that are changed too much."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(60):
        own = list(base)
        for at in range(3, 200, 28) if i % 2 else [rng.randrange(200)]:
            own[at] = f"v{i}_{at}"
        texts.append(" ".join(own))
    seen, cut = {}, jaccard.cut

    def watched(df, name="cut"):
        out = seen[name] = cut(df, name)
        return out

    monkeypatch.setattr(jaccard, "cut", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in p.near_duplicates(spark, docs, "").collect())
    assert kept == [0, *range(2, 61, 2)]
    others = [x for r in seen["prefixes"].select("dfs").collect() for x in array.array("I", r["dfs"])]
    assert min(others) > 1


HELD = """
import ctypes, random, sys
import pyarrow as pa
from pyspark import RDD, cloudpickle
held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
rng, words = random.Random(3), [f"w{i}" for i in range(5000)]
texts = [" ".join(rng.choices(words, k=rng.choice((20, 500, 2000)))) for _ in range(3000)]
rows = pa.table({"id": range(3000), "key": range(3000), "text": texts}).to_batches(1000)
function = cloudpickle.load(open(sys.argv[1], "rb"))
for b in function(iter(rows)):
    pass
del b
after = held()
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
print(after - held())
"""


NEEDED = """
import random, sys
import numpy as np
import pyarrow as pa
from tidelog.llm import decontaminate, langid
rng, words = random.Random(3), [f"w{i}" for i in range(5000)]
texts = pa.array([" ".join(rng.choices(words, k=rng.choice((20, 500, 2000)))) for _ in range(1000)])
model = langid.Model(["a", "b"], np.ones((1 << 16, 1), np.uint8), np.zeros(2))
grams = decontaminate.Grams([("1", " ".join(words[:12]).encode())], 10)
peak = lambda: int(open("/proc/self/status").read().split("VmHWM:")[1].split()[0]) / 1e3
for function in (model.predict, grams.scan):
    function(texts[:1])
    open("/proc/self/clear_refs", "w").write("5")
    before = peak()
    function(texts)
    print(peak() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="memory can't be read here")
def test_workers_need_little_beside_their_batch():
    """Two workers that judge a batch were what took an executor with a full heap over its memory."""
    out = subprocess.run([sys.executable, "-c", NEEDED], capture_output=True, text=True, timeout=120, check=True, cwd=os.path.dirname(p.__file__))
    assert max(map(float, out.stdout.split())) < 20


def test_no_second_python_daemon(spark, monkeypatch):
    """Frames of the driver's rows need no Python workers: those of createDataFrame stayed beside those of the stages."""
    docs = spark.createDataFrame([(i, "the and of to in is that " * (3 + i % 4), "en", f"s{i % 3}") for i in range(30)], "doc_id long, text string, lang string, source string")
    docs = spark.createDataFrame(docs.toArrow())
    monkeypatch.setattr(RDD, "_to_java_object_rdd", lambda self: pytest.fail("rows go through Python workers"))
    assert p.language(spark, docs, "").count() == 30
    assert p.mixture(spark, docs, "").count() > 0


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="memory can't be read here")
def test_workers_give_memory_back_after_a_task(spark, monkeypatch, tmp_path):
    """Idle Python workers count beside the executor's heap: the pipeline went over its executors' memory."""

    def sent(df, function, schema):
        (tmp_path / "function").write_bytes(cloudpickle.dumps(function))
        raise KeyError

    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", sent)
    with pytest.raises(KeyError):
        p.near_duplicates(spark, docs, "")
    out = subprocess.run([sys.executable, "-c", HELD, str(tmp_path / "function")], capture_output=True, text=True, timeout=120, check=True, cwd=os.path.dirname(p.__file__))
    assert float(out.stdout) < 15
