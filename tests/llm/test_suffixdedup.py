import hashlib
import random
from collections import Counter

import pyarrow as pa

from tidelog.llm import suffixdedup
from tidelog.llm.suffixdedup import repeats, report


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def check(spark, texts, length, gram):
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, TEXT string, key int").repartition(5)
    rows = {r["doc_id"]: tuple(r)[1:5] for r in repeats(docs, length=length, gram=gram).collect()}
    want = brute(texts, length)
    for i, w in enumerate(want):
        assert rows[i if i != 3 else None] == w, (i, texts[i], rows[i if i != 3 else None], w)


def test_equal_to_brute_force(spark):
    rng = random.Random(3)
    for length, gram, letters in ((40, 10, "abcdé "), (47, 12, "ab"), (25, 8, "xyz€")):
        common = ["".join(rng.choice(letters) for _ in range(rng.randint(20, 120))) for _ in range(6)]
        texts = [None, "", "short", "a" * 200, "a" * (length - 1), "ab" * 90]
        for _ in range(60):
            texts.append("".join(rng.choice(common)[rng.randint(0, 15) :] if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))))
        texts += [texts[10]] * 3 + [texts[11] + "q"]
        check(spark, texts, length, gram)


def test_production_length_and_long_text(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(120))
    texts = [" ".join(word() for _ in range(200)) + passage[i * 3 :] + " ".join(word() for _ in range(50)) for i in range(8)]
    texts += [passage[:399], passage[:400], "é" * 500, texts[0]]
    check(spark, texts, 400, 100)


def test_empty_table(spark):
    assert report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parts_of_long_texts_choose_the_same_anchors(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("abcd") for _ in range(6_000))

    def chosen():
        found = suffixdedup.text_anchors(pa.array([text]), 400, 100)
        return {i: (int(p), int(h)) for doc, pos, h, a, z, *_ in found for p, h, x, y in zip(pos, h, a, z, strict=True) for i in range(x, y + 1)}

    whole = chosen()
    monkeypatch.setattr(suffixdedup, "LONG", 1_000)
    assert chosen() == whole and len(whole) == 6_000 - 399


def test_a_text_above_the_limit_of_one_part(spark):
    rng = random.Random(9)
    letters = "".join(map(chr, range(97, 123)))
    passage = "".join(rng.choice(letters) for _ in range(900))
    long = rng.randbytes(5 << 20).hex()[: suffixdedup.LONG + (1 << 20)]
    cut = suffixdedup.LONG - 300
    texts = [long[:cut] + passage + long[cut:], "before " + passage[100:] + " after", "quite another text " * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in report(docs).collect()}
    assert got == {0: (len(texts[0]), 800, 1), 1: (len(texts[1]), 800, 1), 2: (len(texts[2]), 0, 0)}
