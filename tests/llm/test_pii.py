import hashlib
import random
import re
import time

from tidelog.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    out = []
    for k, (kind, rx) in enumerate(PLAIN.items()):
        for m in rx.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card":
                total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
                if not 12 <= len(d) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_plain_expressions():
    rng = random.Random(1)
    parts = ["a", "b.", "@", "@x", ".", "-", " ", "+", "+1 (555) 123-4567", "4111 1111 1111 1111", "1", "25", "256.1.1.1", "10.0.0.1", "é", "x@y.z", "4532015112830366", "\n", "()"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [(a, k, z) for a, z, k in pii.base_spans(t)] == [x[:3] for x in plain(t)], t
    assert pii.base_spans("7" * 200_000) == []


def test_report_on_edge_rows_and_learned_spans(spark):
    texts = [(None, None), (1, ""), (2, "mail éa@b.co and 10.1.2.3, card 4111-1111-1111-1111 or +1 (555) 123-4567."), (2, "mail éa@b.co and 10.1.2.3, card 4111-1111-1111-1111 or +1 (555) 123-4567.")]
    texts += [(10 + i, f"you can call me: +1 (555) 123-45{i:02d} today") for i in range(20)] + [(99, "you can call me: 555-123-9999 today"), (98, "you can read 555-123-9999 pages")]
    docs = spark.createDataFrame([(*x, "n", 1) for x in texts], "doc_id long, text string, TEXT string, email int")
    rows = pii.report(docs).collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows}
    want = ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in plain(texts[2][1]))
    assert by[2]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and by[2]["spans"] == want
    assert by[None]["n_email"] == 0 and by[1]["spans"] == ""
    assert by[99]["n_phone"] == 0 and by[99]["spans"] == "phone:17:29" and by[99]["n_spans"] == 1 and by[None]["n_spans"] == 0
    assert by[10]["n_phone"] == 1
    assert pii.report(docs.limit(0)).count() == 0


def test_redact(spark):
    long = "word " * 300_000
    docs = spark.createDataFrame([(1, "to a@b.co now"), (None, None), (2, ""), (3, long + "a@b.co"), (3, long + "a@b.co")], "doc_id long, text string")
    assert sorted(("None" if r["text"] is None else r["text"] for r in pii.redact(docs).collect()), key=len) == ["", "None", "to [email] now", long + "[email]", long + "[email]"]


def test_patterns_learned_from_discovered_tokens(spark):
    """'hotline no' and 'desk is' have no base form at all, only tokens that 'call me' finds and others."""
    texts = [f"please call me: +1 (555) 2{i:02d}-4567 today" for i in range(80)]
    found = [f"77-{i:02d}-8899" for i in range(12)]
    texts += [f"please call me: {t} today" for t in found]
    later = [f"88-{i:02d}-7766" for i in range(12)]
    texts += [f"the hotline no: {t} works" for t in found + later[:1]]
    texts += ["the hotline no: 99-11-0000 works"]
    texts += [f"front desk is {t} always" for t in [*found, "66-55-4433"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r["doc_id"]: r for r in pii.report(docs).collect()}
    for i, t in enumerate(texts):
        assert by[i]["spans"].startswith("phone:"), t
    alone = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if "call" not in t], "doc_id long, text string")
    assert all(r["spans"] == "" for r in pii.report(alone).collect())


def test_each_mention_is_judged_by_its_own_context(spark):
    texts = [f"you can call me: +1 (555) 123-45{i:02d} today" for i in range(20)]
    texts += ["you can call me: 555-123-9999 today", "part no 5551239999 shipped", "5551239999", "555-123-9999"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert by[20] == "phone:17:29" and by[21] == by[22] == by[23] == ""


def test_long_texts_without_spaces(spark):
    """A second at most for a million letters with a few digits, and names of bounded length."""
    texts = ["x" * 1_000_000 + "1", "1" + "x" * 1_000_000, "x1" * 500_000, "x@" * 500_000, "a" * 500_000 + "@" + "b" * 500_000, "1." * 500_000, "1 " * 500_000, "+1(" * 300_000, "a at " * 200_000]
    for t in texts:
        began = time.process_time()
        found = pii.mentions(t, pii.base_spans(t))
        assert time.process_time() - began < 5, t[:10]
        assert all(len(m[3]) < 300 and len(m[5]) < 300 and all(len(p) < 300 for p in m[4]) for m in found), t[:10]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert pii.report(docs).count() == len(texts)


def test_instances_are_whole_tokens(spark):
    """Tokens with the digits of a base entity elsewhere are searched; different ones are different instances."""
    texts = [f"please write to: a{i}@b.co today" for i in range(30)] + ["please write to: jane7@intranet today", "please write to: x.20@mail24 today"]
    texts += [f"the machine host at 10.1.2.{i} runs" for i in range(30)] + ["old machine 7 with 2024 parts and 2029 nuts"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert by[30] == "email:17:31" and by[31] == "email:17:28"
    assert by[62] == ""
    assert pii.instance("10.1.2.3", 1) != pii.instance("1.0.12.3", 1) and pii.instance("555-12", -1) == pii.instance("(555) 12", -1)
    assert len({pii.instance(t, -1) for t in ("x.20@mail24", "2024", "bob7@a.b", "+2024", "x2024")}) == 5


def test_identifiers_with_spaces(spark):
    phones = ["555 123 4567", "030 12 34 56", "(555) 123-9999", "5551 234 567"]
    emails = ["jane at example dot com", "jane [at] example.com", "bob(at)mail (dot) example (dot) org"]
    luhn = [c for i in range(4000) if pii.luhn(c := f"411111111111{i:04d}")][:30]
    texts, want = [], []
    for i in range(30):
        texts += [f"please call me: +1 (555) 123-45{i:02d} today", f"please write to: a{i}@b.co today", f"the card no: {luhn[i]} expired"]
    for kind, label, found in (("phone", "please call me:", phones), ("email", "please write to:", emails), ("card", "the card no:", ["4111 1111 1111 1112"])):
        for x in found:
            want.append((len(texts), kind, label, x))
            texts.append(f"{label} {x} {'expired' if kind == 'card' else 'today'}")
    texts += ["we met at noon dot after 12 34 56 78 90 " + "12 " * 5_000, "7" * 200_000 + " at x.y", "555 123 4567x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    for i, kind, label, x in want:
        a = len(label) + 1
        assert by[i] == f"{kind}:{a}:{a + len(x)}", x
    assert by[len(texts) - 1] == by[len(texts) - 2] == by[len(texts) - 3] == ""
