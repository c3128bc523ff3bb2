import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import text
from tidelog.functions.derive import derive
from tidelog.operators import recall, trust, writes
from tidelog.plans import grammar
from tidelog.plans.query import EventQuery
from tidelog.schema import EVENT
from tidelog.sources import events as sources
from tidelog.sources.tables import indexed
from tidelog.store import open_store

A, B = "a" * 64, "b" * 64


def ident(n):
    return f"{n:064x}"


def event(n, kind=1, author=A, at=1000, tags=(), content=""):
    return (ident(n), author, at, kind, [list(t) for t in tags], content, "")


def frame(spark, rows, seq=False):
    schema = copy.deepcopy(EVENT)
    if seq:
        schema.add("seq", "long")
    return spark.createDataFrame([(*r, *([i] if seq else [])) for i, r in enumerate(rows)], schema)


def test_derived_columns(spark):
    rows = [
        event(1, 0), event(2, 30023, tags=[["d"], ["d", "x"], ["d", "y"]]), event(3, 30023), event(4, 1059, tags=[["p", B]]), event(5, 1, tags=[["expiration", "soon"], ["expiration", "50"], ["expiration", "60"], ["title", "no"], ["t", "Yes"], ["t"]]), event(6, 1059),
    ]
    got = {r["id"]: r for r in derive(frame(spark, rows)).collect()}
    assert got[ident(1)]["address"] == f"0:{A}:" and got[ident(2)]["address"] == f"30023:{A}:x" and got[ident(3)]["address"] == f"30023:{A}:"
    assert got[ident(4)]["owner"] == B and got[ident(6)]["owner"] == A
    assert got[ident(5)]["expires_at"] == 50 and got[ident(1)]["expires_at"] == (1 << 63) - 1
    assert got[ident(5)]["tag_index"] == ["t:Yes"] and got[ident(5)]["address"] is None


@pytest.mark.parametrize(
    ("string", "want"),
    [
        ("hello world", {"words": ("hello", "world")}),
        ('"to be" or', {"words": ("or",), "phrases": ("to be",)}),
        ('"open end', {"phrases": ("open end",)}),
        ('""', {}),
        ("--no e-cash -", {"words": ("e-cash", "-"), "excluded": ("no",)}),
        ('-"a b" -!!', {"excluded": ("a b",)}),
        ("foo:bar https://x.y z", {"words": ("https://x.y", "z")}),
        ("-sort:rank", {"excluded": ("sort:rank",)}),
        ('"sort:rank"', {"phrases": ("sort:rank",)}),
        ("sort:rank filter:rank:gt:4", {"sort": "rank_desc", "floor": 5.0}),
        ("sort:nothing filter:rank:lt:4", {}),
        (f"observer:{'A' * 64} include:spam", {"observer": A, "include_spam": True}),
        ("observer:zz", {}),
    ],
)
def test_grammar(string, want):
    assert grammar.parse(string) == grammar.Parsed(**want)


def test_floor_and_gate():
    q = EventQuery()
    assert grammar.apply(q, "cat").min_rank == 2.0 and grammar.apply(q, "cat include:spam").min_rank == 0.0
    gated = grammar.apply(q, None, observer=A)
    assert (gated.ranking, gated.min_rank) == ("recency_gated", 2.0)
    assert grammar.apply(q, "include:spam", observer=A).ranking is None
    assert grammar.apply(q, "sort:recent").ranking is None
    assert grammar.apply(q, "cat", observer=A).profile() == "search" and grammar.apply(q, "cat").profile() == "text"


def test_fold_parts_tokens():
    assert text.fold("Ｆｕｌｌ Ünï") == "full uni" and text.fold_accents("Ｆ") == "ｆ"
    assert text.parts("camelCaseHTTPServer-x2Y") == ["camel", "case", "http", "server", "x2", "y"]
    assert text.tokens("e-cash now") == ["e-cash", "ecash", "now", "ecashnow"]
    assert text.parts("東京都") == ["東京都", "京都", "都"]
    assert len(text.parts(" ".join(f"w{i}" for i in range(99)))) == 48 and text.tokens("x" * 65) == []


def search(spark, profiles, string, **more):
    rows = [event(i, 0, author=f"{i:064x}", at=1000 + i, content=json.dumps(p)) for i, p in enumerate(profiles)]
    rows += [event(100 + i, 1, content=c) for i, c in enumerate(more.get("notes", ()))]
    q = grammar.apply(EventQuery(**more.get("q", {})), string)
    return [(int(r["id"], 16), r["tier"]) for r in recall.recall(indexed(frame(spark, rows)), q).collect()]


def test_search_tiers_typos_phrases_and_bodies(spark):
    people = [{"name": "Marta Quintela"}, {"name": "Martinique"}, {"name": "someone", "about": "marta is a friend"}, {"name": "MartaTheDev"}, {"name": "x", "nip05": "marta@site.com"}]
    got = dict(search(spark, people, "marta"))
    assert got[0] == "name" and got[3] == "near" and got[4] == "identity" and got[2] in ("weak", "affiliation") and 1 not in got or got.get(1) == "near"
    assert search(spark, people, "marta")[0][0] == 0
    assert 0 in dict(search(spark, people, "quintla")) and 0 not in dict(search(spark, people, "xuintela"))
    assert [i for i, _ in search(spark, people, '"marta quintela"')] == [0]
    assert 0 not in dict(search(spark, people, "marta -quintela"))
    notes = ["estimated testing", "vitamin and editor", "dates estimated", "naïve café", "日本語の本文です"]
    hits = lambda s: {i - 100 for i, _ in search(spark, [], s, notes=notes)}
    assert hits("testin") == {0} and hits("cafe") == {3} and hits("本文です") == {4} and hits("!!") == set()


def test_trust_orders_and_gates(spark):
    names = [{"name": "bob"}, {"name": "bob"}, {"name": "bobby"}]
    rows = [event(i, 0, author=f"{i:064x}", content=json.dumps(p)) for i, p in enumerate(names)]
    rep = spark.createDataFrame([(f"{0:064x}", A, 5, 1.0), (f"{1:064x}", A, 90, 7.0), (f"{2:064x}", A, 1, 3.0)], "subject string, observer string, influence int, followers float")
    ids = lambda s: [int(r["id"], 16) for r in recall.recall(indexed(frame(spark, rows)), grammar.apply(EventQuery(), s, observer=A), rep).collect()]
    assert ids("bob") == [1, 0] and ids("bob include:spam") == [1, 0, 2]
    assert ids("sort:rank filter:rank:gte:5") == [1, 0] and ids("sort:rank:asc include:spam") == [2, 0, 1] and ids("sort:followers include:spam") == [1, 2, 0]
    assert ids("") == [0, 1]


def test_matches_beyond_the_rerank_window_stay(spark):
    rows = indexed(frame(spark, [event(i, 0, author=f"{i:064x}", content=json.dumps({"name": "bob"})) for i in range(1200)]))
    rep = spark.createDataFrame([(f"{i:064x}", A, 90 if i >= 1150 else 50, 1.0) for i in range(1200)], "subject string, observer string, influence int, followers float")
    q = grammar.apply(EventQuery(), "bob", observer=A)
    got = [(int(r["id"], 16), r["score"]) for r in recall.recall(rows, q, rep).collect()]
    assert [i for i, _ in got] == [*range(1150, 1200), *range(1150)]
    assert got[999][1] > got[1000][1] and len({x for _, x in got[50:1000]}) == len({x for _, x in got[1000:]}) == 1
    assert recall.count(rows, [q], rep).first()["n"] == 1200


def test_merges(spark):
    rows = derive(frame(spark, [event(i, i % 3, at=i) for i in range(12)]))
    got = [int(r["id"], 16) for r in recall.query(rows, [EventQuery(kinds=[1], limit=2), EventQuery(since=9, limit=2)]).collect()]
    assert got == [11, 10, 7]
    assert recall.count(rows, [EventQuery(kinds=[1], limit=2), EventQuery(since=9, limit=2)]).first()["n"] == 3
    assert recall.count(rows, [EventQuery(kinds=[1], limit=2)]).first()["n"] == 2
    many = EventQuery(ids=[ident(i) for i in range(10_500)])
    assert recall.rows(rows, many).count() == 12


def random_log(rng, n, deletions, made):
    """made: all events so far; some are sent again (in one batch only where deletions are replayed one by one)."""
    rows, before = [], list(made)
    for i in range(n):
        if (made if deletions else before) and rng.random() < 0.15:
            again = rng.choice(made if deletions else before)
            rows += [again] if deletions or again not in rows else []
            continue
        author = rng.choice([A, B])
        kind = rng.choice([0, 1, 1, 7, 30023, 30023, 20001] + ([5, 62] if deletions else []))
        at = 1000 + rng.randint(0, 30)
        tags = []
        if kind == 30023:
            tags = [["d", rng.choice("xy")]]
        elif kind == 5:
            tags = [["e", rng.choice(made)[0]] if made and rng.random() < 0.7 else ["a", f"30023:{author}:{rng.choice('xy')}"]]
        elif kind == 62:
            tags = [["relay", rng.choice(["ALL_RELAYS", "wss://me", "wss://other"])]]
        if rng.random() < 0.1:
            tags = [*tags, ["expiration", str(rng.choice([500, 5000]))]]
        e = event(len(made), kind, author, at, tags, "bad\x01" if rng.random() < 0.03 else "ok")
        rows.append(e)
        made.append(e)
    return rows


def sequential(stored, batch, now, relay):
    """The rules one event after another, in plain Python, over one store."""
    held = {e[0]: e for e in stored}

    def address(e):
        d = next((t[1] for t in e[4] if t[0] == "d" and len(t) > 1), "")
        return f"{e[3]}:{e[1]}:" + (d if 30_000 <= e[3] < 40_000 else "") if e[3] in (0, 3) or 30_000 <= e[3] < 40_000 else None

    covers = lambda e: e[3] == 62 and any(t[0] == "relay" and t[1] in ("ALL_RELAYS", relay) for t in e[4])
    out = []
    for e in batch:
        expires = next((int(t[1]) for t in e[4] if t[0] == "expiration"), 1 << 62)
        if 20_000 <= e[3] < 30_000:
            out.append(None)
            continue
        why = None
        if expires <= now:
            why = "expired"
        elif "\x01" in e[5]:
            why = "unstorable text"
        elif e[0] in held:
            why = "duplicate"
        elif e[3] not in (5, 62) and any(g[3] == 5 and g[1] == e[1] and g[2] >= e[2] and any(t[0] in "ea" and t[1] in (e[0], address(e)) for t in g[4]) for g in held.values()):
            why = "deleted"
        elif any(covers(g) and g[1] == e[1] and g[2] >= e[2] for g in held.values()):
            why = "vanished"
        elif address(e) and any(address(g) == address(e) and (-g[2], g[0]) < (-e[2], e[0]) for g in held.values()):
            why = "replaced"
        out.append(why)
        if why:
            continue
        if e[3] == 5:
            for t in e[4]:
                for g in list(held.values()):
                    if g[3] not in (5, 62) and g[1] == e[1] and ((t[0] == "e" and g[0] == t[1]) or (t[0] == "a" and address(g) == t[1] and g[2] <= e[2])):
                        del held[g[0]]
        if covers(e):
            held = {k: g for k, g in held.items() if not (g[1] == e[1] and g[2] <= e[2])}
        if address(e):
            held = {k: g for k, g in held.items() if address(g) != address(e)}
        held[e[0]] = e
    return out, held


@pytest.mark.parametrize("deletions", [False, True])
def test_batches_equal_one_by_one(spark, tmp_path, deletions):
    rng = random.Random(11 + deletions)
    for round_ in range(2):
        store = open_store(spark, str(tmp_path / f"s{round_}{deletions}"), relay="wss://me", clock=lambda: 1000)
        held: dict = {}
        made: list = []
        for _ in range(2):
            batch = random_log(rng, 40, deletions, made)
            want, held = sequential(list(held.values()), batch, 1000, "wss://me")
            got = {r["seq"]: r["reason"] for r in store.insert(frame(spark, batch, seq=True)).collect()}
            assert [got[i] for i in range(len(batch))] == want
            assert {r["id"] for r in store.events().collect()} == set(held)


def test_store_reads_deletes_and_transactions(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"), clock=lambda: 1000)
    store.insert(frame(spark, [event(1, 1, at=5, tags=[["t", "x"], ["expiration", "1001"]]), event(2, 1, at=6, tags=[["t", "y"]]), event(3, 7, B, 7)], seq=True))
    assert [r["id"] for r in store.query(EventQuery(limit=2)).collect()] == [ident(3), ident(2)]
    assert store.count([EventQuery(kinds=[1]), EventQuery(authors=[B])]) == 3 and store.count(EventQuery()) == 3
    assert {r["value"] for r in store.distinct_tag_values(EventQuery(), "t").collect()} == {"x", "y"}
    assert store.snapshot_ids(EventQuery(), 1).count() == 2
    assert store.raw_query(EventQuery(ids=[ident(2)])).first()["tags"] == '[["t","y"]]'
    store.clock = lambda: 1001
    assert store.count(EventQuery()) == 2
    store.expire()
    store.delete(EventQuery(kinds=[7]))
    assert [r["id"] for r in store.events().collect()] == [ident(2)]
    out = store.transaction(frame(spark, [event(8, at=1), event(2, at=6), event(9, at=2)], seq=True)).collect()
    assert {(r["seq"], r["reason"]) for r in out} == {(0, None), (1, "duplicate")}
    assert store.count(EventQuery()) == 2


def test_trust_view(spark):
    subject, service = "c" * 64, "d" * 64
    lists = event(1, 10040, A, 1, [["30382:rank", service, "wss://r"], ["client", "x"]])
    other = event(2, 10040, B, 1, [["30382:followers", service, "wss://r"]])
    cards = [event(3, 30382, service, 10, [["d", subject], ["rank", "87"], ["followers", "5"]]), event(4, 30382, service, 11, [["d", subject.upper()], ["rank", "250"]]), event(5, 30382, "e" * 64, 99, [["d", subject], ["rank", "1"]]), event(6, 30382, service, 50, [["d", "nobody"], ["rank", "x"]])]
    e = derive(frame(spark, [lists, other, *cards]))
    rep = trust.reputation(e)
    assert {tuple(r) for r in rep.collect()} == {(subject, A, 100, None), (subject, B, None, 5.0)}
    assert trust.verify(rep, e).count() == 0
    broken = rep.withColumn("influence", F.lit(3))
    assert {r["problem"] for r in trust.verify(broken, e).collect()} == {"different"}
    assert trust.verify(trust.reconcile(broken, e), e).count() == 0
    assert [r["id"] for r in trust.orphan_cards(e).collect()] == [ident(5)]
    assert trust.orphan_cards(e.where("kind = 30382")).count() == 0


def test_json_and_streaming(spark, tmp_path):
    from tidelog.streaming import ingest

    rows = frame(spark, [event(1, 30023, at=5, tags=[["d", "x"]]), event(2, 30023, at=9, tags=[["d", "x"]]), event(3, 20001)])
    sources.to_json(rows).write.text(str(tmp_path / "in"))
    assert sources.read_json(spark, str(tmp_path / "in")).count() == 3
    store = open_store(spark, str(tmp_path / "store"), clock=lambda: 1000)
    stream = sources.from_json(spark.readStream.text(str(tmp_path / "in")))
    ingest.into_store(stream, store, str(tmp_path / "cp")).awaitTermination(120)
    assert [r["id"] for r in store.events().collect()] == [ident(2)]
    newest = ingest.newest_versions(sources.from_json(spark.readStream.text(str(tmp_path / "in"))))
    q = newest.writeStream.format("memory").queryName("newest").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert [r["id"] for r in spark.table("newest").collect()] == [ident(2)]


def test_store_appends_prunes_and_compacts(spark, tmp_path):
    from tidelog.sources.segments import Segments

    store = open_store(spark, str(tmp_path / "s"), clock=lambda: 1000, buckets=4)
    people = [f"{i + 160:064x}" for i in range(12)]
    first = store.insert(frame(spark, [event(i, 0, people[i], 10, content=json.dumps({"name": f"marta{i}"})) for i in range(12)], seq=True))
    for turn in range(1, 10):
        out = store.insert(frame(spark, [event(100 + turn, 0, people[0], 10 + turn, content='{"name": "quintela"}'), event(200 + turn, 1, people[0], 5)], seq=True))
        assert {r["reason"] for r in out.collect()} == {None}
    assert first.count() == 12  # outcomes outlive later writes
    m = store.state.manifest()
    count = [sum(s[1] == b for s in m["rows"] + m["gone"]) for b in range(4)]
    busy = store.state.bucket_numbers([people[0]])[0]
    assert max(count) <= Segments.MOST and all(n <= 1 for b, n in enumerate(count) if b != busy)
    assert store.events().count() == 12 + 9 and store.get(ident(109))["content"] == '{"name": "quintela"}' and store.get(ident(0)) is None
    plan = store.query(EventQuery(owners=[people[0].upper()], kinds=[1], not_expired_at=1000))
    assert plan.count() == 9
    files = [f for f in plan.inputFiles() if "/rows/" in f]
    assert files and all(f"bucket={busy}/" in f for f in files)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    text = plan._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert any("GreaterThan(expires_at" in x and "owner" in x for x in text.split("PushedFilters")[1:])
    found = store.query(EventQuery(), search="quintela")
    assert [int(r["id"], 16) for r in found.collect()] == [109]
    assert not any(x in found._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


def test_reindex_put_and_reputation(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"), clock=lambda: 1000, buckets=4)
    store.insert(frame(spark, [event(i, 1, f"{i:064x}", content=f"word{i}") for i in range(8)], seq=True))
    assert store.reindex() == (0, None)
    broken = store.events().withColumn("folded", F.col("folded").withField("search_text", F.lit(" lost ")))
    store.state.replace(broken.where(F.col("owner") < f"{4:064x}").unionByName(store.events().where(F.col("owner") >= f"{4:064x}")), range(4))
    assert store.count(EventQuery(), '"word1"') == 0
    total, at = 0, 0
    while at is not None:
        n, at = store.reindex(at, 1)
        total += n
    assert total == 4 and store.count(EventQuery(), '"word1"') == 1
    e = dict(zip(EVENT.names, event(50, 30023, at=5, tags=[["d", "x"]]), strict=True))
    assert store.put_if_newer(e) and not store.put_if_newer(e | {"id": ident(51), "created_at": 4}) and store.put_if_newer(e | {"id": ident(52), "created_at": 6})
    assert store.get(ident(50)) is None and store.get(ident(52)) is not None
    service, subject = "d" * 64, "c" * 64
    trusted = frame(spark, [event(60, 10040, A, 1, [["30382:rank", service, "r"]]), event(61, 30382, service, 10, [["d", subject], ["rank", "8"]])], seq=True)
    store.insert(trusted)
    assert store.pending_trust() == 1 and store.drain_trust() == 1 and store.pending_trust() == 0
    newer = frame(spark, [event(62, 30382, service, 11, [["d", subject], ["rank", "9"]])], seq=True)
    store.insert(newer)
    store.await_trust()
    assert [tuple(r) for r in store.reputation_of(subject).collect()] == [(A, 9, None)]
    pages: list = []
    assert store.visit_subjects(pages.append) == 1 and pages == [[subject]]
    assert store.verify_trust().count() == 0
    store.delete(EventQuery(ids=[ident(62)]))  # what is taken away touches the view as well
    store.await_trust()
    assert store.reputation_of(subject).count() == 0 and store.verify_trust().count() == 0


def test_streamed_deletions_and_trust(spark, tmp_path):
    from tidelog.streaming import ingest

    def serve(name, rows):
        sources.to_json(frame(spark, rows)).coalesce(1).write.mode("append").text(str(tmp_path / name))
        return sources.from_json(spark.readStream.text(str(tmp_path / name)))

    x = [["d", "x"]]
    rows = [event(1, 30023, at=5, tags=x), event(2, 5, at=7, tags=[["a", f"30023:{A}:x"]]), event(3, 30023, at=6, tags=x), event(4, 30023, B, 5, x), event(5, 5, at=9, tags=[["a", f"30023:{B}:x"]])]
    seen: dict = {}

    def keep(batch, _):
        seen.update({r["address"]: r["id"] for r in batch.collect()})

    for part in (rows[1:2], rows[:1], rows[2:]):  # the deletion comes before what it deletes
        stream = ingest.newest_versions(serve("versions", part))
        stream.writeStream.foreachBatch(keep).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "v")).start().awaitTermination(120)
    assert {k: v for k, v in seen.items() if v} == {f"30023:{B}:x": ident(4)}
    stream = ingest.newest_versions(serve("versions", [event(6, 30023, at=8, tags=x)]))
    stream.writeStream.foreachBatch(keep).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "v")).start().awaitTermination(120)
    assert seen[f"30023:{A}:x"] == ident(6)

    store = open_store(spark, str(tmp_path / "store"), clock=lambda: 1000, buckets=4)
    service, subject = "d" * 64, "c" * 64
    log = [event(10, 10040, A, 1, [["30382:rank", service, "r"]]), event(11, 30382, service, 10, [["d", subject], ["rank", "8"]]), event(12, 30382, service, 9, [["d", subject], ["rank", "3"]])]
    ingest.into_store(serve("log", log), store, str(tmp_path / "cp")).awaitTermination(200)
    assert [tuple(r) for r in store.reputation_of(subject).collect()] == [(A, 8, None)] and store.pending_trust() == 0
    assert store.get(ident(12)) is None  # the newest card of its address stays


def test_a_second_writer_is_refused(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"), clock=lambda: 1000, buckets=2)
    store.insert(frame(spark, [event(1)], seq=True))
    other, commit = open_store(spark, str(tmp_path / "s"), clock=lambda: 1000, buckets=2), store.state._commit

    def late(*args):
        other.insert(frame(spark, [event(3)], seq=True))
        commit(*args)

    store.state._commit = late
    with pytest.raises(RuntimeError, match="another writer"):
        store.insert(frame(spark, [event(2)], seq=True))
    store.state._commit = commit
    store.insert(frame(spark, [event(4)], seq=True))
    assert {int(r["id"], 16) for r in store.events().collect()} == {1, 3, 4}


def test_rank_agreement(spark):
    from tidelog.operators.quality import agreement

    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "id string, place int")
    b = spark.createDataFrame([("b", 1), ("a", 2), ("x", 3), ("c", 4)], "id string, place int")
    assert tuple(agreement(a, b, (2, 3)).first()) == (1.0, 2 / 3, 1 / 3)
    assert tuple(agreement(a, a).first()) == (1.0, 1.0, 1.0) and tuple(agreement(a.limit(0), b).first()) == (1.0, 1.0, 1.0)
    assert agreement(a, b.limit(0), (2,)).first()["overlap_2"] == 0.0
