"""PII by bootstrapped contextual extraction.

Entities of four base forms are the seeds. The words around each identifier-like token are its patterns; patterns and
instances form a graph in which confidence spreads from seeds to patterns and from patterns to tokens that have no base
form. Tokens whose confidence is high become spans of that kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, take
from .textbytes import buffers

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")
#: Runs without white space, of which those with at least four digits or an @ are identifier-like.
TOKEN = re.compile(r"\S+")
#: Longer instances go by a digest, so that a row of the graph is short however long a token is.
LONGEST_NAME = 200
#: Groups of digits joined by single spaces, dots, hyphens, slashes or brackets, from the edge of a token or a label on.
_DIGITS = r"[0-9]++(?![\w@])"
GROUPS = re.compile(rf"(?<![^\s:=#(\[{{<\"'`,;])\+?\(?{_DIGITS}(?:(?:[\x20./-]|\)[\x20./-]?|[\x20./-]?\(){_DIGITS})++")
#: More digits than any identifier has (an IBAN's 34): a list of numbers.
MOST_DIGITS = 34
#: An e-mail address with its at-sign in words, its dots too or not. RE2 reads it too, and finds the texts that have one.
_AT = r"[A-Za-z0-9._%+-]+(?:[\x20\t]?[\[({<][\x20\t]?[Aa][Tt][\x20\t]?[\])}>][\x20\t]?|[\x20\t][Aa][Tt][\x20\t])[A-Za-z0-9-]+(?:(?:[\x20\t]?[\[({<][\x20\t]?[Dd][Oo][Tt][\x20\t]?[\])}>][\x20\t]?|[\x20\t][Dd][Oo][Tt][\x20\t]|\.)[A-Za-z0-9-]+)+"
AT_WORDS = re.compile(rf"(?<![A-Za-z0-9._%+-]){_AT}")
EDGE = "\"'`.,;:!?()[]{}<>"
#: A pattern counts from this many different seed instances on; a token, from this confidence on.
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.8


def emails(text: str) -> list[tuple[int, int]]:
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            pos = m.end()
        at = text.find("@", max(at + 1, pos))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str, digits: bool = True, at: bool = True) -> list[tuple[int, int, int]]:
    """(start, end, kind) in order of start, then kind; code points, end exclusive."""
    out = [(a, z, 0) for a, z in emails(text)] if at else []
    if digits:
        out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            d = DIGITS.sub("", m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(DIGITS.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def words_before(text: str, at: int, n: int) -> list[str]:
    return [w.strip(EDGE).lower() for w in text[max(0, at - 80) : at].split()[-n:]]


def instance(text: str, kind: int) -> str:
    """What makes two mentions one: the kind of form, and the whole text in lower case, or + and digits where it is a number.

    Dotted texts keep their dots: 10.1.2.3 is not 1.0.12.3.
    """
    form = KINDS[kind] if kind >= 0 else "token"
    number = not re.search(r"[^\W\d_]|@", text) and not re.fullmatch(r"[0-9]+(?:\.[0-9]+)+", text)
    name = "+" * text.startswith("+") + DIGITS.sub("", text) if number else " ".join(text.lower().split())
    return f"{form} {name if len(name) <= LONGEST_NAME else hashlib.sha256(name.encode()).hexdigest()}"


def wide(text: str) -> list[tuple[int, int]]:
    """(start, end) of identifier-like mentions with spaces inside, in order and apart."""
    out = [(m.start(), m.end()) for m in AT_WORDS.finditer(text)]
    taken = {c for a, z in out for c in range(a, z)}
    for m in GROUPS.finditer(text):
        a = m.start() + (m[0].lstrip("+").startswith("(") and ")" not in m[0])
        if " " in m[0] and 4 <= sum(c in "0123456789" for c in m[0]) <= MOST_DIGITS and m.start() not in taken and m.end() - 1 not in taken:
            out.append((a, m.end()))
    return sorted(out)


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str], str, int]]:
    """Base entities and other identifier-like mentions: (start, end, kind or -1, instance, patterns, slot, slot's start).

    A mention with spaces inside and the tokens within it are readings of one slot, which has the name and start of the
    former; any other mention is a slot of its own.
    """
    found = [(a, z, k) for a, z, k in spans]
    ends = sorted((a, z) for a, z, _ in spans)
    starts = np.array([a for a, _ in ends])
    reach = np.maximum.accumulate(np.array([z for _, z in ends])) if ends else None
    free = lambda a, z: not ends or (i := int(np.searchsorted(starts, z, "left")) - 1) < 0 or reach[i] <= a
    slots = [(a, z) for a, z in wide(text) if free(a, z)]
    found += [(a, z, -1) for a, z in slots]
    whole, slot_starts = set(slots), [a for a, _ in slots]
    for m in TOKEN.finditer(text):
        if "@" not in m[0] and len(DIGITS.sub("", m[0])) < 4:
            continue
        own = m[0].strip(EDGE)
        a = m.start() + (len(m[0]) - len(m[0].lstrip(EDGE)))
        z = a + len(own)
        if "@" not in own and len(DIGITS.sub("", own)) < 4:
            continue
        if free(a, z) and (a, z) not in whole:
            found.append((a, z, -1))
    out = []
    for a, z, k in found:
        left = words_before(text, a, 2)
        right = [w.strip(EDGE).lower() for w in text[z : z + 40].split()[:1]]
        inner = re.match(r"[^0-9@]*[:=#]", text[a:z])
        begin = text[max(0, a - 40) : a].split("\n")[-1].rsplit(" ", 1)[-1] if a and not text[a - 1].isspace() else ""
        patterns = []
        if len(left) == 2 and all(left):
            patterns.append(f"left {left[0]} {left[1]}")
        if left and left[-1] and right and right[0]:
            patterns.append(f"around {left[-1]} _ {right[0]}")
        if inner or re.search(r"[:=#]\Z", begin):
            patterns.append(f"glued {(begin or inner[0]).lower()}")
        elif a > 1 and re.search(r"[:=#]\s?\Z", text[max(0, a - 2) : a]) and left:
            patterns.append(f"label {left[-1]}")
        i = bisect_left(slot_starts, z) - 1 if k < 0 else -1
        b, y = slots[i] if i >= 0 and slots[i][1] > a else (a, z)
        out.append((a, z, k, instance(text[a:z], k), patterns, instance(text[b:y], k), b))
    return out


SCAN = pa.struct([("a", pa.int64()), ("z", pa.int64()), ("k", pa.int32()), ("i", pa.string()), ("p", pa.list_(pa.string())), ("w", pa.string()), ("b", pa.int64())])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id and mentions (array) of each row: one pass over whole texts, cut in the shared folder."""
    rows = take(docs, doc_id=key, text=text).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, offs = buffers(b.column(2))
            digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])[offs]
            at = np.concatenate([[0], np.cumsum(data == 64)])[offs]
            digit, at = np.diff(digit) > 0, np.diff(at) > 0
            spelled = pc.fill_null(pc.match_substring_regex(b.column(2), _AT), False).to_numpy(zero_copy_only=False)
            out: list[list] = [[] for _ in range(b.num_rows)]
            for i in np.flatnonzero(digit | at | spelled):
                t = b.column(2)[int(i)].as_py()
                out[i] = [dict(zip(("a", "z", "k", "i", "p", "w", "b"), m, strict=True)) for m in mentions(t, base_spans(t, digit[i], at[i]))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(SCAN))], names=["row", "doc_id", "m"])

    return cut(rows.mapInArrow(run, f"row long, doc_id {id_type}, m array<struct<a:long,z:long,k:int,i:string,p:array<string>,w:string,b:long>>"), "pii")


def confident(edges: DataFrame, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(pattern, kind, conf) of confident patterns, from edges (pattern, instance, kind or -1, slot), distinct.

    Instances with and without a base form never share a name, so that none leaves the search for another one's sake.
    A pattern's confidence in a kind: the number of its seeds by that of its instances plus one, where the readings of
    one slot count once; it needs `min_seeds` different seeds and MIN_CONFIDENCE. An instance that stands in a confident
    pattern is a seed of the rounds that follow, for all its patterns, so that patterns which no base form has count too;
    seeds only become more, and the rounds end when none is added. Each only aggregates and joins by pattern or instance.
    """
    # A pattern with fewer instances can never have enough seeds.
    sizes = cut(edges.groupBy("pattern").agg(F.countDistinct("slot").alias("size")).where(F.col("size") >= min_seeds), "pii-sizes")
    seeds = cut(edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.countDistinct("instance").alias("seeds")).join(sizes.select("pattern"), "pattern"), "pii-seeds")
    open_ = cut(edges.where("kind < 0").select("pattern", "instance", "slot").distinct().join(sizes.select("pattern"), "pattern"), "pii-open")
    accepted, known = None, 0
    while True:
        more = seeds
        if accepted is not None:
            more = seeds.unionByName(open_.join(accepted, "instance").groupBy("pattern", "kind").agg(F.countDistinct("slot").alias("seeds"))).groupBy("pattern", "kind").agg(F.sum("seeds").alias("seeds"))
        patterns = more.where(F.col("seeds") >= min_seeds).join(sizes, "pattern").withColumn("conf", F.col("seeds") / (F.col("size") + 1)).where(F.col("conf") >= MIN_CONFIDENCE)
        patterns = cut(patterns.select("pattern", "kind", "conf"), "pii-patterns")
        accepted = cut(open_.join(patterns, "pattern").select("instance", "kind").distinct(), "pii-accepted")
        before, known = known, accepted.count()
        if known == before:
            return patterns


def extract(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, base and spans: arrays of (start, kind number, end) in order, for each row of docs.

    Null and empty texts have none; whole texts are read, in time that grows with their length. Base spans always stay;
    the method's have the kind of the patterns around them (ties: the kind that stands first). Equal rows get equal spans;
    null ids are kept; other columns are ignored.
    """
    found = scan(docs, key, text)
    long = found.select("row", F.explode("m").alias("m")).select("row", "m.*")
    edges = cut(long.select(F.explode("p").alias("pattern"), F.col("i").alias("instance"), F.col("k").alias("kind"), F.col("w").alias("slot")).distinct(), "pii-edges")
    good = confident(edges)
    # Each mention is judged by its own patterns: an equal one elsewhere, in no confident pattern, stays as it is.
    places = long.where("k < 0").select("row", "a", "z", "b", (F.col("i") != F.col("w")).alias("inner"), F.explode(F.array_distinct("p")).alias("pattern"))
    belief = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-9)))))
    by_kind = places.join(good, "pattern").groupBy("row", "a", "z", "b", "inner", "kind").agg(belief.alias("score"))
    found_ = by_kind.groupBy("row", "a", "z", "b", "inner").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"))
    # Of the readings of one slot the one with spaces stays, or those within it if one of them has a higher score.
    best = lambda inner: F.coalesce(F.max(F.when(F.col("inner") == inner, F.col("score"))).over(Window.partitionBy("row", "b")), F.lit(-1.0))
    kept = found_.withColumns({"whole": best(False), "part": best(True)}).where(F.col("inner") == (F.col("part") > F.col("whole")))
    new = kept.select("row", F.struct(F.col("a").alias("start"), F.col("kind").cast("int").alias("kind"), F.col("z").alias("end")).alias("s")).groupBy("row").agg(F.collect_list("s").alias("new"))
    base = F.array_sort(F.transform(F.filter("m", lambda x: x["k"] >= 0), lambda x: F.struct(x["a"].alias("start"), x["k"].alias("kind"), x["z"].alias("end"))))
    out = found.select("row", "doc_id", base.alias("base")).join(new, "row", "left")
    return out.select("row", "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("new", F.expr("cast(array() as array<struct<start:long,kind:int,end:long>>)")))).alias("spans"))


def redact(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text with every span replaced by [kind]; the row numbers of a cut copy tie texts and spans together.

    Null texts stay null, empty ones empty; of overlapping spans the first one stands; repeated rows give equal texts, and
    texts of any length are rewritten whole."""
    rows = cut(take(docs, doc_id=key, text=text).withColumn("n", F.monotonically_increasing_id()), "pii-text")
    spans = extract(rows, key="n", text="text").select(F.col("doc_id").alias("n"), "spans")
    both = rows.join(spans, "n").select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            new = []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                parts, end = [], 0
                for x in s or []:
                    if x["start"] >= end:
                        parts += [t[end : x["start"]], f"[{KINDS[x['kind']]}]"]
                        end = x["end"]
                new.append(None if t is None else "".join([*parts, t[end:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], names=["doc_id", "text"])

    return both.mapInArrow(run, both.select("doc_id", "text").schema)


def joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (all of them) for each row of docs; odd rows as in
    extract()."""
    out = extract(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
