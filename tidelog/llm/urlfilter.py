"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path.

The model is trained from a small table of labelled URLs that stands apart from the rules and from the judged pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import take
from .textbytes import buffers, gram_hashes, pieces

GRAMS = (3, 4, 5)
FEATURE_BITS = 16
#: Different labelled URLs that the fit reads at most: those with the smallest hash, as many of either label.
LABELLED_ROWS = 4_000
#: Words in the names of hosts to block and to allow, of which labelled_urls() makes the small labelled table.
BLOCK_WORDS = (
    "adult ads bets bingo bonus casino cheap clicks coupons crack dating escort farm free gamble hack jackpot keygen loans lottery "
    "pills poker porn pharma replica seo sex slots spam torrents track viagra warez win x xxx"
).split()
ALLOW_WORDS = (
    "academy archive art atlas bakery biology books botany bridge choir city college cooking council craft dance dental docs "
    "engineering ferry film forest garden geology harbor health history hotel journal kitchen law library maps market math medical "
    "museum music nature news observatory opera orchard paper physics poetry radio recipes river school science shop sport station "
    "studio teacher theatre travel university village weather wiki work"
).split()


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where no `://` stands."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(url)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(raw, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (name, verdict) of the longest rule that fits, else null. A rule fits its host and all subdomains."""
    order = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in order]
    pick = lambda field: F.coalesce(*[F.when(f, F.lit(field(r))) for f, r in zip(fits, order, strict=True)], F.lit(None).cast("string"))
    return F.struct(pick(lambda r: r.name).alias("name"), pick(lambda r: r.verdict).alias("verdict"))


def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of each `^host$path$`, and the number for each row."""
    import pyarrow.compute as pc

    joined = pc.binary_join_element_wise(pa.array(["^"] * len(host)), host, pa.array(["$"] * len(host)), path, pa.array(["$"] * len(host)), "")
    data, offs = buffers(joined)
    slots, owners = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        g = gram_hashes(data.astype(np.uint64) + np.uint64(n * 257), n)
        doc = np.searchsorted(offs, np.arange(len(g)), "right") - 1
        ok = np.arange(len(g)) + n <= offs[doc + 1]
        slots.append((g[ok] >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
        owners.append(doc[ok])
    if not slots:
        return np.zeros(0, np.int64), np.zeros(len(host), np.int64)
    slots, owners = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return slots[order], np.bincount(owners, minlength=len(host))


def means(slots: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[slots])])
    end = np.cumsum(counts)
    return (total[end] - total[end - counts]) / np.sqrt(np.maximum(counts, 1))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def block_probability(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for lo, hi in pieces(path, 1 << 20):
            s, c = features(host.slice(lo, hi - lo), path.slice(lo, hi - lo))
            out.append(1 / (1 + np.exp(-np.clip(self.bias + means(s, c, self.weights), -30, 30))))
        return np.concatenate(out)


def labelled_urls() -> list[tuple[str, bool]]:
    """The small labelled table of the query: (url, block), about 1,300 invented URLs with paths that tell nothing.

    To block: pairs of neighbouring BLOCK_WORDS at several distances. To allow: ALLOW_WORDS alone and in pairs.
    """
    near = lambda words, steps: [(a, words[(i + s) % len(words)]) for s in steps for i, a in enumerate(words)]
    hosts = [(f"{a}-{b}", True) for a, b in near(BLOCK_WORDS, (1, 2, 3, 5, 8, 13, 21))]
    hosts += [(a, False) for a in ALLOW_WORDS for _ in range(8)] + [(f"{a}{j}{b}", False) for j in ("-", "") for a, b in near(ALLOW_WORDS, (1, 4, 9))]
    out = []
    for i, (name, block) in enumerate(hosts):
        front, top, lang = ("", "www.", "m.", "blog.")[i % 4], ("com", "net", "org")[i // 4 % 3], ("en", "de", "fr", "es")[i // 12 % 4]
        out.append((f"http://{front}{name}.example.{top}/{lang}/{i * 37 % 9000}", block))
    return out


def fit(labelled: DataFrame, *, url: str = "url", block: str = "block", rows: int = LABELLED_ROWS, rounds: int = 200, rate: float = 0.3, decay: float = 1e-5) -> Model:
    """Full-batch descent, each weight's steps scaled by the root of its squared gradients so far, on at most `rows` different labelled URLs (booleans; null labels teach nothing).

    A URL that repeats is read once and weighs the root of its number, so that one hot URL neither fills the sample nor
    outweighs it. Without both labels among them the model knows no difference: weights 0, and a bias towards the one label
    seen (none: -1, allow). Equal input gives equal weights: rows are read in order of their hash and URL.
    """
    host, path = host_and_path(F.col("u"))
    t = take(labelled, u=url, b=block).where("b is not null").select(host.alias("h"), path.alias("p"), F.col("b").cast("boolean").alias("b"))
    t = t.groupBy("h", "p", "b").agg(F.sqrt(F.count(F.lit(1))).alias("weight"))
    parts = [t.where(F.col("b") == v).orderBy(F.xxhash64("h", "p"), "h", "p").limit(rows // 2) for v in (True, False)]
    seen = reduce(DataFrame.union, parts).toArrow()
    y = seen["b"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << FEATURE_BITS), 1.0 if y.any() else -1.0)
    slots, counts = features(seen["h"].combine_chunks(), seen["p"].combine_chunks())
    w, bias = np.zeros(1 << FEATURE_BITS), 0.0
    past, past_bias = np.full(len(w), 1e-12), 1e-12
    owner, scale, weight = np.repeat(np.arange(len(y)), counts), 1 / np.sqrt(np.maximum(counts, 1)), seen["weight"].to_numpy()
    weight = weight / weight.sum()
    for _ in range(rounds):
        gap = (1 / (1 + np.exp(-np.clip(bias + means(slots, counts, w), -30, 30))) - y) * weight
        slope = np.bincount(slots, (gap * scale)[owner], minlength=len(w)) + decay * w
        past += slope * slope
        past_bias += gap.sum() ** 2
        w -= rate * slope / np.sqrt(past)
        bias -= rate * gap.sum() / np.sqrt(past_bias)
    return Model(w, float(bias))


def judge(pages: DataFrame, model: Model, rules: Sequence[Rule] = RULES, *, key: str = "page_id", url: str = "url", threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability for each row of pages; null URLs have an empty host and path.

    verdict: the longest fitting rule's (ties: the name that sorts first), else block where the model's probability is
    above the threshold. One pass, no shuffle; whole URLs are read, however long; repeated rows get equal results, an
    empty table an empty one, and other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = take(pages, page_id=key, url=url).select("page_id", host.alias("host"), path.alias("path"))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule["name"].alias("rule"), rule["verdict"].alias("_v"))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = rows.withColumn("block_probability", F.lit(0.0)).schema

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.block_probability(b.column(1), b.column(2)))], names=[*b.schema.names, "block_probability"])

    verdict = F.coalesce("_v", F.when(F.col("block_probability") > threshold, "block").otherwise("allow"))
    return rows.mapInArrow(run, schema).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_probability")


def report(pages: DataFrame) -> DataFrame:
    """judge() by RULES and a model of labelled_urls(), which neither the rules nor the pages enter."""
    return judge(pages, fit(pages.sparkSession.createDataFrame(labelled_urls(), "url string, block boolean")))
