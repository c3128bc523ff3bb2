"""Benchmark decontamination: a broadcast set of normalised benchmark n-grams scanned over training token windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import cut, frugal, take
from .textbytes import SMALL_PIECE, buffers, gram_hashes, lean, lower_table, pieces, span_hashes, words

WINDOW = 10
#: Benchmark text that one pass holds in each Python worker, where it takes about eight times as much; a larger benchmark
#: is scanned in blocks of this size, one pass after the other.
BLOCK_BYTES = 8 << 20
LOWER = lower_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
INSIDE = np.arange(256) > 0


class Grams:
    """The windows of a block of benchmark items: for each length their sorted hashes, and where each stands in the items.

    Windows of one hash are one group; a group whose windows differ in words (a collision) is verified one by one.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.names = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        blobs, starts_, ends_, found = [], [], [], {}
        size = n_words = 0
        for item, text in items:
            data = LOWER[np.frombuffer(text, np.uint8)]
            starts, ends, _ = words(data, np.array([0, len(data)]), INSIDE)
            if not len(starts):
                continue
            n = min(window, len(starts))
            h = gram_hashes(span_hashes(data, starts, ends), n)
            found.setdefault(n, []).append((h, n_words + np.arange(len(h)), np.full(len(h), number[item], np.int32)))
            # Words one space apart, so that equal windows are equal bytes.
            length = ends - starts
            own = np.cumsum(length + 1) - length - 1
            blobs.append(b" ".join(data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)) + b" ")
            starts_.append(size + own)
            ends_.append(size + own + length)
            size += len(blobs[-1])
            n_words += len(starts)
        self.blob = b"".join(blobs)
        self.starts, self.ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts_, ends_))
        self.by_length = {}
        for n, parts in sorted(found.items()):
            h, at, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((item, h))
            h, at, item = h[order], at[order], item[order]
            keys, first = np.unique(h, return_index=True)
            first = np.append(first, len(h))
            many = np.flatnonzero(np.diff(first) > 1)
            mixed = {int(k) for k in many if len({self.window(w, n) for w in at[first[k] : first[k + 1]]}) > 1}
            slots = 1 << max(16, (8 * len(keys)).bit_length())
            seen = np.zeros(slots, bool)
            seen[(keys & np.uint64(slots - 1)).astype(np.int64)] = True
            self.by_length[n] = (keys, first, at, item, mixed, seen)

    def window(self, word: int, n: int) -> bytes:
        return self.blob[self.starts[word] : self.ends[word + n - 1]]

    def items(self, n: int, k: int, own: bytes) -> list[int]:
        """The items in which the window `own` stands, of group k."""
        _, first, at, item, mixed, _ = self.by_length[n]
        a, z = first[k], first[k + 1]
        if k in mixed:
            return [int(item[i]) for i in range(a, z) if self.window(at[i], n) == own]
        return np.unique(item[a:z]).tolist() if self.window(at[a], n) == own else []

    def scan(self, col: pa.Array) -> list[tuple[int, list[tuple[int, int, int, int]], set[str]]]:
        """For each text: its number of words; hit windows (first word, words, start and end byte); items that occur."""
        out = []
        for lo, hi in pieces(col, SMALL_PIECE):
            raw, offs = buffers(col.slice(lo, hi - lo))
            data = LOWER[raw]
            starts, ends, first = words(data, offs, INSIDE)
            h = span_hashes(data, starts, ends)
            hits: dict[int, tuple[list, set]] = {}
            for n, (keys, _, _, _, _, seen) in self.by_length.items():
                g = gram_hashes(h, n)
                at = np.flatnonzero(seen[(g & np.uint64(len(seen) - 1)).astype(np.int64)])
                k = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
                at, k = at[keys[k] == g[at]], k[keys[k] == g[at]]
                doc = np.searchsorted(first, at, "right") - 1
                for i, d, group in zip(at.tolist(), doc.tolist(), k.tolist(), strict=True):
                    if i + n > first[d + 1]:
                        continue
                    own = b" ".join(data[a:b].tobytes() for a, b in zip(starts[i : i + n], ends[i : i + n], strict=True))
                    if found := self.items(n, group, own):
                        spans, items = hits.setdefault(d, ([], set()))
                        spans.append((i - int(first[d]), n, int(starts[i] - offs[d]), int(ends[i + n - 1] - offs[d])))
                        items.update(found)
            out += [(int(first[d + 1] - first[d]), hits[d][0], {self.names[i] for i in hits[d][1]}) if d in hits else (int(first[d + 1] - first[d]), [], set()) for d in range(hi - lo)]
        return out


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the given byte spans."""
    if not spans or text is None:
        return text
    raw, kept, end = text.encode(), [], 0
    for a, b in sorted(spans):
        kept.append(raw[end:a] if a > end else b"")
        end = max(end, b)
    return b"".join([*kept, raw[end:]]).decode()


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Blocks of benchmark items, each of block_bytes or one item at most; the driver holds one block at a time."""
    rows = take(benchmark, i=item, t=text).where(F.col("t").isNotNull()).select(F.coalesce(F.col("i").cast("string"), F.lit("")).alias("i"), F.col("t").cast("binary").alias("t"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r["t"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["i"], bytes(r["t"])))
        size += len(r["t"])
    yield block


HITS = "struct<n_words:bigint,spans:array<struct<word:int,n:int,start:int,end:int>>,items:array<string>>"


def hit_rows(grams, at: int, kind: pa.DataType, keep: list[int], all_rows: bool):
    """mapInArrow: the columns `keep` of each row (or only of those with a hit), and the hits of the text in column `at`."""

    def run(batches):
        for b in batches:
            found = [{"n_words": n, "spans": [dict(zip(("word", "n", "start", "end"), s, strict=True)) for s in spans], "items": sorted(items)} for n, spans, items in grams.value.scan(b.column(at))]
            own = np.array([all_rows or bool(x["items"]) for x in found], bool)
            cols = [b.column(i).filter(pa.array(own)) for i in keep] if not all_rows else [b.column(i) for i in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x for x, o in zip(found, own, strict=True) if o], kind)], names=[*[b.schema.names[i] for i in keep], "_hits"])

    return lean(run)


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a column `hits` (struct of HITS).

    A benchmark of one block is scanned in one pass without a shuffle. Of a larger one each block is a pass of its own over
    a cut copy of docs, of which only hits are kept, and the passes are joined by row at the end; so no task and no driver
    holds more than a block.

    Words: runs of [0-9A-Za-z] and of bytes from 128 on, A-Z lower-cased. A window is `window` words of an item (all the
    words of a shorter one); items without words, or null, have none. Matches by hash are verified on the words. Null and
    empty texts have no words; texts are scanned whole, in pieces of whole texts. Positions are of words and of UTF-8 bytes
    in each text. Repeated rows get equal results, an item id that repeats is one item.
    """
    spark, names = docs.sparkSession, frugal(docs).columns
    out = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at = names.index(text)
    schema = out.withColumn("_hits", F.lit(None).cast(HITS)).schema
    kind = to_arrow_type(schema["_hits"].dataType)
    blocks = benchmark_blocks(benchmark, item, item_text, block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        grams = spark.sparkContext.broadcast(Grams(block, window))
        return out.mapInArrow(hit_rows(grams, at, kind, list(range(len(names))), True), schema).toDF(*names, "hits")
    rows = cut(out.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    passes = []
    while block is not None:
        grams = spark.sparkContext.broadcast(Grams(block, window))
        one = rows.select("_row", f"_c{at}").mapInArrow(hit_rows(grams, 1, kind, [0], not passes), f"_row long, _hits {HITS}")
        passes.append(cut(one, "hits"))
        grams.destroy()
        block, following = following, next(blocks, None)
    both = reduce(DataFrame.union, passes).groupBy("_row")
    merged = both.agg(F.struct(F.max("_hits.n_words").alias("n_words"), F.flatten(F.collect_list("_hits.spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hits.items")))).alias("items")).alias("_hits"))
    return rows.join(merged, "_row").drop("_row").toDF(*names, "hits")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Null and empty texts have no
    words, whole texts of any length are read, repeated rows get equal results; other columns are ignored."""
    hits = scan(take(docs, doc_id="doc_id", text="text"), benchmark, window=window, block_bytes=block_bytes)
    hit_words = F.size(F.array_distinct(F.flatten(F.transform("hits.spans", lambda s: F.sequence(s["word"], s["word"] + s["n"] - 1))))).cast("long")
    items = F.array_sort("hits.items")
    return hits.select("doc_id", F.col("hits.n_words").alias("n_words"), hit_words.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("hits.spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """docs with its own columns, without contaminated documents (remove="documents") or hit spans (remove="spans").

    Null and empty texts are never contaminated; overlapping hits are removed as one; repeated rows go or stay together."""
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    names, found = docs.columns, scan(docs, benchmark, text=text, window=window)
    plain = found.toDF(*[f"_c{i}" for i in range(len(names))], "_hits")
    if remove == "documents":
        return plain.where(F.size("_hits.spans") == 0).drop("_hits").toDF(*names)
    at = names.index(text)
    schema = plain.drop("_hits").schema

    def erase(batches):
        for b in batches:
            spans = [[(s["start"], s["end"]) for s in h["spans"]] for h in b.column(b.num_columns - 1).to_pylist()]
            new = pa.array([without(t, s) for t, s in zip(b.column(at).to_pylist(), spans, strict=True)], b.column(at).type)
            cols = list(b.columns[:-1])
            cols[at] = new
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return plain.mapInArrow(erase, schema).toDF(*names)
