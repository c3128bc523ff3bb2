"""Language ID: bit-sliced Bloom filters whose slots hold a bitmask of the languages that contain an n-gram.

One lookup of an n-gram returns all its languages. For each text the set bits are counted by language, each count is
corrected for that language's false positives, and the language with the largest corrected share wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, frugal, local, take
from .textbytes import SMALL_PIECE, buffers, lean, pieces

GRAM = 4
#: Labelled rows of each language that the fit reads: those with the smallest hash of (id, text).
SAMPLE_ROWS = 2_000
#: A filter has SLOTS_EACH slots for each n-gram of the language that has most, in powers of two between these: beyond
#: the largest a filter drops nothing, but has more false positives, which are measured and corrected.
SLOTS_EACH = 8
SLOT_BITS = (16, 22)
SEEDS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
UNKNOWN = "und"


def _lower_pairs() -> np.ndarray:
    """For each character of two UTF-8 bytes the bytes of its lower case, or its own where that has another length."""
    both = [(chr(c).encode(), chr(c).lower().encode()) for c in range(0x80, 0x800)]
    return np.array([list(low if len(low) == 2 else own) for own, low in both], np.uint8)


LOWER_PAIRS = _lower_pairs()


def normal(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space before and after each; A-Z and capitals of two bytes (Latin, Greek, Cyrillic) lower-cased, other
    ASCII made spaces."""
    n = len(offs) - 1
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    new = offs + 2 * np.arange(n + 1)
    at = np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(offs))
    table = np.full(256, 32, np.uint8)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    out[at] = table[data]
    lead = np.flatnonzero((out >= 0xC2) & (out <= 0xDF))
    pair = (out[lead].astype(np.int64) - 0xC2) * 64 + (out[lead + 1] - 0x80)
    out[lead], out[lead + 1] = LOWER_PAIRS[pair, 0], LOWER_PAIRS[pair, 1]
    return out, new


def codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each GRAM bytes as a uint32, and where each text's n-grams start; those across texts or inside blanks are 0."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    g = np.zeros(len(data) - GRAM + 1, np.uint32)
    for i in range(GRAM):
        g |= data[i : len(g) + i].astype(np.uint32) << np.uint32(8 * i)
    # Two blanks meet only between texts or where other signs stood: such n-grams say nothing.
    pair = (data[:-1] == 32) & (data[1:] == 32)
    dead = pair[: len(g)].copy()
    for i in range(1, GRAM - 1):
        dead |= pair[i : len(g) + i]
    g[dead] = 0
    return g, np.minimum(offs, len(g))


def has_letter(col: pa.Array) -> np.ndarray:
    data, offs = buffers(col)
    ascii_ = np.zeros(256, bool)
    ascii_[65:91] = ascii_[97:123] = True
    some = np.diff(offs) > 0
    out = np.zeros(len(col), bool)
    if some.any():
        out[some] = np.logical_or.reduceat(ascii_[data], offs[:-1][some])
    for i in np.flatnonzero(~out & some):
        out[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # slots x slices of 64 languages (or one slice of 8, 16 or 32)
    false: np.ndarray  # each language's rate of false positives

    @property
    def bits(self) -> int:
        return len(self.table).bit_length() - 1

    def predict(self, col: pa.Array) -> tuple[list[str], list[float], list[int | None]]:
        """Language, score and number of n-grams (None without a letter) of each text."""
        names, scores, grams = [], [], []
        for lo, hi in pieces(col, SMALL_PIECE):
            part = col.slice(lo, hi - lo)
            letters = has_letter(part)
            data, offs = normal(*buffers(part))
            g, first = codes(data, offs)
            live = g != 0
            n = np.diff(np.concatenate([[0], np.cumsum(live)])[first])
            rate = np.zeros((hi - lo, len(self.langs)))
            width = self.table.dtype.itemsize * 8
            for s in range(self.table.shape[1]):
                mask = self.table[slots(g, 0, self.bits), s]
                for k in range(1, len(SEEDS)):
                    mask &= self.table[slots(g, k, self.bits), s]
                mask[~live] = 0
                for l in range(s * width, min(len(self.langs), (s + 1) * width)):
                    bits = np.concatenate([[0], np.cumsum((mask >> self.table.dtype.type(l - s * width)) & self.table.dtype.type(1), dtype=np.int64)])
                    rate[:, l] = np.diff(bits[first]) / np.maximum(n, 1)
            fixed = np.clip((rate - self.false) / (1 - self.false), 0, 1)
            best = fixed.argmax(1) if self.langs else np.zeros(hi - lo, int)
            for i, ok in enumerate(letters):
                names.append(self.langs[best[i]] if ok and self.langs else UNKNOWN)
                scores.append(float(fixed[i, best[i]]) if ok and self.langs else 0.0)
                grams.append(int(n[i]) if ok else None)
        return names, scores, grams


def slots(g: np.ndarray, k: int, bits: int) -> np.ndarray:
    h = g * SEEDS[k]
    return (h ^ (h << np.uint32(13))) * SEEDS[(k + 1) % len(SEEDS)] >> np.uint32(32 - bits)


def slot_bits(grams: int) -> int:
    """Bits of a slot number for languages of so many n-grams at most."""
    return min(max(SLOT_BITS[0], (SLOTS_EACH * max(1, grams) - 1).bit_length()), SLOT_BITS[1])


def slot_width(langs: int) -> int:
    return next((w for w in (8, 16, 32, 64) if langs <= w), 64)


def slot_rows(bits: int, width: int):
    """mapInArrow over (g, i: a language's number): slot, slice and the bits that they set, merged in each batch."""

    def run(batches):
        for b in batches:
            g, i = b.column(0).to_numpy().astype(np.uint32), b.column(1).to_numpy().astype(np.int64)
            at = np.concatenate([slots(g, k, bits).astype(np.int64) for k in range(len(SEEDS))]) << 32 | np.tile(i // width, len(SEEDS))
            mask = np.uint64(1) << np.tile(i % width, len(SEEDS)).astype(np.uint64)
            order = np.argsort(at, kind="stable")
            start = np.flatnonzero(np.diff(at[order], prepend=-1))
            merged = np.bitwise_or.reduceat(mask[order], start) if len(start) else mask
            at = at[order][start]
            yield pa.RecordBatch.from_arrays([pa.array(at >> 32), pa.array(at & 0xFFFFFFFF), pa.array(merged.view(np.int64))], names=["slot", "part", "mask"])

    return run


def build(langs: list[str], bits: int, rows: Iterable[pa.RecordBatch]) -> Model:
    """The model whose filters have the bits of rows (slot, part, mask) set."""
    width = slot_width(len(langs))
    table = np.zeros((1 << bits, -(-max(1, len(langs)) // width)), f"u{width // 8}")
    for b in rows:
        table[b.column(0).to_numpy(), b.column(1).to_numpy()] |= b.column(2).to_numpy().view(np.uint64).astype(table.dtype)
    fill = [((table[:, i // width] >> table.dtype.type(i % width)) & table.dtype.type(1)).mean() for i in range(len(langs))]
    return Model(langs, table, np.array(fill) ** len(SEEDS))


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE_ROWS) -> Model:
    """Learn from `sample` rows of each language at most (those with the smallest hashes, ties by key), on the executors.

    A language's filter holds every n-gram that it uses at a fourth of any other's rate at least; the driver only gets
    the filters. Rows with null text or language teach nothing; without any row the model predicts `und` for every text.
    Repeated rows count as often as they are sampled. Languages stand by their number of sampled rows, the commonest
    first, so that ties go to the commonest. Whole texts are read, however long.
    """
    rows = take(labelled, lang=lang, text=text, id=key).where("lang is not null and text is not null")
    total = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total:
        return build([], SLOT_BITS[0], [])
    # A hash threshold that keeps twice the wanted rows bounds what is sorted; smaller languages keep all.
    share = F.create_map(*[F.lit(x) for l, n in total.items() for x in (l, min(1.0, 2.0 * sample / n))])
    unit = F.shiftrightunsigned(F.xxhash64("id", "text"), 11) / F.lit(float(1 << 53))
    near = rows.withColumn("u", unit).where(F.col("u") <= share[F.col("lang")])
    kept = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "id"))).where(F.col("r") <= sample).select("lang", "text")

    def count(batches):
        for b in batches:
            by: dict[str, Counter] = {}
            rows: Counter = Counter()
            langs = b.column(0).to_pylist()
            rows.update(langs)
            for l in rows:
                own = b.column(1).filter(pa.array([x == l for x in langs]))
                for lo, hi in pieces(own, 4 * SMALL_PIECE):
                    g, c = np.unique(codes(*normal(*buffers(own.slice(lo, hi - lo))))[0], return_counts=True)
                    by.setdefault(l, Counter()).update(dict(zip(g.tolist(), c.tolist(), strict=True)))
            for l, own in by.items():
                own.pop(0, None)
                n = len(own)
                yield pa.RecordBatch.from_pydict({"lang": [l] * (n + 1), "g": [0, *own.keys()], "c": [rows[l], *own.values()]}, pa.schema([("lang", pa.string()), ("g", pa.int64()), ("c", pa.int64())]))

    spark, live = rows.sparkSession, F.col("g") != 0
    sums = cut(kept.mapInArrow(lean(count), "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c")), "langid")
    sizes = sums.groupBy("lang").agg(F.sum(F.when(~live, F.col("c"))).alias("texts"), F.sum(F.when(live, F.col("c"))).alias("total"), F.count(F.when(live, 1)).alias("grams")).collect()
    sizes = sorted(sizes, key=lambda r: (-r["texts"], r["lang"]))
    langs, bits = [r["lang"] for r in sizes], slot_bits(max(r["grams"] for r in sizes))
    # One row a language.
    order = F.broadcast(local(spark, [(r["lang"], i, float(max(1, r["total"] or 0))) for i, r in enumerate(sizes)], "lang string, i long, total double"))
    rated = sums.where(live).join(order, "lang").select("g", "i", (F.col("c") / F.col("total")).alias("rate"))
    high = rated.groupBy("g").agg(F.max("rate").alias("high"))
    own = rated.join(high, "g").where(4 * F.col("rate") >= F.col("high")).select("g", "i")
    masks = own.mapInArrow(slot_rows(bits, slot_width(len(langs))), "slot long, part long, mask long").groupBy("slot", "part").agg(F.bit_or("mask").alias("mask"))
    return build(langs, bits, masks.toArrow().to_batches())


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with three columns at the end: lang_pred (und if text is null or has no letter), score (0 to 1) and grams.

    grams is the number of n-grams that the score rests on, null if text is null or has no letter.

    One pass without a shuffle; the whole text, however long, decides alone, so repeated rows get equal results. Ties go to
    the language that is commonest in the sample. An empty table gives an empty result; all columns of docs are kept.
    """
    names = frugal(docs).columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at, shared = names.index(text), docs.sparkSession.sparkContext.broadcast(model)
    schema = plain.withColumns({"_lang": F.lit("").cast("string"), "_score": F.lit(0.0), "_grams": F.lit(None).cast("long")}).schema

    def run(batches):
        for b in batches:
            names_, scores, grams = shared.value.predict(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names_, pa.string()), pa.array(scores, pa.float64()), pa.array(grams, pa.int64())], names=[*b.schema.names, "_lang", "_score", "_grams"])

    return plain.mapInArrow(lean(run), schema).toDF(*names, "lang_pred", "score", "grams")


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def report(docs: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; a null doc_id counts as empty text in the crc32. Null, empty and very
    long texts, ties and repeated rows as in predict(); rows with null lang teach nothing; other columns are ignored."""
    rows = take(docs, doc_id="doc_id", text="text", lang="lang")
    model = fit(rows.where(~held_out("doc_id")), sample=sample)
    return predict(rows.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
