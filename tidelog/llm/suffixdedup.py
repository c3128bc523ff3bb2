"""Removal of repeated byte strings by difference-cover suffix sorting, dealt out over the cluster.

A suffix matters only if its first `length` bytes also start elsewhere. Equal strings choose equal anchors (the smallest
hash of a GRAM-byte string inside them, leftmost first), so suffixes are dealt by their anchor, and those whose anchor
occurs once leave at once; that loses nothing. The rest are sorted where their anchor's pieces meet:

* positions are counted from the anchor; those with remainder 1 and 2 modulo 3 are the difference-cover sample;
* the sampled suffixes' first words are sorted and named, then triples of names are sorted and named again, each
  recursion tripling the covered prefix, until the names cover `length` bytes less one;
* the remaining suffixes (remainder 0) are merged in by their first byte and the name of the sampled suffix after it;
* in sorted order neighbours with equal prefixes of `length` bytes are the repeats.

Names are ranks, so equality is exact and not a matter of hashes once pieces of one anchor have met.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import buckets, cut, take
from .textbytes import U64, buffers, mix, pieces, powers, runs

LENGTH = 400
GRAM = 100
LONG = 8 << 20
BUCKET_BYTES = 12 << 20
PIECE_BYTES = 4 << 20


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """Of all windows of `length` bytes inside texts: text, anchor position, anchor hash, first and last window start."""
    none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U64),) + (np.zeros(0, np.int64),) * 2
    if len(data) < length:
        return none
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * p[: len(data)], out=total[1:])
    n = len(data) - gram + 1
    h = mix((total[gram:] - total[:-gram]) * q[:n])
    w = length - gram + 1
    packed = (h & ~U64((1 << 24) - 1)) | np.arange(n, dtype=U64)
    pad = np.full(-(-n // w) * w, ~U64(0), U64)
    pad[:n] = packed
    block = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    start = np.concatenate([np.arange(a, z - length + 1) for a, z in zip(offs[:-1], offs[1:], strict=True) if z - a >= length] or [np.zeros(0, np.int64)])
    if not len(start):
        return none
    pick = (np.minimum(behind[start], ahead[start + w - 1]) & U64((1 << 24) - 1)).astype(np.int64)
    doc = np.searchsorted(offs, start, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    return doc[new], pick[new], h[pick[new]], start[new], start[last]


def text_anchors(col: pa.Array, length: int, gram: int):
    """anchors() over an array, piece by piece, with positions counted from each text's start; long texts go in overlapping parts."""
    for lo, hi in pieces(col):
        data, offs = buffers(col.slice(lo, hi - lo))
        if len(data) <= LONG + length:
            doc, pos, h, a, z = anchors(data, offs, length, gram)
            yield lo + doc, pos - offs[doc], h, a - offs[doc], z - offs[doc], data, offs, lo, 0
            continue
        for at in range(0, len(data) - length + 1, LONG):
            part = data[at : at + LONG + length - 1]
            doc, pos, h, a, z = anchors(part, np.array([0, len(part)]), length, gram)
            yield lo + doc, pos + at, h, a + at, z + at, part, np.array([0, len(part)]), lo, at


def deal(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ U64(0xA5A5A5A5)) % U64(n)).astype(np.int64)


SENT = "kind int, bucket int, hashes binary, texts binary, places binary, sure binary"


def anchor_rows(n_buckets: int, length: int, gram: int):
    """mapInArrow over (text key, text): kind 0: anchors for each bucket; kind 1: places already known to recur.

    Each batch sends an anchor once. Where it occurs more often in the batch its places recur for sure; one of them is
    still sent, marked, for places elsewhere. So a passage in a third of all texts costs one entry for each batch.
    """

    def run(batches):
        for b in batches:
            keys = b.column(0).to_numpy()
            once = np.zeros(len(keys), bool)
            once[np.unique(keys, return_index=True)[1]] = True
            found = [(d, p, x) for d, p, x, *_ in text_anchors(b.column(1), length, gram)]
            if not found:
                continue
            doc, pos, h = (np.concatenate(x) for x in zip(*found, strict=True))
            keep = once[doc]
            k, pos, h = keys[doc[keep]], pos[keep], h[keep]
            if not len(k):
                continue
            order = np.lexsort((pos, k, h))
            k, pos, h = k[order], pos[order], h[order]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            count = np.diff(np.append(np.flatnonzero(first), len(h)))
            sure = np.repeat(count > 1, count)
            rows: list[list] = [[], [], [], [], [], []]

            def add(kind, bucket, h, k, pos, sure, rows=rows):
                for r, x in zip(rows, (kind, bucket, h.tobytes(), k.tobytes(), pos.astype(np.int64).tobytes(), sure.tobytes()), strict=True):
                    r.append(x)

            if sure.any():
                add(1, -1, h[sure][:0], k[sure], pos[sure], sure[:0])
            k, pos, h, sure = k[first], pos[first], h[first], sure[first]
            to = deal(h, n_buckets)
            order = np.argsort(to, kind="stable")
            for a, z in runs(to[order]):
                o = order[a:z]
                add(0, int(to[o[0]]), h[o], k[o], pos[o], sure[o])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["kind", "bucket", "hashes", "texts", "places", "sure"])

    return run


def _by_text(k: np.ndarray, pos: np.ndarray) -> pa.Table:
    order = np.lexsort((pos, k))
    k, pos = k[order], pos[order]
    own = runs(k)
    return pa.table({"key": pa.array([int(k[a]) for a, _ in own], pa.int64()), "places": pa.array([pos[a:z].tobytes() for a, z in own], pa.binary())})


def recurring(t: pa.Table) -> pa.Table:
    """For a bucket: places whose anchor occurs elsewhere too, by text; those known to their batch are left out."""
    h, k, pos, sure = (np.concatenate([np.frombuffer(x, d) for x in t[c].to_pylist()]) for c, d in (("hashes", U64), ("texts", np.int64), ("places", np.int64), ("sure", bool)))
    order = np.lexsort((pos, k, h))
    h, k, pos, sure = h[order], k[order], pos[order], sure[order]
    # Copies of a text in several batches send the same places: they count once here, and by their number at the end.
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1]) | (pos[1:] != pos[:-1])])
    at = np.flatnonzero(new)
    sure = np.logical_or.reduceat(sure, at)
    h, k, pos = h[at], k[at], pos[at]
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[:-1] |= same[1:]
    return _by_text(k[same & ~sure], pos[same & ~sure])


def piece_rows(n_buckets: int, length: int, gram: int):
    """mapInArrow over (key, text, copies, lists of places): for each bucket the pieces around its recurring anchors."""

    def run(batches):
        for b in batches:
            keys, copies = b.column(0).to_numpy(), b.column(2).to_numpy()
            known = [np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in (p.as_py() or [])] or [np.zeros(0, np.int64)])) for p in b.column(3)]
            for doc, pos, h, a, z, data, offs, lo, at in text_anchors(b.column(1), length, gram):
                ok = np.zeros(len(doc), bool)
                for d in np.unique(doc):
                    own = slice(*np.searchsorted(doc, [d, d + 1]))
                    ok[own] = np.isin(pos[own], known[d])
                ok |= copies[doc] > 1
                doc, pos, h, a, z = doc[ok], pos[ok], h[ok], a[ok], z[ok]
                if not len(doc):
                    continue
                to = deal(h, n_buckets)
                order = np.argsort(to, kind="stable")
                rows: list[list] = [[], [], []]
                for s, e in runs(to[order]):
                    o = order[s:e]
                    head = np.zeros(len(o), PIECE)
                    head["h"], head["k"], head["pos"], head["a"], head["n"], head["m"] = h[o], keys[doc[o]], pos[o], a[o], z[o] - a[o] + length, np.minimum(copies[doc[o]], 2)
                    base = offs[doc[o] - lo] - at
                    raw = b"".join(data[x : x + n].tobytes() for x, n in zip((base + a[o]).tolist(), head["n"].tolist(), strict=True))
                    for r, x in zip(rows, (int(to[o[0]]), head.tobytes(), pa.compress(raw, codec="zstd", asbytes=True)), strict=True):
                        r.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], names=["bucket", "head", "raw"])

    return run


PIECE = np.dtype([("h", U64), ("k", np.int64), ("pos", np.int64), ("a", np.int64), ("n", np.int32), ("m", np.int32)])


def names(*keys: np.ndarray) -> np.ndarray:
    """Ranks (from 1) of the rows of equally long key columns in sorted order; equal rows have equal names."""
    out = keys[0].astype(U64)
    for k in keys[1:]:
        out = np.unique(out, return_inverse=True)[1].astype(U64)
        k = k.astype(U64)
        if len(k) and int(k.max()) >= 1 << 32:
            k = np.unique(k, return_inverse=True)[1].astype(U64)
        out = (out << U64(32)) | k
    return np.unique(out, return_inverse=True)[1].astype(np.int64) + 1


def repeated_windows(x: np.ndarray, start: np.ndarray, n: np.ndarray, turn: np.ndarray, group: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """For each window (in order of piece and position) of the pieces x[start:start+n]: does its string stand in another one?

    turn: each piece's first position counted from its anchor, so that equal windows have equal remainders modulo 3.
    """
    size = len(x)
    piece = np.repeat(np.arange(len(n)), n)
    place = np.arange(size) - np.repeat(start, n)
    sample = (np.repeat(turn, n) + place) % 3 != 0
    room = np.repeat(n, n) - place  # bytes from here to the piece's end
    # First words: six bytes, sorted and named. Names of positions without enough room stay 0 and are never asked for.
    cover, word = 6, np.zeros(size, np.int64)
    at = np.flatnonzero(sample & (room >= cover))
    key = np.zeros(len(at), U64)
    for i in range(cover):
        key = (key << U64(8)) | x[at + i].astype(U64)
    word[at] = names(key)
    while 3 * cover <= length - 1:  # triples of names, sorted and named again
        at = np.flatnonzero(sample & (room >= 3 * cover))
        new = np.zeros(size, np.int64)
        new[at] = names(word[at], word[at + cover], word[at + 2 * cover])
        word, cover = new, 3 * cover
    # Steps by multiples of 3 from name to name stay in the sample; the bytes that they leave over are added one by one.
    far = (length - 1 - cover) // 3 * 3
    steps, last = [*range(0, far, cover), far], far + cover
    windows = np.flatnonzero(room >= length)
    own = sample[windows]
    found = np.zeros(size, bool)
    for sampled in (True, False):
        at = windows[own == sampled]
        if not len(at):
            continue
        body = at if sampled else at + 1
        done = last if sampled else last + 1
        extra = [x[at + i] for i in range(done, length)] + ([] if sampled else [x[at]])
        label = names(group[piece[at]], *[word[body + s] for s in steps], *extra)
        # In sorted order, equal prefixes of `length` bytes are neighbours; a piece that stands for several is its own.
        order = np.argsort(label, kind="stable")
        same = label[order][1:] == label[order][:-1]
        again = weight[piece[at]] > 1
        again[order[1:][same]] = again[order[:-1][same]] = True
        found[at] = again
    return found[windows]


def slices(todo: np.ndarray, group: np.ndarray, n: np.ndarray, limit: int = 1 << 21):
    """Parts of `limit` bytes at most, or one anchor's pieces: what is sorted at once is bounded."""
    held, size = [], 0
    for a, z in runs(group[todo]):
        own = todo[a:z]
        if held and size + n[own].sum() > limit:
            yield np.concatenate(held)
            held, size = [], 0
        held.append(own)
        size += int(n[own].sum())
    if held:
        yield np.concatenate(held)


def solve(length: int):
    """applyInArrow over the pieces of a bucket: (key, start, end) of the repeated bytes they show, merged in each piece."""

    def run(t: pa.Table) -> pa.Table:
        head = np.concatenate([np.frombuffer(x, PIECE) for x in t["head"].to_pylist()])
        sizes = [int(np.frombuffer(x, PIECE)["n"].sum()) for x in t["head"].to_pylist()]
        data = b"".join(pa.decompress(x, decompressed_size=s, codec="zstd", asbytes=True) for x, s in zip(t["raw"].to_pylist(), sizes, strict=True))
        x, start = np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(head["n"])]).astype(np.int64)
        # Equal pieces of one anchor are one piece with their summed weight.
        seen: dict[tuple, int] = {}
        rep = np.zeros(len(head), np.int64)
        for i, p in enumerate(head):
            key = (int(p["h"]), int(p["a"] - p["pos"]), hashlib.blake2b(data[start[i] : start[i + 1]], digest_size=16).digest())
            rep[i] = seen.setdefault(key, i)
        first, of = np.unique(rep, return_inverse=True)
        weight = np.bincount(of, weights=head["m"]).astype(np.int64)
        group = names(head["h"][first])
        # An anchor with one piece of weight 1 has nothing to meet; one whose pieces all recur is settled.
        single = np.bincount(group, weights=weight)[group] < 2
        all_sure = np.bincount(group, weights=weight < 2)[group] == 0
        covered: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2] * len(first)
        for j in np.flatnonzero((weight > 1)):
            covered[j] = (np.array([0]), np.array([head["n"][first[j]]]))
        todo = np.flatnonzero(~single & ~all_sure)
        todo = todo[np.argsort(group[todo], kind="stable")]
        n = head["n"][first].astype(np.int64)
        for part in slices(todo, group, n):
            flat = np.concatenate([x[start[i] : start[i + 1]] for i in first[part]])
            begin = np.concatenate([[0], np.cumsum(n[part])])[:-1]
            turn = head["a"][first[part]] - head["pos"][first[part]]
            hit = repeated_windows(flat, begin, n[part], turn, group[part], weight[part], length)
            ends = np.cumsum(n[part] - length + 1)
            for j, e, c in zip(part, ends, n[part] - length + 1, strict=True):
                if weight[j] > 1:
                    continue
                w = np.concatenate([[False], hit[e - c : e], [False]])
                edge = np.flatnonzero(w[1:] != w[:-1])
                covered[j] = (edge[::2], edge[1::2] - 1 + length)
        out: list[list] = [[], [], []]
        for i, p in enumerate(head):
            for a, z in zip(*covered[of[i]], strict=True):
                out[0].append(int(p["k"]))
                out[1].append(int(p["a"] + a))
                out[2].append(int(p["a"] + z))
        return pa.table({"key": pa.array(out[0], pa.int64()), "start": pa.array(out[1], pa.int64()), "end": pa.array(out[2], pa.int64())})

    return run


def erase(batches):
    """mapInArrow over (key, text, starts, ends): key, n_removed, n_spans, kept_sha256, spans (merged)."""
    for b in batches:
        rows: list[tuple] = []
        data, offs = buffers(b.column(1))
        for i in range(b.num_rows):
            merged: list[list[int]] = []
            for a, z in sorted(zip(b.column(2)[i].as_py(), b.column(3)[i].as_py(), strict=True)):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            sha, end, text = hashlib.sha256(), 0, data[offs[i] : offs[i + 1]]
            for a, z in merged:
                sha.update(text[end:a].tobytes())
                end = z
            sha.update(text[end:].tobytes())
            rows.append((sum(z - a for a, z in merged), len(merged), sha.hexdigest(), [{"start": a, "end": z} for a, z in merged]))
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["key", "n_removed", "n_spans", "kept_sha256", "removed"])


def repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte spans) for each row of docs.

    Bytes inside any string of `length` bytes that also starts at another place, in the same or another row, are removed;
    strings never cross rows. Null and empty texts keep their (no) bytes; texts above LONG bytes are read in overlapping
    parts. Equal texts (by 128 bits) are worked on once and counted; rows that repeat an id and a text are copies of one
    another. An empty table gives an empty result, other columns are ignored.
    """
    rows = take(docs, doc_id=key, text=text)
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"key": F.xxhash64("text"), "key2": F.xxhash64(F.lit("second"), "text")})
    brief = rows.select("doc_id", "key", "key2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    brief = cut(brief, "brief")
    long = rows.where(F.octet_length("text") >= length).select("key", "key2", F.col("text").cast("binary").alias("text"), "doc_id")
    n = buckets(rows, BUCKET_BYTES)
    sent = cut(long.select("key", "text").mapInArrow(anchor_rows(n, length, gram), SENT), "anchors")
    places = sent.where("kind = 0").groupBy("bucket").applyInArrow(lambda t: recurring(t), "key long, places binary")
    sure = sent.where("kind = 1").select("texts", "places").mapInArrow(_sure, "key long, places binary")
    lists = places.union(sure).groupBy("key").agg(F.collect_list("places").alias("places"))
    # Places are listed by the first half of a text's identity: should texts share it, some are looked at in vain.
    copies = brief.where(F.col("n_bytes") >= length).groupBy("key", "key2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("id"))
    wanted = copies.join(lists, "key", "left").where("places is not null or copies > 1")
    # One row of each text, that of its smallest id; should rows repeat it, so do their equal results, of which one is kept.
    wanted = wanted.withColumnsRenamed({"key": "k", "key2": "k2"})
    kept = long.join(wanted, (F.col("key") == F.col("k")) & (F.col("key2") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("key", "key2", "text", "copies", "places")
    kept = cut(kept.withColumn("n", F.monotonically_increasing_id()), "texts")
    # From here on a text goes by its number.
    pieces_ = kept.select(F.col("n").alias("key"), "text", "copies", "places").mapInArrow(piece_rows(buckets(rows, PIECE_BYTES), length, gram), "bucket int, head binary, raw binary")
    spans = pieces_.groupBy("bucket").applyInArrow(lambda t: solve(length)(t), "key long, start long, end long")
    spans = spans.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    erased = kept.select(F.col("n").alias("key"), "text").join(spans, "key").select("key", "text", "starts", "ends").mapInArrow(erase, "key long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")
    erased = kept.select("n", "key", "key2").join(erased.withColumnRenamed("key", "n"), "n").drop("n").dropDuplicates(["key", "key2"])
    # Cut, so that the join stands alone and Spark can split the rows of one hot text.
    return brief.join(cut(erased, "erased"), ["key", "key2"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), "removed")


def _sure(batches):
    for b in batches:
        for k, p in zip(b.column(0), b.column(1), strict=True):
            t = _by_text(np.frombuffer(k.as_py(), np.int64), np.frombuffer(p.as_py(), np.int64))
            yield from t.to_batches()


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    return repeats(docs, length=length).drop("removed")
