"""Exact n-gram Jaccard join by grouped prefixes.

1. Every text becomes its set of shingle hashes; equal sets are one class. Of each class the hashes in the lowest SHARE of
   the hash space are dealt by hash. A class with so many hashes that no other class has that a similarity of `percent` is
   out of reach leaves here; that proof needs no candidate pairs.
2. Of the other classes all hashes are counted. They are put in one order, rare ones first, and cut to their prefixes, of
   which only hashes that another class has are kept; classes with equal prefix and size form one group.
   Groups that share a prefix hash and pass the size and position filters are candidates. They are verified in rounds:
   first each class against a few leaders of each hash (stars), then against the nearest of many leaders in other
   components as long as that brings links, and last all pairs still in different components, each offered once.
3. Verified links are joined to components; nothing is ever expanded inside a component that is already connected.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import buckets, cut, small, take
from .textbytes import buffers, gram_hashes, lean, lower_table, mix, pieces, runs, span_hashes, words

WORDS = 5
PERCENT = 80
SHARE = 0.35
BUCKET_BYTES = 6 << 20
LOWER = lower_table(lambda b: b != 32 and not 9 <= b <= 13)
INSIDE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
U64 = np.uint64


def shingles(col: pa.Array, k: int = WORDS):
    """Piece by piece: sorted distinct shingle hashes of all texts in it, one after another, and where each text's begin."""
    for lo, hi in pieces(col):
        raw, offs = buffers(col.slice(lo, hi - lo))
        data = np.where(INSIDE[raw], LOWER[raw], raw)
        starts, ends, first = words(data, offs, INSIDE)
        h = span_hashes(data, starts, ends)
        n = np.diff(first)
        grams = gram_hashes(h, k)
        doc = np.repeat(np.arange(hi - lo), n)
        at = np.arange(len(grams))
        whole = at + k <= first[doc[: len(grams)] + 1] if len(grams) else np.zeros(0, bool)
        values, owners = [grams[whole]], [doc[: len(grams)][whole]]
        for d in np.flatnonzero((n > 0) & (n < k)):  # the whole sequence is the one shingle
            values.append(mix(gram_hashes(h[first[d] : first[d + 1]], int(n[d])) + U64(int(n[d]))))
            owners.append(np.array([d]))
        v, o = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(o, kind="stable")  # two sorted runs
        v, o = v[order], o[order]
        at = np.searchsorted(o, np.arange(hi - lo + 1))
        for d in np.flatnonzero(np.diff(at) > 1).tolist():
            v[at[d] : at[d + 1]].sort()
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        v, o = v[new], o[new]
        yield lo, hi, v, np.searchsorted(o, np.arange(hi - lo + 1))


def fingerprint(v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, from two sums of mixed hashes; the first is 0 for the empty one only."""
    sums = []
    for salt in (0x51ED270B, 0x2545F491):
        total = np.zeros(len(v) + 1, U64)
        np.cumsum(mix(v + U64(salt)), out=total[1:])
        sums.append(total[first[1:]] - total[first[:-1]])
    fp = mix(sums[0] ^ mix(sums[1]))
    fp[fp == 0] = 1
    fp[first[1:] == first[:-1]] = 0
    return fp, mix(sums[1] + mix(sums[0] ^ U64(0x7F4A7C15)))


def packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary array of the bytes of values[first[i] : first[i + 1]]."""
    offs = first * values.itemsize
    if offs[-1] >= 1 << 31:
        raise ValueError("more than 2 GB of hashes in one batch: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def by_bucket(h: np.ndarray, owner: np.ndarray, fps: np.ndarray, width: U64) -> dict[str, pa.Array]:
    """bucket, fps, counts, hashes: hashes h dealt to buckets of `width`, one row each, with the fps and number of hashes of
    their owners (row numbers of fps, in ascending order). Its work doesn't depend on the number of buckets."""
    to = (h // width).astype(np.int64)
    # A radix sort, where the numbers are short.
    order = np.argsort(to.astype(np.uint16) if len(to) and to.max() < 1 << 16 else to, kind="stable")
    h, owner, to = h[order], owner[order], to[order]
    own = _starts(to, owner) if len(h) else np.zeros(1, np.int64)
    at = _starts(to[own[:-1]]) if len(h) else own
    return {"bucket": pa.array(to[own[at[:-1]]].astype(np.int32)), "fps": packed(fps[owner[own[:-1]]], at), "counts": packed(np.diff(own).astype(np.uint32), at), "hashes": packed(h, own[at])}


def low_hashes(n_buckets: int, k: int, share: float):
    """mapInArrow over (id, key, text): kind 0 rows (id, key, n, low, fp, fp2) and kind 1 rows (bucket, fps, counts, hashes)."""
    bound = U64(int(share * (1 << 64)))
    width = -(-int(bound) // n_buckets)

    def run(batches):
        for b in batches:
            for lo, hi, v, first in shingles(b.column(2), k):
                (fp, fp2), n = fingerprint(v, first), np.diff(first)
                doc = np.repeat(np.arange(hi - lo), n)
                keep = v < bound
                # One row of each class in this piece is enough.
                _, rep = np.unique(np.stack([fp, fp2], 1), axis=0, return_index=True)
                mine = np.zeros(hi - lo, bool)
                mine[rep] = True
                low = np.diff(np.concatenate([[0], np.cumsum(keep)])[first])
                yield batch(0, id=b.column(0).slice(lo, hi - lo), key=b.column(1).slice(lo, hi - lo), n=n, low=low, fp=fp, fp2=fp2)
                keep &= mine[doc]
                if keep.any():
                    yield batch(1, **by_bucket(v[keep], doc[keep], fp, U64(width)))

    return run


LOW = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("bucket", pa.int32()), ("fps", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])
LOW_DDL = "kind int, id long, key long, n long, low long, fp long, fp2 long, bucket int, fps binary, counts binary, hashes binary"


def batch(kind: int, **cols) -> pa.RecordBatch:
    size = len(next(iter(cols.values())))
    arrays = []
    for f in LOW:
        x = cols.get(f.name)
        if f.name == "kind":
            arrays.append(pa.array(np.full(size, kind, np.int32)))
        elif x is None:
            arrays.append(pa.nulls(size, f.type))
        else:
            x = x.view(np.int64) if isinstance(x, np.ndarray) and x.dtype == U64 else x
            arrays.append(x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=LOW)


HELD = np.dtype([("h", U64), ("df", np.uint32)])


def dealt_hashes(n_buckets: int):
    """mapInArrow over (fp, hashes): bucket, fps, counts, hashes of whole sets."""
    width = U64(-(-(1 << 64) // n_buckets)) if n_buckets > 1 else ~U64(0)

    def run(batches):
        for b in batches:
            raw, offs = buffers(b.column(1))
            h = np.frombuffer(raw, U64)
            if len(h):
                yield pa.RecordBatch.from_pydict(by_bucket(h, np.repeat(np.arange(b.num_rows), np.diff(offs) // 8), b.column(0).to_numpy(), width))

    return run


def shared_hashes(t: pa.Table) -> pa.Table:
    """For a bucket: the hashes that each class shares with another one, with their numbers of classes (classes with none are left out)."""
    fps = np.concatenate([np.repeat(np.frombuffer(f, np.int64), np.frombuffer(c, np.uint32)) for f, c in zip(t["fps"].to_pylist(), t["counts"].to_pylist(), strict=True)])
    h = np.concatenate([np.frombuffer(x, U64) for x in t["hashes"].to_pylist()])
    order = np.argsort(h)
    h = h[order]
    twice = np.zeros(len(h) + 1, bool)
    twice[1:-1] = h[1:] == h[:-1]
    twice = np.flatnonzero(twice[1:] | twice[:-1])  # the rest, mostly most of them, stand once
    h, fps = h[twice], fps[order[twice]]
    order = np.lexsort((fps, h))
    h, fps = h[order], fps[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (fps[1:] != fps[:-1])
    h, fps = h[new], fps[new]
    at = np.flatnonzero(np.append(np.ones(min(1, len(h)), bool), h[1:] != h[:-1]))
    df = np.repeat(np.diff(np.append(at, len(h))), np.diff(np.append(at, len(h))))
    same = df > 1
    held = np.zeros(int(same.sum()), HELD)
    held["h"], held["df"], fps = h[same], df[same], fps[same]
    order = np.argsort(fps, kind="stable")
    held, fps = held[order], fps[order]
    own = runs(fps)
    return pa.table({"fp": pa.array([int(fps[a]) for a, _ in own], pa.int64()), "c": pa.array([z - a for a, z in own], pa.int64()), "shared": pa.array([held[a:z].tobytes() for a, z in own], pa.binary())})


def set_rows(k: int):
    """mapInArrow over (fp, text): fp, n, hashes (the sorted set)."""

    def run(batches):
        for b in batches:
            for lo, hi, v, first in shingles(b.column(1), k):
                sets = [v[a:z].tobytes() for a, z in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(sets, pa.binary())], names=["fp", "n", "hashes"])

    return run


def prefix_length(n, percent: int):
    """Two sets of the wanted similarity share a hash among the first n - ceil(n * percent / 100) + 1 of each."""
    return n - (n * percent + 99) // 100 + 1


def prefix_rows(percent: int):
    """mapInArrow over (fp, n, hashes, lists of shared hashes): fp, n, s, grp, prefix, dfs, bits.

    The order of all hashes: by the number of classes that have them, then by value. So those that no other class has come
    first; prefix has the others of the set's prefix, dfs their numbers of classes, and s is the number of all hashes that
    another class has. grp stands for the size and the whole prefix (and so for s). A set without a prefix links with none.
    """

    def run(batches):
        for b in batches:
            own, shared, out, dfs, bits = [], [], [], [], []
            n = b.column(1).to_numpy()
            for i, (raw, lists, p) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), prefix_length(n, percent).tolist(), strict=True)):
                held = np.concatenate([np.frombuffer(x, HELD) for x in lists or []] or [np.zeros(0, HELD)])
                left = p - (int(n[i]) - len(held))
                if left <= 0:
                    continue
                first = held[np.lexsort((held["h"], held["df"]))[:left]]
                v = np.frombuffer(raw, U64)
                own.append(i)
                shared.append(len(held))
                out.append(first["h"].tobytes())
                dfs.append(first["df"].tobytes())
                bits.append(np.packbits(np.bincount(((v >> U64(7)) % U64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes())
            whole = [int.from_bytes(hashlib.blake2b(x, digest_size=8, salt=int(n[i]).to_bytes(8, "little")).digest(), "little", signed=True) for i, x in zip(own, out, strict=True)]
            at = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(shared, pa.int64()), pa.array(whole, pa.int64()), pa.array(out, pa.binary()), pa.array(dfs, pa.binary()), pa.array(bits, pa.binary())], names=["fp", "n", "s", "grp", "prefix", "dfs", "bits"])

    return run


#: A hash that more classes have is dealt out in blocks of so many.
HOT = 4_096
#: So many of them (8 bytes each) are named to all tasks; with more, all are crossed.
MOST_NAMED = 1_000_000
ALL = (1 << 32) - 1


def hot_hashes(hot: int):
    """mapInArrow over (prefix, dfs, comp): the hashes of more than `hot` classes, each with its lowest and highest component."""

    def run(batches):
        for b in batches:
            p = [len(x) // 8 for x in b.column(0).to_pylist()]
            h, df = (np.frombuffer(b"".join(b.column(i).to_pylist()), t) for i, t in ((0, U64), (1, np.uint32)))
            c = np.repeat(b.column(2).to_numpy(), p)[df > hot]
            h = h[df > hot]
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            at = _starts(h) if len(h) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[at[:-1]].view(np.int64)), pa.array(c[at[:-1]]), pa.array(c[at[1:] - 1])], names=["h", "low", "high"])

    return run


def _in_blocks(parts: np.ndarray, df: np.ndarray, hot: int, whole: bool, mixed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """parts with the postings of hot hashes dealt to blocks, and which of them each came from.

    A block of a hash is a hash of its own. For leaders a class is in one block of each hash, another one for each, so that
    blocks meet through other hashes. For whole crossings it goes to all pairs of blocks with its own, unless the hash is
    known to be in one component only.
    """
    blocks = -(-df.astype(np.int64) // hot)
    cold, split = np.flatnonzero(blocks <= 1), np.flatnonzero(blocks > 1)
    if whole and mixed is not None:
        split = split[np.isin(parts["h"][split], mixed)]
    n = blocks[split].astype(U64)
    own = mix(parts["fp"][split].view(U64) ^ parts["h"][split]) % np.maximum(n, U64(1))
    other = own
    if whole:
        times = n.astype(np.int64)
        split, n, own = np.repeat(split, times), np.repeat(n, times), np.repeat(own, times)
        other = (np.arange(len(split)) - np.repeat(np.cumsum(times) - times, times)).astype(U64)
    out = parts[np.concatenate([cold, split])]
    low, high = np.minimum(own, other), np.maximum(own, other)
    out["h"][len(cold) :] = mix(out["h"][len(cold) :] ^ mix(low * n + high + U64(1)))
    out["k"] = ALL
    out["k"][len(cold) :] = np.where(low == high, U64(ALL), own).astype(np.uint32)
    return out, np.concatenate([cold, split])


def postings(n_buckets: int, hot: int, whole: bool, mixed=None):
    """mapInArrow over (fp, n, grp, prefix, dfs, comp, bits, s): for each bucket one row of packed postings and its classes' bits.

    whole: for crossings, which need all pairs of a hash; mixed: a broadcast array of the hot hashes that have any.
    """

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            p = np.array([len(x) // 8 for x in b.column(3).to_pylist()])
            parts = np.zeros(int(p.sum()), POSTING)
            parts["h"] = np.frombuffer(b"".join(b.column(3).to_pylist()), U64)
            for field, i in (("fp", 0), ("n", 1), ("g", 2), ("c", 5), ("s", 7)):
                parts[field] = np.repeat(b.column(i).to_numpy(), p)
            parts["i"] = np.arange(len(parts)) - np.repeat(np.cumsum(p) - p, p)
            row, bits = np.repeat(np.arange(len(p)), p), np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint8).reshape(len(p), -1)
            fps = b.column(0).to_numpy()
            heads = np.zeros((len(p), HEAD), U64)
            early = parts["i"] < HEAD
            heads[row[early], parts["i"][early]] = parts["h"][early]
            parts, of = _in_blocks(parts, np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint32), hot, whole, mixed.value if mixed is not None else None)
            if not len(parts):
                continue
            to = (mix(parts["h"]) % U64(n_buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            parts, to, row = parts[order], to[order], row[of][order]
            own = runs(to)
            held = []
            for a, z in own:
                u = np.unique(row[a:z])
                one = np.zeros(len(u), BITMAP)
                one["fp"], one["b"], one["head"] = fps[u], bits[u].view(U64), heads[u]
                held.append(one.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(to[[a for a, _ in own]].astype(np.int32)), pa.array([parts[a:z].tobytes() for a, z in own], pa.binary()), pa.array(held, pa.binary())], names=["bucket", "rows", "bits"])

    return run


BITS = 512
#: So many of a class's rarest prefix hashes go with its bitmap, so that a pair is offered by the first of them it shares.
HEAD = 16
BITMAP = np.dtype([("fp", np.int64), ("b", U64, (BITS // 64,)), ("head", U64, (HEAD,))])
#: i: the hash's place among the s hashes of the class that another class has; k: the block of a class, or ALL where it
#: meets its own block too.
POSTING = np.dtype([("h", U64), ("fp", np.int64), ("g", np.int64), ("c", np.int64), ("n", np.uint32), ("s", np.uint32), ("i", np.uint32), ("k", np.uint32)])


def _reach(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Can pairs of postings of one hash reach the similarity, by their sizes, shared hashes and places?"""
    na, nb, sa, sb, i, j = (x[f].astype(np.int64) for f in "nsi" for x in (a, b))
    most = np.minimum(i, j) + 1 + np.minimum(sa - i - 1, sb - j - 1)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (most * (100 + percent) >= (na + nb) * percent)


def _fits(x: np.ndarray, known: np.ndarray, of: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Size, position and bitmap filters for pairs of postings of one hash: each only leaves out pairs below the similarity."""
    a, b = x[i], x[j]
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    need = -(-(na + nb) * percent // (100 + percent))
    ok = _reach(a, b, percent)
    at = np.flatnonzero(ok)
    ok[at] = np.bitwise_count(known["b"][of[i[at]]] ^ known["b"][of[j[at]]]).sum(1, dtype=np.int64) <= (na + nb - 2 * need)[at]
    return ok


def _first(x: np.ndarray, known: np.ndarray, of: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Is this hash the first that a pair shares, as far as their heads tell? A pair that reaches the similarity passes the
    filters at every hash it shares, so that one hash may offer it for all."""
    out = np.ones(len(i), bool)
    for lo in range(0, len(i), 1 << 14):
        a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
        before = known["head"][of[a]][:, :, None] == known["head"][of[b]][:, None, :]
        before &= (np.arange(HEAD) < x["i"][a][:, None])[:, :, None] & (np.arange(HEAD) < x["i"][b][:, None])[:, None, :]
        out[lo : lo + (1 << 14)] = ~before.any((1, 2))
    return out


def _sorted(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings in order of (hash, size, group, class), what is known of the classes, and which of them each posting has."""
    x = np.concatenate([np.frombuffer(r, POSTING) for r in t["rows"].to_pylist()])
    x = x[np.lexsort((x["fp"], x["g"], x["n"], x["h"]))]
    known = np.concatenate([np.frombuffer(r, BITMAP) for r in t["bits"].to_pylist()])
    known = known[np.unique(known["fp"], return_index=True)[1]]
    return x, known, np.searchsorted(known["fp"], x["fp"])


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins, and the end of the last one."""
    new = np.ones(len(cols[0]) + 1, bool)
    new[1:-1] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    u = np.unique(np.stack([lo, hi], 1)[lo != hi], axis=0) if len(lo) else np.zeros((0, 2), np.int64)
    return pa.table({"a": np.ascontiguousarray(u[:, 0]), "b": np.ascontiguousarray(u[:, 1])})


LEADERS = 4
#: Leaders that a class looks at in a later round, of which it takes one.
CHOICES = 64
#: Later rounds go on while one adds this share of the links known before it.
GAIN = 0.05


def _leaders(x: np.ndarray, order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each posting the place of its hash's posting with the smallest order."""
    size = np.diff(start)
    place = np.zeros(len(x), np.int64)
    first = np.flatnonzero(order == np.repeat(np.minimum.reduceat(order, start[:-1]), size))
    lead = np.repeat(start[:-1], size)
    place[lead[first]] = first
    return place[lead]


def stars(percent: int):
    """Candidates of the first round: of each hash, neighbours in order of size and group, and every class with the
    LEADERS classes that come first by as many mixed orders of all classes. Mostly the same classes lead all hashes of a
    dense group, so that its candidates are few and its links soon connect it."""

    def run(t: pa.Table) -> pa.Table:
        x, known, of = _sorted(t)
        start = _starts(x["h"])
        at = np.flatnonzero(x["h"][1:] == x["h"][:-1])
        left, right = [at], [at + 1]
        for salt in range(LEADERS):
            left.append(_leaders(x, mix(x["fp"].view(U64) ^ U64(0x9E37 + salt)), start))
            right.append(np.arange(len(x)))
        i, j = np.concatenate(left), np.concatenate(right)
        keep = x["fp"][i] != x["fp"][j]
        i, j = i[keep], j[keep]
        ok = _fits(x, known, of, i, j, percent)
        return _pairs(x["fp"][i[ok]], x["fp"][j[ok]])

    return run


def nearest(percent: int, turn: int):
    """Candidates of a later round, one a class and hash at most: of CHOICES leaders (the first classes by as many orders
    mixed with the round's number) that are in other components the one whose bitmap differs least."""

    def run(t: pa.Table) -> pa.Table:
        x, known, of = _sorted(t)
        x, of = _mixed(x, of)
        bits = known["b"]
        best, far = np.full(len(x), -1), np.full(len(x), 1 << 30)
        start = _starts(x["h"])
        for salt in range(CHOICES if len(x) else 0):
            i = _leaders(x, mix(x["fp"].view(U64) ^ U64(0xA5110000 + CHOICES * turn + salt)), start)
            j = np.flatnonzero(x["c"][i] != x["c"])
            j = j[_fits(x, known, of, i[j], j, percent)]
            gap = np.bitwise_count(bits[of[i[j]]] ^ bits[of[j]]).sum(1, dtype=np.int64)
            nearer = gap < far[j]
            best[j[nearer]], far[j[nearer]] = i[j[nearer]], gap[nearer]
        j = np.flatnonzero(best >= 0)
        return _pairs(x["fp"][best[j]], x["fp"][j])

    return run


def _mixed(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The postings of hashes whose classes are in more than one component."""
    if not len(x):
        return x, of
    start = _starts(x["h"])
    mixed = np.repeat(np.minimum.reduceat(x["c"], start[:-1]) != np.maximum.reduceat(x["c"], start[:-1]), np.diff(start))
    return x[mixed], of[mixed]


def _hopeful(x: np.ndarray, of: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The postings of mixed hashes that may reach the similarity with a class of the smallest size that their hash has."""
    while True:
        x, of = _mixed(x, of)
        if not len(x):
            return x, of
        start = _starts(x["h"])
        n, low = x["n"].astype(np.int64), np.repeat(x["n"][start[:-1]].astype(np.int64), np.diff(start))
        ok = (n + np.maximum(low, -(-n * percent // 100))) * percent <= x["s"].astype(np.int64) * (100 + percent)
        if ok.all():
            return x, of
        x, of = x[ok], of[ok]


def _group_pairs(head: np.ndarray, sole: np.ndarray, size: np.ndarray, percent: int, most: int = 2_000_000):
    """Pairs of groups of one hash that hold classes of different components, each pair once, about `most` at a time.

    Only groups outside the hash's largest component look for partners: pairs inside that one are never enumerated, so that
    the work of a hash is its groups times those outside.
    """
    n, run = head["n"].astype(np.int64), np.repeat(np.arange(len(at := _starts(head["h"])) - 1), np.diff(at))
    order = np.lexsort((sole, run))
    own = _starts(run[order], sole[order])
    weight, lead = np.add.reduceat(size[order], own[:-1]), order[own[:-1]]
    best = np.lexsort((weight, run[lead]))
    best = best[np.append(run[lead][best][1:] != run[lead][best][:-1], True)]  # one of each hash, in their order
    rest = np.flatnonzero((sole != sole[lead[best]][run]) | (sole < -(1 << 61)))
    outside = np.zeros(len(head), bool)
    outside[rest] = True
    place = (run << 33) + n
    lo = np.searchsorted(place, (run[rest] << 33) + -(-n[rest] * percent // 100))
    hi = np.searchsorted(place, (run[rest] << 33) + n[rest] * 100 // percent, "right")
    total = np.concatenate([[0], np.cumsum(hi - lo)])
    a = 0
    while a < len(rest):
        z = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        width = (hi - lo)[a:z]
        i = np.repeat(rest[a:z], width)
        j = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo[a:z], width)
        keep = ((sole[i] != sole[j]) & (~outside[j] | (j > i))) | ((i == j) & (sole[i] < -(1 << 61)))
        i, j = i[keep], j[keep]
        keep = (i == j) | _reach(head[i], head[j], percent)
        yield np.minimum(i, j)[keep], np.maximum(i, j)[keep]
        a = z


def crossing(percent: int):
    """Candidates of the last round: of each hash, the group pairs that pass the filters, expanded to the pairs of their
    classes that are not yet in one component."""

    def run(t: pa.Table) -> pa.Table:
        x, known, of = _sorted(t)
        x, of = _hopeful(x, of, percent)
        if not len(x):
            return _pairs(np.zeros(0, np.int64), np.zeros(0, np.int64))
        start = _starts(x["h"], x["g"])
        start, size, head = start[:-1], np.diff(start), x[start[:-1]]
        sole = np.where(np.minimum.reduceat(x["c"], start) == np.maximum.reduceat(x["c"], start), x["c"][start], np.arange(-len(start), 0) - (1 << 62))
        held = [np.zeros((0, 2), np.int64)]
        for p, q in _group_pairs(head, sole, size, percent):
            for own in np.array_split(np.arange(len(p)), max(1, int((size[p] * size[q]).sum()) // 2_000_000)):
                n = size[p[own]] * size[q[own]]
                rep = np.repeat(own, n)
                turn = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
                width = np.maximum(size[q[rep]], 1)
                i, j = start[p[rep]] + turn // width, start[q[rep]] + turn % width
                other = (x["c"][i] != x["c"][j]) & ((x["k"][i] == ALL) | (x["k"][i] != x["k"][j]))
                i, j = i[other], j[other]
                ok = _fits(x, known, of, i, j, percent)
                i, j = i[ok], j[ok]
                ok = _first(x, known, of, i, j)
                a, b = x["fp"][i[ok]], x["fp"][j[ok]]
                held.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            if sum(map(len, held)) > 2_000_000:  # repeated pairs go before memory grows
                held = [np.unique(np.concatenate(held), axis=0)]
        u = np.concatenate(held)
        return _pairs(u[:, 0], u[:, 1])

    return run


def verify(percent: int):
    """mapInArrow over (a, b, x, y): pairs whose sets reach the similarity."""

    def run(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y"))
    both = pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return cut(both.mapInArrow(lean(verify(percent)), "a long, b long"), "links")


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT, share: float = SHARE, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows (id, key, n, fp, fp2) for each row of docs; links (fp, fp2, root) for each class with a link to
    another one.

    Rows of equal sets have equal fp and fp2, 128 bits together (fp 0: no words or null text; linked with nothing). Two
    classes have one root if a chain of pairs with 100 * intersection >= percent * union connects them; no partner or
    candidate is capped. Texts are read whole, however long.
    """
    # Copies share a text key, so that (key, id) of one row stands for the class; null ids are kept apart by the key.
    rows = take(docs, id=key, text=text).select(F.col("id").cast("long"), F.xxhash64("text").alias("key"), "text")
    n_buckets = buckets(rows, BUCKET_BYTES)
    low = cut(rows.mapInArrow(lean(low_hashes(n_buckets, k, share)), LOW_DDL), "low")
    texts = low.where("kind = 0").select("id", "key", "n", "low", "fp", "fp2")
    shared = low.where("kind = 1").select("bucket", "fps", "counts", "hashes").groupBy("bucket").applyInArrow(lean(lambda t: shared_hashes(t).select(["fp", "c"])), "fp long, c long")
    # One row a class, however many buckets its hashes were dealt to.
    shared = cut(shared.groupBy("fp").agg(F.sum("c").alias("c")), "shared")
    one = texts.where("n > 0").groupBy("fp", "fp2").agg(F.first("n").alias("n"), F.first("low").alias("low"), F.min(F.struct("key", "id")).alias("r"))
    least = F.floor((F.col("n") * percent + 99) / 100)
    left = one.join(shared.select("fp", "c"), "fp", "left").where(F.col("low") - F.coalesce("c", F.lit(0)) <= F.col("n") - least).select("fp", "fp2", F.col("r.key").alias("key"), F.col("r.id").alias("id"))
    left = cut(left.withColumn("cls", F.monotonically_increasing_id()), "left")
    kept = rows.join(small(left.select("key", "id", "cls")), (rows["key"] == left["key"]) & rows["id"].eqNullSafe(left["id"])).select(F.col("cls").alias("fp"), "text")
    sets = kept.mapInArrow(lean(set_rows(k)), "fp long, n long, hashes binary").where("n > 0")
    # Rows that repeat a (key, id) repeat a class here. From here on a class goes by its number.
    sets = cut(sets.dropDuplicates(["fp"]), "sets")
    # Only these classes can link, so a hash counts by how many of them have it.
    listed = sets.select("fp", "hashes").mapInArrow(lean(dealt_hashes(buckets(sets, BUCKET_BYTES))), "bucket int, fps binary, counts binary, hashes binary")
    listed = listed.groupBy("bucket").applyInArrow(lean(lambda t: shared_hashes(t).select(["fp", "shared"])), "fp long, shared binary").groupBy("fp").agg(F.collect_list("shared").alias("lists"))
    prefixes = cut(sets.join(listed, "fp").select("fp", "n", "hashes", "lists").mapInArrow(lean(prefix_rows(percent)), "fp long, n long, s long, grp long, prefix binary, dfs binary, bits binary"), "prefixes")
    n_postings = buckets(prefixes, BUCKET_BYTES)

    def candidates(frame: DataFrame, find, whole: bool = False, mixed=None) -> DataFrame:
        return frame.select("fp", "n", "grp", "prefix", "dfs", "comp", "bits", "s").mapInArrow(lean(postings(n_postings, hot, whole, mixed)), "bucket int, rows binary, bits binary").groupBy("bucket").applyInArrow(lean(lambda t: find(t)), "a long, b long")

    links = _links(candidates(prefixes.withColumn("comp", F.col("fp")), stars(percent)), sets, percent)
    had, turn = 0, 0
    while True:
        roots = components(links)
        known = prefixes.join(roots.select(F.col("vertex").alias("fp"), F.col("component")), "fp", "left").withColumn("comp", F.coalesce("component", "fp"))
        now = links.count()
        if not turn or now - had > GAIN * had:
            more = _links(candidates(known, nearest(percent, turn)), sets, percent)
            links, had, turn = links.union(more), now, turn + 1
            continue
        break
    # Of hot hashes only those that have classes in several components are crossed; few enough of them are named.
    hot_ = known.select("prefix", "dfs", "comp").mapInArrow(hot_hashes(hot), "h long, low long, high long").groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    hot_ = cut(hot_.where("low < high").select("h"), "hot").limit(MOST_NAMED + 1).toArrow()["h"].to_numpy()
    mixed = known.sparkSession.sparkContext.broadcast(np.sort(hot_).view(U64)) if len(hot_) <= MOST_NAMED else None
    more = _links(candidates(known, crossing(percent), True, mixed), sets, percent)
    roots = components(links.union(more)).select(F.col("vertex").alias("cls"), F.col("component").alias("root"))
    named = left.select("cls", "fp", "fp2").join(roots, "cls", "left").join(roots.select(F.col("root").alias("cls"), F.lit(True).alias("top")).distinct(), "cls", "left")
    named = named.select("fp", "fp2", F.coalesce("root", F.when(F.col("top"), F.col("cls"))).alias("root")).where("root is not null")
    return texts.select("id", "key", "n", "fp", "fp2"), cut(named, "roots")


def report(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Rows without words (null and empty texts too) are components of their own; null doc_ids come after all others in a
    component (and stay null alone); repeated rows are copies of one another; whole texts are read, however long; an empty
    table gives an empty result, other columns are ignored.
    """
    rows, roots = classes(docs, k=k, percent=percent, hot=hot)
    one = rows.where("fp != 0").groupBy("fp", "fp2").agg(F.min("id").alias("low")).join(roots, ["fp", "fp2"], "left")
    one = cut(one, "classes")
    least = one.where("root is not null").groupBy("root").agg(F.min("low").alias("least"))
    # One row a component of several classes; so a large one's rows need not meet in one task.
    table = one.join(small(cut(least, "least")), "root", "left").select("fp", "fp2", F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(table, ["fp", "fp2"], "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("fp") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with its own columns and one row of each component: that with the smallest (id, text hash), null ids last.

    Rows without words (null and empty texts too) all stay; of rows that repeat an id and a text one stays, so that no tie
    is left. Whole texts are read, however long; an empty table stays empty.
    """
    names, plain = docs.columns, docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    rows, roots = classes(docs, key=key, text=text, k=k, percent=percent)
    alone = lambda c: F.when(F.col("root").isNull(), F.col(c)).alias(c)
    own = rows.where("fp != 0").join(roots, ["fp", "fp2"], "left").withColumn("root", F.struct("root", alone("fp"), alone("fp2"))).withColumn("me", F.struct(F.col("id").isNull().alias("none"), "id", F.col("key").alias("h")))
    own = cut(own.groupBy("root", "me").agg(F.count(F.lit(1)).alias("times")), "members")
    first = own.groupBy("root").agg(F.min("me").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    gone = cut(own.join(small(cut(first.drop("_n"), "first")), "root").where("me != first").select("me.id", "me.h"), "gone")
    at, words = F.col(f"_c{names.index(key)}"), F.xxhash64(f"_c{names.index(text)}")
    left = plain.withColumn("_h", words).join(small(gone), (F.col("_h") == F.col("h")) & at.eqNullSafe(F.col("id")), "left_anti")
    twice = cut(own.where("times > 1").select("me.id", "me.h"), "twice")
    if twice.limit(1).count():
        hit = (F.col("_h") == F.col("h")) & at.eqNullSafe(F.col("id"))
        left = left.join(twice, hit, "left_anti").unionByName(left.join(twice, hit, "left_semi").dropDuplicates([f"_c{names.index(key)}", "_h"]))
    return left.drop("_h").toDF(*names)
