"""Self-join of bit strings within a Hamming radius by walking pairs of binary trie nodes together.

Spark walks the upper levels, in which a pair must agree: `links` turns each fingerprint so that each of
radius + 1 blocks stands on top once (one of them is equal in any pair within the radius), and what has an
equal block meets in one task. Light blocks share tasks of about NODE fingerprints. In a block of more the
bits below it are turned in the same way, so Spark goes further down where many fingerprints are, and a pair
still agrees somewhere; different fingerprints end up apart. Inside a task the walk goes on over sorted arrays: the pair
of intervals splits by the next bit, differing bits add up, and a pair is dropped when they exceed the
radius. What a task returns are not all pairs but a forest with the nearest of them that keeps everything
connected that any pair connects.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

NODE, FRONTIER, EDGES, LEAVES = 4096, 100_000, 250_000, 250_000
#: Heavy blocks up to which their table is broadcast (about 24 bytes each); beyond that it is shuffled.
FEW_HEAVY = 1 << 14
#: With signatures: fingerprints of a block from which some of them stand for the rest, and how many do.
CROWD, PIVOTS = 256, 16


class Forest:
    """A minimum spanning forest of the links seen so far."""

    def __init__(self, n: int):
        self.n, self.a, self.b, self.d, self.held = n, [], [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.d.append(d)
        self.held += len(a)
        if self.held > EDGES:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        """Nearest links first, each group of equal distance in rounds: every tree takes one link to another."""
        if not self.a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b, d = map(np.concatenate, (self.a, self.b, self.d))
        root, kept = np.arange(self.n), []
        for bits in np.unique(d):
            here = np.flatnonzero(d == bits)
            while True:
                x, y = root[a[here]], root[b[here]]
                apart = x != y
                here, x, y = here[apart], x[apart], y[apart]
                if not len(here):
                    break
                high, low = np.maximum(x, y), np.minimum(x, y)
                tree, first = np.unique(high, return_index=True)
                root[tree] = low[first]
                kept.append(here[first])
                while (up := root[root]).tobytes() != root.tobytes():
                    root = up
        keep = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        self.a, self.b, self.d, self.held = [a[keep]], [b[keep]], [d[keep]], len(keep)
        return a[keep], b[keep]


def walk(a: np.ndarray, b: np.ndarray, same: bool, bits: int, radius: int, found: Callable[[np.ndarray, np.ndarray], None], block: int = 0) -> None:
    """Calls found(i, j) with places in the sorted arrays a and b (uint64) of all pairs within the radius.

    block: so many top bits must be equal. If a and b aren't the same, all of both have them equal.
    """
    if not len(a) or not len(b):
        return
    al, ah, bl, bh = (np.array([x]) for x in (0, len(a), 0, len(b)))
    if same and block:
        top = a >> np.uint64(bits - block)
        al = bl = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
        ah = bh = np.append(al[1:], len(a))
    stack = [(al, ah, bl, bh, np.zeros(len(al), np.int64), bits - block - 1)]
    while stack:
        al, ah, bl, bh, err, bit = stack.pop()
        if len(al) > FRONTIER:
            for k in range(0, len(al), FRONTIER):
                part = slice(k, k + FRONTIER)
                stack.append((al[part], ah[part], bl[part], bh[part], err[part], bit))
            continue
        few = ((ah - al) * (bh - bl) <= 32) | (bit < 0)
        if few.any():
            _leaves(a, b, al[few], ah[few], bl[few], bh[few], radius, found)
            more = ~few
            al, ah, bl, bh, err = al[more], ah[more], bl[more], bh[more], err[more]
        if not len(al):
            continue
        keep, one = ~np.uint64((1 << (bit + 1)) - 1), np.uint64(1 << bit)
        am = np.clip(np.searchsorted(a, (a[al] & keep) | one), al, ah)
        bm = np.clip(np.searchsorted(b, (b[bl] & keep) | one), bl, bh)
        diagonal = (al == bl) & (ah == bh) if same else np.zeros(len(al), bool)
        children = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1)]
        off = ~diagonal
        children.append((am[off], ah[off], bl[off], bm[off], err[off] + 1))
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*children))
        live = (al < ah) & (bl < bh) & (err <= radius)
        if live.any():
            stack.append((al[live], ah[live], bl[live], bh[live], err[live], bit - 1))


def _leaves(a, b, al, ah, bl, bh, radius, found) -> None:
    na, nb = ah - al, bh - bl
    size = na * nb
    ends = np.cumsum(size)
    lo = 0
    while lo < len(size):  # so many pairs at a time, or one pair of nodes
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + LEAVES, "right")))
        if hi == lo + 1 and size[lo] > LEAVES:
            step = max(1, LEAVES // int(nb[lo]))
            for x in range(int(al[lo]), int(ah[lo]), step):
                i = np.repeat(np.arange(x, min(x + step, int(ah[lo]))), nb[lo])
                j = np.tile(np.arange(bl[lo], bh[lo]), len(i) // int(nb[lo]))
                near = np.bitwise_count(a[i] ^ b[j]) <= radius
                found(i[near], j[near])
        else:
            s = size[lo:hi]
            k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            width = np.repeat(nb[lo:hi], s)
            i, j = np.repeat(al[lo:hi], s) + k // width, np.repeat(bl[lo:hi], s) + k % width
            near = np.bitwise_count(a[i] ^ b[j]) <= radius
            found(i[near], j[near])
        lo = hi


def links(points: DataFrame, bits: int, radius: int) -> DataFrame:
    """points: fp (long, each once) and id (long). Rows (a, b) of ids: a forest of the links of fingerprints within the radius in fp's low `bits` bits."""
    mask = lambda n: F.lit(-1 if n == 64 else (1 << n) - 1)
    rows = points.select(F.lit(0).cast("long").alias("tab"), F.col("fp").bitwiseAND(mask(bits)).alias("fp"), "id", F.lit(None).cast("binary").alias("sig"))
    found, left = None, bits
    while True:
        turns, low = [], F.col("fp").bitwiseAND(mask(left))
        for k in range(radius + 1):
            by = left * k // (radius + 1)
            turned = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, left - by)).bitwiseAND(mask(left)) if by else low
            turns.append(F.struct((F.col("tab") * (radius + 1) + k).alias("tab"), F.col("fp").bitwiseXOR(low).bitwiseOR(turned).alias("fp")))
        rows = rows.select("id", "sig", F.explode(F.array(*turns)).alias("turn")).select("turn.tab", "turn.fp", "id", "sig")
        left -= left // (radius + 1)
        heavy = _heavy(_placed(rows, bits, bits - left))
        deeper = left // (radius + 1) > 0 and not heavy.isEmpty()
        here = block_links(rows, bits, bits - left, radius, heavy=heavy, skip=deeper)
        found = here if found is None else found.unionByName(here)
        if not deeper:
            return found.distinct()
        rows = stored(_placed(rows, bits, bits - left).join(_small(heavy), ["tab", "value"], "left_semi").drop("value"), "heavy-block-rows")


def _placed(points: DataFrame, bits: int, block: int) -> DataFrame:
    """points with the value of their top `block` bits."""
    value = F.shiftrightunsigned("fp", bits - block)
    return points.withColumn("value", value if bits == 64 else value.bitwiseAND(F.lit((1 << block) - 1)))


def _heavy(placed: DataFrame) -> DataFrame:
    return stored(placed.groupBy("tab", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * NODE), "heavy-blocks")


def _small(heavy: DataFrame) -> DataFrame:
    return F.broadcast(heavy) if heavy.limit(FEW_HEAVY + 1).count() <= FEW_HEAVY else heavy


def _crowds(fp: np.ndarray, ids: np.ndarray, distance, most: int, shift: np.uint64, add) -> np.ndarray:
    """Links the members of each crowded block to the nearest of a few that stand for them; the places, in fp's order, that are still to meet each other.

    The few are those with the least hashes of their ids, so that they are the same in other tables and parts.
    """
    left = np.argsort(fp, kind="stable")
    top = fp[left] >> shift
    starts = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
    kept = []
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(left)]):
        here = left[lo:hi]
        while len(here) > CROWD:
            order = here[np.argsort(ids[here].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")]
            pivots, rest = order[:PIVOTS], order[PIVOTS:]
            best, which = np.full(len(rest), most + 1), np.zeros(len(rest), np.int64)
            for p in pivots:
                d = distance(rest, np.full(len(rest), p))
                nearer = d < best
                best[nearer], which[nearer] = d[nearer], p
            ok = best <= most
            add(rest[ok], which[ok], best[ok])
            kept.append(pivots)
            here = rest[~ok]
            if ok.mean() < 0.1:  # no crowd around anyone
                break
        kept.append(here)
    kept = np.concatenate(kept) if kept else left
    return kept[np.lexsort((ids[kept], fp[kept]))]


def block_links(points: DataFrame, bits: int, block: int, radius: int, most: int | None = None, heavy: DataFrame | None = None, skip: bool = False) -> DataFrame:
    """points: tab, fp (long), id (long) and sig (binary; null: the fingerprint itself). Rows (a, b) of ids.

    A link joins points of one tab that have equal top `block` bits, are within the radius in all `bits`
    bits and, with signatures, have at most `most` different bits in those. Returned is a forest of each
    task's links. Heavy blocks (given, or counted here) are left out with `skip`. Else, without signatures, any
    two parts of a heavy block meet in a task of their own, so no group is torn apart and none is without bound.
    With signatures (guesses that the caller verifies, with a way to find the rest) a part meets itself and a
    few fingerprints that all parts get, so the work grows with the block and not with its square.
    """
    n = points.groupBy("tab").count().agg(F.max("count")).first()[0] or 0
    placed = _placed(points, bits, block)
    heavy = _heavy(placed) if heavy is None else heavy
    if heavy.isEmpty():
        placed = placed.withColumn("n", F.lit(None).cast("long"))
    elif skip:
        placed = placed.join(_small(heavy), ["tab", "value"], "left_anti").withColumn("n", F.lit(None).cast("long"))
    else:
        placed = placed.join(_small(heavy), ["tab", "value"], "left")
    parts = F.coalesce(F.ceil(F.col("n") / (2 * NODE)), F.lit(1)).cast("int")
    lump = F.when(F.col("n").isNull(), F.pmod(F.xxhash64("value"), F.lit(max(1, -(-n // NODE)))))
    own, every = F.pmod(F.xxhash64("id"), parts).cast("int"), F.sequence(F.lit(0), parts - 1)
    rows = placed.select("tab", "value", "fp", "id", "sig", parts.alias("parts"), lump.alias("lump"), own.alias("own"), every.alias("every"), "n")
    key = F.when(F.col("n").isNotNull(), F.col("value")).alias("block")
    if most is None:
        one, two = F.col("own"), F.col("two")
        pair = (F.least(one, two).cast("long") * F.col("parts") + F.greatest(one, two)).alias("part")
        met = rows.withColumn("two", F.explode("every")).select("tab", "lump", key, pair, (one > two).cast("int").alias("side"), "fp", "id", "sig")
    else:
        first = rows.select("tab", "lump", key, F.col("own").cast("long").alias("part"), F.lit(0).alias("side"), "fp", "id", "sig")
        other = rows.filter("parts > 1").filter(F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("n") / PIVOTS)) == 0)
        second = other.select("tab", "lump", key, F.explode(F.col("every").cast("array<long>")).alias("part"), F.lit(1).alias("side"), "fp", "id", "sig")
        met = first.unionByName(second)

    def join(table: pa.Table) -> pa.Table:
        side, fp, ids = (table.column(c).to_numpy() for c in ("side", "fp", "id"))
        fp = fp.astype(np.int64).view(np.uint64)
        if bits < 64:
            fp = fp & np.uint64((1 << bits) - 1)
        names, place = np.unique(ids, return_inverse=True)
        forest = Forest(len(names))
        if most is not None:
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(len(table), -1)

        def distance(i, j):
            return np.bitwise_count(fp[i] ^ fp[j]) if most is None else np.bitwise_count(sig[i] ^ sig[j]).sum(axis=1, dtype=np.int64)

        def add(i, j, d):
            ok = ids[i] != ids[j]
            forest.add(place[i[ok]], place[j[ok]], d[ok].astype(np.int64))

        if most is None:
            order = np.lexsort((ids, fp))
            x, y = order[side[order] == 0], order[side[order] == 1]
            same = not len(y)
            y = x if same else y
        else:
            _, once = np.unique(ids, return_index=True)  # those that all parts get are there twice in their own
            x = y = once[_crowds(fp[once], ids[once], lambda i, j: distance(once[i], once[j]), most, np.uint64(bits - block), lambda i, j, d: add(once[i], once[j], d))]
            same = True

        def found(i, j):
            i, j = x[i], y[j]
            d = distance(i, j)
            ok = np.ones(len(d), bool) if most is None else d <= most
            if ok.any():
                add(i[ok], j[ok], d[ok])

        walk(fp[x], fp[y], same, bits, radius, found, block)
        a, b = forest.reduce()
        return pa.table({"a": pa.array(names[a], pa.int64()), "b": pa.array(names[b], pa.int64())})

    return met.groupBy("tab", "lump", "block", "part").applyInArrow(join, "a long, b long").distinct()
