"""SimHash near-duplicates: fingerprints of word shingles, linked by the trie self-join.

`fingerprint_components` links documents whose 64-bit fingerprints differ in few bits.
`near_duplicate_groups` finds documents that share at least SIMILARITY of their sets of five-word
shingles. Such a pair differs in about 15 % of the SimHash bits of the sets, so the trie join takes TABLES
windows of each signature: below a block of BLOCK equal bits the walk allows RADIUS different ones, a whole
signature sorts out most chance meetings, and the sets themselves decide. That only puts most of each group
together. What it misses an exact join finds: in any fixed order of the shingles, two sets this similar
share one of the first n - ceil(similarity n) + 1 of each (the order puts shingles of many texts last, by a
sample). Pairs of these between different groups are bounded by sizes, places and parities, and again the
sets decide. Parities are made with the signatures, so only texts of pairs that pass are read again.

Rows: a null or blank text has the fingerprint zero and no shingles; documents without shingles form
one group of their own. Equal texts share everything. Repeated and null ids are one document per text; null ids come
last, and of equal ids the least text hash is first. Texts of any length are read whole. An empty table gives no rows.
Groups need doc_id and text only; `drop_near_duplicates` carries all other columns, whatever their names, in one struct.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, in_slices, load, small_batches, stored, unused, worker_cache
from .components import components
from .trie_join import block_links, links

SEED = 42
SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a signature and how many of these may differ (at 0.75 similarity 17.3 % do on average, plus three
#: deviations); windows of it that are joined, and of their bits those that must be equal and those that may
#: differ in the rest (at 0.8 on average 15 % of 44, plus three deviations). None of these changes the result.
SIGNATURE, MOST_SIGNATURE_BITS, TABLES, WINDOW_BITS, BLOCK, RADIUS = 256, 62, 12, 64, 20, 14
#: Texts looked at for the order of the shingles, how many of their shingles are put last at most, and bits
#: of a set's parities (at least, and at most). None of these changes the result.
ORDER_TEXTS, LAST_SHINGLES, PARITIES, ROUNDING = 10_000, 200_000, (64, 1 << 16), 1e-9
#: Sets in a group with others up to which their table is broadcast (16 bytes each); beyond that it is shuffled.
FEW_LINKED = 1 << 16
#: A fingerprint of so many documents, and of this share of all, is common; each common one is dealt over SALTS tasks.
FREQUENT, SALTS = 1000, 64


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every run of `size` words (of all words, if fewer), A-Z lower-cased, as big-endian integers."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, ">u8")
    line = b" ".join(found)
    stops = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], stops[:-1]]).tolist()
    k = min(size, len(found))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[a : b - 1], SEED) for a, b in zip(starts, stops[k - 1 :].tolist())]), ">u8")


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each column of an array (n, columns) of big-endian hashes: 64 flags, most significant first, set in over half."""
    n = len(hashes)
    total = np.zeros(hashes.shape[1] * 64, np.int64)
    for k in range(0, n, 255):  # sums of up to 255 flags fit a byte
        part = np.ascontiguousarray(hashes[k : k + 255]).view(np.uint8).reshape(-1, hashes.shape[1] * 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint8)
    return 2 * total > n


def fingerprint(text: str | None, size: int) -> int:
    h = shingle_hashes(text, size)
    return int.from_bytes(np.packbits(majority(h[:, None])).tobytes(), "big", signed=True) if len(h) else 0


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    def run(batches):
        for b in batches:
            fps = [fingerprint(t, size) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def fingerprint_components(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """Rows (doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most radius bits."""
    rows = stored(fingerprints(docs, size), "simhash")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprints")
    roots = components(links(nodes.select("fp", F.col("fp").alias("id")), 64, radius))
    of = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    of = stored(of, "nodes")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    found = of.join(least, "root").select("fp", "component_id")
    # at most FREQUENT fingerprints are common
    most = max(FREQUENT, rows.count() // FREQUENT)
    common = F.broadcast(nodes.filter(F.col("n") >= most).select("fp", F.lit(True).alias("common")))
    salt = lambda x: F.when(F.col("common"), x)
    dealt = rows.join(common, "fp", "left").withColumn("salt", F.coalesce(salt(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), F.lit(0)))
    salts = F.explode(F.coalesce(salt(F.sequence(F.lit(0), F.lit(SALTS - 1))), F.array(F.lit(0)))).alias("salt")
    found = found.join(common, "fp", "left").select("fp", "component_id", salts)
    return dealt.join(found, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint_components(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of a 64-bit hash."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def signature(shingles: np.ndarray) -> bytes:
    """SimHash bits of a set of hashes."""
    if not len(shingles):
        return bytes(SIGNATURE // 8)
    total, n = np.zeros(SIGNATURE, np.int64), len(shingles)
    for at in range(0, n, 50_000):
        part = shingles[at : at + 50_000]
        hashes = np.stack([_mixed(part, k) for k in range(SIGNATURE // 64)], axis=1).astype(">u8")
        for k in range(0, len(part), 255):
            rows = np.ascontiguousarray(hashes[k : k + 255]).view(np.uint8).reshape(-1, SIGNATURE // 8)
            total += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > n).tobytes()


def shingle_counts(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come in several of about ORDER_TEXTS texts, sorted, and in how many."""

    def run(batches):
        worker_cache("signatures")
        for b in in_slices(batches):
            found = [np.unique(shingle_hashes(t, size).astype(np.uint64)) for t in b.column(0).to_pylist()]
            h, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    every = max(1, texts.count() // ORDER_TEXTS)
    counts = texts.filter(F.pmod("text_hash", F.lit(every)) == 0).select("text").mapInArrow(run, "h long, n long")
    with small_batches(texts.sparkSession):
        found = counts.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "h").limit(LAST_SHINGLES).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(shingles: np.ndarray, counts: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Of a sorted set the first shingles in the order of counts, one of which every similar set shares."""
    n, (h, times) = len(shingles), counts
    weight = np.zeros(n, np.int64)
    if n and len(h):
        at = np.minimum(np.searchsorted(h, shingles), len(h) - 1)
        weight = np.where(h[at] == shingles, times[at], 0)
    k = min(n, n - int(np.ceil(similarity * n - ROUNDING)) + 1)
    return shingles[np.lexsort((shingles, weight))[:k]].view(np.int64)


def parities(shingles: np.ndarray) -> bytes:
    """Flags, one or two for each shingle of a set: whether an odd number of them falls there. A power of two, so that halves can be laid over each other."""
    low, high = PARITIES
    bits = min(high, max(low, 1 << max(0, len(shingles) - 1).bit_length()))
    return np.packbits(np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def least_difference(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """For pairs of parities, how many shingles only one of the sets has, at least: each turns one flag."""
    lx, ly = (np.array([*map(len, c)], np.int64) for c in (x, y))
    out = np.zeros(len(x), np.int64)
    for a, b in set(zip(lx.tolist(), ly.tolist())):
        here = np.flatnonzero((lx == a) & (ly == b)).tolist()
        flags = []
        for c in (x, y):
            part = np.frombuffer(b"".join([c[k] for k in here]), np.uint8).reshape(len(here), -1)
            while part.shape[1] > min(a, b):
                half = part.shape[1] // 2
                part = part[:, :half] ^ part[:, half:]
            flags.append(part)
        out[here] = np.bitwise_count(flags[0] ^ flags[1]).sum(axis=1, dtype=np.int64)
    return out


def exact_candidates(sets: DataFrame, similarity: float) -> DataFrame:
    """sets: id, root, n, prefix. Pairs (a, b) of sets under different roots that may be similar enough: no similar pair is missing.

    Of the root with most sets at a key only the others' partners are formed, never its own pairs.
    """
    keys = sets.select("root", F.explode("prefix").alias("key")).groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    shared = stored(keys.filter("lo < hi").select("key"), "shared-shingles")
    sets_at = stored(sets.select("id", "root", "n", F.posexplode("prefix").alias("pos", "key")).join(shared, "key"), "sets-at-shared-shingles")
    most = sets_at.groupBy("key", "root").agg(F.count(F.lit(1)).alias("times")).groupBy("key").agg(F.max(F.struct("times", "root"))["root"].alias("most"))
    met = sets_at.join(most, "key")
    a, b = (met.select("key", "most", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "root", "n", "pos")]) for x in "ab")
    pairs = a.filter("root_a <> most").join(b.drop("most"), "key").filter("root_a <> root_b and (root_b = most or id_a < id_b)")
    pairs = pairs.filter(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - ROUNDING)
    both = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))  # at most, at the first shared shingle
    pairs = pairs.filter(both >= (F.col("n_a") + F.col("n_b")) * (similarity / (1 + similarity)) - ROUNDING)
    found = stored(pairs.select(F.col("id_b").alias("a"), F.col("id_a").alias("b")).distinct(), "exact-candidates")
    discard(shared, sets_at)
    return found


def near_duplicate_groups(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, text_hash, group_id): group_id is the smallest doc_id of the group, by links of the similarity or more."""
    return _grouped(docs, size, similarity).select("doc_id", "text_hash", F.col("first.doc_id").alias("group_id"))


def _least_row():
    """The row with the smallest doc_id, null ids last, then the smallest text_hash."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))


def _grouped(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Rows (doc_id, text_hash, first): first is the least row of the group, which groups with equal ids don't share."""
    schema = "doc_id long, text_hash long, id long, sig binary, bits binary, n int, prefix array<long>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(texts, size))

    def run(batches):
        worker_cache("signatures")
        for b in in_slices(batches):
            ids, sigs, bits, sizes, firsts = [], [], [], [], []
            for t in b.column(2).to_pylist():
                s = np.unique(shingle_hashes(t, size).astype(np.uint64))
                ids.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
                sigs.append(signature(s))
                bits.append(parities(s))
                sizes.append(len(s))
                firsts.append(prefix(s, counts.value, similarity))
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            firsts = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts or [np.zeros(0, np.int64)])))
            made = [pa.array(ids, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bits, pa.binary()), pa.array(sizes, pa.int32()), firsts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["doc_id", "text_hash", "id", "sig", "bits", "n", "prefix"])

    made = stored(texts.mapInArrow(run, schema), "signatures")  # id: the hash of the set of shingles
    nodes = made.groupBy("id").agg(_least_row().alias("first"), *[F.first(c).alias(c) for c in ("sig", "bits", "n", "prefix")])
    nodes = stored(nodes, "shingle-sets")
    rows = stored(made.select("doc_id", "text_hash", "id"), "texts-of-sets")
    discard(made)
    digits = F.concat(F.hex("sig"), F.hex("sig"))
    part = lambda t, k: F.conv(F.substring(digits, t * BLOCK // 4 + 1 + 8 * k, 8), 16, 10).cast("long")
    tabs = F.explode(F.array(*[F.struct(F.lit(t).alias("tab"), F.shiftleft(part(t, 0), 32).bitwiseOR(part(t, 1)).alias("fp")) for t in range(TABLES)]))
    points = nodes.select("id", "sig", tabs.alias("x")).select("x.tab", "x.fp", "id", "sig")
    candidates = stored(block_links(points, WINDOW_BITS, BLOCK, RADIUS, MOST_SIGNATURE_BITS), "candidates")
    places = nodes.select("id", "first.doc_id", "first.text_hash", "n", "bits")
    roots = components(verify(candidates, places, docs, size, similarity))
    linked = F.broadcast(roots) if roots.limit(FEW_LINKED + 1).count() <= FEW_LINKED else roots
    of = nodes.join(linked, nodes.id == roots.node, "left").select("id", F.coalesce("root", "id").alias("root"), "n", "prefix")
    more = verify(exact_candidates(of, similarity), places, docs, size, similarity)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    of = nodes.select("id", "first").join(roots, nodes.id == roots.node, "left").select("id", "first", F.coalesce("root", "id").alias("root"))
    of = stored(of, "nodes")
    discard(nodes)
    least = of.groupBy("root").agg(F.min("first").alias("first"))
    return rows.select("doc_id", "text_hash", "id").join(of.join(least, "root").select("id", least["first"]), "id").select("doc_id", "text_hash", "first")


def verify(candidates: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of the pairs (a stored table, which goes) whose sets of shingles are similar enough; nodes: id, doc_id, text_hash, n, bits.

    Only texts of pairs that are possible by their parities are looked at. A text with very many partners is b in most of its pairs; sets are joined to b first, while pairs are short.
    """

    def sets(batches):
        for b in in_slices(batches):
            found = [np.unique(shingle_hashes(t, size).astype(np.uint64)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["id", "shingles"])

    def possible(batches):
        for b in in_slices(batches):
            of = {c: b.column(c) for c in ("a", "b", "nx", "ny", "x", "y")}
            both = of["nx"].to_numpy().astype(np.int64) + of["ny"].to_numpy()
            apart = least_difference(of["x"].to_pylist(), of["y"].to_pylist())
            keep = pa.array((both - apart) / 2 >= similarity / (1 + similarity) * both - ROUNDING)
            yield pa.RecordBatch.from_arrays([of[c].filter(keep) for c in ("a", "b")], ["a", "b"])

    def similar(batches):
        for b in in_slices(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns[:2]], ["a", "b"])

    left, right = (nodes.select(F.col("id").alias(c), F.col("n").alias(f"n{x}"), F.col("bits").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    pairs = stored(candidates.join(right, "b").join(left, "a").mapInArrow(possible, "a long, b long"), "possible")
    discard(candidates)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes.select("id", "doc_id", "text_hash"), "id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = texts.join(wanted, (texts.doc_id.eqNullSafe(wanted.doc_id)) & (texts.text_hash == wanted.text_hash)).select("id", "text").dropDuplicates(["id"])
    have = stored(texts.mapInArrow(sets, "id long, shingles binary"), "shingles")
    met = pairs.join(have.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(have.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    found = stored(met.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long"), "verified")
    discard(pairs, have)
    return found


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group, that with the smallest doc_id (null ids last), of several texts under it that with the smallest hash; repeated rows of it are one."""
    d, h, rest = unused(docs.columns, "_d", "_h", "_rest")
    no_id = F.lit(-(1 << 63))
    first = _grouped(docs.select("doc_id", "text"), size, similarity).select("first.doc_id", "first.text_hash")
    keep = first.select(F.coalesce("doc_id", no_id).alias(d), F.coalesce("text_hash", F.lit(0)).alias(h)).distinct()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias(d), F.coalesce(F.xxhash64("text"), F.lit(0)).alias(h), F.struct(*docs.columns).alias(rest))
    rows = rows.join(keep, [d, h], "left_semi").groupBy(d, h).agg(F.first(rest).alias(rest))
    return rows.select(*[F.col(rest)[c].alias(c) for c in docs.columns])
