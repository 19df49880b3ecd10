"""The prefix trie of conversations: every distinct run of first turns, with what lies below it.

A turn becomes a token, the 128-bit hash of its role and text, and a run of turns the polynomial of its tokens
modulo 2^127 - 1, so the name of any prefix follows from two parts' names. Ranges of the turns, sorted by
conversation and turn, are cut into pieces of at most PIECE turns; a range hands on one number pair (turns and
hash of the conversation that goes on), so a conversation of any length is many tasks.

Pieces are sorted by path into shards of the trie. A task packs as many as SHARD turns at a time into a double
array: tokens get dense ids, a node is a slot, its child by id x is BASE[slot] + x, and CHECK there names the
parent. Walking all pieces through the arrays counts members. Nodes that several shards share (the upper ones)
are added up by name.

What lies below a node is summed without walking level by level: of the members of a node one stands for it,
that with the least mixed id. Nodes with one representative form a chain, and a path meets a number of chains
that grows with the logarithm of the number of conversations, as the mix is random. Chains send their totals up
in so many rounds; within a chain sums run over ranges of depth.

Rows: a null conv_id names no conversation, such rows are left out; null turns come first, equal turns are in
the order of role and text (bytes); a null role or text is empty. A repeated row is one more turn. An empty table
gives no node, a table with conversations at least the root. Texts are only hashed and measured, so their length
is no matter. Only conv_id, turn, role and text are read; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, in_slices, load, shuffle_partitions, stored, worker_cache

PIECE, SHARD, RANGE = 256, 200_000, 1024
#: Conversations that share the first turns of one of them, and how many turns that are at most.
FAMILY, SHARED = 100, 5
MODULUS, FACTOR = (1 << 127) - 1, 0x5DEECE66D1F8A3B79C3E2C1D0F4B6A95
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Bytes of a token that take part in a piece's place among the shards, and how many tokens do.
PATH_BYTES, PATH_TOKENS = 4, 12


def as_bytes(h: int) -> bytes:
    return h.to_bytes(16, "big")


def as_int(b: bytes) -> int:
    return int.from_bytes(b, "big")


def token(role: str, text: str) -> int:
    r = role.encode()
    return xxhash.xxh3_128_intdigest(len(r).to_bytes(8, "big") + r + text.encode()) % MODULUS


def extended(h: int, tokens: list[int]) -> int:
    """The hash of a run of turns that goes on with these."""
    for t in tokens:
        h = (h * FACTOR + t) % MODULUS
    return h


def joined(h: int, n: int, other: int) -> int:
    """The hash of a run that goes on with another, of n turns."""
    return (h * pow(FACTOR, n, MODULUS) + other) % MODULUS


def tokens_of(blob: bytes) -> list[int]:
    return [as_int(blob[k : k + 16]) for k in range(0, len(blob), 16)]


def mixed(ids: np.ndarray) -> np.ndarray:
    """Another whole number for each (int64), one to one, in no order."""
    z = ids.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def _batch(kinds: dict, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))


PIECES = {"conv_id": pa.int64(), "part": pa.int32(), "place": pa.int64(), "n": pa.int32(), "before": pa.binary(), "own": pa.binary(), "tokens": pa.binary(), "lengths": pa.binary()}


def turn_pieces(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, part, place, n, before, own, tokens, lengths): n turns of a conversation; of its turns in the same part, `place` come before, with the hash `before`."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", plain("role"), plain("text"))
    rows = rows.withColumn("nth", F.monotonically_increasing_id())  # deals equal rows out too
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("nth")]
    rows = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order).select("conv_id", "role", "text")

    def run(batches):
        worker_cache("prefix_trie")
        part, conv, out = TaskContext.get().partitionId(), None, []
        place = before = 0
        held, lengths = [], []

        def close():
            nonlocal place, before, held, lengths
            if held:
                own = extended(0, held)
                out.append((conv, part, place, len(held), as_bytes(before), as_bytes(own), b"".join(map(as_bytes, held)), np.array(lengths, np.int64).tobytes()))
                place, before = place + len(held), joined(before, len(held), own)
                held, lengths = [], []

        for b in in_slices(batches):
            for c, role, text in zip(*(x.to_pylist() for x in b.columns)):
                if c != conv:
                    close()
                    conv, place, before = c, 0, 0
                elif len(held) == PIECE:
                    close()
                held.append(token(role, text))
                lengths.append(len(text))
            if len(out) >= 2000:
                yield _batch(PIECES, out)
                out = []
        close()
        if out:
            yield _batch(PIECES, out)

    schema = "conv_id long, part int, place long, n int, before binary, own binary, tokens binary, lengths binary"
    return stored(rows.mapInArrow(run, schema), "turn-pieces")


def carried_over(pieces: DataFrame) -> dict[int, tuple[int, int, int]]:
    """For each part that begins within a conversation: its id, and the number and hash of its turns before. A row for each part reaches the driver."""
    ends = pieces.groupBy("part", "conv_id").agg(F.max(F.struct("place", "n", "before", "own")).alias("end"))
    ends = ends.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "end")).alias("last"))
    out, conv, turns, h = {}, None, 0, 0
    for r in ends.orderBy("part").collect():
        if r["first"] == conv:
            out[r["part"]] = (conv, turns, h)
        end = r["last"]["end"]
        n, own = end["place"] + end["n"], joined(as_int(end["before"]), end["n"], as_int(end["own"]))
        last = r["last"]["conv_id"]
        conv, turns, h = (conv, turns + n, joined(h, n, own)) if last == conv else (last, n, own)
    return out


PLACED = "conv_id long, rank long, n int, before binary, tokens binary, lengths binary"


def placed(pieces: DataFrame) -> DataFrame:
    """The pieces with the number (rank) and hash (before) of all earlier turns of their conversation."""
    sent = pieces.sparkSession.sparkContext.broadcast(carried_over(pieces))
    names = ["conv_id", "rank", "n", "before", "tokens", "lengths"]

    def run(batches):
        for b in batches:
            rank, before = [], []
            for conv, part, place, h in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "place", "before"))):
                of, turns, earlier = sent.value.get(part, (None, 0, 0))
                rank.append(place + turns if of == conv else place)
                before.append(as_bytes(joined(earlier, place, as_int(h))) if of == conv else h)
            made = [b.column("conv_id"), pa.array(rank, pa.int64()), b.column("n"), pa.array(before, pa.binary()), b.column("tokens"), b.column("lengths")]
            yield pa.RecordBatch.from_arrays(made, names)

    return pieces.mapInArrow(run, PLACED)


PATHS = {"path": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "start": pa.binary(), "end": pa.binary(), "last": pa.bool_(), "tokens": pa.binary(), "lengths": pa.binary()}


def rebuilt_pieces(pieces: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """Every conversation c with its first h = crc32(c) % (shared + 1) turns replaced by those of conversation c - c % family.

    Rows (path, conv_id, depth, start, end, last, tokens, lengths): turns after the prefix `start` of `depth` turns; `last` of each conversation there is one.
    """
    rows = placed(pieces)
    head = F.when(F.col("rank") < shared, F.struct("rank", F.substring("tokens", 1, 16 * shared).alias("tokens"), F.substring("lengths", 1, 8 * shared).alias("lengths")))
    convs = stored(rows.groupBy("conv_id").agg(F.max(F.col("rank") + F.col("n")).alias("turns"), F.array_sort(F.collect_list(head)).alias("head")), "conversations")
    glued = lambda c: F.array_join(F.transform(F.col("head"), lambda x: F.hex(x[c])), "")
    convs_plain = convs.select("conv_id", "turns", F.unhex(glued("tokens")).alias("head"), F.unhex(glued("lengths")).alias("head_lengths"))
    base = convs_plain.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"), F.col("head_lengths").alias("base_lengths"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (shared + 1)).cast("int")
    convs_plain = convs_plain.withColumns({"base": F.col("conv_id") - F.col("conv_id") % family, "h": h}).join(base, "base", "left")
    rows = rows.join(convs_plain.drop("base", "head_lengths"), "conv_id")

    def run(batches):
        worker_cache("prefix_trie")
        for b in in_slices(batches):
            out = []
            for x in b.to_pylist():
                h, rank, n = x["h"], x["rank"], x["n"]
                base, lengths = (x["base_head"] or b"")[: 16 * h], (x["base_lengths"] or b"")[: 8 * h]
                skip = min(max(h - rank, 0), n)
                own, own_lengths, depth, start = x["tokens"][16 * skip :], x["lengths"][8 * skip :], 0, 0
                if rank == 0:
                    own, own_lengths = base + own, lengths + own_lengths
                else:
                    depth, start = len(base) // 16 + max(rank - h, 0), extended(0, tokens_of(base))
                    if rank > h:
                        changed = start - extended(0, tokens_of(x["head"][: 16 * h]))
                        start = (as_int(x["before"]) + changed * pow(FACTOR, rank - h, MODULUS)) % MODULUS
                last = rank + n == x["turns"]
                if own or last:
                    path = as_bytes(start) + b"".join(own[k : k + PATH_BYTES] for k in range(0, min(len(own), 16 * PATH_TOKENS), 16))
                    out.append((path, x["conv_id"], depth, as_bytes(start), as_bytes(extended(start, tokens_of(own))), last, own, own_lengths))
            if out:
                yield _batch(PATHS, out)

    schema = "path binary, conv_id long, depth long, start binary, end binary, last boolean, tokens binary, lengths binary"
    return stored(rows.mapInArrow(run, schema), "paths")


class DoubleArray:
    """BASE and CHECK over sequences of dense ids; slot 0 is the top."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.base, self.check, self.low = np.zeros(1024, np.int64), np.full(1024, -1, np.int64), 1
        self.check[0] = 0
        side = int(ids.max()) + 1 if len(ids) else 1
        state = np.zeros(len(starts), np.int64)
        for d in range(int(lengths.max()) if len(lengths) else 0):
            on = np.flatnonzero(lengths > d)
            code, place = np.unique(state[on] * side + ids[starts[on] + d], return_inverse=True)
            state[on] = self._add(code // side, code % side)[place]

    def _grow(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            more = max(more, len(self.check))
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1, np.int64))

    def _free(self, n: int) -> np.ndarray:
        """The first n free slots."""
        while len(found := self.low + np.flatnonzero(self.check[self.low : self.low + 4 * n + 64] < 0)) < n:
            if (every := np.flatnonzero(self.check[self.low :] < 0)).size >= n:
                found = self.low + every
                break
            self._grow(len(self.check) + n)
        self.low = int(found[0])
        return found[:n]

    def _add(self, parents: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Slots of new children; parents are sorted, and each one's ids."""
        first = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        count = np.diff(np.append(first, len(parents)))
        slots = np.zeros(len(parents), np.int64)
        for k in np.argsort(-count, kind="stable")[: int((count > 1).sum())].tolist():  # the widest first
            lo, hi = int(first[k]), int(first[k] + count[k])
            steps = ids[lo:hi] - ids[lo]
            self._grow(self.low + int(steps[-1]) + 256)
            tried = self._free(64)
            self._grow(int(tried[-1] + steps[-1]) + 1)
            fits = np.flatnonzero((self.check[tried[:, None] + steps] < 0).all(axis=1))
            at = int(tried[fits[0]]) if len(fits) else len(self.check)
            self._grow(at + int(steps[-1]) + 1)
            slots[lo:hi] = at + steps
            self.check[slots[lo:hi]] = parents[lo]
            self.base[parents[lo]] = at - ids[lo]
        one = first[count == 1]
        if len(one):
            slots[one] = self._free(len(one))
            self.check[slots[one]], self.base[parents[one]] = parents[one], slots[one] - ids[one]
        return slots

    def step(self, state: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The children of slots by ids; -1 where there is none."""
        at = self.base[state] + ids
        there = (at > 0) & (at < len(self.check))
        return np.where(there & (self.check[np.where(there, at, 0)] == state), at, -1)


NODES = {"node": pa.binary(), "parent": pa.binary(), "depth": pa.int64(), "n": pa.int64(), "conv_id": pa.int64(), "rep": pa.int64(), "length": pa.int64()}


def shard_nodes(rows: list[tuple]) -> pa.RecordBatch:
    """Nodes below the starts of some pieces (conv_id, depth, start, last, tokens, lengths), and the root's share of these conversations."""
    ends = np.array([r[0] for r in rows if r[3]], np.int64)
    out = [(as_bytes(0), None, 0, len(ends), int(ends.min()), int(mixed(ends).min()), 0)] if len(ends) else []
    rows = [r for r in rows if r[4]]
    # dense ids level by level, so children of a node get neighbouring ones
    names: dict[bytes, int] = {}
    for r in rows:
        names.setdefault(b"s" + r[2], len(names))
    turns = np.array([len(r[4]) // 16 for r in rows], np.int64)
    starts = np.cumsum(turns + 1) - turns - 1
    ids = np.zeros(int((turns + 1).sum()), np.int64)
    ids[starts] = [names[b"s" + r[2]] for r in rows]
    order = np.argsort(-turns, kind="stable").tolist()
    for d in range(int(turns.max()) if len(turns) else 0):
        for k in order:
            if turns[k] <= d:
                break
            t = rows[k][4][16 * d : 16 * d + 16]
            ids[starts[k] + 1 + d] = names.setdefault(t, len(names))
    trie = DoubleArray(ids, starts, turns + 1)
    lengths = [np.frombuffer(r[5], np.int64) for r in rows]
    conv = np.array([r[0] for r in rows], np.int64)
    rep, none = mixed(conv), np.iinfo(np.int64).max
    size = len(trie.check)
    name: dict[int, int] = {}
    state = np.zeros(len(rows), np.int64)
    for d in range(int(turns.max()) + 1 if len(turns) else 0):
        on = np.flatnonzero(turns >= d)
        before, state[on] = state[on], trie.step(state[on], ids[starts[on] + d])
        slots, first, place, n = np.unique(state[on], return_index=True, return_inverse=True, return_counts=True)
        least, least_rep = np.full(len(slots), none), np.full(len(slots), none)
        np.minimum.at(least, place, conv[on])
        np.minimum.at(least_rep, place, rep[on])
        for j, (slot, f) in enumerate(zip(slots.tolist(), first.tolist())):
            r = rows[on[f]]
            if d == 0:
                name[slot] = as_int(r[2])
                continue
            up = name[int(before[f])]
            name[slot] = extended(up, [as_int(r[4][16 * d - 16 : 16 * d])])
            out.append((as_bytes(name[slot]), as_bytes(up), r[1] + d, int(n[j]), int(least[j]), int(least_rep[j]), int(lengths[on[f]][d - 1])))
    assert size == len(trie.check) and (state >= 0).all()
    return _batch(NODES, out)


def trie_nodes(paths: DataFrame) -> DataFrame:
    """Rows (node, parent, depth, n, conv_id, rep, length), stored: every node with its members' number, least id and least mixed id, and its last text's length."""
    n = shuffle_partitions(paths.sparkSession)
    rows = paths.select("path", "conv_id", "depth", "start", "last", "tokens", "lengths").repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches):
        worker_cache("prefix_trie")
        held, turns = [], 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "depth", "start", "last", "tokens", "lengths"))):
                held.append(r)
                turns += len(r[4]) // 16
                if turns >= SHARD or len(held) >= SHARD:
                    yield shard_nodes(held)
                    held, turns = [], 0
        if held:
            yield shard_nodes(held)

    parts = rows.mapInArrow(run, "node binary, parent binary, depth long, n long, conv_id long, rep long, length long")
    kept = [F.first(c).alias(c) for c in ("parent", "depth", "length")]
    return stored(parts.groupBy("node").agg(*kept, F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.min("rep").alias("rep")), "trie-nodes")


def end_digests(paths: DataFrame) -> DataFrame:
    """Rows (node, ends): SHA-256 of the ids of the conversations that end at a node, ascending and comma-joined.

    Ranges of ids are joined apart, so a node's rows are few where very many end there; the digest itself has to read their text in order.
    """
    n = shuffle_partitions(paths.sparkSession)
    rows = paths.filter("last").select("conv_id", "end").repartitionByRange(n, "conv_id").sortWithinPartitions("conv_id")

    def gather(batches):
        for b in batches:
            found: dict[bytes, list[int]] = {}
            for c, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(e, []).append(c)
            yield _batch({"node": pa.binary(), "least": pa.int64(), "ids": pa.string()}, [(e, c[0], ",".join(map(str, c))) for e, c in found.items()])

    def digest(batches):
        node, h, out = None, None, []
        for b in batches:
            for e, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if e != node:
                    if node is not None:
                        out.append((node, h.hexdigest()))
                    node, h = e, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield _batch({"node": pa.binary(), "ends": pa.string()}, out)
                out = []
        if node is not None:
            yield _batch({"node": pa.binary(), "ends": pa.string()}, [(node, h.hexdigest())])

    some = rows.mapInArrow(gather, "node binary, least long, ids string")
    return some.repartition(n, "node").sortWithinPartitions("node", "least").mapInArrow(digest, "node binary, ends string")


def chain_totals(chains: DataFrame) -> list[DataFrame]:
    """chains: rep, up, at, w, l (own sums), k (chains that hang on it). Stored tables of the same whose w and l have all that hangs below, too."""
    done = []
    while True:
        chains = stored(chains, "chains")
        done.append(chains.filter("k = 0"))
        if chains.filter("k > 0").isEmpty():
            return done
        sent = done[-1].groupBy("up").agg(F.sum("w").alias("more_w"), F.sum("l").alias("more_l"), F.count(F.lit(1)).alias("came")).withColumnRenamed("up", "rep")
        more = lambda c: F.coalesce(F.col(c), F.lit(0))
        chains = chains.filter("k > 0").join(sent, "rep", "left")
        chains = chains.select("rep", "up", "at", (F.col("w") + more("more_w")).alias("w"), (F.col("l") + more("more_l")).alias("l"), (F.col("k") - more("came")).alias("k"))


def prefix_trie(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one for each node."""
    pieces = turn_pieces(conversations)
    paths = rebuilt_pieces(pieces, family, shared)
    discard(pieces)
    nodes = trie_nodes(paths)
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("rep").alias("up"))
    below = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    linked = nodes.join(above, "parent", "left").join(below, "node", "left").join(end_digests(paths), "node", "left")
    linked = linked.select("conv_id", "depth", "parent_conv_id", "n", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends"), "rep", "up", ((F.col("n") - 1) * F.col("length")).alias("w"))
    linked = stored(linked, "linked-nodes").withColumn("l", (F.col("n_children") == 0).cast("long"))

    chains = linked.groupBy("rep").agg(F.min_by(F.struct("up", "depth"), "depth").alias("top"), F.sum("w").alias("w"), F.sum("l").alias("l"))
    chains = chains.select("rep", "top.up", (F.col("top.depth") - 1).alias("at"), "w", "l")
    hanging = chains.filter("up is not null").groupBy(F.col("up").alias("rep")).agg(F.count(F.lit(1)).alias("k"))
    totals = chain_totals(chains.join(hanging, "rep", "left").withColumn("k", F.coalesce("k", F.lit(0))))
    every = totals[0]
    for t in totals[1:]:
        every = every.unionByName(t)
    attached = every.filter("up is not null").groupBy(F.col("up").alias("rep"), F.col("at").alias("depth")).agg(F.sum("w").alias("more_w"), F.sum("l").alias("more_l"))

    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    rows = linked.join(attached, ["rep", "depth"], "left").select("*", F.floor(F.col("depth") / RANGE).alias("range")).select("conv_id", "depth", "parent_conv_id", "n", "n_children", "ends", "rep", "range", plus("w", "more_w"), plus("l", "more_l"))
    rows = stored(rows, "nodes-of-chains")
    after = Window.partitionBy("rep").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    later = rows.groupBy("rep", "range").agg(F.sum("w").alias("sum_w"), F.sum("l").alias("sum_l"))
    later = later.select("rep", "range", F.sum("sum_w").over(after).alias("later_w"), F.sum("sum_l").over(after).alias("later_l")).filter("later_w is not null")
    inside = Window.partitionBy("rep", "range").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"w": F.sum("w").over(inside), "l": F.sum("l").over(inside)}).join(later, ["rep", "range"], "left")
    return rows.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", plus("l", "later_l").alias("n_leaves"), plus("w", "later_w").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(load(spark, sf_dir, "conversations"))
