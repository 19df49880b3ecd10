"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Items (pieces of documents) are dealt by hash into blocks of about BLOCK_ITEMS. In every block a
few islands each evolve a small population of packings: crossover puts whole well-filled bins of
one parent into the other, drops the bins that now hold something twice, swaps displaced items for
smaller ones where that fills a bin better, and best-fits the rest. An island whose best packing has as few
bins as the sizes allow stops: plain best-fit often gets there. Between rounds each island's elite also goes to the next island of its block. Then the
least-filled bins of 16 neighbouring blocks are packed anew together, up to a single block, so
that blocks cost next to nothing against one global packing. Blocks have a bounded size, so no
task sees all items; full-length pieces are sequences of their own and skip all this.

Rows: null texts count as empty (one piece, the end id alone); repeated rows are items of their
own, also with null or repeated ids; an empty table gives no rows. Longer texts than a sequence are cut; equal
sizes are packed in any order. Only doc_id and text are read; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_slices, load, stored, worker_cache
from .tokens import encoder, in_groups

SEQUENCE, BLOCK_ITEMS, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 4096, 2000, 3, 2, 16, 6
#: Generations without a better packing after which an island stops.
PATIENCE = 6
#: Blocks joined at each further level, and bins that each of them hands on.
FAN_IN, HANDED_ON = 16, 24


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, leading_space: bool, most: int = SEQUENCE) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only if longer than most."""

    def cut(batches):
        encode = encoder(tokenizer_path, leading_space).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in in_slices(batches):
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            row, piece, start, length, crc = [], [], [], [], []
            for lo, hi in in_groups(texts):
                for i, raw in enumerate(encode(texts[lo:hi]), lo):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * most)):
                        part = raw[at : at + 4 * most]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            ids = doc_ids.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(bins: list[list[int]], room: list[int], items: list[int], size: list[int], most: int) -> None:
    """Put items, longest first, each into the bin with the least room that still holds it."""
    free = sorted((r, b) for b, r in enumerate(room) if r > 0)
    for x in sorted(items, key=lambda i: (-size[i], i)):
        k = bisect_left(free, (size[x], -1))
        if k < len(free):
            r, b = free.pop(k)
        else:
            r, b = most, len(bins)
            bins.append([])
            room.append(most)
        bins[b].append(x)
        room[b] = r - size[x]
        if room[b]:
            insort(free, (room[b], b))


def fitness(bins: list[list[int]], room: list[int], most: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones: they leave room for others."""
    return -len(bins), sum((1 - r / most) ** 2 for r in room)


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], most: int, rng: random.Random) -> list[list[int]]:
    """Whole well-filled bins of a go into b; b's bins that share items with them are dissolved and the rest best-fitted."""
    filled = sorted(a, key=lambda x: -sum(size[i] for i in x))
    share = filled[: max(1, int(len(filled) * rng.uniform(0.2, 0.6)))]
    there = {i for x in share for i in x}
    kept = [x for x in b if there.isdisjoint(x)]
    placed = there.union(*kept)
    child = [list(x) for x in share + kept]
    return settle(child, [i for x in b for i in x if i not in placed], size, most)


def settle(bins: list[list[int]], loose: list[int], size: list[int], most: int) -> list[list[int]]:
    """Put loose items into bins: first in exchange for one or two that fill their bin less, then by best fit."""
    room = [most - sum(size[i] for i in x) for x in bins]
    free = sorted((size[i], i) for i in loose)

    def swap(b: int, out: list[int]) -> bool:
        weight = sum(size[i] for i in out)
        k = bisect_left(free, (weight + room[b] + 1, -1)) - 1
        if k < 0 or free[k][0] <= weight:
            return False
        better, x = free.pop(k)
        for i in out:
            bins[b].remove(i)
            insort(free, (size[i], i))
        bins[b].append(x)
        room[b] -= better - weight
        return True

    for b in sorted(range(len(bins)), key=lambda k: -room[k]):
        if not free:
            break
        if room[b] and not any(swap(b, [i]) for i in sorted(bins[b], key=lambda i: size[i])):
            any(swap(b, list(pair)) for pair in combinations(bins[b][:8], 2))
    best_fit(bins, room, [i for _, i in free], size, most)
    return bins


def mutate(bins: list[list[int]], size: list[int], most: int, rng: random.Random) -> list[list[int]]:
    """Dissolve the least-filled bin and a few others at random, and settle their items."""
    order = sorted(range(len(bins)), key=lambda b: sum(size[i] for i in bins[b]))
    gone = {order[0], *rng.sample(range(len(bins)), min(len(bins), 1 + len(bins) // 20))}
    kept = [list(x) for k, x in enumerate(bins) if k not in gone]
    return settle(kept, [i for k in gone for i in bins[k]], size, most)


def evolve(size: list[int], seeds: list[list[list[int]]], most: int, generations: int, population: int, rng: random.Random) -> list[list[list[int]]]:
    """The two best packings after some generations."""
    everyone = list(range(len(size)))
    start = list(seeds)
    while len(start) < population:
        bins: list[list[int]] = []
        if not start:
            best_fit(bins, [], everyone, size, most)
        else:  # another packing: half of the items in random groups first
            some = rng.sample(everyone, len(everyone) // 2)
            half = set(some)
            best_fit(bins, [], some, size, most)
            best_fit(bins, [most - sum(size[i] for i in x) for x in bins], [i for i in everyone if i not in half], size, most)
        start.append(bins)
    rank = lambda x: fitness(x, [most - sum(size[i] for i in b) for b in x], most)
    people = sorted(start, key=rank, reverse=True)[:population]
    least, waited = -(-sum(size) // most), 0
    for _ in range(generations):
        if len(people[0]) <= least or waited >= PATIENCE:
            break
        best = rank(people[0])
        a, b = rng.sample(people[: max(2, population // 2)], 2)
        child = crossover(a, b, size, most, rng)
        people = sorted([*people, child, mutate(child, size, most, rng)], key=rank, reverse=True)[:population]
        waited = 0 if rank(people[0]) > best else waited + 1
    return people[:2]


def _pack_blocks(items: DataFrame, most: int) -> DataFrame:
    """items: block, uid, length. Rows (block, uid, length, bin), the best packing that any island of the block found."""
    islands = items.withColumn("island", F.explode(F.array([F.lit(k) for k in range(ISLANDS)])))
    schema = "block long, island int, score double, bins array<int>"

    def step(pdf: pd.DataFrame, seeds: pd.DataFrame | None, turn: int) -> pd.DataFrame:
        worker_cache("packing")  # the tokenizer and its chunks go
        pdf = pdf.sort_values(["length", "uid"], ascending=[False, True])
        block, island, size = int(pdf.block.iloc[0]), int(pdf.island.iloc[0]), pdf.length.tolist()
        found = []
        for flat in [] if seeds is None else seeds.bins:
            groups: dict[int, list[int]] = {}
            for i, b in enumerate(flat):
                groups.setdefault(int(b), []).append(i)
            found.append(list(groups.values()))
        best = evolve(size, found, most, GENERATIONS, POPULATION, random.Random(block * 1009 + island * 31 + turn))
        rows = []
        for bins in best:
            where = np.empty(len(size), np.int32)
            for b, x in enumerate(bins):
                where[x] = b
            n, even = fitness(bins, [most - sum(size[i] for i in x) for x in bins], most)
            rows.append((block, island, n + even / (len(bins) + 1), where))
        return pd.DataFrame(rows, columns=["block", "island", "score", "bins"])

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return step(pdf, None, 0)

    def again(pdf: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        return step(pdf, seeds, len(seeds))

    elite = islands.groupBy("block", "island").applyInPandas(first, schema)
    for _ in range(1, ROUNDS):  # the elite stays and migrates
        both = elite.withColumn("island", F.explode(F.array(F.col("island"), (F.col("island") + 1) % ISLANDS)))
        elite = islands.groupBy("block", "island").cogroup(both.groupBy("block", "island")).applyInPandas(again, schema)
    best = elite.groupBy("block").agg(F.max_by("bins", F.struct("score", F.hash("bins"))).alias("bins"))

    def place(pdf: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ascending=[False, True])
        return pdf.assign(bin=np.asarray(won.bins.iloc[0], np.int64))[["block", "uid", "length", "bin"]]

    return items.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(place, "block long, uid long, length long, bin long")


def pack(pieces: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """pieces: uid, length (1 to most). Rows (uid, sequence_id, offset)."""
    spark = pieces.sparkSession
    full = pieces.filter(F.col("length") >= most).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.filter(F.col("length") < most)
    blocks = max(1, round(items.count() / BLOCK_ITEMS))
    items = items.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"), "uid", "length")
    done = []
    while True:
        packed = stored(_pack_blocks(items, most), "packed")
        if blocks == 1:
            done.append(packed)
            break
        fill = packed.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
        loose = fill.groupBy("block").agg(F.slice(F.array_sort(F.collect_list(F.struct("fill", "bin"))), 1, HANDED_ON).alias("b")).select("block", F.explode("b.bin").alias("bin"))
        done.append(packed.join(loose, ["block", "bin"], "left_anti"))
        items = packed.join(loose, ["block", "bin"], "left_semi").select(F.floor(F.col("block") / FAN_IN).alias("block"), "uid", "length")
        blocks = -(-blocks // FAN_IN)
    placed = None
    for level, d in enumerate(done):  # a sequence takes the smallest id of its pieces as its number
        d = d.select("uid", "block", "bin", "length", F.lit(level).alias("level"))
        placed = d if placed is None else placed.unionByName(d)
    sequence = Window.partitionBy("level", "block", "bin")  # at most `most` pieces
    before = F.sum("length").over(sequence.orderBy("uid").rowsBetween(Window.unboundedPreceding, -1))
    return placed.select("uid", F.min("uid").over(sequence).alias("sequence_id"), F.coalesce(before, F.lit(0)).alias("offset")).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, leading_space: bool = False, most: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut_pieces(docs, tokenizer_path, end_id, leading_space, most).withColumn("uid", F.monotonically_increasing_id())
    pieces = stored(pieces, "pieces")
    placed = pack(pieces.select("uid", "length"), most)
    return pieces.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
