"""Stupid-backoff language-model scores, computed relationally over the whole corpus.

Words are lower-cased. The count tables are those of all documents: bigrams that occur LEAST_COUNT times or
more, and all words. A word w after v scores log(c(v w) / c(v)) if the bigram is in its table, else
log(BACKOFF * c(w) / N); a text's first word always backs off. A text's score is the sum over its words.

Texts are stored in blocks of about BLOCK_WORDS words. A block's distinct n-grams (words and bigrams, as 64-bit
hashes) leave it once with their number there, partitioned by hash range; a range sums them to its part of the
count table and joins the table to the n-grams of each block. The counts go back to the block, where the
n-grams of each text are looked up and summed. However frequent an n-gram is, a block sends it once, so no range
and no block grows with it; the number of ranges grows with the corpus.

Rows: null and wordless texts have no words and the score 0; equal rows count as often as they are there and
get equal scores; an id used by several texts keeps them apart, null ids are like any other; an empty table gives
an empty result. A very long text is cut over blocks and summed again. Only doc_id and text are read; other columns,
whatever their names, don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, stored, words

BACKOFF, LEAST_COUNT = 0.4, 2
#: Words (or rows) after which a block is full, and words of the corpus for each hash range.
BLOCK_WORDS, BLOCK_ROWS, RANGE_WORDS = 1_000_000, 100_000, 2_000_000


def _planes(values: np.ndarray) -> bytes:
    """Compressed byte planes: high bytes are mostly zero."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T), 3)


def _from_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _deltas(values: np.ndarray) -> bytes:
    """Differences, which wrap where the values fall."""
    return _planes(np.diff(values, prepend=np.uint64(0)))


def _from_deltas(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw, np.uint64), dtype=np.uint64)


def _pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    odd = np.uint64(0x9E3779B97F4A7C15)
    x = v * odd + (w ^ (w >> np.uint64(29)))
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * odd
    return x ^ (x >> np.uint64(32))


def _blocker(block_words: int):
    def blocks(batches):
        """Rows (doc_id, text_hash, h) to blocks: a vocabulary of word hashes, most frequent first, and each word's place in it."""
        part, number = TaskContext.get().partitionId(), 0
        ids, hashes, lengths, values, size, rows = [], [], [], [], 0, 0

        def block():
            found, of, n = np.unique(np.concatenate(values).view(np.uint64), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # equally frequent words stay in hash order
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            lists = [pa.array([pa.concat_arrays(x).to_pylist()], pa.list_(pa.int64())) for x in (ids, hashes)]
            packed = [pa.array([x], pa.binary()) for x in (_deltas(found[order]), _planes(rank[of]))]
            columns = [pa.array([part << 32 | number], pa.int64()), *lists, pa.array([np.concatenate(lengths)], pa.list_(pa.int64())), *packed]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "text_hashes", "lengths", "vocabulary", "places"])

        for b in batches:
            offsets, flat = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy()
            at = 0
            while at < len(b):
                # the rows that still fit, at least one
                fit = int(np.searchsorted(offsets, offsets[at] + block_words - size, "right")) - 1
                to = min(max(fit, at + 1), len(b), at + BLOCK_ROWS - rows)
                ids.append(b.column(0).slice(at, to - at))
                hashes.append(b.column(1).slice(at, to - at))
                lengths.append(np.diff(offsets[at : to + 1]).astype(np.int64))
                values.append(flat[offsets[at] : offsets[to]].copy())
                size, rows, at = size + int(offsets[to] - offsets[at]), rows + to - at, to
                if size >= block_words or rows >= BLOCK_ROWS or at < len(b):
                    yield block()
                    number += 1
                    ids, hashes, lengths, values, size, rows = [], [], [], [], 0, 0
        if rows:
            yield block()

    return blocks


def _grams(lengths: np.ndarray, vocabulary: np.ndarray, places: np.ndarray):
    """The distinct n-grams of a block in hash order, and of each word its own place there and its bigram's (first words: -1)."""
    later = np.ones(len(places), bool)
    starts = np.cumsum(lengths) - lengths
    later[starts[lengths > 0]] = False
    at = np.flatnonzero(later)
    pairs, which = np.unique(places[at - 1].astype(np.uint64) << np.uint64(32) | places[at], return_inverse=True)
    hashes = _pair_hash(vocabulary[(pairs >> np.uint64(32)).astype(np.int64)], vocabulary[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)])
    grams, of = np.unique(np.concatenate([vocabulary, hashes]), return_inverse=True)
    words_at, bigrams_at = of[: len(vocabulary)][places], np.full(len(places), -1)
    bigrams_at[at] = of[len(vocabulary) :][which]
    return grams, words_at, bigrams_at


def _read_block(row: dict):
    return np.array(row["lengths"], np.int64), _from_deltas(row["vocabulary"]), _from_planes(row["places"], np.uint32)


def _sender(ranges: int):
    bounds = np.array([(i << 64) // ranges for i in range(ranges)], np.uint64)

    def send(batches):
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1).to_pylist()[0]
                grams, words_at, bigrams_at = _grams(*_read_block(row))
                n = np.bincount(words_at, minlength=len(grams)) + np.bincount(bigrams_at[bigrams_at >= 0], minlength=len(grams))
                cuts = np.append(np.searchsorted(grams, bounds), len(grams))
                full = [(k, a, z) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if z > a]
                columns = [
                    pa.array([k for k, _, _ in full], pa.int64()), pa.array([row["block"]] * len(full), pa.int64()),
                    pa.array([_deltas(grams[a:z]) for _, a, z in full], pa.binary()), pa.array([_planes(n[a:z].astype(np.uint32)) for _, a, z in full], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "block", "grams", "n"])

    return send


def _count(table: pa.Table) -> pa.Table:
    """One hash range: its part of the count table, joined to the n-grams of each block."""
    grams = [_from_deltas(x) for x in table.column("grams").to_pylist()]
    found, of = np.unique(np.concatenate(grams), return_inverse=True)
    n = np.concatenate([_from_planes(x, np.uint32) for x in table.column("n").to_pylist()])
    c = np.bincount(of, weights=n, minlength=len(found)).astype(np.uint64)[of]
    cuts = np.cumsum([0] + [len(g) for g in grams])
    counts = pa.array([_planes(c[a:z]) for a, z in zip(cuts[:-1], cuts[1:])], pa.binary())
    return pa.table({"part": table.column("part"), "block": table.column("block"), "counts": counts})


def _scorer(total: int, backoff: float, least_count: int):
    def score(block: pa.Table, counts: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        lengths, vocabulary, places = _read_block(row)
        scores = np.zeros(len(lengths))
        if len(places):
            grams, words_at, bigrams_at = _grams(lengths, vocabulary, places)
            c = np.concatenate([_from_planes(x, np.uint64) for x in counts.sort_by("part").column("counts").to_pylist()])
            logs = np.log(c.astype(np.float64))
            words_log = logs[words_at]
            hit = (bigrams_at >= 0) & (c[bigrams_at] >= least_count)
            before = np.concatenate([words_log[:1], words_log[:-1]])
            each = np.where(hit, logs[bigrams_at] - before, math.log(backoff) + words_log - math.log(total))
            scores = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=each, minlength=len(lengths))
        lists = [pa.array(row[x], pa.int64()) for x in ("doc_ids", "text_hashes")]
        return pa.table([*lists, pa.array(lengths), pa.array(scores)], ["doc_id", "text_hash", "n_words", "score"])

    return score


def score_documents(docs: DataFrame, backoff: float = BACKOFF, least_count: int = LEAST_COUNT, block_words: int = BLOCK_WORDS, range_words: int = RANGE_WORDS) -> DataFrame:
    """Rows (doc_id, text_hash, n_words, score), one per row of docs."""
    found = F.transform(words(F.lower("text")), lambda x: F.xxhash64(x))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), found.alias("h"))
    blocks = "block long, doc_ids array<long>, text_hashes array<long>, lengths array<long>, vocabulary binary, places binary"
    blocks = stored(keyed.mapInArrow(_blocker(block_words), blocks), "lm-blocks")
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    total = max(1, blocks.agg(F.sum(size)).first()[0] or 0)
    sent = blocks.select("block", "lengths", "vocabulary", "places").mapInArrow(_sender(-(-total // range_words)), "part long, block long, grams binary, n binary")
    counts = sent.groupBy("part").applyInArrow(_count, "part long, block long, counts binary")
    scores = blocks.groupBy("block").cogroup(counts.groupBy("block"))
    return scores.applyInArrow(_scorer(total, backoff, least_count), "doc_id long, text_hash long, n_words long, score double")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_documents(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", (F.round("score", 4) + F.lit(0.0)).alias("score"))


OP2_SQL = r"""
with d as (select row_number() over () as rid, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
t as (select rid, unnest(w) as w, unnest(range(1, len(w) + 1)) as i from d),
p as (select rid, w, i, lag(w) over (partition by rid order by i) as v from t),
u as (select w, count(*) as c from t group by w),
b as (select v, w, count(*) as c from p where v is not null group by v, w having count(*) >= 2),
n as (select count(*) as n from t),
s as (select rid, sum(case when b.c is not null then ln(b.c) - ln(uv.c) else ln(0.4) + ln(uw.c) - ln(n.n) end) as score
    from p left join b on p.v = b.v and p.w = b.w join u uw on uw.w = p.w left join u uv on uv.w = p.v, n group by rid)
select doc_id, len(w) as n_words, round(coalesce(score, 0), 4) + 0.0 as score from d left join s using (rid)
"""
