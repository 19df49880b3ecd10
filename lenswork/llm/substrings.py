"""Removal of word sequences that occur more than once, by recompression.

Rounds of recompression rename every text the same way everywhere: first runs of one word become one
symbol, then, round by round, neighbouring symbols whose names hash to "left" and "right" become a
pair. A name is the hash of its parts, so equal names need no exchange between tasks, and a repeated
passage gets the same symbols except near its ends. Which symbols of a window are the same wherever
its words occur follows from the window alone (`_first`, `_stop`): the longest of these is its anchor.

1. Spark counts anchors over all texts. A window whose anchor occurs once can't be repeated.
2. For the other windows the words decide: Spark counts whole windows by two independent 64-bit hashes of
   their words, so that equal hashes of other words don't happen at any real size.
3. The words of windows that occur more than once are removed.

What is common within SLICE_WORDS words of a task is settled there and sent on once, so of a passage that a
third of the texts share one row for each so many words of the corpus meets. The texts are shuffled once (by id) and that shuffle serves steps 2 and 3.

Rows: null and blank texts have no words and keep nothing; texts shorter than the window stay whole;
equal rows are occurrences of each other. An id used by several texts keeps them apart. An empty
table gives no rows. A null id counts as NO_ID, one document per text. Texts of any length are read whole. Only
doc_id and text are read; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, shuffle_partitions, stored, words

WINDOW, PAIR_ROUNDS, ANCHOR_LEVELS = 35, 7, (7, 5, 3, 0)
#: Words that are worked on at a time in a task.
SLICE_WORDS = 400_000
NO_ID = -(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Odd numbers whose powers make the two hashes of a window.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(z: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z + np.uint64((salt * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


def recompress(h: np.ndarray, doc: np.ndarray, starts: np.ndarray, window: int, rounds: int, levels: tuple[int, ...]):
    """The anchor of each window that starts at one of `starts`.

    h: word hashes of several texts; doc: which text each word is of. Returns for each window the
    anchor's name (uint64) and its number (level and place; -1: none is sure).
    """
    n = len(h)
    new = np.ones(n, bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    length = np.diff(np.append(begin, n))
    name = _mix(h[begin] ^ _mix(length.astype(np.uint64), 1))
    # a window's first and last run may go on outside of it; symbols from first up to stop are sure
    first, stop = run[starts] + 1, run[starts + window - 1]
    span, of = length, doc[begin]
    kept = {0: (name, span, first, stop)}
    for level in range(1, rounds + 1):
        right = (_mix(name, level) & np.uint64(1)).astype(np.int64)
        pair = (right[:-1] == 0) & (right[1:] == 1) & (of[:-1] == of[1:])
        second = np.zeros(len(name) + 1, bool)
        second[1:-1] = pair
        index = np.cumsum(~second) - 1  # the last is that of a symbol after the end
        right = np.append(right, 0)
        # a left symbol surely starts a new one; after a right one the next does
        first = index[first + right[first]]
        last = np.maximum(stop - 1, 0)
        stop = np.where(stop > 0, index[last] + right[last], 0)
        head = np.flatnonzero(~second[:-1])
        with np.errstate(over="ignore"):
            joined = _mix(_mix(name[:-1], 2) + name[1:] * _ODD)
        paired = np.append(pair, False)[head]
        name = np.where(paired, np.append(joined, np.uint64(0))[head], name[head])
        span = span[head] + np.where(paired, np.append(span, 0)[head + 1], 0)
        of = of[head]
        if level in levels:
            kept[level] = (name, span, first, stop)
    got, number = np.zeros(len(starts), np.uint64), np.full(len(starts), -1, np.int64)
    for level in sorted(levels, reverse=True):
        name, span, first, stop = kept[level]
        score = (np.minimum(span, 255).astype(np.uint64) << np.uint64(56)) | (name >> np.uint64(8))
        todo = np.flatnonzero((number < 0) & (stop > first))
        if not len(todo):
            continue
        at, end = first[todo], stop[todo]
        best = at.copy()
        live = np.arange(len(todo))
        step = 1
        while len(live):  # the longest sure symbol; of equal ones the first
            live = live[at[live] + step < end[live]]
            cand = at[live] + step
            better = score[cand] > score[best[live]]
            best[live[better]] = cand[better]
            step += 1
        got[todo] = _mix(name[best], 100 + level)
        number[todo] = best * 16 + level
    return got, number


def _slices(lengths: np.ndarray):
    """Ranges of rows with at most SLICE_WORDS words, or one row."""
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_WORDS, "right")))
        yield lo, hi
        lo = hi


def _settle(key: np.ndarray, check: np.ndarray, weight: np.ndarray, occurrence: np.ndarray):
    """Keys common within the rows at hand: (key to send, count to send, first rows of keys to send besides, their counts).

    key, check, weight: of each row; occurrence: rows with equal numbers are parts of one occurrence. Rows of
    a key with several occurrences get a key of their own and a count that settles them; the
    common key goes along once.
    """
    seen, where = np.unique(occurrence, return_index=True)
    counted = np.zeros(len(key), np.int64)
    counted[where] = weight[where]
    order = np.lexsort((check, key))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    firsts = order[new]
    total = np.bincount(inverse, counted, len(firsts)).astype(np.int64)
    common = total[inverse] > 1
    own = _mix(np.arange(len(key), dtype=np.uint64) ^ key, 77)
    return np.where(common, own, key), np.where(common, 2, counted), firsts[total > 1], total[total > 1]


def _rows(key, check, count, ids, hashes, place):
    columns = (key.view(np.int64), check.view(np.int64), place, count, ids, hashes)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "check", "place", "n", "doc_id", "text_hash"])


#: place holds a range of window starts, the first in the low half and how many more in the high one: next to
#: the keys, few bytes of a row differ from the row before, so shuffles compress well. -1: none.
_SCHEMA = "key long, check long, place long, n long, doc_id long, text_hash long"


def _emit(key, check, weight, occurrence, ids, hashes, lo, hi):
    sent, count, more, totals = _settle(key, check, weight, occurrence)
    yield _rows(sent, check, count, ids, hashes, lo.astype(np.int64) | ((hi - lo).astype(np.int64) << 32))
    yield _rows(key[more], check[more], totals, np.full(len(more), NO_ID), np.zeros(len(more), np.int64), np.full(len(more), -1))


def _ranges(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo = place & 0xFFFFFFFF
    return lo, lo + (place >> 32)


def anchors(window: int, rounds: int, levels: tuple[int, ...]):
    """Task function over (doc_id, text_hash, h): rows for ranges lo..hi of window starts with one anchor."""

    def run(batches):
        for b in batches:
            ids, hashes = b.column(0).to_numpy(), b.column(1).to_numpy()
            offsets, values = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy().view(np.uint64)
            lengths = np.diff(offsets)
            for a, z in _slices(lengths):
                size = lengths[a:z]
                h = values[offsets[a] : offsets[z]]
                doc = np.repeat(np.arange(z - a), size)
                place = np.arange(len(h)) - np.repeat(offsets[a:z] - offsets[a], size)
                starts = np.flatnonzero(place <= np.repeat(size, size) - window)
                if not len(starts):
                    continue
                name, number = recompress(h, doc, starts, window, rounds, levels)
                cut = np.ones(len(starts), bool)
                cut[1:] = (number[1:] != number[:-1]) | (starts[1:] != starts[:-1] + 1)
                head = np.flatnonzero(cut)
                tail = np.append(head[1:], len(starts)) - 1
                s, name, number = starts[head], name[head], number[head]
                unsure = number < 0  # no anchor: these windows always go on
                weight = np.where(unsure, 2, 1)
                number = np.where(unsure, -1 - np.arange(len(number)), number)
                name = np.where(unsure, _mix(s.astype(np.uint64) ^ hashes[a + doc[s]].view(np.uint64), 5), name)
                yield from _emit(name, np.zeros(len(name), np.uint64), weight, number, ids[a + doc[s]], hashes[a + doc[s]], place[s], place[starts[tail]])

    return run


def windows(window: int):
    """Task function over (doc_id, text_hash, h, ranges): rows for the hashes of the windows in the ranges."""
    powers: dict[int, np.ndarray] = {}

    def rolling(h, p, odd):
        """A hash of the window at each place p: the words' hashes times powers of an odd number, shifted to a common power."""
        n, inverse = len(h), pow(odd, -1, 1 << 64)
        if len(powers.get(odd, ())) <= n:
            with np.errstate(over="ignore"):
                powers.update({x: np.multiply.accumulate(np.full(n + 1, np.uint64(x))) for x in (odd, inverse)})
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(h, odd & 1023) * powers[odd][:n], dtype=np.uint64)])
            return _mix((sums[p + window] - sums[p]) * powers[inverse][p])

    def run(batches):
        for b in batches:
            ids, hashes = b.column(0).to_numpy(), b.column(1).to_numpy()
            offsets, values = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy().view(np.uint64)
            at = b.column(3).offsets.to_numpy()
            lo, hi = _ranges(b.column(3).values.to_numpy())
            lengths = np.diff(offsets)
            for a, z in _slices(lengths):
                h = values[offsets[a] : offsets[z]]
                begin = offsets[a:z] - offsets[a]
                k = slice(at[a], at[z])
                of = np.repeat(np.arange(z - a), np.diff(at[a : z + 1]))
                marks = np.zeros(len(h) + 1, np.int64)
                np.add.at(marks, begin[of] + lo[k], 1)
                np.add.at(marks, begin[of] + hi[k] + 1, -1)
                p = np.flatnonzero(np.cumsum(marks) > 0)
                if not len(p):
                    continue
                key, check = (rolling(h, p, odd) for odd in BASES)
                doc = np.searchsorted(begin, p, "right") - 1
                same = np.zeros(len(p), bool)
                same[1:] = (key[1:] == key[:-1]) & (check[1:] == check[:-1]) & (p[1:] == p[:-1] + 1) & (doc[1:] == doc[:-1])
                head = np.flatnonzero(~same)
                tail = np.append(head[1:], len(p)) - 1
                s = p[head]
                yield from _emit(key[head], check[head], tail - head + 1, np.arange(len(head)), ids[a + doc[head]], hashes[a + doc[head]], s - begin[doc[head]], p[tail] - begin[doc[head]])

    return run


def _repeated(rows: DataFrame) -> DataFrame:
    """Per text the ranges whose key counts more than one."""
    total = rows.withColumn("total", F.sum("n").over(Window.partitionBy("key", "check")))
    found = total.filter((F.col("total") > 1) & (F.col("place") >= 0))
    return found.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("ranges"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256, kept): kept are the words left, joined by spaces."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), "text")
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    rounds, levels = (PAIR_ROUNDS, ANCHOR_LEVELS) if window >= 16 else (2, (2, 0))
    first = texts.select("doc_id", "text_hash", hashed.alias("h")).mapInArrow(anchors(window, rounds, levels), _SCHEMA)
    dealt = texts.repartition(shuffle_partitions(docs.sparkSession), "doc_id", "text_hash")
    again = dealt.join(stored(_repeated(first), "repeated-anchors"), ["doc_id", "text_hash"]).select("doc_id", "text_hash", hashed.alias("h"), "ranges")
    gone = _repeated(again.mapInArrow(windows(window), _SCHEMA))

    def finish(batches):
        for b in batches:
            n_words, removed, digest, left = [], [], [], []
            for text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = text.encode().split() if text else []
                n = len(found)
                if ranges:
                    change = np.zeros(n + 1, np.int64)
                    lo, hi = _ranges(np.array(ranges, np.int64))
                    np.add.at(change, lo, 1)
                    np.add.at(change, hi + window, -1)
                    keep = (np.cumsum(change[:-1]) == 0).tolist()
                    found = [w for w, k in zip(found, keep) if k]
                kept = b" ".join(found)
                n_words.append(n)
                removed.append(n - len(found))
                digest.append(hashlib.sha256(kept).hexdigest())
                left.append(kept.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(left, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = dealt.join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "text", "ranges")
    out = out.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents")).drop("kept")


OP1_SQL = r"""
with w as (select row_number() over () as rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
p as (select rid, unnest(range(1, len(w) - 33)) as i, w from w where len(w) >= 35),
k as (select rid, i, md5(array_to_string(w[i:i + 34], ' ')) as k from p),
r as (select rid, i from k where k in (select k from k group by k having count(*) > 1)),
g as (select distinct rid, unnest(range(i, i + 35)) as j from r),
x as (select rid, list(j) as gone from g group by rid)
select doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed,
    sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end, ' ')) as kept_sha256
from w left join x using (rid)
"""
