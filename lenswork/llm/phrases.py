"""Phrases of words that occur together more often than chance has it, counted level by level.

Blocks of text are counted apart. In a block the words that can be part of a result get ids ranked by
frequency, and the plane of pairs (id, next id) is cut into square tiles: a tile with many pairs is counted by
direct address (numpy bincount), the pairs of all thin tiles as sorted coordinates. What is frequent over the
corpus then takes part as one unit: frequent pairs are ranked anew and paired with the next word, and so on, a
scan of the texts for each length. Spark adds the blocks' counts up. What is known to be frequent reaches the
tasks as a bitmap of fixed size (BITS bits, built by Spark in parts); a bit set by chance only lets a pair be
counted that the exact threshold removes afterwards, so a crowded bitmap costs time and changes nothing.

A word of a language is told from others by a 64-bit hash of both. Scores are exact: products of counts are
decimals of 38 digits.

Rows: null and empty texts have no words; a null lang is `und`; doc_id is not read, so null and repeated ids
count like others, and a repeated row counts as often as it is there. Very long texts are one block each. An
empty table gives no rows. Only text and lang are read; other columns, whatever their names, don't matter.
Ties of score and count are ordered by the phrase's bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_slices, load, split_words, stored, worker_cache

LEAST, LONGEST, SHARE, TOP = 10, 3, 50, 2000
#: The characters that end a piece, those between words, the language of rows without one.
PIECE_ENDS, BLANKS, NO_LANG = b".,;:!?\n\x0b\x0c\r", b" \t", "und"
#: Side of a tile, pairs from which a tile is counted by direct address, and bits of a level's bitmap (16 MB).
TILE, DENSE, BITS = 512, 1 << 14, 1 << 27
#: Bytes of text in a block: its arrays take some thirty times as much.
BLOCK = 4 << 20
#: A bitmap comes in parts of so many bits (what bitmap_construct_agg makes).
PART = 1 << 15
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_ENDS + BLANKS, b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(PIECE_ENDS) + b" " * len(BLANKS))


def ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes by falling frequency, how often they come, and each code's rank."""
    found, inverse, times = np.unique(codes, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return found[order], times[order], rank[inverse]


def tile_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of two columns of ranks, and how often each comes."""
    if not len(a):
        return a, b, a
    width = int(b.max()) // TILE + 1
    tile = a // TILE * width + b // TILE
    names, place, held = np.unique(tile, return_inverse=True, return_counts=True)
    crowded = held >= DENSE
    out = []
    for k in np.flatnonzero(crowded).tolist():
        here = place == k
        counts = np.bincount(a[here] % TILE * TILE + b[here] % TILE, minlength=TILE * TILE)
        cell = np.flatnonzero(counts)
        up, across = divmod(int(names[k]), width)
        out.append((up * TILE + cell // TILE, across * TILE + cell % TILE, counts[cell]))
    thin = ~crowded[place]
    if thin.any():
        side = int(b.max()) + 1
        code, times = np.unique(a[thin] * side + b[thin], return_counts=True)
        out.append((code // side, code % side, times))
    return tuple(map(np.concatenate, zip(*out)))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def chained(words: np.ndarray, seed) -> np.ndarray:
    """Spark's xxhash64 of whole numbers (int64), each with its own seed (uint64): XXH64 of their 8 bytes."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64
    with np.errstate(over="ignore"):
        h = np.asarray(seed, np.uint64) + p5 + np.uint64(8)
        h = _turn(h ^ (_turn(words.view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for each key (long) of a table, as bytes; at most BITS / PART rows reach the driver."""
    place = F.col("key").bitwiseAND(F.lit(BITS - 1))
    parts = keys.select(F.shiftright(place, PART.bit_length() - 1).alias("part"), place.bitwiseAND(F.lit(PART - 1)).alias("bit"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        out[r["part"] * (PART // 8) : (r["part"] + 1) * (PART // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys.view(np.uint64) & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _words_of(block: pa.RecordBatch):
    """Ranks of a block's words among its distinct (language, word), these (two lists) and their counts, pieces, and languages with their words' numbers."""
    words, row, piece, *_ = split_words(block.column(0), PLAIN)
    langs = block.column(1).fill_null(NO_LANG).dictionary_encode()
    names = langs.dictionary.to_pylist()
    code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] if len(row) else np.zeros(0, np.int64)
    coded = words.dictionary_encode()
    size = max(1, len(coded.dictionary))
    found, times, rank = ranked(code * size + coded.indices.to_numpy(zero_copy_only=False))
    of_lang = [names[k] for k in (found // size).tolist()]
    return rank, of_lang, coded.dictionary.take(pa.array(found % size)), times, piece, dict(zip(names, np.bincount(code, minlength=len(names)).tolist()))


def _keys(of_lang: list[str], words: pa.Array) -> np.ndarray:
    """Spark's xxhash64(lang, word)."""
    seeds = {x: xxhash.xxh64_intdigest(x, 42) for x in set(of_lang)}
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, seeds[x]) for x, w in zip(of_lang, words.to_pylist())], np.uint64).view(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """Rows (lang, word, n); the row without a word has all words of the language."""

    def run(batches):
        worker_cache("phrases")
        for b in in_slices(batches, BLOCK):
            _, of_lang, words, times, _, totals = _words_of(b)
            yield pa.RecordBatch.from_arrays([pa.array(of_lang, pa.string()), words.cast(pa.string()), pa.array(times, pa.int64())], ["lang", "word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], ["lang", "word", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_phrases(docs: DataFrame, size: int, bitmaps: list[np.ndarray]) -> DataFrame:
    """Rows (ws, n): phrases of so many words (their keys), of which all shorter phrases are marked in the bitmaps."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmaps)
    names = [f"w{k}" for k in range(size)]

    def run(batches):
        worker_cache("phrases")
        for b in in_slices(batches, BLOCK):
            rank, of_lang, words, _, piece, _ = _words_of(b)
            keys = _keys(of_lang, words)
            ok = marked(sent.value[0], keys)
            name = np.cumsum(ok) - 1  # ranks among the marked ones
            units, one = [keys[ok]], np.where(ok[rank], name[rank], -1)  # word keys of each unit, and the unit that begins at each word
            here, chain = one, chained(keys[ok], 42)
            for n in range(2, size + 1):
                fits = np.zeros(len(here), bool)
                if len(here) >= n:
                    fits[: 1 - n] = (here[: 1 - n] >= 0) & (here[1 : len(here) - n + 2] >= 0) & (one[n - 1 :] >= 0) & (piece[: 1 - n] == piece[n - 1 :])
                at = np.flatnonzero(fits)
                a, w = here[at], one[at + n - 1]
                if n == size:
                    a, w, times = tile_counts(a, w)
                    made = [*[u[a] for u in units], keys[ok][w], times]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], [*names, "n"])
                    break
                side = max(1, int(ok.sum()))
                found, _, place = ranked(a * side + w)
                a, w = found // side, found % side
                chain = chained(keys[ok][w], chain[a])
                good = marked(sent.value[n - 1], chain.view(np.int64))
                units, chain = [u[a][good] for u in units] + [keys[ok][w][good]], chain[good]
                following = np.full(len(here), -1, np.int64)
                following[at] = np.where(good[place], (np.cumsum(good) - 1)[place], -1)
                here = following

    counted = docs.select("text", "lang").mapInArrow(run, ", ".join(f"{x} long" for x in [*names, "n"]))
    return counted.groupBy(*names).agg(F.sum("n").alias("n")).select(F.array(*names).alias("ws"), "n")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: words (lang, word, key, n), phrases of 2 and more words (ws, n), and languages (lang, n)."""
    counts = stored(count_words(docs).filter(F.col("word").isNull() | (F.col("n") >= least)), "word-counts")
    words = counts.filter("word is not null").select("lang", "word", F.xxhash64("lang", "word").alias("key"), "n")
    langs = counts.filter("word is null and n > 0").select("lang", "n")
    maps, levels = [bitmap(words)], []
    for size in range(2, longest + 1):
        levels.append(stored(count_phrases(docs, size, maps).filter(F.col("n") >= least), f"phrases-{size}"))
        if size < longest:
            maps.append(bitmap(levels[-1].select(F.xxhash64("ws").alias("key"))))
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionByName(level)
    return words, phrases, langs


def mine_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """docs: text, lang. Rows (lang, rank, phrase, a, l, r, n, score): the best `top` phrases of each language.

    A phrase of 2 to `longest` words that comes at least `least` times scores floor(10^6 a^2 / (l r)) for the cut
    into two parts where that is least (of equal ones the first); a phrase inside a longer one that comes in at
    least `share` per cent of its places is left out.
    """
    words, phrases, langs = frequent_phrases(docs, least, longest)
    size = F.size("ws")
    cuts = phrases.select("ws", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("ws", F.lit(1), F.col("k")).alias("first"), F.slice("ws", F.col("k") + 1, size - F.col("k")).alias("rest"))
    counts = words.select(F.array("key").alias("part"), "n", "lang").unionByName(phrases.select(F.col("ws").alias("part"), "n", F.lit(None).cast("string").alias("lang")))
    cuts = cuts.join(counts.select(F.col("part").alias("first"), F.col("n").alias("l"), "lang"), "first")
    cuts = cuts.join(counts.select(F.col("part").alias("rest"), F.col("n").alias("r")), "rest")
    exact = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    cuts = cuts.withColumn("score", exact.cast("long"))
    best = cuts.groupBy("ws").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m"), F.max("lang").alias("lang"))
    if longest > 2:
        inner = F.expr("flatten(transform(sequence(2, size(ws) - 1), s -> transform(sequence(1, size(ws) - s + 1), i -> slice(ws, i, s))))")
        held = phrases.filter(size > 2).select(F.explode(inner).alias("ws"), "n").groupBy("ws").agg(F.max("n").alias("longer"))
        best = best.join(held, "ws", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("m.a")))
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    found = best.select("ws", "lang", "m.a", "m.l", "m.r", "m.score").withColumn("place", F.rank().over(by)).filter(F.col("place") <= top)
    found = stored(found.drop("place"), "best-phrases")  # with all that tie with the last
    spelt = found.select("ws", F.posexplode("ws").alias("pos", "key")).join(words.select("key", "word"), "key")
    spelt = spelt.groupBy("ws").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = found.join(spelt, "ws").withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).filter(F.col("rank") <= top)
    return out.join(langs, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(load(spark, sf_dir, "documents"))


OP12_SQL = r"""
with t as (select row_number() over () doc, coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') text from documents),
p as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) piece from t),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') ws from p),
g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') phrase, count(*) a from (select lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) i from w, (values (1), (2), (3)) s(k) where len(ws) >= k) q group by all),
n as (select lang, sum(a) n from g where k = 1 group by 1),
f as (select *, string_split(phrase, ' ') ws from g where a >= 10),
c as (select f.lang, f.k, f.phrase, f.ws, f.a, i, array_to_string(f.ws[1:i], ' ') x, array_to_string(f.ws[i + 1:], ' ') y from f, (values (1), (2)) s(i) where f.k > i),
s as (select c.lang, c.k, c.phrase, c.a, c.i, x.a l, y.a r, cast(cast(1000000 as hugeint) * c.a * c.a // (cast(x.a as hugeint) * y.a) as bigint) score
  from c join f x on x.lang = c.lang and x.phrase = c.x join f y on y.lang = c.lang and y.phrase = c.y),
b as (select * from (select *, row_number() over (partition by lang, phrase order by score, i) z from s) q where z = 1),
h as (select lang, phrase, max(a) longer from (select lang, a, array_to_string(ws[1:2], ' ') phrase from f where k = 3 union all select lang, a, array_to_string(ws[2:3], ' ') from f where k = 3) q group by all),
o as (select b.*, row_number() over (partition by b.lang order by score desc, b.a desc, b.phrase) as rank from b left join h using (lang, phrase) where longer is null or 100 * longer < 50 * b.a)
select o.lang, o.rank, o.phrase, o.a, o.l, o.r, cast(n.n as bigint) n, o.score from o join n on n.lang = o.lang where o.rank <= 2000
"""
