"""Line dedup by a deletion-neighbourhood join, edit bound 1.

A line (white space collapsed, lower-cased) is removed if an earlier line of the table equals it or, where
both have at least LEAST_CHARS, is one edit away (one character changed, put in or left out). Earlier goes by
(doc_id, hash of the text, line number), over the table as it comes in, removed lines included.

Two lines one edit apart agree outside of one quarter of them, so Spark first counts hashed keys of lines
without a quarter; lines that share such a key with another text go on to the quarters of that quarter, and
those that meet again to the deletions inside of it. Equal variants then meet by their hash. The place of the
deletion verifies the distance: equal variants with the same place are one change apart, a variant equal to
a whole line is one insertion apart, equal variants with other places (two edits) don't count. A line takes
the least of its group's first places, so no pairs are formed. Equal lines are one row from the start, and a
variant has no more different lines than places times characters. A key without a quarter can be shared by
any number of different lines (numbered ones): the task that makes the keys settles those of which it has
several lines itself, and sends one row of them to where the key's other lines meet. Keys are polynomials of the
code points, computed for thousands of lines at a time; two parts that meet by chance only go one level further
down. The texts are shuffled once; all passes read that shuffle.

Rows: null texts stay null; blank lines are kept; equal rows keep the same lines. A null id counts as NO_ID, the
smallest one; equal ids of different texts are told apart by the texts' hashes, in whose order they stand; of equal
lines the first by id, text hash and place stays. Texts of any length are read whole, a few at a time. An empty
table gives no rows. `dedup_lines` reads doc_id and text only; `drop_repeated_lines` carries all other columns,
whatever their names, in one struct.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import in_slices, load, shuffle_partitions, stored, worker_cache

LEAST_CHARS, NO_ID = 16, -(1 << 63)
#: A line is common if it makes up this share of all (so there are at most as many common ones) and comes so
#: often; the join of common lines is dealt over SALTS tasks each.
SHARE, COMMON, SALTS = 1000, 1000, 64
#: Rows of keys that a task settles at a time, and characters of their lines (or one line).
SETTLED, CHARS = 100_000, 1 << 19
#: Keys of more characters than this are hashed one by one: the others' powers of BASE are a table.
LONG, BASE = 1 << 16, 0x9E3779B97F4A7C15


def normal(line: str) -> str:
    return " ".join(line.split()).lower()


def normal_lines(text: str) -> list[str]:
    """normal of each line."""
    return [" ".join(line.split()) for line in text.lower().split("\n")]


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) - (1 << 63)


def span(length, k, level: int):
    """Part k of a line of that length (numbers or arrays): its first place and its end in a line of `base` characters, and base.

    Level 0 has the quarters, as a line of its length (0 to 3) and as one with a character too many (4 to 7);
    level 1 the quarters of these.
    """
    if level == 0:
        base = length - k // 4
        return base * (k % 4) // 4, base * (k % 4 + 1) // 4, base
    a, z, base = span(length, k // 4, 0)
    return a + (z - a) * (k % 4) // 4, a + (z - a) * (k % 4 + 1) // 4, base


def key(line: str, k: int, level: int) -> int:
    """Hash of the line without part k."""
    a, z, base = span(len(line), k, level)
    return _hash(f"{base} {a} {z} {line[:a]}\n{line[z + len(line) - base :]}")


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers from 0 to LONG + 1, and their inverses modulo 2^64."""
    cache = worker_cache("lines")
    if "powers" not in cache:
        up = [np.full(LONG + 2, x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64))]
        for x in up:
            x[0] = 1
        cache["powers"] = [np.cumprod(x, dtype=np.uint64) for x in up]
    return cache["powers"]


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = x * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def keys(lines: list[str], row: np.ndarray, k: np.ndarray, level: int) -> np.ndarray:
    """Hashes of the lines lines[row] without part k: equal where these parts and what is left out are as in `key`."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    a, z, base = span(lengths[row], k, level)
    plain = base <= LONG
    out = np.empty(len(row), np.int64)
    for i in np.flatnonzero(~plain):
        out[i] = key(lines[row[i]], int(k[i]), level)
    row, a, z, base = row[plain], a[plain], z[plain], base[plain]
    tabled = lengths <= LONG + 1
    text = "".join(lines if tabled.all() else [x for x, t in zip(lines, tabled) if t])
    lengths = np.where(tabled, lengths, 0)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    up, down = _powers()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mixed(codes + np.uint64(1), 0xBF58476D1CE4E5B9) * up[np.arange(len(codes)) - np.repeat(starts, lengths)], out=sums[1:])
    rest = z + lengths[row] - base
    before = sums[starts[row] + a] - sums[starts[row]]
    after = (sums[ends[row]] - sums[starts[row] + rest]) * down[rest]
    x = _mixed(before, 0x94D049BB133111EB) + after
    x = _mixed(x, 0xC2B2AE3D27D4EB4F) + ((base << 40) + (a << 20) + z).astype(np.uint64)
    x = _mixed(_mixed(x, 0x9FB21C651E98DF25), 0xD6E8FEB86659FD93)
    out[plain] = x.view(np.int64)
    return out


def variants(line: str, shared: list[int]):
    """(hash, place) of the line itself (-1) and of its deletions in the parts (of level 1) left out of shared keys."""
    places: set[int] = set()
    for k in shared:
        a, z, base = span(len(line), k, 1)
        places.update(range(a, min(len(line), z + len(line) - base)))
    yield _hash(line), -1
    for p in sorted(places):
        yield _hash(line[:p] + line[p + 1 :]), p


def line_table(docs: DataFrame, least_chars: int) -> DataFrame:
    """Rows (doc_id, text_hash, line, times, h, near), one per different line of a text that is not blank, at its first place; near: long enough for one edit."""

    def run(batches):
        worker_cache("lines")
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
        for b in in_slices(batches):
            ids, hashes = (c.to_numpy() for c in b.columns[:2])
            texts = b.column(2).to_pylist()
            for lo in range(0, len(texts), 500):
                found, places, times, counts = [], [], [], []
                for text in texts[lo : lo + 500]:
                    here = normal_lines(text) if text else []
                    first = dict(zip(reversed(here), range(len(here) - 1, -1, -1)))  # the first place is put in last
                    first.pop("", None)
                    again = Counter(here) if len(first) < len(here) else None
                    found += first
                    places += first.values()
                    times += map(again.__getitem__, first) if again else [1] * len(first)
                    counts.append(len(first))
                if found:
                    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)) ^ np.uint64(1 << 63)
                    near = np.fromiter(map(len, found), np.int64, len(found)) >= least_chars
                    made = [np.repeat(ids[lo : lo + 500], counts), np.repeat(hashes[lo : lo + 500], counts), places, times, h.view(np.int64), near]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(made, kinds)], ["doc_id", "text_hash", "line", "times", "h", "near"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, line int, times int, h long, near boolean")


def _emit(docs: DataFrame, asked: DataFrame, level: int) -> DataFrame:
    """asked: h, first, shared. Rows (h, key, k, salt): keys without parts (levels 0 and 1), or deletions and their places (2); salt as in `_settled`."""
    asked = asked.groupBy("first.doc_id", "first.text_hash").agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "h", "shared")).alias("asked"))

    def parts(batches):
        for b in in_slices(batches):
            wanted = b.column(1).flatten()
            line, h, shared = (wanted.field(c) for c in ("line", "h", "shared"))
            h, many = h.to_numpy(), shared.value_lengths().to_numpy()
            made = 4 * many if level else np.full(len(h), 8)
            k = (4 * shared.flatten().to_numpy()[:, None] + np.arange(4)).ravel() if level else np.tile(np.arange(8), len(h))
            after = np.append(0, np.cumsum(made))
            places, lo, n, found, chars = line.to_pylist(), 0, 0, [], 0

            def settled():
                row = np.repeat(np.arange(len(found)), made[lo:n])
                of = k[after[lo] : after[n]].astype(np.int64)
                return _settled(np.repeat(h[lo:n], made[lo:n]), keys(found, row, of, level), of, True)

            for text, count in zip(b.column(0).to_pylist(), b.column(1).value_lengths().to_pylist()):
                split = text.lower().split("\n")
                for place in places[n : n + count]:
                    x = " ".join(split[place].split())
                    found.append(x)
                    chars += len(x)
                    n += 1
                    if after[n] - after[lo] > SETTLED or chars > CHARS:
                        yield settled()
                        lo, found, chars = n, [], 0
            if found:
                yield settled()

    def deletions(batches):
        for b in in_slices(batches):
            out: list[tuple] = []
            for text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                split = text.split("\n")
                for x in wanted:
                    out += [(x["h"], v, p) for v, p in variants(normal(split[x["line"]]), x["shared"])]
                    if len(out) > SETTLED:
                        yield _settled(*(np.array(c, np.int64) for c in zip(*out)), False)
                        out = []
            if out:
                yield _settled(*(np.array(c, np.int64) for c in zip(*out)), False)

    return docs.join(asked, ["doc_id", "text_hash"]).select("text", "asked").mapInArrow(parts if level < 2 else deletions, "h long, key long, k int, salt int")


def _settled(h: np.ndarray, keys: np.ndarray, k: np.ndarray, settle: bool) -> pa.RecordBatch:
    """Rows (h, key, k, salt) of rows at hand. Keys of several lines at hand are settled: their rows are told by a
    salt that isn't 0, dealing them over tasks, and one that goes on to meet the key's other rows by -1."""
    salt = np.zeros(len(h), np.int32)
    if settle:
        order = np.argsort(keys)
        starts = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        sizes = np.diff(np.append(starts, len(h)))
        lines = h[order]
        several = np.minimum.reduceat(lines, starts) != np.maximum.reduceat(lines, starts)
        dealt = order[np.repeat(several, sizes)]
        salt[dealt] = 1 + (h[dealt] & 0xFFFF)
        salt[order[starts[several]]] = -1
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(keys), pa.array(k, pa.int32()), pa.array(salt)], ["h", "key", "k", "salt"])


def _meeting(rows: DataFrame) -> DataFrame:
    """The rows whose key another line has too: settled ones, and those that meet another one or one of a settled key."""
    over = Window.partitionBy("key", F.greatest("salt", F.lit(0)))
    met = (F.col("salt") != 0) | (F.min("h").over(over) != F.max("h").over(over))
    return rows.withColumn("met", met).filter("met").drop("met", "salt")


def earliest(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (h, earliest): for lines that come again or have a near line, the first place of all of these."""
    place = F.struct("doc_id", "text_hash", "line")
    first = stored(lines.groupBy("h").agg(F.min(place).alias("first"), F.sum("times").alias("n"), F.first("near").alias("near")), "distinct-lines")
    asked = first.filter("near").select("h", "first", F.array().cast("array<int>").alias("shared"))
    for level in (0, 1):
        shared = _meeting(_emit(docs, asked, level)).groupBy("h").agg(F.collect_set("k").alias("shared"))
        asked = shared.join(first.select("h", "first"), "h")
    rows = _meeting(_emit(docs, asked, 2)).join(first.select("h", "first"), "h")
    over, same = Window.partitionBy("key"), Window.partitionBy("key", "k")
    whole = F.min(F.when(F.col("k") < 0, F.col("first"))).over(over)
    best = F.when(F.col("k") < 0, F.min("first").over(over)).otherwise(F.least(F.min("first").over(same), F.coalesce(whole, "first")))
    linked = rows.withColumn("best", best).groupBy("h").agg(F.min("best").alias("best"))
    out = first.join(linked, "h", "left").filter((F.col("n") > 1) | (F.col("best") < F.col("first")))
    return out.select("h", "n", F.least("first", F.coalesce("best", "first")).alias("earliest"))


def _decided_lines(lines: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, h, all) of the lines that come again or have a near one; all: the first place in the text goes too."""
    most = max(COMMON, lines.count() // SHARE)
    common = lines.groupBy("h").agg(F.sum("times").alias("n")).filter(F.col("n") >= most).select("h", F.lit(True).alias("common"))
    dealt = lines.select("doc_id", "text_hash", "line", "h").join(F.broadcast(common), "h", "left")
    dealt = dealt.withColumn("salt", F.when(F.col("common"), F.pmod("text_hash", F.lit(SALTS)).cast("int")).otherwise(0))
    salts = F.when(F.col("n") >= most, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    found = dealt.join(decided.select("h", "earliest", F.explode(salts).alias("salt")), ["h", "salt"])
    return found.select("doc_id", "text_hash", "h", (F.struct("doc_id", "text_hash", "line") > F.col("earliest")).alias("all"))


def _keyed(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), *more)


def _texts_and_rules(docs: DataFrame, least_chars: int) -> DataFrame:
    """Rows (doc_id, text_hash, text, gone), one per row of docs, partitioned by the first two; gone: lines to remove (h) and whether the first goes too (all)."""
    texts = _keyed(docs, "text")
    dealt = texts.repartition(shuffle_partitions(docs.sparkSession), "doc_id", "text_hash")
    lines = stored(line_table(texts, least_chars), "lines")
    gone = _decided_lines(lines, earliest(dealt, lines)).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("h", "all")).alias("gone"))
    return dealt.join(gone, ["doc_id", "text_hash"], "left")


def _without(text: str | None, gone: list | None) -> tuple[str | None, int, int]:
    """The text that is left, lines before, lines removed."""
    if not gone:
        return text, 0 if text is None else text.count("\n") + 1, 0
    split = text.split("\n")
    rule = {x["h"]: x["all"] for x in gone}
    kept, seen = [], set()
    for line, x in zip(split, normal_lines(text)):
        h = xxhash.xxh64_intdigest(x) - (1 << 63) if x else None
        if h in rule:
            if rule[h] or h in seen:
                continue
            seen.add(h)
        kept.append(line)
    return "\n".join(kept), len(split), len(split) - len(kept)


def _apply(rows: DataFrame, *more: str) -> DataFrame:
    """rows: doc_id, text_hash, text, gone, *more. The same with new_text, n_lines and n_removed instead of text and gone."""

    def run(batches):
        for b in in_slices(batches):
            found = list(zip(*map(_without, b.column("text").to_pylist(), b.column("gone").to_pylist()))) or [(), (), ()]
            made = [pa.array(c, kind) for c, kind in zip(found, (pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made, *[b.column(c) for c in more]], schema.names)

    schema = StructType([rows.schema[c] for c in ("doc_id", "text_hash")])
    schema = schema.add("new_text", "string").add("n_lines", "long").add("n_removed", "long")
    for c in more:
        schema = schema.add(rows.schema[c])
    return rows.select("doc_id", "text_hash", "text", "gone", *more).mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Rows (doc_id, text_hash, new_text, n_lines, n_removed), one per row of docs."""
    return _apply(_texts_and_rules(docs, least_chars)).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs with the lines left in text (and n_chars, where a column has that name, to match); rows of which no line is left go.

    All other columns stay as they are: rows with equal ids and texts are one row with its different other
    values and their numbers until the lines are removed.
    """
    rows = _texts_and_rules(docs, least_chars).groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"), F.first("gone").alias("gone"))
    others = [c for c in docs.columns if c != "text"]
    rest = _keyed(docs, F.struct(*others).alias("rest")).groupBy("doc_id", "text_hash", "rest").agg(F.count(F.lit(1)).cast("int").alias("rows"))
    left = _apply(rows.join(rest, ["doc_id", "text_hash"]), "rest", "rows").filter("n_removed = 0 or trim(new_text) <> ''")
    left = left.select("new_text", "n_removed", "rest", F.explode(F.sequence(F.lit(1), "rows")))
    chars = F.when(F.col("n_removed") == 0, F.col("rest")["n_chars"]).otherwise(F.char_length("new_text").cast("long")) if "n_chars" in others else None
    return left.select(*[F.col("new_text").alias(c) if c == "text" else chars.alias(c) if c == "n_chars" else F.col("rest")[c].alias(c) for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("new_text", 256).alias("kept_sha256"))
