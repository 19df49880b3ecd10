"""Benchmark decontamination, with DataFrame functions only.

The benchmark's windows (WINDOW consecutive normalised words; a shorter item is one window) form
a hash set: equal windows are one row with the list of their items. The set's rows and bytes are counted
first. Up to BROADCAST_ROWS and BROADCAST_BYTES it is broadcast, and each document's windows are hashed and
verified inside generated code, in one scan for all sizes of windows. Beyond that only rows (document, place,
size, hash) meet the set in a shuffled join, and the texts with hash hits are read again to verify the words.
A hash hit counts only if the words themselves are equal.

Rows: null or wordless texts have no windows; equal rows give equal results; a document id used
for several texts keeps each text's own hits. An item without words matches nothing; an empty
benchmark leaves all documents clean, an empty document table gives no rows. A null item_id is the empty
string: such items are one, count in n_items and stand as nothing between the commas of the digested list. Null
doc_ids are kept apart by their texts. Items' order is that of their ids as strings, so ties don't occur. Texts of
any length are read whole; other columns, whatever their names, are left as they are.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, stored, unused, words

WINDOW, BROADCAST_ROWS, BROADCAST_BYTES = 10, 500_000, 64 << 20
#: Fixed value: ASCII characters that stand between words, after lower-casing A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised_words(text):
    return words(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), BETWEEN)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (size, hash, gram, items): every different window and the items that have it."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), normalised_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    grams = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("gram"))
    grams = grams.groupBy("gram").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return grams.select(F.size("gram").alias("size"), F.xxhash64(F.transform("gram", lambda x: F.xxhash64(x))).alias("hash"), "gram", "items")


def _is_small(grams: DataFrame) -> bool:
    size = F.aggregate(F.concat("gram", "items"), F.lit(64).cast("long"), lambda n, x: n + F.octet_length(x) + 16)
    found = grams.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    return found["n"] <= BROADCAST_ROWS and (found["bytes"] or 0) <= BROADCAST_BYTES


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, text_hash, start, size, items), one per verified occurrence; start counts words from 0."""
    grams = benchmark_windows(benchmark, window)
    sizes = sorted(r["size"] for r in grams.groupBy("size").count().collect()) or [window]  # at most `window` different ones
    w = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), normalised_words(F.col("text")).alias("w"))
    at = w.filter(F.size("w") >= sizes[0]).select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    at = at.select("doc_id", "text_hash", "w", "h", F.explode(F.sequence(F.lit(0), F.size("w") - sizes[0])).alias("start"))
    one = lambda n: F.struct(F.lit(n).alias("size"), F.when(F.col("start") + n <= F.size("w"), F.xxhash64(F.array(*[F.get("h", F.col("start") + k) for k in range(n)]))).alias("hash"))
    if len(sizes) == 1:
        at = at.select("doc_id", "text_hash", "w", "start", one(sizes[0]).alias("x"))
    else:
        at = at.select("doc_id", "text_hash", "w", "start", F.explode(F.array(*[one(n) for n in sizes])).alias("x"))
    words_equal = F.slice("w", F.col("start") + 1, F.col("size")) == F.col("gram")
    if _is_small(grams):
        at = at.select("doc_id", "text_hash", "w", "start", F.col("x.size").alias("size"), F.col("x.hash").alias("hash"))
        return at.join(F.broadcast(grams), ["size", "hash"]).filter(words_equal).select("doc_id", "text_hash", "start", "size", "items")
    at = at.select("doc_id", "text_hash", "start", F.col("x.size").alias("size"), F.col("x.hash").alias("hash")).filter(F.col("hash").isNotNull())
    met = at.join(grams, ["size", "hash"]).withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    texts = w.dropDuplicates(["doc_id", "text_hash"])
    return met.join(texts, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("text_hash"))).filter(words_equal).select("doc_id", "text_hash", "start", "size", "items")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, spans)."""
    spans = hits(docs, benchmark, window).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(normalised_words(F.col("text"))).cast("long").alias("n_words"))
    at = spans.withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    rows = rows.join(at, rows.doc_id.eqNullSafe(at.d) & (rows.text_hash == at.t), "left")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("stop"))
    covered = F.aggregate("spans", start, lambda a, s: F.struct((a["n"] + s["stop"] - F.least(s["stop"], F.greatest(s["start"], a["stop"]))).alias("n"), F.greatest(a["stop"], s["stop"]).alias("stop")))
    n_hit = F.coalesce(covered["n"], F.lit(0).cast("long"))
    found = F.coalesce("found", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", found), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words taken out of their texts.

    With "spans" a changed text is the rest of its normalised words, joined by spaces; all other texts stay as they are.
    """
    d, t, gone, row = unused(docs.columns, "_d", "_t", "_gone", "_row")
    found = hits(docs.select("doc_id", "text"), benchmark, window)
    here = docs.select(F.struct(*docs.columns).alias(row))
    same = F.col(row)["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(F.col(row)["text"]) == F.col(t))
    if remove == "documents":
        bad = stored(found.select(F.col("doc_id").alias(d), F.col("text_hash").alias(t)).distinct(), "contaminated")
        if bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # two numbers a row
            bad = F.broadcast(bad)
        return here.join(bad, same, "left_anti").select(*[F.col(row)[c].alias(c) for c in docs.columns])
    places = F.explode(F.sequence("start", F.col("start") + F.col("size") - 1))
    spans = found.select(F.col("doc_id").alias(d), F.col("text_hash").alias(t), places.alias("p")).groupBy(d, t).agg(F.map_from_entries(F.collect_set(F.struct("p", F.lit(True)))).alias(gone))
    joined = here.join(spans, same, "left")
    rest = F.filter(normalised_words(F.col(row)["text"]), lambda x, i: ~F.coalesce(F.map_contains_key(gone, i), F.lit(False)))
    text = F.when(F.col(gone).isNull(), F.col(row)["text"]).otherwise(F.concat_ws(" ", rest))
    return joined.select(*[text.alias(c) if c == "text" else F.col(row)[c].alias(c) for c in docs.columns])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP8_SQL = r"""
with w as (select doc_id, row_number() over () as rid,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select cast(item_id as varchar) as item_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
g as (select distinct item_id, least(len(w), 10) as size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as gram
    from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
s as (select distinct size from g),
a as (select rid, size, i, array_to_string(w[i:i + size - 1], ' ') as gram from (select rid, w, size, unnest(range(1, len(w) - size + 2)) as i from w, s where len(w) >= size)),
h as (select a.rid, a.i, a.size, g.item_id from a join g on a.gram = g.gram and a.size = g.size),
c as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + size)) as p from h) group by rid),
n as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct rid, item_id from h) group by rid)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join c using (rid) left join n using (rid)
"""
