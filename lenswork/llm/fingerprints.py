"""Document fingerprints (SimHash), with DataFrame functions only.

Terms are pairs of neighbouring words, lower-cased (a single word is its own term). Each occurrence
votes with a weight, so a term counts by its frequency; the weight is 1, or 2 for terms of LONG or
more characters, as long terms are rarer. A term's 64-bit hash votes +weight or -weight on every
bit; a fingerprint bit is 1 where the sum is above zero. The votes of four bits are summed in one
long (lanes of 16 bits), per chunk of at most CHUNK terms so that no lane runs over; Spark sums
chunks before it shuffles them.

Rows: a null text counts as empty; an empty text has the fingerprint zero. Each row is a document
of its own, also with repeated or null ids: documents stand in descending doc_id order, nulls last,
equal ids in the order of their texts' hashes. Rows with equal ids and texts are one row with their number
until the end. Texts of any length are read whole. An empty table gives no rows. Only doc_id and text are
read; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, shuffle_partitions, stored, unused, words

CHUNK, LONG, RADIUS = 16_384, 12, 3
#: Blocks that a fingerprint is cut into; with up to RADIUS bits different at least BLOCKS - RADIUS blocks agree.
BLOCKS = 5
NO_ID = -(1 << 63)
LANES = 0x0001000100010001


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Rows (*keys, fp): keys name a row. One pass; what is shuffled are sums, a row per key and task."""
    w, i, term, weight, chunk = unused(keys, "_words", "_place", "_term", "_weight", "_chunk")
    terms = texts.select(*keys, words(F.lower(F.col(text))).alias(w))
    at = terms.select(*keys, w, F.explode(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0)))).alias(i))
    a, b = F.coalesce(F.get(w, F.col(i)), F.lit("")), F.coalesce(F.get(w, F.col(i) + 1), F.lit(""))
    votes = F.when(F.length(a) + F.length(b) >= LONG, F.lit(2).cast("long")).otherwise(F.lit(1).cast("long"))
    cast = at.select(*keys, F.floor(F.col(i) / CHUNK).alias(chunk), F.when(F.size(w) > 0, F.xxhash64(a, b)).alias(term), votes.alias(weight))
    lane = lambda k: F.sum(F.shiftrightunsigned(term, k).bitwiseAND(F.lit(LANES)) * F.col(weight)).alias(f"v{k}")
    sums = cast.groupBy(*keys, chunk).agg(*[lane(k) for k in range(16)], F.sum(F.when(F.col(term).isNotNull(), F.col(weight))).alias("total"))
    each = [F.sum(F.shiftrightunsigned(f"v{k % 16}", 16 * (k // 16)).bitwiseAND(F.lit(0xFFFF))).alias(f"b{k}") for k in range(64)]
    bits = sums.groupBy(*keys).agg(*each, F.sum("total").alias("total"))
    fp = F.lit(0).cast("long")
    for k in range(64):
        fp = fp.bitwiseOR(F.when(2 * F.col(f"b{k}") > F.col("total"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return bits.select(*keys, fp.alias("fp"))


def likeness(a, b):
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _distinct(docs: DataFrame) -> DataFrame:
    """Rows (d, text_hash, text, c): the different documents and how often they come; null ids are NO_ID, which is last."""
    d, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.coalesce("text", F.lit(""))
    return docs.select(d.alias("d"), F.xxhash64(text).alias("text_hash"), text.alias("text")).groupBy("d", "text_hash").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("c")).filter("c > 0")


def previous(docs: DataFrame) -> DataFrame:
    """Rows (d, text_hash, prev_d, prev_hash, prev_n): the document that each follows in descending order (the first: the last) and its number of characters.

    Only ids, hashes and lengths are sorted, in ranges that Spark cuts by their distribution; a range's first
    row takes the last of the range before, which is one row for each range.
    """
    d, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.coalesce("text", F.lit(""))
    keys = docs.select(d.alias("d"), F.xxhash64(text).alias("text_hash"), F.char_length(text).alias("n")).groupBy("d", "text_hash").agg(F.max("n").alias("n"))
    dealt = keys.repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("d").desc(), F.col("text_hash"))
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()), "document-order")
    over, ranges = Window.partitionBy("part").orderBy(F.col("d").desc(), "text_hash"), Window.orderBy("part")
    last = dealt.groupBy("part").agg(F.max_by(F.struct("d", "text_hash", "n"), F.struct(-F.col("d").cast("decimal(20,0)"), "text_hash")).alias("own"))
    everyone = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = last.select("part", F.coalesce(F.lag("own").over(ranges), F.last("own").over(everyone)).alias("before"))  # a row for each range
    rows = dealt.withColumn("prev", F.lag(F.struct("d", "text_hash", "n")).over(over)).join(F.broadcast(last), "part")
    prev = F.coalesce("prev", "before")
    return rows.select("d", "text_hash", prev["d"].alias("prev_d"), prev["text_hash"].alias("prev_hash"), prev["n"].alias("prev_n"))


def near_fingerprints(fps: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps, queries: fp, n (rows that have it). Rows (fp, other, bits, n) for every query and every fingerprint in the radius, itself included.

    Permuted block tables: one table for each choice of the blocks that must agree. Fingerprints are
    distinct, so copies of a text don't lengthen a bucket.
    """
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    block = lambda k: F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))
    choices = list(combinations(range(BLOCKS), BLOCKS - radius))
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.xxhash64(*[block(k) for k in chosen]).alias("key")) for t, chosen in enumerate(choices)])
    tables = fps.select("fp", "n", F.explode(keys).alias("k")).select(F.col("fp").alias("other"), "n", "k.table", "k.key")
    probes = queries.select("fp", F.explode(keys).alias("k")).select("fp", "k.table", "k.key")
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    probes = probes.hint("merge")  # not broadcast: ten rows for each query
    return probes.join(tables, ["table", "key"]).filter(bits <= radius).select("fp", "other", bits.alias("bits"), "n").distinct()


def _edited(text, following):
    return F.concat(F.expr(f"left({text}, int(char_length({text}) - char_length({text}) div 2))"), F.expr(f"left({following}, int(char_length({text}) div 2))"))


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The digest of each document and its edited text; n_near (ids divisible by 20): rows within the radius, itself included.

    The texts are shuffled once, and of each the characters that the edited text before it takes once more.
    """
    order = stored(previous(docs), "previous")
    texts = _distinct(docs)
    heads = texts.join(order, ["d", "text_hash"]).select(F.col("prev_d").alias("d"), F.col("prev_hash").alias("text_hash"), F.expr("left(text, int(prev_n div 2))").alias("following"))
    rows = texts.join(heads, ["d", "text_hash"])
    kind = lambda k, text: F.struct(F.lit(k).alias("kind"), text.alias("text"))
    kinds = [kind(0, F.col("text")), kind(1, _edited("text", "following")), kind(2, F.when(F.col("c") > 1, _edited("text", "text")))]
    both = rows.select("d", "text_hash", "c", F.char_length("text").cast("long").alias("n_chars"), F.explode(F.array(*kinds)).alias("x")).filter("x.text is not null")
    both = both.select("d", "text_hash", "c", "n_chars", "x.kind", "x.text", F.when(F.col("x.kind") > 0, F.sha2("x.text", 256)).alias("sha"))
    keys = ["d", "text_hash", "c", "n_chars"]
    fps = fingerprints(both, [*keys, "kind", "sha"])
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    one = fps.groupBy(*keys).agg(of(0, "fp").alias("fp"), *[of(k, c).alias(f"{c}{k}") for k in (1, 2) for c in ("fp", "sha")])
    one = stored(one, "fingerprints")
    after = one.select("d", "text_hash", "fp").join(order, ["d", "text_hash"]).select(F.col("prev_d").alias("d"), F.col("prev_hash").alias("text_hash"), F.col("fp").alias("next_fp"))
    counts = one.groupBy("fp").agg(F.sum("c").alias("n"))
    asked = one.filter(F.col("d") % 20 == 0).filter(F.col("d") != NO_ID).select("fp").distinct()
    near = near_fingerprints(counts, asked, radius).groupBy("fp").agg(F.sum("n").alias("n_near"))
    out = one.join(after, ["d", "text_hash"]).join(near, "fp", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))))
    last, digits = F.col("copy") == F.col("c"), lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    edited, following = F.when(last, F.col("fp1")).otherwise(F.col("fp2")), F.when(last, F.col("next_fp")).otherwise(F.col("fp"))
    doc_id = F.nullif("d", F.lit(NO_ID))
    return out.select(
        doc_id.alias("doc_id"), "n_chars", F.when(last, F.col("sha1")).otherwise(F.col("sha2")).alias("edited_sha256"), digits("fp").alias("fingerprint"), digits(edited).alias("edited_fingerprint"),
        likeness(F.col("fp"), edited).alias("near_edited"), likeness(F.col("fp"), following).alias("near_next"), F.when(doc_id % 20 == 0, F.col("n_near")).alias("n_near"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(load(spark, sf_dir, "documents"))
