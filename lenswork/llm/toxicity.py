"""Toxicity of documents learned from document labels alone: multiple-instance learning with a noisy-or.

A document's sentences are its instances. Sentence s has the probability p_s = 1 / (1 + exp(-(bias + sum of its
features' weights))), and the document is toxic with 1 - prod(1 - p_s): one bad sentence is enough, however many
good ones stand around it. Labels of documents give the gradient through that product, so the sentences at fault
are found without a label of their own (`offending`).

Features are character n-grams of words (edges marked) and whole words. Those that are at least MARK times as
common among toxic documents as among others compete by their log-likelihood ratio (LEAST_GAIN at least, which
chance among a million n-grams hardly reaches); the best FEATURES of them are weighed.
They and the weights are learned from at most about SAMPLE labelled ids of each label (picked by a hash of the
id, so the sample is bounded and always the same) and at most about ROWS_OF_ID texts of an id; the sample's
shares are weighed back to those of all labelled rows. Each step of the gradient is a Spark job over the
sample's features. Every document is scored by one scan, its whole text.

Rows: a null or blank text has no sentence and the score 0. Labels that are null teach nothing, several of one
id count as their mean; null ids have no label. Repeated rows give equal results, repeated ids of different texts
their own. Without labels every score is 0. Ties of features are ordered by their text. Very long texts are read
one at a time. An empty table gives no rows. Only doc_id, text and the labels' doc_id and toxic are read; other
columns, whatever their names, don't matter.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, in_slices, load, split_words, stored, worker_cache
from .language import held_out

SAMPLE, ROWS_OF_ID, FEATURES = 8000, 4, 4096
SIZES, LEAST_GAIN, MARK = (3, 4, 5, 6), 25.0, 2.0
STEPS, RATE, BIAS, FIRST, DECAY = 60, 0.3, -8.0, 5.0, 1e-5
#: The bytes that end a sentence; other ASCII but letters, digits and the apostrophe is between words.
ENDS = b".!?\n\r"
TABLE = bytes(10 if c in ENDS else ord(chr(c).lower()) if c < 128 and (chr(c).isalnum() or c == 39) else 32 if c < 128 else c for c in range(256))
#: Score from which a document is predicted to be toxic, and a sentence to be at fault.
THRESHOLD = 0.3
CACHE_WORDS = 300_000


def grams(word: str) -> set[str]:
    """n-grams of a word with marked edges, and the marked word."""
    w = f"^{word.lower()}$"
    return {w[k : k + n] for n in SIZES for k in range(len(w) - n + 1)} | {w}


def sentences(found: Words, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sentence number of each word over all rows, the row of each sentence, and each row's number of sentences."""
    if not len(found.row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    new = np.append(True, (found.piece[1:] != found.piece[:-1]) | (found.row[1:] != found.row[:-1]))
    owner = found.row[new]
    return np.cumsum(new) - 1, owner, np.bincount(owner, minlength=rows)


class Finder:
    """Features of words, kept for words seen before."""

    def __init__(self, features: list[str]):
        self.known: dict[str, list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        for k, gram in enumerate(features):
            self.automaton.add_word(gram, k)
        if features:
            self.automaton.make_automaton()
        self.any = bool(features)

    def of_word(self, word: str) -> list[int]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            got = self.known[word] = sorted({k for _, k in self.automaton.iter(f"^{word.lower()}$")}) if self.any else []
        return got

    def of_sentences(self, found: Words, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (sentence, feature), sorted."""
        if not len(sentence):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        coded = found.words.dictionary_encode()
        each = [self.of_word(w) for w in coded.dictionary.to_pylist()]
        n = np.array([len(x) for x in each], np.int64)
        flat, at = np.array([k for x in each for k in x], np.int64), np.cumsum(n) - n
        code = coded.indices.to_numpy(zero_copy_only=False)
        on = np.flatnonzero(n[code])
        times, begin = n[code[on]], at[code[on]]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        side = len(flat) + FEATURES + 1
        pairs = np.unique(np.repeat(sentence[on], times) * side + flat[np.repeat(begin, times) + inside])
        return pairs // side, pairs % side


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Stored rows (text, y, weight) of the sample; no held-out id is among them."""
    seen = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("double").alias("toxic"))
    seen = seen.filter(~held_out(F.col("id"))).groupBy("id").agg(F.avg("toxic").alias("y"))
    times = docs.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("times"))
    seen = stored(seen.join(times, "id").withColumn("bad", F.col("y") >= 0.5), "labelled-ids")
    sizes = {r["bad"]: r["n"] for r in seen.groupBy("bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 53))
    chosen = None
    for bad, n in sorted(sizes.items()):
        share = min(1.0, sample / n)
        rows = seen.filter((F.col("bad") == bad) & (part < int(share * (1 << 53)))).limit(2 * sample).withColumn("weight", F.lit(1 / share))
        chosen = rows if chosen is None else chosen.unionByName(rows)
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")
    if chosen is None:
        return texts.limit(0).select("text", F.lit(0.0).alias("y"), F.lit(0.0).alias("weight"))
    texts = texts.join(F.broadcast(chosen), "id")  # at most 4 * sample ids
    h = F.xxhash64("text")
    few = F.pmod(h, F.lit(1 << 53)) < F.least(F.lit(1.0), F.lit(float(ROWS_OF_ID)) / F.col("times")) * float(1 << 53)
    rows = texts.filter(few).groupBy("id", h.alias("h")).agg(F.first("text").alias("text"), F.first("y").alias("y"), F.first("weight").alias("weight"))
    return stored(rows.select("text", "y", "weight"), "labelled-texts")


def choose_features(rows: DataFrame, features: int = FEATURES) -> list[str]:
    """The n-grams that tell toxic documents of the sample best, each counted once in a document."""

    def count(batches):
        from collections import Counter

        worker_cache("toxicity")
        of: dict[str, set[str]] = {}
        for b in in_slices(batches):
            bad, good = Counter(), Counter()
            for k, (y, weight) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                words = set(split_words(b.column(0).slice(k, 1), TABLE).words.to_pylist())
                if len(of) > CACHE_WORDS // 10:
                    of.clear()
                found = set().union(*(of[w] if w in of else of.setdefault(w, grams(w)) for w in words))
                bad.update(dict.fromkeys(found, y * weight)) if y else None
                good.update(dict.fromkeys(found, (1 - y) * weight)) if y < 1 else None
            names = list(bad.keys() | good.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([float(bad[x]) for x in names]), pa.array([float(good[x]) for x in names])], ["gram", "bad", "good"])

    all_bad, all_good = rows.agg(F.sum(F.col("y") * F.col("weight")), F.sum((1 - F.col("y")) * F.col("weight"))).first()
    if not all_bad:
        return []
    counts = rows.mapInArrow(count, "gram string, bad double, good double").groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    a, b, share = F.col("bad"), F.col("good"), all_bad / (all_bad + all_good)
    part = lambda x, all_x, p: x * F.log(F.greatest(x, F.lit(1e-9)) / ((a + b) * p)) + (F.lit(all_x) - x) * F.log(F.greatest(F.lit(all_x) - x, F.lit(1e-9)) / ((F.lit(all_bad + all_good) - a - b) * p + 1e-9))
    gain = 2 * (part(a, all_bad, share) + (part(b, all_good, 1 - share) if all_good else F.lit(0.0)))
    best = counts.filter((a * all_good >= MARK * b * all_bad) & (gain >= LEAST_GAIN)).select("gram", "bad", "good", gain.alias("gain")).orderBy(F.desc("gain"), "gram").limit(features).collect()
    # n-grams of the same documents, one inside the other, are one feature: the longest
    same: dict[tuple, list[str]] = {}
    for r in sorted(best, key=lambda r: (-len(r["gram"]), r["gram"])):
        held = same.setdefault((round(r["bad"], 6), round(r["good"], 6)), [])
        if not any(r["gram"] in g for g in held):
            held.append(r["gram"])
    return sorted(g for held in same.values() for g in held)


def _examples(rows: DataFrame, features: list[str]) -> DataFrame:
    """Stored rows (y, weight, plain, sizes, ids): a document's number of sentences without a feature, and the features of the others one after another."""
    sent = rows.sparkSession.sparkContext.broadcast(features)

    def run(batches):
        finder = worker_cache("toxicity").setdefault(tuple(sent.value), Finder(sent.value))
        for b in in_slices(batches):
            found = split_words(b.column(0), TABLE)
            number, owner, of_row = sentences(found, b.num_rows)
            s, f = finder.of_sentences(found, number)
            each, n = np.unique(s, return_counts=True)
            rows_of, ends = owner[each], np.cumsum(n)
            sizes, ids, plain = [], [], []
            cut = np.searchsorted(rows_of, np.arange(b.num_rows + 1))
            for k in range(b.num_rows):
                lo, hi = cut[k], cut[k + 1]
                first, stop = (ends[lo - 1] if lo else 0), (ends[hi - 1] if hi else 0)
                sizes.append(n[lo:hi].tolist())
                ids.append(f[first:stop].tolist())
                plain.append(int(of_row[k] - (hi - lo)))
            made = [b.column(1), b.column(2), pa.array(plain, pa.int64()), pa.array(sizes, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(made, ["y", "weight", "plain", "sizes", "ids"])

    return stored(rows.mapInArrow(run, "y double, weight double, plain long, sizes array<int>, ids array<int>"), "toxicity-examples")


def gradient(weights: np.ndarray, y, weight, plain, sizes: list[np.ndarray], ids: list[np.ndarray]) -> np.ndarray:
    """Of the log-likelihood by the features' weights and (last but one) the bias; last the log-likelihood itself."""
    n = np.array([len(x) for x in sizes], np.int64)
    size, flat = np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
    sentence, doc = np.repeat(np.arange(len(size)), size), np.repeat(np.arange(len(n)), n)
    bias = weights[-1]
    z = bias + np.bincount(sentence, weights[flat], len(size))
    total = np.bincount(doc, softplus(z), len(n)) + plain * softplus(bias)
    clean = np.exp(-total)
    toxic = np.maximum(1e-12, -np.expm1(-total))
    by_total = weight * (y * clean / toxic - (1 - y))
    push = by_total[doc] / (1 + np.exp(-np.clip(z, -500, 500)))
    out = np.zeros(len(weights) + 1)
    out[: len(weights) - 1] = np.bincount(flat, push[sentence], len(weights) - 1)
    out[-2] = push.sum() + (by_total * plain).sum() / (1 + np.exp(-bias))
    out[-1] = (weight * (y * np.log(toxic) - (1 - y) * total)).sum()
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> tuple[list[str], np.ndarray]:
    """The features and their weights, the bias last; weights are empty if nothing is labelled."""
    rows = training_rows(docs, labels, sample)
    total = rows.agg(F.sum("weight")).first()[0]
    if not total:
        return [], np.zeros(0)
    features = choose_features(rows)
    examples = _examples(rows, features)
    context = docs.sparkSession.sparkContext
    weights = np.append(np.full(len(features), FIRST), BIAS)
    speed, size = np.zeros(len(weights)), np.zeros(len(weights))
    for t in range(1, steps + 1):
        sent = context.broadcast(weights)

        def run(batches, sent=sent):
            out = np.zeros(len(sent.value) + 1)
            for b in batches:
                lists = [[np.array(x, np.int64) for x in b.column(c).to_pylist()] for c in ("sizes", "ids")]
                out += gradient(sent.value, *(b.column(c).to_numpy() for c in ("y", "weight", "plain")), *lists)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["g"])

        parts = examples.mapInArrow(run, "g binary").collect()  # a row for each task over the bounded sample
        g = sum(np.frombuffer(r["g"]) for r in parts)[:-1] / total - DECAY * np.append(weights[:-1], 0)
        speed, size = 0.9 * speed + 0.1 * g, 0.98 * size + 0.02 * g * g
        weights = weights + RATE * (speed / (1 - 0.9**t)) / (np.sqrt(size / (1 - 0.98**t)) + 1e-8)
        sent.destroy()
    return features, weights


def score(docs: DataFrame, model: tuple[list[str], np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, score, offending) of docs; offending has the sentences (number, score, text) of at least the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    def run(batches):
        features, weights = sent.value
        finder = worker_cache("toxicity").setdefault(tuple(features), Finder(features))
        for b in in_slices(batches):
            found = split_words(b.column(1), TABLE)
            number, owner, of_row = sentences(found, b.num_rows)
            offending: list[list[dict]] = [[] for _ in range(b.num_rows)]
            if not len(weights):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.zeros(b.num_rows)), pa.array(offending, kind)], ["doc_id", "score", "offending"])
                continue
            s, f = finder.of_sentences(found, number)
            each, place = np.unique(s, return_inverse=True)
            z = weights[-1] + np.bincount(place, weights[f], len(each))
            total = np.bincount(owner[each], softplus(z), b.num_rows) + (of_row - np.bincount(owner[each], minlength=b.num_rows)) * softplus(weights[-1])
            before = np.cumsum(of_row) - of_row
            for k in np.flatnonzero(1 / (1 + np.exp(-np.clip(z, -500, 500))) >= threshold).tolist():
                lo, hi = np.searchsorted(number, [each[k], each[k] + 1])
                row = int(owner[each[k]])
                text = found.data[found.first[lo] : found.last[hi - 1] + 1].decode()
                offending[row].append({"sentence": int(each[k] - before[row]), "score": float(1 / (1 + np.exp(-z[k]))), "text": text})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(-np.expm1(-total)), pa.array(offending, kind)], ["doc_id", "score", "offending"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, offending array<struct<sentence:int,score:double,text:string>>")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    rows = score(docs, learn(docs, load(spark, sf_dir, "labels")))
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return rows.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.transform("offending", lambda x: x["sentence"]).alias("offending"))
