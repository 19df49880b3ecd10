"""Language identification of whole, possibly mixed, texts.

A word's script (by code point range) narrows the languages; within them a word's score is the sum of
log probabilities of its hashed character n-grams. Viterbi over the words' scores, with a penalty for
each switch, labels spans. The n-gram table is learned from at most about SAMPLE different labelled texts for
each language (picked by a 62-bit hash of id and text, so that the sample is bounded and always the same, and no
language is without a text however many rows it has). Its size is bounded: languages x BUCKETS numbers up to
TABLE of them, beyond that fewer buckets. At most MOST_LANGUAGES languages are learned, those with most rows. The
text alone is used for a prediction.

Rows: a text that is null or has no letter is `und` with score 0; rows without a label teach nothing;
without any labelled text all are `und`. A repeated row is learned from once; repeated rows give equal results.
Null ids and repeated ids are like any other, as the text takes part in the choice. Languages with equal sums are
taken in the order of their names. Texts of any length are read whole, a few at a time. An empty table gives no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices, load, small_batches, worker_cache
from .tokens import in_groups

SAMPLE, BUCKETS, SIZES, SWITCH, SHARPNESS = 2000, 1 << 16, (1, 2, 3, 4), 6.0, 0.35
#: Share of a language's letters in a script that makes it a candidate there.
LEAST_SHARE = 0.005
#: Words kept per task (about 100 MB), and words of mixed texts that are labelled together (or one text).
CACHE_WORDS, TOGETHER = 400_000, 400_000
#: Characters of words (or one word) whose n-grams are made together (about 190 bytes for each).
GRAM_CHARS = 1 << 17
#: Languages that are learned at most, and numbers of the n-gram table (32 MB).
MOST_LANGUAGES, TABLE = 4096, 1 << 23
#: Share of a language's rows that the sample takes, in so many parts.
PARTS = 1 << 62
#: Unicode ranges of scripts (first and last code point).
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("latin", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
NAMES = sorted({s[0] for s in SCRIPTS})


def script_of(word: str) -> int:
    """Number of the script of a word's first letter; len(NAMES) for other scripts, -1 without a letter."""
    for c in word:
        if c.isalpha():
            o = ord(c)
            return next((NAMES.index(name) for name, lo, hi in SCRIPTS if lo <= o <= hi), len(NAMES))
    return -1


def grams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of the words, edges included."""
    codes = np.frombuffer((" " + " ".join(w.lower().replace(" ", "_") for w in found) + " ").encode("utf-32-le"), np.uint32)
    space = codes == 32
    owner = np.cumsum(space) - 1
    where, bucket = [], []
    for n in SIZES:
        m = len(codes) - n + 1
        ok = np.ones(m, bool)
        for k in range(n):
            if n == 1 or 0 < k < n - 1:
                ok &= ~space[k : k + m]
        if n == 2:
            ok &= ~(space[:m] & space[1:])
        h = np.full(m, n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h ^ codes[k : k + m]) * np.uint64(0x100000001B3) ^ (h >> np.uint64(29))
        at = np.flatnonzero(ok)
        where.append(owner[at])
        bucket.append(((h[at] ^ (h[at] >> np.uint64(33))) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(where), np.concatenate(bucket)


def buckets_for(languages: int) -> int:
    """Buckets of the table: BUCKETS, or the largest power of two that keeps it within TABLE numbers."""
    out = BUCKETS
    while out * languages > TABLE:
        out //= 2
    return out


class Model:
    """Table of log probabilities (buckets x languages) and each script's candidates."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.table = np.log(smooth / smooth.sum(axis=0)).astype(np.float32) if len(langs) else np.zeros((len(counts), 0), np.float32)
        self.table -= self.table.mean(axis=1, keepdims=True) if len(langs) else 0
        share = scripts / np.maximum(1, scripts.sum(axis=0))
        self.candidate = share >= LEAST_SHARE
        self.candidate[~self.candidate.any(axis=1)] = True

    def word_scores(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words x languages) and letters of words."""
        out = np.empty((len(found), len(self.langs)))
        for lo, hi in in_groups(found, GRAM_CHARS):
            where, bucket = grams(found[lo:hi])
            bucket %= len(self.table)
            for k in range(len(self.langs)):
                out[lo:hi, k] = np.bincount(where, self.table[bucket, k], hi - lo)[: hi - lo]
        letters = np.array([sum(map(str.isalpha, w)) for w in found], np.int64)
        scripts = np.array([script_of(w) for w in found])
        out[~self.candidate[np.maximum(scripts, 0)]] = -50.0
        out[scripts < 0] = 0
        return out.astype(np.float32) * SHARPNESS, letters


def _alone(e: np.ndarray, switch: float) -> int:
    """The language of the best path through scores e (words x languages) if it has no switch, else -1.

    The language with the largest sum is tried: if no stretch, start or end gains more elsewhere than its
    switches cost, it is the best path.
    """
    a = int(np.argmax(e.sum(axis=0)))
    if e.shape[1] == 1:
        return 0
    others = np.delete(e, a, axis=1).max(axis=1) - e[:, a]
    c = np.concatenate([[0.0], np.cumsum(others, dtype=np.float64)])
    sure = c.max() <= switch and (c[-1] - c).max() <= switch and (c - np.minimum.accumulate(c)).max() <= 2 * switch
    return a if sure else -1


def viterbi(texts: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best path through each text's scores (words x languages); all texts take a step together, the longest first."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order])
    k = texts[0].shape[1]
    flat, start = np.concatenate([texts[i] for i in order]), np.cumsum(lengths) - lengths
    back = np.zeros((len(flat), k), np.int16)
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # texts that have a word at each step
    stay, rows = np.arange(k, dtype=np.int16), np.arange(len(order))
    score = flat[start].astype(np.float64)
    for t in range(1, int(lengths[0])):
        n = live[t]
        at, s = start[:n] + t, score[:n]
        top = s.argmax(axis=1)
        other = (s[rows[:n], top] - switch)[:, None]
        moved = s < other
        back[at] = np.where(moved, top[:, None], stay)
        score[:n] = np.where(moved, other, s) + flat[at]
    path = np.zeros(len(flat), np.int64)
    path[start + lengths - 1] = score.argmax(axis=1)
    for t in range(int(lengths[0]) - 1, 0, -1):
        at = start[: live[t]] + t
        path[at - 1] = back[at, path[at]]
    out: list[np.ndarray] = [path] * len(texts)
    for i, a, n in zip(order, start.tolist(), lengths.tolist()):
        out[i] = path[a : a + n]
    return out


def label(e: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path through the scores of one text with words."""
    a = _alone(e, switch)
    return np.full(len(e), a) if a >= 0 else viterbi([e], switch)[0]


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _gram_counts(batches, buckets: int):
    """batches: h, text, lang. Batches (lang, bucket, n): n-grams of each bucket, and words of each script after the buckets; a slice of texts at a time."""
    worker_cache("language")
    for b in in_slices(batches):
        texts, of = b.column(1).to_pylist(), b.column(2).to_pylist()
        for lang in sorted(set(of)):
            seen = Counter(w for t, x in zip(texts, of) if x == lang for w in t.split())
            found = [w for w in seen if script_of(w) >= 0]
            if not found:
                continue
            times = np.array([seen[w] for w in found], np.float64)
            n = np.zeros(buckets + len(NAMES) + 1)
            for lo, hi in in_groups(found, GRAM_CHARS):
                where, bucket = grams(found[lo:hi])
                n[:buckets] += np.bincount(bucket % buckets, times[lo:hi][where], buckets)
            n[buckets:] = np.bincount([script_of(w) for w in found], times, len(NAMES) + 1)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used, pa.int64()), pa.array(n[used])], ["lang", "bucket", "n"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """From the labelled rows of docs (doc_id, text, lang), at most about `sample` of each language."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.xxhash64("doc_id", "text").alias("h"), "text", F.col("lang").cast("string").alias("lang"))
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    langs = sorted(sizes)
    buckets = buckets_for(len(langs))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(NAMES) + 1, 0)))
    shares = docs.sparkSession.createDataFrame([(x, max(1, int(min(1.0, sample / n) * PARTS))) for x, n in sizes.items()], "lang string, share long")
    near = rows.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(PARTS)) < F.col("share")).select("lang", "h", "text")  # at most MOST_LANGUAGES shares
    one = rows.join(F.broadcast(shares), "lang").groupBy("lang").agg(F.min(F.struct("h", "text")).alias("x")).select("lang", "x.h", "x.text")
    rows = near.unionByName(one).groupBy("lang", "h").agg(F.first("text").alias("text")).select("h", "text", "lang")

    def count(batches):
        return _gram_counts(batches, buckets)

    table = rows.mapInArrow(count, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((buckets + len(NAMES) + 1, len(langs)))
    with small_batches(docs.sparkSession):
        got = table.toPandas()  # at most TABLE and languages x scripts
    place = {x: k for k, x in enumerate(langs)}
    counts[got.bucket.to_numpy(np.int64), [place[x] for x in got.lang]] = got.n.to_numpy()
    return Model(langs, counts[:buckets], counts[buckets:])


def _predictor(model: Model):
    """A function from texts to (lang_pred, score, spans) of each; it keeps the scores of words it has seen."""
    known: dict[str, int] = {}
    kept = {"scores": np.zeros((1024, max(1, len(model.langs))), np.float32), "letters": np.zeros(1024, np.int16)}

    def look_up(group: list[list[str]]) -> list[list[int]]:
        if len(known) > min(CACHE_WORDS, max(5000, (1 << 25) // max(1, len(model.langs)))):
            known.clear()
        found = [list(map(known.get, w)) for w in group]
        new = list({w for ws, f in zip(group, found) if None in f for w, i in zip(ws, f) if i is None})
        if not new:
            return found
        s, n = model.word_scores(new)
        at = len(known)
        while len(kept["letters"]) < at + len(new):
            kept.update({k: np.concatenate([x, np.zeros_like(x)]) for k, x in kept.items()})
        kept["scores"][at : at + len(new)], kept["letters"][at : at + len(new)] = s, np.minimum(n, 32_000)
        known.update(zip(new, range(at, at + len(new))))
        return [[known[w] if i is None else i for w, i in zip(ws, f)] if None in f else f for ws, f in zip(group, found)]

    def predict_texts(texts: list[str | None]) -> list[tuple]:
        out: list[tuple] = [("und", 0.0, [])] * len(texts)
        mixed: list[tuple[int, np.ndarray, np.ndarray]] = []
        held = 0

        def settle():
            if mixed:
                for (i, e, letters), path in zip(mixed, viterbi([e for _, e, _ in mixed])):
                    out[i] = _judge(model, e, letters, path)
                mixed.clear()

        for lo in range(0, len(texts) if model.langs else 0, 200):
            found = look_up([t.split() if t else [] for t in texts[lo : lo + 200]])
            for i, f in enumerate(found, lo):
                at = np.array(f, np.int64)
                letters = kept["letters"][at]
                if not letters.any():
                    continue
                e = kept["scores"][at]
                a = _alone(e, SWITCH)
                if a >= 0:
                    out[i] = _judge(model, e, letters, np.full(len(e), a))
                    continue
                if held + len(e) > TOGETHER // max(1, len(model.langs) // 32):
                    settle()
                    held = 0
                mixed.append((i, e, letters))
                held += len(e)
        settle()
        return out

    return predict_texts


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id and text with lang_pred, score and spans (start and stop count words; lang)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, text_hash long, lang_pred string, score double, spans array<struct<start:int,stop:int,lang:string>>"
    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        worker_cache("language")
        predictor = _predictor(sent.value)
        for b in in_slices(batches):
            found = list(zip(*predictor(b.column(2).to_pylist()))) or [(), (), ()]
            made = [pa.array(c, kind) for c, kind in zip(found, (pa.string(), pa.float64(), spans))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["doc_id", "text_hash", "lang_pred", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The rows of docs, whole and in place, whose language is found with at least that score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        worker_cache("language")
        predictor = _predictor(sent.value)
        for b in in_slices(batches):
            found = predictor(b.column("text").to_pylist())
            yield b.filter(pa.array([lang != "und" and score >= least_score for lang, score, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _judge(m: Model, e: np.ndarray, letters: np.ndarray, path: np.ndarray):
    cut = np.flatnonzero(np.diff(path)) + 1
    edges = [0, *cut.tolist(), len(path)]
    spans = [{"start": a, "stop": z, "lang": m.langs[path[a]]} for a, z in zip(edges, edges[1:])]
    share = np.bincount(path, letters, len(m.langs))
    best = int(share.argmax())
    total = e[path == best].sum(axis=0, dtype=np.float64)
    others = np.delete(total, best)
    sure = 1 / (1 + np.exp(-min(30.0, total[best] - others.max()))) if len(others) else 1.0
    return m.langs[best], float(share[best] / share.sum() * sure), spans


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = learn(docs.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
