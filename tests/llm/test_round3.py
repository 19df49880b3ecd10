"""Toxicity, phrases and the prefix trie: brute force, odd rows, many parts."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lenswork.llm import phrases, prefix_trie, toxicity
from lenswork.llm.common import split_words
from lenswork.llm.queries import QUERIES

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TURNS = "conv_id long, turn long, role string, text string"


# prefix trie


def trie_by_brute_force(rows):
    found = {}
    for c, t, r, x in rows:
        if c is not None:
            found.setdefault(c, []).append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in found.items()}
    paths = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = turns.get(base, [])[:h] + v[h:]
    members, children = {}, {}
    for c, v in paths.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out, below = [], {}
    for k in sorted(members, key=len, reverse=True):
        leaves = sum(below[x][0] for x in children.get(k, [])) or 1
        saved = sum(below[x][1] for x in children.get(k, [])) + ((len(members[k]) - 1) * len(k[-1][1].decode()) if k else 0)
        below[k] = (leaves, saved)
        ends = ",".join(map(str, sorted(c for c in members[k] if len(paths[c]) == len(k))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children.get(k, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, parts=5):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(parts)).collect()), key=str)


def test_trie_of_the_given_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_prefix_trie"](spark, sf).collect()), key=str)
    assert got == trie_by_brute_force(rows)


def test_trie_of_odd_rows_long_and_common_conversations(spark, monkeypatch):
    for name, value in (("PIECE", 16), ("SHARD", 300), ("RANGE", 64)):
        monkeypatch.setattr(prefix_trie, name, value)
    rng = random.Random(1)
    rows = []
    for c in [*range(260), -5, -100, -230, 400, 10**15]:
        rows += [(c, rng.choice([t, t, t, None, 0]), rng.choice(["u", None, ""]), rng.choice(["a", "b", "é漢", None, ""])) for t in range(rng.randrange(9))]
    rows += [(None, 1, "u", "x"), (7, 2, "u", "a"), (7, 2, "u", "a")]  # no id; a repeated row
    rows += [(c, i, "u", f"t{i % 7}") for c, n in ((300, 1500), (317, 1400), (350, 10)) for i in range(n)]  # pieces in several parts
    rows += [(c, i, "s", f"same {i}") for c in range(1000, 1400) for i in range(3)]  # copies
    assert trie(spark, rows) == trie_by_brute_force(rows)


def test_trie_of_few_rows(spark):
    assert trie(spark, [], 1) == []
    for rows in ([(5, None, None, None)], [(103, 0, "u", "x")], [(200, 0, "u", "x"), (None, 0, "u", "y")]):
        assert trie(spark, rows, 1) == trie_by_brute_force(rows)
    clash = spark.createDataFrame([(1, 0, "u", "x", "p", 7)], TURNS + ", path string, node int")
    assert prefix_trie.prefix_trie(clash).count() == len(trie_by_brute_force([(1, 0, "u", "x")]))


def test_double_array_keeps_every_path():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 9, 400)
    starts = np.cumsum(lengths) - lengths
    ids = np.where(rng.random(lengths.sum()) < 0.3, rng.integers(0, 5000, lengths.sum()), rng.integers(0, 4, lengths.sum()))
    made = prefix_trie.DoubleArray(ids, starts, lengths)
    slot_of = {}
    state = np.zeros(len(starts), np.int64)
    for d in range(lengths.max()):
        on = np.flatnonzero(lengths > d)
        state[on] = made.step(state[on], ids[starts[on] + d])
        for k in on.tolist():
            path = tuple(ids[starts[k] : starts[k] + d + 1].tolist())
            assert state[k] > 0 and slot_of.setdefault(path, state[k]) == state[k]
    assert len(set(slot_of.values())) == len(slot_of)
    assert made.step(np.array([0]), np.array([9999]))[0] == -1


def test_hashes_of_runs_follow_from_their_parts():
    t = [prefix_trie.token("u", str(k)) for k in range(9)]
    whole = prefix_trie.extended(0, t)
    for k in range(10):
        assert prefix_trie.joined(prefix_trie.extended(0, t[:k]), 9 - k, prefix_trie.extended(0, t[k:])) == whole
    assert prefix_trie.token("ab", "c") != prefix_trie.token("a", "bc")


# phrases


def phrases_by_brute_force(rows, least, longest, share=50, top=2000):
    counts, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            counts.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        found = {p: c for (x, p), c in counts.items() if x == lang and c >= least and len(p) > 1}
        kept = []
        for p, a in found.items():
            if any(100 * b >= share * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            cut = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
            kept.append((-cut[0], -a, " ".join(p).encode(), counts[lang, p[: cut[1]]], counts[lang, p[cut[1] :]]))
        out += [(lang, k, p.decode(), -a, x, y, n[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "longest", "tile", "dense"), [(4, 3, 8, 20), (3, 5, 512, 1 << 14), (2, 2, 4, 1)])
def test_phrases_by_brute_force(spark, monkeypatch, least, longest, tile, dense):
    monkeypatch.setattr(phrases, "TILE", tile)
    monkeypatch.setattr(phrases, "DENSE", dense)
    rng = random.Random(5)
    rows = [(None, "en"), ("", "en"), (" \t\n", None), ("Été à été", "fr"), (LONG[:3000], "en"), (LONG[:3000], "en"), ("a\x1cb a\x1cb c", "xx")]
    for k in range(250):
        words = [rng.choice(["alpha", "Beta", "gamma", "delta", "ÉTÉ", "x-y", "q", "z9"][: 3 + k % 6]) for _ in range(rng.randrange(1, 25))]
        rows.append(("".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\r\n", "\x0b"]) for w in words), rng.choice(["en", "de", None])))
    docs = spark.createDataFrame([(*r, "c") for r in rows], "text string, lang string, word string").repartition(4)
    got = sorted(tuple(r) for r in phrases.mine_phrases(docs, least, longest).collect())
    assert got == phrases_by_brute_force(rows, least, longest) and len(got) > 20
    assert phrases.mine_phrases(docs, least, longest, top=3).count() <= 3 * 5
    assert phrases.mine_phrases(docs.limit(0)).count() == 0


def test_crowded_bitmaps_change_nothing(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wanted = sorted(map(tuple, phrases.mine_phrases(docs).collect()))
    monkeypatch.setattr(phrases, "bitmap", lambda keys: np.full(phrases.BITS // 8, 255, np.uint8))
    assert sorted(map(tuple, phrases.mine_phrases(docs).collect())) == wanted and wanted


def test_keys_and_bitmaps_are_sparks(spark):
    rows = spark.createDataFrame([("en", "été", 5, -3), ("", "x", 2**62, 0)], "lang string, word string, a long, b long")
    for r in rows.withColumns({"k": F.xxhash64("lang", "word"), "p": F.xxhash64(F.array("a", "b"))}).collect():
        assert phrases._keys([r.lang], pa.array([r.word]))[0] == r.k
        one = phrases.chained(np.array([r.a], np.int64), 42)
        assert phrases.chained(np.array([r.b], np.int64), one).view(np.int64)[0] == r.p
    assert np.uint64(xxhash.xxh64_intdigest((7).to_bytes(8, "little"), 9)) == phrases.chained(np.array([7]), 9)[0]
    keys = np.array([0, 1, phrases.BITS - 1, -1, 5_000_000, 1 << 40], np.int64)
    bits = phrases.bitmap(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert phrases.marked(bits, keys).all() and np.unpackbits(bits).sum() == len(set((keys & (phrases.BITS - 1)).tolist()))


def test_words_of_texts():
    texts = ["", None, "One two", "x", "a.B\tc\n\nd", "é 漢字,", "  "]
    column = pa.array(["skipped", *texts]).slice(1)
    found = split_words(column, phrases.PLAIN)
    got = list(zip(found.row.tolist(), found.words.to_pylist()))
    wanted = [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[^.,;:!?\x09-\x0D ]+", (t or "").lower())]
    assert got == wanted
    pieces = [len(list(g)) for _, g in itertools.groupby(found.piece.tolist())]
    assert pieces == [2, 1, 1, 2, 1, 2]


# toxicity


def labelled(rng, n=400):
    good, bad = [f"g{k}" for k in range(200)], ["vilest", "rotten", "beastly"]
    docs, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        said = [[rng.choice(good) for _ in range(rng.randrange(2, 12))] for _ in range(rng.randrange(1, 9))]
        if toxic:
            said[rng.randrange(len(said))].insert(1, rng.choice(bad))
        docs.append((k, ". ".join(" ".join(s) for s in said) + "!", "en"))
        labels.append((k, int(toxic)))
    return docs, labels


def test_toxicity_learns_from_documents_and_finds_sentences(spark):
    docs, labels = labelled(random.Random(3))
    docs += [(None, "rotten words. fine words", "c"), (9001, None, "c"), (9002, " \n", "c"), (9003, "ROTTEN", "c"), (9003, "fine", "c"), (9003, "fine", "c"), (9004, LONG + ". so rotten. " + LONG, "c")]
    labels += [(None, 1), (9001, 1), (9002, None), (1, 0), (9003, 0)]
    table = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3)
    marks = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, toxic int, text string")
    model = toxicity.learn(table, marks)
    rows = toxicity.score(table, model).collect()
    assert len(rows) == len(docs)
    by = {(r.doc_id, round(r.score, 9)): r for r in rows}
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 9000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 60 and all((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in held)
    bad = re.compile("vilest|rotten|beastly")
    for r in held:
        assert all(bad.search(s.text) for s in r.offending) and bool(r.offending) == (r.doc_id % 5 == 0)
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in rows if r.doc_id in (9001, 9002))
    assert sum(r.score >= 0.3 for r in rows if r.doc_id == 9003) == 1 and sum(k[0] == 9003 for k in by) == 2
    [long] = [r for r in rows if r.doc_id == 9004]
    assert [(s.sentence, s.text) for s in long.offending] == [(1, "so rotten")]
    assert next(r for r in rows if r.doc_id is None).offending[0].sentence == 0
    assert toxicity.score(table.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score(table, toxicity.learn(table, marks.limit(0))).collect()} == {0.0}
    few = toxicity.training_rows(table, marks, sample=20).agg(F.count(F.lit(1)), F.sum("weight")).first()
    assert few[0] <= 80 and 150 < few[1] < 600


def test_gradient_by_differences():
    rng = np.random.default_rng(4)
    sizes = [rng.integers(1, 4, int(rng.integers(0, 4))) for _ in range(12)]
    ids = [rng.integers(0, 6, int(s.sum())) for s in sizes]
    y, weight, plain = rng.integers(0, 2, 12).astype(float), rng.random(12) + 0.5, rng.integers(0, 3, 12)
    at = np.append(rng.normal(0, 1, 6), -1.5)
    got = toxicity.gradient(at, y, weight, plain, sizes, ids)
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-6
        up, down = (toxicity.gradient(at + s, y, weight, plain, sizes, ids)[-1] for s in (step, -step))
        assert abs((up - down) / 2e-6 - got[k]) < 1e-4
    # the noisy-or itself
    for j in range(12):
        p = 1.0
        for part in np.split(ids[j], np.cumsum(sizes[j]))[:-1]:
            p *= 1 - 1 / (1 + np.exp(-(at[-1] + at[part].sum())))
        p *= (1 - 1 / (1 + np.exp(1.5))) ** plain[j]
        one = toxicity.gradient(at, y[j : j + 1], weight[j : j + 1], plain[j : j + 1], sizes[j : j + 1], ids[j : j + 1])[-1]
        assert abs(one - weight[j] * np.log(max(1e-12, 1 - p if y[j] else p))) < 1e-9


def test_toxicity_query(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = QUERIES["op11_toxicity"](spark, sf).join(labels, "doc_id").collect()
    assert QUERIES["op11_toxicity"](spark, sf).count() == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3)


def test_toxicity_of_held_out_documents(spark, sf):
    larger = sf.replace("sf0.001", "sf0.01")  # 305 labelled rows to learn from; sf0.001 has 64, of which 9 are toxic
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    held = QUERIES["op11_toxicity"](spark, larger).filter("held_out").join(labels, "doc_id").collect()
    assert len(held) > 80 and sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)
    assert not any(r.predicted and not r.toxic for r in held)
