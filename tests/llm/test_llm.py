import array
import base64
import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lenswork.llm import components as C
from lenswork.llm import decontamination, fingerprints, language, lines, lm_scoring, near_duplicates, packing, substrings, token_output, trie_join, warc
from lenswork.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import compare

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, h string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [None, "", "  \n\t ", "one", "Aa bb\ncc", LONG, "same words here again " * 12, "same words here again " * 12, "é ß 漢字 Привет", "x" * 5000]


def docs_of(spark, texts=ODD):
    rows = [(i, t, "en", "s", None, "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[4], rows[6]] if len(rows) > 6 else []  # repeated rows
    rows += [(None, "no id at all", None, None, None, None, None)] if texts is ODD else []
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLE_SQL[name])


OPERATORS = {
    "substrings": lambda d: substrings.remove_repeats(d),
    "lm": lambda d: lm_scoring.score_documents(d),
    "language": lambda d: language.predict(d, language.learn(d)),
    "packing": lambda d: packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json")),
    "components": lambda d: near_duplicates.fingerprint_components(d),
    "groups": lambda d: near_duplicates.near_duplicate_groups(d),
    "fingerprints": lambda d: fingerprints.fingerprint_documents(d),
    "decontamination": lambda d: decontamination.report(d, d.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id = 4")),
    "tokens": lambda d: token_output.read_token_files(token_output.write_token_files(d, public_tokenizers.path("byte_bpe_50k.json"), 0)),
    "lines": lambda d: lines.dedup_lines(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    docs = docs_of(spark)
    rows = OPERATORS[name](docs).collect()
    assert len(rows) >= docs.count()
    if name not in ("packing",):
        assert len(rows) == docs.count()
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_scores_do_not_depend_on_blocks_and_ranges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    found = [lm_scoring.score_documents(docs, block_words=b, range_words=r) for b, r in ((2_000_000, 2_000_000), (700, 3000), (1, 50_000))]
    found = [sorted((r.doc_id, r.text_hash, r.n_words, round(r.score, 6)) for r in d.collect()) for d in found]
    assert found[0] == found[1] == found[2] and len(found[0]) == docs.count()


def test_recompression_finds_every_repeat(spark):
    rng = np.random.default_rng(3)
    texts = []
    shared = [" ".join(f"s{x}" for x in rng.integers(0, 50, 60)) for _ in range(5)]
    for _ in range(40):
        parts = [" ".join(f"u{x}" for x in rng.integers(0, 4, 30)), shared[rng.integers(5)], "a " * int(rng.integers(0, 90)), " ".join(f"u{x}" for x in rng.integers(0, 9, 20))]
        texts.append(" ".join(parts))
    seen = {}
    for i, t in enumerate(texts):
        w = t.split()
        for p in range(len(w) - 34):
            seen.setdefault(tuple(w[p : p + 35]), []).append((i, p))
    gone = {(i, q) for at in seen.values() if len(at) > 1 for i, p in at for q in range(p, p + 35)}
    for r in substrings.remove_repeats(docs_of(spark, texts)).filter("doc_id < 40").collect():
        w = texts[r.doc_id].split()
        if r.doc_id not in (4, 6):  # those rows are there twice
            assert r.kept == " ".join(x for q, x in enumerate(w) if (r.doc_id, q) not in gone)


def test_trie_join_and_components(spark, monkeypatch):
    monkeypatch.setattr(trie_join, "NODE", 16)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 20, 150)
    fps = sorted({int(b) ^ int(m) for b in base for m in (0, 1 << int(rng.integers(20)), 3 << int(rng.integers(18)))})
    rows = spark.createDataFrame([(f, f) for f in fps], "fp long, id long")
    roots = {r.node: r.root for r in C.components(trie_join.links(rows, 20, 2)).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if bin(a ^ b).count("1") <= 2 and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(roots.get(f, f) == find(f) for f in fps)


def test_near_duplicates_by_shingles(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(12):
        w = [f"t{x}" for x in rng.integers(0, 3000, 200)]
        other = list(w)
        other[100] = "changed"
        texts += [" ".join(w), " ".join(other), " ".join(w[:60])]
    sets = [set(near_duplicates.shingle_hashes(t, 5).tolist()) for t in texts]
    for r in near_duplicates.near_duplicate_groups(docs_of(spark, texts)).collect():
        wanted = min(j for j in range(len(texts)) if len(sets[j] & sets[r.doc_id]) >= 0.8 * len(sets[j] | sets[r.doc_id]))
        assert r.group_id == wanted


def groups_by_brute_force(texts):
    sets = [set(near_duplicates.shingle_hashes(t, 5).tolist()) for t in texts]
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
            lo, hi = sorted((group[i], group[j]))
            group = [lo if g == hi else g for g in group]
    return group


def test_near_duplicates_among_many_of_one_template(spark):
    rng = np.random.default_rng(8)
    texts = []

    def put(places, mark):  # a changed word takes five shingles
        words = [f"t{i}" for i in range(1000)]
        for p in places:
            words[5 * p + 2] = f"{mark}x{p}"
        texts.append(" ".join(words))

    for i in range(200):  # any two at about 0.76; every fifth has a copy at 0.83
        places = rng.choice(200, 19, replace=False)
        put(places[:14], f"d{i}")
        if i % 5 == 0:
            put(places[5:], f"c{i}")
    wanted = groups_by_brute_force(texts)
    got = {r.doc_id: r.group_id for r in near_duplicates.near_duplicate_groups(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == wanted and 20 < len(set(wanted)) < len(texts)


def test_near_duplicates_of_short_texts(spark):
    rng = np.random.default_rng(9)
    texts = []
    for i in range(300):
        w = [f"s{i}w{x}" for x in rng.integers(0, 1000, 8)]
        texts += [" ".join(w), " ".join([*w, "more"])]  # 4 of 5 shingles
    got = {r.doc_id: r.group_id for r in near_duplicates.near_duplicate_groups(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))]


def test_near_duplicates_with_null_and_repeated_ids(spark):
    words = lambda mark: [f"{mark}{i}" for i in range(60)]
    a, b, c, d, e, f = (" ".join(words(x)) for x in "abcdef")
    rows = [(None, a), (None, b), (None, a + " more"), (1, c), (1, d), (2, d + " more"), (3, e), (3, e), (None, e + " more"), (None, f), (None, f)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in near_duplicates.drop_near_duplicates(docs).collect()), key=str)
    kept_a = next(t for _, t in got if t in (a, a + " more"))  # either, by its hash
    assert got == sorted([(None, kept_a), (None, b), (1, c), (1, d), (3, e), (None, f)], key=str)


def test_lines_within_one_edit(spark):
    one = "the quick brown fox jumps over the lazy dog"
    texts = [f"{one}\nshort", one.replace("quick", "quack"), one + "s\nkept line number one of this text", one.replace("fox ", "fx "), one.replace("quick", "quaak"), one.upper(), f"{one}\n{one}"]
    got = {r.doc_id: r.new_text for r in lines.dedup_lines(docs_of(spark, texts).filter("doc_id < 7").distinct()).collect()}
    assert got == {0: texts[0], 1: "", 2: "kept line number one of this text", 3: "", 4: "", 5: "", 6: ""}


def test_short_lines_are_equal_or_kept(spark):
    texts = ["Le treque.\n\nfirst line of this text", "le  Treque.\n\nle trequ.\nsecond text has its own line\nle trequ.", "Le trequf.\n \nLE TREQUE."]
    got = {r.doc_id: (r.new_text, r.n_removed) for r in lines.dedup_lines(docs_of(spark, texts).distinct()).collect()}
    assert got == {0: (texts[0], 0), 1: ("\nle trequ.\nsecond text has its own line", 2), 2: ("Le trequf.\n ", 1)}


def test_token_blocks_round_trip(spark, sf):
    rng = np.random.default_rng(6)
    for ids in (np.zeros(1, np.uint32), rng.integers(0, 2**32, 300, dtype=np.uint32), np.r_[rng.integers(5, 90, 8000), 2**31].astype(np.uint32), np.full(17, 7, np.uint32)):
        assert (token_output.unpack_block(token_output.pack_block(ids)) == ids).all()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for t in ODD if t] + ["a  b\n c", " lead", "<|endoftext|>", "hello <|endoftext|> world", "x<|endoftext|>y"]
    got = sorted(token_output.read_token_files(token_output.write_token_files(docs_of(spark, texts).distinct(), public_tokenizers.path("byte_bpe_50k.json"), 0)).collect())
    at = 0
    for r, t in zip(got, texts):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(array.array("I", ids).tobytes()))
        at += len(ids)


def test_ranges_of_token_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_output.write_token_files(docs_of(spark, [LONG, "two words", LONG]).select("doc_id", "text"), path, 0, partitions=1).collect()
    fs, p = token_output.filesystem(manifest[0].path)
    ids = np.concatenate(list(token_output.read_blocks(fs, p)[1]))
    assert len(ids) == manifest[0].n_ids > 2 * token_output.BLOCK
    for start, count in ((0, 5), (token_output.BLOCK - 3, 9), (token_output.BLOCK, token_output.BLOCK), (len(ids) - 4, 4), (100, 2 * token_output.BLOCK)):
        assert (token_output.read_range(manifest[0].path, start, count) == ids[start : start + count]).all()


def test_packing_is_gapless_and_close_to_the_bound(spark, sf):
    rows = QUERIES["op5_best_fit_packing"](spark, sf).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(x)))
        assert [o for o, _ in sorted(x)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(sequences) <= 1.02 * sum(r.length for r in rows) / 4096 + 1


def test_archives(spark):
    pages = [(1, "http://a/ b", "same"), (2, None, "same"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "é" * 100_000), (6, "u\r\nx: y", "one\r\n\r\ntwo"), (7, "http://a", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_archives(warc.normalise(warc.write_archives(df))).collect()}
    top = {}
    for i, _, h in pages:
        top[h or ""] = max(i, top.get(h or "", 0))
    for i, _, h in pages:
        raw = (h or "").encode()
        response = top[h or ""] == i
        r = got[i]
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(raw), "response" if response else "revisit", None if response else top[h or ""])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert not response or bytes(r.payload) == raw
    assert warc.write_archives(df.limit(0)).count() == 0


def test_language_of_mixed_text_and_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["op3_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    e = np.array([[2.0, 0.0]] * 9 + [[0.0, 3.0]] * 9, np.float32)
    assert language.label(e).tolist() == [0] * 9 + [1] * 9


def test_viterbi_by_brute_force():
    rng = np.random.default_rng(12)
    texts = [rng.normal(0, 3, (int(n), 3)).astype(np.float32) for n in rng.integers(1, 8, 150)]

    def value(e, path):
        return sum(float(e[t, k]) for t, k in enumerate(path)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))

    for e, together in zip(texts, language.viterbi(texts, 2.0)):
        best = max(value(e, p) for p in itertools.product(range(3), repeat=len(e)))
        assert abs(value(e, together) - best) < 1e-4 and abs(value(e, language.label(e, 2.0)) - best) < 1e-4


def test_decontamination_removes_spans_or_documents(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "Solo"), (3, None)], "item_id long, text string")
    docs = docs_of(spark, ["x alpha, beta gamma delta epsilon zeta eta theta iota KAPPA y", "clean text", "SOLO!", None])
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, bench).collect()) == [1, 3]
    got = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, remove="spans").collect()}
    assert got == {0: "x y", 1: "clean text", 2: "", 3: None}


def test_decontamination_without_a_broadcast(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    long_text = docs_of(spark, [LONG + " alpha beta gamma " + LONG, "solo"]).select("doc_id", "text")
    docs = docs.select("doc_id", "text").unionByName(long_text)
    bench = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").unionByName(spark.createDataFrame([("a", "alpha beta gamma"), ("b", "Solo")], "item_id string, text string"))
    wanted = sorted(map(str, decontamination.report(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert sorted(map(str, decontamination.report(docs, bench).collect())) == wanted


def test_fingerprints_by_brute_force(spark):
    rows = [(i, f"text {i} " * (i * 7 % 23)) for i in range(120)] + [(10**15, "far away"), (None, "no id"), (None, None), (None, "no id"), (5, "another five"), (5, "another five"), (7, "é漢字 abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = [(r.doc_id, r.text or "", r.h) for r in docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    order.sort(key=lambda x: (x[0] is None, -(x[0] or 0), x[2]))
    cases = []
    for i, (doc_id, text, _) in enumerate(order):
        after, n = order[(i + 1) % len(order)][1], len(text)
        cases.append((doc_id, text, text[: n - n // 2] + after[: n // 2], after))
    texts = sorted({t for c in cases for t in c[1:]})

    def fingerprint(text):
        w = text.lower().split()
        terms = list(zip(w, w[1:])) or [(x, "") for x in w]
        return terms, [2 if len(a) + len(b) >= fingerprints.LONG else 1 for a, b in terms]

    hashed = spark.createDataFrame([(a, b) for t in texts for a, b in fingerprint(t)[0]] or [("", "")], "a string, b string").distinct().withColumn("h", F.xxhash64("a", "b"))
    h = {(r.a, r.b): r.h % (1 << 64) for r in hashed.collect()}
    fps = {}
    for t in texts:
        terms, weights = fingerprint(t)
        fps[t] = sum(1 << k for k in range(64) if 2 * sum(w for x, w in zip(terms, weights) if h[x] >> k & 1) > sum(weights))
    like = lambda a, b: 1 - bin(fps[a] ^ fps[b]).count("1") / 64
    wanted = [(d, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{fps[t]:016x}", f"{fps[e]:016x}", like(t, e), like(t, a)) for d, t, e, a in cases]
    got = [tuple(r)[:7] for r in fingerprints.fingerprint_documents(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted))


def test_fingerprint_neighbours(spark, sf):
    rows = QUERIES["op7_fingerprints"](spark, sf).collect()
    fps = [int(r.fingerprint, 16) for r in rows]
    for r in rows:
        if r.doc_id % 20 == 0:
            assert r.n_near == sum(bin(int(r.fingerprint, 16) ^ f).count("1") <= fingerprints.RADIUS for f in fps)


def test_simhash_by_brute_force(spark):
    for text in [t for t in ODD if t and t.strip()][:4]:
        w = text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert near_duplicates.fingerprint(text, 3) % (1 << 64) == bits


def test_simhash_components_of_documents_by_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(trie_join, "NODE", 8)  # several tasks, and blocks in parts
    rows = QUERIES["op6_simhash_components"](spark, sf).collect()
    fps = np.array([int(r.fingerprint, 16) for r in rows], np.uint64)
    ids = [r.doc_id for r in rows]
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2).tolist():
            lo, hi = sorted((group[i], group[j]))
            if lo != hi:
                group = [lo if g == hi else g for g in group]
    least = {}
    for g, i in zip(group, ids):
        least[g] = min(i, least.get(g, i))
    assert [r.component_id for r in rows] == [least[g] for g in group]


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def test_lines_by_brute_force(spark):
    rng = np.random.default_rng(13)
    base = ["".join(rng.choice(list("abc d"), int(rng.integers(12, 40)))).strip() for _ in range(25)]

    def edited(x):
        k, c = int(rng.integers(len(x))), str(rng.choice(list("abcé")))
        return [x, x[:k] + x[k + 1 :], x[:k] + c + x[k + 1 :], x[:k] + c + x[k:]][int(rng.integers(4))]

    texts = ["\n".join(edited(str(rng.choice(base))) for _ in range(int(rng.integers(1, 6)))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, wanted = [], []
    for t in texts:
        kept = []
        for line in t.split("\n"):
            x = lines.normal(line)
            gone = x and any(x == y or min(len(x), len(y)) >= lines.LEAST_CHARS and within_one_edit(x, y) for y in seen)
            seen.append(x)
            kept += [] if gone else [line]
        wanted.append("\n".join(kept))
    assert [r.new_text for r in sorted(lines.dedup_lines(docs).collect())] == wanted


def test_packing_of_pieces_in_several_blocks(spark, sf, monkeypatch):
    for name, value in (("BLOCK_ITEMS", 30), ("FAN_IN", 2), ("HANDED_ON", 3)):
        monkeypatch.setattr(packing, name, value)
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack_documents(docs, path).collect()
    tok = Tokenizer.from_file(path)
    pieces, total = [], 0
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        pieces += [(r.doc_id, k, at, len(part := ids[at : at + 4096]), zlib.crc32(array.array("I", part).tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(pieces)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(x)))
        assert [o for o, _ in sorted(x)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(sequences) <= 1.05 * total / 4096 + 1


def test_islands_pack_better_than_best_fit():
    import random

    rng = random.Random(3)
    size = sorted((rng.randint(1200, 2200) for _ in range(400)), reverse=True)
    plain = []
    packing.best_fit(plain, [], list(range(400)), size, 4096)
    found = packing.evolve(size, [], 4096, packing.GENERATIONS, packing.POPULATION, rng)[0]
    assert sorted(i for b in found for i in b) == list(range(400)) and max(sum(size[i] for i in b) for b in found) <= 4096
    assert len(found) < len(plain)


def test_pages_with_odd_rows(spark):
    rows = [(1, "u", "x", "c"), (1, "u", "x", "c"), (None, "v", "x", "c"), (2, None, "y", "c"), (None, "w", "z", "c"), (3, "\x85", None, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(warc.normalise(warc.write_archives(pages))).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "response", None), (None, "revisit", 1), (2, "response", None), (None, "response", None), (3, "response", None)], key=str)


def test_pipeline_stages_with_odd_rows(spark, sf):
    import corpus_pipeline

    text = "the same sentence of the house and the garden with many different words in it {}"
    long = " ".join(f"the house number {i} and the garden of the village" for i in range(40))
    rows = [(None, None), (None, "1 2 3"), (1, text.format("one") + "\nof"), (1, text.format("two and other things") + "\nto be"), (2, long), (2, long), (None, long + " more"), (3, ""), (4, text.format("one"))]
    names = ["_d", "_t", "_h", "_row", "_rest", "n_removed", "text_hash", "new_text", "h", "gone", "size", "root"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"{c}{k}" for c in names]) for k, (i, t) in enumerate(rows)], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(c + ' string' for c in names)}")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = near_duplicates.stored(stage(spark, docs, sf), name)
        assert stage(spark, docs.limit(0), sf).count() == 0
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            break
        assert out.columns == docs.columns
        kept[name] = {r._d[2:]: r for r in out.collect()}
        for k, r in kept[name].items():
            assert r.doc_id == rows[int(k)][0] and all(r[c] == f"{c}{k}" for c in names)
        docs = out
    assert set(kept["language"]) == set("245678") - {"7"} | {"3"}
    assert set(kept["lines"]) == set("23456") and kept["lines"]["2"].text == rows[2][1] and kept["lines"]["2"].n_chars == len(rows[2][1])
    assert len(kept["near_duplicates"]) == 3 and {"2", "3"} <= set(kept["near_duplicates"])
    assert set(kept["decontamination"]) == set(kept["near_duplicates"])


def test_pipeline_stages_keep_columns(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = near_duplicates.stored(stage(spark, docs, sf), name)
        assert docs.columns == columns and 0.8 * before <= docs.count() <= before
