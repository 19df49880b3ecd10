"""Keys, blocks and fingerprints that many rows share: no task or group gets them all."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from lenswork.llm import components as C
from lenswork.llm import lines, near_duplicates, trie_join


def test_keys_of_many_lines_are_settled_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(lines, "SETTLED", 2000)
    numbered = [f"number {i:06d} of one long list of lines that differ in nothing else" for i in range(6000)]
    texts = ["\n".join(numbered[i : i + 500]) for i in range(0, 6000, 500)] + ["a line of its own, of which there is no other\nanother one, as lonely as it"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    keyed = lines._keyed(docs, "text")
    place = F.struct("doc_id", "text_hash", "line")
    first = lines.line_table(keyed, lines.LEAST_CHARS).groupBy("h").agg(F.min(place).alias("first"))
    made = lines._emit(keyed, first.select("h", "first", F.array().cast("array<int>").alias("shared")), 0)
    rows = made.collect()
    by_key, meeting = {}, {}
    for r in rows:
        by_key.setdefault(r.key, set()).add(r.h)
        if r.salt <= 0:
            meeting[r.key] = meeting.get(r.key, 0) + 1
    assert max(map(len, by_key.values())) >= 5000 and max(meeting.values()) <= len(rows) // 1000
    got = sorted((r.h, r.key, r.k) for r in lines._meeting(made).collect())
    assert got == sorted((r.h, r.key, r.k) for r in rows if len(by_key[r.key]) > 1)


def test_numbered_lines_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "SETTLED", 300)
    numbered = [f"number {i:03d} of one long list of lines" for i in range(1000)]
    docs = spark.createDataFrame([(i, "\n".join(numbered[100 * i : 100 * i + 100])) for i in range(10)], "doc_id long, text string").repartition(7)
    kept = "\n".join(r.new_text for r in sorted(lines.dedup_lines(docs).collect()) if r.new_text)
    assert kept == numbered[0]  # each other number has an earlier one a digit away


def roots_by_brute_force(fps, radius):
    group = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius and group[i] != group[j]:
            lo, hi = sorted((group[i], group[j]))
            group = [lo if g == hi else g for g in group]
    return [fps[g] for g in group]


def test_heavy_blocks_are_walked_further_down(spark, monkeypatch):
    monkeypatch.setattr(trie_join, "NODE", 32)
    asked = []
    grouped = trie_join.block_links

    def seen(points, bits, block, *more, **named):
        asked.append(block)
        return grouped(points, bits, block, *more, **named)

    monkeypatch.setattr(trie_join, "block_links", seen)
    rng = np.random.default_rng(21)
    base = int(rng.integers(1 << 62))
    crowd = {base ^ int(x) << int(rng.choice([0, 20, 40])) for x in rng.integers(0, 1 << 13, 350)}  # equal but for 13 bits
    fps = sorted(crowd | {int(x) for x in rng.integers(0, 1 << 62, 200)})
    rows = spark.createDataFrame([(f, f) for f in fps], "fp long, id long")
    roots = {r.node: r.root for r in C.components(trie_join.links(rows, 64, 2)).collect()}
    assert [roots.get(f, f) for f in fps] == roots_by_brute_force(fps, 2) and len(asked) >= 3


def test_any_two_parts_of_a_heavy_block_meet(spark, monkeypatch):
    monkeypatch.setattr(trie_join, "NODE", 8)
    rng = np.random.default_rng(22)
    fps = sorted({int(x) for x in rng.integers(0, 1 << 14, 400)})
    rows = spark.createDataFrame([(0, f, f, None) for f in fps], "tab int, fp long, id long, sig binary")
    roots = {r.node: r.root for r in C.components(trie_join.block_links(rows, 20, 6, 1)).collect()}
    assert [roots.get(f, f) for f in fps] == roots_by_brute_force(fps, 1)


def test_a_fingerprint_of_most_documents(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "FREQUENT", 5)
    docs = spark.createDataFrame([(i, "" if i % 3 else f"text {i} of some words {i * i}") for i in range(1, 200)] + [(None, None), (None, "")], "doc_id long, text string")
    got = near_duplicates.fingerprint_components(docs).collect()
    assert len(got) == 201 and {r.component_id for r in got if r.doc_id is None or r.doc_id % 3} == {1}
