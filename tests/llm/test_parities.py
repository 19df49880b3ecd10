"""Which pairs the near-duplicate stage reads texts for."""

import numpy as np

from lenswork.llm import near_duplicates


def test_parities_never_tell_more_than_the_difference():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 63, 64, 65, 129, 900, 1100, 70_000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, len(s) // 8).astype(np.uint64)])) for s in sets]
    flags = [near_duplicates.parities(s) for s in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    least = near_duplicates.least_difference([flags[i] for i, _ in pairs], [flags[j] for _, j in pairs])
    truth = [len(np.setxor1d(sets[i], sets[j])) for i, j in pairs]
    assert all(a <= b for a, b in zip(least.tolist(), truth))
    alike = {n: near_duplicates.least_difference([flags[n]], [flags[n + 9]])[0] for n in (6, 7)}
    apart = near_duplicates.least_difference([flags[6]], [flags[7]])[0]
    assert all(a < 300 for a in alike.values()) and apart > (900 + 1100) / 9 + 100
    assert len(near_duplicates.least_difference([], [])) == 0


def test_long_texts_that_share_some_shingles_are_not_read_again(spark, monkeypatch):
    """Every two of them meet at a shingle, and their sets are not nearly alike; one has a near copy."""
    rng = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(11)])
    texts = [words[rng.integers(0, 11, 3000)] for _ in range(24)]
    copy = texts[5].copy()
    copy[::90] = "new"
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate([*texts, copy])], "doc_id long, text string")
    rows, real = {}, near_duplicates.stored

    def stored(df, name):
        out = real(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_duplicates, "stored", stored)
    monkeypatch.setattr(near_duplicates, "LAST_SHINGLES", 0)  # as with more texts than are looked at for the order
    got = {r.doc_id: r.group_id for r in near_duplicates.near_duplicate_groups(docs).collect()}
    assert got == {k: 5 if k == 24 else k for k in range(25)}
    assert sum(rows["exact-candidates"]) > 100, rows
    assert sum(rows["shingles"]) <= 4, rows
