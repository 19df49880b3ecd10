"""Keys of the line operator that are made for many lines at a time."""

import numpy as np

from lenswork.llm import lines


def some_lines():
    rng = np.random.default_rng(31)
    base = ["".join(rng.choice(list("ab é😀"), int(rng.integers(12, 60)))) for _ in range(30)] + ["", "x"]
    cut = [x[:k] + x[k + 1 :] for x in base if x for k in rng.integers(0, len(x), 4)]
    return base + cut + [x[:k] + "q" + x[k + 1 :] for x in base if x for k in rng.integers(0, len(x), 4)]


def every_part(of, level):
    parts = 8 if level == 0 else 32
    return np.repeat(np.arange(len(of)), parts), np.tile(np.arange(parts), len(of))


def test_keys_of_many_lines_are_equal_where_single_ones_are(monkeypatch):
    of = [x for x in some_lines() if x]
    for long in (lines.LONG, 30):  # 30: most lines are hashed one by one, and some have a part of either kind
        monkeypatch.setattr(lines, "LONG", long)
        for level in (0, 1):
            row, k = every_part(of, level)
            got = lines.keys(of, row, k, level).tolist()
            single = [lines.key(of[r], int(part), level) for r, part in zip(row, k)]
            assert len(set(got)) == len(set(single)) == len(set(zip(got, single))) > len(of)


def test_no_line_is_hashed_by_itself(monkeypatch):
    asked = []
    monkeypatch.setattr(lines, "_hash", lambda text, seed=0: asked.append(text))
    of = some_lines()[:30]
    for level in (0, 1):
        assert len(lines.keys(of, *every_part(of, level), level)) == (8, 32)[level] * len(of)
    assert not asked


def test_lines_of_the_length_where_keys_change(spark):
    rng = np.random.default_rng(32)
    kept, gone = [], []
    for n in range(lines.LONG - 1, lines.LONG + 2):
        x = "".join(rng.choice(list("abcdefgh"), n))
        p = int(rng.integers(n))
        kept.append(x)
        gone.append([x[:p] + "x" + x[p + 1 :], x[:p] + "x" + x[p:], x[:p] + x[p + 1 :]][n % 3])
    docs = spark.createDataFrame(list(enumerate(kept + gone)), "doc_id long, text string").repartition(3)
    assert [r.new_text for r in sorted(lines.dedup_lines(docs).collect())] == kept + [""] * 3


def test_lines_are_lower_cased_as_one_by_one():
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) != "\n"]
    for s in spaces:
        text = f"ΑΣ{s}Β\n{s}Σ{s}aΣ{s}\nΣb\n\nİ{s}{s}Σ"
        assert lines.normal_lines(text) == [lines.normal(x) for x in text.split("\n")]
