"""Language identification as a query, and what its sample may meet."""

import zlib

import numpy as np
import pytest

from lenswork.llm import decontamination, language
from lenswork.llm.queries import QUERIES

WORDS = {"aa": "kalu miro besa tolu rani", "bb": "straff glomp brunt schnek dworp", "cc": "éouè çaré nêux tié ôlan"}


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(int(k), " ".join(rng.choice(WORDS[x].split(), 12)), x) for k, x in enumerate(rng.choice(list(WORDS), n))]


def plain_prediction(model, text):
    """By the definition: each word's sum of n-gram scores among its script's candidates, the best path word by word, letters' shares."""
    words = text.split() if text else []
    if not any(c.isalpha() for w in words for c in w):
        return "und"
    scores, letters = [], []
    for w in words:
        s = [0.0] * len(model.langs)
        if (script := language.script_of(w)) >= 0:
            _, bucket = language.grams([w])
            s = [language.SHARPNESS * (sum(float(model.table[b % len(model.table), k]) for b in bucket) if model.candidate[script, k] else -50.0) for k in range(len(model.langs))]
        scores.append(s)
        letters.append(sum(map(str.isalpha, w)))
    best, back = list(scores[0]), []
    for s in scores[1:]:
        top = max(range(len(s)), key=lambda k: best[k])
        come = [k if best[k] >= best[top] - language.SWITCH else top for k in range(len(s))]
        back.append(come)
        best = [(best[k] if come[k] == k else best[top] - language.SWITCH) + s[k] for k in range(len(s))]
    at = max(range(len(best)), key=lambda k: best[k])
    path = [at]
    for come in reversed(back):
        path.append(at := come[at])
    share = [0] * len(model.langs)
    for k, n in zip(reversed(path), letters):
        share[k] += n
    return model.langs[share.index(max(share))]


def test_query_by_the_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, sf).collect()}
    model = language.learn(docs.filter(~language.held_out(docs.doc_id)))
    assert len(rows) == docs.count()
    for d in docs.collect():
        r = rows[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred == plain_prediction(model, d.text), d.doc_id
        assert (r.lang_pred == "und") == (r.score == 0)


def predicted(spark, docs, model):
    return {r.doc_id: r.lang_pred for r in language.predict(spark.createDataFrame(docs, "doc_id long, text string, lang string"), model).collect()}


def test_a_very_small_share_still_learns_every_language(spark):
    rows = texts(900)
    for sample in (1e-12, 1e-4, 20):
        model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=sample)
        assert model.langs == sorted(WORDS)
        got = predicted(spark, rows, model)
        assert sum(got[k] == x for k, _, x in rows) > (0.6 if sample < 1 else 0.95) * len(rows)


def test_null_and_repeated_ids_are_sampled_like_others(spark):
    rows = [(None, t, x) for _, t, x in texts(300)] + [(7, t, x) for _, t, x in texts(300, 2)] + [(8, "kalu miro", "aa")] * 3000
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    model = language.learn(table, sample=50)
    got = predicted(spark, texts(200, 3), model)
    assert sum(got[k] == x for k, _, x in texts(200, 3)) >= 195


@pytest.mark.parametrize("languages", [150, 300])
def test_many_languages(spark, monkeypatch, languages):
    monkeypatch.setattr(language, "TABLE", 1 << 20)
    rng = np.random.default_rng(6)
    made = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(languages)]
    rows = [(k, f"{made[k % languages]} {made[k % languages]}", f"l{k % languages:03d}") for k in range(2 * languages)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == languages and model.table.size <= 1 << 20
    got = predicted(spark, rows, model)
    assert sum(got[k] == x for k, _, x in rows) >= 0.95 * len(rows)


def test_equal_languages_and_none(spark):
    twins = [(k, "kalu miro besa", x) for k, x in enumerate(["x", "y"])]
    model = language.learn(spark.createDataFrame(twins, "doc_id long, text string, lang string"))
    assert set(predicted(spark, twins, model).values()) == {"x"}
    none = language.learn(spark.createDataFrame([(1, "kalu", None), (2, None, "x")], "doc_id long, text string, lang string"))
    assert none.langs == [] and set(predicted(spark, twins, none).values()) == {"und"}


def test_decontamination_with_a_null_item(spark):
    bench = spark.createDataFrame([(None, "one two three four"), (None, "five six seven"), (3, "eight nine")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three four y five six seven"), (2, "eight nine"), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontamination.report(docs, bench).collect()}
    assert got == {1: (7, 1, True), 2: (2, 1, True), 3: (0, 0, False)}
    empty = decontamination.report(docs, bench.limit(0)).collect()
    assert [r.contaminated for r in empty] == [False] * 3
