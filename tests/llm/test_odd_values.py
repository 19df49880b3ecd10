"""What odd rows give, by brute force, and that unions of dealt tables don't change results."""

import array
import hashlib
import itertools
import math
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lenswork.llm import fingerprints, language, lm_scoring, near_duplicates, packing, substrings, token_output
from tests.llm.test_llm import OPERATORS, docs_of


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark)


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_repeats_of_odd_rows(docs, texts):
    split = [(i, (t or "").encode().split()) for i, t in texts]
    seen = Counter(tuple(w[p : p + 35]) for _, w in split for p in range(len(w) - 34))
    wanted = []
    for i, w in split:
        gone = {q for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for q in range(p, p + 35)}
        kept = b" ".join(x for q, x in enumerate(w) if q not in gone)
        wanted.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    assert Counter(map(tuple, substrings.remove_repeats(docs).collect())) == Counter(wanted)


def test_scores_of_odd_rows(docs, texts):
    split = [(i, (t or "").lower().split()) for i, t in texts]
    one = Counter(w for _, x in split for w in x)
    two = Counter(p for _, x in split for p in itertools.pairwise(x))
    total = sum(one.values())

    def score(x):
        back = lambda w: math.log(lm_scoring.BACKOFF) + math.log(one[w] / total)
        rest = (math.log(two[v, w] / one[v]) if two[v, w] >= lm_scoring.LEAST_COUNT else back(w) for v, w in itertools.pairwise(x))
        return sum(rest, back(x[0])) if x else 0.0

    wanted = Counter((i, len(x), round(score(x), 3)) for i, x in split)
    assert Counter((r.doc_id, r.n_words, round(r.score, 3)) for r in lm_scoring.score_documents(docs).collect()) == wanted


def test_tokens_of_odd_rows(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    ids = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in texts]
    got = sorted(token_output.read_token_files(token_output.write_token_files(docs, path, 0)).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(array.array("I", x).tobytes())) for i, x in ids)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)


def test_pieces_of_odd_rows(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    wanted = Counter()
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        wanted.update((i, k, at, len(ids[at : at + 4096]), zlib.crc32(array.array("I", ids[at : at + 4096]).tobytes())) for k, at in enumerate(range(0, len(ids), 4096)))
    assert Counter(tuple(r)[:5] for r in packing.pack_documents(docs, path).collect()) == wanted


def test_components_of_odd_rows(docs, texts):
    fps = [near_duplicates.fingerprint(t, 3) % (1 << 64) if (t or "").split() else 0 for _, t in texts]
    group = list(range(len(fps)))
    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2 and group[a] != group[b]:
            group = [group[a] if g == group[b] else g for g in group]
    least = {g: min((i for (i, _), h in zip(texts, group) if h == g and i is not None), default=None) for g in group}
    wanted = Counter((i, f, least[g]) for (i, _), f, g in zip(texts, fps, group))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in near_duplicates.fingerprint_components(docs).collect()) == wanted


def test_fingerprints_of_odd_rows(docs, texts):
    got = fingerprints.fingerprint_documents(docs).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in texts)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in of.values()) and of[6] == of[7] and of[0] == of[1] == {"0" * 16}


def test_languages_of_odd_rows(docs, texts):
    got = language.predict(docs, language.learn(docs)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts)
    assert {(r.doc_id, r.lang_pred) for r in got if r.doc_id in (0, 1, 2)} == {(i, "und") for i in (0, 1, 2)}
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "und") for r in got)


def rows_of(name, df):
    rows = df.collect()
    if name == "packing":  # which sequence a piece is in is free
        return Counter(tuple(r)[:5] for r in rows)
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", ["components", "groups", "fingerprints", "packing"])
def test_unions_of_dealt_tables(spark, sf, name):
    """Spark may keep the partitioning of a union's parts; the rows are the same with and without."""
    setting = "spark.sql.unionOutputPartitioning"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = spark.conf.get(setting)
    try:
        found = []
        for value in ("true", "false"):
            spark.conf.set(setting, value)
            found.append(rows_of(name, OPERATORS[name](docs)))
    finally:
        spark.conf.set(setting, before)
    assert found[0] == found[1] and found[0].total() >= docs.count()
