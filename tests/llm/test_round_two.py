"""Wrapped notices, copied values, ties in a mix, recall at the full size of a shard, hard groups of near copies."""

import random
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from vinculum.llm import ngram_join as nj
from vinculum.llm.hnsw import Hnsw
from vinculum.llm.language_id import language_id
from vinculum.llm.license_scans import TEMPLATES, license_scans
from vinculum.llm.mixing import mix_sources
from vinculum.llm.nearest_neighbours import nearest_neighbours
from vinculum.llm.secret_scans import secret_scans


def test_wrapped_and_embedded_notices(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join(f"w{rng.randint(0, 900)}" for _ in range(n))
    body = max((t for n, t in TEMPLATES if n == "MIT"), key=len)
    rows = [
        (1, prose(600) + "\n" + textwrap.fill(body, 72) + "\n" + prose(600)), (2, "Copyright 2020 Some One. All rights reserved. " + prose(30)),
        (3, prose(900)), (4, None), (5, ""), (None, "x\nReleased under the MIT license"), (7, prose(50) + " hereby granted free of " + prose(50)),
    ]
    out = {r["doc_id"]: r for r in license_scans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["best_license"] == "MIT" and out[1]["best_dice"] == 1.0 and out[1]["n_windows"] >= 1
    assert out[2]["licenses"] == "All-Rights-Reserved" and out[None]["licenses"] == "MIT"
    assert [(out[i]["licenses"], out[i]["n_units"]) for i in (4, 5)] == [("", 0), ("", 0)] and out[3]["licenses"] == out[7]["licenses"] == ""


def test_values_copied_within_an_owner_are_examples(spark):
    rows = [(i, "token: zZ9yY8xX7wW6vV5uU4", "a") for i in range(40)] + [(100, "token: qQ1wW2eE3rR4tT5yY6", "a")]
    out = {r["doc_id"]: r for r in secret_scans(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {r["found"][0]["status"] for i, r in out.items() if i < 40} == {"example"}
    assert out[100]["found"][0]["status"] == "live" and "live" in out[100]["spans"]


@pytest.mark.parametrize("tied", [[(None, "a " * 10, "x")] * 300, [(7, "a " * 20, "x")] * 300])
def test_equal_ids_and_sizes_meet_the_target(spark, tied):
    rows = tied + [(i, "b " * len(tied[0][1].split()), "y") for i in range(300)] + [(1, None, "z"), (2, "", None)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    size = len(tied[0][1].split())
    for s in "xy":
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= size / 2
    assert all(r["taken"] <= 3 * r["size"] for r in out) and len(out) == 602


def test_larger_documents_have_larger_odds(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([10, 100]), s) for i, s in enumerate("ab" * 2000)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("source = 'a'").collect()
    share = {n: np.mean([r["copies"] for r in out if r["size"] == n]) for n in (10, 100)}
    assert share[100] > 1.5 * share[10]


def test_recall_at_the_full_size_of_a_shard():
    x = np.random.default_rng(1).normal(size=(20_000, 64)).astype(np.float32)
    q = x[::400].astype(np.float64)
    found, _ = Hnsw.build(x, 24, 128).search(q, 400)
    best = np.argsort(-(q @ x.T.astype(np.float64)), 1)[:, :20]
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) / 20 for a, b in zip(found, best, strict=True)]) >= 0.9


def test_double_vectors_are_scored_as_they_are(spark):
    tiny = 1e-9
    rows = [(0, [1.0, 1.0])] + [(i, [1.0, 1.0 + tiny * i]) for i in range(1, 30)] + [(30, [1.0, 1.0 + tiny * 29])]
    out = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, k=3, least_shards=2).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(i, 1.0 + (1.0 + tiny * n)) for i, n in ((29, 29), (30, 29), (28, 28))]


def components(sets, percent=80):
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_shared_passages_large_groups_and_chains_lose_no_link(spark, monkeypatch):
    """A passage that 400 texts share, 300 near copies (several groups and splits), texts at the threshold, a sliding chain."""
    monkeypatch.setattr(nj, "CHUNK", 16)
    monkeypatch.setattr(nj, "LOAD", 8)
    rng = random.Random(11)
    words = lambda n: [f"v{rng.randint(0, 4000)}" for _ in range(n)]
    passage, base, chain = words(40), words(100), words(160)
    texts = [passage + words(rng.choice([3, 6, 9, 12, 40])) for _ in range(400)]
    for _ in range(300):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            t[rng.randrange(len(t))] = f"x{rng.randint(0, 9999)}"
        texts.append(t[: rng.choice([100, 98, 95])])
    texts += [chain[i : i + 60] for i in range(0, 100, 4)] + [words(rng.randint(1, 8)) for _ in range(60)] + [["a"], ["a"], ["A"], ["a", "b"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block_tokens=5000, shard_tokens=4000).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.lower().split()]}
    root = components(sets)
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}
    assert len(set(root.values())) < len(rows) - 300


def test_the_join_beyond_the_filter_bound(spark):
    rows = [(i, f"one two three four five six {i % 7}") for i in range(40)] + [(None, "one two three four five six 3"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = lambda out: sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in out.collect())
    assert keyed(nj.ngram_join(df)) == keyed(nj.ngram_join(df, filter_bytes=0))


def test_language_of_held_out_documents(spark):
    out = language_id(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out and lang_pred <> 'und' and lang is not null").collect()
    assert len(out) > 100 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
