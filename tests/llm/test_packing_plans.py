"""Plans where more than four documents share a sequence, and ids of texts with added tokens."""

import random
import zlib

from vinculum.llm.best_fit_packing import best_fit, best_fit_packing, lower_bound, plan_packing
from vinculum.llm.queries import tokenizer_path


def histogram(lengths):
    counts = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    return counts


def check(counts, plan, capacity):
    used = {}
    for filling, times in plan:
        assert sum(n * u for n, u in filling) <= capacity
        for n, u in filling:
            used[n] = used.get(n, 0) + u * times
    assert used == counts


def test_five_documents_a_sequence():
    rng = random.Random(7)
    counts = histogram(rng.randint(601, 1000) for _ in range(20_000))
    plan = plan_packing(dict(counts), 4096)
    check(counts, plan, 4096)
    n, plain = sum(t for _, t in plan), sum(t for _, t in best_fit(counts, 4096))
    assert n <= 1.02 * lower_bound(counts, 4096) and n < 0.97 * plain


def test_known_optimum_of_middling_lengths():
    rng = random.Random(3)
    cut = []
    for _ in range(500):
        five = [rng.randint(700, 900) for _ in range(4)]
        cut += [*five, 4096 - sum(five)]
    counts = histogram(cut)
    plan = plan_packing(dict(counts), 4096)
    check(counts, plan, 4096)
    assert sum(t for _, t in plan) <= 505


def test_added_tokens_have_the_ids_of_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = ["hello <|endoftext|>", "<|startoftext|>a, b.<|endoftext|>c <|endoftext|> d", "<|ENDOFTEXT|> x", "e<|endoftext|>\u0338", "plain, text. <|end", "<|endoftext|>\u00e9\u0301 f\u0301"]
    rows = best_fit_packing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_path()).collect()
    for r in rows:
        ids = [*t.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1]
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
    assert t.encode(texts[0], add_special_tokens=False).ids[-1] == 49407
