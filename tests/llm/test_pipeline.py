"""The pipeline's stages and run() against plain programs."""

import hashlib
import random
import zlib

import corpus_pipeline
from vinculum.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rng = random.Random(6)
    prose = lambda: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(80))
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, c), (2, d), (2, c + " tail"), (None, e), (7, e), (4, ""), (4, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    out = corpus_pipeline.dedup_near(spark, docs, "")
    assert out.columns == docs.columns
    want = [(None, a), (None, b), (1, c), (2, d), (7, e), (4, ""), (4, ""), (5, None)]
    assert sorted(repr((r["doc_id"], r["text"])) for r in out.collect()) == sorted(map(repr, want))


def test_language_stage_without_labels_keeps_texts(spark):
    docs = spark.createDataFrame([(1, "some words", None, "s", 0), (2, "12 34", None, "s", 0), (3, None, None, "s", 0)], SCHEMA)
    assert [r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()] == [1]


def lines_gone(rows):
    """Keys of 20 characters in three documents stay in the largest id alone."""
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    held = {}
    for i, text, *_ in rows:
        for line in text.split("\n"):
            held.setdefault(line.strip(strip).translate(low), set()).add(i)
    out = []
    for i, text, *rest in rows:
        keep = [x for x in text.split("\n") if len(k := x.strip(strip).translate(low)) < 20 or len(held[k]) < 3 or i == max(held[k])]
        out.append((i, "\n".join(keep), *rest))
    return out


def least_of_groups(rows):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t, *_ in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return [r for r in rows if root[r[0]] == r[0]]


def mixed(rows, weights=(1, 2, 3), cap=3):
    """Copies of each document: ranked by Pareto odds, cut where the words are nearest the target."""
    size = {r[0]: len(r[1].split()) for r in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    own = {s: [r for r in rows if r[3] == s] for s in sources}
    total = {s: sum(size[r[0]] for r in own[s]) for s in sources}
    weight = {s: weights[k % 3] for k, s in enumerate(sources)}
    capped = set()
    while True:
        left = sum(total.values()) - cap * sum(total[s] for s in capped)
        weigh = sum(weight[s] for s in sources if s not in capped)
        more = {s for s in sources if s not in capped and weight[s] * left > cap * total[s] * weigh}
        if not more:
            break
        capped |= more
    copies = {}
    for s in sources:
        target = float(cap * total[s]) if s in capped else weight[s] * left / weigh
        ratio = target / total[s] if total[s] else 0.0
        whole, p, upto = int(ratio), ratio - int(ratio), 0
        p = min(max(p, 1e-12), 1 - 1e-12)

        def rank(r, p=p, s=s):
            u = (int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            return (u / (1 - u) / (p / (1 - p) * max(size[r[0]], 1) * len(own[s]) / max(total[s], 1)), str(r[0]))

        for r in sorted(own[s], key=rank):
            upto += size[r[0]]
            taken = upto - size[r[0]] / 2 <= target - whole * total[s]
            copies[r[0]] = min(cap, whole + taken) if total[s] else 0
    return copies


def test_run_against_a_plain_program(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    sound = {"aa": "bcdaei", "bb": "xyzouw"}
    word = lambda k: "".join(rng.choice(sound[k]) for _ in range(rng.randint(3, 7)))
    notice = "this very line is repeated in many documents"
    rows = []
    for i in range(90):
        lang = "ab"[i % 2] * 2
        words = [word(lang) for _ in range(rng.randint(30, 120))]
        if i >= 60 and i % 3 == 0:  # a near copy of an earlier text
            words = rows[i - 60][1].replace(notice, "").split()
            words[rng.randrange(len(words))] = word(lang)
            lang = rows[i - 60][2]
        rows.append((i, " ".join(words) + (f"\n{notice}" if i % 4 == 0 else ""), lang, rng.choice(["s1", "s2", "s3", None]), 0))
    rows += [(200, "12 34 !!", "aa", "s1", 0), (201, "", "aa", "s1", 0)]
    path = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    got = corpus_pipeline.run(spark, path).collect()

    copies = mixed(least_of_groups(lines_gone([r for r in rows if r[0] < 200])))
    texts = {r[0]: r[1] for r in lines_gone([r for r in rows if r[0] < 200])}
    t = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, n in copies.items():
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 1]
        want += [(i, 0, 0, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))] * n
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) == -(-sum(r["length"] for r in got) // 4096)
