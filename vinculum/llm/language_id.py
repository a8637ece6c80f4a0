"""Language identification by hierarchical discrimination.

Texts become hashed byte-trigram profiles.  A one-versus-rest linear support vector machine
per family chooses the family; one-versus-one machines between the languages of that family
choose the language.  Families are learned: the languages' mean profiles are merged, closest
first, until as many families are left as the square root of the number of languages.

The machines are fitted at the driver on a bounded sample of the labelled rows
(``sample_rows``, chosen by a hash of the id, spread evenly over the languages); profiles are
computed over whole texts everywhere.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.llm.common import byte_rows, isolate, lean, restore

DIMS = 4096
_FOLD = np.full(256, 32, np.uint32)  # what is not a letter separates words
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or not text.isascii() and any(c.isalpha() for c in text.decode())


def profile(text: bytes) -> np.ndarray:
    """Square roots of trigram counts, of length 1 (0 for no trigram)."""
    low = text.lower() if text.isascii() else text.decode().lower().encode()
    b = _FOLD[np.frombuffer(b" " + low + b" ", np.uint8)]
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
    code = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
    out = np.sqrt(np.bincount(code, minlength=DIMS).astype(np.float32))
    norm = float(np.sqrt((out * out).sum()))
    return out / norm if norm else out


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 20) -> np.ndarray:
    """A linear machine with squared hinge loss by dual coordinate descent; the last weight is the bias."""
    x = np.concatenate((x, np.ones((len(x), 1), np.float32)), 1)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square = (x * x).sum(1) + 0.5 / cost
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - slope / square[i])
            if new != alpha[i]:
                most = max(most, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if most < 1e-3:
            break
    return w


class Model:
    """families: lists of languages; weights: a column per family, then per pair within one."""

    def __init__(self, families: list[list[str]], pairs: list[tuple[str, str]], weights: np.ndarray):
        self.families, self.pairs, self.weights = families, pairs, weights

    @staticmethod
    def fit(x: np.ndarray, lang: list[str]) -> Model:
        names = sorted(set(lang))
        label = np.array(lang)
        families = [[n] for n in names]
        mean = {n: x[label == n].mean(0) for n in names}

        def close(a: list[str], b: list[str]) -> float:
            one, two = (np.mean([mean[n] for n in f], 0) for f in (a, b))
            return float(one @ two / max(1e-12, np.linalg.norm(one) * np.linalg.norm(two)))

        while len(families) > max(1, round(len(names) ** 0.5)):
            i, j = max(combinations(range(len(families)), 2), key=lambda ij: close(families[ij[0]], families[ij[1]]))
            families[i] += families.pop(j)
        columns = []
        if len(families) > 1:
            for f in families:
                columns.append(train_svm(x, np.where(np.isin(label, f), 1.0, -1.0)))
        pairs = [p for f in families for p in combinations(f, 2)]
        for a, b in pairs:
            both = np.isin(label, (a, b))
            columns.append(train_svm(x[both], np.where(label[both] == a, 1.0, -1.0)))
        weights = np.array(columns, np.float32).reshape(len(columns), x.shape[1] + 1).T
        return Model(families, pairs, weights)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margin = x @ self.weights[:-1] + self.weights[-1]
        sure = 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))
        n = len(self.families) if len(self.families) > 1 else 0
        family = margin[:, :n].argmax(1) if n else np.zeros(len(x), np.int64)
        score = sure[np.arange(len(x)), family].astype(np.float64) if n else np.ones(len(x))
        lang = np.empty(len(x), object)
        for k, names in enumerate(self.families):
            mine = np.flatnonzero(family == k)
            votes = np.zeros((len(mine), len(names)))
            for at, (a, b) in enumerate(self.pairs, n):
                if a in names:
                    votes[:, names.index(a)] += sure[mine, at]
                    votes[:, names.index(b)] += 1 - sure[mine, at]
            best = votes.argmax(1)
            lang[mine] = [names[i] for i in best]
            if len(names) > 1:
                score[mine] *= votes[np.arange(len(mine)), best] / (len(names) - 1)
        return lang.tolist(), np.clip(score, 0, 1)


@lean
def _profiles(batches):
    for batch in batches:
        for at, texts in byte_rows(batch, 1):
            data = [profile(t).astype(np.float16).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(data, pa.binary())], ["lang", "x"])


def _predicted(model, text_at: int):
    def run(batches):
        fitted = Model(*model.value) if model.value is not None else None
        for batch in batches:
            langs, scores = [], []
            for _, texts in byte_rows(batch, text_at):
                known = [fitted is not None and has_letter(t) for t in texts]
                if any(known):
                    x = np.stack([profile(t) for t, ok in zip(texts, known, strict=True) if ok])
                    got = iter(zip(*fitted.predict(x), strict=True))
                for ok in known:
                    lang, score = next(got) if ok else ("und", 0.0)
                    langs.append(lang)
                    scores.append(float(score))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "_lang", "_score"])

    return lean(run)


def language_id(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = 3000,
    folds: int = 5,
    held_fold: int = 0,
) -> DataFrame:
    """Predict the language of each whole text.

    Returns all columns and held_out (crc32 of the id as text, modulo ``folds``, is
    ``held_fold``), lang_pred and score (0 to 1), which replace columns so named.  Only rows
    that are not held out, with a text that has a letter and a non-null ``lang_col``, are
    learned from; a prediction sees the text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if
    nothing could be learned (the result's ``_learned`` tells).  A null id counts as ''.  Repeated rows are predicted alike.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    frame, (doc, text, lang), pairs = isolate(docs, id_col, text_col, lang_col)
    held = F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")) % folds == held_fold
    labelled = frame.filter(~held & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r["l"]: r["n"] for r in labelled.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()}
    model = None  # plain values, as executors need not know this module
    if counts:
        each = max(20, sample_rows // len(counts))
        chance = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, each / n))])
        draw = F.pmod(F.xxhash64(F.lit(11), doc), F.lit(1 << 30)) / float(1 << 30)
        rows = labelled.filter(draw < chance[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text))
        sample = sorted((r["lang"], bytes(r["x"])) for r in rows.mapInArrow(_profiles, "lang string, x binary").collect())
        if sample:
            x = np.stack([np.frombuffer(b, np.float16) for _, b in sample]).astype(np.float32)
            fitted = Model.fit(x, [n for n, _ in sample])
            model = (fitted.families, fitted.pairs, fitted.weights)
    names = [c for c, _ in pairs]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema)
    out = frame.mapInArrow(_predicted(spark.sparkContext.broadcast(model), names.index(text)), f"{kinds}, _lang string, _score double")
    out = restore(out.withColumn("_held", held), pairs, {"held_out": "_held", "lang_pred": "_lang", "score": "_score"})
    out._learned = model is not None
    return out
