"""Quality rules judged by host: rule failures per domain, shrunk by an empirical beta prior.

1. Each document is measured once, and its rules are tested (one pass over the texts).
2. Failures are summed by host (partial sums before the shuffle, so a hot host is cheap).
   Over the hosts, a beta prior is fitted to the failure rates by moments; a host's rate is
   its posterior mean, so that small hosts lean towards the corpus.
3. The host's verdict is joined back: a *condemned* host loses all documents, a *trusted*
   host only those that break two rules, any other host those that break one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.llm.common import byte_rows, isolate, materialize

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACES = np.zeros(256, bool)
_SPACES[list(b" \t\n\x0b\x0c\r")] = True
_CLASS = _SYMBOLS.astype(np.uint8) + 2 * _SPACES.astype(np.uint8)
_CLASS[0x80:0xC0] = 4  # continuation bytes
_CLASS[65:91], _CLASS[97:123], _CLASS[33] = 8, 16, 32

#: What is measured of a text, in order.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs"]
#: The rules a document can break, as SQL over the measures; all are ratios of whole numbers.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "capitals": "n_letters > 0 AND 2 * n_upper > n_letters",
    "marks": "5 * n_bangs > n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
}


def repeated(words: list[bytes]) -> int:
    """Words inside a 3-word window that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    size = len(ids)
    if size == n:
        return 0
    pair = code[:-1] * size + code[1:]
    if size >= 1 << 20:  # keep the product below 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
        size = int(code.max()) + 1
    window = pair[:-1] * size + code[2:]
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    at = np.concatenate((order[1:][same], order[:-1][same]))
    for k in range(3):
        twice[at + k] = True
    return int(twice.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The :data:`MEASURES` of a text."""
    words = text.split()
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=33)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        len(words), len(text) - int(kinds[2]) - int(kinds[4]), int(kinds[1]), len(lines) - len(set(lines)), repeated(words),
        len(lines), int(kinds[8]), int(kinds[8] + kinds[16]), int(kinds[32]),
    )


def _measured(batches):
    for batch in batches:
        for at, texts in byte_rows(batch, 2):
            got = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(MEASURES))
            kept = batch.slice(at, len(texts))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), *(pa.array(got[:, i]) for i in range(got.shape[1]))], ["doc", "host", *MEASURES]
            )


def host_verdicts(tested: DataFrame, condemn: float = 0.5, trust: float = 0.02) -> DataFrame:
    """host, n_docs, n_failed, prior_a, prior_b, rate, verdict; a null host is a host of its own.

    The prior's mean m and variance v are those of the hosts' raw rates; its weight
    a + b = m(1 - m)/v - 1 is held between 1 and 1e6 (one host or equal rates: v = 0).
    """
    hosts = tested.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum((F.col("n_broken") > 0).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    spread = F.col("m") * (1 - F.col("m"))
    weight = F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), spread / F.col("v") - 1))).otherwise(1e6)
    prior = prior.select((F.col("m") * weight).alias("prior_a"), ((1 - F.col("m")) * weight).alias("prior_b"))
    posterior = (F.col("n_failed") + F.col("prior_a")) / (F.col("n_docs") + F.col("prior_a") + F.col("prior_b"))
    judged = hosts.crossJoin(F.broadcast(prior)).withColumn("rate", posterior)  # the prior is one row
    verdict = F.when(F.col("rate") > condemn, "condemned").when(F.col("rate") < trust, "trusted").otherwise("mixed")
    return judged.withColumn("verdict", verdict)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    condemn: float = 0.5,
    trust: float = 0.02,
) -> DataFrame:
    """Measures, rules and verdict of each document.

    Returns the id and host columns, :data:`MEASURES`, a boolean per rule (``broke_<rule>``),
    n_broken, host_rate, host_verdict, base_failed and kept.

    Null and empty texts have no words and break the base rule.  Each row is a document of
    its own, repeated ids included.  A null host is one more host.  Extra columns are
    ignored.  An empty table gives no row.
    """
    frame, (doc, text, host), _ = isolate(docs, id_col, text_col, host_col)
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    schema = f"doc {kinds[doc]}, host {kinds[host]}, " + ", ".join(f"{m} long" for m in MEASURES)
    measured = frame.select(doc, host, text).mapInArrow(_measured, schema)
    tested = measured.withColumns({f"broke_{k}": F.expr(v) for k, v in RULES.items()})
    tested = materialize(tested.withColumn("n_broken", sum((F.col(f"broke_{k}").cast("int") for k in RULES), F.lit(0))))
    hosts = materialize(host_verdicts(tested, condemn, trust).select(F.col("host").alias("_host"), "rate", "verdict"))
    judged = tested.join(hosts, F.col("host").eqNullSafe(F.col("_host")))
    bound = F.when(F.col("verdict") == "condemned", -1).when(F.col("verdict") == "trusted", 1).otherwise(0)
    return judged.select(
        F.col("doc").alias(id_col), F.col("host").alias(host_col), *MEASURES, *[f"broke_{k}" for k in RULES], "n_broken",
        F.col("rate").alias("host_rate"), F.col("verdict").alias("host_verdict"), F.col("broke_base").alias("base_failed"),
        (~F.col("broke_base") & (F.col("n_broken") <= bound)).alias("kept"),
    )
