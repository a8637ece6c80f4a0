"""Secret scans weighed by corpus-wide ownership; DataFrame functions only.

Candidates are found by pattern in every text.  The hash of each candidate value is then
counted over the corpus by distinct repositories and distinct owners: a value that several
owners hold, or that one owner has copied to many repositories, is a copied example; one that
a single owner holds in few places and that looks random is a live-looking credential.  Live values add a span of kind ``live`` to those of the patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum.llm.common import isolate, materialize

#: The patterns of the base kinds, in their order, with the group and the
#: least length that a match must have.  Classes instead of flags keep case rules plain.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
    r"[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
KINDS = {"assign": (ASSIGN, 2, 12), "access": (r"AKIA[A-Z0-9]{14,}", 0, 18), "hex": (r"[0-9a-f]{16,}", 0, 16)}
#: What only the method looks for: long tokens that mix cases and digits.
MIXED = r"[A-Za-z0-9+/_-]{24,}"


def _mixes(v: Column) -> Column:
    """Whether a value looks random: digits and letters, and at least eight different characters."""
    return v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= 8)


def _spans(text: Column, kind: str, pattern: str, group: int, least: int, value_only: bool = False) -> Column:
    """Matches as structs (start, rank, finish, kind, value): places are summed from the pieces between matches."""
    quoted = F.lit(pattern)
    found = F.regexp_extract_all(text, quoted, F.lit(0))
    between = F.split(text, pattern, -1)
    rank = list(KINDS).index(kind) if kind in KINDS else len(KINDS)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,finish:int,kind:string,value:string>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        match = F.get(found_col, i)
        value = F.regexp_extract(match, pattern, group)
        start = acc["at"] + F.char_length(F.get(between_col, i))
        finish = start + F.char_length(match)
        from_ = finish - F.char_length(value) if value_only else start
        one = F.struct(
            from_.alias("start"), F.lit(rank).alias("rank"), finish.alias("finish"), F.lit(kind).alias("kind"), value.alias("value")
        )
        ok = F.char_length(value) >= least
        if kind == "mixed":
            ok = ok & value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")
        return F.struct(finish.alias("at"), F.when(ok, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    # both arrays pass through a one-element transform, so that they are computed once a row
    pair = F.array(F.struct(found.alias("f"), between.alias("b")))
    found_col = between_col = None

    def of(p: Column) -> Column:
        nonlocal found_col, between_col
        found_col, between_col = p["f"], p["b"]
        return F.aggregate(F.sequence(F.lit(0), F.size(p["f"]) - 1), zero, step)["out"]

    none = F.array().cast("array<struct<start:int,rank:int,finish:int,kind:string,value:string>>")
    return F.when(text.rlike(pattern), F.get(F.transform(pair, of), F.lit(0))).otherwise(none)


def _count(structs: str, field: str, value: str) -> Column:
    return F.size(F.filter(structs, lambda s: s[field] == value)).cast("long")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["finish"])), ",")


def secret_scans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    max_owners: int = 1,
    max_repositories: int = 5,
) -> DataFrame:
    """Spans of secrets in each text, with the corpus-wide frequency of what they hold.

    A repository is a document id within its owner.  Returns the id and owner columns,
    n_assign, n_access, n_hex (long), base_spans and spans (``kind:start:end`` by start and
    kind, comma-joined, in code points, end exclusive), and found: an array of structs
    (kind, start, finish, value_sha256, n_repositories, n_owners, status), where status is
    ``example`` (more than ``max_owners`` owners or ``max_repositories`` repositories), ``live``
    or ``plain``.

    Null and empty texts hold nothing.  Each row is scanned by itself; rows with equal id and
    owner are one repository; a null owner is an owner, a null id a repository.  Extra columns
    are ignored.  An empty table gives no row.
    """
    frame, (doc, text, owner), _ = isolate(docs, id_col, text_col, owner_col)
    value = F.coalesce(F.col("text"), F.lit(""))
    scanned = frame.select(F.col(doc).alias("doc"), F.col(owner).alias("owner"), F.col(text).alias("text"))
    base = F.concat(*[_spans(value, k, *v) for k, v in KINDS.items()])
    more = _spans(value, "mixed", MIXED, 0, 24)
    scanned = materialize(
        scanned.select(
            F.monotonically_increasing_id().alias("row"), "doc", "owner",
            F.array_sort(F.transform(base, lambda s: F.struct(s["start"], s["rank"], s["finish"], s["kind"], F.sha2(s["value"], 256).alias("hash"), _mixes(s["value"]).alias("mixes"), F.char_length(s["value"]).alias("size")))).alias("base"),
            F.transform(more, lambda s: F.struct(s["start"], s["rank"], s["finish"], s["kind"], F.sha2(s["value"], 256).alias("hash"), _mixes(s["value"]).alias("mixes"), F.char_length(s["value"]).alias("size"))).alias("more"),
        )
    )
    found = scanned.select("row", "doc", "owner", F.explode(F.concat("base", "more")).alias("s")).select(
        "row", "doc", "owner", F.col("s.*")
    )
    known = F.struct(F.coalesce(F.col("owner").cast("string"), F.lit("")), F.col("owner").isNull())
    repository = F.struct(F.coalesce(F.col("doc").cast("string"), F.lit("")), F.col("doc").isNull())
    by_owner = found.groupBy("hash", known.alias("holder")).agg(F.count_distinct(repository).alias("repos"))
    frequency = materialize(
        by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repositories"), F.count("*").alias("n_owners")).withColumnRenamed("hash", "key")
    )
    status = F.when((F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories), "example").when(F.col("mixes"), "live").otherwise("plain")
    weighed = found.join(frequency, F.col("hash") == F.col("key")).withColumn("status", status)
    gathered = weighed.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "finish", "kind", F.col("hash").alias("value_sha256"), "n_repositories", "n_owners", "status", "size"))).alias("all")
    ).withColumnRenamed("row", "_row")
    out = scanned.join(gathered, F.col("row") == F.col("_row"), "left")
    # a live span covers the value alone; the same place is told once
    live = F.array_distinct(
        F.transform(
            F.filter("all", lambda s: s["status"] == "live"),
            lambda s: F.struct((s["finish"] - s["size"]).alias("start"), F.lit(len(KINDS)).alias("rank"), s["finish"].alias("finish"), F.lit("live").alias("kind")),
        )
    )
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["finish"].alias("finish"), s["kind"].alias("kind")))
    spans = F.when(F.col("all").isNull(), plain).otherwise(F.array_sort(F.concat(plain, live)))
    kinds = {f"n_{k}": _count("base", "kind", k) for k in KINDS}
    return out.select(
        F.col("doc").alias(id_col), F.col("owner").alias(owner_col), *[c.alias(n) for n, c in kinds.items()],
        _joined(F.col("base")).alias("base_spans"), _joined(spans).alias("spans"),
        F.coalesce("all", F.array().cast(gathered.schema["all"].dataType)).alias("found"),
    )
