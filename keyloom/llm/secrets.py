"""Secret scan with corpus-wide ownership frequency (native: DataFrame functions only).

Three base kinds are found by patterns. The method then looks at further candidates, tokens of 24 or more characters
with digits and both cases: their hashes (and those of the base matches) are counted over the whole corpus by distinct
repositories and distinct owners. A value that more than ``copied`` owners have, or more than ``spread`` repositories, is a widely copied
example; any other is owner-specific and live-looking, and such candidates are added as spans of kind ``owned``. Base spans always stay.

Repository and owner are expressions over the row; by default both come from ``source`` (repository: source and language).
Counting first reduces each value to distinct owners in every task, and the verdicts of the commonest values go to every task, so a
value that a third of all rows hold stays cheap.

Edge cases: null text is empty and has no spans; null source is an owner of its own; a document given twice counts its
owner once; candidates that overlap a base span are left to it; offsets are in code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, let, materialize, text_of

#: The base patterns, and the shortest match of each that counts.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH = 12
#: Stands for characters of base spans when candidates are looked for; a private-use character that texts don't use.
MARK = "\ue000"
CANDIDATE = rf"(?<![A-Za-z0-9+/_{MARK}-])(?=[A-Za-z0-9+/_{MARK}-]*[0-9])(?=[A-Za-z0-9+/_{MARK}-]*[a-z])(?=[A-Za-z0-9+/_{MARK}-]*[A-Z])[A-Za-z0-9+/_{MARK}-]{{24,}}"
KINDS = ("assign", "access", "hex", "owned")


def _pieces(t: Column, pattern: str) -> Column:
    """The text as array<struct<g, m>>: each match m and the gap g before it; last the gap after all, with a null match."""
    return F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))


def _places(pieces: Column) -> Column:
    """array<struct<s, e, m>> of the matches. Places are summed up within runs of about as many pieces as there are runs, then over
    the runs, so the work grows with the matches times the root of their number, not with their square."""
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")
    length = lambda p: F.length(p["g"]) + F.coalesce(F.length(p["m"]), F.lit(0))

    def step(a: Column, p: Column) -> Column:
        s = a["at"] + F.length(p["g"])
        return F.struct((a["at"] + length(p)).alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), (a["at"] + length(p)).alias("e"), p["m"].alias("m")))).alias("out"))

    def run(x: Column) -> Column:
        begin = F.struct(x["at"].alias("at"), empty.alias("out"))
        return F.aggregate(x["ps"], begin, step, lambda a: a["out"])

    def begins(runs: Column) -> Column:
        """The place where each run starts."""
        sizes = F.transform(runs, lambda ps: F.aggregate(ps, F.lit(0), lambda a, p: a + length(p)))
        return F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def whole(ps: Column) -> Column:
        each = F.greatest(F.ceil(F.sqrt(F.size(ps))).cast("int"), F.lit(1))
        runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(ps) / each).cast("int") - 1), lambda i: F.slice(ps, i * each + 1, each))
        joined = lambda rs: F.transform(F.filter(F.arrays_zip(rs.alias("ps"), begins(rs).alias("at")), lambda x: x["ps"].isNotNull()), run)
        return F.filter(F.flatten(let(runs, joined)), lambda x: x["m"].isNotNull())

    return let(pieces, lambda ps: F.when(F.size(ps) < 2, empty).otherwise(whole(ps)))


def _matches(t: Column, pattern: str) -> Column:
    """All leftmost matches as array<struct<s, e, m>>."""
    return F.when(t.rlike(pattern), _places(_pieces(t, pattern))).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def _marked(t: Column, pattern: str, counts: Callable[[Column], Column]) -> Column:
    """``t`` with MARK instead of each character of the matches that count."""
    shown = lambda p: F.concat(p["g"], F.when(p["m"].isNull(), "").when(counts(p["m"]), F.repeat(F.lit(MARK), F.length(p["m"]))).otherwise(p["m"]))
    return let(t, lambda x: F.when(x.rlike(pattern), F.array_join(F.transform(_pieces(x, pattern), shown), "")).otherwise(x))


def _kind(spans: Column, order: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.xxhash64(F.regexp_extract(x["m"], ASSIGN, 2) if order == 0 else x["m"]).alias("h")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.sort_array(spans), lambda x: F.concat(F.element_at(names, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))))


def scan_spans(docs: DataFrame, repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """Narrow: per row ``base`` and ``cand`` arrays of (s, k, e, h), with repository and owner hashes."""
    t = text_of()
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if owner is None or repo is None else None
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if repo is None else None
    long = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LENGTH
    assign = F.filter(_matches(t, ASSIGN), lambda x: long(x["m"]))
    # Candidates that overlap a base span hold a mark; the places of all others stay.
    marked = _marked(_marked(_marked(t, ASSIGN, long), ACCESS, lambda m: F.lit(True)), HEX, lambda m: F.lit(True))
    cand = F.filter(let(marked, lambda x: _matches(x, CANDIDATE)), lambda x: ~F.contains(x["m"], F.lit(MARK)))
    return docs.select(
        "doc_id", F.xxhash64(source if owner is None else owner).alias("__owner"), F.xxhash64(F.concat_ws("\n", source, lang) if repo is None else repo).alias("__repo"),
        F.concat(_kind(assign, 0), _kind(_matches(t, ACCESS), 1), _kind(_matches(t, HEX), 2)).alias("base"), _kind(cand, 3).alias("cand"),
    )


def ownership(spans: DataFrame) -> DataFrame:
    """(h, n_owners, n_repos, times) over the whole corpus: places by owner and repository first, then counts."""
    each = spans.select("__owner", "__repo", F.explode(F.transform(F.concat("base", "cand"), lambda x: x["h"])).alias("h"))
    per_repo = each.groupBy("h", "__owner", "__repo").agg(F.count(F.lit(1)).alias("t"))
    per_owner = per_repo.groupBy("h", "__owner").agg(F.count(F.lit(1)).alias("r"), F.sum("t").alias("t"))
    return per_owner.groupBy("h").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repos"), F.sum("t").alias("times"))


def find_secrets(docs: DataFrame, copied: int = 2, spread: int = 4, repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """One row per document: base counts and digest, all spans, and how many are owner-specific (``n_live``) or copied (``n_copied``):
    found with more than ``copied`` owners or in more than ``spread`` repositories."""
    spans = materialize(scan_spans(docs, repo, owner).withColumn("__uid", F.monotonically_increasing_id()), "secret-spans")
    live = (F.col("n_owners") <= copied) & (F.col("n_repos") <= spread)
    counts = materialize(ownership(spans).select("h", live.alias("live"), "times"), "ownership")
    each = spans.select("__uid", F.explode(F.concat("base", "cand")).alias("x")).withColumn("h", F.col("x.h"))
    judged = join_hot(each, counts, "h", "times")
    per_row = judged.groupBy("__uid").agg(
        F.collect_list(F.when(F.col("live") & (F.col("x.k") == 3), F.col("x"))).alias("__owned"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied")
    )
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    none = F.array().cast("array<struct<s:int,k:int,e:int,h:bigint>>")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return spans.join(per_row, "__uid", "left").select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", F.coalesce(F.col("__owned"), none))).alias("spans"), zero("n_live"), zero("n_copied"),
    )
