"""Quality rules whose cutoffs carry a statistical guarantee (native: DataFrame functions only).

Each rule scores a document; documents above the rule's cutoff are rejected. Cutoffs come from a labelled
holdout: for every stratum (language), rule and cutoff of a fixed grid, the exact binomial test
``P(Bin(n, alpha) <= k)`` says whether at most ``alpha`` of the good documents are rejected, k of n having been.
The error ``delta`` is divided by the number of all tests (Bonferroni) and ``alpha`` by the number of rules, so with
probability ``1 - delta`` no stratum loses more than ``alpha`` of its good documents that pass the base rules (which are fixed and
reject what they reject). Among the cutoffs that hold,
the one that rejects most bad documents is taken; a rule for which none holds, or that rejects nothing bad, is off.

Edge cases: null text is empty (0 words, base_failed, not kept); null language is a stratum of its own; labels of
unknown documents count nowhere; a document labelled twice counts twice; without labels no rule is on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, maybe_broadcast, packed, text_of, unpacked

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Cutoffs tried for each rule; a document is rejected if its score is above the cutoff.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (0.01, 0.02, 0.05, 0.1, 0.2, 0.4),
    "dup_line_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25),
    "long_words": (7.0, 8.0, 9.0, 10.0, 12.0, 15.0),
    "short_words": (-5.0, -4.5, -4.0, -3.5, -3.0, -2.0),
    "upper_share": (0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
}


@dataclass(frozen=True)
class Risk:
    """At most ``alpha`` of the good documents of a stratum are lost, with probability ``1 - delta``."""

    alpha: float = 0.05
    delta: float = 0.05


def _repeats(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur at least twice in the text."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        starts = F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
        gaps = lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return let(starts, lambda p: F.aggregate(gaps(p), F.lit(0), lambda a, x: a + x))

    def count(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(pairs, covered))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(hashes, count))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``__q`` of counts."""
    t = text_of(text)
    has_word = r"[^\x20\x09-\x0D]"
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(has_word))
    words = F.filter(F.split(t, SPACES, -1), lambda x: x != "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.concat_ws("", w)).cast("long").alias("word_chars"), _repeats(w).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long")
    upper = F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long")
    return docs.withColumn("__q", F.struct(of_words.alias("w"), of_lines.alias("l"), symbols.alias("n_symbols"), upper.alias("n_upper")))


def scores() -> dict[str, Column]:
    q = F.col("__q")
    words, chars = F.greatest(q["w"]["n_words"], F.lit(1)), F.greatest(q["w"]["word_chars"], F.lit(1))
    length = q["w"]["word_chars"] / words
    return {
        "symbols_per_word": q["n_symbols"] / words,
        "dup_line_share": q["l"]["n_dup_lines"] / F.greatest(q["l"]["n_lines"], F.lit(1)),
        "repeat_share": q["w"]["n_repeat_words"] / words,
        "long_words": length,
        "short_words": -length,
        "upper_share": q["n_upper"] / chars,
    }


def base_failed() -> Column:
    w = F.col("__q")["w"]
    return (w["n_words"] < 20) | (100 * w["n_repeat_words"] > 30 * w["n_words"])


def _ln_factorial(x: Column) -> Column:
    """Stirling's series, whose error is below 1e-12 from 20 on; exact below."""
    big = F.greatest(x, F.lit(20.0))
    series = big * F.log(big) - big + 0.5 * F.log(2 * F.pi() * big) + 1 / (12 * big) - 1 / (360 * big * big * big) + 1 / (1260 * F.pow(big, F.lit(5.0)))
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20.0)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float, terms: int = 5000) -> Column:
    """P(Bin(n, p) <= k) for k < p * n, else 1: summed downwards from k; what lies beyond ``terms`` terms is bounded by a
    geometric series, so the value is exact up to rounding or slightly too large, never too small."""
    x, m = k.cast("double"), n.cast("double")
    top = F.exp(_ln_factorial(m) - _ln_factorial(x) - _ln_factorial(m - x) + x * math.log(p) + (m - x) * math.log(1 - p))
    step = lambda j: (x - j) * (1 - p) / ((m - x + j + 1) * p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    summed = F.aggregate(
        F.sequence(F.lit(0), F.least(k, F.lit(terms)).cast("int")),
        start,
        lambda a, j: F.struct((a["term"] * F.greatest(step(j), F.lit(0.0))).alias("term"), (a["total"] + a["term"] * F.greatest(step(j), F.lit(0.0))).alias("total")),
        lambda a: a["total"] + F.when(k > terms, a["term"] / (1 - step(F.lit(0)))).otherwise(F.lit(0.0)),
    )
    return F.when(x >= m * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * summed))


def fit_cutoffs(featured: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(stratum, cutoffs map<rule, cutoff>) for strata with at least one rule that holds.

    ``featured`` has ``__q``. One row per stratum: the table has as many rows as there are strata.
    """
    lab = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__good")).where("__id is not null and __good is not null")
    s = scores()
    rows = featured.where(~base_failed()).select(F.col(doc_id).alias("__id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("__s"), *[v.alias(f"__v_{r}") for r, v in s.items()])
    hit = lambda good, r, c: F.count_if((F.col("__good") == good) & (F.col(f"__v_{r}") > c))
    grid = [(r, c, f"{r}_{i}") for r, cs in GRIDS.items() for i, c in enumerate(cs)]
    counts = rows.join(lab, "__id").groupBy("__s").agg(
        F.count_if(F.col("__good") == 1).alias("n"), *[hit(1, r, c).alias(f"k_{x}") for r, c, x in grid], *[hit(0, r, c).alias(f"b_{x}") for r, c, x in grid]
    )
    counts = materialize(counts, "strata")
    tests = counts.count() * len(grid)
    cell = lambda r, c, x: F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"k_{x}").alias("k"), F.col(f"b_{x}").alias("b"))
    cells = counts.select("__s", "n", F.explode(F.array(*[cell(*g) for g in grid])).alias("c"))
    p = binomial_tail(F.col("c.k"), F.col("n"), risk.alpha / len(GRIDS))
    good = cells.where((F.col("n") > 0) & (F.col("c.b") > 0) & (p * tests <= risk.delta))
    best = good.groupBy("__s", F.col("c.rule").alias("rule")).agg(F.max(F.struct(F.col("c.b"), F.col("c.cutoff"))).alias("best"))
    return best.groupBy("__s").agg(F.map_from_entries(F.collect_list(F.struct(F.col("rule"), F.col("best.cutoff")))).alias("__cutoffs"))


def with_verdict(featured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``featured`` with boolean ``__kept``. The join is on the stratum: the cutoffs (one row a stratum) are broadcast once counted."""
    over = None
    for rule, v in scores().items():
        hit = F.coalesce(v > F.col("__cutoffs")[rule], F.lit(False))
        over = hit if over is None else over | hit
    joined = featured.withColumn("__s", F.coalesce(F.col(stratum).cast("string"), F.lit(""))).join(maybe_broadcast(cutoffs), "__s", "left")
    return joined.withColumn("__kept", ~base_failed() & ~over).drop("__s", "__cutoffs")


def quality_report(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """One row per document: counts, base verdict and the verdict with the fitted rules."""
    f = materialize(features(docs.select("doc_id", "text", "lang")).drop("text"), "quality")
    q = F.col("__q")
    out = with_verdict(f, materialize(fit_cutoffs(f, labels, risk), "cutoffs"))
    return out.select("doc_id", *[q["w"][c].alias(c) for c in ("n_words", "word_chars")], q["n_symbols"].alias("n_symbols"), q["l"]["n_dup_lines"].alias("n_dup_lines"), q["w"]["n_repeat_words"].alias("n_repeat_words"), base_failed().alias("base_failed"), F.col("__kept").alias("kept"), "lang")


def keep_good(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The documents that pass, with all their columns. Features, the dear part, are taken once; the texts then meet the narrow keys of
    rejected rows."""
    key = [F.col("doc_id"), F.xxhash64(text_of(), F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("__h")]
    f = materialize(features(docs.select(*key, "text", "lang")).drop("text"), "quality")
    judged = with_verdict(f, materialize(fit_cutoffs(f, labels, risk), "cutoffs"))
    bad = judged.where("not __kept").select(F.col("doc_id").alias("__id"), F.col("__h").alias("__bad")).distinct()
    same = F.col("__of").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__bad"))
    return unpacked(packed(docs, key[0].alias("__of"), key[1]).join(bad, same, "left_anti"))
