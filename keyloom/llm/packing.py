"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

A configuration says how many pieces of each length share a sequence. The program (fewest sequences that cover the histogram)
is solved by multiplicative weights: each round a knapsack dynamic program prices the configurations worth most at the present
weights, takes as much of them as their scarcest lengths allow, and lowers the weights of what they cover (Garg and Koenemann; Young).
Weights begin in proportion to lengths, which is nearly a dual solution: a length covered once weighs nothing any more. Only where that
ends more than GAP over the lower bound that the prices give, lengths are covered many times, by weights that fall each time, and the mean is taken.
The solution is rounded down and subtracted; the program runs again on what is left, until it rounds to nothing; the last rest goes,
longest first, where it fits best. Lengths are priced as they are, and the program is always solved. Only the histogram (at most
CAPACITY rows) and the configurations come to the driver.

Pieces are then numbered within their length, by length and input partition, so that no task gathers a common length; a join by
length and block of numbers gives each its place. The plan itself is never broadcast.

Edge cases: null and empty texts are one piece of the end token; only documents of more than CAPACITY tokens are cut; an empty
table gives no rows; repeated rows are packed each.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, id_back, id_of, materialize, new_path, text_of

CAPACITY = 4096
END_ID = 1
#: Share by which a length's weight falls each time that it is covered, where covering once is more than GAP over the lower bound.
EPSILON, GAP = 0.5, 0.01
#: Lengths kept for each room that a configuration may begin with; configurations for each length and round.
DRAWS, TRIES = 8, 6
#: Numbers of a length that are joined with its runs together.
BLOCK = 2048
#: Words whose ids are kept by a task: when there are so many, only those met again go on, and as many new ones.
KNOWN = 600_000
#: ASCII marks that the tokenizer parts from letters before them; an apostrophe may belong to letters after it.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")

#: By tokenizer the ids of words: those kept now, and those kept before them.
_known: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}
_tokenizers: dict = {}


def _by_offsets(tok, words: list[str]) -> list[bytes]:
    """Ids of each word, from one text of them all, dealt out by the places they come from."""
    e = tok.encode(" ".join(words), add_special_tokens=False)
    ids = np.asarray(e.ids, "<u4").tobytes()
    at = np.fromiter((x[0] for x in e.offsets), np.int64, len(e.ids))
    cut = (4 * np.searchsorted(at, np.cumsum([0] + [len(w) + 1 for w in words]))).tolist()
    return [ids[i:j] for i, j in zip(cut, cut[1:])]


def _encoded(tok, last: np.ndarray, words: list[str], each: int = 500) -> list[bytes]:
    """Ids of each word. Where all words of a text are of letters, each has one id that ends a word (``last``)."""
    out: list[bytes] = []
    for lo in range(0, len(words), each):
        group = words[lo : lo + each]
        if all(map(str.isalpha, group)):
            (e,) = tok.encode_batch_fast([" ".join(group)], add_special_tokens=False)  # without offsets
            ids = np.asarray(e.ids, "<u4")
            cut = 4 * (np.flatnonzero(last[ids]) + 1)
            if len(cut) == len(group):
                raw, cut = ids.tobytes(), [0, *cut.tolist()]
                out += [raw[i:j] for i, j in zip(cut, cut[1:])]
                continue
        out += _by_offsets(tok, group)
    return out


def _fresh(known: dict[str, bytes], old: dict[str, bytes], words: Iterable[str]) -> list[str]:
    """The words that are in neither; those that are in ``old`` are known from now on."""
    out = []
    for w in words:
        if w not in known:
            if w in old:
                known[w] = old[w]
            else:
                out.append(w)
    return out


def _learn(tok, last: np.ndarray, known: dict[str, bytes], old: dict[str, bytes], words: list[str]) -> None:
    """Letters with marks after them are letters and marks to the tokenizer, and case doesn't count: fewer words to encode."""
    need, parted = set(), []
    for w in words:
        core = w.rstrip(MARKS)
        if not core.isalpha():
            need.add(w)
        elif core.isascii():
            low = core.lower()
            if low == w:
                need.add(w)
            else:
                parted.append((w, low, w[len(core) :]))
        # Letters that are normalised to a letter and a sign take marks after them for one with the sign.
        elif len(core) == len(w) or not unicodedata.normalize("NFC", core).lower().isalpha():
            need.add(w)
        else:
            parted.append((w, core, w[len(core) :]))
    need.update(_fresh(known, old, {x for _, *both in parted for x in both}))
    letters = [w for w in need if w.isalpha()]
    for part in (letters, list(need.difference(letters))):
        known.update(zip(part, _encoded(tok, last, part)))
    for w, core, marks in parted:
        known[w] = known[core] + known[marks] if marks else known[core]


def token_bytes(texts: list[str], tokenizer: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers, the end id last.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its parts between blanks and line
    ends; each distinct part is encoded once.
    """
    from tokenizers import Tokenizer

    if tokenizer not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tok = Tokenizer.from_file(tokenizer)
        last = np.zeros(tok.get_vocab_size(), bool)
        last[[i for w, i in tok.get_vocab().items() if w.endswith("</w>")]] = True
        _tokenizers[tokenizer] = tok, last
    tok, last = _tokenizers[tokenizer]
    known, old = _known.setdefault(tokenizer, ({}, {}))
    parts = [(t or "").replace("\n", " ").split(" ") for t in texts]
    words = set().union(*parts)
    new = words.difference(known)
    if len(known) + len(new) > KNOWN:
        _known[tokenizer] = known, old = {}, known
        new = words
    _learn(tok, last, known, old, _fresh(known, old, new))
    end = np.asarray([END_ID], "<u4").tobytes()
    return [b"".join(map(known.__getitem__, p)) + end for p in parts]


def _pieces(tokenizer: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, ids in zip(b["id"].tolist(), token_bytes(b["text"].tolist(), tokenizer)):
                n = len(ids) // 4
                for k, lo in enumerate(range(0, n, capacity)):
                    hi = min(n, lo + capacity)
                    out.append((i, k, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])))
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])

    return run


def price(worth: np.ndarray, stock: np.ndarray, slack: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """For all rooms c at once (unbounded knapsack; ``worth`` and ``stock`` by length): the most that a configuration in c is worth, and DRAWS lengths that
    one may begin with: of one worth most, then, drawn by stock, of those worth up to ``slack`` less. 0 leaves a token empty."""
    room = len(worth) - 1
    best, begin = np.zeros(room + 1), np.zeros((room + 1, DRAWS), np.int64)
    back, v = np.zeros(room + 1), np.empty(room)  # best, from the largest room on
    draw = rng.random((room + 1, DRAWS))
    for c in range(1, room + 1):
        u = np.add(back[room - c + 1 :], worth[1 : c + 1], out=v[:c])
        k = int(u.argmax())
        if u[k] > best[c - 1]:
            best[c] = u[k]
            near = np.flatnonzero(u >= u[k] - slack)
            if len(near) > 1:
                total = stock[near + 1].cumsum()
                begin[c] = near[np.searchsorted(total, draw[c] * total[-1], "right")] + 1
            begin[c, 0] = k + 1
            if len(near) == 1:
                begin[c] = k + 1
        else:
            best[c] = best[c - 1]
        back[room - c] = best[c]
    return best, begin


def configurations(live: np.ndarray, begin: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows of lengths, the longest first, 0 after the last: for each length of ``live`` the configuration worth most that holds it, and TRIES - 1 draws of others."""
    lead = np.repeat(live, TRIES)
    full = np.maximum.accumulate(np.where(begin[:, 0] > 0, np.arange(len(begin)), 0))  # the room that is used of each
    at, rows, first = full[len(begin) - 1 - lead], [lead], np.arange(len(lead)) % TRIES == 0
    while at.any():
        rows.append(begin[at, np.where(first, 0, rng.integers(0, DRAWS, len(at)))])
        at = full[at - rows[-1]]
    return -np.sort(-np.stack(rows, axis=1), axis=1)


def cover(sizes: np.ndarray, counts: np.ndarray, room: int, goal: int, rate: float) -> tuple[Counter, float]:
    """Configurations that cover all counts ``goal`` times, and a lower bound of what covers them once.

    A length is worth its share of a sequence, longer ones a little more, less by exp(-rate) with each time that it is covered, and nothing at the goal.
    Each round takes the configurations that are worth most, each as often as its scarcest length allows; of no length more than is there once.
    """
    rng = np.random.default_rng(0)
    need = np.zeros(room + 1, np.int64)
    need[sizes] = counts
    share = np.arange(room + 1) / room
    base = share * (1 + share / (4 * room))  # of full configurations those of longer pieces
    left, used, bound, slack = goal * need, Counter(), 0.0, 0.5 / room
    while left.any():
        live = np.flatnonzero(left)[::-1]
        worth = np.full(room + 1, -np.inf)
        worth[live] = base[live] * np.exp(rate * (left[live] / need[live] - goal))
        scale = float((worth[live] / base[live]).max())
        best, begin = price(worth, left.astype(float), slack * scale, rng)
        # Weights by which no configuration is worth more than one are a dual solution.
        bound = max(bound, float(need[live] @ worth[live]) / best[room])
        rows = configurations(live, begin, rng)
        value = np.where(rows > 0, worth[rows], 0.0).sum(axis=1)
        good = np.flatnonzero(value >= best[room] - slack * scale)
        # The best go first, and of these the ones that aren't draws; then longer lengths.
        turn = good[np.lexsort((good, good % TRIES > 0, value[good] < best[room] - 0.5 / room * scale))]
        once, before = np.minimum(left, need).tolist(), int(left.sum())
        for row in [*rows[turn].tolist(), None]:
            if row is None:
                if int(left.sum()) < before:
                    break
                row = rows[int(value.argmax())].tolist()  # asks for more than there is: as many as there are
                row = [n for n, m in Counter(row).items() if n for _ in range(min(m, once[n]))]
            config = Counter(row)
            config.pop(0, None)
            many = min(once[n] // m for n, m in config.items())
            if many:
                for n, m in config.items():
                    once[n] -= many * m
                    left[n] -= many * m
                used[tuple(sorted(config.items()))] += many
        if 20 * (before - int(left.sum())) < min(before, int(need.sum())):
            slack *= 2  # few are that good: a round takes the next best, too
    return used, bound


def solve(sizes: np.ndarray, counts: np.ndarray, room: int, epsilon: float = EPSILON) -> list[tuple[dict[int, int], float]]:
    """A solution that covers all counts: (configuration, how often). It is whole where covering once takes at most one sequence more than
    the lower bound and a share of GAP, rounded up; else counts are covered log(lengths + 1) / epsilon times, and the solution is the mean, where that is less."""
    used, bound = cover(sizes, counts, room, 1, 0.0)
    goal = 1
    if sum(used.values()) > np.ceil((1 + GAP) * bound) + 1:
        more = int(np.ceil(np.log(len(sizes) + 1) / epsilon))
        other, _ = cover(sizes, counts, room, more, epsilon)
        if sum(other.values()) / more < sum(used.values()):
            used, goal = other, more
    at = {int(n): k for k, n in enumerate(sizes)}
    return [({at[n]: m for n, m in config}, x / goal) for config, x in used.items()]


class Groups:
    """Sequences with equal contents: (room left, number, lengths), findable by room."""

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, []  # sorted (room, contents, number)

    def add(self, contents: tuple[int, ...], number: int) -> None:
        if number:
            insort(self.open, (self.capacity - sum(contents), contents, number))

    def fit(self, length: int, number: int) -> None:
        """Put ``number`` pieces where the least room that is enough is."""
        while number:
            at = bisect_left(self.open, (length,))
            if at < len(self.open):
                room, contents, n = self.open.pop(at)
                use = min(n, number)
                self.add(contents, n - use)
                self.add((*contents, length), use)
                number -= use
            else:
                each = self.capacity // length
                full, rest = divmod(number, each)
                self.add((length,) * each, full)
                self.add((length,) * rest, int(rest > 0))
                number = 0


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, number of sequences that hold them); all pieces are placed: the program's plan, or best fit alone where that takes fewer sequences."""
    planned = by_program(histogram, capacity)
    alone = Groups(capacity)
    for n in sorted(histogram, reverse=True):
        alone.fit(n, histogram[n])
    if sum(number for *_, number in alone.open) < sum(number for _, number in planned):
        return [(contents, number) for _, contents, number in alone.open]
    return planned


def by_program(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    groups, left = Groups(capacity), Counter({n: c for n, c in histogram.items() if c})
    groups.add((capacity,), left.pop(capacity, 0))
    while left:
        sizes = np.array(sorted(left))
        least, placed = int(sizes[0]), 0
        for config, x in sorted(solve(sizes, np.array([left[int(n)] for n in sizes]), capacity), key=lambda c: (-c[1], sorted(c[0].items()))):
            contents = tuple(int(sizes[k]) for k, m in sorted(config.items(), reverse=True) for _ in range(m))
            many = min([int(x + 1e-9), *(left[n] // m for n, m in Counter(contents).items())])
            # A sequence that one more piece would go into is left to the last step.
            if many and capacity - sum(contents) < least:
                groups.add(contents, many)
                placed += many
                left -= Counter({n: many * m for n, m in Counter(contents).items()})
        if not placed:
            break
    for n in sorted(left, reverse=True):
        groups.fit(n, left[n])
    return [(contents, number) for _, contents, number in groups.open]


RUNS = "length long, block long, first long, until long, sequence long, offsets array<long>"


def _runs(groups: list[tuple[tuple[int, ...], int]]) -> Iterator[pd.DataFrame]:
    """Of each length, runs of piece numbers: those from first to before until go into sequences from ``sequence`` on, at each of ``offsets`` in turn.
    A run has a row for each block of BLOCK numbers that it reaches into."""
    out, taken, sequence = [], Counter(), 0
    for contents, number in groups:
        at, offset = {}, 0
        for n in contents:
            at.setdefault(n, []).append(offset)
            offset += n
        for n, offsets in at.items():
            first = taken[n]
            taken[n] = until = first + number * len(offsets)
            out += [(n, block, first, until, sequence, offsets) for block in range(first // BLOCK, (until - 1) // BLOCK + 1)]
        sequence += number
        if len(out) >= 100_000:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RUNS.split(", ")])
            out = []
    yield pd.DataFrame(out, columns=[c.split()[0] for c in RUNS.split(", ")])


def _run_table(spark: SparkSession, groups: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """The runs as a written table: pieces meet them in a join, no task gets them all."""
    path = new_path(spark, "runs")
    for part in _runs(groups):
        spark.createDataFrame(part, RUNS).write.mode("append").parquet(path)
    return spark.read.schema(RUNS).parquet(path)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = "id long, piece int, start long, length long, ids_crc32 long"
    rows = docs.select(id_of().alias("id"), text_of().alias("text")).mapInPandas(_pieces(tokenizer, capacity), schema)
    pieces = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "pieces").withColumn("part", F.shiftright("uid", 33))
    counts = materialize(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The counts have a row for each length and task, so they are joined where the pieces are, not broadcast.
    numbered = pieces.withColumn("turn", F.row_number().over(Window.partitionBy("length", "part").orderBy("uid")) - 1).join(counts.select("length", "part", before.alias("before")).hint("merge"), ["length", "part"])
    numbered = numbered.withColumn("number", F.col("before") + F.col("turn")).withColumn("block", F.floor(F.col("number") / BLOCK))
    inside = (F.col("number") >= F.col("first")) & (F.col("number") < F.col("until"))
    placed = numbered.join(_run_table(spark, plan(histogram, capacity)).hint("merge"), ["length", "block"]).where(inside)
    turn, each = F.col("number") - F.col("first"), F.size("offsets")
    return placed.select(
        id_back("id").alias("doc_id"), "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(turn / each)).cast("long").alias("sequence_id"), F.get("offsets", (turn % each).cast("int")).alias("offset"),
    )
