"""Problem 8: texts packed into containers of a fixed number of tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.operators.ordering import numbered
from missive.session import Cut, table

#: Ranks of a public tokenizer, and the pattern (fixed) by which its vocabulary splits a text.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items in an enumerated combination, the unused tokens it may leave, and the combinations kept a length.
DEPTH, SLACK, NEAR = 3, 0.02, 6
STEPS = 400


def token_counts(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens) of documents(doc_id, text): whole texts; null counts 0."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [0 if t is None else len(encode(t)) for t in b["text"]]})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInPandas(part, f"doc_id {kind}, n_tokens int")


def _combinations(counts: np.ndarray) -> list[tuple[int, ...]]:
    """Combinations of up to DEPTH lengths that fill a container but for SLACK of it, NEAR for each longest length."""
    size = len(counts) - 1
    lengths = np.nonzero(counts)[0][::-1]
    least = size - int(size * SLACK)
    below = np.zeros(size + 1, dtype=int)  # the longest present length up to here
    for n in range(1, size + 1):
        below[n] = n if counts[n] else below[n - 1]
    out = []
    for a in lengths.tolist():
        got: list[tuple[int, ...]] = [(a,)] if a >= least else []
        b = below[min(a, size - a)]
        while b and len(got) < 4 * NEAR:
            rest = size - a - b
            if a + b >= least:
                got.append((a, int(b)))
            c = below[min(b, rest)]
            if DEPTH > 2 and c and a + b + c >= least:
                got.append((a, int(b), int(c)))
            b = below[b - 1]
        got.sort(key=lambda x: (-sum(x), len(x)))
        out += got[:NEAR]
    return out


def _repeats(patterns: list[tuple[int, ...]], counts: np.ndarray) -> np.ndarray:
    """How often to repeat each combination: non-negative least squares against the histogram, by projected steps."""
    if not patterns:
        return np.zeros(0)
    col = np.array([i for i, p in enumerate(patterns) for _ in p])
    row = np.array([x for p in patterns for x in p])
    target = counts.astype(float)
    x, y, t = np.zeros(len(patterns)), np.zeros(len(patterns)), 1.0
    load = np.bincount(row, minlength=len(counts))
    step = 1.0 / max(1.0, float(max(np.bincount(col, weights=load[row]))))
    for _ in range(STEPS):
        fit = np.bincount(row, weights=y[col], minlength=len(counts)) - target
        new = np.maximum(0, y - step * np.bincount(col, weights=fit[row], minlength=len(patterns)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a container, how many such) for a histogram of lengths up to the capacity; every item has a place.

    The work and the plan are bounded by the capacity, not by the number of items: the counts of combinations from
    least squares are rounded down and capped by what is left, and residual lengths are packed greedily, the longest
    first, each combination as often as its lengths last.
    """
    left, size, out = counts.copy(), len(counts) - 1, []

    def take(p: tuple[int, ...], most: int) -> None:
        need = np.bincount(p, minlength=size + 1)
        n = min([most, *(int(left[x] // need[x]) for x in set(p))])
        if n > 0:
            left[:] -= need * n
            out.append((p, n))

    patterns = _combinations(left)
    for p, n in sorted(zip(patterns, _repeats(patterns, left), strict=True), key=lambda x: (-sum(x[0]), x[0])):
        take(p, int(n + 1e-9))
    while left.any():
        room, p, used = size, [], np.zeros_like(left)
        n = int(np.nonzero(left)[0][-1])
        while n:
            fits = np.nonzero((left - used)[: min(room, n) + 1])[0]
            n = int(fits[-1]) if len(fits) and fits[-1] else 0
            if n:
                k = int(min(room // n, left[n] - used[n]))
                p += [n] * k
                used[n] += k
                room -= k * n
                n = min(n - 1, room) if room else 0
        take(tuple(p), int(left.sum()))
    return out


def pack(sizes: DataFrame, capacity: int, cut: Cut) -> DataFrame:
    """(doc_id, piece_no, n_tokens, container_no) of sizes(doc_id, n_tokens): a container for each piece of each text.

    A text longer than the capacity is cut into pieces of the capacity and a rest; no other is divided. The histogram
    of lengths has at most ``capacity`` rows and gives the plan; the r-th piece of a length takes the r-th place that
    the plan has for it. Pieces are numbered per length over sorted runs, so that a length of most texts is no task of
    its own. Texts without tokens need no container and give no row; a repeated doc_id is packed once, with its
    largest size; null ids and sizes are left out.
    """
    rows = sizes.where("doc_id is not null and n_tokens > 0").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    last = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    pieces = rows.select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"), "n_tokens")
    pieces = cut.keep(pieces.select("doc_id", "piece_no", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).cast("int").alias("n_tokens")))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("n_tokens").count().collect():
        counts[r["n_tokens"]] = r["count"]
    places: dict[int, tuple[list[int], list[int], list[int]]] = {}
    base = 0
    for p, n in plan(counts):
        for length in set(p):
            m = p.count(length)
            ends, firsts, many = places.setdefault(length, ([], [], []))
            ends.append((ends[-1] if ends else 0) + m * n)
            firsts.append(base)
            many.append(m)
        base += n
    arrays = {k: tuple(map(np.array, v)) for k, v in places.items()}

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            where = np.zeros(len(b), dtype=np.int64)
            length, rank = b["n_tokens"].to_numpy(), b["rank"].to_numpy() - 1
            for n in np.unique(length):
                own = length == n
                ends, firsts, many = arrays[int(n)]
                k = np.searchsorted(ends, rank[own], "right")
                begin = np.where(k > 0, ends[k - 1], 0)
                where[own] = firsts[k] + (rank[own] - begin) // many[k]
            yield b.drop(columns="rank").assign(container_no=where)

    ranked = numbered(pieces, ["n_tokens"], ["doc_id", "piece_no"], "rank", cut)
    kind = sizes.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece_no", "n_tokens", "rank").mapInPandas(part, f"doc_id {kind}, piece_no int, n_tokens int, container_no long")


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text with its container, for each capacity: spec_id, doc_id, piece_no, n_tokens, container_no."""
    cut = Cut(spark)
    sizes = cut.keep(token_counts(table(spark, sf_dir, "documents")))
    specs = table(spark, sf_dir, "container_specs").select("spec_id", "capacity_tokens").where("capacity_tokens > 0").distinct().orderBy("spec_id").collect()
    done = [pack(sizes, s["capacity_tokens"], cut).select(F.lit(s["spec_id"]).alias("spec_id"), "*") for s in specs]
    return reduce(DataFrame.unionAll, done)


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of room unused for each capacity."""
    specs = table(spark, sf_dir, "container_specs").select("spec_id", "capacity_tokens").distinct()
    used = p8_packing(spark, sf_dir).groupBy("spec_id").agg((F.max("container_no") + 1).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return used.join(specs, "spec_id").select("spec_id", "n_containers", "n_tokens", (1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("unused_share"))
