"""Problem 2: the text that a mail's sender newly wrote, told apart from what was quoted and what closes it."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions.clock import with_instant
from missive.llm.channels import tied
from missive.llm.mailparts import _GREETING, LINE, OWN, QUOTED, parts, split
from missive.session import Cut, table

#: Words that a sentence needs to be told by its fingerprint: shorter ones are told by their exact words.
LONG = 12
#: Bits in which two fingerprints may differ: a changed word of LONG, about what EDITS allow, moves 8 and seldom 20.
DISTANCE = 20
#: Edits, as a share of the longer text, within which a near-match is the same sentence.
EDITS = 0.1
#: Mails of one sender that must have a sentence, wherever it stands, for it to be the sender's boilerplate.
BOILERPLATE = 5
#: Tables that a print is partitioned into: near-matches have one part of 64 / TABLES bits in common.
TABLES = 8
#: Prints of one place that are compared in one task; more are split.
HOT = 8_000
#: Near-matches of a print that are verified at first; those that these don't settle are verified against all.
FIRST = 1000

_WORD = re.compile(r"[^\W_]+")
_STOP = re.compile(r"[.!?]+[\"')\]’”»]*\s+")
# What a stop ends that is no sentence; so does one behind a single capital.
_SHORT = re.compile(r"(?:\b(?:Dr|Mr|Ms|Sr|St|Mrs|No|Nr)|\b[A-ZÀ-Þ])$")
_ITEM = re.compile(r"(?:[-*•·+–]|\(?\w{1,2}[.)])\s")
#: What is told of a mail; n_print counts the sentences that may be inherited, n_said all of them.
TOLD = "told array<int>, n_own int, n_print int, n_said int, body_hash int"
#: What is told of a sentence; long, print and exact are null where it is never inherited.
SAID = "line_no int, begin int, end int, long boolean, print long, exact long, size int, low long, high long, text string"


def fingerprints(lines: list[list[str]]) -> np.ndarray:
    """64-bit SimHash of each list of words."""
    if not lines:
        return np.zeros(0, dtype=np.int64)
    said = list(chain.from_iterable(lines))
    known = {w: i for i, w in enumerate(dict.fromkeys(said))}
    at = np.fromiter(map(known.__getitem__, said), dtype=np.int64, count=len(said))
    x = np.array([zlib.crc32(w.encode()) for w in known], dtype=np.uint64)
    size = np.array([len(w) for w in lines])
    start = np.concatenate([[0], size.cumsum()[:-1]])
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1)
    if size.max() < 256:  # bytes side by side are added as longs, since none overflows
        votes = 2 * np.add.reduceat(bits.view(np.uint64)[at], start, axis=0).view(np.uint8).astype(np.int32)
    else:
        votes = 2 * np.add.reduceat(bits[at], start, axis=0, dtype=np.int32)
    tie = bits[at[start]]  # of as many votes for a bit as against it, the first word's
    return np.packbits((votes > size[:, None]) | ((votes == size[:, None]) & (tie == 1)), axis=1).view(np.int64).ravel()


def bags(texts: list[str]) -> np.ndarray:
    """How many characters of each text fall in each of 16 classes, as two longs of eight bytes (up to 255)."""
    if not texts:
        return np.zeros((0, 2), dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & 15
    at = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    counts = np.bincount(at * 16 + codes, minlength=16 * len(texts))
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, 16).view(np.int64)


def sentences(own: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of the sentences in own lines (number, text), joined across line ends.

    Blank and other lines between, list marks, and a salutation or other short line that ends in a comma, colon or
    dash end a sentence.
    """
    out: list[tuple[int, int, str]] = []
    k = 0
    while k < len(own):
        run = [own[k]]
        k += 1
        while k < len(own) and own[k][0] == run[-1][0] + 1 and not _ITEM.match(own[k][1]) and not (len(run[-1][1]) < 40 and run[-1][1][-1] in ",:;-–—"):
            run.append(own[k])
            k += 1
        text = " ".join(x for _, x in run)
        ends = list(accumulate(len(x) + 1 for _, x in run)) if len(run) > 1 else [len(text) + 1]
        at = 0
        for stop in [*(m.end() for m in _STOP.finditer(text) if not _SHORT.search(text, max(0, m.start() - 4), m.start())), len(text)]:
            if s := text[at:stop].rstrip():
                first, last = bisect_right(ends, at), bisect_right(ends, at + len(s) - 1)
                out.append((run[first][0], run[last][0], s))
            at = stop
    return out


def _salutes(w: list[str], s: str) -> bool:
    return (w[0] in _GREETING and len(w) <= 6) or (len(w) <= 3 and s[-1] in ",:-–—")


def _digest(w: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(w).encode(errors="replace"), digest_size=8).digest(), "big", signed=True)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        told, n_told, n_own, n_print, n_said, hashes, words, long, exact, begin, end, texts = [], [], [], [], [], [], [], [], [], [], [], []
        for body in b.column("body_raw").to_pylist():
            before, own, raw = len(told), [], None
            for i, (s, kind) in enumerate(parts(body), 1):
                if kind != OWN:
                    if not s:
                        raw = split(body) if raw is None else raw
                    if s or raw[i - 1].strip():
                        told.append(i)
                elif s:
                    own.append((i, s))
            said, none = sentences(own), 0
            for i, j, s in said:
                w = _WORD.findall(s.lower())
                begin.append(i)
                end.append(j)
                texts.append(s)
                if not w or (len(w) < LONG and _salutes(w, s)):  # never inherited, but its lines are the sender's own
                    long.append(-1)
                    exact.append(0)
                    none += 1
                    continue
                long.append(int(len(w) >= LONG))
                exact.append(_digest(w))
                if long[-1]:
                    words.append(w)
            n_told.append(len(told) - before)
            n_own.append(len(own))
            n_said.append(len(said))
            n_print.append(len(said) - none)
            hashes.append(0 if body is None else zlib.crc32(body.encode(errors="replace")) - 2**31)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n_told)]).astype(np.int32), pa.array(told, pa.int32()))
        kept = [(b.column(k), f.type) for k, f in enumerate(b.schema) if f.name != "body_raw"]
        names = [f.name for f in b.schema if f.name != "body_raw"]
        mails = [lists, *[pa.array(x, pa.int32()) for x in (n_own, n_print, n_said, hashes)]]
        count = np.asarray(n_said, dtype=np.int64)
        mail = np.repeat(b.column("mail").to_numpy(zero_copy_only=False), count)
        size, kind, same, bag = np.array([len(x) for x in texts], dtype=np.int32), np.array(long, dtype=np.int8), np.array(exact, dtype=np.int64), bags(texts)
        prints = same.copy()
        prints[kind == 1] = fingerprints(words)
        at = np.arange(len(texts)) - np.repeat(count.cumsum() - count, count)
        never = kind < 0
        columns = [
            pa.array(at, pa.int32()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(kind == 1, mask=never), pa.array(prints, mask=never), pa.array(same, mask=never),
            pa.array(size), *[pa.array(np.ascontiguousarray(bag[:, k])) for k in (0, 1)], pa.array(texts, pa.string()),
        ]
        names += [x.split()[0] for x in f"{TOLD}, {SAID}".split(", ")]
        yield pa.RecordBatch.from_arrays([*[c for c, _ in kept], *mails, *[pa.nulls(b.num_rows, c.type) for c in columns]], names)
        if texts:
            own = [pa.array(mail) if n == "mail" else pa.nulls(len(texts), kind) for n, (_, kind) in zip(names, kept, strict=False)]
            yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(len(texts), c.type) for c in mails], *columns], names)


def parsed(mails: DataFrame) -> DataFrame:
    """For each row of mails(mail, body_raw, ...), mail being its number: a row with its other columns and TOLD, where line_no is null, and one with mail and SAID of each sentence of its own."""
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mails.schema if f.name != "body_raw")
    return mails.mapInArrow(_parse, f"{kept}, {TOLD}, {SAID}")


def _sender(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"([\w.+'-]+@[\w.-]+)", 1))


def _people(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\w.+'-]+@[\w.-]+)"))


def _base(c: Column) -> Column:
    return F.xxhash64(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^(?:\s*(?:re|fwd?|aw|wg|sv|tr|rv|enc|antw)\s*:)+\s*", "")))


def _author(rows: DataFrame) -> Column:
    """A number for each sender, null for none."""
    return F.col("author") if "author" in rows.columns else F.when(F.col("sender").isNotNull(), F.xxhash64("sender"))


def _named(rows: DataFrame) -> DataFrame:
    """rows(subject, sender, people) with these as numbers instead: author, and the places by subject, author and those named."""
    named = F.transform(F.array_distinct("people"), lambda x: F.xxhash64(F.lit("author"), F.col("subject"), x))
    by = (F.xxhash64(F.lit("subject"), "subject").alias("by_subject"), F.xxhash64(F.lit("author"), "subject", "sender").alias("by_author"), named.alias("named"))
    return rows.select(*[c for c in rows.columns if c not in ("subject", "sender", "people")], _author(rows).alias("author"), *by)


def _placed(rows: DataFrame) -> DataFrame:
    """_named() rows with a channel, and the places where a mail asks and where it has its sentences instead."""
    by_channel = F.when(F.col("channel").isNotNull(), F.array(F.xxhash64(F.lit("channel"), "channel"))).otherwise(F.array().cast("array<bigint>"))
    asks = F.concat(F.when(F.size("named") > 0, F.col("named")).otherwise(F.array("by_subject")), by_channel)
    has = F.when(F.col("author").isNotNull(), F.concat(F.array("by_author", "by_subject"), by_channel))
    return rows.select(*[c for c in rows.columns if c not in ("by_subject", "by_author", "named", "channel")], asks.alias("asks_at"), has.alias("has_at"))


_BITS = 64 // TABLES
_PAIRS = "node long, node2 long, more boolean"
# With the mails of both, and whether the group has all matches of node.
_COUNTED = f"{_PAIRS}, n long, n2 long, whole boolean"
#: What a sentence is compared by: its print, its length and its bags().
SKETCH = ("node", "print", "size", "low", "high")


def _grouped(rows: DataFrame, cut: Cut, sizes: DataFrame | None = None) -> DataFrame:
    """rows(place, other, node, print, ...) with the group they are compared in, and its table (-1: in all of them).

    sizes(place, n) has the rows of each place, or parts of them, where that is known without making rows.

    A group is a place. Of a place with more than HOT rows it is a part of the prints in one table, and of a part with
    more than HOT rows a pair of shares, so that none is larger and every two rows that may match meet.
    """

    def crowded(sizes: DataFrame) -> DataFrame:
        return cut.keep(sizes.groupBy("group").agg(F.sum("n").alias("n")).where(f"n > {HOT}").select("group", F.ceil(F.col("n") / HOT).cast("int").alias("shares")))

    one = F.lit(1).cast("long").alias("n")
    rows = rows.withColumnRenamed("place", "group").withColumn("table", F.lit(-1))
    hot = crowded(rows.select("group", one) if sizes is None else sizes.select(F.col("place").alias("group"), "n"))
    if hot.isEmpty():
        return rows
    rest = rows.join(hot, "group", "left_anti")
    parts = F.array(*[F.struct(F.xxhash64("group", F.lit(k), F.shiftrightunsigned("print", k * _BITS).bitwiseAND((1 << _BITS) - 1)).alias("group"), F.lit(k).alias("table")) for k in range(TABLES)])
    kept = [c for c in rows.columns if c not in ("group", "table")]
    split = rows.join(hot.select("group"), "group", "left_semi").select(*kept, F.explode(parts).alias("p")).select("p.group", *kept, "p.table")
    shares = F.coalesce("shares", F.lit(1))
    split = split.join(crowded(split.select("group", one)), "group", "left").withColumn("_own", F.pmod(F.xxhash64("node"), shares)).withColumn("_any", F.explode(F.sequence(F.lit(0), shares - 1)))
    pair = F.when(F.col("shares").isNull(), F.col("group")).when(F.col("other"), F.xxhash64("group", "_any", "_own")).otherwise(F.xxhash64("group", F.col("_own").cast("int"), F.col("_any").cast("long")))
    return rest.unionByName(split.select(pair.alias("group"), *kept, "table"))


class _Rows:
    """Whole groups of _grouped() rows as arrays, with their near-matches."""

    def __init__(self, rows: pd.DataFrame):
        self.group, self.other = np.unique(rows["group"].to_numpy(), return_inverse=True)[1].astype(np.uint64), rows["other"].to_numpy(dtype=bool)
        self.prints, self.node, self.size, self.table = rows["print"].to_numpy().view(np.uint64), rows["node"].to_numpy(), rows["size"].to_numpy(), rows["table"].to_numpy()
        self.bag = np.stack([rows["low"].to_numpy(), rows["high"].to_numpy()], 1).view(np.uint8).astype(np.int16)

    def near(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows of left and right with a part in common, within DISTANCE, that may be within EDITS."""
        got = [(left[:0], right[:0])]
        part = lambda x, k: (x >> np.uint64(k * _BITS)) & np.uint64((1 << _BITS) - 1)
        for k in range(TABLES):
            key = (self.group << np.uint64(_BITS)) | part(self.prints, k)
            a, b = (x[(self.table[x] == k) | (self.table[x] < 0)] for x in (left, right))
            b = b[np.argsort(key[b], kind="stable")]
            prints = self.prints[b]
            low, high = np.searchsorted(key[b], key[a], "left"), np.searchsorted(key[b], key[a], "right")
            total, at = np.cumsum(high - low), 0
            while at < len(a):  # about four million candidates at a time
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 4_000_000, "right")))
                n = (high - low)[at:to]
                ends = n.cumsum()
                j = np.repeat(low[at:to] - (ends - n), n) + np.arange(n.sum())
                x = np.repeat(self.prints[a[at:to]], n) ^ prints[j]
                # Few are within DISTANCE: what else is asked is asked of these.
                few = np.flatnonzero(np.bitwise_count(x) <= DISTANCE)
                i, j, x = a[at + np.searchsorted(ends, few, "right")], b[j[few]], x[few]
                most = np.maximum(self.size[i], self.size[j]) * EDITS
                near = (np.abs(self.size[i] - self.size[j]) <= most) & (self.node[i] != self.node[j])
                for before in range(k):  # found in an earlier table
                    near &= part(x, before) != 0
                i, j, most = i[near], j[near], most[near]
                # Edits are no fewer than the characters of a class that one text has and the other has not.
                more = self.bag[i] - self.bag[j]
                close = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1)) <= most
                got.append((i[close], j[close]))
                at = to
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def given(self, i: np.ndarray, j: np.ndarray, most: int | None, n: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
        """The pairs as _PAIRS, at most ``most`` of each row of i, if given; with n, the mails of each row, as _COUNTED."""
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        begin, many = np.searchsorted(i, i, "left"), np.zeros(len(i), dtype=bool)
        if most is not None:
            rank, many = np.arange(len(i)) - begin, np.searchsorted(i, i, "right") - begin > most
            i, j, many = i[rank < most], j[rank < most], many[rank < most]
        for at in range(0, len(i), 100_000):
            x, y = i[at : at + 100_000], j[at : at + 100_000]
            counted = {} if n is None else {"n": n[x], "n2": n[y], "whole": self.table[x] < 0}
            yield pd.DataFrame({"node": self.node[x], "node2": self.node[y], "more": many[at : at + 100_000], **counted})


def _near_pairs(rows: pd.DataFrame, most: int | None) -> Iterator[pd.DataFrame]:
    r = _Rows(rows)
    yield from r.given(*r.near(np.nonzero(~r.other)[0], np.nonzero(r.other)[0]), most)


def _enough(rows: pd.DataFrame, most: int | None) -> Iterator[pd.DataFrame]:
    """Of rows with n, the mails of each print: near-matches of rows that may have BOILERPLATE mails with all of theirs.

    A part of a split place has not all matches of a row, so there all are given.
    """
    r, n = _Rows(rows), rows["n"].to_numpy()
    i, j = r.near(np.nonzero(~r.other)[0], np.nonzero(r.other)[0])
    mails = n + np.bincount(i, weights=n[j], minlength=len(n))
    may = (mails[i] >= BOILERPLATE) | (r.table[i] >= 0)
    yield from r.given(i[may], j[may], most, n)


def _earlier(rows: pd.DataFrame, most: int | None) -> Iterator[pd.DataFrame]:
    """Of rows with told, at, author and long: earlier rows by another author; node2 is -1 where one has the same words."""
    r = _Rows(rows)
    told, at, author, long = rows["told"].to_numpy().view(np.uint64), rows["at"].to_numpy(), rows["author"].to_numpy(), rows["long"].to_numpy(dtype=bool)
    words = (told ^ (r.group * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    known, asked = np.nonzero(r.other)[0], np.nonzero(~r.other)[0]
    # The first of each author's rows with the same words, in order of time.
    known = known[np.lexsort((at[known], author[known], words[known]))]
    first = np.ones(len(known), dtype=bool)
    first[1:] = (words[known][1:] != words[known][:-1]) | (author[known][1:] != author[known][:-1])
    known = known[first]
    known = known[np.lexsort((at[known], words[known]))]
    keys = words[known]
    same = np.zeros(len(r.node), dtype=bool)
    exact = asked[r.table[asked] <= 0]
    if len(known) and len(exact):
        place = np.searchsorted(keys, words[exact], "left")
        for step in (0, 1):  # the earliest, or if that is the asker's own, the next, which another author wrote
            p = np.minimum(place + step, len(known) - 1)
            k = known[p]
            same[exact] |= (keys[p] == words[exact]) & (at[k] < at[exact]) & (author[k] != author[exact])
    hits = r.node[same]
    for x in range(0, len(hits), 100_000):
        yield pd.DataFrame({"node": hits[x : x + 100_000], "node2": -1, "more": False})
    # Near-matches: what is asked with the same words is compared once.
    asked = asked[~same[asked] & long[asked]]
    asked = asked[np.argsort(words[asked], kind="stable")]
    of, start = np.unique(words[asked], return_index=True)
    i, j = r.near(asked[start], known[long[known]])
    n = np.diff(np.append(start, len(asked)))[np.searchsorted(of, words[i])]
    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, j = asked[np.repeat(start[np.searchsorted(of, words[i])], n) + rank], np.repeat(j, n)
    before = (at[j] < at[i]) & (author[j] != author[i])
    yield from r.given(i[before], j[before], most)


def near_matches(asked: DataFrame, others: DataFrame, cut: Cut, most: int | None = None, by: Callable = _near_pairs, sizes: DataFrame | None = None) -> DataFrame:
    """(node, node2, more), distinct but for more: of asked and others(place, *SKETCH), the near-matches of one place.

    Hamming partition tables: prints are cut into TABLES parts, and those with a part in common are compared. That
    finds every pair within TABLES - 1 bits, 99 % of those that differ in 9 and 91 % of those in 12, the most that a
    changed word of LONG usually moves. Rows move once, to the task of their place, where the tables stand; places of
    more than HOT rows are split (_grouped()), and no print is left out. With ``most``, about so many matches of an
    asked row are given, and more says whether it has others. Pairs that can't be within EDITS by their lengths and bags
    are left out. A row doesn't match itself (equal nodes). ``by`` chooses among whole groups of rows. sizes as
    in _grouped().
    """
    columns = [c for c in asked.columns if c != "place"]
    return _met(asked.select("place", F.lit(False).alias("other"), *columns).unionAll(others.select("place", F.lit(True), *columns)), cut, most, by, sizes)


def _met(rows: DataFrame, cut: Cut, most: int | None, by: Callable, sizes: DataFrame | None = None) -> DataFrame:
    """near_matches() of rows(place, other, *SKETCH): of those that are not other, among those that are."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if held and sum(map(len, held)) > HOT and len(b) and b["group"].iloc[-1] != held[0]["group"].iloc[0]:
                rows = pd.concat([*held, b])
                done = (rows["group"] != rows["group"].iloc[-1]).to_numpy()
                yield from by(rows[done], most)
                held = [rows[~done]]
            elif len(b):
                held.append(b)
        if held:
            yield from by(pd.concat(held), most)

    return _grouped(rows, cut, sizes).repartition("group").sortWithinPartitions("group").mapInPandas(part, _COUNTED if by is _enough else _PAIRS)


def _same(pairs: DataFrame, texts: DataFrame, cut: Cut) -> DataFrame:
    """The pairs(node, node2) whose texts(node, text) are within EDITS; only theirs move."""
    pairs = cut.keep(pairs.select("node", "node2").distinct())
    ends = cut.keep(pairs.select("node").unionAll(pairs.select("node2")).distinct())
    texts = cut.keep(texts.join(ends, "node", "left_semi"))
    both = pairs.join(texts, "node").join(texts.toDF("node2", "text2"), "node2")
    both = both.withColumn("most", (F.greatest(F.length("text"), F.length("text2")) * EDITS).cast("int"))
    same = cut.keep(both.where(F.abs(F.length("text") - F.length("text2")) <= F.col("most")).where("levenshtein(text, text2, most) >= 0").select("node", "node2"))
    cut.drop(pairs, ends, texts)
    return same


def _filled(lines: DataFrame, texts: DataFrame, cut: Cut, only: DataFrame | None) -> DataFrame:
    """lines with a node each, whether they are asked about, their texts, and where they lack them: long, alike in size, and told by prints alone."""
    if "node" in lines.columns:
        return lines
    lines = _asked(lines, only)
    for name, value in (("long", F.lit(True)), ("size", F.lit(0)), ("low", F.lit(0).cast("long")), ("high", F.lit(0).cast("long")), ("exact", F.xxhash64("source_id", "line_no")), ("channel", F.lit(None).cast("long"))):
        lines = lines if name in lines.columns else lines.withColumn(name, value)
    lines = lines.drop("text").join(texts.select("source_id", "line_no", "text"), ["source_id", "line_no"], "left")
    return cut.keep(lines.withColumn("node", F.monotonically_increasing_id()))


def _asked(rows: DataFrame, only: DataFrame | None) -> DataFrame:
    """rows with a column asked: whether only(source_id) names them, true for all if it is null."""
    if only is None:
        return rows.withColumn("asked", F.lit(True))
    named = only.select("source_id").distinct().withColumn("asked", F.lit(True))
    return rows.join(named, "source_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def inherited(lines: DataFrame, texts: DataFrame, cut: Cut, ties: DataFrame | None = None, only: DataFrame | None = None, mails: DataFrame | None = None) -> DataFrame:
    """(source_id, line_no, why) of lines(source_id, subject, sender, people, at, line_no, print) not newly written.

    A line is a sentence, line_no its number in the mail. 'inherited': an earlier mail by another sender has the
    sentence, in the same words (column exact, their digest, if there) or within DISTANCE bits of its SimHash
    (near_matches()) and EDITS of its text, which texts(source_id, line_no, text) has and only candidates are joined to.
    That mail has the same channel in ties(source_id, channel), or the same base subject
    and a sender whom this mail is addressed to (people), or any if it names no address. Where a column
    long says that a sentence is not, its words must be the same. Repeated sentences are met once. Lines that authored()
    made have texts and channels already, and a column asked in place of only; mails has their mails, with asked and the
    number n of sentences with a print, which are counted from lines otherwise.
    'boilerplate': boilerplate() has it. Null senders inherit, but nothing is inherited
    from them. only(source_id) names the mails that are asked about, null all.
    """
    lines = _filled(lines if ties is None else lines.join(ties.select("source_id", "channel"), "source_id", "left"), texts, cut, only)
    texts = lines if "text" in lines.columns else texts
    slim = lines.where("print is not null")
    # Places are chosen by mails first: sentences only go to those where another sender's earlier mail may be met.
    counted = None if mails is not None else cut.keep(_placed(_named(slim.groupBy("source_id", "subject", "sender", "people", "at", "channel").agg(F.count("*").alias("n"), F.max("asked").alias("asked")))))
    mails = counted if mails is None else mails
    asks = mails.where("asked").select("source_id", "author", "at", "n", F.explode("asks_at").alias("place"))
    has = mails.select("source_id", "author", "at", "n", F.explode("has_at").alias("place"))
    met = has.groupBy("place").agg(F.min("at").alias("oldest"), F.min("author").alias("x"), F.max("author").alias("y")).join(asks.groupBy("place").agg(F.max("at").alias("newest")), "place").where("oldest < newest")
    met = cut.keep(met)
    asks = cut.keep(asks.join(met, "place").where("oldest < at and (author is null or x <> author or y <> author)").groupBy("source_id", "place").agg(F.max("n").alias("n")))
    has = cut.keep(has.join(met.join(asks.select("place").distinct(), "place", "left_semi"), "place").where("at < newest").groupBy("source_id", "place").agg(F.max("n").alias("n")))
    told = F.when(F.col("long"), F.col("exact")).otherwise(F.coalesce("exact", "print")).alias("told")
    writer = F.coalesce(_author(lines), F.lit(0).cast("long")).alias("author")
    row = [*SKETCH, told, "at", writer, "long"]
    places = asks.select("source_id", "place", F.lit(False).alias("other")).unionAll(has.select("source_id", "place", F.lit(True)))
    sizes = asks.select("place", "n").unionAll(has.select("place", "n"))

    def found(slim: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
        rows = slim.select("source_id", "asked", *row).join(places, "source_id").where("other or asked").select("place", "other", *SKETCH, "told", "at", "author", "long")
        pairs = cut.keep(_met(rows, cut, most, _earlier, sizes))
        near = _same(pairs.where("node2 >= 0"), texts.select("node", "text"), cut)
        return cut.keep(pairs.where("node2 < 0").select("node").unionAll(near.select("node")).distinct()), pairs.where("more").select("node").distinct()

    hits, more = found(slim, FIRST)
    more = cut.keep(more.join(hits, "node", "left_anti"))
    if not more.isEmpty():
        again = slim.join(more.withColumn("again", F.lit(True)), "node", "left")
        hits = hits.unionAll(found(again.withColumn("asked", F.col("asked") & F.col("again").isNotNull()), None)[0])
    cut.drop(counted, met, asks, has)
    hits = hits.distinct().withColumn("why", F.lit("inherited")).unionAll(boilerplate(lines, texts, cut, None, True).withColumn("why", F.lit("boilerplate")))
    return lines.select("node", "source_id", "line_no").join(cut.keep(hits), "node").select("source_id", "line_no", "why")


def boilerplate(lines: DataFrame, texts: DataFrame, cut: Cut, only: DataFrame | None = None, nodes: bool = False) -> DataFrame:
    """(source_id, line_no) of the sentences of lines (as inherited() has them) that BOILERPLATE mails of their sender have.

    A mail has a sentence if one of its own has its print, or is a near-match within DISTANCE bits and EDITS of its text.
    Mails are counted exactly; only texts of sentences that might reach BOILERPLATE are compared. A sentence that its
    FIRST near-matches settle, as in a family of one template, needs no others. Sentences that are not long and null
    senders have none. only(source_id) names the mails that are asked about, null all. With nodes, node is given.
    """
    lines = _filled(lines, texts, cut, only)
    texts = lines if "text" in lines.columns else texts
    said = lines.where(_author(lines).isNotNull()).where("print is not null and long").select(_author(lines).alias("place"), F.xxhash64("source_id").alias("mail"), "asked", *SKETCH)
    each = said.groupBy("place", "print", "mail").agg(F.min(F.struct("node", "size", "low", "high")).alias("line"), F.max("asked").alias("asked"))
    counted = cut.keep(each.groupBy("place", "print").agg(F.count("*").alias("n"), F.min("line").alias("line"), F.max("asked").alias("asked")).select("place", "print", "n", "asked", "line.*"))
    few = counted.where(f"asked and n < {BOILERPLATE}")
    columns = ["place", *SKETCH, "n"]

    def reached(pairs: DataFrame) -> DataFrame:
        """The nodes that BOILERPLATE mails have, by the near-matches in pairs(node, node2, n, n2, whole)."""
        open_ = pairs.where("not whole")  # parts of split places don't know all matches
        enough = open_.groupBy("node").agg((F.sum("n2") + F.first("n")).alias("most")).where(f"most >= {BOILERPLATE}")
        alike = pairs.where("whole").select("node", "node2").unionAll(open_.join(enough, "node", "left_semi").select("node", "node2"))
        # Edits are the same both ways, so each two texts are compared once.
        same = _same(alike.select(F.least("node", "node2").alias("node"), F.greatest("node", "node2").alias("node2")), texts.select("node", "text"), cut)
        same = same.unionAll(same.select(F.col("node2").alias("node"), F.col("node").alias("node2")))
        same = cut.keep(same.unionAll(same.select("node", "node").distinct()))
        ends = cut.keep(counted.select("place", "print", F.col("node").alias("node2")).join(same.select("node2").distinct(), "node2", "left_semi"))
        mails = same.join(said.select("place", "print", "mail").join(ends, ["place", "print"]), "node2")
        return cut.keep(mails.groupBy("node").agg(F.count_distinct("mail").alias("n")).where(f"n >= {BOILERPLATE}").select("node"))

    first = cut.keep(near_matches(few.select(columns), counted.select(columns), cut, FIRST, _enough))
    common = counted.where(f"n >= {BOILERPLATE}").select("node").unionAll(reached(first))
    more = cut.keep(first.where("more").select("node").distinct().join(common, "node", "left_anti"))
    if not more.isEmpty():
        common = common.unionAll(reached(cut.keep(near_matches(few.join(more, "node", "left_semi").select(columns), counted.select(columns), cut, None, _enough))))
    common = cut.keep(counted.join(common.distinct(), "node", "left_semi").select("place", "print"))
    cut.drop(counted)
    hit = said.where("asked").join(common, ["place", "print"]).select("node")
    return hit if nodes else lines.join(hit, "node").select("source_id", "line_no")


def authored(mails: DataFrame, clocks: DataFrame, cut: Cut, ties: DataFrame | None = None, only: DataFrame | None = None, times: DataFrame | None = None, bare: bool = False) -> DataFrame:
    """(source_id, told, n_own) of each source_id of mails, cut: the lines that are not newly written, and how many are.

    mails(source_id, source_name, thread_id, message_id, in_reply_to, references_json, subject, sender, recipients_json,
    sent_timestamp, body_raw, imported_at); ties is tied() of them where it is known already. Lines are told by form
    first (quote marks, headers, introductions, signatures, notices); what is left is held against earlier mails and
    the sender's other mails (inherited()). Of rows with one source_id the first imported counts. Null and empty
    bodies have no lines; null subjects count as one, null senders as different ones. With only(source_id), sentences
    of its mails alone are held against others, and those of the rest are told by form. times(row_id, utc_micros) gives
    the mails' instants where they are known already. With bare, all that need be right is whether n_own is 0: mails with
    a sentence that is never inherited, as a salutation, have a line left whatever else is found, and are told by form.
    """
    ties = tied(mails, cut) if ties is None else ties
    about = mails.where("source_id is not null").select("source_id", F.unix_micros(F.col("imported_at").cast("timestamp")).alias("imported_at"), _base(F.col("subject")).alias("subject"), F.nullif(_sender(F.col("sender")), F.lit("")).alias("sender"), _people(F.col("recipients_json")).alias("people"), "source_name", F.col("sent_timestamp").alias("_text"), "body_raw")
    if times is None:
        zones = clocks.groupBy("source_name").agg(F.max("home_zone").alias("_zone"), F.max("day_first").alias("_first"))
        about = with_instant(about.join(zones, "source_name", "left"), "_text", "_first", "_zone", "instant")
    else:
        about = about.withColumn("instant", F.lit(None).cast("long"))
    about = _named(about.select("source_id", "imported_at", "instant", "subject", "sender", "people", "body_raw", F.monotonically_increasing_id().alias("mail")))
    raw = cut.keep(parsed(about).withColumn("node", F.monotonically_increasing_id()))
    facts = ("mail", "instant", "author", "by_subject", "by_author", "named", "told", "n_own", "n_print", "n_said")
    one = raw.where("line_no is null").groupBy("source_id").agg(F.min_by(F.struct("imported_at", *facts), F.struct("imported_at", "body_hash")).alias("m")).select("source_id", "m.*")
    if times is not None:
        one = one.drop("instant").join(times.select(F.col("row_id").alias("source_id"), F.col("utc_micros").alias("instant")), "source_id", "left")
    one = _asked(one.join(ties.select("source_id", "channel"), "source_id", "left"), only).withColumn("at", F.coalesce("instant", "imported_at")).drop("instant", "imported_at")
    one = one.withColumn("asked", F.col("asked") & (F.col("n_print") == F.col("n_said"))) if bare else one
    rest = cut.keep(_placed(one))
    # Texts stay where they are: sentences move without them.
    said = raw.where("line_no is not null").select("mail", "node", *[x.split()[0] for x in SAID.split(", ")][:-1])
    lines = cut.keep(said.join(rest.where("n_said > 0").select("mail", "source_id", "author", "at", "asked"), "mail").drop("mail"))
    # A line is not newly written if none of its sentences is.
    hits = cut.keep(inherited(lines, raw.where("line_no is not null"), cut, None, None, rest.where("n_print > 0").withColumnRenamed("n_print", "n")).select("source_id", "line_no").distinct().withColumn("hit", F.lit(True)))
    marked = lines.join(hits.select("source_id").distinct(), "source_id", "left_semi").join(hits, ["source_id", "line_no"], "left")
    marked = marked.select("source_id", F.explode(F.sequence("begin", "end")).alias("line_no"), F.coalesce("hit", F.lit(False)).alias("hit"))
    more = marked.groupBy("source_id", "line_no").agg(F.min("hit").alias("hit")).where("hit").groupBy("source_id").agg(F.collect_set("line_no").alias("more"))
    out = rest.join(more, "source_id", "left")
    extra = F.array_except("more", "told")
    done = cut.keep(out.select("source_id", F.when(F.col("more").isNull(), F.col("told")).otherwise(F.array_union("told", "more")).alias("told"), (F.col("n_own") - F.coalesce(F.when(F.col("more").isNotNull(), F.size(extra)), F.lit(0))).alias("n_own")))
    cut.drop(rest, lines, raw)
    return done


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per non-blank line that the sender did not newly write: source_id, line_no."""
    done = authored(table(spark, sf_dir, "emails"), table(spark, sf_dir, "source_clocks"), Cut(spark))
    return done.select("source_id", F.explode("told").alias("line_no"))


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for body, told in zip(b["body_raw"], b["told"], strict=True):
            lines, told = LINE.split(body or ""), set(told)
            kinds = [k for _, k in parts(body)]
            text = lambda keep: "\n".join(x for i, x in enumerate(lines) if keep(i)).strip()
            out.append((text(lambda i: i + 1 not in told and kinds[i] == OWN), text(lambda i: kinds[i] == QUOTED), text(lambda i: i + 1 in told and kinds[i] != QUOTED)))  # noqa: B023
        yield pd.DataFrame({"source_id": b["source_id"], **dict(zip(("current_message", "quoted_history", "closing"), map(list, zip(*out, strict=True)) if out else ([], [], []), strict=True))})


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mail's newly written text, its quoted history and its closing matter."""
    mails = table(spark, sf_dir, "emails")
    done = authored(mails, table(spark, sf_dir, "source_clocks"), Cut(spark))
    bodies = mails.groupBy("source_id").agg(F.min_by("body_raw", F.struct("imported_at", F.crc32("body_raw").alias("h"))).alias("body_raw"))
    return done.join(bodies, "source_id").select("source_id", "body_raw", "told").mapInPandas(_texts, "source_id string, current_message string, quoted_history string, closing string")
