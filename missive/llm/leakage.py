"""Problem 9: passages of evaluation texts in a training corpus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm.words import words
from missive.session import table

#: Token positions that the seeds compare; the others may differ.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6, 8))
#: Characters of passages whose seeds are sent to the executors at once (about 20 bytes each); more are taken in blocks.
BLOCK = 4_000_000
#: Words of documents that are searched at once.
CHUNK = 500_000
#: Share of a passage's words that must stand in a document, in the passage's order.
SHARE = 0.4
#: Share of a passage's words under seeds, in one region of the document, from which it is aligned.
COVER = 0.25
#: Words between two seeds of one stretch, and between two stretches of one passage.
STEP, APART = 9, 80
#: Matching words and their share that make a stretch, alone or as one of two.
STRETCH, DENSE = 6, 0.6


class Seeds:
    """The seeds of some passages: sorted hashes with their passages and positions."""

    def __init__(self, passages: dict[int, str]):
        self.ids, self.words = {}, {}
        self.factors = [np.random.default_rng(7 + k).integers(1, 2**63, len(m), dtype=np.uint64) | np.uint64(1) for k, m in enumerate(MASKS)]
        for item, text in passages.items():
            self.words[item] = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words(text or "")], dtype=np.uint64)
        self.items, self.table = list(self.words), []
        self.stride = np.array([len(w) + APART for w in self.words.values()])
        self.need = np.array([COVER * len(w) for w in self.words.values()])
        for k in range(len(MASKS)):
            rows = [(i, *self.hashes(w, k)) for i, w in enumerate(self.words.values())]
            keys = np.concatenate([np.zeros(0, dtype=np.uint64), *[h for _, _, h in rows]])
            where = np.concatenate([np.zeros((0, 2), dtype=np.int64), *[np.stack([np.full(len(at), i), at], 1) for i, at, _ in rows]])
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 20, dtype=bool)  # which ends of hashes there are: a first look
            seen[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.table.append((keys[order], where[order], seen))

    def hashes(self, tokens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the windows whose selected words are all known."""
        mask = MASKS[k]
        n = len(tokens) - mask[-1]
        if n <= 0:
            return np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
        at = np.arange(n)
        for off in mask:
            at = at[tokens[at + off] > 0]
        h = np.zeros(len(at), dtype=np.uint64)
        for off, f in zip(mask, self.factors[k], strict=True):
            x = (tokens[at + off] + np.uint64(off)) * f
            h = (h ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0x9E3779B97F4A7C15)
        return at, h

    def search(self, texts: list[list[int]]) -> Iterator[tuple[int, int, np.ndarray, set[tuple[int, int]]]]:
        """(text, item, its words, pairs) of passages of which common seeds cover COVER of the words in some region of a text.

        pairs are the (document, passage) positions under the seeds. The texts, given by their words' numbers, stand one
        after the other, with as many unknown words between as no window spans, and are hashed as one.
        """
        gap = max(m[-1] for m in MASKS)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]]) if len(texts) else sizes
        tokens = np.zeros(int(sizes.sum() + gap * len(texts)), dtype=np.uint64)
        if len(tokens):
            tokens[np.repeat(begin - np.concatenate([[0], sizes.cumsum()[:-1]]), sizes) + np.arange(sizes.sum())] = np.concatenate([np.array(t, dtype=np.uint64) for t in texts])
        n_items, hits = max(1, len(self.items)), [np.zeros((0, 4), dtype=np.int64)]
        for k in range(len(MASKS)):
            at, h = self.hashes(tokens, k)
            keys, where, seen = self.table[k]
            new = seen[(h & np.uint64(0xFFFFF)).astype(np.int64)]
            at, h = at[new], h[new]
            low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            n = high - low
            d, w = np.repeat(at, n), where[np.repeat(low - np.concatenate([[0], n.cumsum()[:-1]])[: len(n)], n) + np.arange(n.sum())]
            text = np.searchsorted(begin, d, "right") - 1
            d = d - begin[text]
            hits.append(np.stack([text * n_items + w[:, 0], d, w[:, 1], np.full(len(d), k)], 1))
        hits = np.concatenate(hits)
        # Seeds of less than COVER, were they all apart, are let go before their words are laid out.
        pairs, pair, n = np.unique(hits[:, 0], return_inverse=True, return_counts=True)
        enough = n * max(map(len, MASKS)) >= self.need[pairs % n_items] if len(pairs) else np.zeros(0, dtype=bool)
        hits = hits[enough[pair]]
        rows = [np.zeros((0, 3), dtype=np.int64)]
        for k, mask in enumerate(MASKS):
            own = hits[hits[:, 3] == k]
            rows += [np.stack([own[:, 0], own[:, 1] + o, own[:, 2] + o], 1) for o in mask]
        rows = np.concatenate(rows)
        if not len(rows):
            return
        pairs, pair = np.unique(rows[:, 0], return_inverse=True)
        item = pairs % n_items
        # Regions are as long as the passage may be spread; each row lies in two, so that no passage is cut by a border.
        near = rows[:, 1] // self.stride[item][pair]
        width = int(near.max()) + 2
        cell = np.concatenate([((pair * width + near + shift) << 20) | rows[:, 2] for shift in (0, 1)])
        cell.sort()
        cell = cell[np.append(True, cell[1:] != cell[:-1])] >> 20
        cell, covered = np.unique(cell, return_counts=True)
        cell = cell[covered >= self.need[item][cell // width]]
        kept = np.isin(pair * width + near, cell) | np.isin(pair * width + near + 1, cell)
        rows, pair = rows[kept], pair[kept]
        order = np.argsort(pair, kind="stable")
        rows, pair = rows[order], pair[order]
        for own in np.split(rows, np.nonzero(pair[1:] != pair[:-1])[0] + 1):
            if len(own):
                text, i = divmod(int(own[0, 0]), n_items)
                yield text, self.items[i], tokens[begin[text] : begin[text] + sizes[text]], set(map(tuple, own[:, 1:].tolist()))


def _aligned(doc: np.ndarray, passage: np.ndarray, pairs: set[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Stretches (document start and end, passage start and end, matching words) around the seeded pairs."""
    chains: list[list[tuple[int, int]]] = []
    live: list[list[tuple[int, int]]] = []  # those that the next pair is near enough to
    for d, p in sorted(pairs):
        live = [c for c in live if d - c[-1][0] <= STEP]
        for chain in reversed(live):
            d0, p0 = chain[-1]
            if 0 <= d - d0 <= STEP and 0 <= p - p0 <= STEP and abs((d - d0) - (p - p0)) <= 3 and (d, p) != (d0, p0):
                if d > d0 and p > p0:
                    chain.append((d, p))
                break
        else:
            chains.append([(d, p)])
            live.append(chains[-1])
    out = []
    for chain in chains:
        got = list(chain)
        for (d0, p0), (d1, p1) in zip(chain, chain[1:], strict=False):
            got += [(d0 + x, p0 + x) for x in range(1, min(d1 - d0, p1 - p0)) if doc[d0 + x] == passage[p0 + x]]
        for way, (d, p) in ((-1, chain[0]), (1, chain[-1])):  # on from the outermost seeds, past single other words
            missed = 0
            while missed < 3:
                d, p = d + way, p + way
                if not (0 <= d < len(doc) and 0 <= p < len(passage)):
                    break
                if doc[d] == passage[p]:
                    got.append((d, p))
                    missed = 0
                else:
                    for dd, dp in ((way, 0), (0, way)):  # a word more on either side
                        if 0 <= d + dd < len(doc) and 0 <= p + dp < len(passage) and doc[d + dd] == passage[p + dp] and doc[d + dd] > 0:
                            d, p = d + dd, p + dp
                            got.append((d, p))
                            break
                    missed += 1
        ds, ps = [x for x, _ in got], [x for _, x in got]
        same = len(set(ps))
        if same >= STRETCH and same >= DENSE * (max(ps) - min(ps) + 1) and same >= DENSE * (max(ds) - min(ds) + 1):
            out.append((min(ds), max(ds), min(ps), max(ps), same))
    return out


def contained(doc: np.ndarray, passage: np.ndarray, pairs: set[tuple[int, int]]) -> bool:
    """Whether SHARE of the passage's words stand in one stretch, or in two near each other and in order."""
    found, need = _aligned(doc, passage, pairs), SHARE * len(passage)
    best = max((s[4] for s in found), default=0)
    if best >= need:
        return True
    for a in found:
        for b in found:
            if b[0] > a[1] - 3 and b[0] - a[1] <= APART and b[2] > a[3] - 3 and a[4] + b[4] - max(0, a[3] - b[2] + 1) >= need:
                return True
    return False


def leaked(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id) for each document of documents(doc_id, text) that contains a passage(item_id, passage).

    Fixed masks select token positions, and equal hashes of the selected words seed an alignment that tolerates
    changed and missing words between. Case, accents, punctuation and layout don't count. The passages are the stated
    query set: they go to the executors in blocks of BLOCK characters, each against all documents, so no document moves. Null and
    empty texts and passages with fewer words than a mask contain and are contained in nothing; repeated rows count
    once; of rows that repeat an item_id the longest passage counts.
    """
    items = passages.where("item_id is not null and passage is not null").groupBy("item_id").agg(F.max_by("passage", F.struct(F.length("passage"), "passage")).alias("passage"))
    items = items.orderBy("item_id").toLocalIterator()
    results, block, size = [], {}, 0
    rows = documents.select("doc_id", "text").where("text is not null and doc_id is not null")

    def search(block: dict[int, str]) -> DataFrame:
        sent = documents.sparkSession.sparkContext.broadcast(Seeds(block))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = sent.value
            get = s.ids.get
            for b in batches:
                out, ids, texts, size = [], [], [], 0

                def judged() -> list[tuple]:
                    return [(ids[t], item) for t, item, tokens, pairs in s.search(texts) if contained(tokens, s.words[item], pairs)]  # noqa: B023

                for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                    ids.append(doc_id)
                    texts.append([get(w, 0) for w in words(text)])
                    size += len(texts[-1])
                    if size > CHUNK:
                        out += judged()
                        ids, texts, size = [], [], 0
                out += judged()
                yield pd.DataFrame(out, columns=["doc_id", "item_id"])

        return rows.mapInPandas(part, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id {passages.schema['item_id'].dataType.simpleString()}")

    for row in items:
        block[row["item_id"]] = row["passage"]
        size += len(row["passage"])
        if size >= BLOCK:
            results.append(search(block))
            block, size = {}, 0
    results.append(search(block))
    return reduce(DataFrame.unionAll, results).distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains an evaluation passage: doc_id, item_id."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each evaluation suite, its leaked items, the documents they leaked into, and the pairs of both."""
    found = p9_found(spark, sf_dir).join(table(spark, sf_dir, "eval_passages").select("item_id", "suite").distinct(), "item_id")
    return found.groupBy("suite").agg(F.count_distinct("item_id").alias("n_items"), F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_pairs"))
