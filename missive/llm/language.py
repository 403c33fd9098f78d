"""Problem 10: the language of documents and of each stretch of mixed ones."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missive.functions.ids import valued
from missive.llm.words import WORD
from missive.session import table

# The languages, by family, and the spellings of their labels.
FAMILIES = {"germanic": ("de", "en", "nl"), "romance": ("es", "fr", "pt")}
CODES = ("de", "en", "nl", "es", "fr", "pt")
SPELLINGS = {
    "de": ("de", "deu", "ger", "german", "deutsch"), "en": ("en", "eng", "english", "englisch"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"), "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"), "pt": ("pt", "por", "portuguese", "português", "portugues"),
}
# Common words of each language that its relatives don't have, for corpora that label none of its texts.
COMMON = {
    "de": "und der das nicht ist mit für auf ein eine werden wird auch sich wir", "en": "the and of to is that for with this are was be will you from",
    "nl": "het een van niet zijn voor met aan worden ook wij maar deze naar wordt", "es": "el los las y del una por para con está que se pero como más",
    "fr": "le les des et est dans une pour pas sur avec nous que qui sont", "pt": "o os não uma para com em do da dos das são mas como está",
}
#: Labelled documents of each language that the classifier is fitted on: the bound of its sample.
SAMPLE = 120
DIM, EPOCHS, RATE = 1 << 15, 3, 0.5
#: What a change of language costs against the summed margins of words; words under which a sentence is not sure alone.
SWITCH = 6.0

_PAIRS = [(a, b) for f in FAMILIES.values() for i, a in enumerate(f) for b in f[i + 1 :]]
_END = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+(?=[\"'«“‘(\[¿¡]*[^\W\d_a-zß-öø-ÿ])|[\r\n\v\f]+|(?<=[!?…])\s+|(?<=[.])\s+(?=\d+\s)")


def label_code(c):
    """The code that a label spells, 'other' for labels that name none of CODES, null for no value."""
    s = valued(c)
    base = F.regexp_extract(s, r"^([^\s_\-]+)", 1)
    out = F.when(s.isNotNull(), F.lit("other"))
    for code, names in SPELLINGS.items():
        out = F.when(s.isin(*names) | base.isin(*names), F.lit(code)).otherwise(out)
    return out


def features(word: str) -> np.ndarray:
    """Hashed character n-grams (1 to 4, with ends) and the whole word."""
    w = f"<{word.lower()}>"
    grams = {w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)} | {w}
    return np.array(sorted({zlib.crc32(g.encode()) % DIM for g in grams}), dtype=np.int64)


class Tree:
    """A linear separator of the families, and one for each pair of languages within a family."""

    def __init__(self, weights: np.ndarray, slope: float = 4.0):
        self.weights, self.slope, self.ids = weights, slope, {}
        self.rows = np.zeros((1024, len(weights)))

    def word(self, word: str) -> int:
        """The row of a word's clipped margins."""
        got = self.ids.get(word)
        if got is None:
            f, got = features(word), len(self.ids)
            if got == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[got] = np.clip(self.weights[:, f].sum(1) / np.sqrt(len(f)), -2, 2)
            self.ids[word] = got
        return got

    def margins(self, groups: list[list[str]]) -> np.ndarray:
        """Of each group of words the summed margin of each separator; groups are taken in slices that the words' rows outlive."""
        out, i = [np.zeros((0, len(self.weights)))], 0
        while i < len(groups):
            j, n = i, 0
            while j < len(groups) and (j == i or n + len(groups[j]) <= 100_000):
                n += len(groups[j])
                j += 1
            if n > 100_000:  # one long sentence: its words in slices
                out.append(sum(self._summed([groups[i][k : k + 100_000]]) for k in range(0, n, 100_000)))
            else:
                out.append(self._summed(groups[i:j]))
            i = j
        return np.concatenate(out)

    def _summed(self, groups: list[list[str]]) -> np.ndarray:
        if len(self.ids) > 200_000:
            self.ids.clear()
        get, word = self.ids.get, self.word
        flat = np.array([i if (i := get(w)) is not None else word(w) for g in groups for w in g])
        return np.add.reduceat(self.rows[flat], np.cumsum([0] + [len(g) for g in groups[:-1]]))

    def scores(self, groups: list[list[str]]) -> np.ndarray:
        """Of each group of words a score for each of CODES."""
        return self.scored(self.margins(groups))

    @staticmethod
    def scored(s: np.ndarray) -> np.ndarray:
        """Margins as scores of CODES: the family's margin tells families apart, and only duels within it its languages.

        The leading language of a family has the family's margin, the others what they lose to it in their duels less.
        """
        out = np.zeros((len(s), len(CODES)))
        for sign, family in zip((1, -1), FAMILIES.values(), strict=True):
            duels = []
            for code in family:
                duel = [s[:, 1 + i] if a == code else -s[:, 1 + i] for i, (a, b) in enumerate(_PAIRS) if code in (a, b)]
                duels.append(np.minimum(*duel))
            within = np.stack(duels, 1)
            lead = within - within.max(1)[:, None]
            for k, code in enumerate(family):
                out[:, CODES.index(code)] = sign * s[:, 0] + lead[:, k] / 2
        return out


def fit(texts: list[tuple[str, str]]) -> Tree:
    """Linear support vector machines over (code, sentence), by averaged subgradient steps on the hinge loss.

    Sentences whose label the first fit contradicts are left out of the second, since some labels are wrong. Every
    fifth sentence is held out, and the slope of the confidence is the one that makes its labels likeliest.
    """
    rows, held = [], []
    for k, (code, text) in enumerate(texts):
        if k % 5 == 4:
            held.append((CODES.index(code), WORD.findall(text)))
            continue
        f = [features(w) for w in WORD.findall(text)]
        if len(f) >= 4:
            x = np.concatenate([g for g in f])
            v = np.concatenate([np.full(len(g), 1 / (np.sqrt(len(g)) * len(f))) for g in f])
            rows.append((CODES.index(code), x, v, text))
    tree = Tree(np.zeros((1 + len(_PAIRS), DIM)))
    for turn in (0, 1):
        if turn:
            rows = [r for r in rows if int(tree.scores([WORD.findall(r[3])])[0].argmax()) == r[0]]
        w, total, n = np.zeros((1 + len(_PAIRS), DIM)), np.zeros((1 + len(_PAIRS), DIM)), 0
        order = np.random.default_rng(5)
        for epoch in range(EPOCHS):
            for i in order.permutation(len(rows)):
                code, x, v, _ = rows[i]
                y = np.zeros(1 + len(_PAIRS))
                y[0] = 1 if code < 3 else -1
                for k, (a, b) in enumerate(_PAIRS):
                    y[1 + k] = 1 if CODES[code] == a else -1 if CODES[code] == b else 0
                m = (w[:, x] * v).sum(1)
                for k in np.nonzero((y != 0) & (y * m < 1))[0]:
                    np.add.at(w[k], x, RATE * y[k] * v)
            total += w
            n += 1
        tree = Tree(total / max(n, 1))
    held = [(c, w) for c, w in held if len(w) >= 4]
    if held:
        scores, size = tree.scores([w for _, w in held]), np.array([len(w) for _, w in held])
        best = scores.argmax(1)
        rest = scores.copy()
        rest[np.arange(len(best)), best] = -np.inf
        gap, right = (scores.max(1) - rest.max(1)) / size, best == np.array([c for c, _ in held])
        likely = lambda a: -np.logaddexp(0, np.where(right, -a * gap, a * gap)).sum()
        tree.slope = max((0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0), key=likely)
    return tree


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence: up to sentence marks before a new beginning, and to line ends."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def stretches(text: str, tree: Tree) -> list[tuple[int, int, str, float]]:
    """(start, end, code, confidence) of the longest stretches of whole sentences in one language (stretches_of())."""
    return stretches_of([text], tree)[0]


def stretches_of(texts: list[str], tree: Tree) -> list[list[tuple[int, int, str, float]]]:
    """Of each text (start, end, code, confidence) of the longest stretches of whole sentences in one language.

    The languages of a text's sentences are those whose summed scores, less SWITCH for each change, are highest.
    Sentences without words go with those before them, within a stretch only. The sentences of all texts are scored
    at once.
    """
    places, groups, ends = [], [], [0]
    for text in texts:
        for a, b in sentences(text):
            found = [w for w in WORD.findall(text, a, b) if not w[0].isdigit()]
            if found:
                places.append((a, b))
                groups.append(found)
        ends.append(len(groups))
    scores, size = tree.scores(groups), [len(g) for g in groups]
    first = scores.argmax(1) if groups else np.zeros(0, dtype=np.int64)
    out = []
    for text, x, y in zip(texts, ends, ends[1:], strict=False):
        path = first[x:y]
        if y > x and (path != path[0]).any():  # sentences that agree need no search
            path = _path(scores[x:y])
        done, i = [], x
        while i < y:
            j = i
            while j + 1 < y and path[j + 1 - x] == path[i - x]:
                j += 1
            total, n, k = scores[i : j + 1].sum(0), sum(size[i : j + 1]), int(path[i - x])
            gap = (total[k] - max(v for c, v in enumerate(total) if c != k)) / n
            a, b = places[i][0], places[j][1]
            done.append((a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip()), CODES[k], float(1 / (1 + np.exp(-tree.slope * gap)))))
            i = j + 1
        out.append(done)
    return out


def _path(scores: np.ndarray) -> list[int]:
    best, back = scores[0].copy(), []
    for s in scores[1:]:
        stay, jump = best, best.max() - SWITCH
        back.append(np.where(stay >= jump, np.arange(len(CODES)), best.argmax()))
        best = np.maximum(stay, jump) + s
    path = [int(best.argmax())]
    for come in reversed(back):
        path.append(int(come[path[-1]]))
    return path[::-1]


def _seeded(text) -> Column:
    """The code whose COMMON words a text has most of, null if it has fewer than three of them or as many of another."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"))

    def common(code: str) -> Column:
        return F.struct(F.size(F.filter(words, lambda w: w.isin(*COMMON[code].split()))).alias("n"), F.lit(code).alias("code"))

    counts = F.array(*map(common, CODES))
    order = F.array_sort(counts)
    return F.when((order[5]["n"] >= 3) & (order[5]["n"] > order[4]["n"]), order[5]["code"])


def sample(documents: DataFrame) -> list[tuple[str, str]]:
    """(code, sentence) of at most SAMPLE documents of each language, the first in hash order, whole.

    Documents are those labelled so; of languages that label none, those that _seeded() tells.
    """
    rows = documents.where(F.length("text") > 40).select("doc_id", "text", label_code(F.col("lang")).alias("code"))

    def first(rows: DataFrame) -> list:
        order = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
        chosen = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE)
        return chosen.select("code", "place", "text").orderBy("code", "place").collect()

    got = first(rows.where(F.col("code").isin(*CODES)))
    missing = [c for c in CODES if c not in {r["code"] for r in got}]
    if missing:
        got += first(rows.where("code is null").withColumn("code", _seeded(F.col("text"))).where(F.col("code").isin(*missing)))
    return [(r["code"], r["text"][a:b]) for r in got for a, b in sentences(r["text"])]


def languages(documents: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos, lang_code, confidence, declared): every stretch of documents(doc_id, text, lang).

    Whole texts are read; offsets count code points. declared is the code the label spells, 'other' for another
    language, null for no value. Null texts and texts without words give no row. The classifier, a fixed 2 MB, is
    fitted on a bounded sample of the documents themselves unless given (sample()); where no document is labelled or
    has enough common words to learn from, the result is an error, not a guess.
    """
    if tree is None:
        texts = sample(documents)
        if not texts and not documents.where(F.length("text") > 40).isEmpty():
            raise ValueError("no document is labelled or tells its language by common words: give a fitted tree")
        tree = fit(texts)
    sent = documents.sparkSession.sparkContext.broadcast((tree.weights.astype(np.float32), tree.slope))
    rows = documents.select("doc_id", "text", label_code(F.col("lang")).alias("declared")).where("text is not null")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Tree(*sent.value)
        for b in batches:
            found, at, texts = [], 0, b["text"].tolist()
            while at < len(texts):  # about a million characters at once
                to, n = at, 0
                while to < len(texts) and (to == at or n + len(texts[to]) <= 1_000_000):
                    n += len(texts[to])
                    to += 1
                found += stretches_of(texts[at:to], t)
                at = to
            out = [(d, *s, said) for d, f, said in zip(b["doc_id"], found, b["declared"], strict=True) for s in f]
            yield pd.DataFrame(out, columns=["doc_id", "start_pos", "end_pos", "lang_code", "confidence", "declared"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(part, f"doc_id {kind}, start_pos int, end_pos int, lang_code string, confidence double, declared string")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of documents with a missing or wrong label, or several languages."""
    found = languages(table(spark, sf_dir, "documents")).distinct()
    whole = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("lang_code").alias("one"), F.first("declared").alias("said"))
    wrong = whole.where("n > 1 or said is null or said <> one").select("doc_id")
    return found.join(wrong, "doc_id", "left_semi").select("doc_id", "start_pos", "end_pos", "lang_code")


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language by characters, with a confidence, and how many stretches it has."""
    found = languages(table(spark, sf_dir, "documents")).distinct().withColumn("size", F.col("end_pos") - F.col("start_pos"))
    by = found.groupBy("doc_id", "lang_code").agg(F.sum("size").alias("size"), F.count("*").alias("n"), (F.sum(F.col("confidence") * F.col("size")) / F.sum("size")).alias("confidence"))
    return by.groupBy("doc_id").agg(F.max_by("lang_code", F.struct("size", "lang_code")).alias("lang_code"), F.max_by("confidence", F.struct("size", "lang_code")).alias("confidence"), F.sum("n").alias("n_stretches"))
