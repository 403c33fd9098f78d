"""Problem 6: personal information in free text, found at anchors and replaced by typed placeholders."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.session import Cut, table

EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME = TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
#: Name words of the correspondents that are sent to every executor (about 100 bytes each, 10 MB at most); with more,
#: each mail gets its own through a join, with the same result.
MAX_NAMES = 100_000

# Words that announce numbers of personal documents, social security and tax.
ID_CUES = (
    "ssn", "social security", "national insurance", "ni no", "ni number", "nino", "steuer-id", "steueridentifikationsnummer", "steuernummer", "sozialversicherungsnummer",
    "personalausweis", "reisepass", "ausweis", "führerschein", "passport", "identity card", "id card", "identity no", "driving licence", "driver's license", "driver license",
    "driving license", "dni", "nie", "nif", "carné", "pasaporte", "seguridad social", "sécurité sociale", "carte d'identité", "passeport", "permis de conduire", "numéro fiscal",
    "bsn", "burgerservicenummer", "paspoort", "rijbewijs", "cpf", "cartão de cidadão", "passaporte", "segurança social", "tax id", "tax number", "tin", "itin", "taxpayer",
)
# Words of postal addresses, in the languages of the mails.
STREET_CUES = (
    "box ", "postfach", "apartado", " street", " st,", " st.", " road", " rd", " lane", " ave", " avenue", " drive", " court", " way", " row", " close", " blvd", " boulevard", " square", " terrace", " crescent", " hill",
    "rue ", "avenue ", "boulevard ", "place ", "chemin ", "quai ", "impasse ", "allée ", "c/ ", "calle ", "avda", "plaza ", "paseo ", "rua ", "travessa ", "praça ", "straße", "strasse", "str. ", "weg ", "allee", "platz ", "gasse ",
    "ring ", "damm ", "ufer ", "am ", "graben", "straat", "laan ", "plein ", "gracht",
)
# Given names that are also common words, and what may follow one that stands alone.
WORDLIKE = frozenset(
    "will hope mark april grace rose faith joy grant hunter may june august art bill dawn sue pat frank rich jack miles chase victor ivy olive violet ruby amber crystal daisy summer"
    " autumn christian drew dean earl gene glen guy jay lance mason max nick penny ray rob robin sandy skip ted wade ward dale heath iris lily pearl reed roman sage sterling clay".split()
)
TITLES = frozenset("dr mr mrs ms prof professor herr frau mme mlle monsieur madame sr sra señor señora dhr mevr sir".split())
_AFTER = frozenset("and or about und oder et ou y o e en of to via <".split())

_ADDRESS_AT = re.compile(r"[\w.+'-]*[\w+-]@[\w-]+(?:\.[\w-]+)+")
_CALL = re.compile(r"\+?\d[\d ().-]{6,}\d")
_SPELLED = re.compile(r"\s*(?:\[at\]|\(at\)|\{at\}|<at>|\bAT\b|\bat\b)\s*([\w-]+(?:(?:\.|\s*(?:\[dot\]|\(dot\)|\{dot\}|<dot>)\s*|\s+(?:dot|DOT)\s+)[\w-]+)+)")
_PHONE = re.compile(
    r"(?<![\w.,/#+-])(?:\+\d{1,3}[ .-]?(?:\(0\) ?)?(?:\(\d{1,5}\) ?)?\d{1,5}(?:[ ./-]?\d{2,5}){1,5}|00\d{1,3}[ .-](?:\(0\) ?)?\d{1,4}(?:[ ./-]\d{2,5}){1,5}|\(\d{2,5}\) ?\d{2,4}(?:[ .-]?\d{2,4}){1,3}"
    r"|\d{3}([-.])\d{3}\1\d{4}|[2-9]\d{9}|0\d{1,4}(?: \d{2,4}){2,5}|0\d{1,4} \d{5,8}|0\d{2,4}/\d{4,8}(?:-\d{1,4})?)(?: ?(?:ext|extension|x|app|durchwahl|poste)\.? ?\d{1,5})?(?![\w-]|[.,/]\d)",
    re.I,
)
_BREAK, _NUMBER = re.compile(r"[\r\n]"), re.compile(r"\d")
_DIGITS = re.compile(r"[+(\d][\d ()./+-]{7,}")
_ID = re.compile(
    r"(?:[\s.:#=-]|number|num|no|nr|nº|n°|is|card|licen[cs]e|código|lautet|est|es|é){0,8}?(?<![A-Za-z0-9])([A-Z]{2}(?: ?\d\d){3} ?[A-Z]|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{1,3}[- ]?\d{5,9}[- ]?[A-Z]?|\d(?:[ ./-]?\d){5,14}(?:[- ]?[A-Z])?)(?![\w-])"
)
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_CAP = r"[A-ZÀ-Þ][\w'’.-]*"
_CITY = r"[A-ZÀ-Þ][\w'’-]*(?: (?:(?:am|an der|de|del|la|le|sur|upon|on|aan den) )?[A-ZÀ-Þ][\w'’-]*){0,2}"
_POSTAL = re.compile(
    rf"(?<![\w])(?:(?:P\.? ?O\.? Box|Post Office Box|Postfach|Postbus|Apartado(?: de Correos)?|BP|B\.P\.) ?\d+, (?:\d{{4,5}}(?: [A-Z]{{2}})? )?{_CITY}(?: \d{{5}}\b)?"
    rf"|(?:(?:Unit|Flat|Suite|Apt\.?|Apartment|Floor) \w+, )?\d+[A-Za-z]? (?:{_CAP} ){{1,3}}?(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Ave\.?|Avenue|Drive|Dr\.?|Court|Ct\.?|Way|Row|Close|Blvd\.?|Boulevard|Square|Terrace|Crescent|Hill|Place),? {_CITY}(?: (?:[A-Z]{{2}} )?\d{{5}}(?:-\d{{4}})?\b|,? [A-Z]{{1,2}}\d\w? ?\d[A-Z]{{2}}\b)?"
    rf"|\d+(?: ?bis| ?ter)?,? (?:rue|avenue|boulevard|place|chemin|quai|impasse|allée|cours) (?:(?:du|de la|des|de l'|de|d'|l'|la|le|les) ?)?{_CAP}(?: (?:(?:du|de|des|la|le) )?{_CAP}){{0,3}},? \d{{5}} {_CITY}"
    rf"|(?:C/|Calle|Avda\.?|Avenida|Plaza|Paseo|Rua|Travessa|Praça|Largo) ?(?:(?:de la|del|de|da|do|das|dos) )?{_CAP}(?: (?:(?:de|del|da|do) )?{_CAP}){{0,3}},? \d+ ?[A-Za-zºª]?, \d{{4,5}}(?:-\d{{3}})? {_CITY}"
    rf"|(?:(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den|Alte|Alter|Neue|Neuer) )?{_CAP}(?: {_CAP})? \d+ ?[a-z]?, (?:D-)?\d{{5}} {_CITY}"
    rf"|{_CAP}(?:straat|laan|weg|plein|gracht|kade) \d+ ?[a-z]?, \d{{4}} ?[A-Z]{{2}} {_CITY})"
)
_UPPER = "".join(chr(c) for c in range(0x250) if chr(c).isupper()) + "".join(chr(c) for c in range(0x370, 0x530) if chr(c).isupper())
_WORD = re.compile(rf"[{_UPPER}][\w'’]*(?:-[{_UPPER}][\w'’]*)*")
_INITIALS = re.compile(rf"(?:^|[^\w.])([{_UPPER}]\. (?:[{_UPPER}]\. )?)$")


def _forms(word: str) -> set[str]:
    """The forms in which a capitalised word is looked up among names."""
    low = word.lower()
    bare = low.rstrip("'’")
    return {low, bare, bare[:-2] if bare.endswith(("'s", "’s")) else bare}


def _local(text: str, at: int) -> int:
    """Where the local part of an address that ends before ``at`` begins."""
    i = at
    while i and (text[i - 1].isalnum() or text[i - 1] in "_.+-"):
        i -= 1
    while i < at and text[i] == ".":
        i += 1
    return i


class Finder:
    """Finds items in texts, given the correspondents' name words: given names and family names in lower case."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = given, family
        self.anchors = ahocorasick.Automaton()
        for kind, words in (("id", ID_CUES), ("street", STREET_CUES), ("at", ("[at]", "(at)", "{at}", "<at>", " at ")), ("@", ("@",)), ("call", ("tel:", "callto:", "sms:", "fax:"))):
            for w in words:
                self.anchors.add_word(w, (kind, len(w)))
        self.anchors.make_automaton()

    def items(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, type) of every item, in order; of overlapping ones the first of TYPES' parsers keeps its place.

        Null and blank texts have none. Whole texts are searched, each part only near its anchors.
        """
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        taken: list[tuple[int, int, str]] = []
        ids, lines, calls = [], {}, []
        for end, (kind, size) in self.anchors.iter(low):
            at = end + 1 - size
            if kind == "@":
                begin = _local(text, at)
                if begin < at and (m := _ADDRESS_AT.match(text, begin)):
                    taken.append((m.start(), m.end(), EMAIL))
            elif kind == "at":
                stop = at
                while stop and text[stop - 1] == " ":
                    stop -= 1
                begin = _local(text, stop)
                rest = begin < stop and _SPELLED.match(text, stop)
                if rest and (text[at : end + 1].strip() not in ("at",) or re.search(r"\bdot\b|\(dot\)|\[dot\]", rest.group(1))) and "\n" not in rest.group(0):
                    taken.append((begin, rest.end(), EMAIL))
            elif kind == "call":
                if (m := _CALL.match(text, end + 1)) and 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    calls.append((m.start(), m.end(), PHONE))
            elif kind == "id":
                if (at == 0 or not low[at - 1].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum() or low[end + 1].isdigit()):
                    ids.append(end + 1)
            else:
                a = max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1
                lines[a] = 1
        out = self._keep([], taken)
        found = []
        for a in ids:
            if (m := _ID.match(text, a)) and sum(c.isdigit() for c in m.group(1)) >= 5:
                found.append((m.start(1), m.end(1), ID_NUMBER))
        found += [(m.start(), m.end(), ID_NUMBER) for m in _SSN.finditer(text)]
        out = self._keep(out, found)
        found = []
        for a in lines:
            b = _BREAK.search(text, a)
            b = b.start() if b else len(text)
            if _NUMBER.search(text, a, b):
                found += [(m.start(), m.end(), ADDRESS) for m in _POSTAL.finditer(text, a, b)]
        out = self._keep(out, found)
        out = self._keep(out, calls)
        calls = [m for c in _DIGITS.finditer(text) for m in _PHONE.finditer(text, c.start(), c.end() + 22) if m.start() < c.end()]
        out = self._keep(out, [(m.start(), m.end(), PHONE) for m in calls if 8 <= sum(c.isdigit() for c in re.sub(r"(?i)\s*(?:ext|x|app|durchwahl|poste).*", "", m.group())) <= 15])
        out = self._keep(out, self._names(text, out))
        return sorted(out)

    @staticmethod
    def _keep(old: list, new: list) -> list:
        """old, which don't overlap, and those of new that overlap neither them nor one before, in order of place."""
        out, k, last = [], 0, 0
        for s in sorted(set(new), key=lambda x: (x[0], -x[1])):
            while k < len(old) and old[k][1] <= s[0]:
                k += 1
            if s[0] >= last and (k == len(old) or s[1] <= old[k][0]):
                out.append(s)
                last = s[1]
        return sorted([*old, *out])

    def _names(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        out, spans = [], sorted(taken)
        last, k, shown = -1, 0, ("", -1)
        for m in _WORD.finditer(text):
            a, b = m.span()
            if a < last:
                continue
            while k < len(spans) and spans[k][1] <= a:
                k += 1
            if k < len(spans) and spans[k][0] < b:
                continue
            w = m.group().rstrip("'’").lower()
            b = a + len(w)
            if w.endswith(("'s", "’s")):
                w, b = w[:-2], b - 2
            given, family = w in self.given, w in self.family
            prior, shown = shown, (w, b)
            dotted = text[a - 2 : a] == ". "
            if not (given or family or dotted or (prior[0] in TITLES and prior[1] == a - 1)):
                continue
            if a and (text[a - 1].isalnum() or text[a - 1] in "@_"):
                continue
            before = text[max(0, a - 12) : a]
            title = re.search(r"(?:^|[^\w])(\w+)\.? $", before)
            titled = bool(title and title.group(1).lower() in TITLES and title.group(1)[0].isupper())
            initial = dotted and _INITIALS.search(before)
            if not (given or family or titled or initial):
                continue
            after = _WORD.match(text, b + 1) if text[b : b + 1] == " " else None
            nxt = after.group().lower().rstrip("'’") if after else ""
            if nxt.endswith(("'s", "’s")):
                nxt = nxt[:-2]
            if given and nxt in self.family:
                out.append((a, b + 1 + len(nxt), NAME))
            elif family and not given and text[b : b + 2] == ", " and (g := _WORD.match(text, b + 2)) and g.group().lower() in self.given and text[g.end() : g.end() + 1] in ("", "\n", "\r", '"', " ", "<") and a and text[a - 1] in '":\n ' and re.search(r"(?:\"|: )$", before):
                out.append((a, g.end(), NAME))
            elif family and (not given or w not in WORDLIKE):
                begin = a - len(initial.group(1)) if initial and not titled else a
                out.append((begin, b, NAME))
            elif initial and not titled and text[b : b + 1] != "." and len(w) > 2:
                out.append((a - len(initial.group(1)), b, NAME))
            elif titled and len(w) > 1:
                out.append((a, after.end() if after and given else b, NAME))
            elif given:
                if nxt and len(nxt) > 2 and w not in WORDLIKE and nxt not in self.given and text[after.end() : after.end() + 1] in ("", "\n", "\r", " ", ",", "<") and before[-2:] in (": ", "* "):
                    out.append((a, after.end(), NAME))
                elif w not in WORDLIKE or self._alone(text, a, b):
                    out.append((a, b, NAME))
                else:
                    continue
            else:
                continue
            last = out[-1][1]
        return out

    @staticmethod
    def _alone(text: str, a: int, b: int) -> bool:
        """Whether a given name that is also a word stands as a name: no sentence goes on behind it."""
        rest = re.match(r" ?([\w<]*)", text[b : b + 30])
        if text[b : b + 1] == " " and rest.group(1):
            return rest.group(1).lower() in _AFTER or rest.group(1) == "-"
        return True


def name_words(mails: DataFrame) -> DataFrame:
    """(word, given, family): the words of the display names in sender and recipients_json, in lower case, by role."""
    word = r"(\p{Lu}[\w'’-]+)"
    text = F.concat_ws(" ; ", F.col("sender"), F.col("recipients_json"))
    both = [(rf"(?U)(?:^|[\"(;,\s]){word} {word}\\?\"? *(?:<|\))", 1, 2), (rf"(?U){word}, {word}\\?\"? *<", 2, 1)]
    words = []
    for p, given, family in both:
        for group, role in ((given, 1), (family, 0)):
            found_words = F.regexp_extract_all(text, F.lit(p), F.lit(group))
            words.append(F.arrays_zip(F.transform(found_words, F.lower).alias("word"), F.array_repeat(F.lit(role), F.size(found_words)).alias("role")))
    rows = mails.select(F.explode(F.concat(*words)).alias("n"))
    return rows.groupBy("n.word").agg(F.max(F.col("n.role") == 1).alias("given"), F.max(F.col("n.role") == 0).alias("family"))


def _searched(mails: DataFrame, rows: DataFrame, columns: list[str], each: Callable, kind: str) -> DataFrame:
    """each(batch, items) of the batches of rows, where items(i, text) are those of a text in row i of the batch.

    Names are those of the mails' correspondents: sent to all up to MAX_NAMES, with more joined to the rows whose
    columns have them.
    """
    names = name_words(mails)
    bounded = names.limit(MAX_NAMES + 1).collect()
    sent = None
    if len(bounded) <= MAX_NAMES:
        sent = rows.sparkSession.sparkContext.broadcast(tuple("\n".join(sorted(r["word"] for r in bounded if r[role])) for role in ("given", "family")))
    else:
        rows = rows.withColumn("row", F.monotonically_increasing_id())

        def capitals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [sorted({f for c in columns for m in _WORD.finditer(texts[c] or "") for f in _forms(m.group())}) for texts in b[columns].to_dict("records")]
                yield pd.DataFrame({"row": b["row"], "words": found})

        rows = Cut(rows.sparkSession).keep(rows)  # its numbers must not change between the two readings
        caps = rows.select("row", *columns).mapInPandas(capitals, "row long, words array<string>").select("row", F.explode("words").alias("word"))
        roles = caps.join(names, "word").groupBy("row").agg(F.collect_set(F.when(F.col("given"), F.col("word"))).alias("given"), F.collect_set(F.when(F.col("family"), F.col("word"))).alias("family"))
        rows = rows.join(roles, "row", "left").drop("row")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = Finder(*({w for w in words.split("\n") if w} for words in (sent.value if sent else ("", ""))))
        for b in batches:

            def items(i: int, text: str | None) -> list[tuple[int, int, str]]:
                if not sent:
                    g, f = b["given"].iloc[i], b["family"].iloc[i]  # noqa: B023
                    shared.given, shared.family = set(g) if g is not None else set(), set(f) if f is not None else set()
                return shared.items(text)

            yield each(b, items)

    return rows.mapInPandas(part, kind)


def _once(mails: DataFrame, column: str) -> DataFrame:
    """mails with their order among rows of one source_id: the first imported counts, of those the least text's hash."""
    imported = F.unix_micros(F.col("imported_at").cast("timestamp")) if "imported_at" in mails.columns else F.lit(0).cast("long")
    return mails.withColumn("order_at", F.coalesce(imported, F.lit(0).cast("long"))).withColumn("order_by", F.xxhash64(column))


def found(mails: DataFrame, column: str = "body_raw") -> DataFrame:
    """(source_id, starts, ends, types, order_at, order_by) of each row of mails: every item in the column, types counted from 0 in TYPES.

    Names are those of the mails' correspondents, and what follows a title or an initial. Null texts have no items.
    order_at and order_by order rows of one source_id (_once()).
    """

    def each(b: pd.DataFrame, items: Callable) -> pd.DataFrame:
        got = [items(i, text) for i, text in enumerate(b["text"])]
        return pd.DataFrame({"source_id": b["source_id"], "starts": [[s for s, _, _ in x] for x in got], "ends": [[e for _, e, _ in x] for x in got], "types": [[TYPES.index(t) for _, _, t in x] for x in got], "order_at": b["order_at"], "order_by": b["order_by"]})

    rows = _once(mails, column).select("source_id", F.col(column).alias("text"), "order_at", "order_by")
    return _searched(mails, rows, ["text"], each, "source_id string, starts array<int>, ends array<int>, types array<int>, order_at long, order_by long")


def _exploded(items: DataFrame) -> DataFrame:
    rows = items.select("source_id", F.explode(F.arrays_zip("starts", "ends", "types")).alias("i"))
    types = F.array(*map(F.lit, TYPES))
    return rows.select("source_id", F.col("i.starts").alias("start_pos"), F.col("i.ends").alias("end_pos"), types[F.col("i.types")].alias("pii_type"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item in body_raw: source_id, start_pos, end_pos, pii_type."""
    items = found(table(spark, sf_dir, "emails")).groupBy("source_id").agg(F.min_by(F.struct("starts", "ends", "types"), F.struct("order_at", "order_by")).alias("i"))
    return _exploded(items.select("source_id", "i.starts", "i.ends", "i.types"))


def masked(mails: DataFrame) -> DataFrame:
    """source_id, body_raw, sender and recipients_json of each row of mails with a placeholder such as [EMAIL] for each item."""
    columns = ["body_raw", "sender", "recipients_json"]

    def each(b: pd.DataFrame, items: Callable) -> pd.DataFrame:
        def mask(i: int, text: str | None) -> str | None:
            if text is None:
                return None
            out, at = [], 0
            for a, z, kind in items(i, text):
                out += [text[at:a], f"[{kind}]"]
                at = z
            return "".join([*out, text[at:]])

        return pd.DataFrame({"source_id": b["source_id"], **{c: [mask(i, x) for i, x in enumerate(b[c])] for c in columns}})

    return _searched(mails, mails.select("source_id", *columns), columns, each, "source_id string, body_raw string, sender string, recipients_json string")


def p6_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """body_raw, sender and recipients_json of each mail with a placeholder such as [EMAIL] for each item."""
    mails = _once(table(spark, sf_dir, "emails"), "body_raw")
    first = mails.groupBy("source_id").agg(F.min_by(F.struct("body_raw", "sender", "recipients_json"), F.struct("order_at", "order_by")).alias("m"))
    return masked(first.select("source_id", "m.*"))
