"""Mail files: single messages, maildirs and mbox archives."""

from __future__ import annotations

import email
import email.policy
import email.utils
import hashlib
import re
from collections.abc import Iterator
from datetime import timezone
from html.parser import HTMLParser

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = (
    "source_path string, email_id string, message_id string, reference_ids array<string>, in_reply_to array<string>, subject string, sender string, recipients array<string>, cc array<string>,"
    " sent_at string, body string, attachment_names array<string>, body_digest string, parser_defect_count int"
)
_BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "blockquote", "pre", "hr"}
_HIDDEN = {"script", "style", "head", "title"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _HIDDEN
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in _HIDDEN and self.hidden > 0
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


_FROM = b"\nFrom "
_QUOTED_FROM = re.compile(rb"(?m)^>(>*From )")


def html_text(page: str) -> str:
    """The shown text of a page: blocks on lines of their own, runs of blank lines as one, scripts and styles left out."""
    reader = _Text()
    reader.feed(page)
    reader.close()
    lines = [re.sub(r"[ \t\xa0]+", " ", x).strip() for x in "".join(reader.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _ids(values: list[str]) -> list[str]:
    found = [x.strip("<>").casefold() for v in values for x in re.findall(r"<[^<>\s]+>|[^<>\s,]+@[^<>\s,]+", v)]
    return list(dict.fromkeys(found))


def _people(values: list[str]) -> list[str]:
    return list(dict.fromkeys(email.utils.formataddr(x) for x in email.utils.getaddresses(values) if any(x)))


def parse_message(raw: bytes, path: str) -> dict:
    """One message (RFC 822) as a row of MESSAGE.

    Plain text is preferred to HTML; attachments count by name only, each once. X-From, X-To and X-cc stand in for
    missing addresses. sent_at is ISO in UTC, null where the date can't be read. email_id digests the message id and
    the body, or the path where there is no id.
    """
    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    head = lambda *names: [str(email.header.make_header(email.header.decode_header(v))) for n in names for v in m.get_all(n, [])]
    plain, pages, names, defects = [], [], [], len(m.defects)
    for part in m.walk():
        defects += len(part.defects) if part is not m else 0
        if part.is_multipart():
            continue
        name = part.get_filename()
        if name or part.get_content_disposition() == "attachment":
            names.append(name or "unnamed")
        elif part.get_content_type() in ("text/plain", "text/html"):
            data = part.get_payload(decode=True) or b""
            try:
                s = data.decode(part.get_content_charset() or "utf-8")
            except (LookupError, UnicodeDecodeError):
                s = data.decode("latin-1")
                defects += 1
            (plain if part.get_content_type() == "text/plain" else pages).append(s)
    body = "\n".join(plain) if plain else html_text("\n".join(pages))
    try:
        at = email.utils.parsedate_to_datetime((m.get("Date") or "").strip())
        sent = (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).isoformat()
    except (ValueError, TypeError, IndexError):
        sent = None
    mid = (_ids(head("Message-ID")) or [""])[0]
    digest = hashlib.sha256(body.encode("utf-8", "replace")).hexdigest()
    return {
        "source_path": path, "email_id": hashlib.sha256("\0".join(["id", mid, digest] if mid else ["path", path, digest]).encode("utf-8", "replace")).hexdigest()[:24], "message_id": mid,
        "reference_ids": _ids(head("References")), "in_reply_to": _ids(head("In-Reply-To")), "subject": (head("Subject") or [""])[0], "sender": (_people(head("From")) or head("X-From") or [""])[0],
        "recipients": _people(head("To")) or head("X-To"), "cc": _people(head("Cc")) or head("X-cc"), "sent_at": sent, "body": body, "attachment_names": list(dict.fromkeys(names)), "body_digest": digest, "parser_defect_count": defects,
    }


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([parse_message(bytes(c), p) for p, c in zip(b["path"], b["content"], strict=True)], columns=[c.split()[0] for c in MESSAGE.split(", ")])


def read_messages(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every file below ``path`` whose name fits ``pattern`` as a message; a maildir is read with ``*``. Files are read whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(_parse, MESSAGE)


def _messages_from(path: str, start: int, end: int) -> Iterator[bytes]:
    """The messages of an mbox archive that begin at bytes start to end, without their From lines."""
    filesystem, name = pa_fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    with filesystem.open_input_file(name) as f:
        at = max(0, start - 1)  # a message begins behind a line end, which may be the byte before
        f.seek(at)
        held, begin, open_at = b"\n" if start == 0 else b"", at - (start == 0), None
        while True:
            more = f.read(1 << 20)
            held += more
            last = len(held) if not more else max(0, len(held) - len(_FROM) + 1)
            look = 0 if open_at is None else open_at - begin
            while (k := held.find(_FROM, look, None if not more else last + len(_FROM) - 1)) >= 0:
                if open_at is not None:
                    yield held[open_at - begin : k + 1]
                if begin + k + 1 >= end:
                    return
                open_at = begin + k + 1
                look = k + 1
            if not more:
                if open_at is not None:
                    yield held[open_at - begin :]
                return
            drop = (last if open_at is None else open_at - begin) if len(held) > len(_FROM) else 0
            held, begin = held[drop:], begin + drop


def read_mbox(spark: SparkSession, path: str, block: int = 64 << 20, most: int | None = None) -> DataFrame:
    """Messages of mbox archives, split at From lines; quoted From lines (>From) lose one mark. Bytes are kept as they are.

    Each task reads the messages that begin in one block of an archive, so that large archives are split among tasks.
    ``most``, if given, is how many messages of all are read, those of the first archives by path.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long"))).alias("start"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, start in zip(b["path"], b["start"], strict=True):
                found = []
                for k, raw in enumerate(_messages_from(p, int(start), int(start) + block)):
                    found.append((p, int(start), k, _QUOTED_FROM.sub(rb"\1", raw.partition(b"\n")[2])))
                    if len(found) == 1000:
                        yield pd.DataFrame(found, columns=["path", "start", "k", "content"])
                        found = []
                yield pd.DataFrame(found, columns=["path", "start", "k", "content"])

    rows = ranges.repartition("path", "start").mapInPandas(part, "path string, start long, k int, content binary")
    rows = rows if most is None else rows.orderBy("path", "start", "k").limit(most)
    return rows.select("path", "content").mapInPandas(_parse, MESSAGE)
