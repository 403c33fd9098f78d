"""Words as the text operators compare them."""

from __future__ import annotations

import re
import unicodedata

WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"[̀-ͯ]")


def folded(text: str) -> str:
    """Compatibility forms composed, case folded, accents and soft hyphens removed; ASCII text only changes case."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.replace("­", "").replace("​", "")).casefold()
    return _MARKS.sub("", text)


def words(text: str) -> list[str]:
    return WORD.findall(folded(text))
