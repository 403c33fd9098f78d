"""The parts of a mail body, line by line: quoting, headers, closings and notices by their form."""

from __future__ import annotations

import re

OWN, QUOTED, CLOSING = 0, 1, 2
LINE = re.compile(r"\r\n|\r|\n")

_PREFIX = re.compile(r"\s*(?:(?:[A-Z]{1,3}>|[>|])[ \t]?)+")
_ADDRESS = r"[\w.+'-]+@[\w-]+(?:\.[\w-]+)+"
_TABLE = re.compile(r"\|.*\|.*\|")
# Lines that introduce an earlier message, in the languages of mail programs.
_INTRO = re.compile(
    rf"(?:on\b.{{6,120}}\b(?:wrote|writes)\s?:|am\b.{{6,100}}\bschrieb\b.{{0,100}}:|le\b.{{6,120}}\ba [ée]crit\s?:|el\b.{{6,120}}\bescribi[óo]\s?:"
    rf"|em\b.{{6,120}}\bescreveu\s?:|op\b.{{6,100}}\bschreef\b.{{0,100}}:|il\b.{{6,120}}\bha scritto\s?:|.{{2,90}}<{_ADDRESS}>\s+(?:writes|wrote|schrieb|a [ée]crit|escribi[óo]|escreveu|schreef)\s?:"
    rf"|.{{2,80}}\bsaid the following on\b.{{4,40}}:|\*\s.{{2,60}}\[\d{{4}}-\d\d-\d\d \d\d?:\d\d\]:|.{{2,80}}\b(?:writes|wrote):)$",
    re.I,
)
_DATED = re.compile(rf"\d{{4}}|\d\d?[/.]\d\d?|<{_ADDRESS}>|said the following")
_RULER = re.compile(
    r"(?:-{2,}|_{5,}|\*{3,}|={3,})?\s*(?:begin forwarded message|(?:original|forwarded) (?:message|by\b.{1,60})|message d'origine|message transf[ée]r[ée]|urspr[üu]ngliche nachricht|weitergeleitete nachricht|mensaje (?:original|reenviado)"
    r"|mensagem (?:original|encaminhada)|oorspronkelijk bericht|doorgestuurd bericht)\s*:?\s*-*$",
    re.I,
)
# Header fields as mail programs write them above an earlier message.
_FIELDS = {
    "from": ("from", "von", "de", "van", "da", "expéditeur"), "sent": ("sent", "date", "gesendet", "datum", "envoyé", "enviado", "enviado el", "fecha", "data", "verzonden"),
    "to": ("to", "an", "à", "para", "aan", "pour"), "cc": ("cc", "kopie", "copie à"), "subject": ("subject", "betreff", "objet", "asunto", "assunto", "onderwerp", "re"),
}
_FIELD = {name: kind for kind, names in _FIELDS.items() for name in names}
_HEADER = re.compile(r"\*?([A-Za-zÀ-ÿ]+(?: [a-zà-ÿ]+)?)\s?:\*?(?:\s|$)")
_LOTUS_DATE = re.compile(r"\d\d?/\d\d?/\d{2,4} \d\d?:\d\d(?::\d\d)?(?: ?[AP]M)?(?: \w+)?$", re.I)
_RULE = re.compile(r"(?:-{2,3}|_{5,}|~{4,}|={4,}|\*{4,}|-{5,})\s*$")
# Closing formulas that stand on a line of their own.
_CLOSE = re.compile(
    r"(?:(?:kind|best|warm|warmest|kindest|with kind|with best)? ?regards|best(?: wishes)?|many thanks|thanks(?: again| a lot)?|thank you|cheers|sincerely|yours(?: sincerely| truly| faithfully)?|all the best|take care"
    r"|mit freundlichen gr[üu](?:ß|ss)en|(?:viele|beste|liebe|freundliche|herzliche|sch[öo]ne) gr[üu](?:ß|ss)e|gru(?:ß|ss)|vielen dank|danke|mfg|cordialement|bien cordialement|bien [àa] vous|salutations|merci(?: d'avance)?|bonne journ[ée]e"
    r"|(?:un )?saludos?(?: cordial(?:es)?)?|atentamente|gracias|un abrazo|atenciosamente|cumprimentos|melhores cumprimentos|com os melhores cumprimentos|obrigad[oa]|abra[çc]os?|met vriendelijke groet(?:en)?|vriendelijke groet(?:en)?|groet(?:en|jes)?|hartelijke groet(?:en)?|bedankt|alvast bedankt)[,.!]?\s*$",
    re.I,
)
# Words that open a mail.
_GREETING = frozenset("hi hello hey dear hallo liebe lieber sehr guten bonjour salut cher chère hola buenos estimado estimada querido querida olá caro cara prezado prezada bom beste geachte dag".split())
_INITIAL = re.compile(r"[-–—]\s?[A-ZÀ-Þ][\w'’.-]*(?: [A-ZÀ-Þ][\w'’.-]*){0,2}$")
_NAME = re.compile(r"(?:[A-ZÀ-Þ][\w'’-]*\.?|von|van|de|der|da|dos|el)(?: (?:[A-ZÀ-Þ][\w'’-]*\.?|von|van|de|der|da|dos|el)){0,3}$")
_CONTACT = re.compile(rf"(?:tel|phone|mobile|cell|fax|tél|telefon|teléfono|telefone)\b\.?:?|{_ADDRESS}|(?:\+|00|\(\d)\d[\d\s()./-]{{6,}}|\d[\d\s()./-]{{8,}}\d|\s[|*]\s|^https?://|^www\.", re.I)
_PLACE = re.compile(r"\d{4,5}\b|P\.?O\.? ?Box|\b(?:Street|Road|Lane|Way|Ave|Row)\b|stra(?:ß|ss)e|weg\b|allee\b|rue\b|^C/|Calle", re.I)
# Footers of devices and lists, and the wording of legal notices.
_FOOTER = re.compile(
    r"(?:sent from (?:my|a)\b.{0,60}$|sent (?:via|by|with) .{2,30}$|get outlook for|von unterwegs gesendet|von meinem .{2,30} gesendet|gesendet (?:von|mit|aus) |envoy[ée] (?:de|depuis) mon |enviado (?:desde|do|de) m(?:i|eu) |verzonden (?:vanaf|met|van) "
    r"|to unsubscribe|unsubscribe\b|this is an automat|please do not reply|you (?:are receiving|received) this (?:mail|message|because)|list (?:info|archive)|_{5,}.*mailing list)",
    re.I,
)
_NOTICE = re.compile(
    r"(?:^\W*(?:confidential(?:ity)?(?: notice)?|notice|disclaimer)\s?:|this (?:message|e-?mail|mail) (?:and|is|may|contains)\b.{0,60}\b(?:confidential|files|privileged|intended|addressee)|takes no liability|gives no warranty|received (?:it|this).{0,20} (?:by mistake|in error)"
    r"|consider (?:whether you need this on paper|the environment)|ist vertraulich und nur|haftet nicht f[üu]r|peut contenir des informations|toute diffusion|intended (?:reader|recipient)|legally privileged|es confidencial y|este (?:mensaje|correo) (?:es|puede|y)\b|esta mensagem (?:é|pode)|dit bericht (?:is|kan)\b.{0,40}vertrouwelijk)",
    re.I,
)
#: Words of which every notice has one: a cheap look before the pattern.
_NOTICE_KEYS = ("confiden", "notice", "disclaimer", "privileged", "liability", "warranty", "by mistake", "in error", "on paper", "the environment", "vertraulich", "haftet", "contenir", "diffusion", "intended", "addressee", "mensaje", "correo", "mensagem", "vertrouwelijk")
_SENTENCE = re.compile(r"[.!?][\"')\]]*$")


def _is_header_block(lines: list[str], i: int) -> int:
    """Lines of the header block of an earlier message that begins at line i, 0 if none does."""
    kinds, n, j = set(), 0, i
    if not (":" in lines[i][:24] or (i + 1 < len(lines) and lines[i + 1][:1].isdigit() and len(lines[i]) < 60)):
        return 0
    if i + 1 < len(lines) and _NAME.match(lines[i]) and _LOTUS_DATE.match(lines[i + 1]):
        kinds, j = {"from", "sent"}, i + 2
    while j < len(lines) and j < i + 14:
        m = _HEADER.match(lines[j])
        kind = _FIELD.get(m.group(1).lower()) if m else None
        if kind:
            kinds.add(kind)
        elif not lines[j] or not (n and (lines[j][:1] in " \t<" or "@" in lines[j])):
            break
        n += 1
        j += 1
    return j - i if "from" in kinds and len(kinds) >= 3 else 0


def split(body: str | None) -> list[str]:
    """The lines of a body; CRLF, CR and LF each end one."""
    return LINE.split(body or "") if "\r" in (body or "") else (body or "").split("\n")


def parts(body: str) -> list[tuple[str, int]]:
    """(line without quote marks, OWN, QUOTED or CLOSING) of each line; CRLF, CR and LF each end one.

    Signatures run from their separator or closing formula, or from a name before contact lines, to the blank line
    or quotation behind them. Null bodies have no lines.
    """
    raw = split(body)
    n = len(raw)
    marks = [_PREFIX.match(x) if ">" in x or "|" in x else None for x in raw]
    bare = [(x[m.end() :] if m else x).strip() for x, m in zip(raw, marks, strict=True)]
    kind = [OWN] * n
    quoted = [bool(m) for m in marks]
    # A single marked line that nothing introduces, or a row of a table, is the sender's own.
    marked = [i for i in range(n) if quoted[i]]
    for i in marked:
        if _TABLE.match(raw[i].strip()) and not _PREFIX.match(bare[i]):
            quoted[i] = not (raw[i].lstrip()[0] == "|" and bare[i].count("|") >= 1)
    i = 0 if marked else n
    introduced = False
    while i < n:
        if not quoted[i]:
            introduced = introduced and not bare[i] or bare[i].endswith(":")
            i += 1
            continue
        j = i
        while j < n and (quoted[j] or (not raw[j].strip() and j + 1 < n and quoted[j + 1])):
            j += 1
        run = [k for k in range(i, j) if bare[k]]
        if len(run) == 1 and j - i == 1 and not introduced and raw[i].lstrip()[:1] == ">" and re.match(r"\d", bare[i]):
            quoted[i] = False
        introduced = True
        i = j
    # A line that a mailer wrapped off a marked one has lost its mark.
    for i in range(1, n - 1) if marked else ():
        if not quoted[i] and bare[i] and quoted[i - 1] and bare[i - 1] and marks[i + 1] and not re.search(r"[.!?:,–-]$", bare[i - 1]) and len(bare[i - 1]) > 20:
            quoted[i] = True
    text = [b if not q else "" for b, q in zip(bare, quoted, strict=True)]
    for i in range(n):
        if quoted[i]:
            kind[i] = QUOTED
    i = 0
    while i < n:
        if quoted[i] or not text[i]:
            i += 1
            continue
        s = text[i]
        if (s[0] in "-BbFfOoUuWwMmDd" and len(s) < 90 and _RULER.match(s)) or (s[:5] == "_____" and i + 1 < n and _is_header_block(text, i + 1)) or _is_header_block(text, i):
            for k in range(i, n):  # an earlier message without marks goes on to the end
                kind[k] = QUOTED
            break
        two = s + " " + text[i + 1] if i + 1 < n and text[i + 1][-1:] == ":" and not _SENTENCE.search(s) else ""
        if s[-1] == ":" and _INTRO.match(s) and _DATED.search(s):
            last = i
        elif two and _INTRO.match(two) and _DATED.search(two) and len(text[i + 1]) < 90 and re.match(r"(?:on|am|le|el|em|op|il)\b.*\d", text[i], re.I):
            last = i + 1
        else:
            i += 1
            continue
        for k in range(i, last + 1):
            kind[k] = QUOTED
        after = next((k for k in range(last + 1, n) if raw[k].strip()), n)
        if after < n and not quoted[after]:
            for k in range(last + 1, n):
                kind[k] = QUOTED
            break
        i = last + 1
    own = [k for k in range(n) if kind[k] == OWN and text[k]]
    _close(text, kind, own)
    return list(zip(bare, kind, strict=True))


def _close(text: list[str], kind: list[int], own: list[int]) -> None:
    """Marks signatures, footers and notices among the own lines."""
    whole = "\n".join([text[i] for i in own]).lower()
    keys = [k for k in _NOTICE_KEYS if k in whole]
    for i in own:
        low = text[i].lower()
        if (low[0] in "stugevy_lp" and _FOOTER.match(text[i])) or (keys and any(k in low for k in keys) and _NOTICE.search(text[i])):
            kind[i] = CLOSING
    at = 0
    while at < len(own):
        i = own[at]
        if kind[i] != OWN:
            at += 1
            continue
        block = _block(text, i, own[at + 1 : at + 9]) if len(text[i]) <= 70 else []
        if block:
            for k in block:
                kind[k] = CLOSING
        at += 1
    for i in own:  # rules around what closes
        if kind[i] == OWN and text[i][0] in "-_~=*" and _RULE.match(text[i]):
            kind[i] = CLOSING


def _short(s: str) -> bool:
    return len(s) <= 70 and not _SENTENCE.search(s)


def _block(text: list[str], i: int, later: list[int]) -> list[int]:
    s = text[i]
    if s[0] in "-_~=" and _RULE.match(s):
        out, prev = [i], i
        for k in later:
            if k - prev > 1 or not (_short(text[k]) or _CONTACT.search(text[k])):
                break
            out.append(k)
            prev = k
        return out if len(out) > 1 else []
    if len(s) <= 45 and _CLOSE.match(s):
        out, prev = [i], i
        for k in later:
            gap = 2 if len(out) == 1 else 1
            if k - prev > gap or not (_NAME.match(text[k]) or _RULE.match(text[k]) or (len(out) > 1 and (_short(text[k]) or _CONTACT.search(text[k])))):
                break
            out.append(k)
            prev = k
        return out if len(out) > 1 or not later else []
    if s[0] in "-–—" and _INITIAL.match(s):
        return [i]
    if _NAME.match(s) and s[-1] != "." and later and later[0] - i == 1 and len(s.split()) >= 2 and s.split()[0].lower() not in _GREETING:
        out, prev = [i], i
        contact = False
        for k in later:
            if k - prev > 1 or not (_short(text[k]) or _CONTACT.search(text[k])):
                break
            contact = contact or bool(_CONTACT.search(text[k]) or (text[k][0] == "=" and _RULE.match(text[k])) or _PLACE.search(text[k]) or re.search(r"[|,-] [A-ZÀ-Þ]", text[k]))
            out.append(k)
            prev = k
        return out if contact else []
    return []
