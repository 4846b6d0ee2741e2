"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, scheme separators and
identifier cues.  From each anchor a local parser expands to the boundaries of what it may be part of
and validates it.  The parsers only look at characters that can belong to their kind, so the
result is that of a search over the whole text, and a text without anchors costs the one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelight.llm import words

#: In the order in which spans are listed; the first four are found as their patterns say.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")

# Patterns of the base kinds, by what follows the anchor.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
IP_RUN = re.compile(r"[0-9.]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
CARD_RUN = re.compile(r"[0-9\x20-]+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEMES = ("http", "https", "ftp", "ftps", "sftp", "ssh", "ws", "wss")
URL_REST = re.compile(r"[^\s<>\"'`|\\^{}]+")
#: Words that announce an identifier, by what is checked.
CUES = {
    "account": ("account", "acct", "customer no", "konto", "cuenta", "compte"),
    "iban": ("iban",),
    "swift": ("swift",),
    "secret": ("token", "secret", "password", "passwd", "api_key", "api-key", "api key", "apikey", "bearer"),
}
# Between a cue and its identifier: a word, a separator and a quote, with any run of blanks.  Runs are not given back.
_WORD = r"(?i:numbers?|nummer|n[uú]mero|num[eé]ro|code|no\.?|nr\.?|n[°º]|id|key)"
GAP = rf"[.\"']?\s*+(?:-?{_WORD}[.\"']?\s*+)?(?:[:=#]\s*+)?[\"']?"
RUN = re.compile(rf"{GAP}([A-Za-z0-9][A-Za-z0-9_-]{{5,}})")
GROUPS = re.compile(rf"{GAP}((?=[A-Za-z]*[0-9])[A-Za-z0-9]{{1,6}}(?:[ -][0-9]{{1,6}}(?![A-Za-z0-9_]))+)")
IBAN = re.compile(rf"{GAP}([A-Z]{{2}}[0-9]{{2}}(?:[ -]?[A-Z0-9]){{11,32}}|[a-z]{{2}}[0-9]{{2}}(?:[ -]?[a-z0-9]){{11,32}})(?![A-Za-z0-9])")
BIC = re.compile(rf"{GAP}([A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?)(?![A-Za-z0-9_])")
SECRET = re.compile(r"[\"']?\s*+[:=]\s*+[\"']?([^\s\"'`<>,;&]+)")


_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _folded(text: str) -> str:
    """``text`` with cues in lower case and every place where it was."""
    lower = text.lower()
    return lower if len(lower) == len(text) else text.translate(_ASCII_LOWER)


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for digit in "0123456789":
        out.add_word(digit, "digit")
    out.add_word("@", "at")
    out.add_word("+", "plus")
    out.add_word("://", "scheme")
    for kind, cues in CUES.items():
        for cue in cues:
            out.add_word(cue, kind)
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_end(value: str) -> int:
    """Length of the longest beginning of whole groups that passes mod 97, with 15 to 34 characters besides blanks and hyphens; else 0."""
    found = n = rest = 0
    head = ""
    for i, c in enumerate(value):
        if c in " -":
            continue
        n += 1
        if n > 34:
            break
        digits = str(int(c, 36))
        if n <= 4:
            head += digits
        else:
            rest = (rest * 10 ** len(digits) + int(digits)) % 97
        if n >= 15 and (i + 1 == len(value) or value[i + 1] in " -") and (rest * 10 ** len(head) + int(head)) % 97 == 1:
            found = i + 1
    return found


def find_account(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """Place of the identifier that follows a cue which ends before ``at``."""
    m = IBAN.match(text, at)
    if m and (n := iban_end(m[1])):
        return m.start(1), m.start(1) + n
    if cue == "iban":
        return None
    if cue == "swift" and (m := BIC.match(text, at)):
        return m.span(1)
    if cue == "secret" and (m := SECRET.match(text, at)):
        secret = m[1].rstrip(".:!?)]}")
        if len(secret) >= (8 if secret.isalpha() else 6):
            return m.start(1), m.start(1) + len(secret)
    forms = [m for form in ((GROUPS, RUN) if cue == "account" else (RUN,)) if (m := form.match(text, at))]
    m = max(forms, key=lambda m: m.end(1), default=None)
    if m and sum(c in "0123456789" for c in m[1]) >= 4 and len(m[1].replace(" ", "")) >= 6:
        return m.span(1)
    return None


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind in the order of KINDS, then start; places are code points, ends exclusive."""
    found: dict[str, list[tuple[int, int]]] = {}
    done = dict.fromkeys(KINDS, 0)  # everything of a kind before this place is settled

    def add(kind: str, start: int, end: int) -> None:
        found.setdefault(kind, []).append((start, end))

    for at, anchor in automaton.iter(_folded(text)):
        if anchor == "digit":
            # The first digit of a run: all matches of the run are found at once.
            if at >= done["ip"]:
                done["ip"] = IP_RUN.match(text, at).end()
                for m in IP.finditer(text, at, done["ip"]):
                    if all(len(part) <= 3 and int(part or 0) <= 255 for part in (x.lstrip("0") for x in m[0].split("."))):
                        add("ip", m.start(), m.end())
            if at >= done["card"]:
                done["card"] = CARD_RUN.match(text, at).end()
                for m in CARD.finditer(text, at, done["card"]):
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        add("card", m.start(), m.end())
        elif anchor == "at":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL_PART:
                start -= 1
            m = DOMAIN.match(text, at + 1) if start < at else None
            if m:
                add("email", start, m.end())
                done["email"] = m.end()
        elif anchor == "plus":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    add("phone", m.start(), m.end())
        elif anchor == "scheme":
            first = at - 2
            start = first
            while start > done["url"] and start > first - 8 and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            m = URL_REST.match(text, at + 1)
            if text[start:first].lower() in SCHEMES and m:
                end = at + 1 + len(m[0].rstrip(".,;:!?)]"))
                if end > at + 1:
                    add("url", start, end)
                    done["url"] = end
        else:
            # A cue within an identifier that is found announces none.
            place = find_account(text, at + 1, anchor) if at >= done["account"] else None
            if place:
                add("account", *place)
                done["account"] = place[1]
    return [(kind, *span) for kind in KINDS for span in sorted(found.get(kind, ()))]


def personal_data(block: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of ``block`` (doc_id, content); ``spans`` are (kind, start, end).

    Emails, ip addresses, cards (16 to 19 digits that pass Luhn) and phones (8 to 15 digits) are leftmost and
    do not overlap within a kind; what fails its check is dropped and not searched again.  The method adds urls
    and account identifiers after a cue, any run of blanks and a word such as "number" between them: IBANs in groups or
    not, of whole groups that pass mod 97 (what follows an IBAN cue and does not pass is dropped); bank codes of 8 or 11
    capitals and digits after "swift"; after "token", "password" and the like with a colon or equals sign the text up to
    a blank, quote, comma, semicolon or ampersand, of 6 characters, or 8 if it is letters only; and runs of 6 characters
    with 4 digits, after an account cue also groups of at most 6 characters joined by single blanks or hyphens.
    Whole content counts; places are code points, ends exclusive, spans are
    listed by kind and start.  Null, empty and other content without personal data has an empty list.  Repeated
    rows repeat.  An empty block gives no rows.  Further columns of ``block`` are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(text.as_py() or "", automaton)]
                     for text in words.column(batch, "content")]
            yield pa.RecordBatch.from_arrays([words.column(batch, "doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return block.select("doc_id", "content").mapInArrow(
        search, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def listed(spans: str, *kinds: str) -> str:
    """SQL that joins spans, of the given kinds if any, as kind:start:end."""
    if kinds:
        spans = f"filter({spans}, x -> x.kind IN ({', '.join(map(repr, kinds))}))"
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def counted(kind: str) -> Column:
    """Number of spans of a kind."""
    return F.expr(f"cast(size(filter(spans, x -> x.kind = '{kind}')) AS LONG)").alias(f"n_{kind}")
