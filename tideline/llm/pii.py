"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their scores.

Cards are confirmed by Luhn's sum, account numbers (IBAN) by the remainder modulo 97.  The four base
kinds are always reported; account numbers are added where the checksum holds and the score is reached.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame

from tideline.llm import spans
from tideline.llm.spans import Span

KINDS = ("email", "ip", "card", "phone", "iban")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]\.[0-9]")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")

#: Score before context, for each kind, and the score from which an added span is reported.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.6, "phone": 0.5, "iban": 0.7}
LIMIT = 0.6
NEAR = 40
#: Words that raise (or lower, under "not") the score of a span within NEAR characters.
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "not": ("version", "release", "order", "isbn", "ticket", "example", "build"),
}
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Whether the check digit of a number holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether the two check digits of an account number hold."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ that a domain follows, back over the local part as far as the last match."""
    found, last = [], 0
    for m in DOMAIN.finditer(text):
        at = m.start()
        while at > last and text[at - 1] in LOCAL:
            at -= 1
        if at < m.start():
            found.append((at, m.end()))
            last = m.end()
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers of at most 255; a longer chain is read four by four from its left."""
    found = []
    for m in CHAIN.finditer(text):
        parts = m.group().split(".")
        if len(parts) < 4:
            continue
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((at, end))
            at = end + 1
    return found


def digits_of(said: str) -> str:
    return "".join(c for c in said if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Matches of the four fixed patterns that pass their checks."""
    found: list[Span] = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if DOTTED.search(text):
        found += [(a, 1, b) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return found


def score(text: str, span: Span) -> float:
    """The kind's prior, raised or lowered by the words around the span."""
    a, k, b = span
    around = {w.lower() for w in WORD.findall(text[max(0, a - NEAR) : a] + " " + text[b : b + NEAR])}
    x = PRIOR[KINDS[k]]
    x += 0.3 * bool(around & set(CONTEXT[KINDS[k]])) - 0.3 * bool(around & set(CONTEXT["not"]))
    return min(1.0, max(0.0, x))


def judged_spans(text: str, base: list[Span]) -> list[tuple[Span, float]]:
    """Scores of the base spans, and the account numbers that are confirmed and score enough; digits that also pass as a card do not hide one."""
    ibans = []
    for m in IBAN.finditer(text):
        account = m.group().replace(" ", "")
        # the pattern may run on over a following word; the longest prefix whose checksum holds counts
        for cut in range(len(account), 14, -1):
            if mod97(account[:cut]):
                end, seen = m.start(), 0
                while seen < cut:
                    seen += text[end] != " "
                    end += 1
                if end == m.end() or not text[end].isalnum():
                    ibans.append((m.start(), 4, end))
                    break
    judged = [(s, score(text, s)) for s in base]
    others = [s for s in base if KINDS[s[1]] != "card"]
    return judged + [(s, x) for s in spans.outside(ibans, others) if (x := score(text, s)) >= LIMIT]


def scan_documents(docs: DataFrame, redact: bool = False, doc_id: str = "doc_id", text: str = "text", **more: Column) -> DataFrame:
    """Scans each whole text; see ``spans.scan`` for the columns and for null and empty texts."""
    return spans.scan(docs, base_spans, judged_spans, KINDS, 4, redact=redact, doc_id=doc_id, text=text, **more)
