"""Personal data by anchor expansion: an Aho-Corasick pass finds anchors, local parsers expand them.

The automaton looks for at-signs, plus-signs, digits, schemes and identifier cues in one pass over the
whole text.  From each anchor a deterministic parser walks to the boundaries of the value and validates
it.  The base kinds (email, ip, card, phone) have the spans of the leftmost non-overlapping matches of
fixed grammars; the cued kinds (account, address) come beside them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address")
SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,stop:int>>"

#: What the automaton looks for.
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:", "sip:")
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "swift", "bic", "passport", "ssn")

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = frozenset("0123456789")
_LOCAL = frozenset(_LETTERS + "0123456789._%+-")
_LABEL = frozenset(_LETTERS + "0123456789-")
_DIAL = frozenset("0123456789 ().-")
_ALNUM = frozenset(_LETTERS + "0123456789")
_URL_END = re.compile("[\\s<>\"'\\\\^`{|}]")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in "@+":
        found.add_word(sign, (sign, 1))
    for digit in "0123456789":
        found.add_word(digit, ("0", 1))
    for scheme in SCHEMES:
        found.add_word(scheme, ("s", len(scheme)))
    for cue in CUES:
        found.add_word(cue, ("c", len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    """Check digits of an international account number without spaces."""
    if not 15 <= len(text) <= 34 or not text[:2].isalpha() or not text[2:4].isdigit():
        return False
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def parse_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign, not reaching left of ``floor``."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    i, n, stop, dots = at + 1, len(text), 0, 0
    while True:
        begin = i
        while i < n and text[i] in _LABEL:
            i += 1
        if i == begin:
            break
        stop, dots = i, dots + 1
        if i >= n or text[i] != ".":
            break
        i += 1
    return (start, stop) if dots >= 2 else None


def parse_ips(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """All dotted quads of the chain of digits and single dots that starts at ``at``, and the chain's end."""
    parts, i, n = [], at, len(text)
    while True:
        begin = i
        while i < n and text[i] in _DIGITS:
            i += 1
        parts.append((begin, i))
        if i + 1 < n and text[i] == "." and text[i + 1] in _DIGITS:
            i += 1
        else:
            break
    found = []
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        if all(len(v := text[a:b].lstrip("0")) <= 3 and int(v or 0) <= 255 for a, b in four):
            found.append((four[0][0], four[3][1]))
    return found, i


def parse_card(text: str, at: int) -> tuple[tuple[int, int] | None, int]:
    """The chain of digits with single spaces or hyphens from ``at``; a span if it is a valid card number."""
    i, n, digits = at, len(text), []
    while True:
        digits.append(text[i])
        i += 1
        if i < n and text[i] in _DIGITS:
            continue
        if i + 1 < n and text[i] in " -" and text[i + 1] in _DIGITS:
            i += 1
            continue
        break
    return ((at, i) if 13 <= len(digits) <= 19 and luhn("".join(digits)) else None), i


def parse_phone(text: str, at: int) -> tuple[int, int] | None:
    """The number after the plus-sign at ``at``, up to the last digit of its dialling characters."""
    n = len(text)
    if at + 1 >= n or text[at + 1] not in _DIGITS:
        return None
    i = at + 2
    while i < n and text[i] in _DIAL:
        i += 1
    while i > at + 3 and text[i - 1] not in _DIGITS:
        i -= 1
    if i <= at + 3 or text[i - 1] not in _DIGITS:
        return None
    return (at, i) if 9 <= sum(c in _DIGITS for c in text[at:i]) <= 15 else None


def parse_account(text: str, cue_stop: int) -> tuple[int, int] | None:
    """After a cue at most 12 characters of filler, then an account: IBAN, or 6 to 20 digits in groups."""
    n, i = len(text), cue_stop
    while i < n and i - cue_stop <= 12 and text[i] not in _DIGITS and not (text[i : i + 2].isupper() and text[i + 2 : i + 4].isdigit()):
        if text[i] in "\n@":
            return None
        i += 1
    if i >= n or i - cue_stop > 12:
        return None
    start, kept = i, []
    while i < n and len(kept) < 34:
        if text[i] in _ALNUM:
            kept.append(text[i])
        elif not (text[i] in " -" and i + 1 < n and text[i + 1] in _ALNUM):
            break
        i += 1
    raw = text[start:i]
    for stop in sorted({start + m.start() for m in re.finditer(r"[ -]|$", raw)}, reverse=True):
        joined = re.sub("[ -]", "", text[start:stop])
        if joined.isascii() and iban_valid(joined):
            return start, stop
    digits = re.match(r"[0-9](?:[ -]?[0-9])*", raw)
    if digits and 6 <= sum(c in _DIGITS for c in digits[0]) <= 20:
        return start, start + digits.end()
    return None


def url_run(text: str, at: int) -> tuple[int, int]:
    """End of the run of address characters from ``at`` on, and the end without the punctuation behind it."""
    found = _URL_END.search(text, at)
    end = stop = found.start() if found else len(text)
    while stop > at and text[stop - 1] in ".,;:!?)]":
        stop -= 1
    return end, stop


def parse_address(text: str, scheme_start: int, scheme_stop: int, stop: int) -> tuple[int, int] | None:
    """A web, mail or telephone address up to ``stop``, where it names a person: user part or direct number.

    Only the host is looked at, so a run of many schemes is read once.
    """
    if text[scheme_stop - 1] == "/":
        slash = text.find("/", scheme_stop, stop)
        host = text[scheme_stop : stop if slash < 0 else slash]
        return (scheme_start, stop) if "@" in host.strip("@") else None
    return (scheme_start, stop) if stop - scheme_stop >= 3 and (text[scheme_stop] in _ALNUM or text[scheme_stop] == "+") else None


class Finder:
    """All spans of a text by kind; one automaton for all texts of a task."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def spans(self, text: str) -> dict[str, list[tuple[int, int]]]:
        found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
        email_end = ip_end = card_end = account_end = address_end = run_end = run_stop = 0
        email, phone = found["email"], found["phone"]
        # Lower case of A-Z only, so that places stay the same.
        folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        for last, (sign, size) in self.anchors.iter(folded):
            if sign == "0":
                if last >= ip_end:
                    got, ip_end = parse_ips(text, last)
                    found["ip"] += got
                if last >= card_end:
                    one, card_end = parse_card(text, last)
                    if one:
                        found["card"].append(one)
            elif sign == "@":
                if one := parse_email(text, last, email_end):
                    email.append(one)
                    email_end = one[1]
            elif sign == "+":
                if one := parse_phone(text, last):
                    phone.append(one)
            elif sign == "s":
                start = last + 1 - size
                if start >= address_end and (not start or text[start - 1] not in _ALNUM):
                    if last + 1 >= run_end:
                        run_end, run_stop = url_run(text, last + 1)
                    if one := parse_address(text, start, last + 1, max(run_stop, last + 1)):
                        found["address"].append(one)
                        address_end = one[1]
            else:
                start = last + 1 - size
                whole = (not start or text[start - 1] not in _ALNUM) and (last + 1 == len(text) or text[last + 1] not in _ALNUM)
                if whole and start >= account_end and (one := parse_account(text, last + 1)):
                    found["account"].append(one)
                    account_end = one[1]
        return found


def digest(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in found[kind])


def _over_texts(docs: DataFrame, id_col: str, text_col: str, make: Callable[[list[dict]], dict], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            found = [finder.spans(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | make(found))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, spans`` with kind and code-point places, end exclusive.

    Kinds come in the order of ``KINDS``, spans of a kind from left to right without overlap.  Null and
    empty texts have no spans; repeated rows and null ids are kept; other columns are not read.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    make = lambda found: {"spans": pa.array([[{"kind": k, "start": a, "stop": b} for k in KINDS for a, b in x[k]] for x in found], kind)}
    return _over_texts(docs, id_col, text_col, make, SCHEMA)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``find``, condensed: counts of the base kinds, SHA-256 of their spans, and all spans as text."""

    def make(found: list[dict]) -> dict:
        counts = {f"n_{k}": pa.array([len(x[k]) for x in found], pa.int64()) for k in BASE}
        sha = pa.array([hashlib.sha256(digest(x, BASE).encode()).hexdigest() for x in found], pa.string())
        return counts | {"base_sha256": sha, "spans": pa.array([digest(x, KINDS) for x in found], pa.string())}

    return _over_texts(docs, id_col, text_col, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
