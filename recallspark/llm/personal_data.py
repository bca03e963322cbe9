"""Personal data in whole texts, by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, scheme marks, the short digit pairs that every address, card or phone
number holds, and cue words for identifiers (IBAN, account, card, phone, SSN). From an anchor a deterministic parser
expands to the bounds of the characters its kind may hold and validates what is there. An expansion never looks beyond
those bounds, so a text is read once plus the regions around its anchors, each of them once. Everything happens in the
scan's own tasks: no shuffle, no state.

Base spans are the results of these patterns, leftmost and without overlaps per kind, failing matches dropped:
email, ip (parts up to 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits). The parsers add to them what such a
match hides where it ran over the bounds of numbers that stand side by side: cards of one group of digits, or of four
groups of four, in a run of too many digits; a phone number of the groups that make 15 digits at most; and userinfo,
the part before the last at-sign of an authority after a scheme mark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.common import of_texts, releasing, small_batches

KINDS = ("email", "ip", "card", "phone", "userinfo", "iban", "account", "ssn")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED, _DOTTED_RUN = frozenset("0123456789."), re.compile(r"[0-9.]*")
_SPACED, _SPACED_RUN = frozenset("0123456789 -"), re.compile(r"[0-9 -]*")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>\\]*")
_GROUPS = re.compile(r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])")
_NOT_DIGITS = re.compile(r"[^0-9]")
#: Cue words by what they announce; each also with a capital first letter and in capitals.
CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "kontonummer", "compte", "cuenta"),
    "card": ("card", "visa", "mastercard", "amex"),
    "phone": ("phone", "telephone", "tel", "mobile", "fax", "telefon", "teléfono"),
    "ssn": ("ssn",),
}
#: What may stand between a cue and its number.
_LEAD = re.compile(r"(?:[\s:#.=]|(?i:number|nummer|numero|número|num|no|nr|is)\b){0,8}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])*")
_LOCAL_PHONE = re.compile(r"\(?[0-9][0-9 ().-]*[0-9]")
_SSN = re.compile(r"[0-9]{3}([ -]?)[0-9]{2}\1[0-9]{4}(?![0-9])")


@lru_cache(1)
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    digits = "0123456789"
    for a in digits:
        found.add_word(f"+{a}", ("phone", 1))
        found.add_word(f".{a}", ("ip", 1))
        for b in digits:
            for mark in ("", " ", "-"):
                found.add_word(f"{a}{mark}{b}", ("card", 0))
    found.add_word("@", ("email", 0))
    found.add_word("://", ("userinfo", 0))
    for kind, words in CUES.items():
        for w in words:
            for x in (w, w.capitalize(), w.upper()):
                found.add_word(x, (f"cue {kind}", len(x) - 1))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        x = int(x)
        total += (2 * x - 9 * (x > 4)) if k % 2 else x
    return total % 10 == 0


def _region(text: str, at: int, inside: frozenset, run: re.Pattern) -> tuple[int, int]:
    start = at
    while start and text[start - 1] in inside:
        start -= 1
    return start, run.match(text, at).end()


Spans = dict[str, list[tuple[int, int]]]


def find_spans(text: str | None) -> tuple[Spans, Spans]:
    """Base spans and added ones: (start, end) in code points by kind, in order; end is exclusive. None is an empty text."""
    base: Spans = {k: [] for k in BASE}
    added: Spans = {k: [] for k in KINDS}
    if not text:
        return base, added
    done = dict.fromkeys(KINDS, 0)
    for end, (kind, back) in _anchors().iter(text):
        at = end - back
        if kind[:4] == "cue ":
            if not (at and text[at - 1].isalnum()) and not text[end + 1 : end + 2].isalnum() and (span := _announced(kind[4:], text, end + 1)) and span not in added[kind[4:]]:
                added[kind[4:]].append(span)
            continue
        if at < done[kind]:
            continue
        if kind == "card":
            start, done[kind] = _region(text, end, _SPACED, _SPACED_RUN)
            for m in _CARD.finditer(text, start, done[kind]):
                digits = _NOT_DIGITS.sub("", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    base[kind].append(m.span())
                elif len(digits) > 16:
                    added[kind] += _cards(text, *m.span())
        elif kind == "ip":
            start, done[kind] = _region(text, at, _DOTTED, _DOTTED_RUN)
            base[kind] += [m.span() for m in _IP.finditer(text, start, done[kind]) if all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m.groups())]
        elif kind == "phone":
            if m := _PHONE.match(text, at):
                done[kind] = m.end()
                n = len(_NOT_DIGITS.sub("", m[0]))
                if 8 <= n <= 15:
                    base[kind].append(m.span())
                elif n > 15 and (cut := _phone_groups(m[0])):
                    added[kind].append((at, at + cut))
        elif kind == "email":
            start = at
            while start > done[kind] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done[kind] = m.end()
                base[kind].append((start, m.end()))
        else:
            start, stop = _AUTHORITY.match(text, end + 1).span()
            mark = text.rfind("@", start, stop)
            done[kind] = stop
            if mark > start:
                added[kind].append((start, mark))
    return base, added


def _announced(kind: str, text: str, at: int) -> tuple[int, int] | None:
    """The number of this kind that a cue before at announces."""
    at = _LEAD.match(text, at).end()
    if kind == "iban":
        return _iban(text, at)
    m = (_LOCAL_PHONE if kind == "phone" else _SSN if kind == "ssn" else _NUMBER).match(text, at)
    if not m:
        return None
    digits = _NOT_DIGITS.sub("", m[0])
    least, most = {"account": (6, 17), "card": (13, 15), "phone": (7, 15), "ssn": (9, 9)}[kind]
    return m.span() if least <= len(digits) <= most and (kind != "card" or luhn(digits)) else None


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """The longest start of what stands here that is an IBAN by its check digits."""
    if not (m := _IBAN.match(text, at)):
        return None
    for stop in range(m.end(), at + 14, -1):
        x = text[at:stop].replace(" ", "").replace("-", "")
        if text[stop - 1] not in " -" and not text[stop : stop + 1].isalnum() and len(x) >= 15 and int("".join([str(int(c, 36)) for c in x[4:] + x[:4]])) % 97 == 1:
            return at, stop
    return None


def _cards(text: str, at: int, stop: int) -> list[tuple[int, int]]:
    """Cards in a run of groups of digits: the first that passes Luhn, from any group on, then those after it."""
    found = []
    while m := _GROUPS.search(text, at, stop):
        at = m.start() + 1
        if luhn(_NOT_DIGITS.sub("", m[0])):
            found.append(m.span())
            at = m.end()
    return found


def _phone_groups(number: str) -> int:
    """The length of the longest start of a number that ends with a group of digits and has 8 to 15 of them, else 0."""
    found = digits = 0
    for m in re.finditer(r"[0-9]+", number):
        digits += len(m[0])
        if digits > 15:
            break
        found = m.end() if digits >= 8 else 0
    return found


def all_spans(text: str | None) -> Spans:
    base, added = find_spans(text)
    return {k: sorted([*base.get(k, []), *added[k]]) for k in KINDS}


def redacted(text: str, spans: Spans) -> str:
    """text with each span, or group of overlapping spans, replaced by the kind of its first one in angle brackets."""
    found = sorted((a, b, k) for k, each in spans.items() for a, b in each)
    if not found:
        return text
    out, last, k = [], 0, 0
    while k < len(found):
        start, end, kind = found[k]
        k += 1
        while k < len(found) and found[k][0] < end:
            end, k = max(end, found[k][1]), k + 1
        out += [text[last:start], f"<{kind.upper()}>"]
        last = end
    return "".join([*out, text[last:]])


def _joined(spans: Spans, kinds: tuple[str, ...]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k in kinds for a, b in spans[k]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) for each row: the counts of base spans, and base and all spans as kind:start:end by kind, then start.

    A null or empty text has no spans; a very long one is read whole. Spans of one kind do not overlap but for added ones.
    A null doc_id stays null; repeated rows are repeated; other columns are not read.
    """
    counts = [f"n_{k}" for k in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [find_spans(x) for x in batch.column("text").to_pylist()]
            every = [{k: sorted([*base.get(k, []), *added[k]]) for k in KINDS} for base, added in found]
            columns = [batch.column("doc_id"), *(pa.array([len(base[k]) for base, _ in found], pa.int64()) for k in BASE)]
            columns += [pa.array([_joined(base, BASE) for base, _ in found], pa.string()), pa.array([_joined(x, KINDS) for x in every], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *counts, "base", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return of_texts(rows).mapInArrow(releasing(run), f"doc_id {dict(rows.dtypes)['doc_id']}, " + "".join(f"{c} long, " for c in counts) + "base string, spans string")


def redact_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of its texts replaced by its kind.

    Spans that overlap are replaced as one, by the kind of the first (of those that begin together, the shortest). All
    columns are kept, whatever their names; a null text stays null, an empty one empty; a very long text is read whole;
    repeated rows are repeated.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col):
            texts = [x and redacted(x, all_spans(x)) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(texts, batch.schema.field(at).type))

    return of_texts(docs).mapInArrow(releasing(run), docs.schema)
