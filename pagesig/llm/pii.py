"""Personal data in texts, found by anchor expansion.

Method: an Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, plus signs and
digits, schemes (`https://`, `mailto:`, ...) and identifier cues (`iban`, `account`, ...). At each
anchor a local parser expands to both sides as far as its kind allows and validates what it found.
Parsers are deterministic: each keeps a cursor behind its last candidate, kept or not, so that every
stretch of text is parsed once per kind and candidates of a kind never overlap.

Base kinds, leftmost first, a candidate that fails its check being dropped without a retry:

- email: local part, at-sign, labels with at least one dot;
- ip: four numbers of at most 255 with dots between them;
- card: 13 to 19 digits, single spaces or hyphens between them, with a valid Luhn checksum;
- phone: a plus sign, then 9 to 15 digits with spaces, dots, hyphens and brackets.

Added kinds (they never change a base span):

- address: what a scheme introduces and a base kind does not bound: user information and host of a
  URL, the target of mailto:, sip:, xmpp: and tel:, and addresses written with [at], (at) or {at};
- account: the identifier after a cue: an IBAN with valid check digits, a social security number
  with valid parts, or an account number of 6 to 17 digits.

Plan: one Arrow pass over the texts, no exchange. A document's spans travel as an array in its row.

Defined cases: null and empty texts have no spans; positions are code points, the end exclusive;
repeated rows give repeated rows; a null doc_id stays null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesig.llm.common import doc_columns, whole_rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")

# Anchors, lower-case
URL_SCHEMES = ["http://", "https://", "ftp://", "sftp://", "ssh://"]
TARGET_SCHEMES = ["mailto:", "sip:", "xmpp:"]
CALL_SCHEMES = ["tel:"]
SPELLED_AT = ["[at]", "(at)", "{at}"]
BANK_CUES = ["iban"]
ACCOUNT_CUES = ["account", "acct", "konto"]
SECURITY_CUES = ["ssn", "social security"]

_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_ALNUM = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_HOST = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_QUAD = re.compile(rb"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DOTTED = re.compile(rb"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(rb"[0-9](?:[ -]?[0-9])*+")
_CALL = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(rb"[A-Za-z0-9._~%!$&*+,;=:-]++@(?:[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+)(?::[0-9]{1,5}+)?")
_TARGET = re.compile(rb"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
_TEL = re.compile(rb"\+?[0-9](?:[().-]?[0-9])++")
_SPELLED = re.compile(rb"(?i:\[at\]|\(at\)|\{at\}) ?[a-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[a-z0-9-]++)++", re.I)
_AFTER_CUE = re.compile(rb"(?: ?(?:number|no\.?|nr\.?|num\.?|id))?+ {0,2}[:=#]? {0,2}", re.I)
_IBAN = re.compile(rb"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}+(?: ?[A-Za-z0-9]{1,3})?+")
_SSN = re.compile(rb"([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_DROP = bytes(range(256)).translate(None, b"0123456789")


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = c - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def iban(code: bytes) -> bool:
    code = code.replace(b" ", b"").upper()
    return 15 <= len(code) <= 34 and int("".join(str(int(chr(c), 36)) for c in code[4:] + code[:4])) % 97 == 1


def local_part(data: bytes, floor: int, at: int) -> int:
    """Where the run of local-part characters that ends at `at` begins, not before `floor`."""
    reach = 64
    while True:
        low = max(floor, at - reach)
        start = at - (at - low) + len(data[low:at].rstrip(_LOCAL))
        if start > low or low == floor:
            return start
        reach *= 4


def email(data: bytes, at: int, floor: int) -> tuple[int, int, bool]:
    """(start, end, valid) of the candidate at an at-sign; end is where the next may begin."""
    start = local_part(data, floor, at)
    found = _HOST.match(data, at) if start < at else None
    return (start, found.end(), True) if found else (at, floor, False)


def ip(data: bytes, at: int, floor: int) -> tuple[int, int, bool]:
    found = _QUAD.match(data, at)
    if not found:
        return at, _DOTTED.match(data, at).end(), False
    parts = found.group().split(b".")
    return at, found.end(), all(len(p.lstrip(b"0")) <= 3 and int(p) <= 255 for p in parts)


def card(data: bytes, at: int, floor: int) -> tuple[int, int, bool]:
    end = _DIGITS.match(data, at).end()
    digits = data[at:end].translate(None, b" -") if 13 <= end - at <= 37 else b""
    return at, end, 13 <= len(digits) <= 19 and luhn(digits)


def phone(data: bytes, at: int, floor: int) -> tuple[int, int, bool]:
    found = _CALL.match(data, at)
    if not found:
        return at, at + 1, False
    return at, found.end(), 9 <= len(found.group().translate(None, _DROP)) <= 15


def url(data: bytes, at: int, floor: int, size: int) -> tuple[int, int, bool]:
    if at and data[at - 1] in _ALNUM:  # the tail of a longer word or scheme
        return at, floor, False
    found = _USERINFO.match(data, at + size)
    return (at, found.end(), True) if found else (at, floor, False)


def target(data: bytes, at: int, floor: int, size: int) -> tuple[int, int, bool]:
    found = _TARGET.match(data, at + size) if not at or data[at - 1] not in _ALNUM else None
    return (at, found.end(), True) if found else (at, floor, False)


def call(data: bytes, at: int, floor: int, size: int) -> tuple[int, int, bool]:
    found = _TEL.match(data, at + size) if not at or data[at - 1] not in _ALNUM else None
    if not found:
        return at, floor, False
    return at, found.end(), 7 <= len(found.group().translate(None, _DROP)) <= 15


def spelled(data: bytes, at: int, floor: int, size: int) -> tuple[int, int, bool]:
    end = at - 1 if at and data[at - 1:at] == b" " else at
    start = local_part(data, floor, end)
    found = _SPELLED.match(data, at) if start < end else None
    return (start, found.end(), True) if found else (at, floor, False)


def is_account(found: re.Match) -> bool:
    return 6 <= len(found.group().translate(None, b" -")) <= 17


def is_iban(found: re.Match) -> bool:
    return iban(found.group())


def is_security_number(found: re.Match) -> bool:
    area, group, serial = found.groups()
    return area not in (b"000", b"666") and area < b"900" and group != b"00" and serial != b"0000"


def identifier(data: bytes, at: int, floor: int, size: int, form: re.Pattern, holds) -> tuple[int, int, bool]:
    """What follows a cue, and after it a word such as `number`, a colon and spaces."""
    if at and data[at - 1] in _ALNUM:
        return at, floor, False
    start = _AFTER_CUE.match(data, at + size).end()
    found = form.match(data, start) if start > at + size else None  # else the cue goes on as another word
    return (start, found.end(), holds(found)) if found else (at, floor, False)


# per anchor: the kinds it may begin, their parsers, and what else these take
ANCHORS: dict[str, list[tuple]] = {
    "@": [("email", email, ())], "+": [("phone", phone, ())],
    **{str(d): [("ip", ip, ()), ("card", card, ())] for d in range(10)},
    **{s: [("address", parse, (len(s),))] for parse, names in ((url, URL_SCHEMES), (target, TARGET_SCHEMES), (call, CALL_SCHEMES),
                                                              (spelled, SPELLED_AT)) for s in names},
    **{c: [("account", identifier, (len(c), form, holds))] for form, holds, names in (
        (_IBAN, is_iban, BANK_CUES), (_DIGITS, is_account, ACCOUNT_CUES), (_SSN, is_security_number, SECURITY_CUES)) for c in names},
}
_automata: list = []


def automaton():
    if not _automata:
        import ahocorasick
        words = ahocorasick.Automaton()
        for anchor, parsers in ANCHORS.items():
            words.add_word(anchor, (len(anchor), parsers))
        words.make_automaton()
        _automata.append(words)
    return _automata[0]


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data of a text, by kind as listed, then start."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    # one character per byte, A-Z lower-cased: the automaton reports byte positions
    view = data.lower().decode("latin-1")
    cursor, found = dict.fromkeys(KINDS, 0), []
    for last, (size, parsers) in automaton().iter(view):
        at = last + 1 - size
        for kind, parse, more in parsers:
            if at >= cursor[kind]:
                start, cursor[kind], valid = parse(data, at, cursor[kind], *more)
                if valid:
                    found.append((kind, start, cursor[kind]))
    if found and len(data) != len(text):  # bytes to code points, one stretch between edges at a time
        place, at, points = {}, 0, 0
        for edge in sorted({e for _, a, b in found for e in (a, b)}):
            points += len(data[at:edge].decode("utf-8", "surrogatepass"))
            place[edge], at = points, edge
        found = [(k, place[a], place[b]) for k, a, b in found]
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): array of (kind, start, end) per document."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end"), s)) for s in spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(
        scan, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base
    kinds, and all spans as kind:start:end."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def among(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(among(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return find(docs).select("doc_id", *counts, F.sha2(listed(among(*BASE)).cast("binary"), 256).alias("base_sha256"),
                             listed(F.col("spans")).alias("spans"))


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of spans replaced by the kind of its first, as [kind]."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """`docs`, all columns and rows, personal data in `text` masked."""
    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else masked(t, spans(t)) for t in texts], dtype=object)

    rows = whole_rows(docs).withColumn("clean", mask(F.col("row.text").cast("string")))
    return rows.select(*[(F.col("clean") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
