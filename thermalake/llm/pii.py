"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs,
plus signs, scheme separators, identifier cues and digits that begin a number.
A small deterministic parser per kind then grows a span around an anchor, to
the left and to the right, and validates its boundaries. Each text is handled
alone, so the operator is one narrow map without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of the digest; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account", "address", "secret")
BASE = KINDS[:4]

#: Words that announce an account number, a street address or a secret.
ACCOUNT_CUES = ("account", "acct", "iban", "routing", "passport", "ssn", "konto", "compte", "cuenta")
STREET_CUES = ("street", "avenue", "road", "boulevard", "lane", "drive", "straße", "strasse", "rue", "calle")

SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "bearer")
#: What stands before "key", with nothing, a hyphen or an underscore between.
KEY_CUES = ("api", "access", "private", "auth")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DIGITS = re.compile(r"[0-9]+")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE_BODY = re.compile(r"[\x20().0-9-]+")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?(?:[/?#][^\s<>\"'`{}|\\^]*)?")
_ACCOUNT = re.compile(r"[\x20:#.=-]{0,4}((?:[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30})|[0-9](?:[0-9-]{3,32})[0-9])(?![A-Za-z0-9])")
_HOUSE_AFTER = re.compile(r"[\x20,]{1,2}([0-9]{1,5}[A-Za-z]?)(?![A-Za-z0-9])")
_HOUSE_BEFORE = re.compile(r"([0-9]{1,5}[A-Za-z]?)\x20(?:[^\W\d_]+\x20){0,3}$")

_ASSIGNED = re.compile(r"[\"'\]]?\x20{0,2}(?:[:=]|=>|:=)\x20{0,2}[\"']?([A-Za-z0-9+/_.~$!@#%^&*-]{8,})|\x20([A-Za-z0-9+/_.~-]{20,}={0,2})(?![A-Za-z0-9])")

SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place & 1:
            value += value - 9 * (value > 4)
        total += value
    return total % 10 == 0


def grow_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at `at`, not reaching left of `floor`."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    label = _LABEL.match(text, at + 1)
    if start == at or not label:
        return None
    end, dots = label.end(), 0
    while text.startswith(".", end) and (label := _LABEL.match(text, end + 1)):
        end, dots = label.end(), dots + 1
    return (start, end) if dots else None


def grow_ip(text: str, start: int) -> tuple[int, int, bool] | None:
    """Four dotted numbers from `start`; the flag tells if each is at most 255."""
    end, parts = start, []
    for part in range(4):
        if part:
            if not text.startswith(".", end):
                return None
            end += 1
        number = _DIGITS.match(text, end)
        if not number:
            return None
        parts.append(number[0])
        end = number.end()
    return start, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def grow_phone(text: str, plus: int) -> tuple[int, int] | None:
    if not ("0" <= text[plus + 1 : plus + 2] <= "9"):
        return None
    body = _PHONE_BODY.match(text, plus + 2)
    if not body:
        return None
    last = body.end() - 1
    while last > body.start() and not "0" <= text[last] <= "9":
        last -= 1
    return (plus, last + 1) if last > body.start() else None


def grow_street(text: str, first: int, end: int, floor: int) -> tuple[int, int] | None:
    """A street name that ends in the cue at `first`, with its house number before or after."""
    if text[end : end + 1].isalpha():
        return None
    start = first
    while start > floor and text[start - 1].isalpha():
        start -= 1
    if start < first and not text[first:end].lower().startswith("stra"):
        return None  # only the German cues end a compound
    if after := _HOUSE_AFTER.match(text, end):
        return start, after.end(1)
    left = max(floor, start - 80)
    before = _HOUSE_BEFORE.search(text[left:start])
    return (left + before.start(1), end) if before else None


def iban(code: str) -> bool:
    moved = code[4:] + code[:4]
    return len(code) >= 15 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def grow_secret(text: str, end: int) -> tuple[int, int, bool] | None:
    """The value, of any length, that is assigned to, or follows, the cue before `end`; the flag tells if it has letters and digits together, 8 characters or more."""
    found = _ASSIGNED.match(text, end)
    if not found:
        return None
    group = 1 if found[1] else 2
    value = found[group].rstrip(".,;:!?")
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return found.start(group), found.start(group) + len(value), mixed and len(value) >= 8


def lowered(text: str) -> str:
    """The text with A-Z lower-cased and all else, and so every position, as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for digit in "0123456789":
        machine.add_word(digit, ("digit", 1))
    machine.add_word("@", ("at", 1))
    machine.add_word("+", ("plus", 1))
    machine.add_word("://", ("scheme", 3))
    keys = tuple(f"{cue}{between}key" for cue in KEY_CUES for between in ("", "-", "_"))
    for kind, cues in (("account", ACCOUNT_CUES), ("street", STREET_CUES), ("secret", SECRET_CUES + keys)):
        for cue in cues:
            machine.add_word(cue, (kind, len(cue)))
    machine.make_automaton()
    return machine


def find_spans(text: str, machine) -> list[tuple[str, int, int]]:
    """All spans of a text, ordered by kind as in `KINDS`, then by start."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    floor = dict.fromkeys(KINDS, 0)  # where the search of a kind goes on

    def take(kind: str, start: int, end: int) -> None:
        found[kind].append((start, end))
        floor[kind] = end

    number_end = 0  # of the digit run that the current anchor lies in
    for last, (anchor, length) in machine.iter(lowered(text)):
        first = last + 1 - length
        if anchor == "digit":
            if first >= number_end:
                number_end = _DIGITS.match(text, first).end()
                begins = True
            else:
                begins = False
            if first >= floor["ip"] and (begins or first == floor["ip"]) and (grown := grow_ip(text, first)):
                if grown[2]:
                    take("ip", *grown[:2])
                floor["ip"] = grown[1]
            if first >= floor["card"]:
                end = _NUMBER.match(text, first).end()
                if end > first + 1:
                    digits = text[first:end].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        take("card", first, end)
                floor["card"] = end
        elif anchor == "at":
            if first >= floor["email"] and (grown := grow_email(text, first, floor["email"])):
                take("email", *grown)
        elif anchor == "plus":
            if first >= floor["phone"] and (grown := grow_phone(text, first)):
                digits = sum("0" <= c <= "9" for c in text[grown[0] : grown[1]])
                if 8 <= digits <= 15:
                    take("phone", *grown)
                floor["phone"] = grown[1]
        elif anchor == "scheme":
            start = first
            while start > floor["url"] and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if start < first and (host := _HOST.match(text, last + 1)):
                take("url", start, start + len(text[start : host.end()].rstrip(".,;:!?)")))
        elif anchor == "account":
            if first >= floor["account"] and (code := _ACCOUNT.match(text, last + 1)):
                value = code[1]
                if value[0].isdigit() or iban(value):
                    take("account", *code.span(1))
        elif anchor == "secret":
            if first >= floor["secret"] and (grown := grow_secret(text, last + 1)):
                if grown[2]:
                    take("secret", *grown[:2])
                floor["secret"] = grown[1]
        elif grown := grow_street(text, first, last + 1, floor["address"]):
            take("address", *grown)
    return [(kind, start, end) for kind in KINDS for start, end in found[kind]]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id and its spans in code points, end exclusive.

    Null and empty texts have no spans; texts of any length are searched whole,
    and so are values of any length; cues are known in any letter case;
    spans of one kind don't overlap, those of different kinds may. Repeated rows
    and null ids are kept as rows of their own; other columns of the input are
    not read; an empty table gives an empty one.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton()
        for batch in batches:
            spans = [
                [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(text, machine)] if text else []
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW.field(1).type)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(expand, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind and the joined spans."""
    mark = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(mark(base), 256).alias("base_sha256"), mark(F.col("spans")).alias("spans"))
