"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, `://` and the
cues of an identifier. From each anchor a small deterministic parser walks left and right to the
bounds of an e-mail address, network address, number or account, and checks what it found.

Defined cases: a null text counts as empty and has no spans; repeated rows are handled one by one;
offsets count code points of the whole text, ends are exclusive; further columns pass through
`mask` unchanged and are left out by `find_spans`.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.arrow_text import slices

#: The kinds in their order of report. The first four have given definitions.
KINDS = ("email", "ip", "card", "phone", "account", "address")
#: Words that announce an identifier when a value follows, after `=`, `:`, a word for number or blanks.
CUES = ("account", "acct", "iban", "passport", "token", "api_key", "apikey", "secret", "password", "passwd")
NUMBER_WORDS = ("number", "num", "nr", "no")
#: Characters of an account number by country code, as registered for IBAN.
IBAN_CHARS = {
    code: n for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items() for code in codes.split()
}

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = DIGITS | LETTERS | frozenset("._%+-")
LABEL = DIGITS | LETTERS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
VALUE = DIGITS | LETTERS | frozenset("_-+/=")
URL_END = frozenset(" \t\n\r\v\f\"'<>")

Span = tuple[int, int]


def _run(text: str, at: int, allowed: frozenset[str]) -> int:
    """End of the run of allowed characters from `at`."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email(text: str, at: int, low: int) -> Span | None:
    """Address around the at-sign at `at`, not reaching before `low`."""
    start = at
    while start > low and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    stop = end
    while stop < len(text) and text[stop] == "." and (label := _run(text, stop + 1, LABEL)) > stop + 1:
        stop = label
    return (start, stop) if stop > end else None


def ip(text: str, at: int) -> tuple[int, Span | None]:
    """Four dotted numbers from the digit at `at`: where to go on, and the span if it is valid."""
    end = first = _run(text, at, DIGITS)
    parts = [text[at:end]]
    while len(parts) < 4 and end < len(text) and text[end] == "." and (stop := _run(text, end + 1, DIGITS)) > end + 1:
        parts.append(text[end + 1:stop])
        end = stop
    if len(parts) < 4:
        return first, None
    # More than three digits beside leading zeros are over 255 without being read as a number.
    valid = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)
    return end, (at, end) if valid else None


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def card(text: str, at: int) -> tuple[int, Span | None]:
    """Digits with single blanks or hyphens between them, from the digit at `at`."""
    end, n = at + 1, len(text)
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    digits = text[at:end].replace(" ", "").replace("-", "")
    return end, (at, end) if 13 <= len(digits) <= 19 and luhn(digits) else None


def phone(text: str, at: int) -> tuple[int, Span | None]:
    """International number from the plus sign at `at`."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return at + 1, None
    end = _run(text, at + 2, PHONE)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:
        return at + 1, None
    return end, (at, end) if 9 <= sum(c in DIGITS for c in text[at:end]) <= 15 else None


class Values:
    """Runs of value characters of a text, each walked once, with the places of its digits."""

    def __init__(self, text: str) -> None:
        self.text, self.low, self.high, self.digits = text, 0, 0, []

    def end(self, at: int) -> int:
        if not self.low <= at < self.high:
            self.low, self.high = at, _run(self.text, at, VALUE)
            self.digits = [k for k in range(at, self.high) if self.text[k] in DIGITS]
        return self.high

    def count(self, at: int, end: int) -> int:
        """Digits in `at` to `end`, counted from the known run as far as it goes."""
        inside = bisect_left(self.digits, min(end, self.high)) - bisect_left(self.digits, at) if self.low <= at else 0
        return inside + sum(c in DIGITS for c in self.text[max(at, self.high):end])


def account(text: str, after: int, cue: int, values: Values) -> Span | None:
    """Value announced by the cue that ends at `after`, with a digit in it: `cue = "value"`, `cue number value`.

    Without `=` or `:` the value needs six digits. A first group of three to five characters goes on
    over single blanks, as account numbers are printed.
    """
    if cue and (text[cue - 1] in LETTERS or text[cue - 1] in DIGITS):
        return None
    at = _run(text, after, frozenset(" "))
    if at > after:
        word = next((w for w in NUMBER_WORDS if text[at:at + len(w)].lower() == w), "")
        stop = at + len(word)
        if word and stop < len(text) and text[stop] in " .:=#":
            at = _run(text, stop, frozenset(" .#"))
        elif text[at:at + 1] == "#":
            at = _run(text, at, frozenset(" #"))
    set_off = at < len(text) and text[at] in ":="
    if not set_off and at == after:
        return None
    if set_off:
        at = _run(text, at + 1, frozenset(" \"'"))
    if (whole := iban(text, at + 2)) is not None:
        return whole

    def grouped(group: str) -> bool:
        return all(c in DIGITS or "A" <= c <= "Z" for c in group) and any(c in DIGITS for c in group)

    end = first = values.end(at)
    if 3 <= first - at < 6 and grouped(text[at:first]):
        while end < len(text) and text[end] == " " and (stop := _run(text, end + 1, VALUE)) > end + 1:
            if not grouped(text[end + 1:stop]):
                break
            end = stop
    digits = values.count(at, end)
    return (at, end) if end - at >= 6 and digits >= (1 if set_off and end == first else 6) else None


def iban(text: str, at: int) -> Span | None:
    """Account number whose check digits start at `at`, valid by the remainder of 97.

    It has the length of its country, or for other codes is the longest run of 15 to 34 characters
    that is valid; either ends where no upper-case letter or digit follows at once.
    """
    start = at - 2
    if start < 0 or not all("A" <= c <= "Z" for c in text[start:at]) or (start and (text[start - 1] in LETTERS or text[start - 1] in DIGITS)):
        return None
    if len(text[start:at + 2]) < 4 or not all(c in DIGITS for c in text[at:at + 2]):
        return None
    most = IBAN_CHARS.get(text[start:at], 34)
    least = IBAN_CHARS.get(text[start:at], 15)
    end, plain, found = at, text[start:at], None
    while end < len(text) and len(plain) < most:
        if "A" <= text[end] <= "Z" or text[end] in DIGITS:
            plain += text[end]
            end += 1
            bound = end == len(text) or not ("A" <= text[end] <= "Z" or text[end] in DIGITS)
            if bound and len(plain) >= least and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                found = (start, end)
        elif text[end] == " " and end + 1 < len(text) and ("A" <= text[end + 1] <= "Z" or text[end + 1] in DIGITS):
            end += 1
        else:
            break
    return found


def address(text: str, at: int) -> Span | None:
    """Network address around `://` at `at` that names a user before its host.

    Only the host is read before it is known to name a user, and it ends at a slash, so a text of
    nothing but such signs is read once.
    """
    start = at
    while start and (text[start - 1] in LETTERS or text[start - 1] in DIGITS):
        start -= 1
    end, n = at + 3, len(text)
    if start == at:
        return None
    while end < n and text[end] not in URL_END and text[end] != "/":
        end += 1
    if "@" not in text[at + 3:end].strip("@"):
        return None
    while end < n and text[end] not in URL_END:
        end += 1
    return start, end


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor in ("@", "+", "://", *DIGITS):
        found.add_word(anchor, (anchor if anchor not in DIGITS else "0", len(anchor)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind in the order of KINDS, then by start."""
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    values = Values(text)
    after = dict.fromkeys(KINDS, 0)  # each kind goes on behind its last match

    def keep(kind: str, span: Span | None) -> None:
        if span:
            found[kind].append(span)
            after[kind] = span[1]

    for last, (anchor, size) in anchors.iter(text):
        at = last - size + 1
        if anchor == "0":
            if at >= after["ip"]:
                after["ip"], span = ip(text, at)
                if span:
                    found["ip"].append(span)
            if at >= after["card"]:
                after["card"], span = card(text, at)
                if span:
                    found["card"].append(span)
            if at >= after["account"] and at >= 2:
                keep("account", iban(text, at))
        elif anchor == "@":
            if at >= after["email"]:
                keep("email", email(text, at, after["email"]))
        elif anchor == "+":
            if at >= after["phone"]:
                after["phone"], span = phone(text, at)
                if span:
                    found["phone"].append(span)
        elif anchor == "://":
            if at >= after["address"]:
                keep("address", address(text, at))
        elif at >= after["account"]:
            keep("account", account(text, last + 1, at, values))
    return [(kind, *span) for kind in KINDS for span in found[kind]]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def with_spans(docs: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """`docs` with a column of spans: array of (kind, start, stop)."""
    names = docs.columns
    at = names.index(text)
    schema = ", ".join(
        [f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)] + ["spans array<struct<kind:string,start:int,stop:int>>"]
    )
    # Columns travel under their positions, so no name can clash.
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                listed = [
                    [{"kind": k, "start": a, "stop": b} for k, a, b in spans(t, anchors)] if t else []
                    for t in part.column(at).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(listed, SPANS)], [*part.schema.names, "spans"])

    return plain.mapInArrow(run, schema).toDF(*names, to)


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key and its spans. The text itself does not come back."""
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            for part in slices(batch, "_text"):
                listed = [
                    [{"kind": k, "start": a, "stop": b} for k, a, b in spans(t, anchors)] if t else []
                    for t in part.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(listed, SPANS)], ["key", "spans"])

    return slim.mapInArrow(run, f"key {kind}, spans array<struct<kind:string,start:int,stop:int>>").withColumnRenamed("key", key)


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each group of overlapping spans replaced by the kind that starts first."""
    out, end = [], 0
    for kind, start, stop in sorted(found, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if start >= end:
            out += [text[end:start], f"<{kind.upper()}>"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the personal data in `text` replaced by tags; a null text stays null."""
    at = docs.columns.index(text)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                texts = [masked(t, s) if t and (s := spans(t, anchors)) else t for t in part.column(at).to_pylist()]
                yield part.set_column(at, f"c{at}", pc.cast(pa.array(texts, pa.large_string()), part.column(at).type))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
