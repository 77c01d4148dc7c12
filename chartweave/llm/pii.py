"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, digits, schemes and cues such as
"account number". At each anchor a parser of its kind expands to both sides, character by character and
without backtracking, and validates what it has found: domain labels, address parts, check digits, number of
digits. A parser gives what the kind's regular expression gives, leftmost and without overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, map_batches

#: Kinds in the order of the result; the first four are the base, the others are found from cues.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "iban", "login")

DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
CAPITALS = DIGITS | frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = DIGITS | LETTERS | frozenset("._%+-")
LABEL = DIGITS | LETTERS | frozenset("-")
DIALLED = DIGITS | frozenset(" ().-")
USER = DIGITS | LETTERS | frozenset("._~%!$&'()*+,;=:-")
HOST = DIGITS | LETTERS | frozenset(".-")

#: Cues of account numbers in four languages, and schemes whose addresses can carry a login.
CUES = ("account", "acct", "account number", "account no", "konto", "kontonummer", "kontonr", "compte", "cuenta", "customer id", "user id", "passport", "iban")
SCHEMES = ("http", "https", "ftp", "ftps", "sftp", "ssh", "smb", "imap", "smtp", "ldap", "redis", "postgres", "postgresql", "mysql", "mongodb", "amqp")
#: What may stand between a cue and its number, and how many characters of it.
BETWEEN, MOST_BETWEEN = frozenset(" :#.=-\t"), 4
#: Digits of an account number; letters and digits of an IBAN.
ACCOUNT_DIGITS, IBAN_SIZES = range(6, 18), range(15, 35)

EMAIL, PLUS, DIGIT, CUE, SCHEME = range(5)


def automaton() -> ahocorasick.Automaton:
    """The anchors' automaton; a cue is found in lower case, with a capital and in capitals."""
    found = ahocorasick.Automaton()
    found.add_word("@", (EMAIL, 1))
    found.add_word("+", (PLUS, 1))
    for digit in sorted(DIGITS):
        found.add_word(digit, (DIGIT, 1))
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            found.add_word(form, (CUE, len(form)))
    for scheme in SCHEMES:
        found.add_word(scheme + "://", (SCHEME, len(scheme) + 3))
    found.make_automaton()
    return found


def stretch(text: str, at: int, members: frozenset) -> int:
    """Where the stretch of ``members`` from ``at`` on ends."""
    while at < len(text) and text[at] in members:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def email(text: str, at: int, least: int) -> tuple[int, int] | None:
    """About the at-sign at ``at``: a local part that begins at ``least`` or later, and two labels or more."""
    start = at
    while start > least and text[start - 1] in LOCAL:
        start -= 1
    end = stretch(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end, labels = stretch(text, end + 1, LABEL), labels + 1
    return (start, end) if labels > 1 else None


def addresses(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """The dotted numbers that begin at the digit at ``at``: four parts an address, and where they end."""
    found, parts = [], []
    while True:
        end = stretch(text, at, DIGITS)
        parts.append((at, end))
        if len(parts) == 4:
            if all(b - a <= 3 or not text[a : b - 3].strip("0") for a, b in parts) and all(int(text[max(a, b - 3) : b]) <= 255 for a, b in parts):
                found.append((parts[0][0], end))
            parts = []
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
            at = end + 1
        else:
            return found, end


def card(text: str, at: int) -> tuple[tuple[int, int] | None, int]:
    """The digits from ``at`` on with one space or hyphen at most between two, if a card number; and where they end."""
    end, n = at + 1, 1
    while end < len(text):
        step = 2 if text[end] in " -" and end + 1 < len(text) else 1
        if text[end + step - 1] not in DIGITS:
            break
        end, n = end + step, n + 1
    good = 13 <= n <= 19 and luhn(text[at:end].replace(" ", "").replace("-", ""))
    return ((at, end) if good else None), end


def phone(text: str, at: int) -> tuple[int, int] | None:
    """From the plus sign at ``at``: a digit, then digits, brackets, dots, spaces and hyphens up to a last digit."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = stretch(text, at + 2, DIALLED)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:
        return None
    return (at, end) if 9 <= sum(c in DIGITS for c in text[at:end]) <= 15 else None


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """Two letters, two check digits and more letters and digits, in groups or not, whose remainder by 97 is 1: the longest that ends at a group's end."""
    end, kept, ends = at, "", []
    while end < len(text) and len(kept) < IBAN_SIZES.stop and text[end] in CAPITALS:
        kept, end = kept + text[end], end + 1
        if end == len(text) or text[end] not in DIGITS | LETTERS:
            ends.append((end, len(kept)))
        if end + 1 < len(text) and text[end] == " ":
            end += 1
    for end, size in reversed(ends):
        code = kept[:size]
        if size in IBAN_SIZES and code[:2].isalpha() and code[2:4].isdigit() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return at, end
    return None


def cued(text: str, start: int, end: int) -> tuple[str, int, int] | None:
    """An IBAN or a number of ACCOUNT_DIGITS digits behind the cue at ``start`` to ``end``; the cue is a word of its own."""
    if start and text[start - 1] in LABEL or end < len(text) and text[end] in LETTERS:
        return None
    at = end
    while at < len(text) and at < end + MOST_BETWEEN and text[at] in BETWEEN:
        at += 1
    if at < len(text) and text[at] in LETTERS:
        found = _iban(text, at)
        return ("iban", *found) if found else None
    last = stretch(text, at, DIGITS | frozenset("-"))
    while last > at and text[last - 1] == "-":
        last -= 1
    if last == at or text[at] == "-" or last < len(text) and text[last] in LETTERS:
        return None
    return ("account", at, last) if sum(c in DIGITS for c in text[at:last]) in ACCOUNT_DIGITS else None


def login(text: str, start: int, end: int) -> tuple[int, int] | None:
    """An address with user and password before an at-sign, from its scheme (``start`` to ``end``) to the end of its host."""
    if start and text[start - 1] in LETTERS:
        return None
    at = stretch(text, end, USER)
    if at >= len(text) or text[at] != "@" or ":" not in text[end + 1 : at - 1]:
        return None
    last = stretch(text, at + 1, HOST)
    while last > at + 1 and text[last - 1] in ".-":
        last -= 1
    return (start, last) if last > at + 1 else None


def spans_of(text: str, anchors: ahocorasick.Automaton) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of all personal data in a text, each kind from left to right without overlap."""
    ends = dict.fromkeys((*KINDS, "number"), 0)
    for last, (kind, size) in anchors.iter(text):
        at = last - size + 1
        if kind == DIGIT:
            if at >= ends["number"]:
                found, ends["number"] = addresses(text, at)
                for start, end in found:
                    yield "ip", start, end
            if at >= ends["card"]:
                one, ends["card"] = card(text, at)
                if one:
                    yield "card", *one
            continue
        if kind == EMAIL:
            name, one = "email", email(text, at, ends["email"])
        elif kind == PLUS:
            name, one = "phone", phone(text, at)
        elif kind == SCHEME:
            name, one = "login", login(text, at, last + 1)
        else:
            name, *one = cued(text, at, last + 1) or ("account",)
        if one and one[0] >= ends[name]:
            ends[name] = one[1]
            yield name, *one


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: (kind, start, end) in code points, end exclusive, by kind in the order of KINDS, then start.

    Base kinds are what these expressions match, leftmost and without overlap: email
    ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, ip four dotted numbers of at most 255, card 13 to 19 digits with one space or
    hyphen between two at most that pass Luhn, phone a plus sign and 9 to 15 digits with `` ().-`` between them; a match that fails its
    condition is dropped whole. Spans of two kinds may overlap. Cues add ``account``, ``iban`` and ``login``. One row a row of ``df``, whatever
    its id; null and empty texts have no spans. Rows never meet: no shuffle.
    """

    def make():
        anchors, order = automaton(), {kind: k for k, kind in enumerate(KINDS)}

        def apply(batch):
            spans = []
            for text in batch.column("text").to_pylist():
                own = sorted(spans_of(text, anchors), key=lambda s: (order[s[0]], s[1]))
                spans.append([{"kind": kind, "start": a, "end": b} for kind, a, b in own])
            return {"doc_id": batch.column("doc_id"), "spans": spans}

        return apply

    return map_batches(documents(df, id_col, text_col), make, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_spans: whole texts with ``<kind>`` for each span; of overlapping spans the first, and of two with one start the longer, gives the name, and all of both goes."""

    def make():
        anchors = automaton()

        def apply(batch):
            texts, counts = [], []
            for text in batch.column("text").to_pylist():
                parts, done, own = [], 0, sorted(spans_of(text, anchors), key=lambda s: (s[1], -s[2]))
                for kind, start, end in own:
                    if start >= done:
                        parts += [text[done:start], f"<{kind}>"]
                    done = max(done, end)
                texts.append("".join([*parts, text[done:]]))
                counts.append(len(own))
            return {"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string()), "n_spans": counts}

        return apply

    return map_batches(documents(df, id_col, text_col), make, "doc_id long, text string, n_spans long")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns of what find_pii returns; no Python."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(_number, BASE), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
