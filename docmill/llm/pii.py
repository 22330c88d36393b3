"""Personal data (operator 10), by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, scheme marks, identifier cues, plus signs before digits and pairs of
digits. From each anchor a deterministic parser walks outwards while the characters fit, and validates what it has:
e-mail and IP addresses, card numbers (Luhn), phone numbers, URLs, IBANs (mod 97) and cued account numbers.

Defined cases: null is the empty text and has no spans; every row of the input gives a row, repeated rows too, with its
id as it is, of any type; other columns of the input are not looked at; whole texts are scanned, of any length. An anchor inside a stretch that the
same parser has used up is passed over, which keeps matches of a kind leftmost and apart.
"""

from __future__ import annotations

import functools
import re
import string

import ahocorasick
from pyspark.sql import DataFrame

from docmill.llm.common import derived
from docmill.llm.secret_scan import digest

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")
DIGITS = frozenset(string.digits)
ALNUM = frozenset(string.ascii_letters + string.digits)
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | {"-"}
PHONE = DIGITS | frozenset(" ().-")
URL_STOP = frozenset(" \t\n\r\x0b\x0c<>\"'`|")
SCHEMES = ("http", "https", "ftp", "ftps", "ssh", "sftp", "file", "mailto")
#: Words that announce an account number, in the three usual ways of writing capitals.
CUES = tuple(f(w) for w in ("iban", "account", "acct") for f in (str.lower, str.upper, str.capitalize))
ACCOUNT = re.compile(r"(?a)(?:\x20(?:no\.?|number|nr\.?))?\x20?[:#=]?\x20?([0-9]{6,17})(?![0-9])")
IBAN = re.compile(r"(?a)\x20?[:#=]?\x20?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)")


@functools.cache
def anchors() -> ahocorasick.Automaton:
    """Built once in each worker."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for d in string.digits:
        found.add_word("+" + d, ("plus", 2))
        for e in string.digits:
            for gap in ("", " ", "-", "."):
                found.add_word(d + gap + e, ("number", 2 + len(gap)))
    for cue in CUES:
        found.add_word(cue, (cue.lower(), len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def run_left(text: str, at: int, chars: frozenset, floor: int = 0) -> int:
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def run_right(text: str, at: int, chars: frozenset) -> int:
    while at < len(text) and text[at] in chars:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``: a local part after ``floor``, then two labels or more."""
    start, end = run_left(text, at, LOCAL, floor), run_right(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == "." and (to := run_right(text, end + 1, LABEL)) > end + 1:
        end, labels = to, labels + 1
    return (start, end) if labels > 1 else None


def number_groups(text: str, start: int, gaps: str) -> tuple[list[tuple[int, int]], int]:
    """Runs of digits from ``start`` on, each but the first after one character of ``gaps``; where they end."""
    groups = [(start, run_right(text, start, DIGITS))]
    while (end := groups[-1][1]) + 1 < len(text) and text[end] in gaps and text[end + 1] in DIGITS:
        groups.append((end + 1, run_right(text, end + 1, DIGITS)))
    return groups, groups[-1][1]


def chain_start(text: str, at: int, gaps: str) -> int:
    """Where the chain of digit runs around ``at`` starts."""
    start = run_left(text, at + 1, DIGITS)
    while start > 1 and text[start - 1] in gaps and text[start - 2] in DIGITS:
        start = run_left(text, start - 1, DIGITS)
    return start


def find_personal(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data in ``text``, by kind, then start; code points, end exclusive."""
    found = []
    done = dict.fromkeys(KINDS, 0)  # up to where each parser has used the text up

    def keep(kind: str, start: int, end: int) -> None:
        found.append((kind, start, end))
        done[kind] = end

    for last, (anchor, length) in anchors().iter(text):
        at = last + 1 - length
        if anchor == "at":
            if span := email_at(text, at, done["email"]):
                keep("email", *span)
        elif anchor == "number":
            if at >= done["ip"] and text[at + 1] not in " -":
                groups, done["ip"] = number_groups(text, chain_start(text, at, "."), ".")
                for i in range(0, len(groups) - 3, 4):
                    if all(int(text[a:b][-4:]) <= 255 and not text[a:b][:-3].strip("0") for a, b in groups[i : i + 4]):
                        found.append(("ip", groups[i][0], groups[i + 3][1]))
            if at >= done["card"] and text[at + 1] != ".":
                groups, end = number_groups(text, start := chain_start(text, at, " -"), " -")
                done["card"] = end
                digits = "".join(text[a:b] for a, b in groups)
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", start, end))
        elif anchor == "plus":
            if at >= done["phone"]:
                run = end = run_right(text, at + 2, PHONE)
                while end > at + 2 and text[end - 1] not in DIGITS:
                    end -= 1
                if end >= at + 4:
                    done["phone"] = end
                    if 9 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                        found.append(("phone", at, end))
                else:
                    done["phone"] = min(run, at + 1)
        elif anchor == "scheme":
            start = run_left(text, at, ALNUM, done["url"])
            if text[start:at].lower() in SCHEMES and text[at + 3 : at + 4] in ALNUM:
                end = at + 3
                while end < len(text) and text[end] not in URL_STOP:
                    end += 1
                keep("url", start, start + len(text[start:end].rstrip(".,;:!?)]}")))
        elif anchor == "iban":
            if (m := IBAN.match(text, at + length)) and m.start(1) >= done["iban"] and iban_ok(m[1].replace(" ", "")):
                keep("iban", m.start(1), m.end(1))
        elif (m := ACCOUNT.match(text, at + length)) and m.start(1) >= done["account"]:
            keep("account", m.start(1), m.end(1))
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def iban_ok(code: str) -> bool:
    """Mod-97 check of an IBAN without spaces."""
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for each row of ``docs``."""
    spans = "spans array<struct<kind: string, start: bigint, end: bigint>>"
    return derived(docs.select("doc_id", "text"), spans, lambda: lambda texts: [[find_personal(x) for x in texts]])


def op10_personal_data(spark, sf_dir: str) -> DataFrame:
    return digest(personal_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")), BASE)
