"""Straightforward single-threaded versions of the reference semantics (from
"""

from __future__ import annotations

import re

DIGITS = b"0123456789"


def split_pages(data: bytes) -> list[tuple[int, bytes]]:
    out, cur = [], 0
    while True:
        s = data.find(b"<page>", cur)
        if s < 0:
            break
        e = data.find(b"</page>", s)
        if e < 0:
            break
        e += 7
        out.append((s, data[s:e]))
        cur = e
    return out


def extract(page: bytes) -> tuple[bytes, bytes] | None:
    ts = page.find(b"<title>")
    if ts < 0:
        return None
    ts += 7
    te = page.find(b"</title>", ts)
    if te < 0:
        return None
    tt = page.find(b"<text", te)
    if tt < 0:
        return None
    gt = page.find(b">", tt)
    if gt < 0:
        return None
    xe = page.find(b"</text>", gt + 1)
    if xe < 0:
        return None
    return page[ts:te], page[gt + 1:xe]


def _run(text: bytes, s: int) -> tuple[int, int]:
    n = len(text)
    while s < n and text[s] in b" :=":
        s += 1
    e = s
    while e < n and (text[e] in DIGITS or text[e] in b"-Xx "):
        e += 1
    while e > s and text[e - 1] in b" -":
        e -= 1
    return s, e


def _to_bar(text: bytes, s: int) -> int:
    e = s
    while e < len(text) and text[e] not in b"|}":
        e += 1
    return e


def _ndigits(v: bytes) -> int:
    return sum(1 for c in v if c in DIGITS)


BASIC_RUN = re.compile(rb"ISBN[ :=]*([0-9Xx -]*)")
BASIC_TEMPLATE = re.compile(rb"\{\{BibISBN\|([^|}]*)")


def basic_isbns(text: bytes) -> list[bytes]:
    """Values by the rules: from each token's end, the next template or marker
    word, whichever starts first; a value of 9 to 17 bytes with 10 or 13 digits."""
    out, at = [], 0
    while found := [m for m in (BASIC_RUN.search(text, at), BASIC_TEMPLATE.search(text, at)) if m]:
        m = min(found, key=lambda m: m.start())
        value = m[1].rstrip(b" -") if m.re is BASIC_RUN else m[1]
        if 9 <= len(value) <= 17 and _ndigits(value) in (10, 13):
            out.append(value)
        at = m.start(1) + len(value)
    return out


# The markers of the extended dialect (and, in basic_isbns, of the basic one).
EXT_MARKERS = [b"ISBN ", b"ISBN:", b"ISBN-10:", b"ISBN-13:", b"ISBN-10 ", b"ISBN-13 ", b"{{ISBN|",
               b"{{BibISBN|", b"ISBN=", b"isbn=", b"ISBN&nbsp;"]


def checksum(v: bytes) -> bool | None:
    ds = [c - 48 for c in v if c in DIGITS]
    x = v[-1:] in (b"X", b"x")
    if not 9 <= len(v) <= 17:
        return None
    if len(ds) == 10 or (len(ds) == 9 and x):
        calc = (11 - sum(d * w for d, w in zip(ds[:9], range(10, 1, -1))) % 11) % 11
        return calc == (10 if x else ds[-1])
    if len(ds) == 13:
        head = [c - 48 for c in v[:-1] if c in DIGITS]
        calc = (10 - sum(d * (1 if k % 2 == 0 else 3) for k, d in enumerate(head)) % 10) % 10
        return (not x) and calc == ds[-1]
    return None


def extended_isbns(text: bytes) -> list[tuple[bytes, bool]]:
    out = []
    for j in range(len(text)):
        for k, m in enumerate(EXT_MARKERS):
            if text.startswith(m, j):
                if k in (6, 7):
                    s = j + len(m)
                    e = _to_bar(text, s)
                    while s < len(text) and text[s] in b" :=":
                        s += 1
                else:
                    s, e = _run(text, j + len(m))
                v = text[s:e]
                ok = checksum(v) if s < e else None
                if ok is not None:
                    out.append((v, ok))
    return out


def hits(text: str, term: str) -> list[int]:
    """0-based character offsets of all (overlapping) occurrences."""
    out, i = [], text.find(term) if term else -1
    while i >= 0:
        out.append(i)
        i = text.find(term, i + 1)
    return out
