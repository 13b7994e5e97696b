"""POSIX extended regular expressions (F4), as ``grep -E`` reads them, for
Spark's ``rlike``.

``to_java`` parses a pattern and writes the Java expression that matches the
same lines; ``rlike`` only asks whether there is a match, so that POSIX's
longest and Java's first match come to the same. What the two read alike but
mean differently is rewritten: bracket expressions, ``a*+`` and ``a+?``
(repeats of repeats), ``$`` (the end, never before a last line break), ``{`` that
opens no interval. What has no counterpart raises ``ValueError``.
"""

from __future__ import annotations

import re

# The character classes of POSIX, as Java classes, for ASCII and for all characters.
_ASCII = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\x0B\f\r\x20", "blank": r"\t\x20",
          "punct": r"!-/:-@\[-`{-~", "cntrl": r"\x00-\x1F\x7F", "print": r"\x20-\x7E", "graph": "!-~", "xdigit": "0-9A-Fa-f"}
_UNICODE = {"alpha": r"\p{IsAlphabetic}\p{Nd}&&[^0-9]", "digit": "0-9", "alnum": r"\p{IsAlphabetic}\p{Nd}", "upper": r"\p{IsUppercase}",
            "lower": r"\p{IsLowercase}", "space": r"\t\n\x0B\f\r\p{Z}&&[^   ]", "blank": r"\t\p{Zs}&&[^   ]",
            "punct": r"[\p{P}\p{S}\p{M}\p{No}]&&[^\p{IsAlphabetic}]", "cntrl": r"\p{Cc}  ", "print": r"[^\p{Cc}\p{Cn}\p{Cs}  ]",
            "graph": r"[^\p{Cc}\p{Cn}\p{Cs}\p{Z}][   ]", "xdigit": "0-9A-Fa-f"}
REPEAT_MOST = 32767
_INTERVAL = re.compile(r"\{([0-9]*)(,?)([0-9]*)\}")
_SPECIAL = set("\\^$.[]|()*+?{}")


def _literal(c: str) -> str:
    return c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):X}}}"


class _Parser:
    def __init__(self, pattern: str, classes: dict[str, str]):
        self.s, self.at, self.classes = pattern, 0, classes

    def fail(self, why: str):
        raise ValueError(f"{why} at position {self.at} of the pattern {self.s!r}")

    def peek(self) -> str:
        return self.s[self.at:self.at + 1]

    def alternatives(self, depth: int) -> str:
        out = [self.branch(depth)]
        while self.peek() == "|":
            self.at += 1
            out.append(self.branch(depth))
        return "|".join(out)

    def branch(self, depth: int) -> str:
        out = []
        while (c := self.peek()) and c != "|" and not (c == ")" and depth):
            if c == ")":
                self.fail("unmatched )")
            atom, repeats = self.atom(depth)
            out.append(self.repeated(atom, repeats))
        return "".join(out)

    def repeated(self, atom: str, may: bool) -> str:
        """An atom with all the repeats that follow it, each of them greedy."""
        while True:
            c = self.peek()
            if c in ("*", "+", "?") and c:
                self.at += 1
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            elif c == "{" and (m := _INTERVAL.match(self.s, self.at)):
                if m[0] == "{}":
                    self.fail("empty interval")
                self.at = m.end()
                low = int(m[1] or 0)
                high = int(m[3]) if m[3] else (None if m[2] else low)
                if low > REPEAT_MOST or (high or 0) > REPEAT_MOST or high is not None and high < low:
                    self.fail("invalid interval")
            else:
                return atom
            if not may:
                self.fail("nothing to repeat")
            # a group of its own: a quantifier behind a quantifier means something else in Java
            atom = f"(?:{atom}){{{low},{'' if high is None else high}}}"

    def atom(self, depth: int) -> tuple[str, bool]:
        c = self.peek()
        if c == "(":
            self.at += 1
            inner = self.alternatives(depth + 1)
            if self.peek() != ")":
                self.fail("unmatched (")
            self.at += 1
            return f"(?:{inner})", True
        if c == "[":
            return self.bracket(), True
        self.at += 1
        if c == ".":
            return ".", True
        if c == "^":
            return r"\A", False
        if c == "$":
            return r"\z", False
        if c in "*+?":
            self.at -= 1
            self.fail("nothing to repeat")
        if c == "\\":
            return self.escape()
        if c == "{" and (m := _INTERVAL.match(self.s, self.at - 1)) and m[0] != "{}":
            self.at -= 1
            self.fail("nothing to repeat")
        return _literal(c), True

    def escape(self) -> tuple[str, bool]:
        c = self.peek()
        if not c:
            self.fail("trailing backslash")
        self.at += 1
        word = f"[{self.classes['alnum']}[_]]"
        ahead, behind = f"(?={word})", f"(?<={word})"
        no_word, no_behind = f"(?!{word})", f"(?<!{word})"
        special = {"w": (word, True), "W": (f"[^{word}]", True), "s": (f"[{self.classes['space']}]", True), "S": (f"[^[{self.classes['space']}]]", True),
                   "<": (no_behind + ahead, False), ">": (behind + no_word, False), "b": (f"(?:{no_behind}{ahead}|{behind}{no_word})", False),
                   "B": (f"(?:{no_behind}{no_word}|{behind}{ahead})", False), "`": (r"\A", False), "'": (r"\z", False)}
        if c in special:
            return special[c]
        if c in _SPECIAL or not c.isalnum():
            return _literal(c), True
        self.at -= 1
        return self.fail("back-reference, which these expressions do not have," if c.isdigit() else "escape of an ordinary character")

    def bracket(self) -> str:
        self.at += 1
        negated = self.peek() == "^"
        self.at += negated
        parts, first = [], True
        while first or self.peek() != "]":
            first = False
            if not self.peek():
                self.fail("unmatched [")
            low = self.element()
            if len(low) > 1:  # a class
                if self.peek() == "-" and self.s[self.at + 1:self.at + 2] not in ("]", ""):
                    self.fail("a class cannot start a range")
                parts.append(f"[{low}]")
                continue
            if self.peek() == "-" and self.s[self.at + 1:self.at + 2] not in ("]", ""):
                self.at += 1
                high = self.element()
                if len(high) > 1 or high < low:
                    self.fail("invalid end of a range")
                parts.append(f"{_literal(low)}-{_literal(high)}")
            else:
                parts.append(_literal(low))
        self.at += 1
        inner = f"[{''.join(parts)}]"
        return f"[^{inner}]" if negated else inner

    def element(self) -> str:
        """A character, or the members of a class (more than one character)."""
        c = self.peek()
        if c == "[" and (kind := self.s[self.at + 1:self.at + 2]) and kind in ":.=":
            end = self.s.find(kind + "]", self.at + 2)
            if end < 0:
                self.fail(f"unmatched [{kind}")
            name = self.s[self.at + 2:end]
            if kind == ":":
                if name not in self.classes:
                    self.fail(f"unknown character class {name!r}")
            elif len(name) != 1:
                self.fail("collating element of more than one character")
            self.at = end + 2
            return self.classes[name] if kind == ":" else name
        self.at += 1
        return c


def to_java(pattern: str, ascii_classes: bool = False) -> str:
    """The Java expression that finds a match in the same lines as the POSIX
    extended expression ``pattern``.

    Classes such as ``[[:alpha:]]`` mean all characters of that kind, or with
    ``ascii_classes`` those of the C locale. GNU's ``\\w \\W \\s \\S \\b \\B \\< \\>``
    are understood. Raises ``ValueError`` for back-references, collating
    elements of several characters, repeats of nothing or of an anchor,
    escapes of ordinary characters, and malformed patterns."""
    p = _Parser(pattern, _ASCII if ascii_classes else _UNICODE)
    out = p.alternatives(0)
    if p.at < len(pattern):
        p.fail("unmatched )")
    return f"(?s)(?:{out})"
