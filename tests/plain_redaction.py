"""Redaction in plain Python, by the library's patterns: what the expression has to equal."""

from __future__ import annotations

import re

from cartulary.functions import redact as fixed

HOME, BEARER, RUN, EMAIL = (re.compile(p) for p in (fixed.HOME, fixed.BEARER, fixed.RUN, fixed.EMAIL))
PAIRS, TOKENS = [re.compile(p) for p in fixed.PAIRS], [re.compile(p) for p in fixed.TOKENS]
HARMLESS = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{40}")


def harmless(value: str) -> bool:
    value = value.strip()
    return not value or "[REDACTED_" in value or bool(HARMLESS.fullmatch(value))


def random_run(value: str) -> bool:
    if harmless(value) or value.count("/") >= 2:
        return False
    kinds = (re.search(k, value) for k in ("[a-z]", "[A-Z]", "[0-9]"))
    return len(set(value.rstrip("="))) > 20 or all(kinds)


class Redactor:
    """One text's placeholders and count."""

    def __init__(self):
        self.names: dict[str, str] = {}
        self.count = 0

    def name(self, kind: str, literal: str) -> str:
        self.count += 1
        if literal not in self.names:
            size = "" if kind == "EMAIL" else f" len={len(literal.encode())}"
            self.names[literal] = f"[REDACTED_{kind}_{len(self.names) + 1}{size}]"
        return self.names[literal]

    def pair(self, m: re.Match) -> str:
        value = m[2].strip()
        end = m[3] if m.re.groups > 2 else ""
        return m[0] if harmless(value) else m[1] + self.name("SECRET", value) + end

    def alone(self, m: re.Match) -> str:
        return m[0] if harmless(m[0]) else self.name("SECRET", m[0])

    def run(self, m: re.Match) -> str:
        return self.name("SECRET", m[0]) if random_run(m[0]) else m[0]

    def redact(self, text: str) -> str:
        out = HOME.sub("~/", text)
        out = BEARER.sub(lambda m: m[1] + self.name("SECRET", m[2]), out)
        for pattern in PAIRS:
            out = pattern.sub(self.pair, out)
        for pattern in TOKENS:
            out = pattern.sub(self.alone, out)
        out = RUN.sub(self.run, out)
        return EMAIL.sub(lambda m: self.name("EMAIL", m[0]), out)


def redact_text(text: str) -> tuple[str, int]:
    one = Redactor()
    return one.redact(text), one.count
