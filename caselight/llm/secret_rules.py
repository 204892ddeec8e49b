"""Secret rules, and the Boolean trigram query that each rule's pattern implies."""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """``pattern`` reads the same in Java and Python. A match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0


# A private key goes on to its END line, over header lines (which have dashes) or without any dash; without an END
# line, over the base64 that follows.
_KEY_END = r"-----END [A-Z ]*PRIVATE KEY-----"
_KEY = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*" + _KEY_END
        + r"|[\\\x09-\x0D\x20rn]*[A-Za-z][A-Za-z0-9-]*:[\s\S]*?" + _KEY_END
        + r"|[\\\x09-\x0D\x20]+[A-Za-z0-9+/]{16,}[A-Za-z0-9+/=\\\x09-\x0D\x20]*)?")

# The base rules (first three) and the rules added to them.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         any_case=True, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
    Rule("private_key", _KEY),
    Rule("code_host", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("web_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}", any_case=True),
    Rule("url_login", r"""://[^/\x00-\x20:@"'<>]+:[^/\x00-\x20:@"'<>]{3,}@"""),
)
BASE_KINDS = ("assign", "access", "hex")

#: A pattern part with more spellings than this is taken as unknown text.
MAX_SPELLINGS = 64

Alternatives = frozenset[frozenset[str]]


def _spellings(items) -> set[str] | None:
    """All texts that a pattern part can match, or None if they are many or unbounded."""
    found = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            more = {chr(arg)}
        elif op is sre.IN and all(kind is sre.LITERAL for kind, _ in arg):
            more = {chr(c) for _, c in arg}
        elif op is sre.SUBPATTERN:
            more = _spellings(arg[-1])
        elif op is sre.BRANCH:
            parts = [_spellings(x) for x in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif op is sre.MAX_REPEAT and arg[1] <= 8:
            once = _spellings(arg[2])
            more = once and {"".join(p) for n in range(arg[0], arg[1] + 1) for p in _products(once, n)}
        else:
            more = None
        if more is None or len(found) * len(more) > MAX_SPELLINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def _products(texts: set[str], n: int):
    made = [""]
    for _ in range(n):
        made = [a + b for a in made for b in texts][: MAX_SPELLINGS + 1]
    return made


def trigram_query(pattern: str) -> list[Alternatives]:
    """Clauses that hold for every text the pattern matches: in each, all trigrams of one alternative occur.

    Trigrams are of the text with A-Z lower-cased. Adjacent parts with few spellings are joined first, so
    that trigrams across them count. No clause: the rule has no mandatory trigram and scans fully.
    """
    clauses: list[Alternatives] = []
    run: set[str] = {""}

    def close(texts: set[str]) -> None:
        if texts and min(map(len, texts)) >= 3:
            sets = {frozenset(t.lower()[i : i + 3] for i in range(len(t) - 2)) for t in texts}
            clauses.append(frozenset(s for s in sets if not any(o < s for o in sets)))

    for item in parser.parse(pattern):
        texts = _spellings([item])
        if texts is None or len(run) * len(texts) > MAX_SPELLINGS:
            close(run)
            run = texts or {""}
        else:
            run = {a + b for a in run for b in texts}
    close(run)
    return clauses
