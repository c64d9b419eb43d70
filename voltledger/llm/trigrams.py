"""Boolean trigram queries of regular expressions.

``query(pattern)`` gives clauses, of which a matching text satisfies at least one: a clause is the set of trigrams that all occur in the text.
None means that some way to match has no mandatory trigram, so every text has to be scanned. Computed on the driver, once a rule.
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser

MAX_WAYS = 64


def _runs(nodes) -> list[list[str]]:
    """Ways to match a sequence; each is the list of its literal runs, with breaks between them."""
    ways = [[""]]
    for op, arg in nodes:
        if op is c.LITERAL:
            step = [[chr(arg)]]
        elif op is c.IN and len(arg) <= 8 and all(o is c.LITERAL for o, _ in arg):
            step = [[chr(x)] for _, x in arg]
        elif op is c.SUBPATTERN:
            step = _runs(arg[3])
        elif op is c.BRANCH:
            step = [w for part in arg[1] for w in _runs(part)]
        elif op in (c.AT, c.ASSERT, c.ASSERT_NOT):
            continue
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            low, high, body = arg
            once = _runs(body)
            if (low, high) == (0, 1):
                step = [[""], *once]
            elif low == high and low * max(len(r) for w in once for r in w) <= 64 and len(once) == 1 and len(once[0]) == 1:
                step = [[once[0][0] * low]]
            elif low >= 1:
                step = [[*w, ""] for w in once]
            else:
                step = [["", ""]]
        else:
            step = [["", ""]]
        if len(ways) * len(step) > MAX_WAYS:
            step = [["", ""]]
        ways = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in ways for b in step]
    return ways


def query(pattern: str, ignore_case: bool = False) -> list[frozenset[str]] | None:
    clauses = set()
    for way in _runs(parser.parse(pattern)):
        grams = frozenset(r[i : i + 3].lower() if ignore_case else r[i : i + 3] for r in way for i in range(len(r) - 2))
        if not grams:
            return None
        clauses.add(grams)
    return sorted((x for x in clauses if not any(y < x for y in clauses)), key=sorted)
