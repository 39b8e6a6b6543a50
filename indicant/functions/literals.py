"""Texts that every match of a regular expression contains.

A pattern is read with the standard library's parser.  What stands in a row, is repeated at
least once or is one of alternatives gives sets of texts, of each of which a match contains
one.  Letters count in either case; characters with unusual cases end a text.
"""

from __future__ import annotations

import re
import re._constants as K
import re._parser as parser

#: Characters that match ASCII letters when case is ignored, and those letters.
FOLDED = ("İıſK", "iisk")
#: Alternatives beyond which a set is of no use.
MOST = 64


def sets_of(items) -> list[frozenset[str]]:
    """The sets of a parsed sequence."""
    out, run = [], []

    def close() -> None:
        if run:
            out.append(frozenset(["".join(run)]))
            run.clear()

    for op, value in items:
        if op is K.LITERAL and value < 128:
            run.append(chr(value).lower())
            continue
        if op is K.SUBPATTERN and value[0] is None and all(o is K.LITERAL and v < 128 for o, v in value[3]):
            run.extend(chr(v).lower() for _, v in value[3])
            continue
        close()
        if op in (K.SUBPATTERN, K.ATOMIC_GROUP):
            out += sets_of(value[3] if op is K.SUBPATTERN else value)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] >= 1:
            out += sets_of(value[2])
        elif op is K.BRANCH:
            each = [max(sets_of(b), key=worth, default=None) for b in value[1]]
            if None not in each and len(joined := frozenset().union(*each)) <= MOST:
                out.append(joined)
    close()
    return out


def worth(texts: frozenset[str]) -> tuple[int, int]:
    return min(map(len, texts)), -len(texts)


def required(pattern: str, shortest: int) -> list[list[str]] | None:
    """Sets of texts of ``shortest`` characters or more, of each of which every match contains one; None if the pattern cannot be read.

    A value is to be looked at in lower case after FOLDED.
    """
    try:
        found = sets_of(parser.parse(pattern, re.IGNORECASE))
    except (re.error, OverflowError, RecursionError):
        return None
    return [sorted(s) for s in dict.fromkeys(found) if min(map(len, s)) >= shortest]
