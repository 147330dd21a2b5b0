"""Which words a pattern cannot match without: read off the pattern when a job is built, to try it only on texts that hold one of them."""

from __future__ import annotations

from functools import cache
from re import _constants as kinds, _parser as parser

from pyspark.sql import Column, functions as F


def folded(text: Column) -> Column:
    """The text in one case, as matching without regard to case sees it (long s, Kelvin sign and the Turkish i's included)."""
    return F.lower(F.upper(F.translate(text, "İ", "i")))


def _better(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    """The set that fewer texts will pass: the longer shortest word, then fewer words."""
    worth = lambda s: (min(map(len, s), default=0), -len(s))
    return a if worth(a) >= worth(b) else b


def _required(items: list) -> frozenset[str]:
    """Words of which every match of the sequence holds at least one; empty if there is no such set."""
    best: frozenset[str] = frozenset()
    run = ""
    for op, arg in [*items, (None, None)]:
        if op is kinds.LITERAL:
            run += chr(arg)
            continue
        if run:
            best, run = _better(best, frozenset([run.lower()])), ""
        if op is kinds.SUBPATTERN:
            best = _better(best, _required(list(arg[3])))
        elif op is kinds.BRANCH:
            sides = [_required(list(side)) for side in arg[1]]
            if all(sides):
                best = _better(best, frozenset().union(*sides))
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and arg[0] > 0:
            best = _better(best, _required(list(arg[2])))
    return best


@cache
def required_words(pattern: str) -> tuple[str, ...]:
    """Lower-case words, sorted: a text without any of them cannot match ``pattern``. Empty when the pattern needs none."""
    return tuple(sorted(_required(list(parser.parse(pattern)))))


def may_match(folded_text: Column, pattern: str) -> Column:
    """True where the text (``folded``) holds a word that the pattern needs."""
    out = F.lit(False)
    words = required_words(pattern)
    for word in words:
        out = out | F.contains(folded_text, F.lit(word))
    return out if words else F.lit(True)
