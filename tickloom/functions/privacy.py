"""Privacy predicates. All are native column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from tickloom import settings as S
from tickloom.functions.text import any_of


# The only letters outside ASCII that equal an ASCII letter but for case.
_ODD_LETTERS, _THEIR_ASCII = "ſKİı", "skii"


def _needed_word(pattern: str) -> str | None:
    """A plain word that any match of the pattern must contain, if one is easy
    to see."""
    bare = re.sub(r"\\.", " ", pattern)
    while re.search(r"\([^()]*\)|\[[^\]]*\]", bare):
        bare = re.sub(r"\([^()]*\)[?*+]?|\[[^\]]*\][?*+]?", " ", bare)
    if "|" in bare or "(" in bare or "{" in bare:
        return None
    # A letter under a quantifier may be absent.
    words = re.findall(r"[a-z]{3,}", re.sub(r".[?*]", " ", bare))
    return max(words, key=len) if words else None


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """Some pattern is found in the text, whatever the case.

    Looking for a plain word costs far less than trying a list of regexes at
    every position, so each regex runs only where a word it needs occurs.
    """
    text = F.coalesce(text, F.lit(""))
    odd = reduce(or_, [text.contains(letter) for letter in _ODD_LETTERS])
    lowered = F.lower(
        F.when(odd, F.translate(text, _ODD_LETTERS, _THEIR_ASCII)).otherwise(text)
    )
    by_word: dict[str | None, list[str]] = {}
    for pattern in patterns:
        by_word.setdefault(_needed_word(pattern), []).append(pattern)
    tests = [
        text.rlike(any_of(group)) if word is None
        else lowered.contains(word) & text.rlike(any_of(group))
        for word, group in by_word.items()
    ]
    return reduce(or_, tests)


def is_app_blocked(app: Column, blocked: Sequence[str] = S.BLOCKED_APPS) -> Column:
    """The app is on the blocklist, whatever its case."""
    return F.lower(app).isin([name.lower() for name in blocked])


def is_private_window(title: Column, *attributes: Column) -> Column:
    """The title, or one of the window's attributes, marks a private window."""
    hit = matches_any(title, S.PRIVATE_TITLE_PATTERNS)
    for attribute in attributes:
        lowered = F.lower(F.coalesce(attribute, F.lit("")))
        for word in S.PRIVATE_ATTRIBUTE_WORDS:
            hit = hit | lowered.contains(word)
    return hit


def is_sensitive_page(
    title: Column,
    text: Column,
    extra_title: Sequence[str] = (),
    extra_content: Sequence[str] = (),
) -> Column:
    """The title or the text shows credentials, payment or banking data."""
    return matches_any(title, [*S.SENSITIVE_TITLE_PATTERNS, *extra_title]) | matches_any(
        text, [*S.SENSITIVE_CONTENT_PATTERNS, *extra_content]
    )


def is_secure_field(subrole: Column, secure: Sequence[str] = S.SECURE_SUBROLES) -> Column:
    """The node is a password field."""
    return F.coalesce(subrole.isin(list(secure)), F.lit(False))
