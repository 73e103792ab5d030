"""Text columns: stripping, assembly, URL redaction, normalisation, tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tickloom import settings as S

# Whitespace as Python understands it; Java's \s alone is ASCII only.
WS = r"\s\x1c-\x1f\x85\p{Z}"
URL_IN_TEXT = rf"https?://[^{WS}<>\"']+"
WORD = r"[\p{L}\p{N}]+"


def _accent_pairs() -> tuple[str, str]:
    """Lower-case Latin letters with one accent, and the letters without it."""
    accented, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if letter.islower() and len(parts) == 2 and "a" <= parts[0] <= "z":
            accented.append(letter)
            plain.append(parts[0])
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _accent_pairs()


def widen_whitespace(pattern: str) -> str:
    r"""Give a regex the wide meaning of ``\s`` outside of its own classes."""
    return pattern.replace(r"\s", f"[{WS}]")


def any_of(patterns: Sequence[str]) -> str:
    """One case-insensitive alternation for a list of regexes."""
    return "(?iu)" + "|".join(f"(?:{widen_whitespace(p)})" for p in patterns)


def strip(col: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(col, f"^[{WS}]+|[{WS}]+$", "")


def clean_url(url: Column) -> Column:
    """NULL for internal ``file://`` addresses."""
    return F.when(~url.startswith("file://"), url)


def _redact_query(url: Column, keys: Sequence[str]) -> Column:
    """Redact in a chain of whole-string replacements. Each leaves a URL alone
    that it does not concern, so no part is cut out and computed twice."""
    names = "|".join(rf"\Q{k}\E" for k in keys)
    key = rf"(?i:{names})="
    # From the first "?" on, or from where the last replacement ended: pass over
    # the parameters that are not sensitive, then replace one value.
    steps = [
        (rf"(^[^?#]*\?|\G(?!^)&)((?:(?!{key})[^&#]*&)*)({key})[^&#]*",
         rf"$1$2$3{S.REDACTED}"),
        # A URL with a query is written back without an empty fragment and
        # without an empty parameter list at the end of its path.
        (r"^([^?#]*\?[^#]+)#$", "$1"),
        (r"^(https?://[^/?#]*/(?:[^?#]*/)?[^/;?#]*);(?=\?[^#])", "$1"),
    ]
    for pattern, replacement in steps:
        url = F.regexp_replace(url, pattern, replacement)
    return url


def scrub_url(url: Column, keys: Sequence[str] = S.SENSITIVE_URL_KEYS) -> Column:
    """Replace the values of sensitive query parameters with ``[REDACTED]``.

    Only the first ``#`` and the first ``?`` split. Keys are compared raw and
    without case. A URL without a query, or with an unbalanced or malformed
    bracketed host, is returned as it is.
    """
    if not keys:
        return url
    has_query = url.rlike(r"^[^?#]*\?[^#]")
    bad_host = url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*[\[\]]") & ~url.rlike(
        r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?"
        r"\[(?:[0-9A-Fa-f.]*:[0-9A-Fa-f:.]*(?:%[^\]/?#]*)?|v[0-9A-Fa-f]+\.[^\]/?#]+)\](?::[^/?#]*)?(?:[/?#]|$)"
    )
    # Only odd URLs need these: control characters, an upper-case scheme.
    plain = F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")
    scheme = F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    written = F.when(
        url.rlike(r"^[\x00-\x20]|[\t\r\n]|^[A-Za-z0-9+.-]*[A-Z][A-Za-z0-9+.-]*:"),
        F.concat(F.lower(scheme), F.substr(plain, F.length(scheme) + 1)),
    ).otherwise(url)
    return F.when(has_query & ~bad_host, _redact_query(written, keys)).otherwise(url)


def scrub_text_urls(text: Column, keys: Sequence[str] = S.SENSITIVE_URL_KEYS) -> Column:
    """Scrub every URL inside a text, leaving the rest as it is.

    Texts with no URL that has a query, which is most of them, skip the split.
    """
    if not keys:
        return text
    gaps = F.split(text, URL_IN_TEXT, -1)
    urls = F.regexp_extract_all(text, F.lit(URL_IN_TEXT), F.lit(0))

    # Found URLs start with a plain scheme and hold no whitespace.
    def scrub(url: Column) -> Column:
        brackets = url.rlike(r"^https?://[^/?#]*[\[\]]")
        return F.when(brackets, scrub_url(url, keys)).otherwise(_redact_query(url, keys))

    woven = F.zip_with(
        gaps, F.transform(urls, scrub), lambda g, u: F.concat(g, F.coalesce(u, F.lit("")))
    )
    return F.when(
        text.rlike(rf"https?://[^{WS}<>\"'?]*\?"), F.array_join(woven, "")
    ).otherwise(text)


def assemble_text(
    texts: Column, title: Column, max_length: int = S.MAX_TEXT_LENGTH
) -> Column:
    """Join the distinct strings that differ from the title, first ones first."""
    return F.left(
        F.array_join(
            F.filter(F.array_distinct(texts), lambda t: t != title), S.TEXT_SEPARATOR
        ),
        F.lit(max_length),
    )


def normalise_text(text: Column) -> Column:
    """Drop what ticks by itself on a screen: timers, counters, spinners."""
    steps = [
        # 00:03 / 15:27, counters, braille and clock spinners.
        (r"\b[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?( ?/ ?[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?\b", ""),
        (r"(?i)\b[0-9][0-9,.]* ?(words?|characters?|chars?|comments?)\b", ""),
        (r"[⠁-⣿◐◓◑◒◴◷◶◵]", ""),
        (r" {2,}", " "),
    ]
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(text)


def fold(text: Column) -> Column:
    """Lower case without accents, as words are compared in search; accents that
    are characters of their own go too."""
    plain = F.octet_length(text) == F.length(text)  # ASCII, which has no accents
    folded = F.translate(F.lower(F.regexp_replace(text, r"\p{M}+", "")), ACCENTED, PLAIN)
    return F.when(plain, F.lower(text)).otherwise(folded)


def tokens(text: Column) -> Column:
    """All folded words of a text, repeats kept."""
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))
