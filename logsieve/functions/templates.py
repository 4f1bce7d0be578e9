"""Message -> template: variable parts are replaced by ``*``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import DIGIT, WORD_CHARS, strip

_NUMBER = f"{DIGIT}+"
_IPV4 = f"{DIGIT}+\\.{DIGIT}+\\.{DIGIT}+\\.{DIGIT}+"
_PATH = f"[/\\\\][{WORD_CHARS}/\\\\.]+"
_UUID = "(?iu)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_MOMENT = f"{DIGIT}{{4}}-{DIGIT}{{2}}-{DIGIT}{{2}}[\\t-\\r\\x1c-\\x20\\x85\\p{{Z}}T]{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}"


def template(message: Column, specific_first: bool = False) -> Column:
    """Template of a message.

    By default numbers are replaced first.  Addresses and moments then hold no digit any more, so
    their rules could not fire and are not evaluated; only an id without digits still can.
    ``specific_first=True`` applies the specific rules before the plain number rule.
    """
    if specific_first:
        steps = [(_MOMENT, "*"), (_UUID, "*"), (_IPV4, "*"), (_PATH, "/*"), (_NUMBER, "*")]
    else:
        steps = [(_NUMBER, "*"), (_PATH, "/*"), (_UUID, "*")]
    for pattern, mark in steps:
        message = F.regexp_replace(message, pattern, mark)
    return strip(message)


def tokens(text: Column) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD_CHARS}]{{2,}}"), 0)


def terms(text: Column) -> Column:
    """Words and pairs of neighbouring words."""
    words = tokens(text)
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)
