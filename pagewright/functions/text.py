"""Scalar text functions as column expressions, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_unicode(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def fields(c: Column) -> Column:
    """Tokens between runs of white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def name_words(c: Column) -> Column:
    """Lower-case tokens of a file name or query."""
    return F.filter(F.split(F.lower(c), r"[ _\-.()\[\]]"), lambda w: w != "")


def byte_length(c: Column) -> Column:
    return F.octet_length(c).cast("long")


def contains_folded(c: Column, part: str) -> Column:
    return F.contains(F.lower(c), F.lower(F.lit(part)))


def cut_bytes(c: Column, n: Column) -> Column:
    """The first n bytes of a text; a character cut in two becomes the replacement character."""
    return F.make_valid_utf8(F.substring(F.encode(c, "utf-8"), F.lit(1), n.cast("int")).cast("string"))


def shown(c: Column, n: int = 100) -> Column:
    """A preview of at most n bytes."""
    return F.when(F.octet_length(c) > n, F.concat(cut_bytes(c, F.lit(n)), F.lit("..."))).otherwise(c)


def timestamp_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def glob_regex(pattern: str) -> str | None:
    """An anchored regular expression for a shell pattern over one name; None if it is malformed.

    ``*`` and ``?`` do not match a slash, classes may be negated by ``^``, a backslash
    quotes the next character.
    """
    out, k, n = [], 0, len(pattern)
    quote = lambda c: c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c
    while k < n:
        c = pattern[k]
        k += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if k == n:
                return None
            out.append(quote(pattern[k]))
            k += 1
        elif c == "[":
            items, negated = [], k < n and pattern[k] == "^"
            k += negated

            def member() -> str | None:
                nonlocal k
                if k >= n or pattern[k] in "-]":
                    return None
                if pattern[k] == "\\":
                    k += 1
                    if k >= n:
                        return None
                k += 1
                return pattern[k - 1]

            while True:
                if k < n and pattern[k] == "]" and items:
                    k += 1
                    break
                low = member()
                if low is None:
                    return None
                high = low
                if k < n and pattern[k] == "-":
                    k += 1
                    high = member()
                    if high is None:
                        return None
                items.append((low, high))
            ranges = "".join(quote(a) + "-" + quote(b) for a, b in items if a <= b)
            if ranges:
                out.append(f"[{'^' if negated else ''}{ranges}]")
            else:
                out.append("[^/]" if negated else "(?!)")
        else:
            out.append(quote(c))
    return "^(?s:" + "".join(out) + ")$"


def glob_ends(pattern: str) -> tuple[str, str]:
    """What every name that a well-formed shell pattern matches begins and ends with."""
    special = [k for k, c in enumerate(pattern) if c in "*?[]\\"]
    return (pattern[: special[0]], pattern[special[-1] + 1 :]) if special else (pattern, pattern)
