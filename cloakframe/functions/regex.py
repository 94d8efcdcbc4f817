"""Python patterns on the JVM: a translation of the classes that differ, and all matches with their offsets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.schema import SPAN, empty, let


WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r" \t\n\r\f\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_SETS = {"w": WORD, "d": DIGIT, "s": SPACE}
BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
NO_BOUNDARY = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"


#: Private-use marks put around matches, and what stands for them when a text holds them itself.
OPEN, CLOSE, STAND_IN = "\ue000", "\ue001", "\ue002"


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """The Java pattern with the meaning of a Python one on str.

    Raises ValueError for patterns that match the empty text, and for what Java can't say.
    """
    if re.compile(pattern).search("") is not None:
        raise ValueError(f"the pattern matches an empty text: {pattern!r}")
    out, i, inside, negated = [], 0, False, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            i += 2
            if e.lower() in _SETS:
                chars = _SETS[e.lower()]
                if e.islower():
                    out.append(chars if inside else f"[{chars}]")
                elif inside and negated:
                    raise ValueError(f"\\{e} in a negated set: {pattern!r}")
                else:
                    out.append(f"[^{chars}]")
            elif e == "b":
                out.append(r"\x08" if inside else BOUNDARY)
            elif e == "B":
                out.append(NO_BOUNDARY)
            elif e == "v":
                out.append(r"\x0B")
            elif e == "Z":
                out.append(r"\z")
            else:
                out.append("\\" + e)
            continue
        if inside:
            if c == "]":
                inside = False
            elif c in "[&":
                c = "\\" + c
            out.append(c)
            i += 1
            continue
        if c == "[":
            inside, negated = True, pattern[i + 1 : i + 2] == "^"
            out.append("[^" if negated else "[")
            i += 2 if negated else 1
            if pattern[i : i + 1] == "]":
                out.append(r"\]")
                i += 1
            continue
        if pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        if pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(f"\\k<{pattern[i + 4 : end]}>")
            i = end + 1
            continue
        if pattern.startswith(("(?(", "(?P>"), i):
            raise ValueError(f"no conditional groups: {pattern!r}")
        out.append(c)
        i += 1
    # A match that has to begin with a digit is ruled out by one look at most positions.
    ahead = f"(?=[{DIGIT}])" if begins_with_digit(re._parser.parse(pattern)) else ""
    body = "".join(out)
    return f"(?{'dui' if ignore_case else 'd'}){ahead}(?:{body})" if ahead else f"(?{'dui' if ignore_case else 'd'})" + body


def begins_with_digit(parsed) -> bool:
    """Does every match of a parsed pattern begin with a digit?"""
    for kind, value in parsed:
        name = str(kind)
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if name == "LITERAL":
            return chr(value).isdecimal()
        if name == "IN":
            return all(
                (str(k) == "LITERAL" and chr(v).isdecimal()) or (str(k) == "CATEGORY" and str(v).endswith("CATEGORY_DIGIT")) or (str(k) == "RANGE" and all(48 <= x <= 57 for x in v)) for k, v in value
            )
        if name == "SUBPATTERN":
            return begins_with_digit(value[-1])
        if name == "BRANCH":
            return all(begins_with_digit(b) for b in value[1])
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, _, body = value
            if not begins_with_digit(body):
                return False
            if low:
                return True
            continue
        return False
    return False


def needed(pattern: str, ignore_case: bool = False) -> str:
    """A text that every match of the Python pattern holds ("" if none is plain to see): the longest run of literals at its top level."""
    best, run = "", ""
    if ignore_case:
        return ""
    parsed = re._parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return ""
    for kind, value in parsed:  # literals of a scoped group aren't at the top level
        run = run + chr(value) if str(kind) == "LITERAL" else ""
        best = max(best, run, key=len)
    return best


def escaped(fragment: Column) -> Column:
    """The fragment as a pattern for itself."""
    return F.regexp_replace(fragment, r"([!-/:-@\[-`{-~])", r"\\$1")


def bounded(fragment: Column | str, ignore_case: bool = True) -> Column:
    """Pattern for a fragment that no word character stands next to."""
    fragment = F.lit(fragment) if isinstance(fragment, str) else fragment
    return F.concat(F.lit(f"(?{'dui' if ignore_case else 'd'})(?<![{WORD}])"), escaped(fragment), F.lit(f"(?![{WORD}])"))


def bounded_literal(fragment: str, ignore_case: bool = True) -> str:
    """The same for a fragment known when the plan is made."""
    quoted = re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", fragment)
    return f"(?{'dui' if ignore_case else 'd'})(?<![{WORD}]){quoted}(?![{WORD}])"


def _before(sizes: Column) -> Column:
    """Sum of the numbers before each one of an array, in sums of 16 and of 256.

    A fold that lists sums copies its list for each one.
    """
    total = lambda numbers: F.aggregate(numbers, F.lit(0), lambda s, x: s + x)
    part = lambda numbers, i: total(F.slice(numbers, i - i % 16 + 1, i % 16))
    sums = lambda numbers: F.transform(F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(16)), lambda at: total(F.slice(numbers, at, F.lit(16))))
    nth = lambda bases, i: F.get(bases, F.floor(i / 16).cast("int"))

    def by_16(sizes: Column, tens: Column, more: Column) -> Column:
        bases = F.transform(more, lambda _, g: total(F.slice(more, F.lit(1), g)))
        return let(let(bases, lambda b: F.transform(tens, lambda _, t: nth(b, t) + part(tens, t))), lambda b: F.transform(sizes, lambda _, i: nth(b, i) + part(sizes, i)))

    return let(sizes, lambda s: let(sums(s), lambda tens: let(sums(tens), lambda more: by_16(s, tens, more))))


def find_all(text: Column, pattern: Column | str, must_hold: str = "") -> Column:
    """All matches from left to right, array<struct<text,start,end>>; null text has none.

    With `must_hold`, texts without that string aren't searched.

    Matches are marked in place and the pieces' lengths added up, which keeps everything
    in one JVM expression; texts without a match stop at the test. Each match is read off its piece, and
    positions come from `_before`, so that the work doesn't grow with the square of the matches.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked_already = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))
    safe = F.when(marked_already, F.translate(text, OPEN + CLOSE, STAND_IN * 2)).otherwise(text)

    def listed(pieces: Column) -> Column:
        def one(start: Column, piece: Column) -> Column:
            match = F.substring_index(piece, CLOSE, 1)
            return F.struct(match.alias("text"), start.alias("start"), (start + F.length(match)).alias("end"))

        sizes = F.transform(pieces, lambda piece, i: F.length(piece) - F.when(i == 0, F.lit(0)).otherwise(F.lit(1)))
        return let(_before(sizes), lambda starts: F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda piece, i: let(F.get(starts, i + 1), lambda start: one(start, piece))))

    def original(spans: Column) -> Column:
        again = F.transform(spans, lambda s: F.struct(F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(marked_already, again).otherwise(spans)

    found = let(let(F.split(F.regexp_replace(safe, p, F.lit(f"{OPEN}$0{CLOSE}")), OPEN), listed), original)
    some = F.coalesce(F.regexp_like(text, p), F.lit(False))
    if must_hold:
        some = F.contains(text, F.lit(must_hold)) & some
    return F.when(some, found).otherwise(empty(f"array<{SPAN}>"))
