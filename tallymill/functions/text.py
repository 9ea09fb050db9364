"""SQL expression text for message tests and captures.

The message jobs are a few very wide projections. Their expressions are composed as Spark SQL text and
handed to ``selectExpr``, which costs one call per column instead of one per operator.

Pattern text is written with two extra marks, ``\\<`` and ``\\>``, for the start and the end of an
ASCII word. Java's own ``\\b`` treats accented letters as word characters, the rules here do not.
"""

from __future__ import annotations

import re

MONEY = r"([\d,]+(?:\.\d{1,2})?)"
BLANKS = " \t\n\x0b\f\r"

# Unicode blanks that count as white space in message text, and the separators that
# count as line ends.
UNICODE_BLANKS = (
    "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\ufeff"
)
UNICODE_LINE_ENDS = "\u2028\u2029"


def lit(value: str | int | float | bool | None) -> str:
    """SQL literal of a Python value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(values: list) -> str:
    return f"array({', '.join(lit(v) for v in values)})"


def rx(pattern: str, flags: str = "i") -> str:
    """Turn marked pattern text into a Java pattern with inline flags.

    A start mark before a letter becomes that letter followed by a look-behind, so that a position fails
    on the letter before anything else is checked.
    """
    text = re.sub(r"\\<([A-Za-z])", r"\1(?<![A-Za-z0-9_]\1)", pattern)
    text = text.replace(r"\<", "(?<![A-Za-z0-9_])").replace(r"\>", "(?![A-Za-z0-9_])")
    return f"(?{flags}){text}" if flags else text


def has(col: str, pattern: str, flags: str = "i") -> str:
    return f"rlike({col}, {lit(rx(pattern, flags))})"


def grab(col: str, pattern: str, group: int = 1, flags: str = "i") -> str:
    """First capture of the first hit; the empty string when nothing matches."""
    return f"regexp_extract({col}, {lit(rx(pattern, flags))}, {group})"


def contains(col: str, phrase: str) -> str:
    return f"contains({col}, {lit(phrase)})"


def any_of(col: str, phrases: list[str]) -> str:
    """Any phrase is a substring; a list becomes one constant array instead of a long OR."""
    if len(phrases) == 1:
        return contains(col, phrases[0])
    return f"exists({array(phrases)}, p -> contains({col}, p))"


def all_of(col: str, phrases: list[str]) -> str:
    return both([contains(col, p) for p in phrases])


def either(tests: list[str]) -> str:
    return "(" + " OR ".join(tests) + ")"


def both(tests: list[str]) -> str:
    return "(" + " AND ".join(tests) + ")"


def when(test: str, value: str, otherwise: str = "NULL") -> str:
    return f"CASE WHEN {test} THEN {value} ELSE {otherwise} END"


def first_of(cases: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    """Ordered CASE: the value of the first test that holds."""
    if not cases:
        return otherwise
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in cases) + f" ELSE {otherwise} END"


def coalesce(values: list[str]) -> str:
    return values[0] if len(values) == 1 else f"coalesce({', '.join(values)})"


def gated_grab(
    col: str, lowered: str, anchors: list[str], pattern: str, group: int = 1, flags: str = "i"
) -> str:
    """Capture behind a cheap substring test; some anchor must be part of every possible hit."""
    return when(any_of(lowered, anchors), grab(col, pattern, group, flags), "''")


def first_hit(captures: list[str]) -> str:
    """First non-empty capture of a list, null when all are empty; every capture is written once, and made only where those
    before it are empty."""
    return coalesce([f"get(filter(array({capture}), c -> c <> ''), 0)" for capture in captures])


def first_money(captures: list[str], test: str) -> str:
    """First capture whose decimal value passes ``test`` (on ``v``).

    ``1,234.50`` becomes 1234.50, a comma-only capture has no value. Empty captures are filtered out
    before the cast: a failing cast is caught inside and costs far more than the test.
    """
    values = (
        f"transform(filter(array({', '.join(captures)}), c -> c <> ''), "
        "c -> try_cast(replace(c, ',', '') AS decimal(38,2)))"
    )
    return f"get(filter({values}, v -> {test}), 0)"


def strip(text: str) -> str:
    return f"btrim({text}, {lit(BLANKS)})"


def blank_to_null(text: str) -> str:
    """Null for the empty string. The argument should be a column name: it is read twice."""
    return when(f"{text} <> ''", text)


def normalise_blanks(text: str) -> str:
    """Unicode blanks to a space, Unicode line ends to a newline, so that ASCII classes suffice. All of them are beyond ASCII,
    so a text of as many bytes as characters stays as it is."""
    source = UNICODE_BLANKS + UNICODE_LINE_ENDS + "\u0085"
    target = " " * len(UNICODE_BLANKS) + "\n" * len(UNICODE_LINE_ENDS) + "\u0086"
    return when(f"octet_length({text}) = char_length({text})", text, f"translate({text}, {lit(source)}, {lit(target)})")


def select_sealed(frame, keep: list[str], columns: dict[str, str]):
    """Select computed columns so that later filters on them stay above the computation.

    Spark moves a filter below a projection by repeating the projected expression in it. For expressions
    as wide as these that doubles the work and can stall the optimizer, so they leave through ``inline``,
    which filters on its output do not cross. Filters on the kept input columns still reach the scan.
    """
    pairs = ", ".join(f"{lit(name)}, {sql}" for name, sql in columns.items())
    return frame.selectExpr(*keep, f"inline(array(named_struct({pairs})))")
