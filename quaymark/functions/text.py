"""Text of sources: secrets, line numbers, comments and literals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

HIDDEN = "[REDACTED]"
#: Names of credentials; a space stands for ``_``, ``-`` or nothing between the words.
CREDENTIALS = ("password", "passwd", "passphrase", "secret", "client secret", "api key", "access token", "refresh token", "session token", "private key")
#: Further names of URL parameters that hold credentials.
URL_CREDENTIALS = ("token", "signature", "sig")
SCHEMES = ("bearer", "basic", "digest", "token")


def _any_of(names: tuple[str, ...]) -> str:
    """One of some names; most places are passed over by their first letter."""
    return "(?=[" + "".join(sorted({n[0] for n in names})) + "])(?:" + "|".join(n.replace(" ", "[_-]?") for n in names) + ")"


#: A quote, which may be escaped; a bare value, which may be hidden already; what stands between a name and its value.
_QUOTE, _BARE, _SIGN = r"\\*[\"']", r"(?:\[REDACTED\]|[^\s\"'\\<>,;&#(){}\[\]]+)", r"\s*[:=]\s*"
_HIDING = (
    # name="value", 'name': 'value': the value up to the same quote
    (rf"(?i)({_any_of(CREDENTIALS)}(?:{_QUOTE})?{_SIGN})({_QUOTE}).+?\2", "$1$2{}$2"),
    # "name": value becomes a string, so that JSON stays JSON
    (rf"(?i)({_any_of(CREDENTIALS)}({_QUOTE}){_SIGN})(?!(?:null|true|false)\b){_BARE}", "$1$2{}$2"),
    # name=value
    (rf"(?i)({_any_of(CREDENTIALS)}{_SIGN}){_BARE}", "$1{}"),
    # Authorization: scheme value
    (rf"(?i)(\bauthorization(?:{_QUOTE})?{_SIGN}(?:{_QUOTE})?{_any_of(SCHEMES)}\s+){_BARE}", "$1{}"),
    # ?name=value and &name=value
    (rf"(?i)([?&]{_any_of(CREDENTIALS + URL_CREDENTIALS)}=){_BARE}", "$1{}"),
    # scheme://user:value@host
    (r"(://[^\s:/@]*:)[^\s/@]+(@)", "$1{}$2"),
)


#: What a text must hold, in lower case, for the patterns of ``_HIDING`` with these places; hiding adds none of it.
_HIDING_ASKS = ((("\"", "'"), (0, 1)), ((":", "="), (2,)), (("authorization",), (3,)), (("?", "&"), (4,)), (("://",), (5,)))


def _hiding(marks: tuple[str, ...], places: tuple[int, ...]) -> Callable[[Column], Column]:
    """Some of the patterns, tried on texts that hold one of the marks."""
    shown = HIDDEN.replace("[", r"\[")

    def step(x: Column) -> Column:
        asked, hidden = F.lit(False), x
        for m in marks:
            asked = asked | F.contains(F.lower(x) if m.isalpha() else x, F.lit(m))
        for k in places:
            hidden = F.regexp_replace(hidden, F.lit(_HIDING[k][0]), F.lit(_HIDING[k][1].format(shown)))
        return F.when(asked, hidden).otherwise(x)

    return step


def redact(text: Column) -> Column:
    """Values of credentials hidden; names, mechanisms, quotes and what follows are kept. Hiding twice changes nothing.

    Patterns are tried only on texts that hold the marks they need.
    """
    for marks, places in _HIDING_ASKS:
        text = F.transform(F.array(text), _hiding(marks, places))[0]  # an array of one, so that what went before is made once
    return text


def secret_like(text: Column) -> Column:
    """Whether a credential is left that is not hidden, so that hiding would change the text."""
    return redact(text) != text


def first_line_of(text: Column, needle: str) -> Column:
    """The 1-based line of a substring's first place, or null."""
    at = F.locate(needle, text)
    before = F.substring(text, F.lit(1), at - 1)
    return F.when(at > 0, F.size(F.split(before, "\n"))).cast("bigint")


def mask_code(text: str, hash_comments: bool = False, strings: bool = False) -> str:
    """Comments (and string contents, if asked for) as blanks; lengths and line ends stay."""
    out, at, n = list(text), 0, len(text)

    def blank(lo: int, hi: int) -> None:
        for k in range(lo, hi):
            if out[k] not in "\r\n":
                out[k] = " "

    while at < n:
        c = text[at]
        if c in "'\"`":
            end = at + 1
            while end < n and text[end] != c:
                end += 2 if text[end] == "\\" else 1
            if strings:
                blank(at + 1, min(end, n))
            at = end + 1
        elif text.startswith("//", at) or (hash_comments and c == "#" and not text.startswith("#[", at)):
            end = text.find("\n", at)
            end = n if end < 0 else end
            blank(at, end)
            at = end
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            end = n if end < 0 else end + 2
            blank(at, end)
            at = end
        elif text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            end = n if end < 0 else end + 3
            blank(at, end)
            at = end
        else:
            at += 1
    return "".join(out)


def mask_html_comments(text: Column) -> Column:
    """HTML comments left out."""
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def masked(text: Column, hash_comments: bool = False, strings: bool = False) -> Column:
    """``mask_code`` over a column, in Arrow batches."""

    @pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: None if t is None else mask_code(t, hash_comments, strings))

    return run(text)


def matching(text: str, at: int) -> int:
    """The place of the bracket that closes the one at ``at``, or -1; brackets in strings do not count."""
    pairs = {"(": ")", "[": "]", "{": "}"}
    want, k = [pairs[text[at]]], at + 1
    while k < len(text):
        c = text[k]
        if c in "'\"`":
            k += 1
            while k < len(text) and text[k] != c:
                k += 2 if text[k] == "\\" else 1
        elif c in pairs:
            want.append(pairs[c])
        elif c == want[-1]:
            want.pop()
            if not want:
                return k
        k += 1
    return -1


def split_top(text: str, separator: str = ",") -> list[str]:
    """Parts at a separator outside of brackets and strings, without outer blanks."""
    parts, depth, at, k = [], 0, 0, 0
    while k < len(text):
        c = text[k]
        if c in "'\"`":
            k += 1
            while k < len(text) and text[k] != c:
                k += 2 if text[k] == "\\" else 1
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == separator and depth == 0:
            parts.append(text[at:k].strip())
            at = k + 1
        k += 1
    last = text[at:].strip()
    return parts + [last] if last or parts else []


def statements(text: str) -> list[str]:
    return [s for s in split_top(text, ";") if s]


def literal(text: str) -> str | None:
    """The content of a quoted literal without interpolation, else None."""
    text = text.strip()
    if len(text) > 1 and text[0] in "'\"`" and text[-1] == text[0] and text[0] not in text[1:-1]:
        return text[1:-1]
    return None
