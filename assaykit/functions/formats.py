"""Date format tokens as Java patterns, and the regular expressions of desired types."""

from __future__ import annotations

import re

#: Token and Java pattern, upper or lower case; minutes are MI, so MM and mm are months.
TOKENS = {"yyyy": "yyyy", "mm": "MM", "dd": "dd", "hh": "HH", "mi": "mm", "ss": "ss", "mmm": "MMM"}
#: Strftime directives.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%%": "%"}
_TOKEN = re.compile(r"%[YmdHMSb%]|yyyy|mmm|mm|dd|hh|mi|ss|.", re.IGNORECASE | re.DOTALL)


def java_pattern(fmt: str) -> str:
    """A format of tokens (YYYY-MM-DD) or strftime directives (%Y-%m-%d) as Spark reads it; other letters are literal."""
    out, literal = [], ""
    for part in [*_TOKEN.findall(fmt), ""]:
        known = DIRECTIVES.get(part) or TOKENS.get(part.lower())
        if part and not known and (part.isalpha() or part in "'[]{}#"):
            literal += part
            continue
        if literal:
            out.append("'" + literal.replace("'", "''") + "'")
            literal = ""
        out.append(known or part)
    return "".join(out)


def date_shape(fmt: str) -> str:
    """A regular expression of texts that have digits and separators where the format has them."""
    out = ""
    for part in re.findall(r"'(?:[^']|'')*'|MMM|[yMdHms]|.", java_pattern(fmt), re.DOTALL):
        if part.startswith("'"):
            out += re.escape(part[1:-1].replace("''", "'"))
        else:
            out += r"\p{L}+" if part == "MMM" else r"\d" if part in "yMdHms" else re.escape(part)
    return f"^{out}$"


def strftime_pattern(fmt: str) -> str:
    """The same format in strftime's directives."""
    back = {v: k for k, v in DIRECTIVES.items()}
    out = []
    for part in _TOKEN.findall(fmt):
        low = part.lower()
        out.append(part if part in DIRECTIVES else back[TOKENS[low]] if low in TOKENS else part.replace("%", "%%"))
    return "".join(out)


def basic_integer() -> str:
    return "^-?[0-9]+$"


def basic_float() -> str:
    return r"^-?[0-9]+(\.[0-9]+)?$"


def integer_like_float() -> str:
    return r"^-?[0-9]+\.0*$"


def integer_digits(n: int) -> str:
    return f"^-?[0-9]{{1,{n}}}$"


def float_digits(precision: int, scale: int) -> str:
    if scale == 0:
        return rf"^-?[0-9]{{1,{precision}}}\.?0*$"
    whole = precision - scale
    return rf"^-?[0-9]{{1,{whole}}}(\.[0-9]{{1,{scale}}})?$" if whole else rf"^-?0(\.[0-9]{{1,{scale}}})?$"


def at_most_characters(n: int) -> str:
    return f"^.{{0,{n}}}$"
