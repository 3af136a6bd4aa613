"""Named parameters in SQL text, written ``:name``."""

from __future__ import annotations

import re

#: A quoted string or name, a line comment, or a named parameter, which is group 1.
_PARAMETER = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|(?<![:\w]):([A-Za-z_]\w*)")


def parameters_of(text: str) -> list[str]:
    """The named parameters of a statement, outside of quotes and comments."""
    return [m[1] for m in _PARAMETER.finditer(text) if m[1]]


def with_parameters(text: str, write) -> str:
    """``text`` with each named parameter replaced by what ``write`` gives for its name."""
    return _PARAMETER.sub(lambda m: write(m[1]) if m[1] else m[0], text)


def literal(value) -> str:
    """A parameter's value as SQL text."""
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(f'{float(x)!r}F' for x in value)})"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return "null" if value is None else str(value)
