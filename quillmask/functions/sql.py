"""Small helpers to write Spark SQL expression text."""

from __future__ import annotations


def name(column: str) -> str:
    """A quoted column name."""
    return "`" + column.replace("`", "``") + "`"


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def regex(pattern: str) -> str:
    """A regex as raw literal, which holds backslashes but no quote."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def texts(values) -> str:
    """An array literal of strings."""
    return typed_array([text(v) for v in values], "array<string>")


def typed_array(items: list[str], array_type: str) -> str:
    return f"array({', '.join(items)})" if items else empty(array_type)


def empty(array_type: str) -> str:
    return f"cast(array() as {array_type})"


def struct(**fields: str) -> str:
    """A struct with named fields."""
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def let(variable: str, value: str, body: str) -> str:
    """Evaluate ``value`` once under a name that ``body`` may use many times.

    A fold of nothing: unlike an element of a transformed array, its result is
    neither copied nor asked for its type, whose derivation walks the whole body,
    at every evaluation.
    """
    return f"aggregate({empty('array<int>')}, {value}, (held, none) -> held, {variable} -> {body})"


def flat(arrays: str) -> str:
    """Flatten; the type of a name is known, that of an expression is derived at every evaluation."""
    return let("nested", arrays, "flatten(nested)")
