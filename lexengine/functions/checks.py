"""Checks of what callers ask for."""

from __future__ import annotations

LIMIT, MOST, PAGE_SIZE = 15, 50, 20


class NotFoundError(LookupError):
    pass


class ConflictError(ValueError):
    pass


def whole_number(value: object, name: str, least: int, most: int | None, default: int) -> int:
    """A whole number in bounds, as a number or its text; nothing gives the default, anything else is an error."""
    if value is None or value == "":
        return default
    try:
        number = int(str(value))
    except ValueError:
        raise ValueError(f"{name} must be a whole number") from None
    if isinstance(value, bool) or number < least or (most is not None and number > most):
        raise ValueError(f"{name} must be at least {least}" + ("" if most is None else f" and at most {most}"))
    return number


def limit(value: object = None) -> int:
    return whole_number(value, "limit", 1, MOST, LIMIT)


def page(number: object = None, size: object = None) -> tuple[int, int]:
    return whole_number(number, "page", 1, None, 1), whole_number(size, "size", 1, None, PAGE_SIZE)
