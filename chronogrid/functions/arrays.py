"""Series as arrays: position is calendar position, null is missing."""

from __future__ import annotations


def points(x: str) -> str:
    """The observed (t, x) of an array, in order of time."""
    return f"filter(transform({x}, (e, i) -> named_struct('t', i, 'x', e)), p -> p.x is not null)"


def both(x: str, y: str) -> str:
    """The observed (t, x, y) of two arrays of one length."""
    return (
        f"filter(transform({x}, (e, i) -> named_struct('t', i, 'x', e, 'y', get({y}, i))), p -> p.x is not null and p.y is not null)"
    )


def total(v: str, term: str, p: str = "p") -> str:
    """The sum over an array of ``term``, written in ``p``."""
    return f"aggregate({v}, 0D, (acc, {p}) -> acc + ({term}))"


def median(sorted_values: str) -> str:
    """Of an ascending array; null if it is empty."""
    n = f"size({sorted_values})"
    return f"if({n} = 0, null, (get({sorted_values}, cast(({n} - 1) div 2 as int)) + get({sorted_values}, cast({n} div 2 as int))) / 2)"


def quantile(sorted_values: str, q: float) -> str:
    """Linear interpolation between order statistics."""
    at = f"({q}D * (size({sorted_values}) - 1))"
    low = f"get({sorted_values}, cast(floor({at}) as int))"
    high = f"get({sorted_values}, cast(ceil({at}) as int))"
    return f"if(size({sorted_values}) = 0, null, {low} + ({high} - {low}) * ({at} - floor({at})))"
