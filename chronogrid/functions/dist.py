"""Distribution functions as SQL expressions over column names.

Each takes names of columns (or constants) and gives SQL text; inputs appear
more than once in it, so pass columns, not long expressions.
"""

from __future__ import annotations

#: Terms of the series for the normal distribution; beyond |z| = 8 its tail is
#: below the resolution of 1 - x in double precision.
TERMS = 200
#: Two-sided normal quantiles by significance level.
NORMAL_QUANTILE = {0.10: 1.6448536269514722, 0.05: 1.959963984540054, 0.01: 2.5758293035489004}


def normal_two_sided(z: str) -> str:
    """2 (1 - Phi(|z|)) by the odd series for Phi - 1/2."""
    a = f"least(abs({z}), 8D)"
    series = (
        f"aggregate(sequence(1, {TERMS}), named_struct('a', {a}, 'sum', {a}), (s, k) -> named_struct("
        f"'a', s.a * {a} * {a} / (2 * k + 1), 'sum', s.sum + s.a * {a} * {a} / (2 * k + 1))).sum"
    )
    return f"if({z} is null, null, if(abs({z}) > 8, 0D, greatest(0D, 1 - 2 * exp(-{a} * {a} / 2) / sqrt(2 * pi()) * {series})))"


def student_two_sided(t: str, df: str) -> str:
    """P(|T| > |t|) for whole degrees of freedom, by the finite cosine sums."""
    c = f"({df} / ({df} + {t} * {t}))"
    angle = f"atan(abs({t}) / sqrt({df}))"

    def total(last: str, ratio: str) -> str:
        steps = f"if({last} >= 1, sequence(1, cast({last} as int)), cast(array() as array<int>))"
        return f"aggregate({steps}, named_struct('a', 1D, 'sum', 1D), (s, k) -> named_struct('a', s.a * {ratio} * {c}, 'sum', s.sum + s.a * {ratio} * {c})).sum"

    even = f"sin({angle}) * {total(f'floor(({df} - 2) / 2)', '(2 * k - 1) / (2 * k)')}"
    odd = f"2 / pi() * ({angle} + if({df} = 1, 0D, sin({angle}) * cos({angle}) * {total(f'floor(({df} - 3) / 2)', '(2 * k) / (2 * k + 1)')}))"
    return f"if({t} is null, null, greatest(0D, 1 - if({df} % 2 = 0, {even}, {odd})))"


def f2_survival(f: str, m: str) -> str:
    """P(F > f) for 2 and m degrees of freedom."""
    return f"if({f} is null, null, power(1 + 2 * {f} / {m}, -{m} / 2D))"
