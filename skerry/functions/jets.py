"""Forward-mode derivatives as SQL text: a value with its gradient and the diagonal of its second derivatives.

A function of columns that is written with these numbers gives its derivatives as expressions beside its value, exact and
without differences; Spark evaluates them in generated code, and another engine can run the same text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from skerry.functions.sqltext import num


def _sum(*parts: str | None) -> str | None:
    kept = [p for p in parts if p is not None]
    return None if not kept else kept[0] if len(kept) == 1 else f"({' + '.join(kept)})"


def _times(*parts: str | None) -> str | None:
    """None is zero."""
    return None if any(p is None for p in parts) else f"({' * '.join(parts)})"


@dataclass(frozen=True)
class Jet:
    """text: the value. first, second: by variable, the first derivative and the second one along the variable; None is zero."""

    text: str
    first: tuple[str | None, ...]
    second: tuple[str | None, ...]

    def _lifted(self, other: Jet | float) -> Jet:
        return other if isinstance(other, Jet) else Jet(num(float(other)), (None,) * len(self.first), (None,) * len(self.first))

    def __add__(self, other: Jet | float) -> Jet:
        o = self._lifted(other)
        return Jet(f"({self.text} + {o.text})", tuple(map(_sum, self.first, o.first)), tuple(map(_sum, self.second, o.second)))

    def __mul__(self, other: Jet | float) -> Jet:
        if not isinstance(other, Jet) and other == 0:
            return Jet(num(0.0), (None,) * len(self.first), (None,) * len(self.first))
        a, b = self, self._lifted(other)
        first = tuple(_sum(_times(x, b.text), _times(a.text, y)) for x, y in zip(a.first, b.first, strict=True))
        second = tuple(_sum(_times(xx, b.text), _times(num(2.0), x, y), _times(a.text, yy)) for x, y, xx, yy in zip(a.first, b.first, a.second, b.second, strict=True))
        return Jet(f"({a.text} * {b.text})", first, second)

    def of(self, value: str, slope: str, bend: str) -> Jet:
        """A function of this number, from its text at the number and those of its first and second derivative."""
        first = tuple(_times(slope, x) for x in self.first)
        second = tuple(_sum(_times(slope, xx), _times(bend, x, x)) for x, xx in zip(self.first, self.second, strict=True))
        return Jet(value, first, second)

    def __neg__(self) -> Jet:
        return self * -1.0

    def __sub__(self, other: Jet | float) -> Jet:
        return self + -self._lifted(other)

    def __rsub__(self, other: float) -> Jet:
        return -self + other

    __radd__, __rmul__ = __add__, __mul__

    def __truediv__(self, other: Jet | float) -> Jet:
        return self * self._lifted(other) ** -1

    def __pow__(self, n: int) -> Jet:
        raised = lambda k: num(1.0) if k == 0 else f"power({self.text}, {num(float(k))})"
        return self.of(raised(n), f"({num(float(n))} * {raised(n - 1)})", f"({num(float(n * (n - 1)))} * {raised(n - 2)})" if n not in (0, 1) else num(0.0))


def variables(names: list[str]) -> list[Jet]:
    one = num(1.0)
    return [Jet(n, tuple(one if j == k else None for j in range(len(names))), (None,) * len(names)) for k, n in enumerate(names)]


def exp(x: Jet) -> Jet:
    e = f"exp({x.text})"
    return x.of(e, e, e)


def log(x: Jet) -> Jet:
    return x.of(f"ln({x.text})", f"({num(1.0)} / {x.text})", f"(-{num(1.0)} / ({x.text} * {x.text}))")


def tanh(x: Jet) -> Jet:
    t = f"({num(1.0)} - {num(2.0)} / (exp({num(2.0)} * {x.text}) + {num(1.0)}))"
    slope = f"({num(1.0)} - {t} * {t})"
    return x.of(t, slope, f"(-{num(2.0)} * {t} * {slope})")


Function = Callable[[list[Jet]], Jet]
