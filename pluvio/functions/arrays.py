"""Numeric array formulas as Spark SQL text: moments, entropy, Gini, bands, peaks, roll, cutout.

Each function takes SQL expressions and returns one, to be used with `F.expr` or `selectExpr`. As
text, a page of nested formulas reaches the JVM in one call. All run on the JVM without an explode.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

_names = count()
# Fixed value: odd multiplier of the counter hash.
MIX = 73244475


def _var(prefix: str = "x") -> str:
    return f"{prefix}{next(_names)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """Bind a value once, so that a lambda inside `body` does not evaluate it for every element."""
    v = _var("v")
    return f"get(transform(array({value}), {v} -> {body(v)}), 0)"


def bind(body: Callable[[str], str], **values: str) -> str:
    """`let` for several named values at once, reached as fields.

    Whatever a lambda body needs from outside goes through here: Spark cannot run a column that
    comes from a Python function inside a lambda.
    """
    fields = ", ".join(f"'{k}', {v}" for k, v in values.items())
    return let(f"named_struct({fields})", body)


def ratio(num: str, den: str) -> str:
    """NULL when the denominator is 0."""
    return f"try_divide(double({num}), double({den}))"


def total(a: str, f: Callable[[str], str] = lambda x: x) -> str:
    s, x = _var("s"), _var()
    return f"aggregate({a}, 0D, ({s}, {x}) -> {s} + double({f(x)}))"


def mean(a: str, f: Callable[[str], str] = lambda x: x) -> str:
    return ratio(total(a, f), f"size({a})")


def central(a: str, power: int) -> str:
    """Population central moment."""
    return bind(lambda b: mean(f"{b}.a", lambda x: f"power({x} - {b}.m, {power})"), a=a, m=mean(a))


def std(a: str) -> str:
    return f"sqrt({central(a, 2)})"


def skewness(a: str) -> str:
    return ratio(central(a, 3), f"power({central(a, 2)}, 1.5D)")


def kurtosis(a: str) -> str:
    """Fourth standardised moment (3 for a normal shape)."""
    return ratio(central(a, 4), f"power({central(a, 2)}, 2)")


def entropy(a: str) -> str:
    """Shannon entropy (natural log) of the shares of a non-negative array."""
    def body(b: str) -> str:
        share = total(f"{b}.a", lambda x: f"if({x} > 0, -({x} / {b}.s) * ln({x} / {b}.s), 0D)")
        return f"if({b}.s > 0, {share}, null)"
    return bind(body, a=a, s=total(a))


def evenness_gap(a: str) -> str:
    """1 - entropy / log n."""
    return f"(1D - {ratio(entropy(a), f'ln(nullif(size({a}), 1))')})"


def gini(a: str) -> str:
    """Gini coefficient of a non-negative array."""
    x, i = _var(), _var("i")
    weighted = total(f"transform(array_sort({a}), ({x}, {i}) -> {x} * ({i} + 1))")
    return f"({ratio(f'2 * {weighted}', f'size({a}) * {total(a)}')} - {ratio(f'size({a}) + 1', f'size({a})')})"


def zipped(a: str, b: str) -> str:
    """Array of struct(v, f)."""
    x, y = _var(), _var()
    return f"zip_with({a}, {b}, ({x}, {y}) -> named_struct('v', double({x}), 'f', double({y})))"


def between(values: str, freqs: str, low: float, high: float) -> str:
    """Values whose frequency lies in [low, high)."""
    c, d = _var("c"), _var("c")
    return f"transform(filter({zipped(values, freqs)}, {c} -> {c}.f >= {low}D and {c}.f < {high}D), {d} -> {d}.v)"


def divided(a: str, b: str) -> str:
    """Element-wise a / b."""
    x, y = _var(), _var()
    return f"zip_with({a}, {b}, ({x}, {y}) -> {ratio(x, y)})"


def slope(x: str, y: str) -> str:
    """Least-squares slope of y on x."""
    def body(m: str) -> str:
        a, b = _var(), _var()
        return ratio(total(f"zip_with({m}.x, {m}.y, ({a}, {b}) -> ({a} - {m}.mx) * ({b} - {m}.my))"),
                     total(f"{m}.x", lambda v: f"({v} - {m}.mx) * ({v} - {m}.mx)"))
    return bind(body, x=x, y=y, mx=mean(x), my=mean(y))


def share_frequency(values: str, freqs: str, share: float) -> str:
    """Lowest frequency at which the running sum reaches a share of the total."""
    def scan(b: str) -> str:
        s, c, e = _var("s"), _var("c"), _var("e")
        step = f"named_struct('run', {s}.run + {c}.v, 'at', coalesce({s}.at, if({s}.run + {c}.v >= {b}.goal, {c}.f, null)))"
        return f"aggregate({b}.z, named_struct('run', 0D, 'at', double(null)), ({s}, {c}) -> {step}, {e} -> {e}.at)"
    return bind(scan, z=zipped(values, freqs), goal=f"{total(values)} * {share * (1 - 1e-12)!r}D")


def local_maxima(values: str, freqs: str) -> str:
    """Array of struct(k, f) of the elements above both neighbours; k is the negated height."""
    def body(b: str) -> str:
        i, j = _var("i"), _var("i")
        peaks = (f"filter(sequence(1, greatest(size({b}.v) - 2, 1)), {i} -> get({b}.v, {i}) > get({b}.v, {i} - 1) "
                 f"and get({b}.v, {i}) > get({b}.v, {i} + 1))")
        return f"transform({peaks}, {j} -> named_struct('k', -get({b}.v, {j}), 'f', double(get({b}.f, {j}))))"
    return bind(body, v=values, f=freqs)


def spaced_peaks(values: str, freqs: str, spacing: float) -> str:
    """Number of local maxima when, from the highest down, each keeps others at least `spacing` away."""
    s, p, g = _var("s"), _var("p"), _var("g")
    kept = (f"aggregate(array_sort({local_maxima(values, freqs)}), cast(array() as array<double>), ({s}, {p}) -> "
            f"if(exists({s}, {g} -> abs({g} - {p}.f) < {spacing}D), {s}, array_append({s}, {p}.f)))")
    return f"if({values} is null, null, size({kept}))"


def sign_changes(a: str) -> str:
    """Number of neighbours with different sign (zero counts as positive)."""
    x, y = _var(), _var()
    head, tail = f"slice({a}, 1, greatest(size({a}) - 1, 0))", f"slice({a}, 2, greatest(size({a}) - 1, 0))"
    return total(f"zip_with({head}, {tail}, ({x}, {y}) -> int(({x} < 0) != ({y} < 0)))")


def frames(a: str, size: int, hop: int) -> str:
    """Full frames of an array; empty when it is shorter than one frame."""
    def body(b: str) -> str:
        i, j = _var("i"), _var("i")
        starts = f"filter(sequence(0, greatest(size({b}) - {size}, 0), {hop}), {i} -> {i} + {size} <= size({b}))"
        return f"transform({starts}, {j} -> slice({b}, {j} + 1, {size}))"
    return let(a, body)


def roll(a: str, shift: str) -> str:
    """Circular shift to the right, 0 <= shift < size."""
    return bind(lambda b: f"concat(slice({b}.a, size({b}.a) - {b}.s + 1, {b}.s), slice({b}.a, 1, size({b}.a) - {b}.s))", a=a, s=shift)


def gain(a: str, factor: str) -> str:
    x = _var()
    return bind(lambda b: f"transform({b}.a, {x} -> {x} * {b}.g)", a=a, g=factor)


def cutout(a: str, start: str, length: int) -> str:
    """Zero `length` elements from `start`; a NULL start changes nothing."""
    x, i = _var(), _var("i")
    return bind(lambda b: f"transform({b}.a, ({x}, {i}) -> if({i} >= {b}.s and {i} < {b}.s + {length}, {x} * 0, {x}))", a=a, s=start)


def mixed(number: str) -> str:
    """32 well mixed bits of an integer from 0 to 2 ** 32 - 1; every product stays below 2 ** 63, as in `kernels.mixed`."""
    step = lambda v: f"({v} ^ shiftright({v}, 16)) * {MIX}L % {1 << 32}L"
    return let(number, lambda a: let(step(a), lambda b: let(step(b), lambda c: f"({c} ^ shiftright({c}, 16))")))


def noise(a: str, factor: str, seed: str) -> str:
    """Gaussian noise at a share of the peak amplitude; a NULL factor changes nothing.

    The number at place i is a function of the seed and i alone (two mixed counters and the Box-Muller formula), so that any
    engine repeats it and no generator has a state.
    """
    x, i, p = _var(), _var("i"), _var()

    def gaussian(b: str) -> str:
        unit = lambda counter: f"(({mixed(f'({mixed(counter)} + {b}.seed) % {1 << 32}L')}) + 0.5D) / {float(1 << 32)!r}D"
        return f"sqrt(-2D * ln({unit(f'2L * {i}')})) * cos(2D * pi() * ({unit(f'2L * {i} + 1L')}))"
    return bind(lambda b: f"if({b}.f is null, {b}.a, transform({b}.a, ({x}, {i}) -> {x} + {b}.f * {b}.peak * {gaussian(b)}))",
                a=a, f=factor, seed=seed, peak=f"coalesce(array_max(transform({a}, {p} -> abs({p}))), 0D)")


def decibels(a: str) -> str:
    x = _var()
    return f"transform({a}, {x} -> 10 * log10({x}))"
