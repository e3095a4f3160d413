"""In-document numeric functions as Column expressions: sampled, exponential, stitching and calculator functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, num(high)), num(low))


def interpolate(x: Column, x0, x1, y0, y1) -> Column:
    return F.when(num(x1) == num(x0), num(y0)).otherwise(num(y0) + (x - num(x0)) * (num(y1) - num(y0)) / F.nullif(num(x1) - num(x0), F.lit(0.0)))


def exponential(x: Column, c0: list[float], c1: list[float], n: float, domain=(0.0, 1.0)) -> list[Column]:
    """c0 + x^n * (c1 - c0), an output per component."""
    power = F.pow(clamp(x, *domain), F.lit(float(n)))
    return [F.lit(float(a)) + power * (float(b) - float(a)) for a, b in zip(c0, c1)]


def stitching(x: Column, functions: list[Callable[[Column], list[Column]]], bounds: list[float], encode: list[float], domain=(0.0, 1.0)) -> list[Column]:
    """The function of the interval that holds x (closed on the left), given x mapped to the interval's encoding."""
    x = clamp(x, *domain)
    edges = [domain[0], *bounds, domain[1]]
    outputs = []
    for k, f in enumerate(functions):
        low, high = edges[min(k, len(edges) - 2)], edges[min(k + 1, len(edges) - 1)]
        e0, e1 = (encode[2 * k], encode[2 * k + 1]) if len(encode) > 2 * k + 1 else (0.0, 1.0)
        t = (x - float(low)) / float(high - low) if high > low else F.lit(0.0)
        outputs.append(f(F.lit(float(e0)) + t * (float(e1) - float(e0))))
    chosen = []
    for parts in zip(*outputs):
        out = parts[-1]
        for k in range(len(parts) - 2, -1, -1):
            out = F.when(x < float(bounds[k]), parts[k]).otherwise(out)
        chosen.append(out)
    return chosen


def sampled(inputs: list[Column], samples: list[int], size: list[int], bits: int, domain: list[float], out_range: list[float], encode: list[float] | None = None, decode: list[float] | None = None) -> list[Column]:
    """Multilinear interpolation in a table of samples; the first input varies fastest."""
    encode = encode or [v for n in size for v in (0, n - 1)]
    decode = decode or out_range
    n_out, table = len(out_range) // 2, F.array(*(F.lit(float(s)) for s in samples))
    low, frac = [], []
    for k, x in enumerate(inputs):
        e = interpolate(clamp(x, domain[2 * k], domain[2 * k + 1]), domain[2 * k], domain[2 * k + 1], encode[2 * k], encode[2 * k + 1])
        e = clamp(e, 0, size[k] - 1)
        i0 = F.least(F.floor(e), F.lit(size[k] - 1)).cast("int")
        low.append(i0)
        frac.append(F.when(i0 >= size[k] - 1, 0.0).otherwise(e - i0))
    outputs = []
    for j in range(n_out):
        total = F.lit(0.0)
        for corner in product((0, 1), repeat=len(inputs)):
            weight, index, stride = F.lit(1.0), F.lit(0), 1
            for k, up in enumerate(corner):
                weight = weight * (frac[k] if up else 1 - frac[k])
                index = index + F.least(low[k] + up, F.lit(size[k] - 1)) * stride
                stride *= size[k]
            total = total + weight * F.get(table, index * n_out + j)
        value = interpolate(total, 0, 2**bits - 1, decode[2 * j], decode[2 * j + 1])
        outputs.append(clamp(value, out_range[2 * j], out_range[2 * j + 1]))
    return outputs


def _truncate(a: Column) -> Column:
    return F.when(a >= 0, F.floor(a)).otherwise(F.ceil(a)).cast("double")


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _bits(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: f(_truncate(a).cast("long"), _truncate(b).cast("long")).cast("double")


def _atan(a: Column, b: Column) -> Column:
    degrees = F.degrees(F.atan2(a, b))
    return F.when(degrees < 0, degrees + 360).otherwise(degrees)


def _shift(a: Column, b: Column) -> Column:
    bits, by = _truncate(a).cast("long"), _truncate(b).cast("int")
    return F.when(by >= 0, F.call_function("shiftleft", bits, by)).otherwise(F.call_function("shiftright", bits, -by)).cast("double")


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0.0))),
    "idiv": lambda a, b: F.when(b == 0, 0.0).otherwise(_truncate(a / F.nullif(b, F.lit(0.0)))),
    "mod": lambda a, b: F.when(b == 0, 0.0).otherwise(a % F.nullif(b, F.lit(0.0))),
    "exp": lambda a, b: F.pow(a, b),
    "atan": _atan,
    "eq": lambda a, b: _flag(a == b),
    "ne": lambda a, b: _flag(a != b),
    "gt": lambda a, b: _flag(a > b),
    "ge": lambda a, b: _flag(a >= b),
    "lt": lambda a, b: _flag(a < b),
    "le": lambda a, b: _flag(a <= b),
    "and": _bits(lambda a, b: a.bitwiseAND(b)),
    "or": _bits(lambda a, b: a.bitwiseOR(b)),
    "xor": _bits(lambda a, b: a.bitwiseXOR(b)),
    "bitshift": _shift,
}
UNARY: dict[str, Callable[[Column], Column]] = {
    "neg": lambda a: -a,
    "abs": F.abs,
    "sqrt": lambda a: F.sqrt(F.greatest(a, F.lit(0.0))),
    "sin": lambda a: F.sin(F.radians(a)),
    "cos": lambda a: F.cos(F.radians(a)),
    "ln": lambda a: F.when(a > 0, F.log(F.greatest(a, F.lit(1e-300)))).otherwise(0.0),
    "log": lambda a: F.when(a > 0, F.log10(F.greatest(a, F.lit(1e-300)))).otherwise(0.0),
    "cvi": _truncate,
    "truncate": _truncate,
    "cvr": lambda a: a,
    "floor": lambda a: F.floor(a).cast("double"),
    "ceiling": lambda a: F.ceil(a).cast("double"),
    "round": lambda a: F.when(a >= 0, F.floor(a + 0.5)).otherwise(F.ceil(a - 0.5)).cast("double"),
    "not": lambda a: _flag(a == 0),
}


def parse_calculator(source: str) -> list:
    """Nested blocks of a calculator program: numbers, operator names, lists."""
    stack: list[list] = [[]]
    for token in re.findall(r"[{}]|[^\s{}]+", re.sub(r"%[^\r\n]*", " ", source)):
        if token == "{":
            stack.append([])
        elif token == "}" and len(stack) > 1:
            done = stack.pop()
            stack[-1].append(done)
        else:
            try:
                stack[-1].append(float(token))
            except ValueError:
                stack[-1].append(token)
    return stack[0][0] if len(stack[0]) == 1 and isinstance(stack[0][0], list) else stack[0]


def calculator(source: str, inputs: list[Column], domain: list[float], out_range: list[float]) -> list[Column]:
    """Compiles a calculator program to Columns. The stack is known when the plan is built, so counts of copy, index and roll have to be constants and both arms of ifelse leave the same number of values."""
    stack = [clamp(x, domain[2 * k], domain[2 * k + 1]) for k, x in enumerate(inputs)]
    stack = _run(parse_calculator(source), stack)
    n_out = len(out_range) // 2
    found = stack[-n_out:] if len(stack) >= n_out else [F.lit(0.0)] * (n_out - len(stack)) + stack
    return [clamp(num(value), out_range[2 * j], out_range[2 * j + 1]) for j, value in enumerate(found)]


def _run(program: list, stack: list) -> list:
    stack, blocks = list(stack), []

    def pop() -> Column:
        value = stack.pop() if stack else 0.0
        return num(value)

    def count() -> int:
        value = stack.pop() if stack else 0.0
        if isinstance(value, Column):
            raise ValueError("counts have to be constants")
        return int(value)

    for step in program:
        if isinstance(step, list):
            blocks.append(step)
        elif isinstance(step, float):
            stack.append(step)
        elif step in ("true", "false"):
            stack.append(float(step == "true"))
        elif step in BINARY:
            b, a = pop(), pop()
            stack.append(BINARY[step](a, b))
        elif step in UNARY:
            stack.append(UNARY[step](pop()))
        elif step == "dup":
            stack.append(stack[-1] if stack else 0.0)
        elif step == "pop":
            stack[-1:] = []
        elif step == "exch":
            if len(stack) >= 2:
                stack[-2:] = stack[:-3:-1]
        elif step == "copy":
            n = count()
            if 0 < n <= min(len(stack), 100):
                stack += stack[-n:]
        elif step == "index":
            n = count()
            stack.append(stack[-1 - n] if 0 <= n < len(stack) else 0.0)
        elif step == "roll":
            j, n = count(), count()
            if 0 < n <= len(stack):
                top, j = stack[-n:], j % n
                stack[-n:] = top[n - j :] + top[: n - j]
        elif step in ("if", "ifelse"):
            other = blocks.pop() if step == "ifelse" and blocks else []
            then = blocks.pop() if blocks else []
            if step == "if":
                then, other = other or then, []
            test = pop() != 0
            yes, no = _run(then, stack), _run(other, stack)
            if len(yes) != len(no):
                raise ValueError("arms leave different numbers of values")
            stack = [y if y is n else F.when(test, num(y)).otherwise(num(n)) for y, n in zip(yes, no)]
            blocks = []
    return stack
