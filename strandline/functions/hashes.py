"""Other integer hashes, as column functions on longs whose bits stand for unsigned numbers.

Sums and products are put together from parts that never leave 63 bits, so they wrap silently in ANSI mode too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (shift to the right and xor, multiply) steps of two 64-bit finalisers, and their last shift.
MURMUR64 = [(33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)], 33
SPLITMIX64 = [(30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)], 31


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once."""
    return F.transform(F.array(x), lambda v: f(v))[0]


def xor_right(x: Column, n: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, n))


def plus64(a: Column, b: Column) -> Column:
    low = _low(a, 32) + _low(b, 32)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(_low(high, 32), 32).bitwiseOR(_low(low, 32))


def times64(x: Column, m: int) -> Column:
    """Low 64 bits of a product: 16-bit digits, carried from place to place."""
    digit = [_low(F.shiftrightunsigned(x, 16 * i), 16) for i in range(4)]
    out, carry = None, None
    for place in range(4):
        t = None
        for i in range(place + 1):
            part = digit[i] * F.lit(m >> 16 * (place - i) & 0xFFFF).cast("long")
            t = part if t is None else t + part
        t = t if carry is None else t + carry
        own = F.shiftleft(_low(t, 16), 16 * place)
        out = own if out is None else out.bitwiseOR(own)
        carry = F.shiftrightunsigned(t, 16)
    return out


def _finalised(x: Column, steps: tuple) -> Column:
    rounds, last = steps
    for shift, factor in rounds:
        x = _let(x, partial(xor_right, n=shift))
        x = _let(x, partial(times64, m=factor))
    return _let(x, lambda v: xor_right(v, last))


def murmur64(x: Column) -> Column:
    return _finalised(x, MURMUR64)


def splitmix64(x: Column) -> Column:
    return _finalised(x, SPLITMIX64)


def six_rounds32(x: Column) -> Column:
    """x from 0 to 2^32 - 1. The constants and shifts are fixed values of a public 32-bit hash."""
    left = lambda v, n: _low(F.shiftleft(v, n), 32)
    right = F.shiftrightunsigned
    const = lambda c: F.lit(c).cast("long")
    x = _let(x, lambda v: _low(v + const(0x7ED55D16) + left(v, 12), 32))
    x = _let(x, lambda v: v.bitwiseXOR(const(0xC761C23C)).bitwiseXOR(right(v, 19)))
    x = _let(x, lambda v: _low(v + const(0x165667B1) + left(v, 5), 32))
    x = _let(x, lambda v: _low(v + const(0xD3A2646C), 32).bitwiseXOR(left(v, 9)))
    x = _let(x, lambda v: _low(v + const(0xFD7046C5) + left(v, 3), 32))
    return _let(x, lambda v: v.bitwiseXOR(const(0xB55A4F09)).bitwiseXOR(right(v, 16)))


def halved(x: Column) -> Column:
    """64 bits to 32: shifts, sums and one product by 21, all of them fixed values of a public hash."""
    x = _let(x, lambda v: plus64(F.bitwise_not(v), F.shiftleft(v, 18)))
    x = _let(x, lambda v: times64(xor_right(v, 31), 21))
    x = _let(x, lambda v: xor_right(v, 11))
    x = _let(x, lambda v: plus64(v, F.shiftleft(v, 6)))
    return _let(x, lambda v: _low(xor_right(v, 22), 32))
