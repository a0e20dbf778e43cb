"""The 48-bit linear congruential generator of the Java platform, for seeded choices that must repeat."""

from __future__ import annotations

#: Fixed values of the published generator.
_MULTIPLIER, _INCREMENT, _MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1


def _signed(value: int, bits: int) -> int:
    value &= (1 << bits) - 1
    return value - (value >> (bits - 1) << bits)


class Lcg:
    def __init__(self, seed: int):
        self.state = (seed ^ _MULTIPLIER) & _MASK

    def bits(self, n: int) -> int:
        self.state = (self.state * _MULTIPLIER + _INCREMENT) & _MASK
        return _signed(self.state >> (48 - n), 32)

    def integer(self) -> int:
        return self.bits(32)

    def below(self, bound: int) -> int:
        if bound <= 0:
            raise ValueError("bound must be positive")
        if bound & (bound - 1) == 0:
            return bound * self.bits(31) >> 31
        while True:
            drawn = self.bits(31)
            value = drawn % bound
            if drawn - value + bound - 1 < 1 << 31:
                return value

    def long(self) -> int:
        return _signed((self.bits(32) << 32) + self.bits(32), 64)

    def double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) * 2.0**-53

    def boolean(self) -> bool:
        return self.bits(1) != 0

    def shuffled(self, values: list, size: int | None = None) -> list:
        """A copy whose first ``size`` elements are a random choice in random order (all by default)."""
        out, n = list(values), len(values)
        for at in range(n if size is None else min(size, n)):
            other = at + self.below(n - at)
            out[at], out[other] = out[other], out[at]
        return out
