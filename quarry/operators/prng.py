"""The 64-bit linear generator that makes training reproducible."""

from __future__ import annotations

#: Fixed values.
MULTIPLIER = 6364136223846793005
INCREMENT = 1442695040888963407
SEED = 16045690984503098046
_MASK = (1 << 64) - 1


class Generator:
    def __init__(self, seed: int = SEED):
        self.state = seed & _MASK

    def word(self) -> int:
        self.state = (self.state * MULTIPLIER + INCREMENT) & _MASK
        return self.state

    def below(self, n: int) -> int:
        """A whole number below n from the high bits; 0, without a draw, if n is not positive."""
        return (self.word() >> 33) % n if n > 0 else 0

    def unit(self) -> float:
        """A number in [0, 1) of 53 bits."""
        return (self.word() >> 11) / float(1 << 53)
