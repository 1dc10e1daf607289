"""SimHash inside a row, with DataFrame functions: bit counters packed several to a long, summed over an array of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Packed counters: bits of one, and the bit that a counter over half reaches. The sign bit stays free. Narrow ones need half as many sums.
NARROW, WIDE = (8, 6), (16, 13)
#: Features counted in narrow and in wide counters at most; larger arrays are counted bit by bit.
FEW, SEGMENT = (1 << NARROW[1]) - 1, (1 << WIDE[1]) - 1


def _ones(width: int) -> int:
    return sum(1 << i for i in range(0, 64, width))


def _packed(hashes: str, width: int, top: int) -> str:
    """SQL of the 64 majority bits: `width` sums over the hashes, the j-th of every width-th bit from bit j; a sum's counter over half sets its bit.

    Everything is a function of arrays, so that the code generated for it stays small."""
    ones = _ones(width)
    sums = f"transform(sequence(0, {width - 1}), j -> aggregate({hashes}, 0L, (a, x) -> a + (shiftrightunsigned(x, j) & {ones}L)))"
    lift = f"({(1 << top) - 1} - size({hashes}) div 2) * {ones}L"
    over = f"((c + {lift}) & {ones << top}L)"
    bits = f"aggregate(transform(s, (c, j) -> case when j <= {top} then shiftrightunsigned({over}, {top} - j) else shiftleft({over}, j - {top}) end), 0L, (a, x) -> a | x)"
    return f"transform(array({sums}), s -> {bits})[0]"


def _bit_by_bit(hashes: str) -> str:
    bit = f"size(filter({hashes}, x -> (shiftrightunsigned(x, j) & 1L) = 1L))"
    return f"aggregate(sequence(0, 63), 0L, (a, j) -> a | case when 2 * {bit} > size({hashes}) then shiftleft(1L, j) else 0L end)"


def fingerprint(hashes: str) -> str:
    """SQL of the 64-bit SimHash of an array column of 64-bit hashes of any length."""
    return f"case when size({hashes}) <= {FEW} then {_packed(hashes, *NARROW)} when size({hashes}) <= {SEGMENT} then {_packed(hashes, *WIDE)} else {_bit_by_bit(hashes)} end"


def with_fingerprint(df: DataFrame, hashes: str, keep: list[str]) -> DataFrame:
    """The columns keep, f1 and f2: the 128-bit SimHash of features, of which the array column `hashes` holds 64-bit hashes.

    The second half is made of a second hash of the first."""
    both = df.select(*keep, F.col(hashes).alias("_h1"), F.expr(f"transform({hashes}, x -> xxhash64(x, 1))").alias("_h2"))
    return both.select(*keep, F.expr(fingerprint("_h1")).alias("f1"), F.expr(fingerprint("_h2")).alias("f2"))


def distance(a1: str, a2: str, b1: str, b2: str) -> Column:
    """Hamming distance of two 128-bit fingerprints."""
    return F.bit_count(F.col(a1).bitwiseXOR(F.col(b1))) + F.bit_count(F.col(a2).bitwiseXOR(F.col(b2)))
