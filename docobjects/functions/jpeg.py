"""The quality that a quantisation table was made at, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The example luminance table of ITU-T T.81, annex K, row by row.
STANDARD = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]


def scaled(quality: int) -> list[int]:
    """The standard table at a quality of 1 to 100: entries scaled in whole per cents, from 1 to 255."""
    percent = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [min(max((v * percent + 50) // 100, 1), 255) for v in STANDARD]


#: Sums of the scaled table at qualities 1 to 100, which never rise with the quality.
SUMS = [sum(scaled(q)) for q in range(1, 101)]


def table_sum(entries: Column) -> Column:
    """Sum of the 64 entries of a table; null for any other number of them or a null among them, which makes the sum null."""
    return F.when(F.size(entries) == 64, F.aggregate(entries, F.lit(0).cast("long"), lambda s, v: s + v))


def nearest_quality(total: Column) -> Column:
    """The quality whose sum is nearest to a table's; of equally near ones the lowest.

    Sums never rise with the quality, so it is looked up by halves among the middles between neighbouring sums.
    """
    steps = [q for q in range(1, 101) if q == 1 or SUMS[q - 1] < SUMS[q - 2]]  # the lowest quality of each sum

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(steps[low])
        half = (low + high) // 2
        middle = (SUMS[steps[half] - 1] + SUMS[steps[half + 1] - 1]) / 2
        return F.when(total >= middle, among(low, half)).otherwise(among(half + 1, high))

    return F.when(total.isNotNull(), among(0, len(steps) - 1))


def table_quality(entries: Column) -> Column:
    """The quality that a quantisation table was made at, null if it is no table."""
    return nearest_quality(table_sum(entries))
