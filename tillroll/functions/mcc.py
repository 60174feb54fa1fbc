"""Merchant category codes and their groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Group -> code ranges, low end included, high end excluded.
MCC_BANDS: dict[int, list[tuple[int, int]]] = {
    1: [(724, 1799)],
    2: [(1799, 2842), (4900, 5200), (5714, 5715), (9702, 9752)],
    3: [(2842, 3299)],
    4: [(3299, 3441), (7511, 7519)],
    5: [(3441, 3882), (6760, 7011)],
    6: [(3882, 4789)],
    7: [(4789, 4900)],
    8: [(5200, 5499)],
    9: [(5499, 5599), (5699, 5714), (5969, 5999)],
    10: [(5599, 5699)],
    11: [(5715, 5735), (5811, 5950)],
    12: [(5735, 5811), (5962, 5963), (5999, 6760), (7011, 7033)],
    13: [(5950, 5962), (5963, 5969)],
    14: [(7033, 7299)],
    15: [(7299, 7511), (7519, 7523)],
    16: [(7523, 7699)],
    17: [(7699, 7999)],
    18: [(7999, 8351)],
    19: [(8351, 8699)],
    20: [(8699, 8999)],
    21: [(8999, 9702), (9752, 9754)],
}


def mcc_group(code: Column) -> Column:
    """Group 1..21 of a code; a code outside every range stays as it is, NULL stays NULL."""
    steps = sorted((low, high, group) for group, ranges in MCC_BANDS.items() for low, high in ranges)
    case = F.when(code < steps[0][0], code)
    for _, high, group in steps:
        case = case.when(code < high, group)
    return case.otherwise(code)
