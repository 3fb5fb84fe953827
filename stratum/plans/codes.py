"""Readable labels of exchange and industry codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and numbers of exchanges, and ranges of SIC codes.
EXCHANGES = {"N": "NYSE", "A": "AMEX", "Q": "NASDAQ"}
EXCHANGE_NUMBERS = {1: "NYSE", 31: "NYSE", 2: "AMEX", 32: "AMEX", 3: "NASDAQ", 33: "NASDAQ"}
INDUSTRIES = [
    (1, 999, "Agriculture"),
    (1000, 1499, "Mining"),
    (1500, 1799, "Construction"),
    (2000, 3999, "Manufacturing"),
    (4000, 4899, "Transportation"),
    (4900, 4999, "Utilities"),
    (5000, 5199, "Wholesale"),
    (5200, 5999, "Retail"),
    (6000, 6799, "Finance"),
    (7000, 8999, "Services"),
    (9000, 9999, "Public"),
]


def _chosen(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    out = None
    for condition, label in cases:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(otherwise)


def exchange(letter: Column) -> Column:
    return _chosen([(letter == k, v) for k, v in EXCHANGES.items()], "Other")


def exchange_of_number(number: Column) -> Column:
    return _chosen([(number == k, v) for k, v in EXCHANGE_NUMBERS.items()], "Other")


def industry(sic: Column) -> Column:
    return _chosen([(sic.between(low, high), label) for low, high, label in INDUSTRIES], "Missing")
