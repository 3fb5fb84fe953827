"""Linear model formulas: y ~ x1 + x2, with - 1 or + 0 for no intercept."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Formula:
    dependent: str
    regressors: tuple[str, ...]
    intercept: bool

    @property
    def names(self) -> tuple[str, ...]:
        return ("Intercept", *self.regressors) if self.intercept else self.regressors

    def column(self, data: DataFrame, term: str) -> Column:
        """A term's values: a column, a product a:b of columns, or an SQL expression."""
        if term in data.columns:
            return F.col(f"`{term}`").cast("double")
        if ":" in term and all(p in data.columns for p in term.split(":")):
            out = F.lit(1.0)
            for p in term.split(":"):
                out = out * F.col(f"`{p}`").cast("double")
            return out
        if re.search(r"[(*/]", term):
            return F.expr(term).cast("double")
        raise ValueError(f"The data has no column for the term '{term}'.")

    def design(self, data: DataFrame) -> tuple[Column, list[Column]]:
        """The dependent variable and the regressors, the constant first."""
        xs = [self.column(data, t) for t in self.regressors]
        return self.column(data, self.dependent), [F.lit(1.0), *xs] if self.intercept else xs


def parse_formula(model: str) -> Formula:
    if not isinstance(model, str) or model.count("~") != 1:
        raise ValueError("The model must be a formula like 'y ~ x1 + x2'.")
    left, right = (x.strip() for x in model.split("~"))
    if not left:
        raise ValueError("The model has no dependent variable.")
    terms, intercept = [], True
    for sign, term in re.findall(r"([+-]?)\s*((?:[^+\-()\s]|\([^()]*\))+)", right):
        if sign == "-" or term == "0":
            intercept = False
        elif term != "1" and term not in terms:
            if re.fullmatch(r"\w+\*\w+", term):
                a, b = term.split("*")
                terms += [x for x in (a, b, f"{a}:{b}") if x not in terms]
            else:
                terms.append(term)
    return Formula(left, tuple(terms), intercept)
