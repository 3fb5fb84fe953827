"""Aggregates of sliding windows from aggregates of panes.

A pane is what falls into one period. Sums, counts, extremes and moments of a window are those of its panes merged, so a
row is aggregated once, however many windows hold it. Moments are merged as counts, means and squared deviations
(Chan, Golub and LeVeque), so large means do not cancel digits.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPREAD = {"stddev": 1, "stddev_samp": 1, "std": 1, "variance": 1, "var_samp": 1, "stddev_pop": 0, "var_pop": 0}
_CALL = re.compile(rf"\b(sum|count|avg|mean|min|max|{'|'.join(_SPREAD)})\s*\(", re.IGNORECASE)
#: What may stand around and between the aggregates.
_PLAIN = re.compile(r"(?:_pane_\d+|abs|sqrt|exp|ln|pow|power|round|nullif|coalesce|greatest|least|[\s\d.+\-*/(),])*", re.IGNORECASE)


@dataclass
class PaneAggregate:
    """An aggregate expression taken apart: its calls (function, argument), and the text that joins their results."""

    calls: list[tuple[str, str]] = field(default_factory=list)
    text: str = ""

    @classmethod
    def of(cls, expression: str | Column, data: DataFrame) -> PaneAggregate | None:
        """None if the expression has other aggregates than those that merge, or decimals, whose scale would change."""
        text = expression if isinstance(expression, str) else expression._jc.toString()
        out, at = cls(), 0
        while match := _CALL.search(text, at):
            end, depth = match.end(), 1
            while depth and end < len(text):
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            argument = text[match.end() : end - 1].strip()
            if depth or re.match(r"(?i)distinct\b", argument) or "'" in argument or _CALL.search(argument) or _commas(argument):
                return None
            if argument != "*" and isinstance(data.select(F.expr(argument)).schema[0].dataType, T.DecimalType):
                return None
            out.text += text[at : match.start()] + f"_pane_{len(out.calls)}"
            out.calls.append((match[1].lower(), argument))
            at = end
        out.text += text[at:]
        return out if out.calls and _PLAIN.fullmatch(out.text) else None

    def partials(self, counted: Column) -> list[Column]:
        """Of a pane, over the rows that count."""
        out = []
        for k, (name, argument) in enumerate(self.calls):
            x = F.when(counted, F.lit(1) if argument == "*" else F.expr(argument))
            if name in ("min", "max", "sum", "count"):
                out.append(getattr(F, name)(x).alias(f"_a{k}"))
            elif name in ("avg", "mean"):
                out += [F.count(x).alias(f"_n{k}"), F.sum(x.cast("double")).alias(f"_m{k}")]
            else:
                x = x.cast("double")
                out += [F.count(x).alias(f"_n{k}"), F.avg(x).alias(f"_m{k}"), (F.var_pop(x) * F.count(x)).alias(f"_s{k}")]
        return out

    def merged(self, over: Window) -> list[Column]:
        """The result of each call over a window of panes, as _pane_0, _pane_1, ..."""
        out = []
        for k, (name, _) in enumerate(self.calls):
            if name in ("min", "max"):
                found = getattr(F, name)(f"_a{k}").over(over)
            elif name in ("sum", "count"):
                found = F.sum(f"_a{k}").over(over)
            elif name in ("avg", "mean"):
                found = F.sum(f"_m{k}").over(over) / F.nullif(F.sum(f"_n{k}").over(over), F.lit(0))
            else:
                found = _spread(k, over, _SPREAD[name], name.startswith("std"))
            out.append(found.alias(f"_pane_{k}"))
        return out


def _commas(text: str) -> bool:
    """Whether there is a comma outside parentheses."""
    depth = 0
    for c in text:
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and not depth:
            return True
    return False


def _spread(k: int, over: Window, less: int, root: bool) -> Column:
    """Of the panes' moments: the variance over n - less, or its root."""
    panes = F.collect_list(F.when(F.col(f"_n{k}") > 0, F.struct(F.col(f"_n{k}").cast("double").alias("n"), F.col(f"_m{k}").alias("m"), F.col(f"_s{k}").alias("s")))).over(over)
    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def add(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["m"] - a["m"]
        return F.struct(n.alias("n"), (a["m"] + apart * b["n"] / n).alias("m"), (a["s"] + b["s"] + apart * apart * a["n"] * b["n"] / n).alias("s"))

    def finish(t: Column) -> Column:
        value = F.when(t["n"] > less, t["s"] / (t["n"] - less))
        return F.sqrt(value) if root else value

    return F.aggregate(panes, none, add, finish)


def over_panes(keyed: DataFrame, groups: list[str], bucket: str, counted: Column, f: PaneAggregate, periods: int, then: Callable[[Column, Column], Column], value: str) -> DataFrame:
    """groups, bucket and value = then(result, rows) for each period of a group: over it and the periods - 1 before it."""
    panes = keyed.groupBy(*groups, bucket).agg(F.count(F.when(counted, 1)).alias("_rows"), *f.partials(counted))
    # A row for each group and period: few for a group, and for the whole table where there are no groups.
    over = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy(bucket).rangeBetween(-(periods - 1), 0)
    made = panes.select(*groups, bucket, F.sum("_rows").over(over).alias("_rows"), *f.merged(over))
    return made.select(*groups, bucket, then(F.expr(f.text), F.col("_rows")).alias(value))
