"""A rule is a column expression over a label row: struct(missing, warnings), two arrays of issues.

Any ``missing`` fails a label, any ``warnings`` warns, else it passes. A set of rules is
applied in one pass over the labels. Rules register under a name; opaque Python rules can
be adapted, a batch of rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES: dict[str, Callable[[], Column]] = {}
ISSUES = "struct<missing:array<string>,warnings:array<string>>"


def rule(name: str):
    def register(make: Callable[[], Column]):
        RULES[name] = make
        return make

    return register


def issues(*missing: Column, warnings: tuple[Column, ...] = ()) -> Column:
    """Of nullable strings; nulls are no issues."""
    pack = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    return F.struct(pack(missing).alias("missing"), pack(warnings).alias("warnings"))


def opaque(check: Callable[[dict], dict], columns: list[str]) -> Callable[[], Column]:
    """A rule from a function of a row's dict that returns {missing: [...], warnings: [...]}."""

    @F.pandas_udf(ISSUES)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [check(row) for row in rows.to_dict("records")]
            yield pd.DataFrame({"missing": [f.get("missing", []) for f in found], "warnings": [f.get("warnings", []) for f in found]})

    return lambda: run(F.struct(*columns))


def validate(labels: DataFrame, names: list[str] | None = None, rules: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """(test_case, file, status, missing, warnings): a row a rule and label."""
    held = RULES if rules is None else rules
    found = F.array(*[F.struct(F.lit(n).alias("test_case"), held[n]().cast(ISSUES).alias("i")) for n in (names or sorted(held))])
    rows = labels.select("file", F.explode(found).alias("r")).select(F.col("r.test_case").alias("test_case"), "file", F.col("r.i.missing").alias("missing"), F.col("r.i.warnings").alias("warnings"))
    status = F.when(F.size("missing") > 0, "FAIL").when(F.size("warnings") > 0, "WARNING").otherwise("PASS")
    return rows.select("test_case", "file", status.alias("status"), "missing", "warnings")
