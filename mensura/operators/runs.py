"""Run identity, merges of runs, leak checks and the report as Markdown."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_id(fingerprint: DataFrame, config: dict) -> str:
    """12 hex digits of the data's fingerprint and the configuration; neither model nor date is part of it."""
    row = fingerprint.first().asDict()
    text = json.dumps({**{k: str(v) for k, v in row.items()}, **config}, sort_keys=True, default=str)
    return hashlib.blake2s(text.encode(), digest_size=6).hexdigest()


def merged(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two runs' model columns side by side; cells must match one to one and have the same actuals."""
    mine = [c for c in b.columns if c not in (*keys, "real", "run_id", "scale")]
    if set(mine) & set(a.columns):
        raise ValueError(f"models in both runs: {sorted(set(mine) & set(a.columns))}")
    right = b.select(*keys, *mine, F.col("real").alias("_real"), F.lit(1).alias("_b"))
    rows = a.withColumn("_a", F.lit(1)).join(right, keys, "full")
    bad = rows.agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("alone"), F.count_if(~F.col("real").eqNullSafe(F.col("_real"))).alias("other"), (F.count("*") - F.countDistinct(*keys)).alias("twice")).first()
    if bad["alone"] or bad["other"] or bad["twice"]:
        raise ValueError(f"runs don't match: {bad.asDict()}")
    return rows.drop("_a", "_b", "_real")


def leaks(calculate: Callable[[DataFrame, str], DataFrame], data: DataFrame, cuts: list[str], date: str = "month", factor: float = 7.3) -> list[tuple[str, str]]:
    """(cut, kind) of leaks from the future: by its existence (rows cut off) or its values (perturbed)."""
    floats = [f.name for f in data.schema if f.dataType.simpleString() in ("double", "float")]
    if not floats:
        raise ValueError("no float column to perturb")
    found = []
    for cut in cuts:
        late = F.col(date) > F.lit(cut).cast("date")
        want = _rounded(calculate(data, cut))
        changed = data.withColumns({c: F.when(late, F.col(c) * factor).otherwise(F.col(c)) for c in floats})
        for kind, other in (("existence", data.where(~late)), ("value", changed)):
            got = _rounded(calculate(other, cut))
            if not want.exceptAll(got).isEmpty() or not got.exceptAll(want).isEmpty():
                found.append((cut, kind))
    return found


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in sorted(df.schema, key=lambda f: f.name)])


def unique_grain(df: DataFrame, keys: list[str]) -> DataFrame:
    """The frame itself; duplicates or nulls of the key raise, with their number and an example."""
    bad = df.groupBy(*keys).count().where("count > 1 or " + " or ".join(f"`{k}` is null" for k in keys))
    example = bad.first()
    if example:
        raise ValueError(f"{bad.count()} keys of {keys} occur twice or are null, as {example.asDict()}")
    return df


def to_markdown(tables: dict[str, DataFrame], title: str, notes: list[str] | None = None, order: list[str] | None = None) -> str:
    """Report-sized tables as Markdown: four decimals, a dash for NULL, known sections first."""
    names = [n for n in order or [] if n in tables] + [n for n in tables if n not in (order or [])]
    show = lambda v: "—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    out = [f"# {title}", *[f"> {n}" for n in notes or []]]
    for name in names:
        df = tables[name]
        out += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(map(show, r)) + " |" for r in df.collect()]
    return "\n".join(out) + "\n"
