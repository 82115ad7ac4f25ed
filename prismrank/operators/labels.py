"""Label and prompt functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) if values else F.create_map().cast("map<string,string>")


def roll_up(labels: Column | str, mapping: dict[str, str], keep: list[str] | None = None) -> Column:
    """Each label by the map (unknown ones stay), without repeats in order
    of first occurrence; then only those of ``keep``."""
    m = lookup(mapping)
    labels = F.col(labels) if isinstance(labels, str) else labels
    out = F.array_distinct(F.transform(labels, lambda x: F.coalesce(F.element_at(m, x), x)))
    return out if keep is None else F.filter(out, lambda x: x.isin(keep))


def multi_hot(labels: Column | str, classes: list[str]) -> Column:
    """P12."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    return F.array(*[F.coalesce(F.array_contains(labels, c).cast("int"), F.lit(0)) for c in classes])


def prompt(label: Column | str, names: dict[str, str], template: str = "a satellite image of {}") -> Column:
    """P10, one label: its readable name (or itself) in the template."""
    label = F.col(label) if isinstance(label, str) else label
    before, _, after = template.partition("{}")
    return F.concat(F.lit(before), F.coalesce(F.element_at(lookup(names), label), label), F.lit(after))


def joined_prompt(labels: Column | str, names: dict[str, str], template: str = "a satellite image of {}") -> Column:
    """P10, several labels: joined by " and "."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    before, _, after = template.partition("{}")
    m = lookup(names)
    return F.concat(F.lit(before), F.array_join(F.transform(labels, lambda x: F.coalesce(F.element_at(m, x), x)), " and "), F.lit(after))


def tile_of(patch: Column | str) -> Column:
    """A patch id without its last two parts."""
    return F.regexp_replace(F.col(patch) if isinstance(patch, str) else patch, r"_[^_]+_[^_]+$", "")


def class_counts(rows: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """G1: rows of every class of the dimension, 0 where there are none.
    ``label`` may be an array; then each of its labels counts."""
    kind = dict(rows.dtypes)[label]
    each = rows.select(F.explode(label).alias("class_name")) if kind.startswith("array") else rows.select(F.col(label).alias("class_name"))
    n = each.groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
    return classes.select("class_name").distinct().join(n, "class_name", "left").select("class_name", F.coalesce("n", F.lit(0)).alias("n"))


def most_common(rows: DataFrame, label: str, k: int = 10) -> DataFrame:
    """The k most common labels; ties by name."""
    kind = dict(rows.dtypes)[label]
    each = rows.select(F.explode(label).alias("class_name")) if kind.startswith("array") else rows.select(F.col(label).alias("class_name"))
    return each.groupBy("class_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "class_name").limit(k)


def keep_clear(rows: DataFrame, *flags: list[str]) -> DataFrame:
    """rows for which no group of fallback fields has a number above 0;
    what is missing or no number keeps the row."""
    out = rows
    for names in flags:
        v = F.coalesce(*[F.col(n).cast("string") for n in names]).try_cast("double")
        out = out.filter(~F.coalesce(v > 0, F.lit(False)))
    return out


def keep_labelled(rows: DataFrame, labels: str, mapping: dict[str, str], keep: list[str]) -> DataFrame:
    """rows with a label of ``keep`` after the roll-up, which replaces the
    labels."""
    return rows.withColumn(labels, roll_up(labels, mapping, keep)).filter(F.size(labels) > 0)
