"""Diagnosis labels as nodes of a partial order: a label refines another that it adds detail to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .text import trim_u


def canonical_label(c: Column) -> Column:
    return F.replace(trim_u(c), F.lit("癌"), F.lit("がん"))


def label_table(spark: SparkSession) -> DataFrame:
    """label, side, region, hist, special of the 53 known labels."""
    rows = [(label, *node) for label, node in schema.DIAGNOSES.items()]
    return spark.createDataFrame(rows, "label string, side string, region string, hist string, special string")


def _node(label: Column) -> Column:
    known = F.create_map(*(F.lit(x) if isinstance(x, str) else F.struct(*(F.lit(v).cast("string").alias(n) for v, n in zip(x, ("side", "region", "hist", "special"), strict=True))) for item in schema.DIAGNOSES.items() for x in item))
    return known[label]


def is_known_label(c: Column) -> Column:
    return canonical_label(c).isin(*schema.DIAGNOSES)


def refines(pred: Column, gold: Column) -> Column:
    """Whether pred equals gold or adds detail without contradicting it; unknown labels only equal."""
    p, g = canonical_label(pred), canonical_label(gold)
    a, b = _node(p), _node(g)
    fits = lambda name: b[name].isNull() | F.coalesce(a[name] == b[name], F.lit(False))
    ordinary = a.isNotNull() & b.isNotNull() & a["special"].isNull() & b["special"].isNull()
    return F.coalesce(p == g, F.lit(False)) | F.coalesce(ordinary & fits("side") & fits("region") & fits("hist"), F.lit(False))


def refines_text(pred: str, gold: str) -> bool:
    """The same relation for the grouped matcher, on canonical labels."""
    if pred == gold:
        return True
    a, b = schema.DIAGNOSES.get(pred), schema.DIAGNOSES.get(gold)
    if a is None or b is None or a[3] or b[3]:
        return False
    return all(want is None or have == want for have, want in zip(a[:3], b[:3], strict=True))
