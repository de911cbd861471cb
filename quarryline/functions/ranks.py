"""Orders of enumerations: never compare their names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENCE = ("low", "medium", "high", "manual")
RAG = ("Green", "Yellow", "Red")


def rank(value: Column | str, order: tuple[str, ...]) -> Column:
    """Place of a value in an order, from 0; null for an unknown one."""
    value = F.col(value) if isinstance(value, str) else value
    out = F.when(value == order[0], 0)
    for k, name in enumerate(order[1:], 1):
        out = out.when(value == name, k)
    return out


def named(place: Column, order: tuple[str, ...]) -> Column:
    """The value at a place."""
    out = F.when(place == 0, order[0])
    for k, name in enumerate(order[1:], 1):
        out = out.when(place == k, name)
    return out


def authority(doc_type: Column) -> Column:
    """Which copy of a text is canonical: wiki 3, product docs 2, tickets 1, else 0."""
    return F.when(doc_type == "wiki", 3).when(doc_type == "docs", 2).when(doc_type == "ticket", 1).otherwise(0)
