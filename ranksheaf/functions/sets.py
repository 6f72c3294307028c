"""Set and vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def iou_scored(gold: Column, found: Column) -> Column:
    """Empty gold counts 0."""
    return F.when(F.size(gold) == 0, F.lit(0.0)).otherwise(_ratio(F.size(F.array_intersect(gold, found)), F.size(F.array_union(gold, found))))


def jaccard(gold: Column, found: Column) -> Column:
    """An empty union counts 0."""
    return _ratio(F.size(F.array_intersect(gold, found)), F.size(F.array_union(gold, found)))


def iou_lab(gold: Column, found: Column) -> Column:
    """Two empty sets agree fully."""
    return F.when((F.size(gold) == 0) & (F.size(found) == 0), F.lit(1.0)).otherwise(jaccard(gold, found))


def iou_at(ranked: Column, gold: Column, k: Column) -> Column:
    return jaccard(gold, F.slice(ranked, F.lit(1), F.greatest(k, F.lit(0))))


def hit_at(ranked: Column, gold: Column, k: int) -> Column:
    return F.arrays_overlap(F.slice(ranked, 1, k), gold).cast("int")


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    return _ratio(F.size(F.array_intersect(F.slice(ranked, 1, k), gold)), F.size(gold))


def reciprocal_rank(ranked: Column, gold: Column) -> Column:
    places = F.filter(F.transform(gold, lambda g: F.array_position(ranked, g)), lambda p: p > 0)
    return F.coalesce(F.lit(1.0) / F.array_min(places), F.lit(0.0))


def gathered(ids: Column, indices: Column) -> Column:
    """ids at 0-based indices; those out of bounds are left out."""
    return F.filter(F.transform(indices, lambda i: F.get(ids, i)), lambda x: x.isNotNull())


def places(ids: Column, wanted: Column) -> Column:
    """Sorted 1-based positions of the wanted ids."""
    return F.array_sort(F.filter(F.transform(wanted, lambda w: F.array_position(ids, w)), lambda p: p > 0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Of length one; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def blended(a: Column, b: Column, alpha: Column) -> Column:
    """normalise((1 - alpha) a + alpha b)."""
    return normalised(F.zip_with(a, b, lambda x, y: (1 - alpha) * x + alpha * y))


def max_sim(question: Column, paragraph: Column) -> Column:
    """Late interaction: each question vector's best match, summed; 0 if either side has none."""
    best = F.transform(question, lambda q: F.coalesce(F.array_max(F.transform(paragraph, lambda p: dot(q, p))), F.lit(0.0)))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def as_list(refs: Column) -> Column:
    """A variant that is a list, a single string, null or missing, as an array of strings."""
    kind = F.schema_of_variant(refs)
    return (
        F.when(refs.isNull() | (kind == "VOID"), F.array().cast("array<string>"))
        .when(kind.startswith("ARRAY"), F.coalesce(F.try_variant_get(refs, "$", "array<string>"), F.array().cast("array<string>")))
        .otherwise(F.array(F.try_variant_get(refs, "$", "string")))
    )


def parse_refs(refs: Column, keep_blank: bool = True) -> Column:
    """A comma-joined list of ids; blank input is the empty list, and blank parts go unless kept."""
    parts = F.transform(F.split(refs, ","), lambda x: F.trim(x))
    parts = parts if keep_blank else F.filter(parts, lambda x: x != "")
    return F.when(refs.isNull() | (F.trim(refs) == ""), F.array().cast("array<string>")).otherwise(parts)
