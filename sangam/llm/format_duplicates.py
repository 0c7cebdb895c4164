"""Copies that differ only in formatting: Merkle-style digests of normalised nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sangam.session import materialise


def leaf(x: Column) -> Column:
    """A leaf's normal form: its letters and digits in lower case; null counts as empty."""
    return F.regexp_replace(F.lower(F.coalesce(x.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", "")


def _kids(x: Column, kind: T.DataType, unordered: bool, each) -> tuple[Column, bool] | None:
    """A node's children by ``each``, and whether their order says nothing; None for a leaf."""
    if isinstance(kind, T.StructType):
        return F.array(*[each(x.getField(f.name), f.dataType) for f in kind.fields]), True
    if isinstance(kind, T.ArrayType):
        return F.transform(F.coalesce(x, F.array().cast(kind)), lambda v: each(v, kind.elementType)), unordered
    if isinstance(kind, T.MapType):
        entries = F.map_entries(F.coalesce(x, F.create_map().cast(kind)))
        return F.transform(entries, lambda v: F.concat(each(v["key"], kind.keyType), F.lit("="), each(v["value"], kind.valueType))), True
    return None


def digest(x: Column, kind: T.DataType, unordered: bool = False) -> Column:
    """Bottom-up digest: leaves hash their normal form, structs and maps the sorted digests of
    their children, arrays theirs in order, or sorted too if ``unordered``."""
    kids = _kids(x, kind, unordered, lambda v, t: digest(v, t, unordered))
    return F.md5(leaf(x)) if kids is None else F.md5(F.array_join(F.array_sort(kids[0]) if kids[1] else kids[0], "|"))


def canonical(x: Column, kind: T.DataType, unordered: bool = False) -> Column:
    """The whole normal form as text, children in the order digested: what a digest stands for."""
    kids = _kids(x, kind, unordered, lambda v, t: canonical(v, t, unordered))
    return leaf(x) if kids is None else F.concat(F.lit("("), F.array_join(F.array_sort(kids[0]) if kids[1] else kids[0], ","), F.lit(")"))


def _roots(df: DataFrame, fields: list[str], id_col: str, unordered: bool) -> tuple[DataFrame, DataFrame]:
    """Written (id, root) of every record, and the lazy (id, form)."""
    kind = T.StructType([df.schema[f] for f in fields])
    rec, id_ = F.struct(*[F.col(f) for f in fields]), F.col(id_col).cast("long").alias("id")
    roots = materialise(df.select(id_, F.unhex(digest(rec, kind, unordered)).alias("root")), "roots")
    return roots, df.select(id_, canonical(rec, kind, unordered).alias("form"))


def _copies(roots: DataFrame, forms: DataFrame) -> DataFrame:
    sets = roots.groupBy("root").agg(F.min("id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("root", "keep")
    suspects = materialise(roots.join(sets, "root").select("id", "keep"), "suspects")
    formed = materialise(forms.join(suspects, "id"), "forms")  # forms of members of sets only
    head = formed.where("id = keep").select("keep", F.col("form").alias("keep_form"))
    alike = F.col("form") == F.col("keep_form")
    near = formed.where("id <> keep").join(head, "keep")
    near = materialise(near.select("keep", F.col("id").alias("copy"), F.when(~alike, F.col("form")).alias("odd")), "copies")
    odd = near.where("odd is not null").groupBy("keep", "odd").agg(F.min("copy").alias("first"))
    regrouped = near.join(odd, ["keep", "odd"]).where(F.col("copy") != F.col("first")).select(F.col("first").alias("keep"), "copy")
    return near.where("odd is null").select("keep", "copy").unionAll(regrouped)


def copies(df: DataFrame, fields: list[str], id_col: str, unordered: bool = False) -> DataFrame:
    """(keep, copy): one row for each record but the smallest id of its set.

    Records are the same when the unordered set of their normalised fields is equal;
    inside a field arrays keep their order unless ``unordered``.  Digests are grouped first
    (24 bytes a row, combined on the map side); the full normal form is made again only to
    be met by the members of sets of two or more, and each member is held against its keeper's,
    in a join AQE splits where one set is very large.  Members of one digest and another
    form are regrouped by their form.  Null and empty fields are the same leaf.  Ids must be unique;
    extra columns are not read.
    """
    return _copies(*_roots(df, fields, id_col, unordered))


def collapse(df: DataFrame, fields: list[str], id_col: str, unordered: bool = False) -> DataFrame:
    """(keep, copies): each set's kept id and how many records it had, itself included."""
    roots, forms = _roots(df, fields, id_col, unordered)
    c = materialise(_copies(roots, forms), "pairs")
    more = c.groupBy("keep").agg(F.count("*").alias("more"))
    kept = roots.select(F.col("id").alias("keep")).join(c.select(F.col("copy").alias("keep")), "keep", "left_anti")
    return kept.join(more, "keep", "left").select("keep", (F.coalesce("more", F.lit(0)) + 1).alias("copies"))
