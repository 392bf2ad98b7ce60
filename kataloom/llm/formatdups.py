"""Duplicates hidden by formatting: bottom-up hashing of records, groups by root digest, structural confirmation.

A record is either plain text (one leaf) or a set of labelled fields (an unordered node over its leaves). Leaves
are normalised and hashed, the children of an unordered node are sorted by digest, and the root digest is the hash
of the sorted child digests. A record with fields also has the digest of its text as one leaf, so that it can meet
a plain record with the same characters. Digests only select: members of a group are compared as whole strings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from kataloom.operators.components import connected_components
from kataloom.session import staged

#: The ASCII characters that carry no content.
BLANKS = " \t\n\r\x0b\x0c"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A field: a label of one word, ':' or '=', and a value.
FIELD = r"(?s)^\s*[\p{L}\p{N}_]+\s*[:=]\s*\S.*$"
SPLIT = r"(?s)^([^:=]*)[:=](.*)$"


def leaf(text: Column) -> Column:
    """Text without ASCII blanks and punctuation, in lower case."""
    return F.lower(F.translate(text, BLANKS + PUNCTUATION, ""))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _shapes(comments: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, plain, fields): the normalised text, and the normalised fields in digest order for records that have them."""
    rows = comments.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    rows = rows.select("id", "text", leaf(F.col("text")).alias("plain")).where(F.length("plain") >= least)
    parts = F.filter(F.split("text", r"[|;\r\n]+"), lambda x: x.rlike(r"\S"))
    fielded = F.col("text").rlike(r"[:=]") & F.col("text").rlike(r"[|;\r\n]")
    rows = rows.withColumn("parts", F.when(fielded, parts))
    whole = (F.size("parts") >= 2) & F.forall("parts", lambda x: x.rlike(FIELD))
    children = F.transform("parts", lambda x: F.concat(leaf(F.regexp_replace(x, SPLIT, "$1")), F.lit("\x1e"), leaf(F.regexp_replace(x, SPLIT, "$2"))))
    ordered = F.array_sort(F.transform(children, lambda x: F.struct(F.md5(x).alias("d"), x.alias("v"))))
    return rows.select("id", "plain", F.when(fielded & whole, F.transform(ordered, lambda x: x["v"])).alias("fields"))


def formatting_duplicates(comments: DataFrame, id_col: str, text_col: str, *, least: int = 12) -> DataFrame:
    """(id, first_id, copies) for every record that has at least one copy; first_id is the smallest id of its group.

    Two records are the same if their texts are equal without ASCII blanks and punctuation and regardless of letter
    case, or if both consist of two or more labelled fields (between '|', ';' or line breaks) and these are the same
    in any order; sameness carries over. Records with fewer than ``least`` characters left, null ids and null texts
    are left out. ``copies`` is the group's number of records. Ids are expected to be unique; rows that repeat an id
    count as copies of each other. An empty table gives no rows; other columns are ignored.

    The first pass shuffles digests only, combined before the shuffle, so a group that holds a third of all records
    arrives as one row per task. Only records whose digest occurs more than once send their text; joins on the
    digest have unique keys on one side, and AQE splits the other where a key is hot.
    """
    shapes = _shapes(comments, id_col, text_col, least)
    marks = shapes.select(
        _digest(F.col("plain")).alias("d1"),
        F.when(F.col("fields").isNotNull(), F.unhex(F.md5(F.concat_ws("", F.transform("fields", F.md5))))).alias("d2"),
    )
    texts = staged(marks.groupBy("d1").agg(F.count("*").alias("n"), F.min("d2").alias("d2"), F.max("d2").alias("d3")), "leaves")
    roots = texts.select("d1", "n", F.coalesce("d2", "d1").alias("root"), F.lit(False).alias("bridged"))
    # A text that can be read as two different sets of fields joins their groups. Hardly any collection has one.
    bridges = texts.where("d2 <> d3").select("d2", "d3").distinct()
    if not bridges.isEmpty():
        joined = connected_components(bridges, "d2", "d3").select(F.col("node").alias("root"), F.col("root").alias("to"))
        roots = roots.drop("bridged").join(joined, "root", "left").select("d1", "n", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("bridged"))
    several = roots.groupBy("root").agg(F.sum("n").alias("_n")).where("_n > 1").select("root")
    chosen = roots.join(several, "root").select("d1", "root", "bridged")
    members = shapes.select("id", "plain", "fields", _digest(F.col("plain")).alias("d1")).join(chosen, "d1").select(
        "id", "root", "bridged", "plain", F.array_join("fields", "\x1f").alias("canon")
    )
    members = staged(members, "members")
    # Confirmation: inside a digest group, sets are built from the strings themselves.
    by_text = members.groupBy("root", "bridged", "plain").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.min("canon").alias("canon"))
    key = F.when(F.col("bridged"), "").when(F.col("canon").isNotNull(), F.concat(F.lit("f"), "canon")).otherwise(F.concat(F.lit("t"), "plain"))
    by_text = by_text.select("root", "plain", "first", "n", key.alias("key"))
    by_key = by_text.groupBy("root", "key").agg(F.min("first").alias("first_id"), F.sum("n").alias("copies")).where("copies > 1")
    sets = by_text.join(by_key, ["root", "key"]).select("root", "plain", "first_id", "copies")
    return members.join(sets, ["root", "plain"]).select("id", "first_id", "copies")


def _node(value: Column, kind: DataType, ordered: bool) -> Column:
    """struct<d, c> of a nested value, bottom-up: its digest, and its canonical form for the confirmation.

    A leaf is its normalised text; a struct or map is an unordered node over its labelled children, without null ones; an array is
    an ordered node or an unordered one. Children of an unordered node stand in the order of their digests.
    """
    made = lambda tag, children: F.struct(F.md5(F.concat(F.lit(tag), F.concat_ws("", F.transform(children, lambda x: x["d"])))).alias("d"), F.concat(F.lit(tag + "("), F.concat_ws("\x1f", F.transform(children, lambda x: x["c"])), F.lit(")")).alias("c"))
    label = lambda name, x: F.struct(F.md5(F.concat(F.md5(name), x["d"])).alias("d"), F.concat(name, F.lit("\x1e"), x["c"]).alias("c"))
    if isinstance(kind, StructType):
        children = F.array(*[F.when(value[f.name].isNotNull(), label(leaf(F.lit(f.name)), _node(value[f.name], f.dataType, ordered))) for f in kind.fields])
        out = made("s", F.array_sort(F.array_compact(children)))
    elif isinstance(kind, MapType):
        entries = F.filter(F.map_entries(value), lambda e: e["value"].isNotNull())
        out = made("s", F.array_sort(F.transform(entries, lambda e: label(leaf(e["key"].cast("string")), _node(e["value"], kind.valueType, ordered)))))
    elif isinstance(kind, ArrayType):
        children = F.transform(value, lambda x: F.coalesce(_node(x, kind.elementType, ordered), F.struct(F.lit("n").alias("d"), F.lit("n").alias("c"))))
        out = made("a", children) if ordered else made("b", F.array_sort(children))
    else:
        text = leaf(value) if isinstance(kind, StringType) else value.cast("string")
        out = F.struct(F.md5(F.concat(F.lit("t"), text)).alias("d"), F.concat(F.lit("t"), text).alias("c"))
    return F.when(value.isNotNull(), out)


def nested_duplicates(records: DataFrame, id_col: str, columns: Sequence[str], *, ordered: bool = False) -> DataFrame:
    """(id, first_id, copies) for every record that has a copy, by the nested ``columns``: structs, maps and arrays of any depth.

    Records are the same if their leaves are equal without ASCII blanks and punctuation and regardless of case, whatever the order
    of fields and map entries and, unless ``ordered``, of array elements. A null field is the same as none; records in which all
    columns are null are left out, as are null ids. Ids are expected to be unique. An empty table gives no rows.

    Only root digests are shuffled at first, combined before the shuffle; records whose digest occurs more than once send
    their canonical form, on which groups are made, so equal digests alone make no copy.
    """
    schema = records.select(*columns).schema
    parts = F.struct(*[F.col(f"`{c}`").alias(c) for c in columns])
    some = F.lit(False)
    for c in columns:
        some = some | F.col(f"`{c}`").isNotNull()
    rows = records.where(F.col(f"`{id_col}`").isNotNull() & some).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), _node(parts, schema, ordered).alias("r"))
    rows = staged(rows.select("id", F.unhex("r.d").alias("d"), F.col("r.c").alias("c")), "roots")
    several = rows.groupBy("d").agg(F.count("*").alias("_n")).where("_n > 1").select("d")
    members = staged(rows.join(several, "d"), "members")
    groups = members.groupBy("d", "c").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return members.join(groups, ["d", "c"]).select("id", "first_id", "copies")
