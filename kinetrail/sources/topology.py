"""Bond tables, sectioned data files and mapping files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sections: least columns, how many of the last columns are atoms, and their names (fixed values of the format).
SECTIONS = {
    "Masses": (2, 0, ()),
    "Bonds": (4, 2, ("ai", "aj")),
    "Angles": (5, 3, ("ai", "aj", "ak")),
    "Dihedrals": (6, 4, ("ai", "aj", "ak", "al")),
    "Impropers": (6, 4, ("ai", "aj", "ak", "al")),
}


MOST_HEADS = 10_000


class TopologyError(ValueError):
    pass


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """at (line order: file, then place in it) and t (tokens) of the lines that hold something besides a comment."""
    text = F.trim(F.regexp_replace("value", "#.*$", ""))
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(at.alias("at"), text.alias("line")).filter("line <> ''").select("at", "line", F.split("line", r"[\s]+").alias("t"))


def _whole(c: Column, kind: str) -> Column:
    v = c.try_cast(kind)
    return F.when(v.isNull(), F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(c, F.lit(""))))).otherwise(v)


def read_bond_table(spark: SparkSession, path: str) -> DataFrame:
    """type, ai, aj: two columns i j (type 0), three type i j, more: the second is the type and the last two the atoms."""
    n = F.size("t")
    kind = F.when(n == 2, F.lit("0")).when(n == 3, F.get("t", F.lit(0))).otherwise(F.get("t", F.lit(1)))
    return _tokens(spark, path).filter(n >= 2).select(_whole(kind, "int").alias("type"), _whole(F.element_at("t", -2), "long").alias("ai"), _whole(F.element_at("t", -1), "long").alias("aj"))


def read_data_file(spark: SparkSession, path: str, sections: list[str]) -> dict[str, DataFrame]:
    """The asked sections of a data file, each as a table; a missing one is an error, an empty one is not.

    A line that starts with a letter opens a section. Only those few lines reach the driver; every other line learns
    its section by comparing its place with theirs."""
    lines = _tokens(spark, path)
    # A data file has a handful of sections; a file with more heads than MOST_HEADS is none, and isn't collected.
    heads = sorted((tuple(r["at"]), r["line"]) for r in lines.filter(F.col("line").rlike("^[A-Za-z]")).select("at", F.substring("line", 1, 40).alias("line")).limit(MOST_HEADS + 1).collect())
    if len(heads) > MOST_HEADS:
        raise TopologyError("too many lines begin with a letter for a data file")
    out = {}
    for name in sections:
        least, atoms, names = SECTIONS[name]
        spans = [(a, heads[i + 1][0] if i + 1 < len(heads) else None) for i, (a, line) in enumerate(heads) if line.startswith(name)]
        if not spans:
            raise TopologyError(f"section {name} is missing")
        place = lambda x: F.struct(F.lit(x[0]).alias("file"), F.lit(x[1]).cast("long").alias("block"), F.lit(x[2]).cast("long").alias("line"))
        inside = F.lit(False)
        for a, b in spans:
            inside = inside | ((F.col("at") > place(a)) & (F.lit(True) if b is None else F.col("at") < place(b)))
        rows = lines.filter(inside).select("at", F.when(F.size("t") < least, F.raise_error(F.lit(f"a short row in {name}"))).otherwise(F.col("t")).alias("t"))
        if name == "Masses":
            # Later rows of a type replace earlier ones.
            typed = rows.select("at", _whole(F.get("t", F.lit(0)), "int").alias("type"), _whole(F.get("t", F.lit(1)), "double").alias("mass"))
            out[name] = typed.groupBy("type").agg(F.max_by("mass", "at").alias("mass"))
        else:
            out[name] = rows.select(_whole(F.get("t", F.lit(1)), "int").alias("type"), *(_whole(F.element_at("t", k - atoms), "long").alias(c) for k, c in enumerate(names)))
    return out


def read_mapping_file(spark: SparkSession, path: str) -> DataFrame:
    """atom_id, bead_id, weight (1 if not given), bead_type (null if not given)."""
    has = lambda k, c, other: F.when(F.size("t") > k, c).otherwise(other)
    return _tokens(spark, path).filter(F.size("t") >= 2).select(
        _whole(F.get("t", F.lit(0)), "long").alias("atom_id"), _whole(F.get("t", F.lit(1)), "long").alias("bead_id"),
        has(2, _whole(F.get("t", F.lit(2)), "double"), F.lit(1.0)).alias("weight"), has(3, _whole(F.get("t", F.lit(3)), "int"), F.lit(None)).cast("int").alias("bead_type"),
    )


def canonical_bonds(bonds: DataFrame, atoms: DataFrame, columns: tuple[str, ...] = ("ai", "aj")) -> DataFrame:
    """Atom ids replaced by canonical indices; an unknown id is an error."""
    out = bonds
    for c in columns:
        if not out.join(atoms.select(F.col("id").alias(c)), c, "left_anti").isEmpty():
            raise TopologyError("a section names an unknown atom")
        out = out.join(atoms.select(F.col("id").alias(c), F.col("idx").alias(f"__{c}")), c).drop(c)
    names = {"ai": "u", "aj": "v", "ak": "w", "al": "x"}
    return out.select("type", *(F.col(f"__{c}").alias(names[c]) for c in columns))
