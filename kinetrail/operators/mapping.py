"""Coarse-graining: atoms to beads, bead positions and back-mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POSITIONS = ("com_geom", "com_mass", "representative_atom")


def _numbered(values: DataFrame, key: str) -> DataFrame:
    """Bead numbers 0.. in ascending order of the key."""
    from ..functions.stats import numbered_globally

    return numbered_globally(values, [key], "bead").select(key, F.col("bead").cast("long").alias("bead"))


def identity_map(atoms: DataFrame) -> DataFrame:
    beads = _numbered(atoms.select(F.col("id").alias("bead_id")), "bead_id")
    return atoms.select("id", F.col("id").alias("bead_id"), F.lit(1.0).alias("weight")).join(beads, "bead_id")


def molecule_map(atoms: DataFrame) -> DataFrame:
    beads = _numbered(atoms.select(F.col("mol").alias("bead_id")).distinct(), "bead_id")
    return atoms.select("id", F.col("mol").alias("bead_id"), F.lit(1.0).alias("weight")).join(beads, "bead_id")


def file_map(rows: DataFrame, atoms: DataFrame) -> DataFrame:
    """From a mapping file's rows (atom_id, bead_id, weight, bead_type); errors as the checks say."""
    if rows.isEmpty():
        raise ValueError("the mapping is empty")
    if not rows.join(atoms, rows["atom_id"] == atoms["id"], "left_anti").isEmpty():
        raise ValueError("the mapping names an unknown atom")
    if not rows.filter("weight < 0").isEmpty():
        raise ValueError("a weight is negative")
    if not rows.groupBy("atom_id").agg(F.countDistinct("bead_id").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("an atom is in two beads")
    types = rows.groupBy("bead_id").agg(F.countDistinct("bead_type").alias("n"), F.max("bead_type").alias("bead_type"))
    if not types.filter("n > 1").isEmpty():
        raise ValueError("a bead has two types")
    typed = not types.filter("bead_type is not null").isEmpty()
    kinds = types.select("bead_id", F.coalesce("bead_type", F.lit(0)).alias("bead_type") if typed else F.lit(None).cast("int").alias("bead_type"))
    beads = _numbered(rows.select("bead_id").distinct(), "bead_id")
    return rows.select(F.col("atom_id").alias("id"), "bead_id", "weight").join(beads, "bead_id").join(kinds, "bead_id")


def restrict(mapping: DataFrame, group: DataFrame) -> DataFrame:
    """The mapping of a static group's atoms; an empty group is an error."""
    if group.isEmpty():
        raise ValueError("the source group is empty")
    return mapping.join(group, "id", "left_semi")


def atom_masses(atoms: DataFrame, masses: DataFrame | None) -> DataFrame:
    """id and mass; 1 where the table has no positive mass for the type."""
    if masses is None:
        return atoms.select("id", F.lit(1.0).alias("mass"))
    return atoms.select("id", "type").join(masses, "type", "left").select("id", F.when(F.col("mass") > 0, F.col("mass")).otherwise(1.0).alias("mass"))


def bead_masses(mapping: DataFrame, masses: DataFrame) -> DataFrame:
    return mapping.join(masses, "id").groupBy("bead_id").agg(F.sum("mass").alias("mass"))


def bead_positions(positions: DataFrame, mapping: DataFrame, how: str = "com_geom", masses: DataFrame | None = None) -> DataFrame:
    """frame, bead_id, x, y, z. Weighted means of unwrapped coordinates, (0,0,0) where the weights sum to 0."""
    rows = positions.join(mapping.select("id", "bead_id", "weight"), "id")
    if how == "representative_atom":
        return rows.groupBy("frame", "bead_id").agg(*(F.min_by(c, "id").alias(c) for c in "xyz"))
    if how not in POSITIONS:
        raise ValueError(f"unknown bead position {how}")
    w = F.col("weight")
    if how == "com_mass":
        if masses is None:
            raise ValueError("com_mass needs masses")
        rows, w = rows.join(masses, "id"), F.col("weight") * F.col("mass")
    total = F.sum(w)
    return rows.groupBy("frame", "bead_id").agg(*(F.when(total > 0, F.sum(w * F.col(c)) / F.when(total > 0, total)).otherwise(0.0).alias(c) for c in "xyz"))


def atom_bonds(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """ai, aj (ids) of edges between canonical indices u and v."""
    name = lambda end, c: atoms.select(F.col("idx").alias(end), F.col("id").alias(c))
    return edges.join(name("u", "ai"), "u").join(name("v", "aj"), "v").select("ai", "aj")


def bead_edges(bonds: DataFrame, mapping: DataFrame) -> DataFrame:
    """u < v: beads joined by a bond of their atoms; unmapped ends and bonds within a bead drop out."""
    a = mapping.select(F.col("id").alias("ai"), F.col("bead_id").alias("p"))
    b = mapping.select(F.col("id").alias("aj"), F.col("bead_id").alias("q"))
    met = bonds.select("ai", "aj").join(a, "ai").join(b, "aj").filter("p <> q")
    return met.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct()


def back_intensive(atoms: DataFrame, mapping: DataFrame, values: DataFrame, fill: float = 0.0) -> DataFrame:
    """id and its bead's value; `fill` for unmapped atoms."""
    held = mapping.select("id", "bead_id").distinct().join(values, "bead_id")
    return atoms.select("id").join(held, "id", "left").select("id", F.coalesce("value", F.lit(fill)).alias("value"))


def back_extensive(atoms: DataFrame, mapping: DataFrame, values: DataFrame, fill: float = 0.0) -> DataFrame:
    """id and its share w / sum(w) of its bead's value; equal shares where the weights sum to nothing."""
    bead = Window.partitionBy("bead_id")
    total, n = F.sum("weight").over(bead), F.count("*").over(bead)
    held = mapping.join(values, "bead_id").withColumn("total", total).withColumn("n", n)
    share = F.when(F.col("total") > 0, F.col("weight") / F.when(F.col("total") > 0, F.col("total"))).otherwise(1.0 / F.col("n"))
    held = held.select("id", (F.col("value") * share).alias("value"))
    return atoms.select("id").join(held, "id", "left").select("id", F.coalesce("value", F.lit(fill)).alias("value"))


def specification(model_scale: str = "auto", mode: str = "none", position: str = "com_geom", source_group: str = "", file_hash: str = "") -> tuple[str, str]:
    """The mapping's canonical text and its fingerprint."""
    from ..functions.hashing import fnv1a, hex16

    text = f"model_scale={model_scale};mode={mode};position={position};source_group={source_group};file_hash_fnv1a64={file_hash}"
    return text, hex16(fnv1a(text.encode()))
