"""Trajectories, topologies and samples seen in the driver's tables, so that every operator has real inputs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..functions.stats import numbered_globally
from .durable import settle

FRAMES = 28
ORTHORHOMBIC = Box((0.0, 0.0, 0.0), (20.0, 4.0, 3.0))
TRICLINIC = Box((0.0, 0.0, 0.0), (20.0, 4.0, 3.0), 2.0, 1.0, 0.5)


@dataclass
class Views:
    """Each view is built when first used; all read the tables of one folder."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def positions(self) -> DataFrame:
        """frame, timestep, id, x, y, z: a particle is a supplier, a frame a quarter, a position means of its lines."""
        day = F.col("l_shipdate")
        frame = ((F.year(day) - 1995) * 4 + F.quarter(day) - 1).cast("long")
        percent = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
        cells = self.table("lineitem").groupBy(F.col("l_suppkey").alias("id"), frame.alias("frame")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("sq"), percent("l_discount").alias("sd"), percent("l_tax").alias("st"))
        # The cells of an id meet in one partition, where the correlators need them too.
        cells = cells.withColumn("frames", F.count("*").over(Window.partitionBy("id"))).filter(F.col("frames") == FRAMES)
        cells = cells.select("frame", (F.col("frame") * 10 + F.col("frame") % 3).alias("timestep"), "id", *((F.col(c) / F.col("n")).alias(v) for c, v in (("sq", "x"), ("sd", "y"), ("st", "z"))))
        # Correlators read them several times (both sides of a pair, and the drift); the lines are reduced once.
        return settle(cells, "positions")

    @cached_property
    def atoms(self) -> DataFrame:
        """idx, id, type, mol: the particles in canonical order."""
        ids = self.positions.filter("frame = 0").select("id")
        return numbered_globally(ids, ["id"], "idx").select(F.col("idx").cast("long").alias("idx"), "id", (F.col("id") % 3 + 1).cast("int").alias("type"), (F.floor(F.col("id") / 10) + 1).cast("long").alias("mol"))

    @cached_property
    def masses(self) -> DataFrame:
        return self.spark.createDataFrame([(1, 12.0), (2, 1.0), (3, 16.0)], "type int, mass double")

    @cached_property
    def bonds(self) -> DataFrame:
        """type, ai, aj (ids): chains, branches, rings and networks by molecule."""
        a = self.atoms.select("id", "mol", (F.col("id") % 10).alias("digit"))
        b = a.select(F.col("id").alias("aj"), F.col("mol").alias("mol_b"), F.col("digit").alias("end"))
        pair = a.join(b, F.col("mol") == F.col("mol_b")).filter("mol % 5 <> 0 and digit < end")
        chain = (F.col("end") == F.col("digit") + 1) & ~((F.col("mol") % 4 == 3) & (F.col("digit") == 8))
        extra = ((F.col("digit") == 4) & (F.col("end") == 9) & (F.col("mol") % 4 == 3)) | ((F.col("digit") == 0) & (F.col("end") == 9) & (F.col("mol") % 4).isin(0, 2)) | ((F.col("digit") == 2) & (F.col("end") == 7) & (F.col("mol") % 4 == 0))
        kind = F.when(chain, F.col("mol") % 2 + 1).otherwise(3).cast("int")
        return pair.filter(chain | extra).select(kind.alias("type"), F.col("id").alias("ai"), "aj")

    @cached_property
    def edges(self) -> DataFrame:
        """u, v: bonds between canonical indices."""
        i = self.atoms.select(F.col("id").alias("ai"), F.col("idx").alias("u"))
        j = self.atoms.select(F.col("id").alias("aj"), F.col("idx").alias("v"))
        return self.bonds.join(i, "ai").join(j, "aj").select("type", "u", "v")

    @cached_property
    def mapping(self) -> DataFrame:
        """atom_id, bead_id, weight, bead_type: the rows of a mapping file."""
        digit = F.col("id") % 10
        third = F.floor(digit / 3)
        return self.atoms.filter(digit != 9).select(F.col("id").alias("atom_id"), (F.col("mol") * 10 + third).cast("long").alias("bead_id"), (F.col("id") % 4 + 1).cast("double").alias("weight"), (third + 1).cast("int").alias("bead_type"))

    @cached_property
    def chain_positions(self) -> DataFrame:
        return self.atoms.select(F.col("idx").alias("node"), F.col("mol").alias("chain_id"), (9 - F.col("id") % 10).cast("long").alias("chain_pos"))

    @cached_property
    def points(self) -> DataFrame:
        """node, x, y, z: three components of the embeddings."""
        at = lambda k: F.element_at("embedding", k).cast("double")
        return self.table("embeddings").select(F.col("vec_id").alias("node"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))

    @cached_property
    def samples(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("i"), "value", F.col("user_id").cast("double").alias("user"))


# The same views as DuckDB common table expressions.
SQL = {
    "cells": "select l_suppkey as id, cast((year(l_shipdate)-1995)*4 + quarter(l_shipdate) - 1 as bigint) as frame, count(*) as n, sum(cast(l_quantity as bigint)) as sq, sum(cast(round(l_discount*100) as bigint)) as sd, sum(cast(round(l_tax*100) as bigint)) as st from lineitem group by 1, 2",
    "full_ids": "select id from cells group by id having count(*) = 28",
    "traj": "select frame, 10*frame + frame % 3 as timestep, id, cast(sq as double)/n as x, cast(sd as double)/n as y, cast(st as double)/n as z from cells where id in (select id from full_ids)",
    "atoms": "select row_number() over (order by id) - 1 as idx, id, cast(id % 3 + 1 as integer) as type, id // 10 + 1 as mol from full_ids",
    "masses": "select * from (values (1, 12.0::double), (2, 1.0::double), (3, 16.0::double)) t(type, mass)",
    "pairs_of_mol": "select a.id as ai, b.id as aj, a.mol, a.id % 10 as d, b.id % 10 as e from atoms a join atoms b on a.mol = b.mol where a.mol % 5 <> 0 and a.id % 10 < b.id % 10",
    "bonds": "select cast(mol % 2 + 1 as integer) as type, ai, aj from pairs_of_mol where e = d + 1 and not (mol % 4 = 3 and d = 8) union all select 3, ai, aj from pairs_of_mol where (d = 4 and e = 9 and mol % 4 = 3) or (d = 0 and e = 9 and mol % 4 in (0, 2)) or (d = 2 and e = 7 and mol % 4 = 0)",
    "edges": "select b.type, i.idx as u, j.idx as v from bonds b join atoms i on i.id = b.ai join atoms j on j.id = b.aj",
    "mapfile": "select id as atom_id, mol*10 + (id % 10) // 3 as bead_id, cast(1 + id % 4 as double) as weight, cast((id % 10) // 3 + 1 as integer) as bead_type from atoms where id % 10 <> 9",
    "sym": "select u, v from edges union select v, u from edges",
    "reach": "select idx as node, idx as other from atoms union select r.node, s.v from reach r join sym s on s.u = r.other",
    "comp": "select node, min(other) as root from reach group by node",
    "labels": "select node, dense_rank() over (order by root) - 1 as component from comp",
    "degree": "select a.idx as node, count(s.v) as degree from atoms a left join sym s on s.u = a.idx group by a.idx",
    "points": "select vec_id as node, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings",
    "samples": "select event_id as i, value, cast(user_id as double) as usr from events",
}
NEEDS = {
    "full_ids": ["cells"], "traj": ["full_ids"], "atoms": ["full_ids"], "pairs_of_mol": ["atoms"], "bonds": ["pairs_of_mol"], "edges": ["bonds"], "mapfile": ["atoms"],
    "sym": ["edges"], "reach": ["sym"], "comp": ["reach"], "labels": ["comp"], "degree": ["sym"],
}


def with_views(*names: str) -> str:
    """The WITH clause for these views and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "with recursive " + ", ".join(f"{n} as ({SQL[n]})" for n in order) + " "
