"""The registered queries over the trajectory views, each beside its DuckDB equivalent.

Floating results are rounded to 8 digits here and nowhere in the library; counts and indices are bigint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, stats
from ..operators import correlate, graph, mapping
from ..operators.correlate import CorrelatorSpec
from . import selection
from .views import ORTHORHOMBIC, TRICLINIC, Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        name = f.__name__
        QUERIES[name] = lambda spark, folder: f(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def r8(df: DataFrame) -> DataFrame:
    """Doubles rounded to 8 digits, integers as bigint."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append((F.round(c, 8) + F.lit(0.0) if kind == "double" else c.cast("long") if kind in ("int", "bigint") else c).alias(name))
    return df.select(*out)


# --- correlation --------------------------------------------------------------------------------------------------

DT, BLOCK = 0.5, 4


def sql_msd(key: str = "cur - org", lag: str = "cast(key as bigint)", time: str = "mean_dtimestep * 0.5", axes: str = "xyz", stride: int = 1, block: int = BLOCK, drift: bool = True, members: str = "", frames: str = "", views: tuple[str, ...] = (), extra: str = "") -> str:
    shift = "(select frame, avg(x) as cx, avg(y) as cy, avg(z) as cz from rows_ group by frame)" if drift else "(select distinct frame, 0.0 as cx, 0.0 as cy, 0.0 as cz from rows_)"
    square = " + ".join(f"(c.{a}-o.{a})*(c.{a}-o.{a})" for a in axes)
    blocks = f"(select key, rn // {block} as b, avg(v) as bm from (select *, row_number() over (partition by key order by cur, org desc) - 1 as rn from keyed) group by 1, 2 having count(*) = {block})" if block else "(select 0 as key, 0 as b, 0.0 as bm where false)"
    return (
        with_views("traj", *views)
        + f"""{extra}, rows_ as (select * from traj {frames}), com as {shift},
sig as (select r.frame, r.timestep, r.id, r.x-cx as x, r.y-cy as y, r.z-cz as z from rows_ r join com using (frame) {members}),
pairs as (select c.frame as cur, o.frame as org, c.timestep-o.timestep as dts, avg({square}) as v from sig c join sig o on c.id = o.id and o.frame < c.frame where (c.frame-o.frame) % {stride} = 0 and c.timestep > o.timestep group by 1, 2, 3),
keyed as (select *, {key} as key from pairs),
base as (select key, avg(v) as msd, count(*) as count_pairs, avg(dts) as mean_dtimestep from keyed group by key),
blocks as {blocks},
err as (select key, count(*) as n_blocks, case when count(*) > 1 then sqrt(greatest(0.0, avg(bm*bm)-avg(bm)*avg(bm))*count(*)/(count(*)-1)/count(*)) else 0.0 end as sem from blocks group by key)
select {lag} as lag, round({time}, 8) as time, round(msd, 8) as msd, count_pairs, round(coalesce(sem, 0.0), 8) as sem, cast(coalesce(n_blocks, 0) as bigint) as n_blocks, round(mean_dtimestep, 8) as mean_dtimestep from base left join err using (key)"""
    )


def series(df: DataFrame, whole_lag: bool = True) -> DataFrame:
    return r8(df.withColumn("lag", F.col("lag").cast("long")) if whole_lag else df)


def spec(**k) -> CorrelatorSpec:
    return CorrelatorSpec(**({"dt": DT, "block_size": BLOCK} | k))


@query(sql_msd())
def msd_exact_frame(v: Views) -> DataFrame:
    return series(correlate.msd(v.positions, spec()))


@query(sql_msd())
def msd_exact_blocked_kernel(v: Views) -> DataFrame:
    return series(correlate.exact(correlate.without_drift(v.positions), spec()))


@query(sql_msd())
def msd_exact_joined(v: Views) -> DataFrame:
    """The same by the join on id, which functions of Columns take."""
    return series(correlate.exact(correlate.without_drift(v.positions), spec(), tiled=False))


@query(sql_msd(block=0))
def msd_fft(v: Views) -> DataFrame:
    return series(correlate.msd(v.positions, spec(kind="fft", block_size=0)))


_EVEN = ", even as (select frame, 10*frame as timestep, id, x, y, z from traj)"


def _even(v: Views) -> DataFrame:
    """The positions at equal steps, which the axes of time ask for."""
    return v.positions.withColumn("timestep", F.col("frame") * 10)


@query(sql_msd(key="dts", time="cast(key as double) * 0.5", block=0, axes="xy", stride=2, extra=_EVEN).replace("select * from traj", "select * from even"))
def msd_fft_timestep(v: Views) -> DataFrame:
    return series(correlate.spectral(correlate.without_drift(_even(v)), CorrelatorSpec(kind="fft", axis="timestep", dt=DT, components="xy", lag_stride=1)).filter("lag % 20 = 0"))


@query(sql_msd(stride=3))
def msd_exact_stride(v: Views) -> DataFrame:
    return series(correlate.msd(v.positions, spec(lag_stride=3)))


@query(sql_msd(key="dts", time="cast(key as double) * 0.5"))
def msd_exact_timestep(v: Views) -> DataFrame:
    return series(correlate.msd(v.positions, spec(axis="timestep")))


@query(sql_msd(key="cast(floor(dts * 0.5 / 7.0) as bigint)", lag="round(mean_dtimestep * 0.5, 8)"))
def msd_exact_timebin(v: Views) -> DataFrame:
    return series(correlate.msd(v.positions, spec(axis="timebin", timebin_width=7.0)), False)


_MERGE_TAIL = """,
bins as (select key, row_number() over (order by key) as i, sum(v) as s, count(*) as c, sum(dts) as d from keyed group by key),
fold as (select i, s, c, d, 0 as grp from bins where i = 1 union all select b.i, case when f.c < 20 then f.s + b.s else b.s end, case when f.c < 20 then f.c + b.c else b.c end, case when f.c < 20 then f.d + b.d else b.d end, case when f.c < 20 then f.grp else f.grp + 1 end from fold f join bins b on b.i = f.i + 1),
done as (select grp, max_by(s, i) as s, max_by(c, i) as c, max_by(d, i) as d from fold group by grp),
last as (select max(grp) as g from done),
short as (select case when (select c from done where grp = (select g from last)) < 20 and (select g from last) > 0 then 1 else 0 end as x),
final as (select case when (select x from short) = 1 and grp = (select g from last) then grp - 1 else grp end as grp, s, c, d from done)
select round(sum(d)/sum(c)*0.5, 8) as lag, round(sum(d)/sum(c)*0.5, 8) as time, round(sum(s)/sum(c), 8) as msd, cast(sum(c) as bigint) as count_pairs, 0.0::double as sem, 0::bigint as n_blocks, round(sum(d)/sum(c), 8) as mean_dtimestep from final group by grp"""


@query(sql_msd(key="cast(floor(dts * 0.5 / 7.0) as bigint)", block=0).split(",\nbase as")[0] + _MERGE_TAIL)
def msd_timebin_merged(v: Views) -> DataFrame:
    return series(correlate.msd(v.positions, spec(axis="timebin", timebin_width=7.0, min_pairs_per_bin=20, block_size=0)), False)


@query(sql_msd(block=2))
def msd_block_sem(v: Views) -> DataFrame:
    return series(correlate.msd(v.positions, spec(block_size=2)))


@query(sql_msd(drift=False))
def msd_no_drift(v: Views) -> DataFrame:
    return series(correlate.msd(v.positions, spec(), remove_drift=False))


@query(sql_msd(axes="xz"))
def msd_component_mask(v: Views) -> DataFrame:
    return series(correlate.msd(v.positions, spec(components="xxzz")))


@query(sql_msd(frames="where frame between 5 and 20"))
def msd_frame_range(v: Views) -> DataFrame:
    return series(correlate.msd(v.positions, spec(), frames=(5, 20)))


@query(sql_msd(members="where r.id in (select id from atoms where type = 1)", views=("atoms",)))
def msd_group(v: Views) -> DataFrame:
    groups = selection.Groups({"ones": "type:1"}, v.atoms, v.positions, ORTHORHOMBIC)
    return series(correlate.msd(v.positions, spec(), members=groups.ids("ones")))


@query(sql_msd(members="where r.id in (select id from atoms join degree on idx = node where degree = 1)", views=("degree",)))
def msd_topo_group(v: Views) -> DataFrame:
    ends = topo_members(v, "atoms_is_end")
    return series(correlate.msd(v.positions, spec(), members=ends))


@query(sql_msd(members="where r.id in (select id from atoms join degree on idx = node where type = 1 and not degree = 1)", views=("degree",)))
def msd_combine_not(v: Views) -> DataFrame:
    groups = selection.Groups({"ones": "type:1"}, v.atoms, v.positions, ORTHORHOMBIC)
    members = selection.combined_ids(v.atoms, groups.ids("ones"), topo_members(v, "atoms_is_end"), "A & !T")
    return series(correlate.msd(v.positions, spec(), members=members))


@query(with_views("traj") + "select t.frame, round(greatest(0.0, avg((t.x-o.x)*(t.x-o.x)+(t.y-o.y)*(t.y-o.y)+(t.z-o.z)*(t.z-o.z)) - (avg(t.x-o.x)*avg(t.x-o.x)+avg(t.y-o.y)*avg(t.y-o.y)+avg(t.z-o.z)*avg(t.z-o.z))), 8) as msd from traj t join traj o on o.id = t.id and o.frame = 0 group by t.frame")
def msd_single_origin(v: Views) -> DataFrame:
    return r8(correlate.single_origin_msd(v.positions))


def _multitau_sql(m: int, levels: int) -> str:
    out = with_views("traj") + ", com as (select frame, avg(x) cx, avg(y) cy, avg(z) cz from traj group by frame), l0 as (select id, dense_rank() over (partition by id order by frame) - 1 as k, timestep, x-cx as x, y-cy as y, z-cz as z from traj join com using (frame))"
    for n in range(1, levels):
        out += f", l{n} as (select id, k // 2 as k, cast(sum(timestep // 2) as bigint) as timestep, sum(x)*0.5 as x, sum(y)*0.5 as y, sum(z)*0.5 as z from l{n - 1} group by 1, 2 having count(*) = 2)"
    out += ", pairs as (" + " union all ".join(f"select cast((c.k-o.k) * {1 << n} as bigint) as key, c.k as cur, o.k as org, c.timestep-o.timestep as dts, avg((c.x-o.x)*(c.x-o.x)+(c.y-o.y)*(c.y-o.y)+(c.z-o.z)*(c.z-o.z)) as v from l{n} c join l{n} o on c.id = o.id and c.k-o.k between {1 if n == 0 else m // 2 + 1} and {m} and c.timestep > o.timestep group by 1, 2, 3, 4" for n in range(levels)) + ")"
    out += f", base as (select key, avg(v) as msd, count(*) as count_pairs, avg(dts) as mean_dtimestep from pairs group by key), blocks as (select key, rn // {BLOCK} as b, avg(v) as bm from (select *, row_number() over (partition by key order by cur, org desc) - 1 as rn from pairs) group by 1, 2 having count(*) = {BLOCK}), err as (select key, count(*) as n_blocks, case when count(*) > 1 then sqrt(greatest(0.0, avg(bm*bm)-avg(bm)*avg(bm))*count(*)/(count(*)-1)/count(*)) else 0.0 end as sem from blocks group by key)"
    return out + " select key as lag, round(mean_dtimestep * 0.5, 8) as time, round(msd, 8) as msd, count_pairs, round(coalesce(sem, 0.0), 8) as sem, cast(coalesce(n_blocks, 0) as bigint) as n_blocks, round(mean_dtimestep, 8) as mean_dtimestep from base left join err using (key)"


@query(_multitau_sql(4, 3))
def msd_multitau(v: Views) -> DataFrame:
    return series(correlate.msd(v.positions, spec(kind="multitau", channels=4, levels=3)))


@query(with_views("traj") + "select frame, round(avg(x), 8) as cx, round(avg(y), 8) as cy, round(avg(z), 8) as cz from traj group by frame")
def drift_com(v: Views) -> DataFrame:
    return r8(correlate.center_of_mass(v.positions))


# --- geometry and selections --------------------------------------------------------------------------------------

_WRAP = {
    "o": ("x - floor(x/20.0)*20.0", "y - floor(y/4.0)*4.0", "z - floor(z/3.0)*3.0"),
}
_WRAPPED = "wrapped as (select frame, t.id, type, mol, (x/20.0-floor(x/20.0))*20.0 as x, (y/4.0-floor(y/4.0))*4.0 as y, (z/3.0-floor(z/3.0))*3.0 as z from traj t join atoms a on a.id = t.id)"
_LAMBDA = "lam as (select frame, id, z/3.0 as c, (y - z/3.0*0.5)/4.0 as b, (x - (y - z/3.0*0.5)/4.0*2.0 - z/3.0*1.0)/20.0 as a from traj)"
_SEL = with_views("traj", "atoms") + ", " + _WRAPPED


@query(with_views("traj") + "select frame, id, round((x - floor(x/20.0)*20.0) + floor(x/20.0)*20.0, 8) as x, round((y - floor(y/4.0)*4.0) + floor(y/4.0)*4.0, 8) as y, round((z - floor(z/3.0)*3.0) + floor(z/3.0)*3.0, 8) as z from traj")
def geom_unwrap(v: Views) -> DataFrame:
    flags = {c: F.floor(F.col(c) / e) for c, e in zip("xyz", ORTHORHOMBIC.edges)}
    inside = {c: F.col(c) - flags[c] * e for c, e in zip("xyz", ORTHORHOMBIC.edges)}
    return r8(v.positions.select("frame", "id", *(c.alias(n) for n, c in zip("xyz", geometry.unwrap(ORTHORHOMBIC, *inside.values(), *flags.values())))))


@query(with_views("traj") + "select frame, id, round(x+1*20.0+2*2.0+3*1.0, 8) as x, round(y+2*4.0+3*0.5, 8) as y, round(z+3*3.0, 8) as z from traj")
def geom_unwrap_triclinic(v: Views) -> DataFrame:
    return r8(v.positions.select("frame", "id", *(c.alias(n) for n, c in zip("xyz", geometry.unwrap(TRICLINIC, F.col("x"), F.col("y"), F.col("z"), F.lit(1), F.lit(2), F.lit(3))))))


@query(_SEL + " select frame, id, round(x, 8) as x, round(y, 8) as y, round(z, 8) as z from wrapped")
def geom_wrap(v: Views) -> DataFrame:
    return r8(v.positions.select("frame", "id", *(c.alias(n) for n, c in zip("xyz", geometry.wrap(ORTHORHOMBIC, F.col("x"), F.col("y"), F.col("z"))))))


@query(with_views("traj") + f", {_LAMBDA} select frame, id, round(a, 8) as a, round(b, 8) as b, round(c, 8) as c from lam")
def geom_fractional_triclinic(v: Views) -> DataFrame:
    return r8(v.positions.select("frame", "id", *(c.alias(n) for n, c in zip("abc", geometry.to_fractional(TRICLINIC, F.col("x"), F.col("y"), F.col("z"))))))


@query(with_views("traj") + f", {_LAMBDA} select frame, id, round((a-floor(a))*20.0+(b-floor(b))*2.0+(c-floor(c))*1.0, 8) as x, round((b-floor(b))*4.0+(c-floor(c))*0.5, 8) as y, round((c-floor(c))*3.0, 8) as z from lam")
def geom_wrap_triclinic(v: Views) -> DataFrame:
    return r8(v.positions.select("frame", "id", *(c.alias(n) for n, c in zip("xyz", geometry.wrap(TRICLINIC, F.col("x"), F.col("y"), F.col("z"))))))


_STEP = with_views("traj") + ", step as (select t.frame, t.id, t.x*3-o.x as dx, t.y*3-o.y as dy, t.z*3-o.z as dz from traj t join traj o on o.id = t.id and o.frame = 0)"


def _step(v: Views) -> DataFrame:
    o = v.positions.filter("frame = 0").select("id", *(F.col(c).alias(f"o{c}") for c in "xyz"))
    return v.positions.join(o, "id").select("frame", "id", *((F.col(c) * 3 - F.col(f"o{c}")).alias(f"d{c}") for c in "xyz"))


@query(_STEP + " select frame, id, round(dx-round_even(dx/20.0,0)*20.0, 8) + 0.0 as x, round(dy-round_even(dy/4.0,0)*4.0, 8) + 0.0 as y, round(dz-round_even(dz/3.0,0)*3.0, 8) + 0.0 as z from step")
def geom_min_image(v: Views) -> DataFrame:
    return r8(_step(v).select("frame", "id", *(c.alias(n) for n, c in zip("xyz", geometry.minimum_image(ORTHORHOMBIC, F.col("dx"), F.col("dy"), F.col("dz"))))))


@query(_STEP + ", f as (select frame, id, dz/3.0 as c, (dy-dz/3.0*0.5)/4.0 as b, (dx-(dy-dz/3.0*0.5)/4.0*2.0-dz/3.0*1.0)/20.0 as a from step), g as (select frame, id, a-round_even(a,0) as a, b-round_even(b,0) as b, c-round_even(c,0) as c from f) select frame, id, round(a*20.0+b*2.0+c*1.0, 8) + 0.0 as x, round(b*4.0+c*0.5, 8) + 0.0 as y, round(c*3.0, 8) + 0.0 as z from g")
def geom_min_image_triclinic(v: Views) -> DataFrame:
    return r8(_step(v).select("frame", "id", *(c.alias(n) for n, c in zip("xyz", geometry.minimum_image(TRICLINIC, F.col("dx"), F.col("dy"), F.col("dz"))))))


def groups_of(v: Views, **definitions: str) -> selection.Groups:
    return selection.Groups(definitions, v.atoms, v.positions, ORTHORHOMBIC)


def _select(name: str, selector: str, where: str) -> None:
    def run(v: Views) -> DataFrame:
        return groups_of(v, g=selector).ids("g")

    run.__name__ = name
    query(_SEL + f" select id from wrapped where frame = 0 and {where}")(run)


_select("sel_all", "*", "true")
_select("sel_type", "type:1,3", "type in (1, 3)")
_select("sel_mol_range", "mol:7-3", "mol between 3 and 7")
_select("sel_id_list", "id:1,4-8,30", "(id in (1, 30) or id between 4 and 8)")
_select("sel_region_box", "region:box,12,3,0.5,3,0,2.5", "x between 3 and 12 and y between 0.5 and 3 and z between 0 and 2.5")
_select("sel_region_slab", "region:slab,y,1,2.2", "y between 1 and 2.2")
_select("sel_region_sphere", "region:sphere,25,5,4,1.5", "(x-5.0-round_even((x-5.0)/20.0,0)*20.0)**2 + (y-1.0-round_even((y-1.0)/4.0,0)*4.0)**2 + (z-1.0-round_even((z-1.0)/3.0,0)*3.0)**2 <= 2.25")
_select("sel_compound", "type:1;type:2;mol:1-6;region:slab,z,2,0.5", "type in (1, 2) and mol between 1 and 6 and z between 0.5 and 2")
_DEFS = {"a": "type:1", "b": "mol:1-5", "c": "id:1-40"}
_select("sel_empty_list", "type:", "false")


@query(_SEL + " select id from wrapped where frame = 0 and (type = 1 or (mol between 1 and 5 and id between 1 and 40))")
def sel_bool_expr(v: Views) -> DataFrame:
    return groups_of(v, **_DEFS, g="a | b & c").ids("g")


@query(_SEL + " select id from wrapped where frame = 0 and ((type = 1 or mol between 1 and 5) and id between 1 and 40)")
def sel_bool_parentheses(v: Views) -> DataFrame:
    return groups_of(v, **_DEFS, g="(a | b) & c").ids("g")


@query(_SEL + " select frame, id from wrapped where x between 1 and 8 and type = 2")
def sel_dynamic_members(v: Views) -> DataFrame:
    return groups_of(v, g="selection_mode:dynamic; type:2; region:slab,x,1,8").members("g")


_SIZES = ", sizes as (select f.frame, count(w.id) as n_selected from (select distinct frame from traj) f left join wrapped w on w.frame = f.frame and w.x between 1 and 8 and w.type = 2 group by f.frame)"


@query(_SEL + _SIZES + " select frame, n_selected from sizes")
def sel_dynamic_sizes(v: Views) -> DataFrame:
    return groups_of(v, g="selection_mode:dynamic; type:2; region:slab,x,1,8").sizes("g")


@query(_SEL + _SIZES + " select count(*) as samples, min(n_selected) as min, max(n_selected) as max, round(avg(n_selected), 8) as mean, round(coalesce(var_samp(n_selected), 0.0), 8) as variance from sizes")
def sel_size_audit(v: Views) -> DataFrame:
    return r8(stats.size_statistics(groups_of(v, g="selection_mode:dynamic; type:2; region:slab,x,1,8").sizes("g"), "n_selected"))


@query(_SEL + " select f.frame, count(w.id) as n_selected from (select distinct frame from traj) f left join wrapped w on w.frame = f.frame and w.id in (select id from wrapped where frame = 0 and x between 1 and 8) group by f.frame")
def selection_size_series(v: Views) -> DataFrame:
    return groups_of(v, g="region:slab,x,1,8").sizes("g")


def _combine(name: str, text: str, where: str) -> None:
    def run(v: Views) -> DataFrame:
        g = groups_of(v, a="type:1", t="mol:1-5")
        return selection.combined_ids(v.atoms, g.ids("a"), g.ids("t"), text)

    run.__name__ = name
    query(with_views("atoms") + f"select id from atoms where {where}")(run)


_combine("sel_combine_and", "", "type = 1 and mol between 1 and 5")
_combine("sel_combine_or", "a|T", "type = 1 or mol between 1 and 5")
_combine("sel_combine_not", "!(A & !T)", "not (type = 1 and not mol between 1 and 5)")


# --- topology, graphs ---------------------------------------------------------------------------------------------


def nodes_of(v: Views) -> DataFrame:
    return v.atoms.select(F.col("idx").alias("node"))


def topo_members(v: Views, definition: str, groups: selection.Groups | None = None) -> DataFrame:
    from .topology import topo_group

    held = topo_group(definition, nodes_of(v), v.edges, lambda name: groups.ids(name).join(v.atoms, "id").select(F.col("idx").alias("node")))
    return v.atoms.join(held.withColumnRenamed("node", "idx"), "idx", "left_semi").select("id")


def _topo(name: str, definition: str, sql: str, *views: str, **defs: str) -> None:
    def run(v: Views) -> DataFrame:
        return topo_members(v, definition, groups_of(v, **defs) if defs else None)

    run.__name__ = name
    query(with_views(*views) + sql)(run)


_topo("topo_any_bond", "atoms_in_any_bond", "select id from atoms where idx in (select u from sym)", "sym")
_topo("topo_bond_type", "atoms_in_bond_type {2,3}", "select id from atoms where idx in (select u from edges where type in (2,3) union select v from edges where type in (2,3))", "edges")
_topo("topo_component_size", "atoms_in_component_size>=6", "select id from atoms where idx in (select node from comp where root in (select root from comp group by root having count(*) >= 6))", "comp")
_topo("topo_incident", "atoms_incident_to_group(g)", "select id from atoms where idx in (select v from sym join atoms a on a.idx = u where a.type = 1)", "sym", g="type:1")
_topo("topo_degree", "atoms_degree_is:0", "select id from atoms join degree on node = idx where degree = 0", "degree")
_topo("topo_end", "atoms_is_end", "select id from atoms join degree on node = idx where degree = 1", "degree")
_topo("topo_all", "all", "select id from atoms", "atoms")


@query(with_views("labels") + "select node, component from labels")
def graph_components(v: Views) -> DataFrame:
    return graph.components(nodes_of(v), v.edges)


@query(with_views("labels") + "select node, component from labels")
def graph_components_rounds(v: Views) -> DataFrame:
    """By rounds of joins, as for graphs that no task holds."""
    return graph.components(nodes_of(v), v.edges, task_edges=0)


@query(with_views("labels") + "select size, count(*) as count from (select component, count(*) as size from labels group by component) group by size")
def graph_component_hist(v: Views) -> DataFrame:
    return graph.size_histogram(graph.components(nodes_of(v), v.edges))


@query(with_views("labels") + "select cast(count(*) as double) as m0, cast(sum(size) as double) as m1, cast(sum(size*size) as double) as m2, cast(sum(size*size*size) as double) as m3, round(sum(size*size)/sum(size), 8) as weight_average from (select component, count(*) as size from labels group by component)")
def graph_cluster_moments(v: Views) -> DataFrame:
    return r8(graph.cluster_moments(graph.components(nodes_of(v), v.edges)))


@query(with_views("degree") + "select degree, count(*) as count from degree group by degree")
def graph_degree_dist(v: Views) -> DataFrame:
    return graph.degree_distribution(nodes_of(v), v.edges)


@query(with_views("labels", "degree") + "select (select count(*) from atoms) as vertices, cast((select sum(degree) from degree)//2 as bigint) as edges, (select count(distinct component) from labels) as components, (select count(*) from degree where degree = 1) as ends, (select count(*) from degree where degree >= 3) as branches, cast((select sum(degree) from degree)//2 - (select count(*) from atoms) + (select count(distinct component) from labels) as bigint) as cycle_rank")
def graph_summary(v: Views) -> DataFrame:
    return graph.summary(nodes_of(v), v.edges)


def _bfs_sql(sources: str) -> str:
    return with_views("sym", "atoms") + f", walk as (select idx as node, 0 as hops from atoms where {sources} union select s.v, w.hops + 1 from walk w join sym s on s.u = w.node where w.hops < 12), best as (select node, min(hops) as hops from walk group by node) select a.idx as node, cast(coalesce(hops, -1) as bigint) as hops from atoms a left join best on node = a.idx"


@query(_bfs_sql("idx = 10"))
def graph_bfs_single(v: Views) -> DataFrame:
    return graph.distances(nodes_of(v), v.edges, v.atoms.filter("idx = 10").select(F.col("idx").alias("node")))


@query(_bfs_sql("idx % 7 = 0"))
def graph_bfs_multi(v: Views) -> DataFrame:
    return graph.distances(nodes_of(v), v.edges, v.atoms.filter("idx % 7 = 0").select(F.col("idx").alias("node")))


@query(_bfs_sql("idx % 7 = 0"))
def graph_bfs_rounds(v: Views) -> DataFrame:
    """By a join for each hop, as for graphs that no task holds."""
    return graph.distances(nodes_of(v), v.edges, v.atoms.filter("idx % 7 = 0").select(F.col("idx").alias("node")), task_edges=0)


@query(_bfs_sql("idx % 7 = 0").replace(" select a.idx as node", ", h as (select a.idx as node") + ") select hops, count(*) as count, cast(sum(type) as bigint) as sum, cast(sum(type*type) as bigint) as sumsq from h join atoms on idx = node where hops >= 0 group by hops")
def graph_distance_bins(v: Views) -> DataFrame:
    hops = graph.distances(nodes_of(v), v.edges, v.atoms.filter("idx % 7 = 0").select(F.col("idx").alias("node")))
    return r8(graph.distance_bins(hops, v.atoms.select(F.col("idx").alias("node"), F.col("type").cast("long").alias("value"))))


@query(with_views("labels", "traj") + ", f as (select component, x/20.0-floor(x/20.0) as a, y/4.0-floor(y/4.0) as b, z/3.0-floor(z/3.0) as c from labels join atoms on idx = node join traj t on t.id = atoms.id where frame = 0) select component, min(a) <= 0.2 and max(a) >= 0.8 as spans_x, min(b) <= 0.2 and max(b) >= 0.8 as spans_y, min(c) <= 0.2 and max(c) >= 0.8 as spans_z from f group by component")
def graph_spanning(v: Views) -> DataFrame:
    first = v.positions.filter("frame = 0").join(v.atoms, "id").select(F.col("idx").alias("node"), "x", "y", "z")
    return graph.spanning(graph.components(nodes_of(v), v.edges), first, ORTHORHOMBIC, 0.2)


@query(with_views("points") + "select a.node as u, b.node as v from points a join points b on a.node < b.node where (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.05*0.05")
def graph_contact(v: Views) -> DataFrame:
    return graph.contacts(v.points, 0.05)


@query(with_views("points") + "select a.node as u, b.node as v from points a join points b on a.node < b.node where (a.x-b.x-round_even(a.x-b.x,0))**2 + (a.y-b.y-round_even(a.y-b.y,0))**2 + (a.z-b.z-round_even(a.z-b.z,0))**2 <= 0.05*0.05")
def graph_contact_periodic(v: Views) -> DataFrame:
    return graph.contacts(v.points, 0.05, geometry.Box((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)))


@query(with_views("edges") + "select u, v from edges where type in (1, 2) and u in (select idx from atoms where type <> 3) and v in (select idx from atoms where type <> 3)")
def graph_bond_filter(v: Views) -> DataFrame:
    members = v.atoms.filter("type <> 3").select(F.col("idx").alias("node"))
    return graph.filter_bonds(v.edges, [1, 2], members).select("u", "v")


_POLYMER = ", poly as (select component, count(*) as size, cast(sum(degree)//2 as bigint) as edges, count(*) filter (where degree = 1) as ends, count(*) filter (where degree >= 3) as branches from labels join degree using (node) group by component), tagged as (select *, edges - size + 1 as cycle_rank, case when size <= 1 then 'other' when edges - size + 1 = 0 then case when branches = 0 and ends = 2 then 'linear' when branches > 0 then 'branched' else 'other' end when edges - size + 1 = 1 and ends = 0 and branches = 0 then 'ring' else 'network' end as tag from poly)"


@query(with_views("labels", "degree") + _POLYMER + " select component, size, edges, ends, branches, cycle_rank, tag from tagged")
def polymer_components(v: Views) -> DataFrame:
    return graph.polymer_components(nodes_of(v), v.edges)


@query(with_views("labels", "degree") + _POLYMER + ", seen as (select distinct tag from tagged where tag <> 'other') select case when count(*) = 0 then 'other' when count(*) = 1 then min(tag) else 'mixed' end as tag, coalesce(string_agg(tag, ',' order by tag), '') as tags from seen")
def polymer_tags(v: Views) -> DataFrame:
    return graph.polymer_tag(graph.polymer_components(nodes_of(v), v.edges))


@query(with_views("atoms") + "select mol as chain, row_number() over (partition by mol order by 9 - id % 10, idx) - 1 as position, idx as node from atoms")
def chain_from_pos(v: Views) -> DataFrame:
    return graph.chains_from_positions(v.chain_positions)


@query(with_views("labels", "degree") + _POLYMER + ", lin as (select component from tagged where cycle_rank = 0 and branches = 0 and (size = 1 or ends = 2)), st as (select component, min(node) as node from labels join degree using (node) where degree <= 1 and component in (select component from lin) group by component), walk as (select component, node, 0 as hops from st union select w.component, s.v, w.hops + 1 from walk w join sym s on s.u = w.node where w.hops < 12) select component + 1 as chain, cast(min(hops) as bigint) as position, node from walk group by component, node")
def chain_from_linear(v: Views) -> DataFrame:
    return graph.chains_from_linear(nodes_of(v), v.edges)


@query(with_views("atoms") + "select mol, count(*) as size, min(idx) as first from atoms group by mol")
def mol_index(v: Views) -> DataFrame:
    return v.atoms.groupBy("mol").agg(F.count("*").alias("size"), F.min("idx").alias("first"))


@query(with_views("labels") + "select node, component + 1 as mol from labels")
def mol_derived(v: Views) -> DataFrame:
    return graph.derived_molecules(nodes_of(v), v.edges)


# --- mapping ------------------------------------------------------------------------------------------------------


@query(with_views("atoms") + "select id, id as bead_id, row_number() over (order by id) - 1 as bead from atoms")
def map_identity(v: Views) -> DataFrame:
    return mapping.identity_map(v.atoms).select("id", "bead_id", "bead")


def _bead_sql(join: str, w: str, where: str = "") -> str:
    return f" select frame, bead_id, round(sum({w}*x)/sum({w}), 8) as x, round(sum({w}*y)/sum({w}), 8) as y, round(sum({w}*z)/sum({w}), 8) as z from traj t {join} {where} group by frame, bead_id"


@query(with_views("traj", "atoms") + _bead_sql("join (select id, mol as bead_id from atoms) m using (id)", "1.0"))
def map_by_mol_geom(v: Views) -> DataFrame:
    return r8(mapping.bead_positions(v.positions, mapping.molecule_map(v.atoms)))


@query(with_views("traj", "atoms", "masses") + _bead_sql("join (select id, mol as bead_id, mass from atoms join masses using (type)) m using (id)", "mass"))
def map_by_mol_mass(v: Views) -> DataFrame:
    return r8(mapping.bead_positions(v.positions, mapping.molecule_map(v.atoms), "com_mass", mapping.atom_masses(v.atoms, v.masses)))


@query(with_views("traj", "atoms") + "select frame, mol as bead_id, round(min_by(x, id), 8) as x, round(min_by(y, id), 8) as y, round(min_by(z, id), 8) as z from traj join atoms using (id) group by frame, mol")
def map_representative(v: Views) -> DataFrame:
    return r8(mapping.bead_positions(v.positions, mapping.molecule_map(v.atoms), "representative_atom"))


@query(with_views("traj", "mapfile") + _bead_sql("join mapfile m on m.atom_id = t.id", "weight"))
def map_file_weights(v: Views) -> DataFrame:
    return r8(mapping.bead_positions(v.positions, mapping.file_map(v.mapping, v.atoms)))


@query(with_views("mapfile", "masses") + "select bead_id, sum(mass) as mass from mapfile join atoms on id = atom_id join masses using (type) group by bead_id")
def map_bead_masses(v: Views) -> DataFrame:
    return r8(mapping.bead_masses(mapping.file_map(v.mapping, v.atoms), mapping.atom_masses(v.atoms, v.masses)))


@query(with_views("bonds", "mapfile") + "select distinct least(a.bead_id, b.bead_id) as u, greatest(a.bead_id, b.bead_id) as v from bonds join mapfile a on a.atom_id = ai join mapfile b on b.atom_id = aj where a.bead_id <> b.bead_id")
def bead_graph(v: Views) -> DataFrame:
    return mapping.bead_edges(v.bonds, mapping.file_map(v.mapping, v.atoms))


@query(with_views("mapfile") + "select id, case when bead_id is null then -1.0::double else cast(bead_id as double) * 0.5 end as value from atoms left join mapfile on atom_id = id")
def backmap_intensive(v: Views) -> DataFrame:
    m = mapping.file_map(v.mapping, v.atoms)
    return mapping.back_intensive(v.atoms, m, m.select("bead_id", (F.col("bead_id") * 0.5).alias("value")).distinct(), -1.0)


@query(with_views("mapfile") + "select id, round(case when bead_id is null then 0.0 else bead_id * 0.5 * weight / sum(weight) over (partition by bead_id) end, 8) as value from atoms left join mapfile on atom_id = id")
def backmap_extensive(v: Views) -> DataFrame:
    m = mapping.file_map(v.mapping, v.atoms)
    return r8(mapping.back_extensive(v.atoms, m, m.select("bead_id", (F.col("bead_id") * 0.5).alias("value")).distinct()))


# --- statistics ---------------------------------------------------------------------------------------------------


@query(with_views("samples") + ", b as (select case when value < 5 then -1 when value >= 60 then 11 else least(cast(floor((value-5)*(11/55.0)) as bigint), 10) end as bin from samples), r as (select unnest(range(-1, 12)) as bin) select r.bin as bin, cast(case when r.bin between 0 and 10 then 5 + (r.bin + 0.5) * 5.0 end as double) as center, cast(count(b.bin) as double) as weight from r left join b on b.bin = r.bin group by r.bin")
def hist1d(v: Views) -> DataFrame:
    return r8(stats.histogram(v.samples, "value", 5, 60, 11))


@query(with_views("samples") + ", b as (select case when value < 5 or usr < 10 then -1 when value >= 60 or usr >= 90 then -2 else least(cast(floor((value-5)*(11/55.0)) as bigint), 10) end as ix, case when value < 5 or usr < 10 then -1 when value >= 60 or usr >= 90 then -2 else least(cast(floor((usr-10)*(8/80.0)) as bigint), 7) end as iy from samples) select ix, iy, cast(count(*) as double) as weight from b group by ix, iy")
def hist2d(v: Views) -> DataFrame:
    return r8(stats.histogram_2d(v.samples, "value", "user", (5, 60, 11), (10, 90, 8)))


@query(with_views("samples") + "select case when value >= 1 and value < 600 then least(cast(floor(ln(value/1.0)*(12/ln(600.0))) as bigint), 11) else 12 end as bin, count(*) as count from samples group by 1")
def log_bins(v: Views) -> DataFrame:
    return v.samples.groupBy(stats.log_bin(F.col("value"), 1.0, 600.0, 12).alias("bin")).agg(F.count("*").alias("count"))


@query(with_views("samples") + "select usr as user, count(value) as n, round(avg(value), 6) as mean, round(var_pop(value), 6) as var_pop, round(coalesce(var_samp(value), 0.0), 6) as var_sample, round(stddev_pop(value), 6) as std_pop, round(coalesce(stddev_samp(value), 0.0), 6) as std_sample from samples group by usr")
def running_mean_var(v: Views) -> DataFrame:
    out = stats.mean_and_variance(v.samples, "value", ["user"], ["i"])
    return out.select("user", "n", *(F.round(c, 6).alias(c) for c in ("mean", "var_pop", "var_sample", "std_pop", "std_sample")))


@query(with_views("samples") + ", b as (select rn // 50 as block, avg(value) as mean from (select value, row_number() over (order by i) - 1 as rn from samples) group by 1 having count(*) = 50) select count(*) as n_blocks, round(avg(mean), 6) as mean, round(coalesce(var_samp(mean), 0.0), 6) as variance, round(case when count(*) > 1 then sqrt(var_samp(mean)/count(*)) else 0.0 end, 6) as sem from b")
def block_average(v: Views) -> DataFrame:
    out = stats.block_summary(stats.blocks(v.samples, "value", ["i"], 50))
    return out.select("n_blocks", *(F.round(c, 6).alias(c) for c in ("mean", "variance", "sem")))


# --- streams, run to the end of what is there -----------------------------------------------------------------------


@query(_multitau_sql(4, 3))
def stream_msd_multitau(v: Views) -> DataFrame:
    from ..streaming import follow

    spot = follow.scratch(v.spark, "stream")
    correlate.without_drift(v.positions).select("frame", "timestep", "id", "x", "y", "z").repartitionByRange(4, "frame").write.parquet(f"{spot}/in")
    s = spec(kind="multitau", channels=4, levels=3)
    return series(follow.stream_correlation(follow.follow_folder(v.spark, f"{spot}/in"), s, f"{spot}/pairs", f"{spot}/state"))


@query(with_views("traj") + "select frame, count(*) filter (where x > 20) as n_selected from traj group by frame")
def stream_selection_size(v: Views) -> DataFrame:
    from ..streaming import follow

    spot = follow.scratch(v.spark, "stream")
    v.positions.select("frame", "timestep", "id", "x", "y", "z").repartitionByRange(3, "frame").write.parquet(f"{spot}/in")
    return follow.stream_sizes(follow.follow_folder(v.spark, f"{spot}/in"), F.col("x") > 20, f"{spot}/sizes", f"{spot}/state")


# --- files, runs and the extension surface: registered where they are defined ---------------------------------------

from . import file_queries  # noqa: E402, F401
