"""Queries on backbone geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import residues as R
from ..operators import backbone as B
from ..operators.statistics import merge_multisets, multisets, quantiles
from . import sql_geometry as S
from . import views as V
from .registration import Registry

REGISTRY = Registry()
query = REGISTRY.query
MAX_BOND = 4.0
# Atoms that the view lacks, by their offset from one that it has.
MORE = {"O": ("C", 1.0, 0.5, -0.25), "H": ("N", 0.6, 0.8, 0.0), "HA": ("CA", 0.0, 0.9, 0.6)}

_TRACE = "tr as (select *, " + ", ".join(f"lead({c}, {i}) over w as {c}{i}" for i in (1, 2, 3) for c in "xyz") + """, lead(res_seq) over w as next_res, lag(x) over w as bx, lag(y) over w as "by", lag(z) over w as bz
 from atoms window w as (partition by structure_id, chain_id order by res_seq, serial))"""
_P = [("x", "y", "z"), *[(f"x{i}", f"y{i}", f"z{i}") for i in (1, 2, 3)]]
_BONDS = f"bonds as (select structure_id, chain_id, res_seq, res_name, case name when 'N' then 'N_CA' when 'CA' then 'CA_C' else 'C_N' end as bond, {S.distance(_P[0], _P[1])} as length from tr where x1 is not null)"
_FULL = "fa as (select structure_id, chain_id, res_seq, res_name, name, x, y, z from atoms " + " ".join(
    f"union all select structure_id, chain_id, res_seq, res_name, '{n}', x + {dx}, y + {dy}, z + {dz} from atoms where name = '{of}'" for n, (of, dx, dy, dz) in MORE.items()) + ")"
_ONE = "case res_name " + " ".join(f"when '{k}' then '{v}'" for k, v in R.THREE_TO_ONE.items()) + " else 'X' end"
_RES = f"re as (select structure_id, chain_id, res_seq, min({_ONE}) as aa, min(res_name) as res_name, " + ", ".join(f"max({c}) filter (where name = '{n}') as {n.lower()}_{c}" for n in ("N", "CA", "C", "O", "H", "HA") for c in "xyz") + " from fa group by all)"
_NEI = "ne as (select *, lag(aa) over w as before, lead(aa) over w as after, " + ", ".join(f"lag(c_{c}) over w as pc_{c}, lead(n_{c}) over w as nn_{c}" for c in "xyz") + " from re window w as (partition by structure_id, chain_id order by res_seq))"
_q = {n: S.p(f"{n}_") for n in ("pc", "n", "ca", "c", "o", "nn", "h", "ha")}


def _bend(a, b, c):
    return f"((3.141592653589793 - {S.angle(_q[a], _q[b], _q[c])}) / 2)"


_GEO = f"""ge as (select structure_id, chain_id, res_seq, aa, before, after, {S.dihedral(_q['pc'], _q['n'], _q['ca'], _q['c'])} as phi, {S.dihedral(_q['n'], _q['ca'], _q['c'], _q['nn'])} as psi,
 {_bend('pc', 'n', 'ca')} as cm1_n_ca, {_bend('n', 'ca', 'c')} as n_ca_c, {_bend('ca', 'c', 'nn')} as ca_c_np1, {S.angle(_q['ca'], _q['c'], _q['o'])} / 2 as ca_c_o,
 {S.distance(_q['n'], _q['ca'])} as n_ca, {S.distance(_q['ca'], _q['c'])} as ca_c, {S.distance(_q['c'], _q['nn'])} as c_np1, {S.distance(_q['c'], _q['o'])} as c_o from ne where pc_x is not null and nn_x is not null)"""
_LONG = f"lg as (select before || aa || after as trimer, aa, before || after as pair, {S.bin10('phi')} as phi_bin, {S.bin10('psi')} as psi_bin, kind, value from ge unpivot (value for kind in (cm1_n_ca, n_ca_c, ca_c_np1, ca_c_o)))"
_ALL = V.with_views("atoms", more=", ".join([_FULL, _RES, _NEI, _GEO]))
_ALL_LONG = V.with_views("atoms", more=", ".join([_FULL, _RES, _NEI, _GEO, _LONG.replace("from ge unpivot", "from (select before, aa, after, phi, psi, cm1_n_ca, n_ca_c, ca_c_np1, ca_c_o from ge) unpivot")]))


def full_atoms(spark, d):
    a = V.atoms(spark, d).select("structure_id", "chain_id", "res_seq", "res_name", "name", "x", "y", "z")
    out = a
    for name, (of, dx, dy, dz) in MORE.items():
        out = out.unionByName(a.filter(F.col("name") == of).withColumns({"name": F.lit(name), "x": F.col("x") + dx, "y": F.col("y") + dy, "z": F.col("z") + dz}))
    return out


@query("bond_lengths", V.with_views("atoms", more=f"{_TRACE}, {_BONDS}") + f"select structure_id, chain_id, res_seq, res_name, bond, {S.r('length')} as length from bonds")
def bond_lengths(spark, d):
    return B.bond_lengths(V.atoms(spark, d)).withColumn("length", G.rounded(F.col("length")))


_TORS = f"""tf as (select *, max({S.distance(_P[0], _P[1])}) over (partition by structure_id, chain_id) as far from tr),
to_ as (select structure_id, chain_id, case name when 'C' then next_res else res_seq end as res_seq, case name when 'N' then 'psi' when 'CA' then 'omega' else 'phi' end as kind, {S.r('degrees(' + S.dihedral(*_P) + ')')} as deg
 from tf where far <= {MAX_BOND} and x3 is not null),
tors as (select structure_id, chain_id, res_seq, kind, case when deg = -180 then 180.0 else deg end as degrees from to_)"""


@query("backbone_torsions", V.with_views("atoms", more=f"{_TRACE}, {_TORS}") + "select * from tors")
def backbone_torsions(spark, d):
    return B.torsions(V.atoms(spark, d), MAX_BOND)


@query("chain_breaks", V.with_views("atoms", more=f"""{_TRACE}, br as (select *, case when coalesce({S.distance(_P[0], ('bx', '"by"', 'bz'))}, 0) > 2.1 then 1 else 0 end as broken from tr),
pi as (select *, sum(broken) over (partition by structure_id, chain_id order by res_seq, serial) as piece, max(broken) over (partition by structure_id, chain_id) as anyb from br),
nu as (select *, row_number() over (partition by structure_id, chain_id, piece order by res_seq, serial) - 1 as k, {_ONE} as aa from pi where anyb = 1)""") +
       "select structure_id, chain_id, piece::int as piece, count(*) as n_atoms, min(res_seq) as first, max(res_seq) as last, string_agg(aa, '' order by res_seq, serial) filter (where k % 3 = 0) as sequence from nu group by structure_id, chain_id, piece")
def chain_breaks(spark, d):
    return B.chain_breaks(V.atoms(spark, d))


@query("bond_geometry", _ALL + "select structure_id, res_seq, aa, " + ", ".join(f"{S.r(k)} as {k}" for k in ["phi", "psi", *B.ANGLES, *B.LENGTHS]) + " from ge")
def bond_geometry(spark, d):
    return B.bond_geometry(full_atoms(spark, d)).select("structure_id", "res_seq", "aa", *[G.rounded(F.col(k)).alias(k) for k in ["phi", "psi", *B.ANGLES, *B.LENGTHS]])


@query("bin10", _ALL + f"select structure_id, res_seq, {S.bin10('phi')} as phi_bin, {S.bin10('psi')} as psi_bin from ge")
def bin10(spark, d):
    return B.bond_geometry(full_atoms(spark, d)).select("structure_id", "res_seq", G.bin10(F.col("phi")).alias("phi_bin"), G.bin10(F.col("psi")).alias("psi_bin"))


@query("bend_encode", _ALL + "select aa, count(*) as n, round(avg(n_ca_c), 4) as bend, round(avg(3.141592653589793 - 2 * n_ca_c), 4) as radians from ge group by aa")
def bend_encode(spark, d):
    g = B.bond_geometry(full_atoms(spark, d))
    return g.groupBy("aa").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_ca_c"), 4).alias("bend"), F.round(F.avg(3.141592653589793 - 2 * F.col("n_ca_c")), 4).alias("radians"))


@query("jcoupling_torsions", V.with_views("atoms", more=", ".join([_FULL, _RES])) + f"select structure_id, chain_id, res_seq, case when res_name <> 'PRO' then {S.r('degrees(' + S.dihedral(_q['h'], _q['n'], _q['ca'], _q['ha']) + ')')} end as degrees from re")
def jcoupling_torsions(spark, d):
    return B.coupling_torsions(full_atoms(spark, d))


def _long(spark, d):
    return B.long_geometry(B.bond_geometry(full_atoms(spark, d)), B.ANGLES)


@query("trimer_library", _ALL_LONG + "select trimer, phi_bin, psi_bin, kind, count(*) as n, list_sort(list(round(value, 4))) as vals from lg group by all")
def trimer_library(spark, d):
    return _long(spark, d).groupBy("trimer", "phi_bin", "psi_bin", "kind").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.round("value", 4))).alias("vals"))


@query("trimer_library_chunks", _ALL_LONG + ", c as (select trimer, phi_bin, psi_bin, kind, round(value * 10000)::bigint as s, count(*) as n from lg group by all)" +
       " select trimer, phi_bin, psi_bin, kind, floor(s / 1024)::bigint as chunk, sum(n)::bigint as n, list(s / 10000 order by s) as vals, list(n order by s) as times from c group by trimer, phi_bin, psi_bin, kind, floor(s / 1024)")
def trimer_library_chunks(spark, d):
    """The library's values as counted ones, in chunks of bounded length; made of two halves of the structures, merged."""
    keys, every = ["trimer", "phi_bin", "psi_bin", "kind"], full_atoms(spark, d)
    halves = [multisets(B.long_geometry(B.bond_geometry(every.filter(F.col("structure_id") % 2 == i)), B.ANGLES), keys, "value") for i in (0, 1)]
    m = merge_multisets(*halves, keys)
    return m.select(*keys, "chunk", "n", F.transform("entries", lambda e: e["value"]).alias("vals"), F.transform("entries", lambda e: e["n"]).alias("times"))


@query("library_regroup", _ALL_LONG + "select kind, aa, pair, phi_bin, psi_bin, count(*) as n, round(sum(value), 4) as total from lg group by all")
def library_regroup(spark, d):
    return _long(spark, d).groupBy("kind", "aa", "pair", "phi_bin", "psi_bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("library_reduce", _ALL_LONG + "select kind, aa, pair, count(*) as n, round(avg(value), 4) as mean from lg group by grouping sets ((kind, aa, pair), (kind, aa))")
def library_reduce(spark, d):
    k, a, p = F.col("kind"), F.col("aa"), F.col("pair")
    return _long(spark, d).groupingSets([[k, a, p], [k, a]], k, a, p).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("bend_means", _ALL_LONG + "select trimer, kind, round(avg(value), 4) as mean from lg group by all")
def bend_means(spark, d):
    return _long(spark, d).groupBy("trimer", "kind").agg(F.round(F.avg("value"), 4).alias("mean"))


@query("bond_length_stats", V.with_views("atoms", more=f"{_TRACE}, {_BONDS}") + """select bond, res_seq::varchar as res_seq, res_name, count(*) as n, round(avg(length), 4) as mean, round(stddev_pop(length), 4) as std, round(median(length), 4) as median, round(var_pop(length), 4) as var
 from bonds group by grouping sets ((bond, res_seq), (bond), (bond, res_name))""")
def bond_length_stats(spark, d):
    b, s, n, x = F.col("bond"), F.col("res_seq"), F.col("res_name"), F.col("length")
    lengths = B.bond_lengths(V.atoms(spark, d))
    stats = [F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_pop(x), 4).alias("std"), F.round(F.var_pop(x), 4).alias("var")]
    out = lengths.groupingSets([[b, s], [b], [b, n]], b, s, n).agg(*stats)
    none = lengths.withColumns({"res_seq": F.lit(None).cast("int"), "res_name": F.lit(None).cast("string")})
    sets = [lengths.withColumn("res_name", F.lit(None).cast("string")), none, lengths.withColumn("res_seq", F.lit(None).cast("int"))]
    medians = reduce(DataFrame.unionByName, [quantiles(x, ["bond", "res_seq", "res_name"], "length", {"median": 0.5}) for x in sets])
    medians = medians.select(F.col("bond").alias("_b"), F.col("res_seq").alias("_s"), F.col("res_name").alias("_n"), F.round("median", 4).alias("median"))
    out = out.join(medians, (b == F.col("_b")) & s.eqNullSafe(F.col("_s")) & n.eqNullSafe(F.col("_n")))
    return out.select("bond", s.cast("string").alias("res_seq"), "res_name", "n", "mean", "std", "median", "var")


@query("geometry_by_residue", _ALL + "select aa, kind, count(*) as n, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std from (select aa, kind, value from (select aa, cm1_n_ca, n_ca_c, ca_c_np1, ca_c_o, n_ca, ca_c, c_np1, c_o from ge) unpivot (value for kind in (cm1_n_ca, n_ca_c, ca_c_np1, ca_c_o, n_ca, ca_c, c_np1, c_o))) group by all")
def geometry_by_residue(spark, d):
    g = B.long_geometry(B.bond_geometry(full_atoms(spark, d)), B.ANGLES + B.LENGTHS)
    return g.groupBy("aa", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"))


@query("ss_fraction", V.with_views("ss") + "select pos, ss, round(count(*) / (select count(distinct user_id) from ss), 6) as fraction from ss group by pos, ss")
def ss_fraction(spark, d):
    s = V.ss(spark, d)
    n = s.select("user_id").distinct().count()
    return s.groupBy("pos", "ss").agg(F.round(F.count(F.lit(1)) / F.lit(n), 6).alias("fraction"))


_ANG = f"an as (select structure_id, res_seq, max(degrees) filter (where kind = 'phi') as phi, max(degrees) filter (where kind = 'psi') as psi from tors group by all)"


def _angles(spark, d):
    t = backbone_torsions(spark, d)
    return t.groupBy("structure_id", "res_seq").agg(*[F.max(F.when(F.col("kind") == k, F.col("degrees"))).alias(k) for k in ("phi", "psi")])


@query("rama_fraction", V.with_views("atoms", more=f"{_TRACE}, {_TORS}, {_ANG}") + """select res_seq, region, round(count(*) / any_value(total), 6) as fraction from (select res_seq, count(*) over (partition by res_seq) as total,
 case when phi > -180 and phi < 10 and psi > -120 and psi < 45 then 'alpha' when phi > -180 and phi < 0 and ((psi > -180 and psi < -120) or (psi > 45 and psi < 180)) then 'beta' else 'other' end as region from an where phi is not null and psi is not null) group by res_seq, region""")
def rama_fraction(spark, d):
    a = _angles(spark, d).filter(F.col("phi").isNotNull() & F.col("psi").isNotNull()).withColumn("region", B.region(F.col("phi"), F.col("psi")))
    total = a.groupBy("res_seq").agg(F.count(F.lit(1)).alias("total"))
    return a.groupBy("res_seq", "region").count().join(total, "res_seq").select("res_seq", "region", F.round(F.col("count") / F.col("total"), 6).alias("fraction"))


@query("rama_fraction_legacy", V.with_views("atoms", more=f"{_TRACE}, {_TORS}, n_ as (select *, row_number() over (partition by structure_id, kind order by res_seq) as i from tors where kind <> 'omega')") +
       """select res_seq, region, count(*) as n from (select p.res_seq, case when f.degrees > -180 and f.degrees < 10 and p.degrees > -120 and p.degrees < 45 then 'alpha'
 when f.degrees > -180 and f.degrees < 0 and ((p.degrees > -180 and p.degrees < -120) or (p.degrees > 45 and p.degrees < 180)) then 'beta' else 'other' end as region
 from n_ p join n_ f on p.structure_id = f.structure_id and p.i = f.i and p.kind = 'psi' and f.kind = 'phi') group by res_seq, region""")
def rama_fraction_legacy(spark, d):
    """Regions of angles that are paired by their places in the lists."""
    a = B.angle_pairs(backbone_torsions(spark, d), legacy_index=True).withColumn("region", B.region(F.col("phi"), F.col("psi")))
    return a.groupBy("res_seq", "region").agg(F.count(F.lit(1)).alias("n"))


@query("ppii_assign", V.with_views("atoms", "ss", more=f"{_TRACE}, {_TORS}, {_ANG}, j as (select structure_id, pos, ss, phi, psi, row_number() over (partition by structure_id order by pos) as rn from ss join an on user_id = structure_id and pos = res_seq)," +
       """f as (select *, coalesce(ss = ' ' and phi between -104 and -46 and psi between 116 and 174 and rn > 1, false) as fits from j),
 g as (select *, lag(fits) over w and lag(pos) over w = pos - 1 as a, lead(fits) over w and lead(pos) over w = pos + 1 as b from f window w as (partition by structure_id order by pos))""") +
       "select structure_id, pos, case when fits and (coalesce(a, false) or coalesce(b, false)) then 'P' else ss end as ss_new from g")
def ppii_assign(spark, d):
    j = V.ss(spark, d).join(_angles(spark, d), (F.col("user_id") == F.col("structure_id")) & (F.col("pos") == F.col("res_seq")))
    return B.polyproline(j, ["structure_id"], "pos").select("structure_id", "pos", "ss_new")


@query("bond_report", V.with_views("atoms", more=f"{_TRACE}, {_BONDS}, ex as (select *, case bond when 'N_CA' then 1.46 when 'CA_C' then 1.525 else 1.33 end as expected from bonds), off_ as (select * from ex where abs(length - expected) > 0.01 + 1e-5 * expected)") +
       "select a.structure_id, count(o.bond) as n_off, list_sort(coalesce(list(o.res_seq::varchar || ':' || o.res_name || ':' || o.bond) filter (where o.bond is not null), [])) as details from (select distinct structure_id from atoms) a left join off_ o using (structure_id) group by a.structure_id")
def bond_report(spark, d):
    off = B.off_bonds(B.bond_lengths(V.atoms(spark, d))).withColumn("d", F.concat_ws(":", F.col("res_seq").cast("string"), "res_name", "bond"))
    off = off.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("d")).alias("d"))
    every = V.atoms(spark, d).select("structure_id").distinct()
    return every.join(off, "structure_id", "left").select("structure_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_off"), F.coalesce("d", F.array().cast("array<string>")).alias("details"))


@query("distribution_summary", V.with_views("atoms", more=f"{_TRACE}, {_BONDS}") + "select bond, round(min(length), 4) as low, round(quantile_cont(length, 0.25), 4) as q1, round(median(length), 4) as mid, round(quantile_cont(length, 0.75), 4) as q3, round(max(length), 4) as high from bonds group by bond")
def distribution_summary(spark, d):
    names = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q3": 0.75, "high": 1.0}
    s = quantiles(B.bond_lengths(V.atoms(spark, d)), ["bond"], "length", names)
    return s.select("bond", *[F.round(n, 4).alias(n) for n in names])
