"""Queries on pairs of atoms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import residues as R
from ..operators import backbone, pairs
from . import sql_geometry as S
from . import views as V
from .registration import Registry

REGISTRY = Registry()
query = REGISTRY.query
A, B = S.p("a."), S.p("b.")
_RAD = "ra as (select *, case element when 'C' then 1.7 when 'N' then 1.625 else 0 end as radius from atoms)"
_PAIR = f"pa as (select a.structure_id, a.serial as i, b.serial as j, a.res_seq as ra_, b.res_seq as rb_, a.name as na, b.name as nb, a.radius as rada, b.radius as radb, {S.distance(A, B)} as dist from ra a join ra b on a.structure_id = b.structure_id and a.serial < b.serial)"
# Force-field values by atom name: sigma (nm), epsilon, charge.
FIELD = {"N": (0.325, 0.71128, -0.4157), "CA": (0.339967, 0.457730, 0.0337), "C": (0.339967, 0.359824, 0.5973)}
# Bonds between atom names, by residue distance.
CHAIN_BONDS = [("N", "CA", 0), ("CA", "C", 0), ("C", "N", 1)]


def _radii(spark, d):
    return pairs.with_radius(V.atoms(spark, d), R.radii_table(spark))


@query("pair_distances", V.with_views("atoms", more=f"{_RAD}, {_PAIR}") + f"select structure_id, i, j, {S.r('dist')} as dist, {S.r('dist * dist', 3)} as square from pa")
def pair_distances(spark, d):
    p = pairs.all_pairs(V.atoms(spark, d), [])
    return p.select("structure_id", F.col("a.serial").alias("i"), F.col("b.serial").alias("j"), G.rounded(F.col("dist")).alias("dist"), G.rounded(F.col("dist") * F.col("dist"), 3).alias("square"))


@query("pair_combine", V.with_views("atoms", more=f"{_RAD}, {_PAIR}") + "select structure_id, i, j, round(rada + radb, 4) as total, round(rada * radb, 4) as product from pa")
def pair_combine(spark, d):
    p = pairs.all_pairs(_radii(spark, d), ["radius"])
    return p.select("structure_id", F.col("a.serial").alias("i"), F.col("b.serial").alias("j"), F.round(F.col("a.radius") + F.col("b.radius"), 4).alias("total"), F.round(F.col("a.radius") * F.col("b.radius"), 4).alias("product"))


_CLASH = f"cl as (select a.structure_id, a.serial as i, b.serial as j, a.res_seq as ra_, b.res_seq as rb_, a.name as na, b.name as nb, {S.distance(A, B)} as dist, a.radius + b.radius - {S.distance(A, B)} as overlap from ra a join ra b on a.structure_id = b.structure_id and a.res_seq - b.res_seq >= 2 where a.radius + b.radius - {S.distance(A, B)} >= 0)"


@query("clash_within", V.with_views("atoms", more=f"{_RAD}, {_CLASH}") + f"select structure_id, i, j, {S.r('dist')} as dist, {S.r('overlap')} as overlap from cl")
def clash_within(spark, d):
    c = pairs.clashes_within(_radii(spark, d), widest=1.7)
    return c.select("structure_id", F.col("a.serial").alias("i"), F.col("b.serial").alias("j"), G.rounded(F.col("dist")).alias("dist"), G.rounded(F.col("overlap")).alias("overlap"))


@query("clash_report", V.with_views("atoms", more=f"{_RAD}, {_CLASH.replace('>= 2 where', '>= 3 where')}") + """select s.structure_id, count(i) as n, list_sort(coalesce(list(ra_::varchar || ':' || na || '-' || rb_::varchar || ':' || nb) filter (where i is not null), [])) as details
 from (select distinct structure_id from atoms) s left join cl using (structure_id) group by s.structure_id""")
def clash_report(spark, d):
    a = _radii(spark, d)
    label = F.concat(F.col("a.res_seq").cast("string"), F.lit(":"), F.col("a.name"), F.lit("-"), F.col("b.res_seq").cast("string"), F.lit(":"), F.col("b.name"))
    c = pairs.clashes_within(a, apart=3, widest=1.7).groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(label)).alias("d"))
    return a.select("structure_id").distinct().join(c, "structure_id", "left").select("structure_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("d", F.array().cast("array<string>")).alias("details"))


@query("sort_report", REGISTRY.sql["clash_report"] + " order by s.structure_id")
def sort_report(spark, d):
    return clash_report(spark, d).orderBy("structure_id")


# A structure is checked against the one with the next id.
_BETWEEN = f"select a.structure_id, count(*) as n from ra a join ra b on b.structure_id = a.structure_id + 1 where a.res_seq >= 4 and {S.distance(A, B)} < a.radius + b.radius + 0.4 group by a.structure_id"


@query("clash_between", V.with_views("atoms", more=_RAD) + f"select structure_id, n, n <= 40 as accepted from ({_BETWEEN})")
def clash_between(spark, d):
    a = _radii(spark, d)
    parents = a.withColumn("structure_id", F.col("structure_id") - 1)
    fragments = pairs.trim_tails(a, ["structure_id"], front=True, back=False)
    return pairs.clashes_between(fragments, parents, ["structure_id"], widest=1.7).withColumn("accepted", F.col("n") <= 40)


@query("clash_backbone_kd", V.with_views("atoms", more="""ra as (select *, case name when 'N' then 1.55 when 'CA' then 1.7 else 1.7 end as radius, max(res_seq) over (partition by structure_id) as hi from atoms)""") +
       f"select a.structure_id, count(*) as n from ra a join ra b on b.structure_id = a.structure_id + 1 where b.res_seq <= b.hi - 2 and {S.distance(A, B)} < a.radius + b.radius group by a.structure_id")
def clash_backbone_kd(spark, d):
    a = pairs.with_radius(V.atoms(spark, d), R.radii_table(spark, "bondi1964"))
    older = pairs.trim_tails(a.withColumn("structure_id", F.col("structure_id") - 1), ["structure_id"], front=False, back=True, residues=2)
    return pairs.clashes_between(a, older, ["structure_id"], tolerance=0.0, widest=1.7)


def separations(spark):
    """(name_a, name_b, step, sep) of a backbone chain: the graph of three residues, up to three bonds."""
    bonds = [(f"{a}{r}", f"{b}{r + s}") for r in range(3) for a, b, s in CHAIN_BONDS if r + s < 3]
    g = pairs.bond_separation(spark.createDataFrame(bonds, "a string, b string"))
    name, res = (lambda c: F.regexp_extract(c, "[A-Z]+", 0)), (lambda c: F.regexp_extract(c, "[0-9]+", 0).cast("int"))
    rows = g.select(name("a").alias("name_a"), name("b").alias("name_b"), (res("b") - res("a")).alias("step"), "sep").filter("step between 0 and 1")
    return rows.groupBy("name_a", "name_b", "step").agg(F.min("sep").alias("sep"))


def structure_separations(atoms):
    """(structure_id, name_a, name_b, step, sep) of all atoms up to three bonds apart, along the backbone of each structure."""
    node = F.struct("serial", "res_seq", "name")
    bonds = atoms.select("structure_id", node.alias("a"), F.lead(node).over(Window.partitionBy("structure_id").orderBy("serial")).alias("b")).filter("b is not null")
    g = pairs.bond_separation(bonds, keys=["structure_id"])
    return g.select("structure_id", F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"), (F.col("b.res_seq") - F.col("a.res_seq")).alias("step"), "sep")


_GRAPH = """gb as (select * from (values """ + ", ".join(f"('{a}', '{b}', {s})" for a, b, s in CHAIN_BONDS) + """) as t(a, b, s)),
no as (select r, n, row_number() over (order by r, o) as k from (select unnest([0, 1, 2]) as r), (values ('N', 0), ('CA', 1), ('C', 2)) as t(n, o)),
se as (select distinct x.n as name_a, y.n as name_b, y.r - x.r as step, abs(y.k - x.k) as sep from no x, no y where x.k <> y.k and abs(y.k - x.k) <= 3 and y.r - x.r between 0 and 1)"""


@query("expand_bonds", V.with_views("atoms") + """select a.name as name_a, b.name as name_b, (b.res_seq - a.res_seq)::int as step, min(abs(b.serial - a.serial))::int as sep from atoms a join atoms b on a.structure_id = b.structure_id
 and a.serial <> b.serial and abs(b.serial - a.serial) <= 3 and b.res_seq - a.res_seq between 0 and 1 group by all""")
def expand_bonds(spark, d):
    g = structure_separations(V.atoms(spark, d)).filter("step between 0 and 1")
    return g.groupBy("name_a", "name_b", "step").agg(F.min("sep").alias("sep"))


_STATE = f"{_RAD}, {_PAIR}, {_GRAPH}, st as (select pa.*, case when sep <= 2 then 'excluded' when sep = 3 then 'scaled' else 'free' end as state from pa left join (select name_a, name_b, step, min(sep) as sep from se group by all) on name_a = na and name_b = nb and step = rb_ - ra_)"


def _classified(spark, d, atoms, columns):
    return pairs.classify_bonded(pairs.all_pairs(atoms, columns), separations(spark))


@query("exclude_bonded", V.with_views("atoms", more=_STATE) + "select structure_id, i, j, state from st")
def exclude_bonded(spark, d):
    return _classified(spark, d, V.atoms(spark, d), ["res_seq", "name"]).select("structure_id", F.col("a.serial").alias("i"), F.col("b.serial").alias("j"), "state")


def field(spark):
    return spark.createDataFrame([(k, *v) for k, v in FIELD.items()], "name string, sigma double, epsilon double, charge double")


_FIELD = "ff as (select * from (values " + ", ".join(f"('{k}', {s}::double, {e}::double, {c}::double)" for k, (s, e, c) in FIELD.items()) + ") as t(name, sigma, epsilon, charge))"


@query("ff_lookup", V.with_views("atoms", more=_FIELD) + "select structure_id, serial, case when res_seq = 1 then 'N' || res_name when res_seq = 7 then 'C' || res_name else res_name end as kind, sigma, epsilon, charge from atoms join ff using (name)")
def ff_lookup(spark, d):
    kind = F.when(F.col("res_seq") == 1, F.concat(F.lit("N"), "res_name")).when(F.col("res_seq") == 7, F.concat(F.lit("C"), "res_name")).otherwise(F.col("res_name"))
    return V.atoms(spark, d).join(F.broadcast(field(spark)), "name").select("structure_id", "serial", kind.alias("kind"), "sigma", "epsilon", "charge")


_ENERGY = _STATE + f""", {_FIELD}, en as (select st.*, 4 * sqrt(fa.epsilon * fb.epsilon) * pow(5 * (fa.sigma + fb.sigma) / dist, 6) * (pow(5 * (fa.sigma + fb.sigma) / dist, 6) - 1) as lj0, 0.25 * fa.charge * fb.charge / dist as co0
 from st join ff fa on fa.name = na join ff fb on fb.name = nb where dist > 0.5),
et as (select structure_id, sum(case state when 'free' then lj0 when 'scaled' then lj0 * 0.1 end) as lj, sum(case state when 'free' then co0 when 'scaled' then co0 * 0.8333333 end) as co from en group by structure_id)"""


def _energies(spark, d):
    a = V.atoms(spark, d).join(F.broadcast(field(spark)), "name")
    e = pairs.pair_energy(_classified(spark, d, a, ["res_seq", "name", "sigma", "epsilon", "charge"]).filter("dist > 0.5"))
    return e.groupBy("structure_id").agg(F.sum("lj").alias("lj"), F.sum("coulomb").alias("co"))


_LOG = "sign({0}) * round(ln(1 + abs({0})), 5) + 0.0"


@query("pair_energy", V.with_views("atoms", more=_ENERGY) + f"select structure_id, {_LOG.format('lj')} as log_lj, round(co, 5) + 0.0 as coulomb from et")
def pair_energy(spark, d):
    return _energies(spark, d).select("structure_id", (F.signum("lj") * F.round(F.log(1 + F.abs("lj")), 5) + 0.0).alias("log_lj"), (F.round("co", 5) + 0.0).alias("coulomb"))


@query("energy_filter", V.with_views("atoms", more=_ENERGY) + "select structure_id from et where lj + co <= 1e9")
def energy_filter(spark, d):
    return _energies(spark, d).filter(F.col("lj") + F.col("co") <= 1e9).select("structure_id")


_RESIDUE = "re as (select structure_id as id, res_seq, " + ", ".join(f"max({c}) filter (where name = '{n}') as {n.lower()}_{c}" for n in ("N", "CA", "C") for c in "xyz") + " from atoms group by all)"


@query("closure_join", V.with_views("atoms", more=_RESIDUE) + f"""select a.id as left_id, b.id as right_id, a.res_seq from re a join re b on a.res_seq = b.res_seq
 where {S.distance(S.p('a.c_'), S.p('b.n_'))} between 1.0 and 1.8 and {S.angle(S.p('a.ca_'), S.p('a.c_'), S.p('b.n_'))} between 1.2 and 2.4 and {S.distance(S.p('a.c_'), S.p('b.ca_'))} between 1.5 and 3.0 and abs({S.dihedral(S.p('a.ca_'), S.p('a.c_'), S.p('b.n_'), S.p('b.ca_'))}) >= 1.5""")
def closure_join(spark, d):
    r = backbone.residues(V.atoms(spark, d), ["N", "CA", "C"]).withColumnRenamed("structure_id", "id")
    return pairs.closures(r, r, bond=(1.0, 1.8), ca_c_n=(1.2, 2.4), reach=(1.5, 3.0), omega=1.5)


_CLOSED = f"""fo as (select a.id as left_id, b.id as right_id, a.res_seq from re a join re b on a.res_seq = b.res_seq
 where {S.distance(S.p('a.c_'), S.p('b.n_'))} between 1.32 and 1.56 and {S.angle(S.p('a.ca_'), S.p('a.c_'), S.p('b.n_'))} between 1.91 and 2.15 and {S.distance(S.p('a.c_'), S.p('b.ca_'))} between 2.2 and 2.7 and abs({S.dihedral(S.p('a.ca_'), S.p('a.c_'), S.p('b.n_'), S.p('b.ca_'))}) >= 2.61)"""


_BAD = f"""bad as (select left_id, right_id, fo.res_seq as place from fo join ra a on a.structure_id = left_id and a.res_seq <= fo.res_seq join ra b on b.structure_id = right_id and b.res_seq > fo.res_seq
 where {S.distance(A, B)} < a.radius + b.radius + 0.4 group by all having count(*) > 12)"""


@query("closure_clashes", V.with_views("atoms", more=f"{_RESIDUE}, {_RAD}, {_CLOSED}, {_BAD}") + "select left_id, right_id, res_seq from fo where (left_id, right_id, res_seq) not in (select left_id, right_id, place from bad)")
def closure_clashes(spark, d):
    """Closures within the usual bounds whose halves clash twelve times at most."""
    a = _radii(spark, d)
    r = backbone.residues(V.atoms(spark, d), ["N", "CA", "C"]).withColumnRenamed("structure_id", "id")
    return pairs.closures_without_clashes(pairs.closures(r, r), a, a, most=12, widest=1.7)


@query("combine_conformers", V.with_views("atoms", more=f"{_RAD}, cb as ({_BETWEEN})") + """select a.vec_id as id0, b.vec_id as id1 from (select vec_id from embeddings where label = 0) a, (select vec_id from embeddings where label = 1) b
 where not exists (select 1 from cb where n > 3 and structure_id = a.vec_id and structure_id + 1 = b.vec_id) order by (a.vec_id * 2654435761 + b.vec_id * 40503) % 4294967296, 1, 2 limit 500""")
def combine_conformers(spark, d):
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    a = _radii(spark, d)
    fragments = pairs.trim_tails(a, ["structure_id"], front=True, back=False)
    bad = pairs.clashes_between(fragments, a.withColumn("structure_id", F.col("structure_id") - 1), ["structure_id"], widest=1.7).filter("n > 3")
    bad = bad.select(F.col("structure_id").alias("a"), (F.col("structure_id") + 1).alias("b"))
    order = lambda a, b: (a * F.lit(2654435761) + b * F.lit(40503)) % F.lit(4294967296)
    return pairs.combine([e.filter("label = 0"), e.filter("label = 1")], bad, 500, order)


@query("rmsd", V.with_views("atoms") + "select a.structure_id, round(sqrt(sum((a.x - r.x) * (a.x - r.x) + (a.y - r.y) * (a.y - r.y) + (a.z - r.z) * (a.z - r.z)) / count(*)), 4) as rmsd from atoms a join atoms r on r.serial = a.serial and r.structure_id = 0 group by a.structure_id")
def rmsd(spark, d):
    a = V.atoms(spark, d)
    return pairs.rmsd(a, a.filter("structure_id = 0")).withColumn("rmsd", F.round("rmsd", 4))
