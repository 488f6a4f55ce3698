"""Queries on structures as tables, ids, records and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import residues as R
from ..operators import backbone as B
from ..operators import database as D
from ..operators import islands, kmer_index, sampling, similarity
from ..operators import structures as T
from . import backbone_queries as BQ
from . import sequence_queries as SQ
from . import views as V
from .registration import Registry

REGISTRY = Registry()
query = REGISTRY.query

_RAW = """raw as (select structure_id, serial as row_idx, serial, case when serial % 7 = 0 then 'HETATM' else 'ATOM' end as record, name, ['A', '', ' ', 'B'][serial % 4 + 1] as alt_loc, res_name,
 ['A', 'b', 'C'][res_seq % 3 + 1] as chain_id, (case when res_seq = 5 then 4 else res_seq end)::int as res_seq, case when (structure_id + res_seq) % 5 = 0 then 'A' else '' end as icode, x, y, z,
 ((serial * 7 + structure_id) % 100)::double as temp, case when res_seq % 2 = 0 then 'PROA' else 'MEMB' end as segid, element from atoms)"""
_ONE = BQ._ONE


def raw_atoms(spark, d):
    """Atoms with the columns of coordinate files, odd values included."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    s, r, i = F.col("serial"), F.col("res_seq"), F.col("structure_id")
    return V.atoms(spark, d).select(
        "structure_id", s.alias("row_idx"), "serial", F.when(s % 7 == 0, "HETATM").otherwise("ATOM").alias("record"), "name", pick(["A", "", " ", "B"], s % 4).alias("alt_loc"), "res_name",
        pick(["A", "b", "C"], r % 3).alias("chain_id"), F.when(r == 5, 4).otherwise(r).cast("int").alias("res_seq"), F.when((i + r) % 5 == 0, "A").otherwise("").alias("icode"), "x", "y", "z",
        ((s * 7 + i) % 100).cast("double").alias("temp"), F.when(r % 2 == 0, "PROA").otherwise("MEMB").alias("segid"), "element",
    )


@query("filter_stack", V.with_views("atoms", more=_RAW) + "select structure_id, serial from raw where record = 'ATOM' and chain_id = 'A'")
def filter_stack(spark, d):
    s = T.FilterStack().push(F.col("record") == "ATOM").push(F.col("chain_id") == "A").push(F.col("name") == "N").pop()
    return s.apply(raw_atoms(spark, d)).select("structure_id", "serial")


@query("filter_backbone", V.with_views("atoms", more=_RAW) + "select structure_id, serial from raw where name in ('N', 'CA', 'C', 'O') and element in ('N', 'C')")
def filter_backbone(spark, d):
    return raw_atoms(spark, d).filter(T.is_backbone(True)).select("structure_id", "serial")


@query("backbone_check", V.with_views("atoms", more=_RAW + ", c as (select structure_id, chain_id, count(*) as n, count(distinct res_seq) as r, min_by(name, row_idx) as first, list_sort(list(distinct name)) as names from raw where record = 'ATOM' group by all)") +
       "select structure_id, chain_id, case when r < 2 then 'short' when n % 3 <> 0 then 'count' when first <> 'N' then 'first' when names <> ['C', 'CA', 'N'] then 'labels' end as reason from c")
def backbone_check(spark, d):
    return T.backbone_check(raw_atoms(spark, d).filter("record = 'ATOM'"))


@query("clean_chains", V.with_views("atoms", more=_RAW + """, f as (select * from raw where element in ('C', 'O', 'N', 'H', 'S', 'Se', 'D') and alt_loc in ('A', '', ' ', '1') and res_name not in ('TRP', 'MET')),
 want as (select vec_id as structure_id, case when label % 2 = 0 then 'B' else 'a' end as chain from embeddings where not (label % 10 = 3)),
 m as (select w.structure_id, h.chain_id, row_number() over (partition by w.structure_id, w.chain order by w.chain = h.chain_id desc, h.chain_id) as b from want w join (select distinct structure_id, chain_id from f) h on h.structure_id = w.structure_id and lower(h.chain_id) = lower(w.chain)),
 k as (select f.*, max(case when record = 'ATOM' then 1 else 0 end) over (partition by f.structure_id, f.chain_id) as atom from f join (select distinct structure_id, chain_id from m where b = 1) using (structure_id, chain_id))""") +
       "select structure_id, chain_id, row_idx, row_number() over (partition by structure_id, chain_id order by row_idx)::int as serial from k where atom = 1")
def clean_chains(spark, d):
    e = V.table(spark, d, "embeddings")
    chain = F.when(F.col("label") % 2 == 0, "B").otherwise("a").alias("chain")
    wanted, blocked = e.select(F.col("vec_id").alias("structure_id"), chain), e.filter("label % 10 = 3").select(F.col("vec_id").alias("structure_id"), chain)
    ligands = spark.createDataFrame([("TRP",), ("MET",)], "res_name string")
    return T.clean_chains(raw_atoms(spark, d), wanted, ligands, blocked).select("structure_id", "chain_id", "row_idx", "serial")


@query("delete_insertions", V.with_views("atoms", more=_RAW + """, a as (select *, case when chain_id is not distinct from lag(chain_id) over w and res_seq = lag(res_seq) over w and icode is not distinct from lag(icode) over w then 0 else 1 end as new from raw window w as (partition by structure_id order by row_idx)),
 b as (select *, case when new = 1 and sum(new) over (partition by structure_id, chain_id, res_seq order by row_idx) > 1 then 1 else 0 end as again from a)""") +
       "select structure_id, row_idx, (res_seq + sum(again) over (partition by structure_id order by row_idx))::int as res_seq_new from b")
def delete_insertions(spark, d):
    return T.delete_insertions(raw_atoms(spark, d)).select("structure_id", "row_idx", "res_seq_new")


@query("renumber_atoms", V.with_views("atoms", more=_RAW) + "select structure_id, row_idx, row_number() over (partition by structure_id order by row_idx)::int as serial from raw where record = 'HETATM'")
def renumber_atoms(spark, d):
    return T.renumber(raw_atoms(spark, d).filter("record = 'HETATM'")).select("structure_id", "row_idx", "serial")


@query("rename_residues", V.with_views("atoms", more=_RAW + """, a as (select *, case when res_seq = lag(res_seq) over (partition by structure_id order by row_idx) then 0 else 1 end as new from raw),
 b as (select *, sum(new) over (partition by structure_id, res_seq order by row_idx) as block from a)""") + "select structure_id, row_idx, case when block = 1 and res_seq = 1 then 'ABC' when block = 1 and res_seq = 4 then 'DEF' else res_name end as res_name from b")
def rename_residues(spark, d):
    return T.rename_residues(raw_atoms(spark, d), {"1": "ABC", "4": "DEF"}).select("structure_id", "row_idx", "res_name")


@query("filter_confidence", V.with_views("atoms", more=_RAW) + "select structure_id, row_idx, row_number() over (partition by structure_id order by row_idx)::int as serial from raw where temp > 70")
def filter_confidence(spark, d):
    return T.renumber(raw_atoms(spark, d).filter("temp > 70")).select("structure_id", "row_idx", "serial")


@query("filter_segid", V.with_views("atoms", more=_RAW) + "select structure_id, row_idx from raw where contains(segid, 'PRO')")
def filter_segid(spark, d):
    return raw_atoms(spark, d).filter(F.col("segid").contains("PRO")).select("structure_id", "row_idx")


@query("map_residue_codes", V.with_views("atoms") + f"select structure_id, serial, {_ONE} as aa, res_name as three from atoms")
def map_residue_codes(spark, d):
    aa = R.one_letter(F.col("res_name"))
    return V.atoms(spark, d).select("structure_id", "serial", aa.alias("aa"), R.three_letter(aa).alias("three"))


@query("chain_sequence", V.with_views("atoms", more=_RAW + f", r as (select structure_id, chain_id, res_seq, min(row_idx) as i, min_by({_ONE}, row_idx) as aa from raw group by all)") + "select structure_id, chain_id, string_agg(aa, '' order by i) as fasta from r group by all")
def chain_sequence(spark, d):
    return T.chain_sequence(raw_atoms(spark, d))


@query("file_sequence", V.with_views("atoms", more=_RAW + f", r as (select structure_id, res_seq, min(row_idx) as i, max_by({_ONE}, row_idx) as aa from raw group by all)") + "select structure_id, string_agg(aa, '' order by i) as fasta from r group by all")
def file_sequence(spark, d):
    return T.file_sequence(raw_atoms(spark, d))


@query("element_fallback", V.with_views("atoms", more=_RAW) + "select structure_id, row_idx, case when serial % 3 = 0 then left(name, 1) else element end as element from raw")
def element_fallback(spark, d):
    a = raw_atoms(spark, d).withColumn("element", F.when(F.col("serial") % 3 == 0, "").otherwise(F.col("element")))
    return a.select("structure_id", "row_idx", T.element_or_name(F.col("element"), F.col("name")).alias("element"))


@query("ss_extract", V.with_views("atoms", "ss", more="isl as (select *, pos - row_number() over (partition by user_id, ss order by pos) as g from ss), lr as (select user_id as id, ss, min(pos) as start, max(pos) + 1 as stop from isl group by user_id, ss, g)," +
       "rn as (select *, id::varchar || '_' || ss || '_' || (row_number() over (partition by id, ss order by start) - 1)::varchar as part from lr where stop - start >= 2)") +
       "select a.structure_id, part, a.res_seq, serial from rn join atoms a on a.structure_id = id and a.res_seq >= start and a.res_seq < stop where name = 'CA'")
def ss_extract(spark, d):
    runs = islands.label_runs(V.ss(spark, d).withColumnRenamed("user_id", "id"), ["id"], "pos", "ss")
    return T.runs_to_atoms(runs, V.atoms(spark, d), 2, ["CA"]).select("structure_id", "part", "res_seq", "serial")


@query("segment_atoms", V.with_views("atoms", more=_RAW + """, s as (select vec_id as structure_id, unnest([1, 3, 6]) as first from embeddings), j as (select r.*, first from raw r join s on s.structure_id = r.structure_id and res_seq between first and case first when 1 then 1 when 3 then 5 else 7 end),
 k as (select structure_id, first, row_number() over (partition by structure_id order by first) - 1 as seg_no from (select structure_id, first from j group by all having count(distinct res_seq) >= 2 and max(case when record = 'ATOM' then 1 else 0 end) = 1))""") +
       "select structure_id, row_idx, seg_no::int as seg_no from j join k using (structure_id, first)")
def segment_atoms(spark, d):
    last = F.when(F.col("first") == 1, 1).when(F.col("first") == 3, 5).otherwise(7)
    s = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("structure_id"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(6))).alias("first")).withColumn("last", last)
    return T.segment_atoms(raw_atoms(spark, d), s).select("structure_id", "row_idx", F.col("seg_no").cast("int").alias("seg_no"))


@query("splice_segments", V.with_views("atoms", more="""p as (select structure_id, serial as row_idx, res_seq, case when res_seq < 3 then 0 else 2 end as part from atoms where res_seq < 3 or res_seq >= 5
 union all select structure_id - 1, serial, res_seq, 1 from atoms where res_seq >= 3 and res_seq < 5 and structure_id > 0)""") + "select structure_id, part, row_idx, dense_rank() over (partition by structure_id order by part, res_seq)::int as res_new, row_number() over (partition by structure_id order by part, row_idx)::int as serial_new from p")
def splice_segments(spark, d):
    a = V.atoms(spark, d).withColumn("row_idx", F.col("serial"))
    seg = a.withColumn("structure_id", F.col("structure_id") - 1).filter("structure_id >= 0")
    part = F.when(F.col("res_seq") < 3, 0).when(F.col("res_seq") < 5, 1).otherwise(2)
    return T.splice(a, seg, 3, 5).select("structure_id", part.alias("part"), "row_idx", "res_new", "serial_new")


@query("merge_ensembles", """with p as (select distinct left(o_orderpriority, 1)::int - 1 as part, o_custkey as id from orders)
 select part, id, 'conf_' || row_number() over (order by part, id)::varchar as name from p""")
def merge_ensembles(spark, d):
    o = V.table(spark, d, "orders")
    parts = [o.filter(F.col("o_orderpriority").startswith(str(i + 1))).select(F.col("o_custkey").alias("id"), F.lit(i).alias("part")).distinct() for i in range(5)]
    return T.merge_ensembles(parts, "conf", "id").select("part", "id", "name")


def _records(spark, d):
    """Segments with angles of invented values; every third id has too few omegas."""
    n = F.length("fasta") - 1
    s = V.segments(spark, d).filter(n > 0)
    count = F.sequence(F.lit(0), n - 1)
    s = s.withColumn("phi", F.transform(count, lambda i: i * 2.0)).withColumn("psi", F.transform(count, lambda i: i * 3.0))
    return s.withColumn("omega", F.when(F.col("segment_id") % 3 == 0, F.slice(F.col("phi"), 1, 1)).otherwise(F.col("phi")))


_ALIGNED = """al as (select segment_id, substr(fasta, 2, length(fasta) - 2) as aa, substr(dssp, 2, length(dssp) - 2) as ss, list_transform(range(length(fasta) - 2), lambda i: i * 2.0) as phi,
 list_transform(range(length(fasta) - 2), lambda i: (i + 1) * 3.0) as psi from segments where length(fasta) > 2 and segment_id % 3 <> 0)"""


@query("align_db", V.with_views("segments", more=_ALIGNED) + "select * from al")
def align_db(spark, d):
    return D.align(_records(spark, d)).select("segment_id", "aa", "ss", "phi", "psi")


@query("align_db_exact", V.with_views("segments", more=_ALIGNED) + """select segment_id, length(aa)::int as n, (length(aa) * (length(aa) - 1) // 2)::double as bends, length(aa) * 1.5 as lengths from al where segment_id % 5 <> 0""")
def align_db_exact(spark, d):
    """Records whose bend angles and bond lengths fit too; every fifth id has one length too many."""
    inner = F.sequence(F.lit(1), F.length("fasta") - 2)
    r = _records(spark, d).filter(F.length("fasta") > 2).withColumn("n_ca_c", F.transform(inner, lambda i: i - 1.0))
    more = F.when(F.col("segment_id") % 5 == 0, F.array(F.lit(1.5))).otherwise(F.array().cast("array<double>"))
    r = r.withColumn("ca_c", F.concat(F.transform(inner, lambda i: F.lit(1.5)), more))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return D.align(r, ["n_ca_c", "ca_c"]).select("segment_id", F.length("aa").alias("n"), total("n_ca_c").alias("bends"), total("ca_c").alias("lengths"))


@query("align_slices", V.with_views("segments", more=_ALIGNED) + """select segment_id, start::bigint as start, (start + n)::bigint as stop from (select segment_id, length(aa) as n, coalesce(sum(length(aa) + 1) over (order by segment_id rows between unbounded preceding and 1 preceding), 0) as start from al)""")
def align_slices(spark, d):
    return D.slices(D.align(_records(spark, d)))


@query("merge_torsions", "select l.doc_id, quality, toxic, n_chars from labels l join documents d on d.doc_id = l.doc_id")
def merge_torsions(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "n_chars")
    return D.merge_records(V.table(spark, d, "labels"), docs, "doc_id")[0]


@query("merge_geometry", "select 'left' as side, doc_id from labels where doc_id not in (select doc_id from documents) union all select 'right', doc_id from documents where doc_id not in (select doc_id from labels)")
def merge_geometry(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "n_chars")
    _, left, right = D.merge_records(V.table(spark, d, "labels"), docs, "doc_id")
    return left.select(F.lit("left").alias("side"), "doc_id").unionByName(right.select(F.lit("right").alias("side"), "doc_id"))


_DB = f"db as (select structure_id, string_agg({BQ._ONE}, '' order by res_seq) as fasta from (select distinct structure_id, res_seq, res_name from atoms) where structure_id % 7 <> 3 group by structure_id)"


def _database(spark, d):
    """Sequences of the structures, but for every seventh."""
    r = V.atoms(spark, d).filter("structure_id % 7 <> 3").groupBy("structure_id", "res_seq").agg(F.min("res_name").alias("res_name"))
    rows = F.array_sort(F.collect_list(F.struct("res_seq", R.one_letter(F.col("res_name")).alias("aa"))))
    return r.groupBy("structure_id").agg(F.array_join(F.transform(rows, lambda x: x["aa"]), "").alias("fasta"))


@query("merge_torsions_records", V.with_views("atoms", more=f"{BQ._TRACE}, {BQ._TORS}, {_DB}, ta as (select structure_id, list(degrees order by chain_id, res_seq) filter (where kind = 'phi') as phi, list(degrees order by chain_id, res_seq) filter (where kind = 'psi') as psi, list(degrees order by chain_id, res_seq) filter (where kind = 'omega') as omega from tors where structure_id % 5 <> 2 group by structure_id)") +
       "select coalesce(db.structure_id, ta.structure_id) as structure_id, case when ta.structure_id is null then 'left' when db.structure_id is null then 'right' else 'both' end as side, fasta, phi, psi, omega from db full join ta on db.structure_id = ta.structure_id")
def merge_torsions_records(spark, d):
    """Sequences and torsions of structures, either of which some lack: merged rows and both reports in one pass."""
    t = B.chain_records(BQ.backbone_torsions(spark, d).filter("structure_id % 5 <> 2"))
    return D.merge_tagged(_database(spark, d), t, "structure_id")


@query("merge_geometry_records", BQ._ALL.rstrip() + f", {_DB}, ga as (select structure_id, count(*) as n, " + ", ".join(f"round(sum({k}), 3) + 0.0 as {k}" for k in B.ANGLES + B.LENGTHS) + " from ge where structure_id % 6 <> 1 group by structure_id)" +
       " select coalesce(db.structure_id, ga.structure_id) as structure_id, case when ga.structure_id is null then 'left' when db.structure_id is null then 'right' else 'both' end as side, coalesce(fasta, '') as fasta, coalesce(n, 0)::bigint as n, " + ", ".join(f"coalesce({k}, 0) as {k}" for k in B.ANGLES + B.LENGTHS) + " from db full join ga on db.structure_id = ga.structure_id")
def merge_geometry_records(spark, d):
    """The same with bend angles and bond lengths, summed over a structure."""
    g = B.bond_geometry(BQ.full_atoms(spark, d)).filter("structure_id % 6 <> 1")
    g = g.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"), *[(F.round(F.sum(k), 3) + 0.0).alias(k) for k in B.ANGLES + B.LENGTHS])
    return D.merge_tagged(_database(spark, d), g, "structure_id").fillna(0.0, B.ANGLES + B.LENGTHS).fillna(0, ["n"]).fillna("", ["fasta"])


@query("new_ids", "select distinct doc_id from documents where doc_id not in (select doc_id from labels) and doc_id not in (select item_id from benchmark)")
def new_ids(spark, d):
    return D.new_ids(V.table(spark, d, "documents"), V.table(spark, d, "labels"), V.table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id"), "doc_id")


@query("update_db", "select doc_id, quality + 10 as quality from labels where toxic = 0 union all select doc_id, quality from labels where toxic <> 0")
def update_db(spark, d):
    old = V.table(spark, d, "labels").select("doc_id", "quality")
    new = V.table(spark, d, "labels").filter("toxic = 0").select("doc_id", (F.col("quality") + 10).alias("quality"))
    return D.update(old, new, "doc_id")


# Ids as text in several spellings, from pages.
_IDS = "ids as (select page_id, case page_id % 6 when 0 then '1abc' when 1 then lpad((page_id % 10)::varchar, 1, '0') || 'xyzB' when 2 then '2def_' || chr((65 + page_id % 5)::int) when 3 then '3ghi_A_seg' || (page_id % 4)::varchar when 4 then '#comment' else 'model' || page_id::varchar || '.pdb' end || ' 120 XRAY' as entry from pages)"
_PARSED = """pi as (select page_id, entry, regexp_replace(regexp_extract(entry, '^(\\S+)', 1), '\\.[A-Za-z0-9]+$', '') as w from ids where not starts_with(entry, '#')),
 pp as (select page_id, case when regexp_full_match(w, '[0-9][A-Za-z0-9]{3}((_)?[A-Za-z0-9]+(_seg[0-9]+)?)?') then upper(left(w, 4)) else w end as name,
 case when regexp_full_match(w, '[0-9][A-Za-z0-9]{3}_[A-Za-z0-9]+(_seg[0-9]+)?') then split_part(w, '_', 2) when regexp_full_match(w, '[0-9][A-Za-z0-9]{4,}') then substr(w, 5) end as chain,
 case when regexp_full_match(w, '[0-9][A-Za-z0-9]{3}_[A-Za-z0-9]+_seg[0-9]+') then split_part(w, '_', 3) end as seg from pi)"""


def id_entries(spark, d):
    i = F.col("page_id")
    entry = F.when(i % 6 == 0, "1abc").when(i % 6 == 1, F.concat((i % 10).cast("string"), F.lit("xyzB"))).when(i % 6 == 2, F.concat(F.lit("2def_"), F.char(65 + i % 5)))
    entry = entry.when(i % 6 == 3, F.concat(F.lit("3ghi_A_seg"), (i % 4).cast("string"))).when(i % 6 == 4, "#comment").otherwise(F.concat(F.lit("model"), i.cast("string"), F.lit(".pdb")))
    return V.table(spark, d, "pages").select("page_id", F.concat(entry, F.lit(" 120 XRAY")).alias("entry"))


def parsed_ids(spark, d):
    return id_entries(spark, d).filter(~F.col("entry").startswith("#")).select("page_id", D.parse_id(F.col("entry")).alias("p"))


@query("scan_id_list", f"with {_IDS}, {_PARSED} select page_id, name, chain, seg from pp")
def scan_id_list(spark, d):
    return parsed_ids(spark, d).select("page_id", "p.name", "p.chain", "p.seg")


@query("id_dedup", f"with {_IDS}, {_PARSED} select distinct concat_ws('_', name, chain, seg) as id from pp")
def id_dedup(spark, d):
    return parsed_ids(spark, d).select(D.id_text(F.col("p")).alias("id")).distinct()


@query("sort_ids", f"with {_IDS}, {_PARSED} select distinct concat_ws('_', name, chain, seg) as id from pp order by id")
def sort_ids(spark, d):
    return id_dedup(spark, d).orderBy("id")


@query("id_difference", "select distinct doc_id from documents except select doc_id from labels")
def id_difference(spark, d):
    return V.table(spark, d, "documents").select("doc_id").subtract(V.table(spark, d, "labels").select("doc_id"))


@query("chains_by_name", f"with {_IDS}, {_PARSED} select name, list_sort(coalesce(list(distinct chain) filter (where chain is not null), [])) as chains from pp group by name")
def chains_by_name(spark, d):
    return parsed_ids(spark, d).groupBy("p.name").agg(F.array_sort(F.collect_set("p.chain")).alias("chains"))


@query("case_intersection", V.with_views("atoms", more=_RAW) + "select distinct structure_id, chain_id from raw where lower(chain_id) in ('a', 'b')")
def case_intersection(spark, d):
    return raw_atoms(spark, d).select("structure_id", "chain_id").distinct().filter(F.lower("chain_id").isin("a", "b"))


@query("limit_n", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r <= 3")
def limit_n(spark, d):
    return islands.first_rows(V.table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("top1_match", "select o_custkey, max_by(o_orderkey, o_totalprice * 1000000 - o_orderkey) as best from orders group by o_custkey")
def top1_match(spark, d):
    return islands.first_rows(V.table(spark, d, "orders"), ["o_custkey"], [F.desc(F.col("o_totalprice") * 1000000 - F.col("o_orderkey"))], 1).select("o_custkey", F.col("o_orderkey").alias("best"))


MATCHES = [SQ.QUERY_SEQ, "ACDEFGHIKLMNPQRSTVWY"]


def _match_queries(spark):
    return spark.createDataFrame(list(enumerate(MATCHES)), "q_idx int, query string")


@query("chain_match")
def chain_match(spark, d):
    return D.best_match(V.segments(spark, d).select(F.col("segment_id").alias("chain"), "fasta"), _match_queries(spark))


# A chain of one letter shares one block with a query, if any: the part of the ratio that SQL can say, with its bound.
@query("top1_similar", V.with_views("segments", more="""c as (select segment_id as chain, i // 30 as piece, substr(fasta, i + 1, 1) as a, substr(fasta, i + 1, 30) as part from segments, unnest(range(0, length(fasta), 30)) as t(i)),
 q as (select i - 1 as q_idx, ['""" + "', '".join(MATCHES) + """'][i] as query from unnest(range(1, 3)) as t(i)),
 r as (select chain, piece, q_idx, 2.0::double * case when contains(query, a) then 1 else 0 end / (1 + length(query)) as ratio from c, q)""") +
       "select chain, piece, min(q_idx)::int as q_idx, round(any_value(ratio), 6) as ratio from r where (chain, piece, ratio) in (select chain, piece, max(ratio) from r group by chain, piece) group by chain, piece")
def top1_similar(spark, d):
    """The most similar query of every thirtieth residue of each chain."""
    firsts = F.regexp_extract_all("fasta", F.lit("(.).{0,29}"), F.lit(1))
    s = V.segments(spark, d).select("segment_id", F.posexplode(firsts).alias("piece", "fasta"))
    s = s.select(F.struct("segment_id", F.col("piece").cast("long").alias("piece")).alias("chain"), "fasta")
    return similarity.most_similar(s, _match_queries(spark)).select("chain.segment_id", "chain.piece", "q_idx", F.round("ratio", 6).alias("ratio")).withColumnRenamed("segment_id", "chain")


KEYWORDS = ["enthere", "THE", "and", "of"]
_HEAD = """ln as (select doc_id as source, i::int as line_no, lower(case when i = 0 then 'HEADER ' else '' end || string_split(text, chr(10))[i + 1]) as line from documents, unnest(range(length(text) - length(replace(text, chr(10), '')) + 1)) as t(i)),
 en as (select source, min(line_no) filter (where contains(line, 'expdta')) as e from ln group by source),
 hk as (select ln.source, k, i, line_no, row_number() over (partition by ln.source order by line_no, i) as r from ln join en using (source), (values ('enthere', 0), ('the', 1), ('and', 2), ('of', 3)) as kw(k, i) where line_no <= coalesce(e, 2147483647) and contains(line, k))"""


def _matches(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("source"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    docs = docs.withColumn("line", F.when(F.col("line_no") == 0, F.concat(F.lit("HEADER "), "line")).otherwise(F.col("line")))
    kw = spark.createDataFrame([(k, i) for i, k in enumerate(KEYWORDS)], "keyword string, kw_idx int")
    return D.header_matches(docs, kw).withColumn("keyword", F.lower("keyword"))


@query("header_search", f"with {_HEAD} select source, k as keyword from hk where r = 1")
def header_search(spark, d):
    return _matches(spark, d)


@query("keyword_totals", f"with {_HEAD} select k as keyword, count(*) as n from hk where r = 1 group by k")
def keyword_totals(spark, d):
    return _matches(spark, d).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@query("mask_known", V.with_views("segments", more="m as (select segment_id, length(fasta) as n, unnest(range(length(fasta))) as i, unnest(string_split(replace(replace(fasta, 'THE', '***'), 'AND', '***'), '')) as c from segments), p as (select *, i - row_number() over (partition by segment_id order by i) as g from m where c <> '*')") +
       "select segment_id, min(i)::int as start, (max(i) + 1)::int as stop, case when min(i) = 0 then 'N' when max(i) + 1 = any_value(n) then 'C' else 'linker' end as kind from p group by segment_id, g")
def mask_known(spark, d):
    m = D.mask(D.mask(F.col("fasta"), F.lit("THE")), F.lit("AND"))
    r = islands.runs_without(V.segments(spark, d).select("segment_id", F.length("fasta").alias("size"), m.alias("masked")), "masked", "*")
    kind = F.when(F.col("start") == 0, "N").when(F.col("stop") == F.col("size"), "C").otherwise("linker")
    return r.select("segment_id", "start", "stop", kind.alias("kind"))


_CSSS = "cs as (select p_size as res_id, left(p_brand, 1) || right(p_brand, 1) as ss, count(*)::double as weight from part group by all)"


def csss(spark, d):
    """Label weights of each residue number, from parts."""
    ss = F.concat(F.substring("p_brand", 1, 1), F.expr("right(p_brand, 1)"))
    return V.table(spark, d, "part").groupBy(F.col("p_size").alias("res_id"), ss.alias("ss")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


@query("normalise_probs", f"with {_CSSS} select res_id, ss, round(weight / sum(weight) over (partition by res_id), 6) as prob from cs")
def normalise_probs(spark, d):
    return sampling.normalise(csss(spark, d), ["res_id"], "weight").select("res_id", "ss", F.round("prob", 6).alias("prob"))


@query("size_renorm", "with s as (select p_size as size, count(*)::double as weight from part group by all), h as (select distinct l_linenumber as size from lineitem) select size, round(weight / sum(weight) over (), 6) as prob from s where size in (select size from h)")
def size_renorm(spark, d):
    s = V.table(spark, d, "part").groupBy(F.col("p_size").alias("size")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    present = V.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("size")).distinct()
    return sampling.restrict_sizes(s, present).withColumn("prob", F.round("prob", 6))


GROUPS = [(1, 10, "H", 0.5), (5, 12, "H", 0.7), (8, 20, "L", 0.4)]


@query("custom_pattern", f"""with {_CSSS}, b as (select res_id, ss, weight / sum(weight) over (partition by res_id) as prob from cs),
 g as (select r as res_id, s as ss, p, i from (values """ + ", ".join(f"({i}, {a}, {b}, '{s}', {p}::double)" for i, (a, b, s, p) in enumerate(GROUPS)) + ") as t(i, a, b, s, p), unnest(range(a, b + 1)) as u(r)), o as (select res_id, ss, max_by(p, i) as prob from g group by all)" +
       " select coalesce(o.res_id, b.res_id) as res_id, coalesce(o.ss, b.ss) as ss, round(coalesce(o.prob, b.prob), 6) as prob from b full join o on b.res_id = o.res_id and b.ss = o.ss")
def custom_pattern(spark, d):
    text = spark.createDataFrame([(sampling.custom_pattern(GROUPS),)], "pattern string")
    base = sampling.normalise(csss(spark, d), ["res_id"], "weight").select("res_id", "ss", "prob")
    return sampling.merge_probabilities(base, sampling.parse_pattern(text, "pattern")).withColumn("prob", F.round("prob", 6))


SIZES = [(1, 1.0), (2, 1.0), (3, 3.0)]
_U = "(((({s} * 40503) * 31 + {a} * 2654435761) % 4294967296) * 31 + {b} * 2654435761) % 4294967296 / 4294967296.0"


@query("draw_fragments", V.with_views("segments", more=f"""dr as (select vec_id as draw, p as pos from embeddings, unnest(range({len(SQ.QUERY_SEQ)})) as t(p)),
 sz as (select size, (hi - w) / 5.0 as lo, hi / 5.0 as hi from (values (1, 1.0, 1.0), (2, 1.0, 2.0), (3, 3.0, 5.0)) as t(size, w, hi)),
 ix as (select k, substr(fasta, i + 1, k) as kmer, segment_id, i::int as start from (select *, unnest(range(length(fasta))) as i from segments), (select unnest([1, 2, 3]) as k) where i + k <= length(fasta)),
 nu as (select *, row_number() over (partition by k, kmer order by segment_id % 64, segment_id, start) as nth, count(*) over (partition by k, kmer) as n from ix),
 uu as (select draw, pos, {_U.format(s=7, a='draw', b='pos')} as u, {_U.format(s=8, a='pos', b='draw')} as v from dr),
 kk as (select draw, pos, v, unnest(range(1, least(size, {len(SQ.QUERY_SEQ)} - pos) + 1)) as k from uu join sz on u >= lo - 1e-12 and u < hi - 1e-12),
 ch as (select kk.*, c.n, c.kmer, row_number() over (partition by draw, pos order by kk.k desc) as r from kk join (select distinct k, kmer, n from nu) c on c.k = kk.k and c.kmer = substr('{SQ.QUERY_SEQ}', pos + 1, kk.k))""") +
       "select draw, ch.pos::int as pos, ch.k::int as k, ch.kmer, segment_id, start from ch join nu on nu.k = ch.k and nu.kmer = ch.kmer and nu.nth = floor(v * ch.n) + 1 where r = 1")
def draw_fragments(spark, d):
    draws = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(len(SQ.QUERY_SEQ) - 1))).alias("pos"))
    index = kmer_index.build(V.segments(spark, d), [1, 2, 3], label=None, order=[F.pmod("segment_id", F.lit(64)), F.col("segment_id")])
    sizes = spark.createDataFrame(SIZES, "size int, weight double")
    return sampling.draw_fragments(draws, SQ.QUERY_SEQ, sizes, index, 7)
