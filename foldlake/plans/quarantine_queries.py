"""Scans of damaged lines, and functions that fail for some structures: what is kept, and what is set aside."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.per_structure import per_structure
from ..sources import checked
from . import source_queries as SQ
from . import views as V
from .registration import Registry

REGISTRY = Registry()
query = REGISTRY.query


def _report(good: DataFrame, total, bad: DataFrame, source: str = "source") -> DataFrame:
    """source, reason (null: good), n, total: rows kept with a sum over them, and lines set aside by reason. The sum is
    rounded as in SQL, by the nearest whole number of thousandths in doubles: F.round goes by the decimal digits and takes
    0.5095, which is a little less, up."""
    thousandths = F.round(F.sum(total) * 1000)
    kept = good.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"), (thousandths / 1000 + 0.0).alias("total"))
    aside = bad.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.lit(0.0))
    return kept.withColumn("reason", F.lit(None).cast("string")).select("source", "reason", "n", "total").unionByName(aside.select("source", "reason", "n", "total"))


_BAD = "select {source} as source, {reason} as reason, count(*) as n, 0.0::double as total from {rows} where {reason} is not null group by all"


@query("quarantine_fasta", V.with_views("seqs", more="""c as (select doc_id, i, substr(seq, i * 60 + 1, 60) as part, (doc_id + i) % 11 = 3 as damaged from (select *, unnest(range((length(seq) + 59) // 60)) as i from seqs where length(seq) > 0))""") +
       "select (doc_id % 50)::varchar as source, case when damaged then 'letters' end as reason, case when damaged then count(*) else count(distinct doc_id) end as n, case when damaged then 0 else sum(length(part)) end::double as total from c group by doc_id % 50, damaged")
def quarantine_fasta(spark, d):
    """Every eleventh line of a sequence has a digit."""
    s = V.seqs(spark, d).filter(F.length("seq") > 0)
    head = F.concat(F.array(F.concat(F.lit(">"), F.col("doc_id").cast("string"))), F.regexp_extract_all("seq", F.lit(".{1,60}"), F.lit(0)))
    rows = s.select((F.col("doc_id") % 50).cast("string").alias("source"), "doc_id", F.posexplode(head).alias("i", "line"))
    line = F.when((F.col("i") > 0) & ((F.col("doc_id") + F.col("i") - 1) % 11 == 3), F.concat("line", F.lit("7"))).otherwise(F.col("line"))
    good, bad = checked.scan(rows.select("source", (F.col("doc_id") * 1_000_000 + F.col("i")).alias("line_no"), line.alias("line")), checked.sequences())
    return _report(good, F.length("sequence").cast("double"), bad)


@query("quarantine_chespi", f"""with {SQ._E8}, r as (select *, case vec_id % 5 when 1 then 'fields' when 2 then 'residue number' when 3 then 'probability' end as reason from e8)
 select vec_id::varchar as source, null as reason, 8::bigint as n, round(list_sum(p), 3) + 0.0 as total from r where reason is null union all """ + _BAD.format(source="vec_id::varchar", reason="reason", rows="r"))
def quarantine_chespi(spark, d):
    rows = SQ.eight_lines(spark, d).withColumn("m", F.col("source").cast("long") % 5)
    line = F.when(F.col("m") == 1, F.regexp_replace("line", r" \S+$", "")).when(F.col("m") == 2, F.regexp_replace("line", r"A \d+", "A x")).when(F.col("m") == 3, F.regexp_replace("line", r"\S+$", "n/a"))
    good, bad = checked.scan(rows.withColumn("line", line.otherwise(F.col("line"))), checked.eight_classes())
    return _report(good, F.col("prob"), bad)


@query("quarantine_d2d", f"""with {SQ._E4}, r as (select *, case when vec_id % 4 = 0 then null when vec_id % 6 = 2 then 'fields' when vec_id % 6 = 3 then 'probability' end as reason from e4)
 select vec_id::varchar as source, null as reason, 4::bigint as n, case when vec_id % 4 = 0 then 1.0 else round(list_sum(p), 3) + 0.0 end as total from r where reason is null union all """ + _BAD.format(source="vec_id::varchar", reason="reason", rows="r"))
def quarantine_d2d(spark, d):
    rows = SQ.four_lines(spark, d).withColumn("v", F.col("source").cast("long"))
    hurt = F.when(F.col("v") % 6 == 2, F.regexp_replace("line", r" \S+ \S+$", "")).when(F.col("v") % 6 == 3, F.regexp_replace("line", r"\S+ L$", "- L")).otherwise(F.col("line"))
    good, bad = checked.scan(rows.withColumn("line", F.when(F.col("v") % 4 > 1, hurt).otherwise(F.col("line"))), checked.four_classes())
    return _report(good, F.col("prob"), bad)


@query("quarantine_xmer_probs", "with s as (select p_brand as source, p_size as size, count(*)::double as w, case p_size % 10 when 7 then 'weight' when 3 then 'size' end as reason from part group by all)" +
       " select source, null as reason, count(*) as n, round(sum(size * w) / sum(w), 3) + 0.0 as total from s where reason is null group by source union all " + _BAD.format(source="source", reason="reason", rows="s"))
def quarantine_xmer_probs(spark, d):
    s = V.table(spark, d, "part").groupBy(F.col("p_brand").alias("source"), "p_size").agg(F.count(F.lit(1)).alias("w"))
    m = F.col("p_size") % 10
    line = F.when(m == 7, F.format_string("%d heavy", "p_size")).when(m == 3, F.format_string("s%d %d", "p_size", "w")).otherwise(F.format_string("%d %d", "p_size", "w"))
    good, bad = checked.scan(s.select("source", F.col("p_size").alias("line_no"), line.alias("line")), checked.size_weights())
    return _report(good, F.col("size") * F.col("prob"), bad)


@query("quarantine_loop_db", """with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as r from lineitem),
 t as (select *, case when r % 4 = 2 then 'fields' when r % 4 = 3 then 'residue number' end as reason from l),
 g as (select l_orderkey, radians(round(l_discount * 100, 2)) as psi, lead(r) over w as next, radians(lead(round(l_quantity, 2)) over w) as phi from t where reason is null window w as (partition by l_orderkey order by r))
 select l_orderkey::varchar as source, null as reason, count(*) as n, round(sum(psi + phi), 3) + 0.0 as total from g where next is not null group by l_orderkey union all """ + _BAD.format(source="l_orderkey::varchar", reason="reason", rows="t"))
def quarantine_loop_db(spark, d):
    li = V.table(spark, d, "lineitem").withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")))
    number = F.when(F.col("r") % 4 == 3, F.format_string("n%d", "r")).otherwise(F.col("r").cast("string"))
    line = F.format_string("%d A %s %s %.2f %.2f %.2f", "l_orderkey", "l_returnflag", number, "l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100)
    line = F.when(F.col("r") % 4 == 2, F.regexp_replace(line, r" \S+$", "")).otherwise(line)
    rows = li.select(F.col("l_orderkey").cast("string").alias("source"), F.col("r").alias("line_no"), line.alias("line"))
    good, bad = checked.scan(rows, checked.loops())
    return _report(good, F.col("psi") + F.col("phi"), bad, "chain")


@query("quarantine_residue_csv", V.with_views("atoms", more="r as (select *, case when serial in (4, 9) then 'columns' end as reason from atoms)") +
       "select structure_id::varchar as source, null as reason, count(*) as n, round(sum(serial), 3)::double as total from r where reason is null group by structure_id union all " + _BAD.format(source="structure_id::varchar", reason="reason", rows="r"))
def quarantine_residue_csv(spark, d):
    a = V.atoms(spark, d)
    x = F.when(F.col("serial") == 4, "oops").otherwise(F.format_string("%.3f", "x"))
    line = F.format_string("%s,L,%s,%.3f,%.3f,%d", F.substring("res_name", 1, 1), x, "y", "z", "serial")
    line = F.when(F.col("serial") == 9, F.regexp_replace(line, r",[^,]*$", "")).otherwise(line)
    rows = a.select(F.col("structure_id").cast("string").alias("source"), F.col("serial").alias("line_no"), line.alias("line"))
    good, bad = checked.scan(rows, checked.table("aa string, ss string, x double, y double, z double, phi double"))
    return _report(good, F.col("phi"), bad)


@query("quarantine_energy_log", "with r as (select *, case when o_orderkey % 8 = 1 then 'columns' end as reason from orders)" +
       " select o_orderpriority as source, null as reason, count(*) as n, round(sum(round(o_totalprice, 2)), 3) + 0.0 as total from r where reason is null group by 1 union all " + _BAD.format(source="o_orderpriority", reason="reason", rows="r"))
def quarantine_energy_log(spark, d):
    line = F.when(F.col("o_orderkey") % 8 == 1, F.format_string("conformer_%d", "o_orderkey")).otherwise(F.format_string("conformer_%d,%.2f", "o_orderkey", "o_totalprice"))
    rows = V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("line_no"), line.alias("line"))
    good, bad = checked.scan(rows, checked.table("conformer string, energy double"))
    return _report(good, F.col("energy"), bad)


@query("quarantine_db_json", V.with_views("segments", more="r as (select *, case when segment_id % 9 = 4 then 'no object' end as reason from segments)") +
       "select (segment_id % 50)::varchar as source, null as reason, count(*) as n, sum(length(fasta))::double as total from r where reason is null group by 1 union all " + _BAD.format(source="(segment_id % 50)::varchar", reason="reason", rows="r"))
def quarantine_db_json(spark, d):
    """A text for each segment; every ninth is cut off."""
    record = F.map_from_arrays(F.array(F.col("segment_id").cast("string")), F.array(F.struct("fasta", "dssp")))
    line = F.when(F.col("segment_id") % 9 == 4, F.concat(F.left(F.to_json(record), F.lit(12)))).otherwise(F.to_json(record))
    rows = V.segments(spark, d).select((F.col("segment_id") % 50).cast("string").alias("source"), F.col("segment_id").alias("line_no"), line.alias("line"))
    good, bad = checked.scan(rows, checked.database())
    return _report(good, F.length("fasta").cast("double"), bad)


def centre(atoms: pd.DataFrame) -> pd.DataFrame:
    """The centre of a structure's atoms, and their mean distance from it; fails for every tenth structure."""
    s = int(atoms["structure_id"].iloc[0])
    if s % 10 == 3:
        raise ArithmeticError(f"structure {s}")
    p = atoms[["x", "y", "z"]].to_numpy()
    c = p.mean(axis=0)
    return pd.DataFrame({"structure_id": [s], "n": [len(p)], "cx": [c[0]], "spread": [((p - c) ** 2).sum(axis=1).mean()]})


@query("per_structure", V.with_views("atoms", more="""g as (select structure_id, count(*) as n, avg(x) as cx, var_pop(x) + var_pop(y) + var_pop(z) as spread from atoms group by structure_id)""") +
       """select structure_id, case when structure_id % 10 = 3 then 'ArithmeticError: structure ' || structure_id::varchar end as reason, case when structure_id % 10 <> 3 then n else 0 end as n,
 case when structure_id % 10 <> 3 then round(cx, 4) + 0.0 end as cx, case when structure_id % 10 <> 3 then round(spread, 4) + 0.0 end as spread from g""")
def per_structure_query(spark, d):
    rows, bad = per_structure(V.atoms(spark, d), centre, "structure_id long, n long, cx double, spread double", order=["serial"])
    rows = rows.select("structure_id", F.lit(None).cast("string").alias("reason"), "n", *[(F.round(c, 4) + 0.0).alias(c) for c in ("cx", "spread")])
    return rows.unionByName(bad.withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True)
