"""Queries on files' lines: written from the tables, read back, and checked against the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import residues as R
from ..operators import kmers
from ..sources import lines as L
from ..sources import json_objects, packed, reports, sinks, structures, tars
from . import database_queries as DQ
from . import sequence_queries as SQ
from . import views as V
from .registration import Registry

REGISTRY = Registry()
query = REGISTRY.query


def coordinate_lines(spark, d):
    """source, line_no, line: a coordinate file for each structure, of two models. Coordinates are rounded before, ties away from zero."""
    a = DQ.raw_atoms(spark, d).withColumns({c: F.round(c, 3) for c in "xyz"}).withColumn("occ", F.lit(1.0)).withColumn("charge", F.lit(""))
    body = structures.pdb_lines(a).select(F.col("structure_id").cast("string").alias("source"), F.col("row_idx").alias("line_no"), "line")
    ids = a.select(F.col("structure_id").cast("string").alias("source")).distinct()
    marks = ids.select("source", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("MODEL        1").alias("l")), F.struct(F.lit(50).alias("n"), F.lit("ENDMDL").alias("l")), F.struct(F.lit(51).alias("n"), F.lit("MODEL        2").alias("l")))).alias("m"))
    second = body.filter("line_no <= 3").withColumn("line_no", F.col("line_no") + 51)
    return body.unionByName(marks.select("source", F.col("m.n").alias("line_no"), F.col("m.l").alias("line"))).unionByName(second)


@query("sink_pdb_lines", V.with_views("atoms", more=DQ._RAW) + """select structure_id, row_idx, printf('%-6s%5d %s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f      %-4s%2s%2s', record, serial, printf(' %-3s', name),
 case when alt_loc = '' then ' ' else alt_loc end, res_name, chain_id, res_seq, case when icode = '' then ' ' else icode end, x, y, z, 1.0::double, temp, segid, element, '  ') as line from raw""")
def sink_pdb_lines(spark, d):
    return structures.pdb_lines(DQ.raw_atoms(spark, d).withColumn("occ", F.lit(1.0)).withColumn("charge", F.lit("")))


@query("scan_pdb", V.with_views("atoms", more=DQ._RAW) + "select structure_id::varchar as structure_id, row_idx, record, serial, name, trim(alt_loc) as alt_loc, res_name, chain_id, res_seq, icode, round(x, 3) + 0.0 as x, round(y, 3) + 0.0 as y, round(z, 3) + 0.0 as z, temp, segid, element from raw")
def scan_pdb(spark, d):
    atoms, _ = structures.scan_pdb(coordinate_lines(spark, d))
    return atoms.select("structure_id", "row_idx", "record", "serial", "name", "alt_loc", "res_name", "chain_id", "res_seq", "icode", *[(F.col(c) + 0.0).alias(c) for c in "xyz"], "temp", "segid", "element")


CIF_HEAD = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "auth_asym_id"]


def cif_lines(spark, d):
    a = DQ.raw_atoms(spark, d)
    alt = F.when(F.trim("alt_loc") == "", ".").otherwise(F.when(F.col("alt_loc") == "A", "1").otherwise(F.col("alt_loc")))
    auth = F.when(F.col("serial") % 2 == 0, "?").otherwise(F.col("chain_id"))
    cells = ["record", F.col("serial").cast("string"), "element", "name", alt, "res_name", F.upper("chain_id"), F.col("res_seq").cast("string"), *[F.format_string("%.3f", F.col(c)) for c in "xyz"], auth]
    body = a.select(F.col("structure_id").cast("string").alias("source"), (F.col("row_idx") + 20).alias("line_no"), F.concat_ws(" ", *cells).alias("line"))
    top = ["data_x", "loop_", *[f"_atom_site.{h}" for h in CIF_HEAD]]
    fixed = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(t).alias("l")) for i, t in [*enumerate(top), (99, "#")]])
    ids = a.select(F.col("structure_id").cast("string").alias("source")).distinct().select("source", F.explode(fixed).alias("f"))
    return body.unionByName(ids.select("source", F.col("f.n").alias("line_no"), F.col("f.l").alias("line")))


@query("scan_cif", V.with_views("atoms", more=DQ._RAW) + "select structure_id::varchar as structure_id, serial, record, name, trim(alt_loc) as alt_loc, res_name, case when serial % 2 = 0 then upper(chain_id) else chain_id end as chain_id, res_seq, round(x, 3) + 0.0 as x, round(y, 3) + 0.0 as y, round(z, 3) + 0.0 as z, element from raw")
def scan_cif(spark, d):
    atoms, _ = structures.scan_cif(cif_lines(spark, d))
    return atoms.select("structure_id", "serial", "record", "name", "alt_loc", "res_name", "chain_id", "res_seq", *[(F.col(c) + 0.0).alias(c) for c in "xyz"], "element")


@query("scan_format", "select vec_id::varchar || '.' || k as source, case k when 'a' then 'cif' when 'b' then 'pdb' else 'unknown' end as format from embeddings, (values ('a'), ('b'), ('c')) as t(k)")
def scan_format(spark, d):
    suffix = lambda df, s: df.withColumn("source", F.concat_ws(".", "source", F.lit(s)))
    plain = V.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("source"), F.lit(0).alias("line_no"), F.lit("nothing").alias("line"))
    every = suffix(cif_lines(spark, d), "a").unionByName(suffix(coordinate_lines(spark, d), "b")).unionByName(suffix(plain, "c"))
    return L.detect_format(every)


_BROKEN = """pr as (select *, i // 10 as part from (select segment_id, unnest(range(length(fasta))) as i, unnest(string_split(fasta, '')) as aa, unnest(string_split(dssp, '')) as ss from segments) where i % 10 <> 9)"""


def report_lines(spark, d):
    """A structure report for each segment, broken at every tenth residue."""
    both = F.arrays_zip(R.letters(F.col("fasta")).alias("aa"), F.split("dssp", "").alias("ss"))
    segments = V.segments(spark, d).select(F.col("segment_id").cast("string").alias("source"), both.alias("both"))
    s = segments.select("source", F.posexplode("both").alias("i", "x")).select("source", "i", "x.aa", "x.ss")
    aa = F.when(F.col("i") % 10 == 9, "!").otherwise(F.col("aa"))
    number = F.col("i") % 9999 + 1  # four columns
    body = s.select("source", (F.col("i") + 2).alias("line_no"), F.format_string("%5d %4d A %s  %s", F.col("i") % 99999 + 1, number, aa, F.col("ss")).alias("line"))
    top = F.array(F.struct(F.lit(0).alias("n"), F.lit("title").alias("l")), F.struct(F.lit(1).alias("n"), F.lit("  #  RESIDUE AA STRUCTURE").alias("l")))
    head = V.seqs(spark, d).filter(F.length("seq") > 0).select(F.col("doc_id").cast("string").alias("source"), F.explode(top).alias("f")).select("source", F.col("f.n").alias("line_no"), F.col("f.l").alias("line"))
    return body.unionByName(head)


@query("scan_dssp", V.with_views("segments", more=_BROKEN) + "select segment_id::varchar as source, part::int as seg_no, string_agg(aa, '' order by i) as fasta, string_agg(ss, '' order by i) as dssp, string_agg((i % 9999 + 1)::varchar, ',' order by i) as resids from pr group by segment_id, part")
def scan_dssp(spark, d):
    return reports.scan_dssp(report_lines(spark, d))[0]


@query("sink_ss_flat", V.with_views("segments", more=_BROKEN) + "select segment_id::varchar as source, string_agg(aa, '' order by i) as fasta, translate(string_agg(ss, '' order by i), ' ', '-') as ss from pr group by segment_id")
def sink_ss_flat(spark, d):
    return reports.flat_report(scan_dssp(spark, d))


@query("scan_fasta", V.with_views("seqs") + "select (doc_id % 50)::varchar as source, '>' || doc_id::varchar as header, seq as sequence from seqs where length(seq) > 0")
def scan_fasta(spark, d):
    s = V.seqs(spark, d).filter(F.length("seq") > 0)
    parts = F.concat(F.array(F.concat(F.lit(">"), F.col("doc_id").cast("string"))), F.regexp_extract_all("seq", F.lit(".{1,60}"), F.lit(0)))
    rows = s.select((F.col("doc_id") % 50).cast("string").alias("source"), "doc_id", F.posexplode(parts).alias("i", "line"))
    rows = rows.select("source", (F.col("doc_id") * 1_000_000 + F.col("i")).alias("line_no"), "line")
    return reports.scan_fasta(rows)


@query("scan_loop_db", """with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as r from lineitem)
 select l_orderkey::varchar as chain, r::int as res_no, 'A' as aa, l_returnflag as ss, round(radians(round(l_discount * 100, 2)), 6) as psi, round(radians(round(l_tax * 100, 2)), 6) as omega, round(radians(lead(round(l_quantity, 2)) over (partition by l_orderkey order by r)), 6) as phi from l
 qualify lead(r) over (partition by l_orderkey order by r) is not null""")
def scan_loop_db(spark, d):
    li = V.table(spark, d, "lineitem").withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")))
    line = F.format_string("%d A %s %d %.2f %.2f %.2f", "l_orderkey", "l_returnflag", "r", "l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100)
    rows = li.select(F.lit("x").alias("source"), F.col("r").alias("line_no"), line.alias("line"))
    return reports.scan_loops(rows).select("chain", "res_no", "aa", "ss", *[F.round(c, 6).alias(c) for c in ("psi", "omega", "phi")])


@query("scan_energy_log", "select 'conformer_' || o_orderkey::varchar as conformer, round(o_totalprice, 2) as energy from orders")
def scan_energy_log(spark, d):
    rows = V.table(spark, d, "orders").select(F.lit("log").alias("source"), F.format_string("conformer_%d,%.2f", "o_orderkey", "o_totalprice").alias("line"))
    return reports.scan_csv(rows, "conformer string, energy double").drop("source")


@query("scan_residue_csv", V.with_views("atoms") + "select structure_id::varchar as source, left(res_name, 1) as aa, 'L' as ss, round(x, 3) + 0.0 as x, round(y, 3) + 0.0 as y, round(z, 3) + 0.0 as z, serial::double as phi from atoms")
def scan_residue_csv(spark, d):
    a = V.atoms(spark, d)
    rows = a.select(F.col("structure_id").cast("string").alias("source"), F.format_string("%s,L,%.3f,%.3f,%.3f,%d", F.substring("res_name", 1, 1), "x", "y", "z", "serial").alias("line"))
    return reports.scan_csv(rows, "aa string, ss string, x double, y double, z double, phi double").withColumns({c: F.col(c) + 0.0 for c in "xyz"})


@query("scan_db_json", V.with_views("segments") + "select segment_id::varchar as segment_id, fasta, dssp, length(fasta)::int as n from segments")
def scan_db_json(spark, d):
    s = V.segments(spark, d).select("segment_id", "fasta", "dssp", F.transform(F.sequence(F.lit(1), F.length("fasta")), lambda i: i * 1.0).alias("phi"))
    return reports.scan_database(reports.to_database(s)).select("segment_id", "fasta", "dssp", F.size("phi").alias("n"))


@query("sink_db", V.with_views("segments") + "select segment_id::varchar as segment_id, length(fasta)::int as n from segments")
def sink_db(spark, d):
    s = V.segments(spark, d).select("segment_id", "fasta", "dssp")
    return reports.scan_database(reports.to_database(s, 100)).select("segment_id", F.length("fasta").alias("n"))


_E8 = "e8 as (select vec_id, list_transform(embedding[1:8], lambda v: round(abs(v::double), 4)) as p from embeddings)"


def eight_lines(spark, d):
    e = V.table(spark, d, "embeddings")
    cells = [F.format_string("%.4f", F.abs(F.element_at("embedding", i).cast("double"))) for i in range(1, 9)]
    return e.select(F.col("vec_id").cast("string").alias("source"), F.lit(0).alias("line_no"), F.concat_ws(" ", F.lit("  A"), F.col("vec_id").cast("string"), *cells).alias("line"))


@query("scan_chespi", f"with {_E8} select vec_id::varchar as source, vec_id::int as res_id, ['H', 'G', 'I', 'E', ' ', 'T', 'S', 'B'][i] as ss, p[i] as prob from e8, unnest(range(1, 9)) as t(i)")
def scan_chespi(spark, d):
    return reports.scan_eight(eight_lines(spark, d))


@query("scan_chespi_grouped", f"with {_E8} select vec_id::varchar as source, vec_id::int as res_id, k as ss, round(case k when 'L' then p[3] + p[5] + p[6] + p[7] + p[8] when 'H' then p[1] + p[2] else p[4] end, 4) as prob from e8, (values ('L'), ('H'), ('E')) as t(k)")
def scan_chespi_grouped(spark, d):
    return reports.scan_eight(eight_lines(spark, d), grouped=True)


def four_lines(spark, d):
    e = V.table(spark, d, "embeddings")
    cells = [F.format_string("%.3f", F.abs(F.element_at("embedding", i).cast("double"))) for i in range(1, 5)]
    i = F.col("vec_id").cast("string")
    line = F.when(F.col("vec_id") % 4 == 0, F.concat(F.lit("#"), i, F.lit(" none"))).when(F.col("vec_id") % 4 == 1, F.lit("# comment")).otherwise(F.concat_ws(" ", i, F.lit("A"), *cells, F.lit("L")))
    return e.select(i.alias("source"), F.lit(0).alias("line_no"), line.alias("line"))


_E4 = "e4 as (select vec_id, list_transform(embedding[1:4], lambda v: round(abs(v::double), 3)) as p from embeddings where vec_id % 4 <> 1)"


@query("scan_d2d", f"with {_E4} select vec_id::varchar as source, vec_id::int as res_id, ['H', 'E', ' ', 'P'][i] as ss, case when vec_id % 4 = 0 then 0.25 else p[i] end as prob from e4, unnest(range(1, 5)) as t(i)")
def scan_d2d(spark, d):
    return reports.scan_four(four_lines(spark, d))


@query("scan_d2d_grouped", f"with {_E4} select vec_id::varchar as source, vec_id::int as res_id, k as ss, case when vec_id % 4 = 0 then 0.333 when k = 'L' then round(p[3] + p[4], 3) when k = 'H' then p[1] else p[2] end as prob from e4, (values ('L'), ('H'), ('E')) as t(k)")
def scan_d2d_grouped(spark, d):
    return reports.scan_four(four_lines(spark, d), grouped=True)


@query("scan_xmer_probs", "with s as (select p_brand as source, p_size as size, count(*)::double as w from part group by all) select source, size, round(w / sum(w) over (partition by source), 6) as prob from s")
def scan_xmer_probs(spark, d):
    s = V.table(spark, d, "part").groupBy(F.col("p_brand").alias("source"), "p_size").agg(F.count(F.lit(1)).alias("w"))
    rows = s.select("source", F.col("p_size").alias("line_no"), F.format_string("%d %d", "p_size", "w").alias("line"))
    return reports.scan_sizes(rows).withColumn("prob", F.round("prob", 6))


@query("sink_csss", f"with {DQ._CSSS}, p as (select res_id, ss, weight::bigint as w from cs) select res_id, '{{' || string_agg('\"' || ss || '\":' || w::varchar, ',' order by ss) || '}}' as json from p group by res_id")
def sink_csss(spark, d):
    return reports.nested_probabilities(DQ.csss(spark, d).select("res_id", "ss", F.col("weight").cast("long").alias("prob")))


@query("sink_stats_csv", V.with_views("segments", more="x as (select k, substr(fasta, i + 1, k) as kmer from (select *, unnest(range(length(fasta))) as i from segments), (select unnest([1, 2, 3]) as k) where i + k <= length(fasta)), n as (select k, kmer, count(*) as n from x group by all)") +
       "select k::int as k, string_agg(kmer || ',' || n::varchar, chr(10) order by n desc, kmer) as lines from n group by k")
def sink_stats_csv(spark, d):
    return sinks.count_lines(kmers.kmer_counts(V.segments(spark, d), "fasta", SQ.KS))


@query("scan_tar", V.with_views("segments") + "select segment_id::varchar as source, fasta as sequence from segments")
def scan_tar(spark, d):
    """Archives of all segments, a member for each; read by their headers, then by ranges."""
    s = V.segments(spark, d).select(F.concat(F.col("segment_id").cast("string"), F.lit(".fasta")).alias("name"), F.concat_ws("\n", F.lit(">x"), "fasta").alias("text"))
    path = sinks.new_folder(spark, "tars")
    tars.write_tars(s, path)
    return reports.scan_fasta(L.split_tar_lines(L.read_tar(spark, path, ".fasta"))).select("source", "sequence")


def packed_segments(spark, d):
    """All segments, two lines each, in shards."""
    s = V.segments(spark, d).select(F.col("segment_id").alias("id"), F.concat_ws("\n", "fasta", F.replace("dssp", F.lit(" "), F.lit("-"))).alias("text"))
    path = sinks.new_folder(spark, "segments")
    packed.write_packed(s, path)
    return path


@query("sink_segments", V.with_views("segments") + "select segment_id, fasta as line from segments union all select segment_id, replace(dssp, ' ', '-') from segments")
def sink_segments(spark, d):
    texts = packed.read_packed(spark, packed_segments(spark, d))
    return texts.select(F.col("id").cast("long").alias("segment_id"), F.explode(F.split("text", "\n")).alias("line"))


@query("scan_existing_ids", V.with_views("segments") + "select segment_id::varchar as id from segments")
def scan_existing_ids(spark, d):
    return packed.offsets(spark, packed_segments(spark, d)).select("id")


@query("scan_corpus", V.with_views("segments") + "select segment_id::varchar as id, 1::bigint as files from segments")
def scan_corpus(spark, d):
    return packed.offsets(spark, packed_segments(spark, d)).groupBy("id").agg(F.count(F.lit(1)).alias("files"))


@query("scan_corpus_lists", V.with_views("segments") + "select doc_id::varchar as id, length(fasta)::int as n from labels left join segments on segment_id = doc_id where segment_id is not null union all select doc_id::varchar, -1 from labels where doc_id not in (select segment_id from segments) union all select 'missing' || item_id::varchar, -1 from benchmark")
def scan_corpus_lists(spark, d):
    """The texts that two list files name, and, with -1, what they name and is not there."""
    path = packed_segments(spark, d)
    lists = [sinks.new_folder(spark, "list") for _ in range(2)]
    V.table(spark, d, "labels").select(F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("value")).write.text(lists[0])
    V.table(spark, d, "benchmark").select(F.concat(F.lit("missing"), F.col("item_id").cast("string")).alias("value")).write.text(lists[1])
    found, missing = packed.resolve(spark, path, lists)
    texts = packed.read_packed(spark, path, found).select("id", F.length(F.substring_index("text", "\n", 1)).alias("n"))
    return texts.unionByName(missing.select("id", F.lit(-1).alias("n")))


@query("sink_db_object", V.with_views("segments") + "select segment_id::varchar as segment_id, fasta, dssp, length(fasta)::int as n from segments")
def sink_db_object(spark, d):
    """All segments as one JSON object over several files, read back by ranges of bytes."""
    path = sinks.new_folder(spark, "database")
    json_objects.write_object(V.segments(spark, d), path, more={"phi": F.transform(F.sequence(F.lit(1), F.length("fasta")), lambda i: i * 1.0)})
    found, _ = json_objects.scan_object(spark, path, whole="folder", glob="part-*")
    return found.select("segment_id", "fasta", "dssp", F.size("phi").alias("n"))


@query("sink_database", V.with_views("segments") + "select segment_id, fasta, dssp from segments")
def sink_database(spark, d):
    """Records in the native form."""
    path = sinks.new_folder(spark, "records")
    sinks.write_database(V.segments(spark, d), path)
    return spark.read.parquet(path)


@query("sink_counts_csv", V.with_views("segments", more="x as (select k, substr(fasta, i + 1, k) as kmer from (select *, unnest(range(length(fasta))) as i from segments), (select unnest([1, 2, 3]) as k) where i + k <= length(fasta))") + "select k::int as k, kmer, count(*) as n from x group by all")
def sink_counts_csv(spark, d):
    """Counts as CSV files, a folder for each size."""
    path = sinks.new_folder(spark, "counts")
    sinks.write_counts(kmers.kmer_counts(V.segments(spark, d), "fasta", SQ.KS), path)
    return spark.read.option("header", True).schema("kmer string, n bigint, k int").csv(path)


_TERMINALS = """atm as (select p_brand as residue, p_type as type, round(p_retailprice, 2) as charge from part union all select 'N' || p_brand, p_type, round(p_retailprice, 2) + 1 from part where right(p_brand, 1) in ('1', '3')),
 nb as (select distinct p_type as type, length(p_type) / 10.0 as sigma from part), wa as (select p_partkey, p_brand as residue, ['', 'N', 'C'][p_partkey % 3 + 1] as terminal from part),
 us as (select *, case when terminal || residue in (select residue from atm) then terminal || residue else residue end as used from wa)"""


@query("scan_forcefield_file", f"with {_TERMINALS}, sums as (select residue, count(*) as n, round(sum(charge), 2) as charge, round(sum(sigma), 2) as sigma from atm join nb using (type) group by residue) select p_partkey, used, n, charge, sigma from us join sums on sums.residue = used")
def scan_forcefield_file(spark, d):
    """A force-field file with residues, terminal variants of some, and non-bonded values: the atoms of each wanted residue."""
    p = V.table(spark, d, "part")
    path = sinks.new_folder(spark, "forcefield")
    both = F.explode(F.array(F.lit(""), F.lit("N"))).alias("t")
    atom = F.format_string('<Atom name="A%d" type="%s" charge="%.2f"/>', "p_partkey", "p_type", F.col("p_retailprice") + F.when(F.col("t") == "N", 1).otherwise(0))
    rows = p.select("*", both).filter((F.col("t") == "") | F.expr("right(p_brand, 1)").isin("1", "3"))
    rows = rows.groupBy(F.concat("t", "p_brand").alias("r"), (F.col("p_partkey") % 100).alias("g")).agg(F.array_join(F.collect_list(atom), "").alias("a"))
    values = p.select("p_type").distinct().select(F.format_string('<NonbondedForce><Atom type="%s" sigma="%.1f" epsilon="0.5"/></NonbondedForce>', "p_type", F.length("p_type") / 10).alias("value"))
    rows.select(F.format_string('<Residue name="%s">%s</Residue>', "r", "a").alias("value")).unionByName(values).write.text(path)
    atoms, bonded = structures.scan_forcefield(spark, path)
    wanted = p.select(F.col("p_brand").alias("residue"), F.element_at(F.array(F.lit(""), F.lit("N"), F.lit("C")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("terminal")).distinct()
    used = structures.terminal_atoms(wanted, atoms.join(bonded, "type")).groupBy("residue", "terminal", "used").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("charge"), 2).alias("charge"), F.round(F.sum("sigma"), 2).alias("sigma"))
    parts = p.select("p_partkey", F.col("p_brand").alias("residue"), F.element_at(F.array(F.lit(""), F.lit("N"), F.lit("C")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("terminal"))
    return parts.join(used, ["residue", "terminal"]).select("p_partkey", "used", "n", "charge", "sigma")


@query("scan_forcefield", "select p_brand as residue, 'A' || p_partkey::varchar as atom, p_type as type, round(p_retailprice, 2) as charge from part")
def scan_forcefield(spark, d):
    atom = F.format_string('<Atom name="A%d" type="%s" charge="%.2f"/>', "p_partkey", "p_type", "p_retailprice")
    parts = V.table(spark, d, "part").withColumn("g", F.col("p_partkey") % 100)  # an element of bounded size
    texts = parts.groupBy("p_brand", "g").agg(F.concat(F.lit('<Residue name="'), F.first("p_brand"), F.lit('">'), F.array_join(F.collect_list(atom), ""), F.lit("</Residue>")).alias("xml"))
    return structures.parse_residues(texts)
