"""Queries on sequences, labels and k-mers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import residues as R
from ..functions import tolerance
from ..operators import islands, kmer_index, kmers
from . import views as V
from .registration import Registry

REGISTRY = Registry()
query = REGISTRY.query
QUERY_SEQ = "THEANDINGERATENTHATTIREHASTEN"
KS = [1, 2, 3]
_QK = "q as (select distinct k, substr('{q}', i + 1, k) as kmer from (select unnest([{ks}]) as k), (select unnest(range({n})) as i) where i + k <= {n})"


def _qk(q=QUERY_SEQ, ks=KS):
    return _QK.format(q=q, n=len(q), ks=", ".join(map(str, ks)))


_RUNS = """lab as (select user_id, pos, translate(ss, 'HGETS BIP', 'HHELLLLLL') as c from ss),
isl as (select *, pos - row_number() over (partition by user_id, c order by pos) as g from lab),
runs as (select user_id, c, min(pos) as start, max(pos) + 1 as stop, count(*) as length from isl group by user_id, c, g)"""


def _runs(spark, d):
    return islands.label_runs(V.ss(spark, d).withColumn("c", R.reduce_ss(F.col("ss"))), ["user_id"], "pos", "c")


@query("reduce_ss", V.with_views("segments") + "select segment_id, translate(dssp, 'HGETS BIP', 'HHELLLLLL') as reduced, translate(dssp, ' ', '-') as report from segments")
def reduce_ss(spark, d):
    return V.segments(spark, d).select("segment_id", R.reduce_ss(F.col("dssp")).alias("reduced"), R.report_ss(F.col("dssp")).alias("report"))


@query("validate_fasta", """select doc_id, coalesce(regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWYpedst]+') and upper(s) = s, false) as valid,
 list_sort(list_distinct(list_filter(string_split(s, ''), lambda c: not contains('ACDEFGHIKLMNPQRSTVWYpedst', c)))) as unknown
 from (select doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') as s from documents)""")
def validate_fasta(spark, d):
    s = F.regexp_replace("text", "[^A-Za-z]", "")
    docs = V.table(spark, d, "documents").select("doc_id", s.alias("s"))
    return docs.select("doc_id", R.valid_fasta(F.col("s")).alias("valid"), R.unknown_residues(F.col("s")).alias("unknown"))


@query("remap_sequence", V.with_views("seqs") + "select doc_id, regexp_replace(seq, '[^PG]', 'A', 'g') as remapped from seqs")
def remap_sequence(spark, d):
    return V.seqs(spark, d).select("doc_id", R.remap(F.col("seq")).alias("remapped"))


@query("split_chunks", V.with_views("seqs") + """select doc_id, i as chunk, substr(seq, i * 150 + 1, 150) as part,
 case when i > 0 then substr(seq, i * 150 - 1, 2) else '' end || substr(seq, i * 150 + 1, 150) as overlapped
 from seqs, unnest(range((length(seq) + 149) // 150)) as t(i)""")
def split_chunks(spark, d):
    n = F.ceil(F.length("seq") / 150).cast("int")
    s = V.seqs(spark, d).filter(F.length("seq") > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    part = F.substring(F.col("seq"), F.col("chunk") * 150 + 1, F.lit(150))
    last = F.when(F.col("chunk") > 0, F.substring(F.col("seq"), F.col("chunk") * 150 - 1, F.lit(2))).otherwise("")
    return s.select("doc_id", "chunk", part.alias("part"), F.concat(last, part).alias("overlapped"))


@query("split_ranges", V.with_views("seqs") + """select doc_id, r.k, substr(seq, r.a + 1, coalesce(least(r.b, length(seq)), length(seq)) - r.a) as part
 from seqs, (values (0, 0, 10), (1, 10, 50), (2, 50, null)) as r(k, a, b) where length(seq) > r.a""")
def split_ranges(spark, d):
    r = spark.createDataFrame([(0, 0, 10), (1, 10, 50), (2, 50, None)], "k int, a int, b int")  # null: to the end
    s = V.seqs(spark, d).join(F.broadcast(r), F.length("seq") > F.col("a"))
    return s.select("doc_id", "k", F.substring(F.col("seq"), F.col("a") + 1, F.least("b", F.length("seq")) - F.col("a")).alias("part"))


@query("trimer_context", V.with_views("segments") + """select segment_id, i::int as pos, aa, coalesce(lag(aa) over o, 'G') || coalesce(lead(aa) over o, 'G') as pair, coalesce(lead(aa) over o, '') as next_residue
 from (select segment_id, unnest(range(length(fasta))) as i, unnest(string_split(fasta, '')) as aa from segments) window o as (partition by segment_id order by i)""")
def trimer_context(spark, d):
    s = V.segments(spark, d).select("segment_id", R.letters(F.col("fasta")).alias("l"))
    near = lambda i: F.coalesce(F.get("l", i), F.lit("G"))
    before = lambda i: F.when(i == 0, "G").otherwise(near(i - 1))
    x = F.transform("l", lambda c, i: F.struct(i.alias("pos"), c.alias("aa"), F.concat(before(i), near(i + 1)).alias("pair"), F.coalesce(F.get("l", i + 1), F.lit("")).alias("next_residue")))
    return s.select("segment_id", F.explode(x).alias("x")).select("segment_id", "x.*")


@query("next_residue", V.with_views("segments") + "select segment_id, i::int as pos, substr(fasta, i + 2, 1) as following from segments, unnest(range(length(fasta) - 1)) as t(i) where length(fasta) > 1")
def next_residue(spark, d):
    return trimer_context(spark, d).filter("next_residue <> ''").select("segment_id", "pos", F.col("next_residue").alias("following"))


@query("seq_chunk", V.with_views("segments") + "select segment_id, substr(fasta, 3, 5) as chunk, substr(fasta, 8, 1) as following from segments")
def seq_chunk(spark, d):
    return V.segments(spark, d).select("segment_id", F.substring("fasta", 3, 5).alias("chunk"), F.substring("fasta", 8, 1).alias("following"))


@query("drop_empty", V.with_views("seqs") + "select doc_id, length(seq) as n from seqs where length(seq) > 0")
def drop_empty(spark, d):
    return V.seqs(spark, d).filter(F.length("seq") > 0).select("doc_id", F.length("seq").cast("long").alias("n"))


@query("substitute_pattern", V.with_views("segments") + """select segment_id, list_aggregate(list_transform(string_split(fasta, ''), lambda c: case c when 'S' then '[SE]' when 'A' then '[AVG]' else c end), 'string_agg', '') as pattern
 from segments""")
def substitute_pattern(spark, d):
    return V.segments(spark, d).select("segment_id", R.substitute(F.col("fasta"), {"S": "E", "A": "VG"}).alias("pattern"))


@query("label_runs", V.with_views("ss", more="isl as (select *, pos - row_number() over (partition by user_id, ss order by pos) as g from ss)") +
       "select user_id, ss, min(pos)::bigint as start, (max(pos) + 1)::bigint as stop, count(*) as length from isl group by user_id, ss, g")
def label_runs(spark, d):
    r = islands.label_runs(V.ss(spark, d), ["user_id"], "pos", "ss")
    return r.select("user_id", "ss", *[F.col(c).cast("long").alias(c) for c in ("start", "stop", "length")])


@query("int_runs", """with o as (select distinct o_custkey, o_orderkey from orders), g as (select *, case when o_orderkey - lag(o_orderkey) over w > 2 then 1 else 0 end as gap from o window w as (partition by o_custkey order by o_orderkey)),
 r as (select *, sum(gap) over (partition by o_custkey order by o_orderkey) as run from g) select o_custkey, min(o_orderkey) as first, max(o_orderkey) + 1 as last, count(*) as n from r group by o_custkey, run""")
def int_runs(spark, d):
    return islands.int_runs(V.table(spark, d, "orders").select("o_custkey", "o_orderkey").distinct(), ["o_custkey"], "o_orderkey", 2)


@query("ss_size_filter", V.with_views("ss", more=_RUNS) + "select user_id, start::bigint as start, stop::bigint as stop from runs where c = 'L' and length between 3 and 8")
def ss_size_filter(spark, d):
    r = islands.sized_runs(_runs(spark, d), "c", "L", 3, 8)
    return r.select("user_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query("ss_sandwich", V.with_views("ss", more=_RUNS + """, w as (select *, lag(c) over w as pc, lag(length) over w as pl, lag(start) over w as ps, lead(c) over w as nc, lead(length) over w as nl, lead(stop) over w as ns
 from runs window w as (partition by user_id order by start))""") + "select user_id, ps::bigint as start, ns::bigint as stop from w where c = 'H' and length >= 1 and pc = 'L' and nc = 'L' and pl >= 2 and nl >= 2")
def ss_sandwich(spark, d):
    r = islands.sandwiches(_runs(spark, d), ["user_id"], "c", "H", "L", 1, 2)
    return r.select("user_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query("class_windows", V.with_views("ss", more=_RUNS) + """select user_id, c, k::int as k, (start + o)::bigint as start, (start + o + k)::bigint as stop from runs, unnest(range(2, 5)) as t(k), unnest(range(0, length::bigint)) as s(o) where o + k <= length""")
def class_windows(spark, d):
    r = islands.class_windows(_runs(spark, d), ["user_id"], "c", 2, 4)
    return r.select("user_id", "c", "k", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query("pattern_windows", V.with_views("segments") + """select segment_id, o::int as start, (o + 4)::int as stop from (select segment_id, dssp, unnest(range(length(dssp) - 3)) as o from segments where length(dssp) >= 4)
 where regexp_full_match(substr(dssp, o + 1, 4), 'H[^E]{2}H|[TS ]+')""")
def pattern_windows(spark, d):
    return islands.pattern_windows(V.segments(spark, d).select("segment_id", "dssp"), "dssp", "H[^E]{2}H|[TS ]+", 4).select("segment_id", "start", "stop")


_PURE = "regexp_full_match(translate(dssp, 'HGETS BIP', 'HHELLLLLL'), '[L]+|[HE]+')"


@query("pure_class_filter", V.with_views("segments", more="w as (select segment_id, o::int as start, substr(dssp, o + 1, 3) as dssp from (select *, unnest(range(length(dssp) - 2)) as o from segments where length(dssp) >= 3))") + f"select segment_id, start from w where {_PURE}")
def pure_class_filter(spark, d):
    return kmers.pure_windows(_reduced(spark, d), "segment_id", "dssp", 3, ["L", "HE"])


@query("kmer_distinct", V.with_views("seqs") + "select k, count(distinct substr(seq, i + 1, k)) as n from (select *, unnest(range(length(seq))) as i from seqs), (select unnest([1, 2, 3]) as k) where i + k <= length(seq) group by k")
def kmer_distinct(spark, d):
    return kmers.distinct_kmers(V.seqs(spark, d), "seq", KS)


_PURE_RUNS = """lab as (select segment_id, unnest(range(length(fasta))) as pos, unnest(string_split(fasta, '')) as aa, unnest(string_split(translate(dssp, 'HGETS BIP', 'HHELLLLLL'), '')) as c from segments),
isl as (select *, pos - row_number() over (partition by segment_id, c order by pos) as g from lab),
pr as (select string_agg(aa, '' order by pos) as s from isl where c in ('L', 'H') group by segment_id, c, g)"""


@query("kmer_hits", V.with_views("segments", more=_PURE_RUNS + ", " + _qk() + """, h as (select k, substr(s, i + 1, k) as kmer from (select s, unnest(range(length(s))) as i from pr), (select unnest([1, 2, 3]) as k) where i + k <= length(s))""") +
       "select q.k::int as k, q.kmer, count(h.kmer) as n from q left join h using (k, kmer) group by q.k, q.kmer")
def kmer_hits(spark, d):
    """The flagship: hits of a query's k-mers within pure runs of loops or helices."""
    return kmers.kmer_hits(spark, _reduced(spark, d), "fasta", "dssp", "LH", QUERY_SEQ, KS)


@query("sort_hits", REGISTRY.sql["kmer_hits"] + " order by n desc, kmer")
def sort_hits(spark, d):
    return kmer_hits(spark, d).orderBy(F.desc("n"), "kmer")


@query("db_summary", V.with_views("seqs") + "select count(*) as chains, sum(length(seq))::bigint as residues from seqs where length(seq) > 0")
def db_summary(spark, d):
    return V.seqs(spark, d).filter(F.length("seq") > 0).agg(F.count(F.lit(1)).alias("chains"), F.sum(F.length("seq")).cast("long").alias("residues"))


_INDEX = """ch as (select segment_id, unnest(range(length(fasta))) as i, unnest(string_split(fasta, '')) as a, unnest(string_split(dssp, '')) as s from reduced),
w as (select segment_id, i::int as i, a || coalesce(lead(a, 1) over o, '') || coalesce(lead(a, 2) over o, '') || coalesce(lead(a, 3) over o, '') as aa,
 s || coalesce(lead(s, 1) over o, '') || coalesce(lead(s, 2) over o, '') || coalesce(lead(s, 3) over o, '') as ss from ch window o as (partition by segment_id order by i)),
h as (select w.*, q.k, kmer from w, q where left(aa, q.k) = kmer),
p as (select *, false as followed_by_pro, i + k as stop from h union all select *, true, i + k + 1 from h where substr(aa, k + 1, 1) = 'P'),
f as (select k::int as k, kmer, followed_by_pro, ss_class, segment_id, i as start, stop::int as stop from p, (values ('L'), ('H'), ('E')) as c(ss_class) where replace(left(ss, stop - i), ss_class, '') = '')"""
_REDUCED = "reduced as (select segment_id, fasta, translate(dssp, 'HGETS BIP', 'HHELLLLLL') as dssp from segments)"


def _reduced(spark, d):
    return V.segments(spark, d).withColumn("dssp", R.reduce_ss(F.col("dssp")))


@query("fragment_index", V.with_views("segments", more=f"{_REDUCED}, {_qk()}, {_INDEX}") + "select * from f")
def fragment_index(spark, d):
    return kmers.fragment_index(_reduced(spark, d), kmers.query_kmers(spark, QUERY_SEQ, KS), KS, ["L", "H", "E"])


def stored_index(spark, d):
    """An index of all segments, written into the shared folder."""
    return kmer_index.build(_reduced(spark, d), KS, ["L", "H", "E"])


@query("fragment_index_stored", REGISTRY.sql["fragment_index"])
def fragment_index_stored(spark, d):
    """The same fragments, from a stored index: only the folders and row groups of the query's k-mers are read."""
    index = stored_index(spark, d)
    return kmer_index.fragments(kmer_index.places(index.blocks(spark, kmers.kmer_list(QUERY_SEQ, KS)), index), index)


@query("csss_index", V.with_views("segments", more=f"{_REDUCED}, {_qk()}, {_INDEX}") + "select k, kmer, followed_by_pro, ss_class, count(*) as n, min(printf('%012d:%09d', segment_id, start)) as first from f group by all")
def csss_index(spark, d):
    place = F.struct("segment_id", "start")
    plain = F.col("segment_id").between(0, 10**12 - 1) & F.col("start").between(0, 10**9 - 1)  # of which the order of numbers is that of texts
    text = lambda c: F.format_string("%012d:%09d", *c)
    found = fragment_index_stored(spark, d).groupBy("k", "kmer", "followed_by_pro", "ss_class").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(plain, place)).alias("p"), F.min(F.when(~plain, text(["segment_id", "start"]))).alias("odd"))
    return found.select("k", "kmer", "followed_by_pro", "ss_class", "n", F.least(F.when(F.col("p").isNotNull(), text(["p.segment_id", "p.start"])), "odd").alias("first"))


TOLERANCES = {"close": tolerance.by_score((5, 3, 2)), "every": tolerance.by_score(), "preset": tolerance.PRESETS["idp1"]}
CLOSE = tolerance.allowed(TOLERANCES["close"], R.AMINO)


def _others(table):
    return "map {" + ", ".join(f"'{aa}': '{others}'" for aa, others in tolerance.allowed(table, R.AMINO).items()) + "}"


@query("tolerance_table", V.with_views("seqs", more="n as (select c as aa, count(*) as n from (select unnest(string_split(seq, '')) as c from seqs) where c <> '' group by c)") +
       "select aa, n, " + ", ".join(f"map_extract({_others(t)}, aa)[1] as {name}" for name, t in TOLERANCES.items()) + " from n")
def tolerance_table(spark, d):
    """Residues with their substitutes by the matrix's upper columns, by all of them, and by the preset."""
    out = V.seqs(spark, d).select(F.explode(R.letters(F.col("seq"))).alias("aa")).groupBy("aa").agg(F.count(F.lit(1)).alias("n"))
    for name, table in TOLERANCES.items():
        t = tolerance.allowed_table(spark, table, R.AMINO).groupBy("aa").agg(F.array_join(F.array_sort(F.collect_set("other")), "").alias(name))
        out = out.join(F.broadcast(t), "aa")  # a row for each residue
    return out


_ALLOWED = "allowed as (select * from (values " + ", ".join(f"('{a}', '{b}')" for a, others in CLOSE.items() for b in others) + ") as t(aa, other))"


@query("tolerance_join", V.with_views("segments", more=f"{_ALLOWED}, {_qk(ks=[3])}" + """, ch as (select segment_id, unnest(range(length(fasta))) as i, unnest(string_split(fasta, '')) as a from segments),
 w as (select segment_id, i, a || lead(a, 1) over o || lead(a, 2) over o as found from ch window o as (partition by segment_id order by i))""") + """select q.k::int as k, q.kmer, w.segment_id, w.i::int as start from q,
 allowed a, allowed b, allowed c, w where a.aa = substr(q.kmer, 1, 1) and b.aa = substr(q.kmer, 2, 1) and c.aa = substr(q.kmer, 3, 1) and a.other || b.other || c.other = w.found""")
def tolerance_join(spark, d):
    return kmers.tolerant_hits(V.segments(spark, d), kmers.query_kmers(spark, QUERY_SEQ, [3]), tolerance.allowed_table(spark, TOLERANCES["close"], R.AMINO), [3])


@query("seed_extend", V.with_views("seqs") + f"""select doc_id as segment_id, qi::int as q_start, ti::int as start, n::int as size, 0 as mismatches
 from (select *, unnest(range(length(seq) - 2)) as ti from seqs where length(seq) >= 3), (select unnest(range({len(QUERY_SEQ)} - 2)) as qi), (select unnest(range(3, {len(QUERY_SEQ)} + 1)) as n)
 where qi + n <= {len(QUERY_SEQ)} and substr(seq, ti + 1, n) = substr('{QUERY_SEQ}', qi + 1, n) and substr(seq, ti + 1, 3) = substr('{QUERY_SEQ}', qi + 1, 3)""")
def seed_extend(spark, d):
    return kmers.seed_extend(V.seqs(spark, d).select(F.col("doc_id").alias("segment_id"), F.col("seq").alias("fasta")), QUERY_SEQ)


@query("seed_extend_mismatch", V.with_views("segments").replace("with ", "with recursive ", 1).rstrip() + f""",
 ch as (select segment_id, length(fasta) as n, unnest(range(length(fasta))) as i, unnest(string_split(fasta, '')) as a from segments),
 w as (select segment_id, i, a || lead(a, 1) over o || lead(a, 2) over o as seed from ch window o as (partition by segment_id order by i)),
 e as (select w.segment_id, qi as q_start, w.i as start, 3::bigint as size, 0::bigint as mismatches from w, (select unnest(range({len(QUERY_SEQ)} - 2)) as qi) where seed = substr('{QUERY_SEQ}', qi + 1, 3)
  union all select e.segment_id, q_start, start, size + 1, mismatches + case when a = substr('{QUERY_SEQ}', q_start + size + 1, 1) then 0 else 1 end from e join ch on ch.segment_id = e.segment_id and ch.i = start + size
  where q_start + size < {len(QUERY_SEQ)} and (a = substr('{QUERY_SEQ}', q_start + size + 1, 1) or ceil(100 * (mismatches + 1)::double / (size + 1)) <= 25))
 select segment_id, q_start::int as q_start, start::int as start, size::int as size, mismatches::int as mismatches from e""")
def seed_extend_mismatch(spark, d):
    return kmers.seed_extend(V.segments(spark, d), QUERY_SEQ, max_percent=25)


@query("parameter_strings", "select vec_id, (vec_id % 7)::varchar as size, coalesce(label::varchar, '') as label from embeddings")
def parameter_strings(spark, d):
    """Parameters of strings like ``size=1 label=0 size=3``: the last of a name counts."""
    text = F.format_string("size=%d label=%s  size=%d", F.col("vec_id") % 5, F.coalesce(F.col("label").cast("string"), F.lit("")), F.col("vec_id") % 7)
    m = R.parameters(text)
    return V.table(spark, d, "embeddings").select("vec_id", m["size"].alias("size"), m["label"].alias("label"))
