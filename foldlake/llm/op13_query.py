"""op13_vector_codes: product codes of all vectors, with their errors and the codebooks' digest."""

from pyspark.sql import functions as F

from .codes import compress, with_group_sum
from .common import read


def op13_vector_codes(spark, sf_dir):
    found = compress(read(spark, sf_dir, "embeddings"), keep={"vec_id": F.col("vec_id"), "label": F.col("label")})
    rows = with_group_sum(found.rows, "label", "error", "label_error")
    digits = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return rows.select("vec_id", digits.alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


QUERIES = {"op13_vector_codes": op13_vector_codes}

_ROUND = """near{i} as (select id, p, v, arg_min(e, d * 64 + e) as e, min(d) as d from (
  select k.id, k.p, k.v, b.e, list_sum(list_transform(range(len(k.v)), lambda j: (k.v[j + 1] - b.w[j + 1]) * (k.v[j + 1] - b.w[j + 1])))::bigint as d from parts k join book{i} b on b.p = k.p) group by id, p, v)"""
_BOOK = """sums{i} as (select p, e, j, floor(sum(x)::double / count(*))::bigint as x from (select p, e, unnest(range(len(v))) as j, unnest(v) as x from near{i}) group by p, e, j),
means{i} as (select p, e, list(x order by j) as w from sums{i} group by p, e),
book{n} as (select b.p, b.e, coalesce(m.w, b.w) as w from book{i} b left join means{i} m on m.p = b.p and m.e = b.e)"""

ORACLE = {"op13_vector_codes": """
with kept as (
  select vec_id as id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), parts as (select id, p, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] as v from kept, unnest(range(16)) as t(p)),
firsts as (select id, row_number() over (order by id) - 1 as e from kept qualify e < 64),
book0 as (select p, e, v as w from parts join firsts using (id)),
""" + ",\n".join(x for i in range(2) for x in (_ROUND.format(i=i), _BOOK.format(i=i, n=i + 1))) + ",\n" + _ROUND.format(i=2) + """,
coded as (select id, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from near2 group by id),
labelled as (select label, sum(error)::bigint as label_error from coded join kept using (id) group by label),
digest as (select sha256(string_agg(x::varchar, ',' order by p, e, j)) as codebooks_sha256 from (select p, e, unnest(range(len(w))) as j, unnest(w) as x from book2))
select id as vec_id, code, error, label_error, codebooks_sha256 from coded join kept using (id) join labelled l on l.label is not distinct from kept.label, digest
"""}
