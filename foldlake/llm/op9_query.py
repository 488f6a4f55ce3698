"""op9_topk: the 20 best inner products of every twentieth vector against all others."""

from pyspark.sql import functions as F

from .common import read
from .topk import quantised, top_k


def op9_topk(spark, sf_dir):
    return top_k(quantised(read(spark, sf_dir, "embeddings"), scale=64), F.col("id") % 20 == 0, k=20)


QUERIES = {"op9_topk": op9_topk}

ORACLE = {"op9_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0 and vec_id is not null
), s as (
  select a.vec_id as query_id, b.vec_id, list_dot_product(a.q::double[], b.q::double[])::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""}
