"""op11_resampling: weights of all documents towards the benchmark's distribution of n-grams, and a quarter drawn by them."""

from pyspark.sql import functions as F

from .common import LOWER, UPPER, read
from .resample import resample


def op11_resampling(spark, sf_dir):
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep={"doc_id": F.col("doc_id")})


QUERIES = {"op11_resampling": op11_resampling}

# The CRC's table follows from its polynomial; its steps are folds over the bytes of a feature.
_GRAMS = """{name}w as (select {id}, i, w from (select {id}, unnest(ws) as w, unnest(range(len(ws))) as i from
  (select {id}, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from {table}))),
{name} as (select {id}, w as g from {name}w union all select {id}, w || ' ' || after as g from (select {id}, w, lead(w) over (partition by {id} order by i) as after from {name}w) where after is not null)"""

ORACLE = {"op11_resampling": f"""
with {_GRAMS.format(name="d", id="doc_id", table="documents", upper=UPPER, lower=LOWER)},
{_GRAMS.format(name="b", id="item_id", table="benchmark", upper=UPPER, lower=LOWER)},
crc as (select list(list_reduce(range(8), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t from range(256) as r(i)),
bytes as (select g, list_transform(range(octet_length(encode(g))), lambda k: ('0x' || substr(hex(encode(g)), (2 * k + 1)::int, 2))::bigint) as x from (select g from d union select g from b)),
buckets as (select g, xor(list_reduce(x, lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1]), 4294967295::bigint), 4294967295) % 10000 as k from bytes, crc),
s as (select k, count(*) as n from d join buckets using (g) group by k), t as (select k, count(*) as n from b join buckets using (g) group by k),
sums as (select (select count(*) from d)::double as s_all, (select count(*) from b)::double as t_all),
gains as (select s.k, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (s_all + 10000) / ((s.n + 1)::double * (t_all + 10000))))::bigint as gain from s left join t using (k), sums),
w as (select doc_id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from d join buckets using (g) join gains using (k) group by doc_id),
z as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(n_words, 0) as n_words,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from documents left join w using (doc_id) left join (select doc_id, count(*) as n_words from dw group by doc_id) using (doc_id)),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from z where n_words >= 20)
select doc_id, n_features::bigint as n_features, weight, score, case when rank <= 25 * (select count(*) from r) // 100 then rank end as rank from z left join r using (doc_id)
"""}
