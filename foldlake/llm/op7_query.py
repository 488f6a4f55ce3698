"""op7_decontamination: every document against the benchmark."""

from pyspark.sql import functions as F

from .common import read
from .decontaminate import contamination


def op7_decontamination(spark, sf_dir):
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op7_decontamination": op7_decontamination}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = {"op7_decontamination": f"""
with dw as (select doc_id, {_WORDS} as w from documents), iw as (select item_id, {_WORDS} as w from benchmark),
win as (select item_id, k, array_to_string(w[i + 1:i + k], ' ') as s from (select *, unnest(range(len(w) - k + 1)) as i from (select *, least(13, len(w)) as k from iw where len(w) > 0))),
ks as (select distinct k from win),
dwin as (select doc_id, i, k, array_to_string(w[i + 1:i + k], ' ') as s from (select doc_id, w, k, unnest(range(len(w) - k + 1)) as i from dw, ks where len(w) >= k)),
hit as (select doc_id, i, dwin.k, item_id from dwin join win on win.k = dwin.k and win.s = dwin.s),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) as contaminated
from dw left join n using (doc_id) left join it using (doc_id)
"""}
