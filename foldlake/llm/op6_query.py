"""op6_warc: all pages to WARC archives and back."""

from .common import read
from .warc import archive_pages


def op6_warc(spark, sf_dir):
    return archive_pages(read(spark, sf_dir, "pages")).drop("error")


QUERIES = {"op6_warc": op6_warc}

ORACLE = {"op6_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as payload_bytes, sha1(h) as payload_digest from p),
g as (select payload_digest, max(page_id) as first from d where payload_bytes >= 1000 group by payload_digest having count(*) > 1)
select page_id, payload_bytes, payload_digest, case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when first is not null and page_id is distinct from first then first end as refers_to
from d left join g using (payload_digest)
"""}
