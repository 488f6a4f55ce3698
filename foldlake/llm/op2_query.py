"""op2_pii: personal data in every document."""

from pyspark.sql import functions as F

from .common import read
from .pii import find_pii, joined


def op2_pii(spark, sf_dir):
    found = find_pii(read(spark, sf_dir, "documents"))
    every = F.array_sort(F.concat("base", "terms"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))


QUERIES = {"op2_pii": op2_pii}
