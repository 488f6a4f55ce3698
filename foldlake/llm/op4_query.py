"""op4_quality: the quality of every document; one quarter by crc32 of the id is never learnt from."""

from pyspark.sql import functions as F

from .common import read, remainder
from .quality import fit, score


def op4_quality(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rest = remainder(F.col("doc_id"), 4)
    model = fit(docs, labels.filter(rest != 2))
    return score(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": rest == 2})


QUERIES = {"op4_quality": op4_quality}
