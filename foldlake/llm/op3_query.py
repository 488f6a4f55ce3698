"""op3_toxicity: the toxicity of every document; one fifth by crc32 of the id is never learnt from."""

from pyspark.sql import functions as F

from .common import read, remainder
from .toxicity import fit, score


def op3_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rest = remainder(F.col("doc_id"), 5)
    model = fit(docs, labels.filter(rest != 0), rest != 0)
    return score(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": rest == 0})


QUERIES = {"op3_toxicity": op3_toxicity}
