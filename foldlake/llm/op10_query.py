"""op10_language_id: the language of every document; one fifth by crc32 of the id is never learnt from."""

from pyspark.sql import functions as F

from .common import read, remainder
from .language_id import fit, predict


def op10_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rest = remainder(F.col("doc_id"), 5)
    model = fit(docs.filter(rest != 0))
    return predict(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": rest == 0})


QUERIES = {"op10_language_id": op10_language_id}
