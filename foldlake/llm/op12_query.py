"""op12_lm_scoring: log probabilities of every document under the model of nine tenths of them."""

from pyspark.sql import functions as F

from .common import read, remainder
from .kneser_ney import fit, score


def op12_lm_scoring(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rest = remainder(F.col("doc_id"), 10)
    model = fit(docs.filter(rest != 0))
    rows = score(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": rest == 0})
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op12_lm_scoring": op12_lm_scoring}
