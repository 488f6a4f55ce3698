"""op5_jaccard_join: groups of documents by the Jaccard similarity of three-word shingles, at 0.9 or more, and the number
of documents that each is linked with."""

from .common import read
from .jaccard import similar_groups


def op5_jaccard_join(spark, sf_dir):
    return similar_groups(read(spark, sf_dir, "documents"), n=3, num=90, den=100, count_links=True).drop("_t")


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
