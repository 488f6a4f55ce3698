"""op8_best_fit_packing: all documents packed into sequences of 2048 tokens; gap says by how many sequences a piece's partition may exceed its bound."""

import public_tokenizers

from .common import read
from .packing import pack, tokenise

TOKENIZER = "word_bpe_49k.json"


def op8_best_fit_packing(spark, sf_dir):
    pieces = tokenise(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), size=2048)
    return pack(pieces, size=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap")


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
