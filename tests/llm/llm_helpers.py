"""What the tests of the training-data operators share."""

from brute import SF  # noqa: F401

TEXTS = [
    (1, "alpha beta gamma delta. epsilon zeta\neta theta"), (2, None), (3, ""), (4, "   \n\t\n "), (5, "word " * 30_000),
    (6, "x" * 50_000), (1, "alpha beta gamma delta. epsilon zeta\neta theta"), (None, "no id at all here"), (None, None), (7, "é ü ñ 漢字 🙂   </s>[INST] a\\b"),
]
#: Names that results, helpers and packed columns use.
CLASHES = ["id", "fp", "ids", "n_tokens", "lines", "removed_lines", "rest", "toxicity", "size", "shard", "hash", "crc", "sha", "score", "words", "mask", "bits", "dk", "g", "node", "key", "later", "seeds", "holds_item", "text_", "_0", "made_fp"]
