"""Operators that prepare training data. Nothing outside this package, ``corpus_pipeline`` and the entry module uses them."""
