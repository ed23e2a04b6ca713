"""Training-data operators: URL filters, deduplication, tokenisation,
classifiers, mixing and fingerprints.

Nothing outside this package imports it. :mod:`flowlens.llm.queries` holds the
registered queries (``opN_<name>``) and their SQL.
"""
