"""Operators for building training corpora: quality, dedup, PII, licences, packing, tokenising, chat.

Nothing outside this subpackage imports it.  ``QUERIES`` and ``ORACLE_SQL`` in
:mod:`framewright.llm.queries` are merged into the driver's entry module when the subpackage exists.
"""
