"""Training-data operators: sharding, mixing, deduplication, decontamination and measurement of text tables.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; the
``queries`` module holds the thin ``opN_<name>`` queries of the driver contract.
"""
