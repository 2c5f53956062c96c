"""Training-data operators: cleaning, deduplication, tokenizing, packing and sharding.

Each module holds one operator with a general DataFrame interface and the thin
``opN_<name>`` query that applies it to its whole table.  ``registry`` gathers
the queries; nothing outside this subpackage imports it.
"""
