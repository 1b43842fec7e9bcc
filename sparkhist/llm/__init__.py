"""Training-data operators (deduplication, token counting, packing, scoring, mixing).

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` registers the thin ``opN_*`` queries
over the standard tables.
"""
