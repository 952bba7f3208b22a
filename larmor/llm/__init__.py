"""Training-data operators for corpora far larger than memory.

Every module holds one operator with a general interface; ``queries`` holds the thin
``opN_<name>`` queries that apply them to the driver tables.
"""
