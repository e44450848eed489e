"""Operators of a training-data pipeline over a table of documents.

Each module holds one operator with its own interface; `queries` derives the
contract queries from them.  Nothing outside this subpackage imports it.
"""
