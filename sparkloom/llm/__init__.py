"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage.  Each operator lives in a
module of its own and takes DataFrames; `queries` wires them to the tables.
"""
