"""Operators for preparing large text corpora, one module per operator.

Nothing outside this subpackage imports it; ``lanewise.llm.queries`` lists its
registered queries and their SQL.
"""
