"""Operators that prepare text corpora for training language models.

Nothing outside this subpackage imports it; its queries are listed in
:mod:`daybook.llm.queries` and its tests are in ``tests/llm``.
"""
