"""Operators for preparing language-model training data.

Every operator takes and returns DataFrames, works on whole tables and whole
texts, and keeps what it collects to the driver or broadcasts within a bound
that its docstring states.
"""
