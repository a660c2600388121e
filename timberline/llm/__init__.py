"""Operators for large text corpora: token counts, filters, deduplication, mixing.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and names of its id and text columns, and touches no other column, so extra
columns never clash.
"""
