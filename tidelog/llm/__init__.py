"""Operators of a training-data pipeline over `documents`, `pages` and `benchmark`.

Nothing outside this subpackage imports it.  Shared conventions, which hold for every
operator unless its own docstring says otherwise:

* a null text counts as the empty text; a null id never matches another id;
* rows are documents: rows that share an id are kept apart and each gets its result;
* only the named columns are read, so further columns may have any name;
* an empty table gives an empty result with the usual schema;
* words are runs of characters other than ``[\\x20\\x09-\\x0D]``.
"""
