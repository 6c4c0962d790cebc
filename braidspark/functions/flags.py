"""The flag's predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: predicate -> mask.
FLAG_COLUMNS = {
    "is_paired": 0x001,
    "is_proper_pair": 0x002,
    "is_unmapped": 0x004,
    "is_mate_unmapped": 0x008,
    "is_reverse": 0x010,
    "is_secondary": 0x100,
    "is_qcfail": 0x200,
    "is_duplicate": 0x400,
    "is_supplementary": 0x800,
}


def has_flag(name: str, flag: Column | str = "flag") -> Column:
    """One of the nine predicates, from a flag column."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return flag.bitwiseAND(FLAG_COLUMNS[name]) != 0
