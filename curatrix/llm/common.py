"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.shared import attach, materialise, table

__all__ = ["attach", "crc32_mod", "materialise", "table"]


def crc32_mod(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo modulus."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
