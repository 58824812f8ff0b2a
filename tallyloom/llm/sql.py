"""Pieces of SQL that several counterparts use."""

from __future__ import annotations

# Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _shifted(register: int) -> int:
    """What eight steps of the checksum make of one byte."""
    for _ in range(8):
        register = register >> 1 ^ POLYNOMIAL * (register & 1)
    return register


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes: the checksum is linear, so a byte's
    part is put together from those of its eight bits."""
    byte = "CAST(('0x' || h[i:i + 1]) AS BIGINT)"
    step = "c >> 8"
    for bit in range(8):
        step = f"xor({step}, ((xor(c, b) >> {bit}) & 1) * {_shifted(1 << bit)})"
    return (
        f"xor(list_reduce(list_transform([hex(encode({text}))], lambda h: "
        f"list_transform(range(1, len(h), 2), lambda i: {byte}))[1], lambda c, b: {step}, 4294967295), 4294967295)"
    )
