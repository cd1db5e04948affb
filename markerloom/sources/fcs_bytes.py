"""Writing cells as the bytes of an FCS 3.1 file."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def encode_fcs(
    names: Sequence[str], values: np.ndarray, kind: str = "F", little: bool = True, bits: int = 32
) -> bytes:
    """One list-mode file: floats (F), doubles (D) or unsigned integers (I) of `bits`."""
    values = np.asarray(values, dtype="float64").reshape(-1, len(names))
    order = "<" if little else ">"
    kinds = {"F": ("f4", 32), "D": ("f8", 64), "I": (f"u{bits // 8}", bits)}
    code, width = kinds[kind]
    data = values.astype(order + code).tobytes()
    fields = {
        "$BEGINANALYSIS": 0,
        "$ENDANALYSIS": 0,
        "$BYTEORD": "1,2,3,4" if little else "4,3,2,1",
        "$DATATYPE": kind,
        "$MODE": "L",
        "$NEXTDATA": 0,
        "$PAR": len(names),
        "$TOT": len(values),
    }
    for i, name in enumerate(names, 1):
        fields |= {f"$P{i}B": width, f"$P{i}N": f"P{i}", f"$P{i}S": name, f"$P{i}R": 2**min(width, 32), f"$P{i}E": "0,0"}

    def text(begin: int, end: int) -> bytes:
        pairs = fields | {"$BEGINDATA": f"{begin:012d}", "$ENDDATA": f"{end:012d}"}
        return ("/" + "".join(f"{k}/{str(v).replace('/', '//')}/" for k, v in pairs.items())).encode("latin-1")

    begin = 58 + len(text(0, 0))
    end = begin + len(data) - 1
    segment = text(begin, end)
    # Offsets beyond eight digits stand in the text segment only.
    in_header = (begin, end) if end < 10**8 else (0, 0)
    header = "FCS3.1    " + "".join(f"{n:8d}" for n in (58, begin - 1, *in_header, 0, 0))
    return header.encode("latin-1") + segment + data
