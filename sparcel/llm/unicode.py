"""Character classes for stdlib ``re``, built from the Unicode data that Python carries.

The tokenizers library knows the letters and numbers of that Unicode version; newer tables, such as those
of the regex module, would split characters assigned since then in another way.
"""

from __future__ import annotations

import functools
import sys
import unicodedata


@functools.cache
def char_classes() -> dict[str, str]:
    """Ranges, ready for use inside brackets: ``L`` letters, ``N`` numbers, ``S`` white space."""
    found: dict[str, list[list[int]]] = {"L": [], "N": [], "S": []}
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        kind = "S" if c.isspace() and not 0x1C <= cp <= 0x1F else unicodedata.category(c)[0]
        if kind in found and not (kind == "S" and not c.isspace()):
            ranges = found[kind]
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in v) for k, v in found.items()}
