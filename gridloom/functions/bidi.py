"""Approximate embedding levels: implicit rules of the bidirectional algorithm over one paragraph.

Classes are one letter each, so the rules are substitutions on a string.  There are no explicit
embeddings; those controls never pass the input gate.
"""

from __future__ import annotations

import re
import unicodedata

_CLASS = {"L": "L", "R": "R", "AL": "A", "EN": "E", "AN": "N", "ES": "S", "ET": "T", "CS": "C", "NSM": "M", "WS": "W", "ON": "O", "BN": "x", "B": "B", "S": "Z"}
_RTL = re.compile("[RAN]")
#: Texts without any of these have no right-to-left text.
_PERHAPS = re.compile("[^\x00-\u058F\u2E80-\u9FFF]")
_STRONG = re.compile("[LRA]")


def levels(text: str) -> list[int] | None:
    """A level for each code point, or None without right-to-left text."""
    if not _PERHAPS.search(text):
        return None
    types = "".join([_CLASS.get(unicodedata.bidirectional(c), "L") for c in text])
    if not _RTL.search(types):
        return None
    first = _STRONG.search(types)
    base = int(first is not None and first.group() != "L")
    edge = "LR"[base]
    types = re.sub("^M+", lambda m: edge * len(m.group()), types)  # marks follow what they stand on
    types = re.sub("([^M])(M+)", lambda m: m.group(1) * len(m.group()), types)
    types = re.sub("A[^LRA]*", lambda m: m.group().replace("E", "N"), types).replace("A", "R")
    types = re.sub("(?<=E)[SC](?=E)", "E", types)
    types = re.sub("(?<=N)C(?=N)", "N", types)
    types = re.sub("T*E[ET]*", lambda m: "E" * len(m.group()), types)
    types = re.sub("[WSTC]", "O", types)
    after_l = lambda m: m.group().replace("E", "L")
    types = re.sub("L[^LR]*" if edge == "R" else "(?:^|L)[^LR]*", after_l, types)
    padded = edge + types + edge
    between = lambda m: ("L" if m.group(1) == "L" else "R") * len(m.group(2)) if (m.group(1) == "L") == (m.group(3) == "L") else edge * len(m.group(2))
    types = re.sub("(?<=(.))(O+)(?=(.))", between, padded, flags=re.DOTALL)[1:-1]
    up = {0: {"R": 1, "N": 2, "E": 2}, 1: {"L": 1, "N": 1, "E": 1}}[base]
    return [base + up.get(t, 0) for t in types]
