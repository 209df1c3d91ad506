"""Secret scan by a combined deterministic automaton.

All rules are compiled into one minimal automaton (see ``automaton``), and
every byte of every text moves it once, whatever the number of rules. Where a
rule accepts, its backward automaton finds the leftmost start and its own
forward automaton the longest end; matches of a rule do not overlap, and each
continues after the one before. A match that fails its rule's length check is
dropped after it has been taken, so it still hides what it covers.

Rules ``assign``, ``access`` and ``hex`` are the base ones; the others are
public token formats. Positions are in code points, ends exclusive. Null
texts are empty. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marketlens.llm import kernels as K
from marketlens.llm.automaton import Dfa, compile_rules

# fixed values: the rules, in the order in which spans of one start are listed
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
BASE = ("assign", "access", "hex")
RULES = {
    "assign": (_ASSIGN + r"[A-Za-z0-9+/_.=-]+", 12),
    "access": (r"AKIA[A-Z0-9]+", 18),
    "hex": (r"[0-9a-f]{16,}", 16),
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 15),
    "google": (r"AIza[A-Za-z0-9_-]+", 39),
    "stripe": (r"[rs]k_live_[A-Za-z0-9]+", 24),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    "private_key": (r"-----BEGIN( [A-Z]+)* PRIVATE KEY-----", 0),
}


@dataclass
class Scanner:
    kinds: list[str]
    least: list[int]
    together: Dfa
    forward: list[Dfa]
    backward: list[Dfa]
    before_value: Dfa

    @classmethod
    def of(cls, rules: dict[str, tuple[str, int]]) -> Scanner:
        patterns = [p for p, _ in rules.values()]
        return cls(list(rules), [n for _, n in rules.values()], compile_rules(patterns),
                   [compile_rules([p], anchored=True) for p in patterns],
                   [compile_rules([p], anchored=True, backward=True) for p in patterns], compile_rules([_ASSIGN], anchored=True))

    def spans(self, text: bytes, rule: int, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """Byte spans of a rule, from the positions behind which it accepts."""
        at, i = 0, 0
        while i < len(ends):
            start = self.backward[rule].farthest_back(text, int(ends[i]), at)
            if start < 0:  # every match that ends here starts in the one before
                i += 1
                continue
            at = self.forward[rule].longest(text, start)
            value = self.before_value.longest(text, start) if self.kinds[rule] == "assign" else start
            if at - value >= self.least[rule]:
                yield start, at
            i = int(np.searchsorted(ends, at, "right"))

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """(start, rule, end) in code points, sorted, of every document of a slice that has any.

        A byte 0, which no rule contains, is put behind every document."""
        n = len(offsets) - 1
        where = offsets + np.arange(n + 1)
        padded = np.zeros(len(data) + n, np.uint8)
        keep = np.ones(len(padded), bool)
        keep[where[1:] - 1] = False
        padded[keep] = data
        states = self.together.states(padded)
        accepting = self.together.accepts != 0
        hit = np.flatnonzero(accepting[states])
        masks = self.together.accepts[states[hit]]
        docs = np.searchsorted(where, hit, "right") - 1
        out: dict[int, list[tuple[int, int, int]]] = {}
        for d in np.unique(docs).tolist():
            own = slice(*np.searchsorted(docs, (d, d + 1)))
            ends, mask = hit[own] - where[d] + 1, masks[own]
            text = data[offsets[d] : offsets[d + 1]]
            raw = text.tobytes()
            found = [(s, r, e) for r in range(len(self.kinds)) for s, e in self.spans(raw, r, ends[(mask >> r) & 1 == 1])]
            if found:
                points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                out[d] = sorted((int(points[s]), r, int(points[e])) for s, r, e in found)
        return out


def find_secrets(docs: DataFrame, rules: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """(doc_id, n_<base kind>..., base_sha256, spans) of every row of ``docs`` (doc_id, text, any others).

    ``spans`` lists kind:start:end of all rules by start; ``base_sha256`` is
    the digest of such a list of the base kinds."""
    scanner = Scanner.of(rules or RULES)
    base = [scanner.kinds.index(k) for k in BASE]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in BASE),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = K.text_buffers(batch.column(1))
            for at, to, part, local in K.slices(data, offsets):
                found = scanner.scan(part, local)
                rows = [found.get(i, []) for i in range(to - at)]
                listed = lambda spans: ",".join(f"{scanner.kinds[r]}:{s}:{e}" for s, r, e in spans)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), *(pa.array([sum(r == b for _, r, _ in x) for x in rows], pa.int64()) for b in base),
                     pa.array([sha256(listed([x for x in row if x[1] in base]).encode()).hexdigest() for row in rows], pa.string()),
                     pa.array([listed(row) for row in rows], pa.string())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
