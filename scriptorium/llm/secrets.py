"""Secret scans: base patterns, and credentials whose parts stand apart.

Besides the base findings, weak candidates are looked for: access identifiers, secrets and endpoints. Each is a span in a
scope of `scope_chars` code points around it. A weak candidate is reported only if complementary parts lie within its scope:
an identifier needs a secret, a secret an identifier or an endpoint, an endpoint a secret. The join is on intervals: the
spans of one text are sorted by start, and each looks up its nearest complements by binary search; the work of a text
grows as its number of spans times its logarithm, not with pairs.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm._common import small_batches, with_fields

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{16,}")  # runs of 16 or more; as runs are taken whole, these are the long ones among HEX's

#: Weak candidates: of these one alone says nothing.
IDENTIFIER = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})|\bAKIA[A-Z0-9]{8,13}\b""", re.IGNORECASE | re.ASCII)
SHORT_SECRET = re.compile(r"""\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|private_?key|credential)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,11})(?![A-Za-z0-9+/_.=-])""", re.ASCII | re.IGNORECASE)
#: A whole run of secret characters, entered once at its beginning; what it holds is tested in code, so that time grows with its length.
RUN = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}+={0,2}+(?![A-Za-z0-9+/=])")
DIGIT = re.compile(r"[0-9]")
ENDPOINT = re.compile(r"""\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[^\s"'<>]+|\b(?:endpoint|host|server|region)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{4,}""", re.IGNORECASE | re.ASCII)
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: A text without any of these has no weak candidate that a complement could confirm.
HINT = re.compile(r"[:=]|AKIA", re.IGNORECASE)


@dataclass(frozen=True)
class Params:
    scope_chars: int = 200


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, leftmost and not overlapping within a kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(out)


def weak_secrets(text: str) -> list[tuple[int, int, int]]:
    """Short assigned secrets, and runs of 20 or more characters with digits and both cases; of two that overlap the one that begins first."""
    runs = [(m.start(), 4, m.end()) for m in RUN.finditer(text) if DIGIT.search(m[0]) and m[0] != m[0].lower() and m[0] != m[0].upper()]
    out: list[tuple[int, int, int]] = []
    for x in sorted([(m.start(), 4, m.end()) for m in SHORT_SECRET.finditer(text)] + runs):
        if not out or x[0] >= out[-1][2]:
            out.append(x)
    return out


def linked_spans(text: str, base: list[tuple[int, int, int]], scope: int) -> list[tuple[int, int, int]]:
    """Weak candidates that a complement within the scope confirms. Base findings serve as complements as well."""
    if not HINT.search(text):
        return []
    identifiers = [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)]
    endpoints = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    secrets = weak_secrets(text)
    strong_id = [b for b in base if b[1] == 1]
    assigned, runs = [b for b in base if b[1] == 0], [b for b in base if b[1] == 2]

    def near(*lists):
        """Whether a span of the lists lies within the scope of a span, other than on top of it. The spans of a list don't overlap, so starts and ends are sorted alike."""
        sides = [([x[0] for x in spans], [x[2] for x in spans]) for spans in lists if spans]

        def test(s: int, e: int) -> bool:
            for starts, ends in sides:
                i, j = bisect.bisect_right(ends, s) - 1, bisect.bisect_left(starts, e)
                if (i >= 0 and s - ends[i] <= scope) or (j < len(starts) and starts[j] - e <= scope):
                    return True
            return False

        return test

    by_secret, by_id, by_end = near(secrets, assigned, runs), near(identifiers, strong_id), near(endpoints)
    taken = {(s, e) for s, _, e in base}
    out = [x for x in identifiers if by_secret(x[0], x[2])]
    out += [x for x in secrets if by_id(x[0], x[2]) or by_end(x[0], x[2])]
    out += [x for x in endpoints if by_secret(x[0], x[2])]
    return [x for x in out if (x[0], x[2]) not in taken]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_secrets(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """docs (without text) with the added columns n_assign, n_access, n_hex, base_sha256 and spans; those of these names are replaced.

    Starts and ends count code points. A null or empty text has no spans, and base_sha256 is that of the empty string.
    Repeated rows each get their result; an empty table gives an empty one.
    """
    p = p or Params()
    small_batches(docs.sparkSession)
    added = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    base = docs.drop(*added)
    rest = base.drop("text")
    schema = with_fields(rest, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

    def scan(batches):
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                found = base_spans(text)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in found))
                digests.append(hashlib.sha256(joined(found).encode()).hexdigest())
                spans.append(joined(found + linked_spans(text, found, p.scope_chars)))
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.record_batch([*kept, *(pa.array(c, type=pa.int64()) for c in counts), pa.array(digests, type=pa.string()), pa.array(spans, type=pa.string())], names=schema.names)

    return base.mapInArrow(scan, schema)
