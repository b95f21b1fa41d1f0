"""Secret scanning with multipart credential linking.

Base patterns are reported as they are. A credential often comes in parts: an access identifier, a secret and an endpoint.
Weak secrets (a short assignment, a random-looking token) are collected with the identifiers and endpoints of the same
text, and an interval join within a scope of `scope` characters decides: a weak secret is reported, with its parts, only
where complementary parts lie within the scope. The join merges sorted starts, so it is linear in the parts but for the
sort. Texts never meet each other; nothing is shuffled.

Edge cases: null and empty texts have no span. Rows that repeat are each reported. Added spans never overlap base spans.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ["assign", "access", "hex", "linked"]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
IDENTIFIER = re.compile(r"""(?<![a-z0-9])(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?|uid)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,64})""", re.ASCII | re.IGNORECASE)
IDENTIFIER_WORDS = ("user", "login", "account", "clientid", "client_id", "access", "uid", "akia")
ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+]{1,15}://[^\s"'<>]{3,200}|(?<![a-z])(?:host|endpoint|server|bucket|region)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{3,100})""", re.ASCII | re.IGNORECASE)
ENDPOINT_WORDS = ("://", "host", "endpoint", "server", "bucket", "region")
WEAK = re.compile(r"""(?<![A-Za-z0-9+/_-])(?:(?:[A-Za-z0-9_-]*[_-])?(?:pwd|pass|key|credential|auth)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#%^&*-]{6,}+)|([A-Za-z0-9+/_-]{20,}+={0,2}))(?![A-Za-z0-9+/_=-])""", re.ASCII | re.IGNORECASE)
#: Bits per character that a bare token needs to look random.
RANDOM_BITS = 3.5

Span = tuple[int, int, str]


def base_spans(text: str, low: str) -> list[Span]:
    """Base matches by kind; a match that fails its length is dropped without another try."""
    out: list[Span] = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def random_looking(token: str) -> bool:
    """Letters and digits mixed, and close to uniform characters."""
    if not (any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)):
        return False
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values()) >= RANDOM_BITS


def near(starts: list[int], at: int, scope: int) -> bool:
    """Whether a sorted start lies within the scope of a place."""
    i = bisect_left(starts, at - scope)
    return i < len(starts) and starts[i] <= at + scope


def linked_spans(text: str, low: str, base: list[Span], scope: int) -> list[Span]:
    """Weak secrets that complementary parts make credible."""
    if not any(w in low for w in IDENTIFIER_WORDS):
        return []
    access = sorted(a for a, _, kind in base if kind == "access")
    identifiers = sorted([*access, *(m.start() for m in IDENTIFIER.finditer(text))])
    if not identifiers:
        return []
    endpoints = sorted(m.start() for m in ENDPOINT.finditer(text)) if any(w in low for w in ENDPOINT_WORDS) else []
    taken = sorted((a, b) for a, b, _ in base)
    firsts = [a for a, _ in taken]
    out: list[Span] = []
    reach = 0
    ends = []
    for _, b in taken:
        reach = max(reach, b)
        ends.append(reach)
    for m in WEAK.finditer(text):
        group = 1 if m[1] else 2
        a, b = m.span(group)
        i = bisect_left(firsts, b)
        if i and ends[i - 1] > a:
            continue
        if group == 2 and not random_looking(m[2]):
            continue
        pair = len(m[group]) == 40 and near(access, a, scope)
        if pair or near(identifiers, a, scope) and near(endpoints, a, scope):
            out.append((a, b, "linked"))
    return out


def scan(docs: DataFrame, scope: int = 400) -> DataFrame:
    """The columns of docs, then spans: array<struct<kind, start, stop>> by start, then kind."""
    docs = docs.drop("spans")
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def of(text: str | None) -> list[dict]:
        if not text:
            return []
        low = text.lower()
        base = base_spans(text, low)
        spans = sorted([*base, *linked_spans(text, low, base, scope)], key=lambda s: (s[0], KINDS.index(s[2])))
        return [{"kind": k, "start": a, "stop": b} for a, b, k in spans]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([of(t.as_py()) for t in batch.column(at)], kind)], [*batch.schema.names, "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, spans array<struct<kind:string,start:int,stop:int>>")
