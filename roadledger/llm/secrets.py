r"""Secret scans with a trigram inverted index.

Each rule's regex is turned into a Boolean query: an AND of ORs of trigrams that any match must contain,
read off the parsed pattern. Documents are indexed in segments of bounded size; a segment's postings map
each trigram that some rule asks for to the documents that hold it. The query is answered by
intersecting and uniting postings, and the regex runs over the candidates only. Rules whose pattern
forces no trigram scan every document. A segment is built, searched and dropped where its documents lie,
so neither texts nor postings are shuffled.

Trigrams are over bytes with A-Z lower-cased, in index and queries alike; a query may let through a
document without a match, never the reverse.

Defined results: a null or empty text has no spans; matches of one rule are leftmost and do not overlap,
matches of different rules may; spans are in code points, end exclusive, by start and then rule order;
repeated rows and ids are independent; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as C
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roadledger.llm.common import pieces, whole_text


@dataclass(frozen=True)
class Rule:
    """A regex and what its matches must satisfy besides: group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0


# The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 20),
    Rule("hex", r"[0-9a-f]+", re.ASCII, 0, 24),
)
# Published token formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[a-z0-9.-]+"),
)
RULES = BASE_RULES + MORE_RULES

#: A query: None (any document), or a frozenset of clauses to be met all; a clause is a frozenset of
#: alternatives, an alternative a frozenset of trigrams needed together.
LONGEST_SET, LONGEST_WORDS = 16, 64


def _literals(items) -> list[tuple[list[str] | None, bool]]:
    """Parts of a pattern in order: (strings that the part can be, or None if unknown; may it be joined)."""
    out = []
    for op, value in items:
        if op is C.LITERAL:
            out.append([chr(value)])
        elif op is C.IN and all(o in (C.LITERAL, C.RANGE) for o, _ in value):
            chars = [chr(x) for o, v in value for x in ([v] if o is C.LITERAL else range(v[0], v[1] + 1))]
            out.append(sorted(set(chars)) if len(chars) <= LONGEST_SET else None)
        elif op is C.SUBPATTERN:
            out += _literals(value[3])
        elif op is C.BRANCH:
            options = [_strings(b) for b in value[1]]
            out.append(None if any(o is None for o in options) else sorted({s for o in options for s in o}))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = value
            inner = _strings(body)
            if inner is not None and high != C.MAXREPEAT and high <= 2:
                out.append(sorted({s for n in range(low, high + 1) for s in _power(inner, n)}))
            else:
                for _ in range(min(low, 3)):
                    out += _literals(body)
                out.append(None)
        elif op is C.AT:
            continue
        else:
            out.append(None)
    return out


def _power(strings: list[str], n: int) -> list[str]:
    out = [""]
    for _ in range(n):
        out = [a + b for a in out for b in strings]
    return out


def _strings(items) -> list[str] | None:
    """All strings that a pattern can match, if they are few."""
    out = [""]
    for part in _literals(items):
        if part is None or len(out) * len(part) > LONGEST_WORDS:
            return None
        out = [a + b for a in out for b in part]
    return out


def trigram_query(pattern: str, flags: int = 0) -> list[frozenset[frozenset[int]]]:
    """Clauses of a pattern, each a set of alternatives, each a set of trigram codes; empty: scan fully."""
    clauses, run = [], [""]

    def close():
        alternatives = {frozenset(_codes(s)) for s in run}
        if frozenset() not in alternatives:
            clauses.append(frozenset(alternatives))

    for part in [*_literals(parser.parse(pattern, flags)), None]:
        if part is not None and len(run) * len(part) <= LONGEST_WORDS:
            run = [a + b for a in run for b in part]
            continue
        close()
        run = part if part is not None else [""]
    return clauses


def _codes(s: str) -> list[int]:
    b = s.encode().translate(LOWER)
    return [b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)]


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Segment:
    """Postings of the asked trigrams over the documents of one piece of the table."""

    def __init__(self, texts: list[str], asked: np.ndarray):
        raw = [t.encode() for t in texts]
        self.count = len(raw)
        data = np.frombuffer(b"\0\0\0".join(raw).translate(LOWER), np.uint8)
        self.postings: dict[int, np.ndarray] = {}
        if len(data) < 3 or not len(asked):
            return
        wanted = np.zeros(1 << 16, bool)
        wanted[asked >> 8] = True
        two = data[:-1].astype(np.uint16) << 8 | data[1:]
        place = np.flatnonzero(wanted[two[:-1]])
        code = two[place].astype(np.int64) << 8 | data[place + 2]
        keep = np.isin(code, asked)
        place, code = place[keep], code[keep]
        starts = np.cumsum([0, *(len(r) + 3 for r in raw[:-1])])
        doc = np.searchsorted(starts, place, "right") - 1
        pairs = np.unique(code * self.count + doc)
        codes, docs = pairs // self.count, pairs % self.count
        cuts = np.flatnonzero(np.diff(codes)) + 1
        for c, d in zip(np.split(codes, cuts), np.split(docs, cuts)):
            if len(c):
                self.postings[int(c[0])] = d

    def candidates(self, clauses: list[frozenset[frozenset[int]]]) -> np.ndarray:
        """Documents that meet all clauses, in order."""
        none = np.zeros(0, np.int64)
        out = None
        for clause in clauses:
            met = none
            for needed in clause:
                lists = sorted((self.postings.get(t, none) for t in needed), key=len)
                both = lists[0]
                for more in lists[1:]:
                    both = np.intersect1d(both, more, assume_unique=True)
                met = np.union1d(met, both)
            out = met if out is None else np.intersect1d(out, met, assume_unique=True)
        return np.arange(self.count) if out is None else out


def scanner(rules: tuple[Rule, ...]) -> Callable[[list[str]], list[list[tuple[int, int, int]]]]:
    """A function from texts to the (start, rule number, end) of their secrets, sorted."""
    ready = [(re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags), r.group, r.least) for r in rules]
    asked = np.array(sorted({t for _, q, _, _ in ready for clause in q for alt in clause for t in alt}), np.int64)

    def scan(texts: list[str]) -> list[list[tuple[int, int, int]]]:
        segment, out = Segment(texts, asked), [[] for _ in texts]
        for n, (regex, query, group, least) in enumerate(ready):
            for i in segment.candidates(query).tolist():
                out[i] += [(m.start(), n, m.end()) for m in regex.finditer(texts[i]) if m.end(group) - m.start(group) >= least]
        for spans in out:
            spans.sort()
        return out

    return scan


def secret_spans(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, spans): every row's secrets as an array of (kind, start, end)."""
    kinds = [r.kind for r in rules]
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def work(batches):
        scan = scanner(rules)
        for batch in pieces(batches, text):
            found = scan(batch[text].to_pylist())
            spans = [[{"kind": kinds[n], "start": a, "end": b} for a, n, b in doc] for doc in found]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(spans, pa.list_(item))], names=[key, "spans"])

    schema = T.StructType([df.schema[key], *T.StructType.fromDDL("spans array<struct<kind:string,start:int,end:int>>").fields])
    return df.select(key, whole_text(text).alias(text)).mapInArrow(work, schema)


def joined(spans) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def base_digest(spans) -> str:
    """sha256 of the base spans of a document, joined."""
    kinds = {r.kind for r in BASE_RULES}
    return hashlib.sha256(joined([s for s in spans if s["kind"] in kinds]).encode()).hexdigest()
