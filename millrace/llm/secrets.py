"""Secret scan: fixed patterns, and formats learned from labelled credentials."""

from __future__ import annotations

import bisect
import random
import re
import string
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.grammar import Automaton
from millrace.llm import tables
from millrace.llm.tables import map_rows, text_bytes
from millrace.llm.words import byte_table, spans

ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "learned")
SHORTEST = {"assign": 6, "access": 20, "hex": 24, "learned": 16}

HEX_BYTES = byte_table(b"0123456789abcdef")
TOKEN_BYTES = byte_table((string.ascii_letters + string.digits + "+/_.=-").encode())
DIGIT_BYTES = byte_table(string.digits.encode())
LETTER_BYTES = byte_table(string.ascii_letters.encode())
SHORTER, LONGER = 0.7, 1.5  # lengths of credentials with a literal beginning, as shares of the labelled ones
JOINS = set("=/.-_+")  # characters of a run that may stand between a name, a path or a sentence and a credential
LEADS = byte_table(bytes(range(0x80, 0xC0)), inverted=True)

UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
ALNUM = UPPER + LOWER + DIGITS
# Published formats of credentials, as literal text and (alphabet, length) parts.
FORMATS = {
    "code host": ["ghp_", (ALNUM, 36)],
    "code host, other": ["glpat-", (ALNUM + "_-", 20)],
    "chat bot": ["xoxb-", (DIGITS, 12), "-", (DIGITS, 12), "-", (ALNUM, 24)],
    "map service": ["AIza", (ALNUM + "_-", 35)],
    "payments": ["sk_live_", (ALNUM, 24)],
    "mail service": ["SG.", (ALNUM + "_-", 22), ".", (ALNUM + "_-", 43)],
    "package index": ["npm_", (ALNUM, 36)],
    "web token": ["eyJ", (ALNUM + "_-", 33), ".eyJ", (ALNUM + "_-", 60), ".", (ALNUM + "_-", 43)],
    "cloud secret": [(ALNUM + "+/", 40)],
}


def labelled(format_: Sequence[str | tuple[str, int]], count: int, seed: str) -> list[str]:
    """Credentials of a format; made up by rule, so none is anybody's."""
    draw = random.Random(seed)
    return [
        "".join(p if isinstance(p, str) else "".join(draw.choice(p[0]) for _ in range(p[1])) for p in format_)
        for _ in range(count)
    ]


def learn(count: int = 150) -> list[Automaton]:
    """One automaton a format, each from ``count`` labelled credentials."""
    return [Automaton(labelled(f, count, name)) for name, f in FORMATS.items()]


def mixed(run: str) -> bool:
    """Long enough for a credential, with a letter and a digit."""
    data = np.frombuffer(run.encode(), np.uint8)
    return len(run) >= SHORTEST["learned"] and bool(DIGIT_BYTES[data].any() and LETTER_BYTES[data].any())


def plain(part: str) -> bool:
    """A word in one case, a number or a few characters."""
    return len(part) < 4 or part.isdigit() or part.isalpha() and (part.islower() or part.isupper() or part.istitle())


class Scanner:
    """Finds the spans of one text; offsets count code points, ends are exclusive."""

    def __init__(self, automata: Sequence[Automaton], margin: float = 20.0):
        self.automata, self.margin = automata, margin

    def bytes_found(self, text: bytes) -> list[tuple[int, int, int]]:
        data = np.frombuffer(text, np.uint8)
        found = []
        if b"=" in text or b":" in text:
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST["assign"]]
        if b"AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= SHORTEST["access"]]
        starts, ends = spans(data, HEX_BYTES)
        long = np.flatnonzero(ends - starts >= SHORTEST["hex"])
        found += [(int(starts[i]), 2, int(ends[i])) for i in long]
        starts, ends = spans(data, TOKEN_BYTES)
        long = np.flatnonzero(ends - starts >= SHORTEST["learned"])
        base = list(found)
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            token = text[s:e].decode()
            over = sorted((max(x, s) - s, min(y, e) - s) for x, _, y in base if x < e and s < y)
            at = 0
            for x, y in [*over, (e - s, e - s)]:
                found += [(s + at + a, 3, s + at + b) for a, b in self.parts(token[at:x])] if x > at else []
                at = max(at, y)
        return sorted(found)

    def parts(self, run: str) -> list[tuple[int, int]]:
        """Non-overlapping parts of a run that beat the margin, the best first taken."""
        found: list[tuple[int, int]] = []
        if mixed(run):
            for _, start, end in sorted((c for a in self.automata for c in self._candidates(a, run)), key=lambda c: (-c[0], c[1:])):
                at = bisect.bisect_left(found, (start,))
                if (at == 0 or found[at - 1][1] <= start) and (at == len(found) or end <= found[at][0]):
                    found.insert(at, (start, end))
        return found

    def _candidates(self, automaton: Automaton, run: str) -> Iterator[tuple[float, int, int]]:
        """(score, start, end) of the parts that have the format's length and likelihood.

        A format with a literal beginning starts there, behind no letter or digit, and may be somewhat shorter or longer than
        the labelled ones. Any other has their length, between characters it does not hold; behind a name or a path it may also
        stand between characters it does hold, if all else in the run is plain words: in encoded data nothing is."""
        literal, low, high = automaton.literal, min(automaton.lengths), max(automaton.lengths)
        if len(literal) > 2:
            low, high, at = max(SHORTEST["learned"], int(low * SHORTER)), int(high * LONGER), -1
            while (at := run.find(literal, at + 1)) >= 0:
                stop = at
                while stop < min(len(run), at + high + 1) and run[stop] in automaton.symbols:
                    stop += 1
                if at and run[at - 1].isalnum():
                    continue
                scores = automaton.scores(run[at:stop])
                ends = [e for e in range(at + low, min(stop, at + high) + 1) if e == len(run) or not run[e].isalnum()]
                best = max(((scores[e - at], e) for e in ends), default=(-1.0, 0))
                if best[0] >= self.margin and mixed(run[at : best[1]]):
                    yield best[0], at, best[1]
            return
        for joins in (JOINS - automaton.symbols, JOINS):
            cuts = [-1, *(i for i, x in enumerate(run) if x in joins), len(run)]
            pieces = [(a + 1, b) for a, b in zip(cuts, cuts[1:])]
            others = [run[a:b] for a, b in pieces if b - a not in automaton.lengths]
            if joins == JOINS and not all(map(plain, others)):
                return
            for a, b in pieces:
                if b - a in automaton.lengths and mixed(run[a:b]) and (score := automaton.score(run[a:b])) >= self.margin:
                    yield score, a, b

    def scan(self, text: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed."""
        found = self.bytes_found(text)
        if not found:
            return []
        chars = np.concatenate([[0], np.cumsum(LEADS[np.frombuffer(text, np.uint8)], dtype=np.int64)])
        return [(KINDS[kind], int(chars[s]), int(chars[e])) for s, kind, e in found]

    def masked(self, text: bytes, mask: bytes) -> bytes:
        parts, at = [], 0
        for s, _, e in self.bytes_found(text):
            if s >= at:
                parts += [text[at:s], mask]
            at = max(at, e)
        return b"".join([*parts, text[at:]])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = 150) -> DataFrame:
    """One row for each input row: doc_id and an array of spans (kind, start, stop) as text ``kind:start:stop``.

    Base kinds are ``assign``, ``access`` and ``hex`` (leftmost non-overlapping matches of each, those too short dropped;
    kinds may overlap each other). ``learned`` are parts of runs of token characters, with a letter and a digit, outside base
    spans, that have the length of a labelled format and whose likelihood under the automaton learned from its credentials beats
    ordinary text by a margin. Null and empty texts have no spans; null ids and repeated rows are scanned like any other; time is
    in proportion to a text's length.
    """
    automata = learn(count)

    def make() -> Callable:
        scanner = Scanner(automata)
        return lambda id, text: (id, [f"{kind}:{s}:{e}" for kind, s, e in scanner.scan(text)])

    return map_rows(text_bytes(docs, id_col, text_col), make, "doc_id long, spans array<string>")


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", count: int = 150) -> DataFrame:
    """All rows and columns, every span in the text replaced by ``mask``; a column n_chars follows the new length."""
    automata = learn(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(automata)
        for batch in tables.parts(batches):
            at = batch.schema.get_field_index(text_col)
            texts = [
                t if t is None else scanner.masked(t.encode(), mask.encode()).decode() for t in batch.column(at).to_pylist()
            ]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(f"`{text_col}`").isNull(), F.col("n_chars")).otherwise(F.length(f"`{text_col}`").cast(kind)))
    return out
