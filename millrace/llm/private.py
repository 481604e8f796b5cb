"""Personal data: fixed patterns, and names, addresses and numbers that a skip-chain random field finds."""

from __future__ import annotations

import functools
import random
import re
import string
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.skipchain import ALIKE, CHAIN, LOOSE, SAME, Graph, SkipChain, joined
from millrace.llm.tables import map_parts, slices, text_bytes
from millrace.llm.words import Hasher, byte_table, spans

KINDS = ("email", "ip", "card", "phone", "name", "address", "number")
NONE, NAME, ADDRESS, NUMBER = range(4)  # labels; base spans but email are numbers
REACH = 4  # tokens on either side of evidence that the field covers
SURE = 0.9  # probability that a span's surest token needs; the others need to be likelier of its label than not

HOST = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(rb"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
STREET_END = re.compile(rb"(?:stra\xc3\x9fe|strasse|allee|gasse|platz)(?![a-z0-9\x80-\xff])")
LOCAL_BYTES = byte_table((string.ascii_letters + string.digits + "._%+-").encode())
TOKEN_BYTES = byte_table((string.ascii_letters + string.digits).encode() + bytes(range(0x80, 0x100)))
LEADS = byte_table(bytes(range(0x80, 0xC0)), inverted=True)
NOT_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)

# Words that hint at personal data, in lower case.
WORDS = {
    "title": "mr mrs ms mister miss dr prof professor herr herrn frau monsieur madame mademoiselle mme señor señora señorita sr sra "
             "don doña",
    "greeting": "dear sincerely regards signed lieber liebe cher chère estimado estimada",
    "intro": "name named nombre nom heiße heisse heißt heisst appelle llamo llama patient client customer tenant employee born née "
             "geboren contact",
    "given": "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara "
             "susan jessica sarah karen anna emma daniel paul mark peter hans klaus jürgen wolfgang dieter uwe stefan monika sabine "
             "petra ursula renate pierre jean michel andré philippe alain marie nathalie isabelle sylvie catherine françoise josé "
             "antonio manuel francisco juan carlos miguel carmen maría dolores pilar lucía sofía elena laura martin julia",
    "street": "street avenue road lane drive boulevard court square terrace straße strasse weg allee platz rue impasse quai calle "
              "avenida plaza paseo camino",
    "number": "passport ssn iban account licence license social security tax insurance reisepass ausweis konto kontonummer steuer "
              "passeport compte pasaporte cuenta dni nif",
}
CLASS = {word: kind for kind, words in WORDS.items() for word in words.split()}


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes by kind, then start. Every pattern in time proportional to the text."""
    found = []
    if b"@" in text:
        data = np.frombuffer(text, np.uint8)
        starts, ends = spans(data, LOCAL_BYTES)
        last = 0
        for at in np.flatnonzero(data == 64).tolist():
            run = int(np.searchsorted(ends, at))
            start = max(last, int(starts[run])) if run < len(ends) and ends[run] == at else at
            match = HOST.match(text, at) if at >= last and start < at else None
            if match:
                found.append((0, start, match.end()))
                last = match.end()
    ips, cards, phones = [], [], []
    for m in DOTTED.finditer(text):
        if m[0].count(b".") >= 3:
            parts, at = m[0].split(b"."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in four):
                    ips.append((1, at, end))
                at = end + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].translate(None, NOT_DIGITS)) <= 19 and luhn(digits):
            cards.append((2, m.start(), m.end()))
    if b"+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(m[0].translate(None, NOT_DIGITS)) <= 15:
                phones.append((3, m.start(), m.end()))
    return found + ips + cards + phones


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def capital(text: bytes) -> bool:
    return 65 <= text[0] <= 90 or text[0] == 0xC3 and len(text) > 1 and 0x80 <= text[1] <= 0x9E


@functools.lru_cache(1 << 16)
def token_kind(token: bytes) -> tuple[str, str, bool]:
    """Class by meaning, class by shape, and whether it begins with a capital."""
    lower = token.lower()
    word = lower.decode("utf-8", "replace").lower()
    kind = CLASS.get(word, "street" if STREET_END.search(lower) else "")
    digits = len(token) - len(token.translate(None, b"0123456789"))
    large = capital(token)
    if digits == len(token):
        shape = f"d{min(digits, 5)}" if digits < 6 else "d9" if digits < 9 else "d10"
    elif digits:
        shape = "mixed9" if digits >= 5 else "mixed"
    elif large:
        shape = "initial" if len(token) == 1 else "capitals" if token.isupper() else "capital"
    else:
        shape = "small"
    return ("" if kind == "given" and not large else kind), shape, large


class Tokens:
    """The tokens of one text that the field covers, with their graph."""

    def __init__(self, text: bytes, base: list[tuple[int, int, int]], hasher: Hasher, lexicon: np.ndarray):
        self.text = text
        lower = text.lower()
        data = np.frombuffer(lower, np.uint8)
        raw = np.frombuffer(text, np.uint8)
        starts, ends = spans(data, TOKEN_BYTES)
        self.nodes = np.zeros(0, np.int64)
        self.starts, self.ends, n = starts, ends, len(starts)
        if not n:
            return
        hashes = hasher.words(data, starts, ends)
        first = raw[starts]
        second = raw[np.minimum(starts + 1, len(raw) - 1)]
        self.large = (first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        digit = (first >= 48) & (first <= 57)
        place = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        evidence = (lexicon[place] == hashes) | digit & (ends - starts >= 4)
        for m in STREET_END.finditer(lower):
            evidence[np.searchsorted(starts, m.start(), "right") - 1] = True
        self.base = np.full(n, -1)
        for kind, start, end in base:
            a, b = np.searchsorted(ends, start, "right"), np.searchsorted(starts, end)
            self.base[a:b] = kind
        evidence |= self.base > 0
        if not evidence.any():
            return
        upto = np.concatenate([[0], np.cumsum(evidence)])
        around = np.arange(n)
        covered = upto[np.minimum(around + REACH + 1, n)] > upto[np.maximum(around - REACH, 0)]
        # tokens that may be linked over a distance: capitals and longer numbers, alike but for a final s
        linked = (self.large | digit) & (ends - starts >= 3) & (self.base != 0)
        links = np.flatnonzero(linked)
        cut = (data[ends[links] - 1] == 115) & (ends[links] - starts[links] > 3)
        stems = hasher.words(data, starts[links], ends[links] - cut)
        again = np.isin(stems, stems[covered[links]])
        covered[links[again]] = True
        self.nodes = np.flatnonzero(covered)
        self.hashes = hashes
        small = hashes[~self.large]
        self.both = self.large & np.isin(hashes, small) if len(small) else np.zeros(n, bool)
        self._link(links[again], stems[again])

    def _link(self, links: np.ndarray, stems: np.ndarray) -> None:
        """Edges between neighbours, from every linked token to the one before it with its stem, and to the first one."""
        self.tight = np.zeros(len(self.starts), bool)  # whether a token stands close to the one before it
        for i in self.nodes.tolist():
            if i:
                gap = self.text[self.ends[i - 1] : self.starts[i]]
                self.tight[i] = len(gap) <= 2 and b"\n" not in gap and not gap.startswith((b"!", b"?", b";", b"|", b"\t"))
        number = np.full(len(self.starts), -1)
        number[self.nodes] = np.arange(len(self.nodes))
        right = self.nodes[1:][np.diff(self.nodes) == 1]
        a, b, kind = [number[right - 1]], [number[right]], [np.where(self.tight[right], CHAIN, LOOSE)]
        order = np.lexsort((links, stems))
        ids, keys = links[order], stems[order]
        repeat = np.flatnonzero(keys[1:] == keys[:-1]) + 1
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        head = begin[np.searchsorted(begin, repeat, "right") - 1] if len(repeat) else repeat
        for other, wanted in ((repeat - 1, True), (head, head != repeat - 1)):
            wanted &= ids[other] + 1 < ids[repeat]  # neighbours have an edge already
            x, y = ids[other][wanted], ids[repeat][wanted]
            a.append(number[x])
            b.append(number[y])
            kind.append(np.where(self.hashes[x] == self.hashes[y], SAME, ALIKE))
        self.a, self.b, self.kind = np.concatenate(a), np.concatenate(b), np.concatenate(kind)

    def token(self, i: int) -> bytes:
        return self.text[self.starts[i] : self.ends[i]]

    def features(self) -> Iterator[list[str]]:
        """The features of every covered token."""
        for i in self.nodes.tolist():
            kind, shape, large = token_kind(self.token(i))
            out = ["bias", shape, f"is {kind}"]
            gap = self.text[self.ends[i - 1] : self.starts[i]] if i else b"\n"
            before, form, _ = token_kind(self.token(i - 1)) if i else ("", "", False)
            opening = b"\n" in gap or bool(re.search(rb"[.!?]", gap)) and before != "title" and form != "initial"
            if large:
                out += ["opening" if opening else "inside"] + ["both"] * bool(self.both[i])
            for step in (-2, -1, 1, 2):
                j = i + step
                near = 0 <= j < len(self.starts)
                other, form, _ = token_kind(self.token(j)) if near else ("", "none", False)
                if near and self.base[j] >= 0:
                    other = KINDS[self.base[j]]
                if abs(step) == 1:
                    out += [f"{step} {form}", f"{step} {other} {shape[0]}"]
                elif other:
                    out.append(f"{step} {other} {shape[0]}")
            out.append(f"gap {gap[:1].decode('latin-1') if gap.strip() else 'blank'} {shape[0]}")
            yield out

    def graph(self, numbers: dict[str, int], grow: bool = False) -> Graph:
        at, feature = [], []
        for node, names in enumerate(self.features() if len(self.nodes) else ()):
            for name in names:
                number = numbers.setdefault(name, len(numbers)) if grow else numbers.get(name)
                if number is not None:
                    at.append(node)
                    feature.append(number)
        known = np.full(len(self.nodes), -1)
        if len(self.nodes):
            base = self.base[self.nodes]
            known[base == 0] = NONE
            known[base > 0] = NUMBER
        none = np.zeros(0, np.int64)
        edges = (self.a, self.b, self.kind) if len(self.nodes) else (none, none, none)
        return Graph(known, np.array(at, np.int64), np.array(feature, np.int64), *edges)

    def found(self, chance: np.ndarray, sure: float) -> Iterator[tuple[int, int, int]]:
        """(kind, start, end) in bytes from the probabilities of the covered tokens: runs of neighbours with one label, the
        surest of them above ``sure``."""
        run: list[int] = []
        what, most = NONE, 0.0
        labels = np.where(chance.max(1) >= 0.5, chance.argmax(1), NONE)
        for node, i in enumerate([*self.nodes.tolist(), -9]):
            now = int(labels[node]) if i >= 0 and self.base[i] < 0 else NONE
            if run and (now != what or i != run[-1] + 1 or not self.tight[i]):
                if most >= sure and self._whole(run, what):
                    yield what + 3, int(self.starts[run[0]]), int(self.ends[run[-1]])
                run, most = [], 0.0
            if now != NONE:
                run.append(i)
                what, most = now, max(most, chance[node, now])

    def _whole(self, run: list[int], what: int) -> bool:
        """A name has a capital and two letters, an address a number and a word, a number seven digits."""
        tokens = [self.token(i) for i in run]
        digits = sum(len(t) - len(t.translate(None, b"0123456789")) for t in tokens)
        if what == NAME:
            return not digits and any(capital(t) and len(t) > 1 for t in tokens)
        if what == ADDRESS:
            return digits > 0 and any(token_kind(t)[1] in ("capital", "capitals", "small") for t in tokens)
        return digits >= 7


# Sentences of the labelled examples. Slots give the labels; a later sentence may name a person again.
SENTENCES = """My name is {name}.|Dear Mr. {last},|Mrs. {name} called again about the order.|Please contact Dr. {name} at {email}.
{name} lives at {address}.|Ship to: {name}, {address}|Signed, {name}|I asked Mr. {last} twice.|Ask Mrs {last}.|The patient, {name}, was seen on Tuesday.|Her name was {given}.
His passport is {id} and his account is {number}.|SSN {ssn} belongs to {name}.|Transfer it to IBAN {iban} please.
Mein Name ist {name}.|Herr {last} wohnt in {german}.|Frau {last} kommt.|Frau {name} hat die Kontonummer {number}.|Sehr geehrter Herr {last},
Der Reisepass {id} ist verloren.|Je m'appelle {name} et je vis {french}.|Monsieur {last} est absent.|Madame {name} habite {french}.
Le compte {number} est vide.|Me llamo {name}.|La señora {name} vive en {spanish}.|Mme {last} est là.|Es la Sra. {last}.|El señor {last} tiene la cuenta {number}.
Customer {name}, account {number}, phone {phone}.|Call {phone} or write to {email}.|I met {given} {last} there.|Mail: {email}"""
AGAIN = """We did not hear from {last} again.|Then {last} left.|They saw {given} in the garden.|It was {last} who paid.|Nobody asked {last}.
Das ist {lasts} Haus.|We know the {lasts} well.|Später kam {last} zurück.|Alors {last} est parti.|Luego vino {last}.|Only {given} and the others knew.|The house of {last} is empty."""
ORDINARY = """The street was long and the road empty.|In 1998 there were 45000 people here.|Order 12345678 was shipped on Monday.
The name of the game is patience.|He took into account that it was late.|A contact at the border was made.|On Monday the court met again.
Chapter 12 is about the social life of bees.|Das Konto der Firma war leer.|Der Weg war weit.|La rue est longue.|La plaza es grande.
The Internet grew in 2004 and 2005.|On Friday, Paris was quiet; Paris is large.|Dear all, thank you.|Version 2.1 came out in March 2011.
The customer is king.|Item 4711 costs 12000 dollars.|We live in a large court near the square.|The avenue has 300 trees.|Total 1234567890 units.
Signed and sealed.|The patient waited.|See table 1024 for details.|No passport is needed.|License terms apply.|Best regards|The account is old."""
COMMON = ("the of and to in is was it for on with as at by from this that they which his her one all there been many some time very "
          "when much new also people about could water work year der die und das nicht ein zu les des une dans pour los las una con").split()
PARTS = "ka lo mi ren tor sen bur gal dim vas pel nor hul zet fin mar ost wick berg ley man ton ham dez ric".split()


def person(draw: random.Random) -> tuple[str, str]:
    """A given name, listed or made up, and a family name made up of parts."""
    made = lambda: "".join(draw.choice(PARTS) for _ in range(draw.randint(2, 3))).title()
    given = draw.choice(WORDS["given"].split()).title() if draw.random() < 0.5 else made()
    return given, made()


def noise(draw: random.Random, count: int) -> str:
    """Words without meaning, sometimes in capitals, with symbols, or around a number that a pattern finds."""
    words = [draw.choice(COMMON) if draw.random() < 0.7 else draw.choice(PARTS) + draw.choice(PARTS) for _ in range(count)]
    words = [w.capitalize() if i == 0 or draw.random() < 0.03 else w for i, w in enumerate(words)]
    if draw.random() < 0.3:
        words[draw.randrange(1, count)] = draw.choice(["{ip}", "{phone}", "{email}", "9870157079875996"])
    if draw.random() < 0.2:
        words = [w if w.startswith("{") else w.upper() for w in words]
    return draw.choice([" ", " ", " ", "!! ", "$$$ ", " | ", ", "]).join(words) + draw.choice([".", ".", ",", "!"])


def example(draw: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A labelled text: (label, start, end) in code points. Made up by rule, so it concerns nobody."""
    given, last = person(draw)
    figures = lambda n: "".join(draw.choice(string.digits) for _ in range(n))
    place = draw.choice(PARTS).title() + draw.choice(PARTS)
    slots = {
        "given": (NAME, lambda: given), "last": (NAME, lambda: last), "lasts": (NAME, lambda: f"{last}s"),
        "name": (NAME, lambda: draw.choice([f"{given} {last}", f"{given} {draw.choice(string.ascii_uppercase)}. {last}"])),
        "address": (ADDRESS, lambda: f"{draw.randint(1, 400)} {place} {draw.choice(['Street', 'Avenue', 'Road', 'Lane', 'Drive'])}"),
        "german": (ADDRESS, lambda: draw.choice([f"{place}straße {draw.randint(1, 99)}", f"{place}allee {draw.randint(1, 99)}"])),
        "french": (ADDRESS, lambda: f"{draw.randint(1, 99)} rue {place}"),
        "spanish": (ADDRESS, lambda: f"calle {place} {draw.randint(1, 99)}"),
        "id": (NUMBER, lambda: draw.choice(["", draw.choice(string.ascii_uppercase)]) + figures(8)),
        "number": (NUMBER, lambda: draw.choice([figures(10), f"{figures(3)} {figures(4)} {figures(3)}"])),
        "ssn": (NUMBER, lambda: f"{figures(3)}-{figures(2)}-{figures(4)}"),
        "iban": (NUMBER, lambda: f"DE{figures(2)} " + " ".join(figures(4) for _ in range(4)) + " " + figures(2)),
        "email": (NONE, lambda: f"{draw.choice([given.lower(), draw.choice(COMMON)])}.{draw.randint(1, 99)}@mail.example.com"),
        "phone": (NONE, lambda: f"+1 ({figures(3)}) 555-{figures(4)}"),
        "ip": (NONE, lambda: ".".join(str(draw.randint(1, 255)) for _ in range(4))),
    }
    own, again, other = (draw.sample(re.split(r"[|\n]", x), 3) for x in (SENTENCES, AGAIN, ORDINARY))
    lines = [*own[: draw.randint(0, 3)], *other[: draw.randint(0, 3)], noise(draw, 8), noise(draw, 5)]
    lines += [*again[: draw.randint(0, 2)] * any("{name}" in x for x in lines), noise(draw, 6)]
    text, marks = "", []
    for line in lines:
        for part in re.split(r"(\{\w+\})", line):
            label, value = slots[part[1:-1]] if part.startswith("{") else (NONE, lambda part=part: part)
            value = value()
            if label:
                marks.append((label, len(text), len(text) + len(value)))
            text += value
        text += draw.choice([" ", "\n"])
    return text, marks


class Finder:
    """Base spans and the field's spans of texts."""

    def __init__(self, numbers: dict[str, int], field: SkipChain, sure: float = SURE):
        self.numbers, self.field, self.sure = numbers, field, sure
        self.hasher = Hasher()
        self.lexicon = lexicon(self.hasher)

    def spans(self, texts: Sequence[bytes], skips: bool = True) -> list[list[tuple[int, int, int]]]:
        """For each text (kind, start, end) in bytes by kind, then start."""
        base = [base_spans(t) for t in texts]
        covered = [Tokens(t, b, self.hasher, self.lexicon) for t, b in zip(texts, base)]
        nodes, _ = self.field.marginals(joined([c.graph(self.numbers) for c in covered]), skips=skips)
        at, out = 0, []
        for b, c in zip(base, covered):
            mine = nodes[at : at + len(c.nodes)]
            at += len(c.nodes)
            out.append(b + sorted(c.found(mine, self.sure)) if (mine[:, 1:] >= self.sure).any() else b)
        return out


def lexicon(hasher: Hasher) -> np.ndarray:
    """The sorted hashes of all words with a class, as lower-cased by bytes, accented capitals included."""
    forms = {w for word in CLASS for w in (word, word.capitalize())}
    data = [f.encode().lower() for f in forms]
    return np.unique(np.concatenate([hasher.words(np.frombuffer(d, np.uint8), np.array([0]), np.array([len(d)])) for d in data]))


@functools.lru_cache(4)
def learned(count: int = 260, seed: int = 7) -> tuple[dict[str, int], SkipChain]:
    """Feature numbers and the field, learned from ``count`` labelled examples."""
    draw, hasher, numbers = random.Random(seed), Hasher(), {}
    words = lexicon(hasher)
    graphs, truth = [], []
    for _ in range(count):
        text, marks = example(draw)
        data = text.encode()
        tokens = Tokens(data, base_spans(data), hasher, words)
        graphs.append(tokens.graph(numbers, grow=True))
        labels = np.zeros(len(tokens.nodes), np.int64)
        for label, a, b in marks:
            a, b = len(text[:a].encode()), len(text[:b].encode())
            labels[(tokens.starts[tokens.nodes] >= a) & (tokens.ends[tokens.nodes] <= b)] = label
        labels = np.where(graphs[-1].known >= 0, graphs[-1].known, labels)
        truth.append(labels)
    return numbers, SkipChain(4, len(numbers)).fit(joined(graphs), np.concatenate(truth))


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = 260) -> DataFrame:
    """One row for each input row: doc_id and an array of spans as text ``kind:start:stop`` in code points, by kind as listed in
    ``KINDS``, then start.

    ``email``, ``ip``, ``card`` and ``phone`` are leftmost non-overlapping matches of fixed patterns; they may overlap each other.
    ``name``, ``address`` and ``number`` come from a skip-chain random field, learned from ``count`` made-up examples, and do not
    overlap base spans. Its variables are the tokens near evidence (titles, given names, words of addresses and documents, numbers,
    base spans) and all tokens of the text that repeat such a one, so what stands with a name once is found wherever it is
    repeated. Every other token is no personal data by definition. Null and empty texts have no spans; null ids and repeated rows are scanned like any
    other; time and memory are in proportion to a text's length.
    """
    numbers, field = learned(count)

    def make() -> Callable:
        finder = Finder(numbers, field)

        def part(ids: list, texts: list) -> list[tuple]:
            return [(id, list(written(text, found))) for id, text, found in zip(ids, texts, finder.spans(texts))]

        return part

    return map_parts(text_bytes(docs, id_col, text_col), make, "doc_id long, spans array<string>")


def written(text: bytes, found: list[tuple[int, int, int]]) -> Iterator[str]:
    if found:
        chars = np.concatenate([[0], np.cumsum(LEADS[np.frombuffer(text, np.uint8)], dtype=np.int64)])
        for kind, start, end in found:
            yield f"{KINDS[kind]}:{chars[start]}:{chars[end]}"


def mask_private(docs: DataFrame, text_col: str = "text", count: int = 260) -> DataFrame:
    """All rows and columns, every span in the text replaced by its kind in brackets; of spans that overlap, the part that is left
    counts to the first."""
    numbers, field = learned(count)

    def masked(text: bytes, found: list[tuple[int, int, int]]) -> bytes:
        out, at = [], 0
        for kind, start, end in sorted(found, key=lambda f: (f[1], -f[2])):
            if start >= at:
                out += [text[at:start], f"[{KINDS[kind].upper()}]".encode()]
            at = max(at, end)
        return b"".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(numbers, field)
        for batch in batches:
            for part in slices(batch):
                at = part.schema.get_field_index(text_col)
                texts = part.column(at).to_pylist()
                data = [(t or "").encode() for t in texts]
                new = [t if t is None else masked(d, f).decode() for t, d, f in zip(texts, data, finder.spans(data))]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
