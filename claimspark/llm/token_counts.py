"""Token counts by a compiled finite-state transducer.

The byte-level BPE of a `tokenizer.json` is compiled, as far as texts need it, into a deterministic transducer
over bytes. A state stands for everything the future can depend on: the longest suffix that is a proper
prefix of some vocabulary entry, with the last token and the relative token count at each byte boundary in it.
Each transition carries the change of the emitted-token count. A prefix's last token is the one entry that ends
there and whose pair with the last token before it stays unmerged (two tokens are such a pair when merging
their bytes by rank gives them back), so the annotated counts equal those of merging by rank.

Texts are cut into chunks of fixed length. A chunk's state map is kept in closed form: the piece before its
first synchronising position, the count emitted between, and the piece after its last one. (A
pre-token never holds a white-space character after another one, so the automaton restarts at any such place
whatever the state before.) State maps form a monoid; they are composed by a balanced prefix scan.

Defined results: null text is empty and has no token; repeated rows are counted each; special strings
inside texts are single tokens, as the library's default; an empty table gives an empty result; very long texts are
handled chunk by chunk; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from claimspark.llm.common import prepare

CHUNK_CHARS = 1 << 14
#: Entries kept in a worker's caches; a full cache is emptied, which costs time and changes nothing.
CACHE_ENTRIES = 1 << 20

# Fixed values of the byte-level pre-tokenizer.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def _category_class(letter: str) -> str:
    """Ranges of all characters of a major Unicode category, for a regular-expression class."""
    out, start = [], None
    for cp in range(sys.maxunicode + 2):
        inside = cp <= sys.maxunicode and unicodedata.category(chr(cp))[0] == letter
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(re.escape(chr(start)) + ("-" + re.escape(chr(cp - 1)) if cp - 1 > start else ""))
            start = None
    return "".join(out)


def byte_alphabet() -> dict[str, int]:
    """The vocabulary's printable stand-ins for bytes: printable Latin-1 stands for itself, the rest follows from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """The lazily compiled transducer of one vocabulary: `count(bytes)` runs it over one pre-token."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        alphabet = byte_alphabet()
        plain = lambda s: bytes(alphabet[c] for c in s)
        self.rank = {}
        for i, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((plain(a), plain(b)), i)
        self.entries = {a + b for a, b in self.rank} | {bytes([b]) for b in range(256)}
        self.prefixes = {e[:i] for e in self.entries for i in range(len(e))}
        self.ends: dict[bytes, int] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states = [(b"", ((None, 0),))]
        self.numbers = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        self.pairs.clear()

    def merge(self, data: bytes) -> list[bytes]:
        """Merging by rank, directly: the definition that the compiled pairs are checked by."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def stays(self, a: bytes | None, b: bytes) -> bool:
        """True when the tokens a, b side by side are what merging their bytes gives."""
        if a is None:
            key = (b"", b)
            if key not in self.pairs:
                self.pairs[key] = self.merge(b) == [b]
            return self.pairs[key]
        key = (a, b)
        got = self.pairs.get(key)
        if got is None:
            got = self.pairs[key] = self.merge(a + b) == [a, b]
        return got

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """Compile one transition: the next state and the change of the count."""
        suffix, held = self.states[state]
        grown = suffix + bytes([byte])
        here = held[-1][1]
        last = count = None
        for i in range(len(grown)):  # entries that end here, longest first
            entry = grown[i:]
            if entry in self.entries:
                before, n = held[i]
                if self.stays(before, entry):
                    last, count = entry, n + 1
                    break
        if last is None:
            raise ValueError("the vocabulary has no unique reading for a byte string")
        held = (*held, (last, count))
        cut = next(i for i in range(len(grown) + 1) if grown[i:] in self.prefixes)
        suffix, held = grown[cut:], held[cut:]
        base = held[-1][1]
        key = (suffix, tuple((t, n - base) for t, n in held))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        move = self.moves[state][byte] = (number, base - here)
        return move

    def count(self, data: bytes) -> int:
        if len(self.states) > CACHE_ENTRIES:
            self._reset()
        state = total = 0
        moves = self.moves
        for byte in data:
            move = moves[state].get(byte) or self._move(state, byte)
            state = move[0]
            total += move[1]
        return total


class _Counts(dict):
    """Pre-token -> token count, filled by the transducer."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, token: str) -> int:
        n = self.transducer.count(token.encode("utf-8"))
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[token] = n
        return n


class TokenCounter:
    """Counts of whole texts under a byte-level BPE `tokenizer.json`."""

    def __init__(self, path: str, chunk_chars: int = CHUNK_CHARS) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("only byte-level BPE without a normalizer is compiled")
        self.chunk_chars = chunk_chars
        self.counts = _Counts(Transducer(spec["model"]["vocab"], spec["model"]["merges"]))
        specials = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        letters, numbers, space = _category_class("L"), _category_class("N"), WHITE_SPACE
        self.words = re.compile(
            "|".join(CONTRACTIONS) + f"| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+"
            + f"|[{space}]+(?![^{space}])|[{space}]+")
        self.sync = re.compile(f"(?<=[^{space}])(?=[{space}])")
        self.last_sync = re.compile(f".*[^{space}](?=[{space}])", re.DOTALL)

    def run(self, piece: str) -> int:
        """Tokens of a piece that starts and ends at synchronising positions."""
        if self.special and self.special.search(piece):
            at = total = 0
            for m in self.special.finditer(piece):
                total += sum(map(self.counts.__getitem__, self.words.findall(piece[at:m.start()]))) + 1
                at = m.end()
            return total + sum(map(self.counts.__getitem__, self.words.findall(piece[at:])))
        return sum(map(self.counts.__getitem__, self.words.findall(piece)))

    def state_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(piece before the first synchronising position, count between, piece after the last); None: there is none."""
        first = self.sync.search(chunk)
        if first is None:
            return chunk, None, ""
        last = self.last_sync.match(chunk).end()
        return chunk[:first.start()], self.run(chunk[first.start():last]), chunk[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """State map of chunk a followed by chunk b; the seam may hold a synchronising position of its own."""
        if a[1] is None and b[1] is None:
            return self.state_map(a[0] + b[0])
        if a[1] is None:
            head = self.state_map(a[0] + b[0])
            return (head[0], b[1], b[2]) if head[1] is None else (head[0], head[1] + self.run(head[2]) + b[1], b[2])
        if b[1] is None:
            tail = self.state_map(a[2] + b[0])
            return (a[0], a[1], tail[0]) if tail[1] is None else (a[0], a[1] + self.run(tail[0]) + tail[1], tail[2])
        return a[0], a[1] + self.run(a[2] + b[0]) + b[1], b[2]

    def count(self, text: str) -> int:
        size = self.chunk_chars
        if len(text) <= size:
            return self.run(text)
        maps = [self.state_map(text[i:i + size]) for i in range(0, len(text), size)]
        while len(maps) > 1:  # balanced scan
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, count, tail = maps[0]
        return self.run(head) if count is None else self.run(head) + count + self.run(tail)


_COUNTERS: dict[tuple[str, int], TokenCounter] = {}


def counter(path: str, chunk_chars: int = CHUNK_CHARS) -> TokenCounter:
    """The worker process's compiled counter for a vocabulary file."""
    key = (path, chunk_chars)
    if key not in _COUNTERS:
        _COUNTERS[key] = TokenCounter(path, chunk_chars)
    return _COUNTERS[key]


def _count_batches(batches: Iterator[pa.RecordBatch], path: str, limit: int,
                   chunk_chars: int) -> Iterator[pa.RecordBatch]:
    own = counter(path, chunk_chars)
    for batch in batches:
        n_bytes, n_tokens = [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            n_bytes.append(len(text.encode("utf-8")))
            n_tokens.append(own.count(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
             pa.array([n > limit for n in n_tokens], pa.bool_())],
            names=["id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text",
                 chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row; no shuffle.

    `vocabulary` is the path of a byte-level BPE `tokenizer.json` that every executor can open.
    """
    prepare(docs.sparkSession)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(lambda it: _count_batches(it, vocabulary, limit, chunk_chars),
                         f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
