"""The numpy half of the stored index (`evidence_index.write_index`): texts to packed postings, packed postings to blocks.

    texts --take_apart--> a row per (piece of the table, shard, slot): terms, and the places and counts of their documents
          --squares--> each document's sum of squared weights, by piece, from the shards a task holds
          --cut_blocks--> blocks of (doc, w)

A posting takes about four bytes on the way from the texts to its shard, and neither texts nor the vocabulary are sent around:
a document's place in its piece stands for its id, and a term's document frequency is counted where all of its postings meet.
Tasks hold one slot of a shard at a time, and 20 bytes for each document of the corpus (id, hash, length).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Bytes of text, and documents, of a piece at most (a longer text is a piece of its own).
PIECE_BYTES = 4 << 20
PIECE_DOCS = 1 << 16
#: `shard` of the rows that hold a piece's documents.
DOCUMENTS = -1

_TOKEN = np.zeros(256, dtype=bool)
for _a, _b in ("09", "az", "AZ", "__"):
    _TOKEN[ord(_a):ord(_b) + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative whole numbers in the one, two or four bytes each that the largest needs."""
    top = int(numbers.max()) if numbers.size else 0
    return numbers.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n if n else 1}").astype(np.int64)


def word_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of its text, token) of every token, as `tokens(clean_text(text))` has them: runs of two or more ASCII word
    characters, lower-cased after everything else has become a space. A missing text has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    word = _TOKEN[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[ends] = True  # no run goes on into the next text
    at = np.flatnonzero(edge)
    start, size = at[:-1], np.diff(at)
    keep = word[start] & (size > 1)
    chars = _LOWER[data[np.repeat(keep, size)]]
    start, size = start[keep], size[keep]
    return np.searchsorted(ends, start, "right") - 1, _strings(chars, size)


def _strings(chars: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.append(0, np.cumsum(sizes)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(chars))])


def _pieces(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    ends, row = np.cumsum(sizes), 0
    while row < len(ends):
        most = (ends[row - 1] if row else 0) + PIECE_BYTES
        stop = min(max(row + 1, int(np.searchsorted(ends, most, "right"))), row + PIECE_DOCS)
        yield batch.slice(row, stop - row)
        row = stop


def packed_schema(doc_type: str) -> str:
    return f"piece long, shard int, slot int, size int, n int, lengths binary, terms binary, counts binary, places binary, tfs binary, ids array<{doc_type}>, hashes binary"


def _packed_rows(piece: int, docs: pa.RecordBatch, at: np.ndarray, terms: pa.Array, tf: np.ndarray | None, shards: int, slots: int):
    """Rows of `packed_schema` of one piece. `tf`: occurrences of each (document, term), already distinct; None: count them."""
    coded = terms.dictionary_encode()
    crc = np.fromiter(map(zlib.crc32, coded.dictionary.cast(pa.large_binary()).to_pylist()), np.int64, len(coded.dictionary))
    group = crc % shards * slots + crc // shards % slots
    order = np.argsort(group, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    key = rank[coded.indices.to_numpy().astype(np.int64)] * PIECE_DOCS + at
    if tf is None:
        key, tf = np.unique(key, return_counts=True)
    else:
        by = np.argsort(key)
        key, tf = key[by], tf[by]
    counts, places = np.bincount(key // PIECE_DOCS, minlength=len(order)), key % PIECE_DOCS
    ends = np.append(0, np.cumsum(counts))
    words = coded.dictionary.take(pa.array(order))
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    letters, chars = np.append(0, np.cumsum(lengths)), words.buffers()[2].to_pybytes() if len(words) else b""
    group = group[order]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(first, np.append(first[1:], len(group))):
        p = slice(ends[a], ends[b])
        yield (piece, int(group[a]) // slots, int(group[a]) % slots, len(docs), int(b - a), pack(lengths[a:b]), chars[letters[a]:letters[b]], pack(counts[a:b]),
               pack(places[p]), pack(tf[p]), None, None)


def take_apart(shards: int, slots: int, counted: bool, schema: pa.Schema):
    """Rows (doc, hash, text), or with `counted` (doc, hash, terms, tfs) of a document's distinct terms, to packed rows."""
    def run(batches):
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            width = pc.list_value_length(batch.column("terms")) if counted else pc.binary_length(batch.column("text"))
            for docs in _pieces(batch, pc.fill_null(width, 0).to_numpy(zero_copy_only=False).astype(np.int64) * (16 if counted else 1)):
                if counted:
                    terms, tf = (docs.column(c).flatten() for c in ("terms", "tfs"))
                    at = np.repeat(np.arange(len(docs)), pc.list_value_length(docs.column("terms")).to_numpy(zero_copy_only=False))
                    terms, tf = terms.cast(pa.large_string()), tf.to_numpy(zero_copy_only=False).astype(np.int64)
                else:
                    (at, terms), tf = word_tokens(docs.column("text")), None
                rows = [*_packed_rows(piece, docs, at, terms, tf, shards, slots)]
                hashes = docs.column("hash").to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
                rows.append((piece, DOCUMENTS, 0, len(docs), 0, *[None] * 5, docs.column("doc"), hashes))
                yield pa.RecordBatch.from_arrays([
                    pa.array([x.to_pylist() if isinstance(x, pa.Array) else x for x in c], f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                piece += 1
    return run


class _Slot:
    """The postings of one slot of a shard, of all pieces: `code` of the term in `terms`, `idf` of each term."""

    def __init__(self, rows: list[dict], n_docs: int):
        lengths, counts = ([unpack(r[c], r["n"]) for r in rows] for c in ("lengths", "counts"))
        chars = np.frombuffer(b"".join(r["terms"] for r in rows), np.uint8)
        coded = _strings(chars, np.concatenate(lengths)).dictionary_encode()
        self.held = [int(c.sum()) for c in counts]  # postings of each row
        self.terms = coded.dictionary
        self.code = np.repeat(coded.indices.to_numpy().astype(np.int64), np.concatenate(counts))
        self.places = np.concatenate([unpack(r["places"], n) for r, n in zip(rows, self.held)])
        tfs = np.concatenate([unpack(r["tfs"], n) for r, n in zip(rows, self.held)])
        self.df = np.bincount(self.code, minlength=len(self.terms))
        self.idf = np.log((1 + n_docs) / (1 + self.df)) + 1.0
        self.weight = (1.0 + np.log(tfs)) * self.idf[self.code]


def _slots(batches, n_docs: int) -> Iterator[tuple[int, list[dict], _Slot]]:
    """(shard, packed rows, postings) of each slot in a task whose rows are sorted by (shard, slot)."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["shard"], row["slot"]) != (held[0]["shard"], held[0]["slot"]):
                yield held[0]["shard"], held, _Slot(held, n_docs)
                held = []
            held.append(row)
    if held:
        yield held[0]["shard"], held, _Slot(held, n_docs)


SQUARES = "piece long, squares binary"


def squares(n_docs: int):
    """The sum of squared weights of each document, over the shards of a task: a row for each piece."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for _, rows, slot in _slots(batches, n_docs):
            at = np.append(0, np.cumsum(slot.held))
            for row, a, b in zip(rows, at, at[1:]):
                own = np.bincount(slot.places[a:b], slot.weight[a:b] ** 2, row["size"])
                sums[row["piece"]] = sums[row["piece"]] + own if row["piece"] in sums else own
        for piece, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["piece", "squares"])
    return run


def add_squares(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.float64) for b in table["squares"].to_pylist())
    return pa.table({"piece": table["piece"][:1], "squares": pa.array([total.tobytes()], pa.binary())})


def document_table(pieces: pa.Table) -> dict:
    """Ids, hashes and lengths of all documents, and the place of each piece's first one. From (piece, ids, hashes, squares)."""
    sizes = pc.list_value_length(pieces["ids"]).to_numpy().astype(np.int64)
    squares = [np.zeros(n) if s is None else np.frombuffer(s, np.float64) for n, s in zip(sizes, pieces["squares"].to_pylist())]
    ids = pieces["ids"].combine_chunks()
    return {"first": dict(zip(pieces["piece"].to_pylist(), (np.cumsum(sizes) - sizes).tolist())),
            "ids": (ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids).flatten(),
            "hash": np.frombuffer(b"".join(pieces["hashes"].to_pylist()), np.int32),
            "length": np.sqrt(np.concatenate([*squares, np.zeros(0)]))}


def cut_blocks(shared, n_docs: int, block: int, schema: pa.Schema):
    """Blocks of `schema` (term, band, part, n, max_w, postings, shard), sorted by term within a slot. `shared`: a `document_table`."""
    def run(batches):
        known = shared.value
        for shard, rows, slot in _slots(batches, n_docs):
            doc = np.repeat([known["first"][r["piece"]] for r in rows], slot.held) + slot.places
            w = slot.weight / known["length"][doc]
            band = np.minimum(np.floor(-np.log2(w)), 30).astype(np.int64)
            part = known["hash"][doc] % -(-slot.df // block)[slot.code]
            by_term = pc.sort_indices(slot.terms).to_numpy()
            rank = np.empty_like(by_term)
            rank[by_term] = np.arange(len(by_term), dtype=by_term.dtype)
            order = np.lexsort((part, band + 32 * rank[slot.code].astype(np.int64)))
            code, band, part, doc, w = (x[order] for x in (slot.code, band, part, doc, w))
            new = np.append(True, (np.diff(code) != 0) | (np.diff(band) != 0) | (np.diff(part) != 0))
            first = np.flatnonzero(new)
            ends = pa.array(np.append(first, len(w)), pa.int32())
            pairs = pa.StructArray.from_arrays([known["ids"].take(pa.array(doc)), pa.array(w)], names=["doc", "w"])
            columns = [slot.terms.take(pa.array(code[first])).cast(pa.string()), band[first], part[first], np.diff(np.append(first, len(w))),
                       np.maximum.reduceat(w, first), pa.ListArray.from_arrays(ends, pairs), np.full(len(first), shard)]
            yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, schema)], schema=schema)
    return run
