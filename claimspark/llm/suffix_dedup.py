"""Repeated byte strings across documents by names of grams and windows at growing lengths, in place of prefix doubling.

Asked: every byte covered by a string of `length` bytes that also starts in a document with a smaller id.

No pairs (rank[i], rank[i + k]) are formed and no offset doubles: hashes of byte strings stand in for the ranks. Suffix positions
are compared by growing prefixes; a position leaves as soon as its prefix is unique (no other document has
it) or the threshold is passed. Three things keep the volume down, none of which loses a string:

* Ranking starts at `GRAM` bytes (a 64-bit name packs them), not at one.
* Only synchronised positions are ranked. Every `length`-byte window owns the smallest of its grams (leftmost among
  equals); equal windows own it at the same place, so a position stands for the run of windows that own it.
* Ranks are only compared inside one fragment of the names, to which Spark shuffles the (name, position) pairs;
  the task sorts them.

Round 1 sorts the gram names and drops positions whose gram stands in one document only. Round 2 sorts the survivors by (gram
name, name of the bytes of all its windows), the prefix grown past the threshold on both sides: positions whose whole run
stands in a smaller document are done; the first holder of each run stays only where its gram has other
runs too. Round 3 sorts those by their single windows.

Hot strings: a batch (about a megabyte of texts) sends every name once, with its smallest id, however many of its texts have it, and
keeps the places for the answer. A gram of many batches is hot: its runs, and in round 3 its single windows, are dealt by
names of their own instead of the gram's, so contexts of one famous string spread over all tasks. No pair of
documents is ever made. Texts are joined to the verdicts by (id, text hash).

Names are 64-bit hashes. Defined results: null text is empty; texts below `length` bytes keep all; documents with equal ids are not
smaller than each other; a null id is larger than any other; repeated rows get one result each; an empty table gives
an empty result; other columns are ignored (or kept by `remove_repeats`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm import common as C

#: Bytes of the first rank.
GRAM = 20
#: Batches from which on a gram counts as hot (only the dealing differs).
HOT_BATCHES = 64
_HOT = 1 << 62
NO_ID = (1 << 63) - 1


#: Bytes that the ranking of positions holds in its working arrays at once (a longer single text is one part).
PART_BYTES = 1 << 18


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(position, first window, last window, gram name, run name, text) of every synchronised position, in order.

    A window is the start of `length` bytes inside one text; a run's name covers all its windows' bytes.
    """
    parts = []
    for low, _, b, o in C.pieces(buf, offs, PART_BYTES):
        pos, first, last, names, sums = _anchors(b, o, length, gram)
        runs = C.mix(C.span_hash(sums, first, last + length) * C._ODD + (pos - first).astype(np.uint64) * np.uint64(257)
                     + (last - first).astype(np.uint64))
        base = int(offs[low])
        # chosen names are small ones; mixed again, they spread evenly over fragments
        parts.append((pos + base, first + base, last + base, C.mix(names + C._ODD), runs,
                      np.searchsorted(o, pos, "right") - 1 + low))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    return tuple(np.concatenate(column) for column in zip(*parts))


def _anchors(buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(position, first window, last window, gram name) of every synchronised position, and the hash sums."""
    none = np.zeros(0, dtype=np.int64)
    sums = C.prefix_sums(buf)
    n = len(buf)
    if n < length:
        return none, none, none, none.astype(np.uint64), sums
    at = np.arange(n - gram + 1)
    names = C.mix(C.span_hash(sums, at, at + gram))
    bits = np.uint64(int(n).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    values = (names & ~low) | at.astype(np.uint64)
    span, width = length - gram + 1, 1
    least = values
    while width * 2 <= span:  # minima over doubling widths
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:len(values) - span + 1], least[span - width:])
    valid = np.zeros(n + 1, dtype=np.int32)
    long = np.diff(offs) >= length
    np.add.at(valid, offs[:-1][long], 1)
    np.add.at(valid, offs[1:][long] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    owner = (least[windows] & low).astype(np.int64)
    if not len(windows):
        return none, none, none, none.astype(np.uint64), sums
    cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    first, last = windows[cut], windows[np.append(cut[1:], len(windows)) - 1]
    return owner[cut], first, last, names[owner[cut]], sums


def _fragment_of(names: np.ndarray, fragments: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def _small(values: np.ndarray) -> np.ndarray:
    """The same values in the narrowest type."""
    if len(values) and values.min() < 0:
        return values.astype(np.int64)
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _dump(values: np.ndarray) -> bytes:
    """An array with its type in front."""
    return values.dtype.str.encode().ljust(8) + values.tobytes()


def _load(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.dtype(data[:8].decode().strip()), offset=8)


def home_fragment(batch: int, fragments: int) -> int:
    """The fragment that carries a batch's own columns (batch: partition << 32 | number); batches spread over all."""
    return ((batch >> 32) * 31 + (batch & 0xFFFFFFFF)) % fragments


def _rows(fragment: np.ndarray, fragments: int, batch: int, columns: dict[str, np.ndarray], **head) -> list[dict]:
    """One row per fragment with its slice of every column; the batch's home fragment always has one, with `head`.

    `base` is the place of the slice's first entry in fragment order (see `_dealt`), by which answers find back.
    """
    home = home_fragment(batch, fragments)
    order = np.argsort(fragment, kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(fragment, minlength=fragments))])
    columns = {c: v[order] for c, v in columns.items()}
    out = []
    for f in range(fragments):
        if f == home or cut[f] < cut[f + 1]:
            row = {c: _dump(_small(v[cut[f]:cut[f + 1]]) if c not in ("name", "key") else v[cut[f]:cut[f + 1]])
                   for c, v in columns.items()}
            out.append({"batch": batch, "fragment": f, "base": _dump(cut[f:f + 1]), **row,
                        **{k: v if f == home else None for k, v in head.items()}})
    return out


def _schema(binaries: str) -> pa.Schema:
    return pa.schema([("batch", pa.int64()), ("fragment", pa.int32()), *[(c, pa.binary()) for c in binaries.split()]])


def _sql(binaries: str) -> str:
    return "batch long, fragment int, " + ", ".join(f"{c} binary" for c in binaries.split())


def _input(batches: Iterator[pa.RecordBatch]):
    """Pieces of (id, key, text, ...) batches: batch number, ids, keys, bytes, offsets, (batch, first row)."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
        buf, offs = C.column_bytes(batch.column("text"))
        for low, high, b, o in C.pieces(buf, offs):
            yield (part << 32) | number, ids[low:high], keys[low:high], b, o, batch, low
            number += 1
        del buf, batch
        C.give_back()


def _dealt(fragment: np.ndarray) -> np.ndarray:
    """Each entry's place in fragment order, the order in which `_rows` deals them."""
    out = np.empty(len(fragment), dtype=np.int64)
    out[np.argsort(fragment, kind="stable")] = np.arange(len(fragment))
    return out


# -- round 1: grams -----------------------------------------------------------------

_GRAMS = "name doc ids keys near_doc near_of near_code"


def _send_grams(batches, length: int, gram: int, fragments: int) -> Iterator[pa.RecordBatch]:
    for number, ids, keys, b, o, _, _ in _input(batches):
        _, _, _, names, _, doc = anchors(b, o, length, gram)
        # a gram once per text, and once per batch: with its text, or 0 if several texts have it
        order = np.lexsort((doc, names))
        doc, names = doc[order], names[order]
        once = np.ones(len(doc), dtype=bool)
        once[1:] = (doc[1:] != doc[:-1]) | (names[1:] != names[:-1])
        doc, names = doc[once], names[once]
        first = np.ones(len(doc), dtype=bool)
        first[1:] = names[1:] != names[:-1]
        many = np.diff(np.append(np.flatnonzero(first), len(doc))) > 1
        near = many[np.cumsum(first) - 1] if len(doc) else first
        holder = np.where(near, 0, doc + 1)[first]
        names_once = names[first]
        out = _rows(_fragment_of(names_once, fragments), fragments, number,
                    {"name": names_once.astype(np.uint32), "doc": holder}, ids=_dump(ids), keys=_dump(keys),
                    near_doc=_dump(_small(doc[near])), near_of=_dump(_small((np.cumsum(many) - 1)[np.cumsum(first) - 1][near])),
                    near_code=_dump(gram_codes(names_once[many], fragments)))
        yield pa.RecordBatch.from_pylist(out, _schema(_GRAMS))


def gram_codes(names: np.ndarray, fragments: int) -> np.ndarray:
    return (_fragment_of(names, fragments) << 32) | names.astype(np.uint32).astype(np.int64)


def _repeated_grams(table: pa.Table) -> pa.Table:
    """Per batch: the gram names of one fragment that more than one text has; hot ones marked in the holder's sign."""
    rows = table.to_pylist()
    names = [_load(r["name"]) for r in rows]
    holders = [_load(r["doc"]).astype(np.int64) for r in rows]
    every, holder = np.concatenate(names), np.concatenate(holders)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(every) else np.zeros(0, np.int64)
    held = np.diff(np.append(start, len(every)))
    near = np.minimum.reduceat(holder[order], start) == 0 if len(every) else held > 0
    flags = np.empty((2, len(every)), dtype=bool)
    flags[0, order] = np.repeat((held > 1) | near, held)
    flags[1, order] = np.repeat(held >= HOT_BATCHES, held)
    out, at = [], 0
    for r, own, doc in zip(rows, names, holders):
        keep, hot = flags[:, at:at + len(own)]
        at += len(own)
        out.append({**r, "name": _dump(own[keep]), "doc": _dump(np.where(hot, -1 - doc, doc)[keep])})
    return pa.Table.from_pylist(out, _schema(_GRAMS))


def _grams_of_texts(table: pa.Table) -> pa.Table:
    """One row per text of a batch that has repeated grams: id, key, grams (code, the hot bit on top, in code order)."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["ids"] is not None)
    ids, keys = _load(head["ids"]), _load(head["keys"])
    doc = np.concatenate([_load(r["doc"]).astype(np.int64) for r in rows])
    code = np.concatenate([(r["fragment"] << 32) | _load(r["name"]).astype(np.int64) for r in rows])
    hot = doc < 0
    doc = np.where(hot, -1 - doc, doc)
    near_doc, near_of = _load(head["near_doc"]).astype(np.int64), _load(head["near_of"]).astype(np.int64)
    near_code = _load(head["near_code"])
    hot_near = np.isin(near_code, code[hot & (doc == 0)])[near_of]
    near_code = near_code[near_of]
    own = doc > 0
    doc = np.concatenate([doc[own] - 1, near_doc])
    code, hot = np.concatenate([code[own], near_code]), np.concatenate([hot[own], hot_near])
    order = np.lexsort((code, doc))
    doc, code = doc[order], np.where(hot[order], code[order] | _HOT, code[order])
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    have = np.flatnonzero(np.diff(cut))
    return pa.table({"id": ids[have], "key": keys[have],
                     "grams": pa.array([code[cut[k]:cut[k + 1]].tobytes() for k in have], pa.binary())})


# -- round 2: runs of windows -----------------------------------------------------------

_RUNS = "base name key id hot ids keys texts doc start size of hot_place"


def _once(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names, the smallest id of each, and the index of each given name among them."""
    values, back = np.unique(names, return_inverse=True)
    least = np.full(len(values), NO_ID, dtype=np.int64)
    np.minimum.at(least, back, ids)
    return values, least, back


def _send_runs(batches, length: int, gram: int, fragments: int) -> Iterator[pa.RecordBatch]:
    for number, ids, keys, b, o, batch, low in _input(batches):
        pos, first, last, names, whole, doc = anchors(b, o, length, gram)
        code = gram_codes(names, fragments)
        cut = np.searchsorted(doc, np.arange(len(ids) + 1))
        keep, hot = np.zeros(len(pos), dtype=bool), np.zeros(len(pos), dtype=bool)
        grams = batch.column("grams")
        for k in range(len(ids)):
            marked = np.frombuffer(grams[low + k].as_py(), np.int64)
            own, here = marked & (_HOT - 1), code[cut[k]:cut[k + 1]]
            place = np.minimum(np.searchsorted(own, here), len(own) - 1)
            keep[cut[k]:cut[k + 1]] = own[place] == here
            hot[cut[k]:cut[k + 1]] = marked[place] >= _HOT
        first, last, names, whole, doc, hot = (x[keep] for x in (first, last, names, whole, doc, hot))
        run, least, entry = _once(whole, ids[doc])
        some = np.zeros(len(run), dtype=np.int64)
        some[entry] = np.arange(len(entry))  # any place of each run tells its gram
        run_hot, run_gram = hot[some], names[some]
        fragment = np.where(run_hot, _fragment_of(run, fragments), _fragment_of(run_gram, fragments))
        out = _rows(fragment, fragments, number,
                    {"name": run_gram.astype(np.uint32), "key": run, "id": least, "hot": run_hot.astype(np.uint8)},
                    **_places(ids, keys, o, doc, first, last - first, _dealt(fragment)[entry], hot))
        yield pa.RecordBatch.from_pylist(out, _schema(_RUNS))


_ANSWERS = "base flags ids keys texts doc start size of hot_place"


def _answer(row: dict, smaller: np.ndarray, is_open: np.ndarray) -> dict:
    """For each entry of a row: 1 if a text smaller than all of the batch's own has the name, 2 if it stays open."""
    own = {c: row[c] for c in ("batch", "fragment", "base", "ids", "keys", "texts", "doc", "start", "size", "of", "hot_place")}
    return {**own, "flags": _dump(smaller.astype(np.uint8) + 2 * is_open.astype(np.uint8))}


def _places(ids, keys, o, doc, first, size, of, hot) -> dict[str, bytes]:
    """A batch's own columns: its texts, and for each place its text, first window (as steps), windows after it and entry."""
    return {"ids": _dump(ids), "keys": _dump(keys), "texts": _dump(_small(o[:-1])), "doc": _dump(_small(doc)),
            "start": _dump(_small(np.diff(first, prepend=0))), "size": _dump(_small(size)), "of": _dump(_small(of)),
            "hot_place": _dump(hot.astype(np.uint8))}


def _judge_runs(table: pa.Table) -> pa.Table:
    """Sorts one fragment's entries by (gram, run): whether a smaller id has the run, and whether its gram has other runs.

    Hot grams are dealt by run, so theirs always count as having others.
    """
    rows = table.to_pylist()
    name, key, hot = (np.concatenate([_load(r[c]) for r in rows]) for c in ("name", "key", "hot"))
    ids = np.concatenate([_load(r["id"]).astype(np.int64) for r in rows])
    order = np.lexsort((key, name))
    name, key = name[order], key[order]
    new_gram, new_run = np.ones(len(name), bool), np.ones(len(name), bool)
    new_gram[1:] = name[1:] != name[:-1]
    new_run[1:] = new_gram[1:] | (key[1:] != key[:-1])
    smaller, is_open = np.zeros(len(name), dtype=bool), hot > 0
    if len(name):
        run, start = np.cumsum(new_run) - 1, np.flatnonzero(new_run)
        smaller[order] = np.minimum.reduceat(ids[order], start)[run] < ids[order]
        others = np.bincount(np.cumsum(new_gram) - 1, weights=new_run)[np.cumsum(new_gram) - 1] > 1
        is_open[order] |= others
    out, at = [], 0
    for r in rows:
        own = slice(at, at + len(_load(r["name"])))
        at = own.stop
        out.append(_answer(r, smaller[own], is_open[own]))
    return pa.Table.from_pylist(out, _schema(_ANSWERS))


def _merge_runs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted window runs (first window, windows after it) with touching ones joined."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], (start + size)[order]
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1] + 1
    at = np.flatnonzero(new)
    return start[at], reach[np.append(at[1:], len(start)) - 1] - start[at]


def _answered(rows: list[dict], head: dict, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """For each place that a batch kept: seen in a smaller document, still open, and the place's columns."""
    rows = sorted(rows, key=lambda r: int(_load(r["base"])[0]))  # entries are dealt in fragment order
    flags = np.concatenate([_load(r["flags"]) for r in rows])
    place = {c: _load(head[c]).astype(np.int64) for c in ("doc", "start", "size", "of", "hot_place")}
    of, own = place["of"], ids[place["doc"]]
    place["start"] = np.cumsum(place["start"]) - _load(head["texts"]).astype(np.int64)[place["doc"]]
    least = np.full(len(flags), NO_ID, dtype=np.int64)  # in this batch
    np.minimum.at(least, of, own)
    done = (flags[of] & 1 > 0) | (least[of] < own)
    return done, ~done & (flags[of] & 2 > 0), place


def _runs_of_texts(table: pa.Table) -> pa.Table:
    """One row per text: its runs that are done, and the positions still asked about (first window * 2 + hot)."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["ids"] is not None)
    ids, keys = _load(head["ids"]), _load(head["keys"])
    done, asked, place = _answered(rows, head, ids)
    some = done | asked
    doc, start, size, hot = (place[c][some] for c in ("doc", "start", "size", "hot_place"))
    done, asked = done[some], asked[some]
    order = np.lexsort((start, doc))
    doc, start, size, hot, done, asked = (x[order] for x in (doc, start, size, hot, done, asked))
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    out = []
    for k in np.flatnonzero(np.diff(cut)):
        own = slice(cut[k], cut[k + 1])
        s, n = _merge_runs(start[own][done[own]], size[own][done[own]])
        out.append({"id": int(ids[k]), "key": int(keys[k]), "done": _dump(np.stack([s, n])) if len(s) else None,
                    "asked": _dump((start * 2 + hot)[own][asked[own]]) if asked[own].any() else None})
    return pa.Table.from_pylist(out, pa.schema([("id", pa.int64()), ("key", pa.int64()), ("done", pa.binary()),
                                                ("asked", pa.binary())]))


# -- round 3: single windows ---------------------------------------------------------------

_WINDOWS = "bytes run_doc run_id run_start run_size base name id ids keys texts doc start size of hot_place"


def _send_windows(batches, length: int, gram: int, fragments: int) -> Iterator[pa.RecordBatch]:
    """The windows of the positions asked about: as the bytes of their run by gram, or, for hot grams, by their own names."""
    for number, ids, keys, b, o, batch, low in _input(batches):
        _, first, last, names, _, doc = anchors(b, o, length, gram)
        cut = np.searchsorted(doc, np.arange(len(ids) + 1))
        keep, hot = np.zeros(len(first), dtype=bool), np.zeros(len(first), dtype=bool)
        asked = batch.column("asked")
        for k in range(len(ids)):
            marked = _load(asked[low + k].as_py())
            place = cut[k] + np.searchsorted(first[cut[k]:cut[k + 1]], (marked >> 1) + o[k])
            keep[place], hot[place] = True, (marked & 1) > 0
        cold = keep & ~hot
        name, least, of, at_window = _hot_windows(b, first[keep & hot], last[keep & hot], ids, doc[keep & hot], length)
        owner = np.searchsorted(o, at_window, "right") - 1
        dealt = _fragment_of(name, fragments)
        rows = {r["fragment"]: r for r in _rows(
            dealt, fragments, number, {"name": name, "id": least},
            **_places(ids, keys, o, owner, at_window, np.zeros(len(owner), np.int64), _dealt(dealt)[of],
                      np.zeros(len(owner), bool)))}
        first, last, names, doc = first[cold], last[cold], names[cold], doc[cold]
        fragment = _fragment_of(names, fragments)
        order = np.argsort(fragment, kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(fragment, minlength=fragments))])
        for f in np.flatnonzero(np.diff(at)).tolist():
            own = order[at[f]:at[f + 1]]
            n = last[own] - first[own] + length
            row = rows.setdefault(f, {"batch": number, "fragment": f})
            row |= {"bytes": b[_counting(n) + np.repeat(first[own], n)].tobytes(), "run_doc": _dump(_small(doc[own])),
                    "run_id": _dump(_small(ids[doc[own]])), "run_start": _dump(_small(first[own] - o[doc[own]])),
                    "run_size": _dump(_small(last[own] - first[own]))}
        yield pa.RecordBatch.from_pylist(list(rows.values()), _schema(_WINDOWS))


def _hot_windows(b, first, last, ids, doc, length: int):
    """Distinct names of the windows of some runs, their smallest ids, each window's name index, and the windows."""
    n = last - first + 1
    at = _counting(n) + np.repeat(first, n)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), at
    names = C.mix(C.span_hash(C.prefix_sums(b), at, at + length))
    return *_once(names, np.repeat(ids[doc], n)), at


_FOUND = _ANSWERS + " run_doc run_start run_size"


def _judge_windows(table: pa.Table, length: int) -> pa.Table:
    """Sorts one fragment's windows by name: those that a smaller document has are repeats.

    Runs are answered as runs of repeated windows, windows of hot grams one by one.
    """
    rows = table.to_pylist()
    names, ids, sizes, hot = [], [], [], []
    for r in rows:
        buf = np.frombuffer(r["bytes"] or b"", np.uint8)
        size = _load(r["run_size"]).astype(np.int64) if r["bytes"] else np.zeros(0, np.int64)
        n = size + length
        idx = _counting(size + 1) + np.repeat(np.cumsum(n) - n, size + 1)
        names.append(C.span_hash(C.prefix_sums(buf), idx, idx + length) if len(idx) else np.zeros(0, np.uint64))
        ids.append(np.repeat(_load(r["run_id"]), size + 1) if r["bytes"] else np.zeros(0, np.uint8))
        sizes.append(size)
        hot.append(r["base"] is not None)
    repeats = _smaller_by_name(names, ids)
    own = [k for k, h in enumerate(hot) if h]
    smaller = _smaller_by_name([_load(rows[k]["name"]) for k in own], [_load(rows[k]["id"]) for k in own])
    out, at, hot_at = [], 0, 0
    for r, size, is_hot in zip(rows, sizes, hot):
        found = {**{c: None for c in _FOUND.split()}, "batch": r["batch"], "fragment": r["fragment"]}
        if is_hot:
            n_own = len(_load(r["name"]))
            found |= _answer(r, smaller[hot_at:hot_at + n_own], np.zeros(n_own, bool))
            hot_at += n_own
        if len(size):
            hit = repeats[at:at + int((size + 1).sum())]
            at += len(hit)
            doc = np.repeat(_load(r["run_doc"]).astype(np.int64), size + 1)[hit]
            start = (_counting(size + 1) + np.repeat(_load(r["run_start"]).astype(np.int64), size + 1))[hit]
            cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])) \
                if len(doc) else np.zeros(0, np.int64)
            runs = np.diff(np.append(cut, len(doc))) - 1
            found |= {"run_doc": _dump(_small(doc[cut])), "run_start": _dump(_small(start[cut])),
                      "run_size": _dump(_small(runs))}
        out.append(found)
    return pa.Table.from_pylist(out, _schema(_FOUND))


def _smaller_by_name(names: list[np.ndarray], ids: list[np.ndarray]) -> np.ndarray:
    """For each name: whether a smaller id has it too."""
    if not names:
        return np.zeros(0, bool)
    name = np.concatenate(names)
    every = np.concatenate(ids) if len({x.dtype for x in ids}) == 1 else np.concatenate([x.astype(np.int64) for x in ids])
    smaller = np.empty(len(name), dtype=bool)
    if len(name):
        order = np.argsort(name)
        name, own = name[order], every[order]
        new = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        smaller[order] = np.repeat(np.minimum.reduceat(own, new), np.diff(np.append(new, len(name)))) < own
    return smaller


def _windows_of_texts(table: pa.Table) -> pa.Table:
    """One row per text: its repeated windows, as runs."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["ids"] is not None)
    ids, keys = _load(head["ids"]), _load(head["keys"])
    done, _, place = _answered([r for r in rows if r["base"] is not None], head, ids)
    cold = [r for r in rows if r["run_doc"] is not None]
    col = lambda c: np.concatenate([_load(r[c]).astype(np.int64) for r in cold]) if cold else np.zeros(0, np.int64)
    doc = np.concatenate([place["doc"][done], col("run_doc")])
    start = np.concatenate([place["start"][done], col("run_start")])
    size = np.concatenate([place["size"][done], col("run_size")])
    order = np.lexsort((start, doc))
    doc, start, size = doc[order], start[order], size[order]
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    out = [{"id": int(ids[k]), "key": int(keys[k]),
            "done": _dump(np.stack(_merge_runs(start[cut[k]:cut[k + 1]], size[cut[k]:cut[k + 1]])))}
           for k in np.flatnonzero(np.diff(cut))]
    return pa.Table.from_pylist(out, pa.schema([("id", pa.int64()), ("key", pa.int64()), ("done", pa.binary())]))


def _counting(n: np.ndarray) -> np.ndarray:
    """0, 1, .. n[0] - 1, 0, 1, .. n[1] - 1, and so on."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


# -- assembly -----------------------------------------------------------------------------

def byte_spans(runs: list[bytes | None], length: int) -> np.ndarray:
    """Maximal removed byte ranges (start, end) of the window runs of one text, in order."""
    both = [_load(r).reshape(2, -1) for r in runs if r is not None]
    if not both:
        return np.zeros((0, 2), dtype=np.int64)
    start, size = _merge_runs(np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both]))
    end = start + size + length
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return np.stack([start[at], end[np.append(at[1:], len(start)) - 1]], axis=1)


def _thrifty(judge):
    """The same function of a group's table; the worker's freed memory goes back after each group."""
    def run(table: pa.Table) -> pa.Table:
        out = judge(table)
        del table
        C.give_back()
        return out

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50,
                  gram: int | None = None) -> DataFrame:
    """(id, key, done, more) for texts with repeats: their window runs from rounds 2 and 3, packed (see `byte_spans`)."""
    spark = docs.sparkSession
    C.prepare(spark)
    gram = min(GRAM, length) if gram is None else gram
    fragments = max(64, 2 * C.shuffle_partitions(spark))
    src = _keyed(docs, id_col, text_col)

    sent = src.mapInArrow(lambda it: _send_grams(it, length, gram, fragments), _sql(_GRAMS))
    repeated = sent.groupBy("fragment").applyInArrow(_thrifty(_repeated_grams), _sql(_GRAMS))
    grams = C.stored(repeated.groupBy("batch").applyInArrow(_thrifty(_grams_of_texts), "id long, key long, grams binary"),
                     "repeat-grams")
    C.drop_shuffles(spark)
    one = grams.dropDuplicates(["id", "key"])
    # rows of a batch are told apart by their place: a fixed order keeps it when a lost task runs again
    held = src.join(one, ["id", "key"]).select("id", "key", "text", "grams").sortWithinPartitions("id", "key")
    runs = held.mapInArrow(lambda it: _send_runs(it, length, gram, fragments), _sql(_RUNS))
    judged = runs.groupBy("fragment").applyInArrow(_thrifty(_judge_runs), _sql(_ANSWERS))
    verdicts = C.stored(judged.groupBy("batch").applyInArrow(
        _thrifty(_runs_of_texts), "id long, key long, done binary, asked binary"), "repeat-runs")
    C.release(grams)
    C.drop_shuffles(spark)

    asked = verdicts.where("asked is not null").select("id", "key", "asked").dropDuplicates(["id", "key"])
    held = src.join(asked, ["id", "key"]).select("id", "key", "text", "asked").sortWithinPartitions("id", "key")
    windows = held.mapInArrow(lambda it: _send_windows(it, length, gram, fragments), _sql(_WINDOWS))
    answered = windows.groupBy("fragment").applyInArrow(
        _thrifty(lambda t: _judge_windows(t, length)), _sql(_FOUND))
    more = C.stored(answered.groupBy("batch").applyInArrow(
        _thrifty(_windows_of_texts), "id long, key long, done binary"), "repeat-windows")
    C.drop_shuffles(spark)
    left = verdicts.where("done is not null").select("id", "key", "done").dropDuplicates(["id", "key"])
    right = more.select("id", "key", F.col("done").alias("more")).dropDuplicates(["id", "key"])
    return left.join(right, ["id", "key"], "full")


def _digest(batches, length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = C.column_bytes(batch.column("text"))
        data = buf.tobytes()
        removed, spans, digests = [], [], []
        for k, (done, more) in enumerate(zip(batch.column("done").to_pylist(), batch.column("more").to_pylist())):
            at, digest, gone = int(offs[k]), hashlib.sha256(), 0
            cuts = byte_spans([done, more], length)
            for s, e in cuts.tolist():
                digest.update(data[at:offs[k] + s])
                at = int(offs[k]) + e
                gone += e - s
            digest.update(data[at:offs[k + 1]])
            removed.append(gone)
            spans.append(len(cuts))
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
             pa.array(digests, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50,
                   gram: int | None = None) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    runs = repeated_runs(docs, id_col, text_col, length, gram)
    joined = _keyed(docs, id_col, text_col).join(runs, ["id", "key"], "left").select("id", "text", "done", "more")
    out = joined.mapInArrow(lambda it: _digest(it, length),
                            "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_col)


def _cut_text(data: bytes, cuts: np.ndarray) -> str:
    """Text without the removed ranges, drawn in to whole characters."""
    out, at = [], 0
    for s, e in cuts.tolist():
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        out.append(data[at:s])
        at = e
    out.append(data[at:])
    return b"".join(out).decode("utf-8")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50,
                   gram: int | None = None) -> DataFrame:
    """All rows with their texts cut, columns as they were; a text that loses everything becomes empty.

    A character stays whole: one whose bytes are not all removed is kept.
    """
    runs = repeated_runs(docs, id_col, text_col, length, gram)
    row = F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("row")
    others = [c for c in docs.columns if c != text_col]
    joined = _keyed(docs, id_col, text_col, F.col(text_col).isNull().alias("absent"), row).join(
        runs, ["id", "key"], "left").select("text", "absent", "done", "more", *([] if not others else ["row"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k, (done, more) in enumerate(zip(batch.column("done").to_pylist(), batch.column("more").to_pylist())):
                if done is not None or more is not None:
                    texts[k] = _cut_text(texts[k].encode("utf-8"), byte_spans([done, more], length))
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), *[batch.column(c) for c in batch.schema.names if c in ("absent", "row")]],
                names=["text", *[c for c in batch.schema.names if c in ("absent", "row")]])

    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    schema = "text string, absent boolean" + (f", row {kinds['row']}" if others else "")
    cut = joined.mapInArrow(run, schema)
    return cut.select(*[F.when(~F.col("absent"), F.col("text")).alias(c) if c == text_col else F.col("row")[c].alias(c)
                        for c in docs.columns])
