"""N-gram Jaccard self-join by vertical partitioning, and the components that its links form.

The global n-gram order is cut into fragments; overlaps are counted inside each fragment and summed.

1. Every text's set of n-gram hashes is cut along the hash order into fragments. One row per (input batch, fragment)
   carries the batch's n-grams of that fragment, each once, with its count if several texts of the batch have it, so
   an n-gram of a third of all texts is no large group. A fragment counts which n-grams any other text has too, and the counts are
   summed per text. A text can link only if the given share of its n-grams is shared at all, which most texts
   fail. Equal sets are one class from here on, so copies are never paired.
2. The classes left are ordered globally: n-grams of high document frequency last, the rest by hash. Two sets above
   the threshold must meet in their prefixes in that order; the positions at which they meet bound their overlap.
3. Each prefix n-gram first pairs its members with one of them only. Verified links merge most of a large group of near
   copies; after that only pairs from different components are generated, so a group's pairs are never all
   emitted, and no link that could join two components is left out.
4. Pairs are verified exactly: both sets, cut into vertical fragments, meet per (pair, fragment), overlaps are counted there
   and summed per pair.

Identity is by 64-bit hashes of words and n-grams. Defined results: null or word-free texts have an empty set, link with nothing and form
their own component; fewer words than the n-gram width give one n-gram of all words; repeated rows are members
of one class; a null id belongs to its class's component (null only if all its ids are); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from claimspark.llm import common as C
from claimspark.llm.components import connected

#: Stands for a null id inside; larger than any id.
NO_ID = (1 << 63) - 1
#: Document frequency from which an n-gram is ordered by its frequency.
HEAVY_DF = 64
#: Most heavy n-grams that are sent to the tasks (12 bytes each); the frequency limit rises until they fit.
HEAVY_ENTRIES = 1 << 20
#: Largest id list that is broadcast to pick texts; beyond it the texts are joined by id.
BROADCAST_BYTES = 16 << 20
#: Vertical fragments in which pairs are verified.
VERIFY_FRAGMENTS = 4


def _fragment_of(hashes: np.ndarray, fragments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int32)


def text_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a text column: (first row, end row, sorted distinct n-gram hashes, offsets per text)."""
    buf, offs = C.column_bytes(column)
    for first_row, end_row, b, o in C.pieces(buf, offs):
        b = C.lower_ascii(b)
        starts, ends, first = C.word_bounds(b, o)
        hashes, at = C.shingle_hashes(C.word_hashes(b, starts, ends), first, width)
        yield first_row, end_row, *C.distinct_per_text(hashes, at)


def set_signature(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set, the same for equal sets; 0 for the empty set."""
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(C.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64, out=sums[1:])
    n = np.diff(at).astype(np.uint64)
    out = C.mix((sums[at[1:]] - sums[at[:-1]]) * C._ODD + n)
    out[n == 0] = 0
    return out.view(np.int64)


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


_PACKED = pa.schema([("batch", pa.int64()), ("fragment", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()),
                     ("kind", pa.string()), ("common", pa.binary()), ("common_df", pa.binary()), ("ids", pa.binary()),
                     ("ns", pa.binary()), ("signatures", pa.binary()), ("known", pa.binary())])
_PACKED_SQL = ("batch long, fragment int, keys binary, counts binary, kind string, common binary, common_df binary, "
               "ids binary, ns binary, signatures binary, known binary")


def _pack(batches: Iterator[pa.RecordBatch], width: int, fragments: int) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        for low, high, hashes, at in text_sets(batch.column(1), width):
            yield _packed_rows((part << 32) | number, ids[low:high], hashes, at, fragments)
            number += 1


def _packed_rows(number: int, ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, fragments: int) -> pa.RecordBatch:
    signatures = set_signature(hashes, at)
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    cut = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    df = np.diff(np.append(cut, len(ranked)))
    common, common_df = ranked[cut[df > 1]], df[df > 1].astype(np.uint32)  # in several texts of this batch: sent once
    single = np.empty(len(hashes), dtype=bool)
    single[order] = np.repeat(df == 1, df)
    known = np.bincount(owner[~single], minlength=len(n)).astype(np.int64)
    hashes, owner = hashes[single], owner[single]
    fragment = _fragment_of(hashes, fragments)
    counts = np.bincount(fragment.astype(np.int64) * len(n) + owner, minlength=fragments * len(n)).reshape(fragments, -1)
    order = np.argsort(fragment, kind="stable")
    keys = hashes[order].astype(np.uint32)
    cut = np.concatenate([[0], np.cumsum(counts.sum(axis=1))])
    common_cut = np.searchsorted(_fragment_of(common, fragments), np.arange(fragments + 1))  # sorted, so fragments rise
    out, home = [], ((number >> 32) * 31 + (number & 0xFFFFFFFF)) % fragments
    for f in range(fragments):
        held, own = _small(counts[f]), slice(common_cut[f], common_cut[f + 1])
        if f != home and cut[f] == cut[f + 1] and own.start == own.stop:
            continue
        row = {"batch": number, "fragment": f, "keys": keys[cut[f]:cut[f + 1]].tobytes(), "counts": held.tobytes(),
               "kind": held.dtype.str, "common": common[own].astype(np.uint32).tobytes(),
               "common_df": common_df[own].tobytes(), "ids": None, "ns": None, "signatures": None, "known": None}
        if f == home:
            row |= {"ids": ids.tobytes(), "ns": n.astype(np.int64).tobytes(), "signatures": signatures.tobytes(),
                    "known": known.tobytes()}
        out.append(row)
    return pa.RecordBatch.from_pylist(out, _PACKED)


_COUNTED = pa.schema([("batch", pa.int64()), ("shared", pa.binary()), ("kind", pa.string()), ("ids", pa.binary()),
                      ("ns", pa.binary()), ("signatures", pa.binary()), ("known", pa.binary()), ("code", pa.int64()),
                      ("df", pa.int64())])
_COUNTED_SQL = ("batch long, shared binary, kind string, ids binary, ns binary, signatures binary, known binary, "
                "code long, df long")


def _count_fragment(table: pa.Table) -> pa.Table:
    """Which n-grams of one fragment stand in more than one text, counted per text; and the frequent ones."""
    rows = table.to_pylist()
    keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
    common = [np.frombuffer(r["common"], np.uint32) for r in rows]
    every = np.concatenate([*keys, *common])
    weight = np.concatenate([np.ones(sum(map(len, keys)), np.uint32),
                             *[np.frombuffer(r["common_df"], np.uint32) for r in rows]])
    order = np.argsort(every, kind="stable")
    every = every[order]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    df = np.add.reduceat(weight[order], starts, dtype=np.int64) if len(every) else np.zeros(0, np.int64)
    twice = every[starts[df > 1]]
    out = []
    for r, own in zip(rows, keys):
        counts = np.frombuffer(r["counts"], np.dtype(r["kind"])).astype(np.int64)
        place = np.searchsorted(twice, own)
        hit = np.zeros(len(own) + 1, dtype=np.int64)
        if len(twice):
            np.cumsum(twice[np.minimum(place, len(twice) - 1)] == own, out=hit[1:])
        ends = np.cumsum(counts)
        shared = _small(hit[ends] - hit[ends - counts])
        out.append({"batch": r["batch"], "shared": shared.tobytes(), "kind": shared.dtype.str, "ids": r["ids"],
                    "ns": r["ns"], "signatures": r["signatures"], "known": r["known"], "code": None, "df": None})
    heavy = df >= HEAVY_DF
    fragment = rows[0]["fragment"] if rows else 0
    for key, n in zip(every[starts[heavy]].tolist(), df[heavy].tolist()):
        out.append({"batch": None, "shared": None, "kind": None, "ids": None, "ns": None, "signatures": None,
                    "known": None, "code": fragment << 32 | key, "df": n})
    return pa.Table.from_pylist(out, _COUNTED)


def _sum_batch(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    head = next(r for r in rows if r["ids"] is not None)
    total = sum(np.frombuffer(r["shared"], np.dtype(r["kind"])).astype(np.int64) for r in rows)
    total = total + np.frombuffer(head["known"], np.int64)
    return pa.table({"id": np.frombuffer(head["ids"], np.int64), "n": np.frombuffer(head["ns"], np.int64),
                     "signature": np.frombuffer(head["signatures"], np.int64), "shared": total})


def _heavy_list(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes and frequencies of the most frequent n-grams, at most `HEAVY_ENTRIES`."""
    heavy = counted.where("code is not null")
    steps = heavy.groupBy(F.floor(F.log2("df")).alias("step")).agg(F.count("*").alias("n")).collect()  # at most 64 rows
    limit, held = HEAVY_DF, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        held += r["n"]
        if held > HEAVY_ENTRIES:
            limit = 2 << int(r["step"])
            break
    got = heavy.where(F.col("df") >= limit).select("code", "df").toArrow()
    codes, df = got.column("code").to_numpy(), got.column("df").to_numpy()
    order = np.argsort(codes)
    return codes[order], df[order]


def _profiles(batches: Iterator[pa.RecordBatch], width: int, percent: int, fragments: int,
              codes: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
    """signature, n, vertical segments, and the prefix n-grams in the global order."""
    for batch in batches:
        expected = batch.column(0).to_numpy(zero_copy_only=False)
        for low, high, hashes, at in text_sets(batch.column(1), width):
            signatures = set_signature(hashes, at)
            code = (_fragment_of(hashes, fragments).astype(np.int64) << 32) | hashes.astype(np.uint32).astype(np.int64)
            weight = np.zeros(len(hashes), dtype=np.int64)
            if len(codes):
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                weight = np.where(codes[place] == code, df[place], 0)
            quarter = _fragment_of(hashes, VERIFY_FRAGMENTS)
            out = []
            for k in range(high - low):
                a, b = at[k], at[k + 1]
                if b == a or signatures[k] != expected[low + k]:
                    continue
                own, n = hashes[a:b], b - a
                prefix = n - -(-percent * n // 100) + 1
                order = np.lexsort((own, weight[a:b]))[:prefix]
                cut = np.searchsorted(quarter[a:b], np.arange(VERIFY_FRAGMENTS + 1))
                out.append({"signature": int(signatures[k]), "n": int(n), "prefix": own[order].view(np.int64).tolist(),
                            "segments": [own[cut[f]:cut[f + 1]].tobytes() for f in range(VERIFY_FRAGMENTS)]})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([
                    ("signature", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())),
                    ("segments", pa.list_(pa.binary()))]))


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlap of each (pair, fragment) row."""
    for batch in batches:
        left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
        counts = np.empty(len(left), dtype=np.int64)
        for k, (x, y) in enumerate(zip(left, right)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            if len(x):
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                counts[k] = int((y[place] == x).sum())
            else:
                counts[k] = 0
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("sizes"), pa.array(counts)],
                                         names=["a", "b", "sizes", "overlap"])


def verified_links(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity: overlaps are counted per vertical fragment and summed per pair."""
    cut = profiles.select("signature", "n", F.posexplode("segments").alias("f", "segment"))
    met = (pairs.join(cut.select(F.col("signature").alias("a"), F.col("n").alias("n_a"), "f",
                                 F.col("segment").alias("left")), "a")
           .join(cut.select(F.col("signature").alias("b"), F.col("n").alias("n_b"), "f",
                            F.col("segment").alias("right")), ["b", "f"])
           .select("a", "b", (F.col("n_a") + F.col("n_b")).alias("sizes"), "left", "right"))
    partial = met.mapInArrow(_overlaps, "a long, b long, sizes long, overlap long")
    return (partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.first("sizes").alias("sizes"))
            .where(F.lit(100) * F.col("overlap") >= F.lit(percent) * (F.col("sizes") - F.col("overlap")))
            .select("a", "b"))


def _may_reach(percent: int) -> Column:
    """True where sizes n_a, n_b and the positions p_a, p_b of a common prefix n-gram leave enough possible overlap.

    At the first n-gram that two sets share (in the global order) all their other common n-grams stand after it.
    """
    best = 1 + F.least(F.col("n_a") - F.col("p_a") - 1, F.col("n_b") - F.col("p_b") - 1)
    return best * (100 + percent) >= F.lit(percent) * (F.col("n_a") + F.col("n_b"))


def _side(members: DataFrame, side: str, *more: str) -> DataFrame:
    return members.select("token", F.col("signature").alias(side), F.col("n").alias(f"n_{side}"),
                          F.col("pos").alias(f"p_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in more])


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                       percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links).

    members: id, n, signature for every row. classes: signature, n, representative (smallest id), for sets that could
    link or have copies. links: pairs (a, b) of signatures: all that join different components, verified.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    fragments = max(64, 2 * C.shuffle_partitions(spark))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = src.mapInArrow(lambda it: _pack(it, width, fragments), _PACKED_SQL)
    counted = C.stored(packed.groupBy("fragment").applyInArrow(_count_fragment, _COUNTED_SQL), "ngram-counts")
    members = C.stored(counted.where("batch is not null").groupBy("batch").applyInArrow(
        _sum_batch, "id long, n long, signature long, shared long"), "ngram-members")
    codes, df = _heavy_list(counted)
    C.release(counted)

    classes = C.stored(members.where((F.col("n") > 0) & (F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("n")))
                       .groupBy("signature").agg(F.min("id").alias("representative"), F.max("n").alias("n")),
                       "ngram-classes")
    wanted = classes.select(F.col("signature").alias("expected"), F.col("representative").alias("wanted"))
    small = classes.count() * 16 <= BROADCAST_BYTES
    keyed = src.withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    # ids of several rows (null among them) don't tell a class's text: those rows are told apart by their signatures as well
    shared = C.stored(members.groupBy("id").count().where("count > 1").select("id"), "ngram-shared-ids")
    by_id = wanted.join(shared, F.col("wanted") == F.col("id"), "left_anti")
    texts = keyed.join(F.broadcast(by_id) if small else by_id, F.col("id") == F.col("wanted")).select("expected", "text")
    profiles = texts.mapInArrow(lambda it: _profiles(it, width, percent, fragments, codes, df),
                                "signature long, n long, prefix array<long>, segments array<binary>")
    if shared.limit(1).count():
        schema = StructType([*keyed.schema.fields, StructField("__signature", LongType())])
        signed = keyed.join(shared, "id", "left_semi").select(*keyed.columns).mapInArrow(lambda it: _add_signature(it, 1, width), schema)
        of_class = ((F.col("id") == F.col("wanted")) & (F.col("__signature") == F.col("expected")))
        one_each = signed.join(F.broadcast(wanted) if small else wanted, of_class).groupBy("expected").agg(F.min("text").alias("text"))
        profiles = profiles.unionByName(one_each.mapInArrow(lambda it: _profiles(it, width, percent, fragments, codes, df), profiles.schema))
    profiles = C.stored(profiles, "ngram-profiles")

    prefixes = profiles.select("signature", "n", F.posexplode("prefix").alias("pos", "token"))
    groups = (prefixes.groupBy("token").agg(F.count("*").alias("held"), F.min(F.struct("pos", "signature", "n")).alias("c"))
              .where("held > 1"))
    star = (prefixes.join(groups.select("token", "c"), "token")
            .select("token", F.col("signature").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("p_a"),
                    F.col("c.signature").alias("b"), F.col("c.n").alias("n_b"), F.col("c.pos").alias("p_b"))
            .where((F.col("a") != F.col("b")) & _may_reach(percent)))
    pairs = C.stored(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ngram-star")
    first_links = C.stored(verified_links(pairs, profiles, percent), "ngram-links")
    roots = connected(first_links)

    labelled = (prefixes.join(groups.select("token"), "token", "left_semi")
                .join(roots.withColumnRenamed("node", "signature"), "signature", "left")
                .withColumn("root", F.coalesce("root", "signature")))
    labelled = C.stored(labelled, "ngram-labelled")
    mixed = (labelled.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
             .where("low <> high").select("token"))
    open_members = labelled.join(mixed, "token", "left_semi")
    cross = (_side(open_members, "a", "root").join(_side(open_members, "b", "root"), "token")
             .where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & _may_reach(percent))
             .select("a", "b").distinct())
    rest = C.stored(cross.join(pairs, ["a", "b"], "left_anti"), "ngram-cross")
    more_links = C.stored(verified_links(rest, profiles, percent), "ngram-links")
    for frame in (labelled, pairs, rest, profiles, roots):
        C.release(frame)
    return members, classes, first_links.unionByName(more_links)


def _named_members(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """members with root (the component's key; null for sets that neither link nor have copies) and component_id."""
    members, classes, links = similarity_classes(docs, id_col, text_col, width, percent)
    roots = connected(links)
    own = classes.join(roots.withColumnRenamed("node", "signature"), "signature", "left").select(
        "signature", "representative", F.coalesce("root", "signature").alias("root"))
    lowest = own.groupBy("root").agg(F.min("representative").alias("component_id"))
    return members.join(own.join(lowest, "root").select("signature", "root", "component_id"), "signature", "left")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
               percent: int = 80) -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links, itself included) for every row."""
    out = _named_members(docs, id_col, text_col, width, percent)
    back = lambda c: F.when(c != NO_ID, c)
    return out.select(back(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"),
                      back(F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component_id", "id")))
                      .alias("component_id"))


def _add_signature(batches: Iterator[pa.RecordBatch], place: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [set_signature(hashes, at) for _, _, hashes, at in text_sets(batch.column(place), width)]
        signatures = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signatures, pa.int64())],
                                         names=[*batch.schema.names, "__signature"])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
               percent: int = 80) -> DataFrame:
    """One row of each component stays: that with the smallest id. All columns as they were.

    Rows are told apart by id and signature, so a row that only shares its id with a copy stays. A null id comes after
    all others: such a row stays only if its whole component has null ids. Of equal ids the smallest signature stays, and of
    rows equal in both the first by their columns as JSON. Every row without a word is a component of its own and stays.
    """
    found = _named_members(docs, id_col, text_col, width, percent).where("n > 0 and root is not null")
    keys = C.stored(found.groupBy("root", "id", "signature").agg(F.count("*").alias("copies")), "ngram-keys")
    best = keys.groupBy("root").agg(F.min(F.struct("id", "signature")).alias("best"))
    first = F.struct("id", "signature") == F.col("best")
    gone = C.stored(keys.join(best, "root").where(~first | (F.col("copies") > 1)).select(
        F.col("id").alias("__id"), F.col("signature").alias("__gone"), first.alias("__first")), "ngram-losers")
    C.release(keys)
    place = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField("__signature", LongType())])
    signed = docs.mapInArrow(lambda it: _add_signature(it, place, width), schema)
    match = (F.coalesce(signed[id_col].cast("long"), F.lit(NO_ID)) == F.col("__id")) & (signed["__signature"] == F.col("__gone"))
    small = gone.count() * 16 <= BROADCAST_BYTES
    left = signed.join(F.broadcast(gone) if small else gone, match, "left_anti").select(*docs.columns)
    repeated = gone.where("__first")
    if not repeated.limit(1).count():
        return left
    row = F.struct(*docs.columns)
    one = (signed.join(F.broadcast(repeated) if small else repeated, match).groupBy("__id", "__gone")
           .agg(F.min_by(row, F.to_json(row)).alias("row")))  # merged map-side, so many copies are no large group
    return left.unionByName(one.select("row.*"))
