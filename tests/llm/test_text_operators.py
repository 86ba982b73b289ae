import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from llm_cases import awkward_texts, frame, prose
from tokenizers import Tokenizer

from claimspark.llm import common as C
from claimspark.llm import jaccard_join, mixing, quality_forest, suffix_dedup, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def lowered(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


# -- kernels ---------------------------------------------------------------------

def test_words_and_shingles_match_python():
    import pyarrow as pa
    texts = [r[1] for r in awkward_texts()]
    buf, offs = C.column_bytes(pa.array(texts))
    for low, high, b, o in C.pieces(buf, offs, 500):
        starts, ends, first = C.word_bounds(b, o)
        for k in range(high - low):
            own = [bytes(b[s:e]).decode() for s, e in zip(starts[first[k]:first[k + 1]], ends[first[k]:first[k + 1]])]
            assert own == WORD.findall(texts[low + k] or "")
        hashes, at = C.shingle_hashes(C.word_hashes(b, starts, ends), first)
        for k in range(high - low):
            words = WORD.findall(texts[low + k] or "")
            sets = [tuple(words[i:i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
            own = hashes[at[k]:at[k + 1]].tolist()
            assert len(own) == len(sets) and len(set(own)) == len(set(sets))


# -- token counts -------------------------------------------------------------------

def test_token_counts_match_the_library(spark):
    rows = awkward_texts() + [(30, "<|endoftext|>a <|endoftext|>  b\n\n<|endoftext|>", None, None),
                              (31, "don't I'LL we've 'tis x\x1cy 　z  12½²  !!??", None, None),
                              (32, "a" * 5000, None, None), (33, "   " * 700, None, None)]
    library = Tokenizer.from_file(VOCABULARY)
    want = plain((i, len((t or "").encode()), n, n > 512) for (i, t, *_), n in
                 ((r, len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows))
    assert plain(token_counts.token_counts(frame(spark, rows), VOCABULARY).collect()) == want
    assert plain(token_counts.token_counts(frame(spark, rows), VOCABULARY, chunk_chars=23).collect()) == want
    assert token_counts.token_counts(frame(spark, []), VOCABULARY).count() == 0


def test_state_maps_compose_in_any_grouping():
    own = token_counts.TokenCounter(VOCABULARY)
    rng = random.Random(4)
    text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "é", "12", "!", "<|endoftext|>", "'s "]) for _ in range(400))
    for _ in range(20):
        cuts = sorted(rng.sample(range(1, len(text)), 6))
        maps = [own.state_map(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        while len(maps) > 1:
            k = rng.randrange(len(maps) - 1)
            maps[k:k + 2] = [own.compose(maps[k], maps[k + 1])]
        head, count, tail = maps[0]
        assert own.run(head) + (count or 0) + own.run(tail) == own.run(text)


def test_transducer_cache_reset_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 50)
    own, library = token_counts.TokenCounter(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    text = prose(77, 400)
    assert own.count(text) == len(library.encode(text).ids)


# -- quality ---------------------------------------------------------------------------

def base_counts(text):
    words, windows = WORD.findall(text or ""), {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def test_rule_statistics_match_brute_force(spark):
    rows = awkward_texts() + [(40, "# a | b ** c <d> " * 9, None, None)]
    labels = spark.createDataFrame([(5, 1), (6, 1), (7, None), (None, 1)], "doc_id long, quality int")
    got = quality_forest.judge(frame(spark, rows), labels)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert plain(got.select(*names).collect()) == plain((r[0], *base_counts(r[1])) for r in rows)
    assert got.where("base_failed and kept").count() == 0
    assert quality_forest.judge(frame(spark, []), labels).count() == 0


def junk(seed):
    return " ".join(w + random.Random(seed + i).choice(["###", "$$$", "&&&"]) for i, w in enumerate(prose(seed, 60).split()))


def test_forest_rejects_junk_and_keeps_prose(spark):
    good = [(i, prose(i, 40 + i % 50), "en", "a") for i in range(150)]
    bad = [(1000 + i, junk(i), "en", "a") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(1000 + i, 0, 0) for i in range(20)],
                                   "doc_id long, quality int, toxic int")
    docs = frame(spark, good + bad)
    kept = {r[0] for r in quality_forest.judge(docs, labels).where("kept").select("doc_id").collect()}
    assert kept == {r[0] for r in good if not base_counts(r[1])[5]}  # unlabelled rows of both kinds as well
    left = quality_forest.keep_good(docs, labels)
    assert left.schema == docs.schema and {r["doc_id"] for r in left.collect()} == kept
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_forest.judge(docs, no_labels).where("kept = base_failed").count() == 0


def test_isolation_scores_fall_with_path_length():
    rng = np.random.default_rng(0)
    rows = np.clip(rng.normal(0.1, 0.02, (400, 3)), 0, 1)
    forest = quality_forest.grow_forest(rows)
    odd = np.array([[0.9, 0.1, 0.1], [0.1, 0.1, 0.1], [0.9, 0.9, 0.9]])
    scores = forest.score(odd)
    assert scores[2] >= scores[0] > scores[1]
    assert quality_forest.best_threshold({10: 5, 20: 5}, {60: 3, 90: 1}) == pytest.approx(0.0041, abs=1e-9)
    assert quality_forest.best_threshold({10: 5}, {}) > 1


# -- n-gram Jaccard join -------------------------------------------------------------------

def jaccard_brute(rows, width=5, percent=80):
    sets = []
    for i, text, *_ in rows:
        w = lowered(text)
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if either and sets[a] and sets[b] and 100 * both >= percent * either:
                root[find(a)] = find(b)
    lowest = {}
    for k, (i, *_) in enumerate(rows):
        lowest.setdefault(find(k), []).append(i)
    return plain((r[0], len(sets[k]), min((x for x in lowest[find(k)] if x is not None), default=None))
                 for k, r in enumerate(rows))


def test_components_match_brute_force(spark):
    rows = awkward_texts()
    assert plain(jaccard_join.components(frame(spark, rows)).collect()) == jaccard_brute(rows)
    assert jaccard_join.components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("edits", [1, 3, 6])
def test_large_group_of_near_copies(spark, edits):
    base = prose(100, 120)
    from llm_cases import edited
    rows = [(i, edited(base, i, 1 + i % edits), "en", "a") for i in range(60)]
    rows += [(100 + i, prose(200 + i, 30) + " " + prose(99, 25), "en", "b") for i in range(20)]  # a shared passage links nothing
    rows += [(200 + i, prose(300 + i // 3, 40), "en", "b") for i in range(9)]
    assert plain(jaccard_join.components(frame(spark, rows)).collect()) == jaccard_brute(rows)


def test_join_without_broadcast_and_with_heavy_order(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(jaccard_join, "HEAVY_DF", 2)
    monkeypatch.setattr(jaccard_join, "HEAVY_ENTRIES", 3)
    rows = awkward_texts()
    assert plain(jaccard_join.components(frame(spark, rows)).collect()) == jaccard_brute(rows)


def test_keep_first_keeps_one_of_each_component(spark):
    rows = [r for r in awkward_texts() if r[0] is not None]
    docs = frame(spark, rows)
    want = {i for i, _, c in jaccard_brute(rows) if i == c}
    left = jaccard_join.keep_first(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == want


def test_many_null_and_shared_ids_are_told_apart_by_their_texts(spark):
    rows = [(None if k % 2 else 7, prose(k // 4, 40), "en", "s") for k in range(160)]  # 40 texts, two rows each of null and of 7
    rows += [(k, prose(900 + k // 2, 40), "en", "s") for k in range(20, 40)]
    got = jaccard_join.components(frame(spark, rows)).collect()
    assert plain(got) == plain(jaccard_brute(rows))
    members, classes, _ = jaccard_join.similarity_classes(frame(spark, rows))
    assert members.count() == 180 and classes.count() == 50


@pytest.mark.parametrize("bound", [jaccard_join.BROADCAST_BYTES, 0])
def test_keep_first_of_null_repeated_and_shared_ids(spark, monkeypatch, bound):
    monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", bound)
    a, b, c, d, e = (prose(500 + k, 40) for k in range(5))
    rows = [(1, a, "en", "s"), (None, a, "en", "s"), (None, a.upper(), "en", "s"),  # null copies of a numbered one
            (None, b, "en", "s"), (None, b, "en", "s"), (None, b, "en", "t"),  # null ids only
            (2, c, "en", "s"), (2, c, "en", "s"),  # a repeated row
            (3, d, "en", "s"), (4, d, "en", "s"), (4, e, "en", "s"),  # 4 is a copy of 3 and a clean text
            (5, None, "en", "s"), (5, None, "en", "s"), (None, "", "en", "s"), (None, "", "en", "s")]
    docs = frame(spark, rows)
    left = jaccard_join.keep_first(docs)
    assert left.columns == docs.columns
    assert plain(r[:4] for r in left.collect()) == plain([rows[0], rows[3], rows[6], rows[8], *rows[10:]])


# -- mixing ------------------------------------------------------------------------------------

def water_fill(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        rate = (budget - sum(target.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if rate * w[s] > epochs * sizes[s]}
        if not full:
            target.update({s: rate * w[s] for s in open_})
            break
        target.update({s: epochs * sizes[s] for s in full})
        open_ -= full
    return target


def test_mix_targets_and_taken_words(spark):
    rows = awkward_texts() + [(100 + i, prose(i, 5 + i % 37), None, "abcdefg"[i % 7]) for i in range(300)]
    docs = frame(spark, rows)
    got = mixing.mix_documents(docs).collect()
    assert plain(mixing.mix_documents(docs).collect()) == plain(got)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    targets = water_fill(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for source in sizes:
        sums = {0}
        for _, text, _, own in rows:  # every sum of up to two copies of each document
            if own == source:
                n = len(WORD.findall(text or ""))
                sums |= {s + n for s in sums} | {s + 2 * n for s in sums}
        nearest = min(abs(s - targets[source]) for s in sums)
        assert abs(taken[source] - targets[source]) <= nearest + 1, source


def test_mix_seed_changes_documents_but_not_totals(spark):
    docs = frame(spark, [(i, prose(i % 3, 10 + i % 4), None, "ab"[i % 2]) for i in range(400)])
    a, b = (mixing.mix_documents(docs, seed=s).collect() for s in (1, 2))
    total = lambda rows: sum(r["copies"] * r["size"] for r in rows)
    assert total(a) == total(b) and {(r["doc_id"], r["copies"]) for r in a} != {(r["doc_id"], r["copies"]) for r in b}
    assert mixing.mix_documents(frame(spark, [])).count() == 0
    assert {r["copies"] for r in mixing.mix_documents(frame(spark, [(1, None, None, None), (2, "", None, "x")])).collect()} <= {0, 1, 2}


def test_fit_counts_reaches_the_nearest_sum():
    rng = random.Random(5)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(0, 40), 5)))
        counts = np.array([rng.randrange(1, 5) for _ in lengths])
        total = int((lengths * counts).sum())
        budget = rng.randrange(0, total + 20)
        take = mixing.fit_counts(lengths, counts, budget)
        assert ((take >= 0) & (take <= counts)).all()
        sums = {0}
        for size, n in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * size for s in sums for k in range(n + 1)}
        # the first proportional share is fixed; what is left is fitted exactly
        share = sum(int(c) * budget // total * s for c, s in zip(counts.tolist(), lengths.tolist())) if budget < total else total
        assert share <= int((take * lengths).sum()) or budget >= total
        assert abs(int((take * lengths).sum()) - budget) <= max(lengths) or budget > total


@pytest.mark.parametrize("share", [0.13, 0.5, 0.64, 0.9])
def test_every_length_band_gives_its_share(share):
    """Lengths held by one document each, and a long tail: no band fills up and none is left out."""
    rng = np.random.default_rng(3)
    for lengths in (np.arange(1, 20001), np.unique(np.exp(rng.uniform(0, 9.9, 3000)).astype(np.int64))):
        counts = np.ones(len(lengths), dtype=np.int64)
        total = int(lengths.sum())
        take = mixing.fit_counts(lengths, counts, int(total * share))
        assert int((take * lengths).sum()) == int(total * share)
        for low, high in ((1, 50), (50, 500), (500, 2000), (2000, 20001)):
            band = (lengths >= low) & (lengths < high)
            words = int(lengths[band].sum())
            assert abs(int((take * lengths)[band].sum()) / words - share) < 0.05 or words < 30 * int(lengths[band].max())


def test_mix_splits_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    rows = [(i, "w " * 8, None, "a") for i in range(500)] + [(1000 + i, "w " * (i % 9 + 1), None, "b") for i in range(100)]
    got = mixing.mix_documents(frame(spark, rows), budget_share=0.4).collect()
    for source in "ab":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= 8


# -- repeated strings ---------------------------------------------------------------------------

def repeats_brute(rows, length):
    seen, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    k = 0
    while k < len(order):
        same = [r for r in order if r[0] == order[k][0]]
        new = []
        for i, text, *_ in same:
            b = (text or "").encode()
            gone = bytearray(len(b))
            for p in range(len(b) - length + 1):
                w = b[p:p + length]
                if w in seen:
                    gone[p:p + length] = b"\1" * length
                new.append(w)
            kept = bytes(c for c, g in zip(b, gone) if not g)
            spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
            out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
        seen.update(dict.fromkeys(new))
        k += len(same)
    return plain(out)


@pytest.mark.parametrize(("length", "gram", "hot"), [(50, None, 16), (50, 50, 1), (23, 4, 1), (7, 7, 2), (50, None, 2)])
def test_repeats_match_brute_force(spark, monkeypatch, length, gram, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_BATCHES", hot)
    rows = [r for r in awkward_texts() if r[0] != 19]
    docs = frame(spark, rows).repartition(5)  # several batches
    got = suffix_dedup.repeat_digests(docs, length=length, gram=gram)
    assert plain(got.collect()) == repeats_brute(rows, length)


def test_repeats_in_periodic_and_long_texts(spark):
    rng = random.Random(3)
    pieces = ["ab" * 30, "a" * 70, prose(1, 15), "xyz" * 25, "\n" * 60]
    rows = [(i, "".join(rng.choice(pieces)[rng.randrange(9):] for _ in range(4)), None, None) for i in range(40)]
    rows.append((99, prose(50, 30000), None, None))
    rows.append((100, prose(50, 30000)[1000:90000], None, None))
    got = suffix_dedup.repeat_digests(frame(spark, rows), length=50)
    assert plain(got.collect()) == repeats_brute(rows, 50)
    assert suffix_dedup.repeat_digests(frame(spark, []), length=50).count() == 0


def test_remove_repeats_keeps_columns_and_characters(spark):
    rows = awkward_texts()
    docs = frame(spark, rows)
    left = suffix_dedup.remove_repeats(docs, length=20)
    assert left.columns == docs.columns and [f.dataType for f in left.schema] == [f.dataType for f in docs.schema]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "") for r in left.collect()))
    assert len(got) == len(rows)
    assert sum(t for _, _, t, _ in got) == 1  # null text stays null
    by_id = {r["doc_id"]: r["text"] for r in left.collect()}
    assert by_id[1] is not None and by_id[2] == "" and by_id[1] != ""
    assert all("�" not in (t or "") for t in by_id.values())
