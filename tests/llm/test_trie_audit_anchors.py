import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import awkward_texts, edited, frame, prose

from claimspark.llm import anchor_dedup, divergence_audit, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.fixture()
def short_batches(spark):
    """Slices of three rows: forests and pieces of texts meet often."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, old)


# -- prefix trie ------------------------------------------------------------------------

def conversations(seed: int, n: int) -> list[tuple]:
    """(conv_id, turn, role, text): shared openings, copies, prefixes of others, nulls, ties, repeated rows, long ones."""
    rng, rows = random.Random(seed), []
    kinds = ["user", "assistant", None, ""]
    for c in range(n):
        cid = rng.choice([c, c + 100, -c, c * 7])
        if any(r[0] == cid for r in rows):
            continue
        length = rng.choice([0, 1, 2, 3, 5, 8, 40])
        rows += [(cid, rng.choice([t, t, t, None]), rng.choice(kinds[:2 + (c % 9 == 0) * 2]), rng.choice(["a", "b", "é😀", None, ""]))
                 for t in range(length)]
    rows += [(900 + k, t, "user", "same") for k in range(12) for t in range(4)]  # equal conversations across slices
    rows += [(950 + k, t, "user", "same") for k in range(5) for t in range(2)]   # and a prefix of them
    rows += [(None, 0, "user", "lost"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    return rows


def rebuilt(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


def trie_brute(convs):
    members = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    out = []
    for k, cs in members.items():
        below = [b for b in members if b[:len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(k))))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), kids[k], sum(1 for b in below if not kids[b]),
                    sum((len(members[b]) - 1) * len(b[-1][1]) for b in below if b), hashlib.sha256(ends.encode()).hexdigest()))
    return plain(out)


@pytest.mark.parametrize("seed, parts", [(1, 4), (2, 40)])
def test_trie_matches_brute_force(spark, short_batches, seed, parts):
    rows = conversations(seed, 70)
    df = spark.createDataFrame([(*r, 5, b"k", "p") for r in rows], "conv_id long, turn long, role string, text string, "
                                                                  "depth int, key binary, part string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))  # beyond FAN partitions, forests are merged in two rounds
    try:
        got = prefix_trie.prefix_trie(prefix_trie.share_openings(df))
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert plain(got.collect()) == trie_brute(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_trie_of_plain_and_empty_tables(spark, short_batches):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (2, 1, "u", "c"), (3, 0, "u", "a")]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema)
    want = trie_brute({1: [("u", "a"), ("u", "b")], 2: [("u", "a"), ("u", "c")], 3: [("u", "a")]})
    assert plain(prefix_trie.prefix_trie(prefix_trie.numbered_turns(df)).collect()) == want
    assert prefix_trie.prefix_trie(prefix_trie.share_openings(spark.createDataFrame([], schema))).count() == 0


class Emitted(prefix_trie.Rows):
    def node(self, n, leaves, saved):
        self.rows.append((n.depth, n.low, n.n, n.kids, leaves, saved))

    def __call__(self, row, parent_conv_id, parent_key):
        self.rows.append(row[:6])

    def chunk(self, key, ids):
        pass


@pytest.mark.parametrize("seed", range(6))
def test_forests_merge_at_any_cut(seed):
    rng = random.Random(seed)
    convs = sorted((b"".join(bytes([rng.randrange(2)]) * prefix_trie.NAME for _ in range(rng.randrange(6))), i) for i in range(30))
    cuts = sorted({0, 30, *(rng.randrange(31) for _ in range(seed))})
    out, forest = Emitted(), None
    for a, b in zip(cuts, cuts[1:]):
        names, ids = [n for n, _ in convs[a:b]], [i for _, i in convs[a:b]]
        own = prefix_trie.slice_forest(ids, names, [[1 + n[k] for k in range(0, len(n), prefix_trie.NAME)] for n in names], out)
        forest = own if forest is None else prefix_trie.join_forests(forest, own, out)
    out.root(forest)
    texts = {i: [("", "x" * (1 + n[k])) + (n[k],) for k in range(0, len(n), prefix_trie.NAME)] for n, i in convs}
    want = [(d, low, n, kids, leaves, saved) for low, d, _, n, kids, leaves, saved, _ in trie_brute(texts)]
    assert plain(out.rows) == plain(want)


# -- source divergence audit -----------------------------------------------------------------

def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def audit_brute(rows, min_docs, top=10):
    docs, counts, groups = defaultdict(set), defaultdict(Counter), set()
    for i, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in terms_of(text):
            docs[lang, t].add(i)
            counts[lang, source][t] += 1
    out = []
    for lang, source in groups:
        kept = [t for (g, t), d in docs.items() if g == lang and len(d) >= min_docs]
        peers = sorted((s for g, s in groups if g == lang), key=str.encode)

        def share(count, total):
            return 1 + 10 ** 9 * (count + 2) // (total + 2 * len(kept))

        def p_of(s):
            total = sum(counts[lang, s][t] for t in kept)
            return {t: share(counts[lang, s][t], total) for t in kept}

        mine, whole = p_of(source), Counter()
        for s in peers:
            whole.update(counts[lang, s])
        total = sum(whole[t] for t in kept)
        pairs = []
        for s in peers:
            if s != source:
                q = p_of(s)
                pairs.append((s, sum((mine[t] - q[t]) ** 2 // (mine[t] + q[t]) for t in kept)))
        terms = [(t, (mine[t] - q) ** 2 // (mine[t] + q)) for t in kept for q in [share(whole[t], total)]
                 if counts[lang, source][t] and mine[t] > q]
        for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
            order = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(order)]
    return plain(out)


@pytest.mark.parametrize("min_docs", [1, 3])
def test_audit_matches_brute_force(spark, min_docs):
    rows = awkward_texts() + [(40, "É é Ünder ünder A\x00B c_d [x] 12", "en", "q"), (41, "12 34 _", "xx", "only"), (42, None, "xx", "two"),
                              (43, "word" * 3000 + " tail", "en", "q"), (44, "word" * 3000 + " tail", "en", "b")]
    got = divergence_audit.audit(frame(spark, rows), min_docs=min_docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert plain(got.collect()) == audit_brute(rows, min_docs)


def test_audit_of_an_empty_table(spark):
    assert divergence_audit.audit(frame(spark, [])).count() == 0


def test_pointer_runs_name_equal_terms():
    rng = random.Random(5)
    words = [bytes(rng.choice([97, 98]) for _ in range(rng.choice([1, 7, 8, 9, 16, 17, 40]))) for _ in range(3000)]
    buf = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    names = divergence_audit.run_names(buf, starts, ends).tolist()
    assert len(set(zip(names, words))) == len(set(names)) == len(set(words))


def test_shares_stay_exact_beyond_64_bits():
    counts, totals = np.array([[10 ** 13, 7]]), np.array([3 * 10 ** 13, 10 ** 10])
    want = [[1 + 10 ** 9 * (c + 2) // (t + 10) for c, t in zip(counts[0].tolist(), totals.tolist())]]
    assert divergence_audit.shares(counts, totals, 5).tolist() == want


def test_column_and_matrix_shares_agree(spark):
    got = spark.sql("select 10000000000000L n, 30000000000000L total, 5L v").select(
        divergence_audit.share(*(divergence_audit.F.col(c) for c in ("n", "total", "v")))).first()[0]
    assert got == 1 + 10 ** 9 * (10 ** 13 + 2) // (3 * 10 ** 13 + 10)


# -- cover anchors -------------------------------------------------------------------------

def anchors_brute(rows, width):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    first = {}
    for (i, *_), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k:k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, *_), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[k:k + width])] < i:
                gone |= set(range(k, k + width))
        text = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(text.encode()).hexdigest(), text))
    return plain(out)


def passages():
    """Shared passages at every alignment, of widths around the window's, in documents of many lengths."""
    rng, rows = random.Random(11), awkward_texts()
    for k in range(60):
        size = rng.choice([8, 12, 13, 14, 20, 60])
        passage = " ".join(prose(500 + k % 7, 60).split(" ")[:size])
        rows.append((100 + rng.randrange(80), f"{prose(2000 + k, rng.randrange(1, 30))}\n\t{passage}  {prose(3000 + k, rng.randrange(30))}",
                     "en", "a"))
    rows += [(200, "w " * 40, "en", "a"), (201, "w " * 30, "en", "a"), (202, " ".join(["a b c"] * 20), "en", "a"), (190, "b c " + "a b c " * 9, "en", "a")]
    return rows + [(300 + k, edited(prose(9, 300), k, 6), "en", "a") for k in range(8)]


@pytest.mark.parametrize("width", [13, 9])
def test_anchors_match_brute_force(spark, width):
    rows = passages()
    got = anchor_dedup.remove_repeats(frame(spark, rows), width=width, with_text=True)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    assert plain(got.collect()) == anchors_brute(rows, width)


def test_anchors_without_text_and_of_an_empty_table(spark, short_batches):
    rows = passages()[:60]
    got = anchor_dedup.remove_repeats(frame(spark, rows))
    assert plain(got.collect()) == plain(r[:4] for r in anchors_brute(rows, 13))
    assert anchor_dedup.remove_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        anchor_dedup.remove_repeats(frame(spark, rows), width=8)


def test_cover_meets_every_alignment():
    cover, period = set(anchor_dedup.COVER), anchor_dedup.PERIOD
    assert all(any((i + s) % period in cover and (j + s) % period in cover for s in range(period))
               for i in range(period) for j in range(period))


def test_kept_bytes_join_by_one_space():
    texts = ["a  b\tc ", "", " x", "é\nè"]
    buf, offs = anchor_dedup.column_bytes(pa.array(texts))
    starts, ends, first = anchor_dedup.word_bounds(buf, offs)
    keep = np.array([True, False, True, True, False, True])
    out, at = anchor_dedup.kept_bytes(buf, starts, ends, first, keep)
    assert [out[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == ["a c", "", "x", "è"]
