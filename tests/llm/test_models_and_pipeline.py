import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import awkward_texts, frame, prose

import corpus_pipeline
from claimspark.llm import decontaminate, language_id
from claimspark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


# -- language identification -----------------------------------------------------------

STEMS = {"en": "the and ing tion that with for her this".split(), "de": "der und sch ung nicht ein ich aus für".split(),
         "fr": "les des eau ément que ère une dans où".split()}


def sentence(lang, seed, n=25):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randrange(1, 3))) for _ in range(n)).capitalize() + "."


def test_language_is_learned_and_held_out(spark):
    rows = [(i, sentence(lang, i), lang, "s") for i, lang in enumerate("en de fr en".split() * 60)]
    odd = [(900, None, "en", "s"), (901, "", "de", "s"), (902, "123 !? 4", "fr", "s"), (None, sentence("de", 7), "xx", "s"),
           (903, sentence("fr", 8), None, "s"), (904, sentence("en", 5) * 400, None, "s"), (900, sentence("de", 9), None, "s")]
    docs = frame(spark, rows + odd)
    held = {r[0] for r in docs.where(language_id.held_out(docs["doc_id"])).select("doc_id").collect()}
    assert held == {r[0] for r in rows + odd if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1}
    model = language_id.fit(docs.where(~language_id.held_out(docs["doc_id"])), train_rows=40)
    assert model.languages == ["de", "en", "fr"] and (model.weights == 0).mean() > 0.03  # the l1 penalty
    got = [tuple(r) for r in language_id.predict(docs, model).collect()]
    assert len(got) == len(rows + odd) and all(0 <= s <= 1 for *_, s in got)
    by_id = {i: (p, s) for i, p, s in got if i is not None and i != 900}
    assert np.mean([by_id[i][0] == lang for i, _, lang, _ in rows if i in held]) > 0.95
    assert by_id[901] == ("und", 0.0) and by_id[902] == ("und", 0.0) and by_id[903][0] == "fr" and by_id[904][0] == "en"
    assert sorted(p for i, p, _ in got if i == 900) == ["de", "und"]
    again = language_id.fit(docs.where(~language_id.held_out(docs["doc_id"])), train_rows=40)
    assert (again.weights == model.weights).all() and again.temperature == model.temperature


def test_language_without_training_rows(spark):
    docs = frame(spark, [(1, "words", None, None), (2, None, "en", None)])
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(docs, language_id.fit(docs)).collect()} == {("und", 0.0)}
    empty = frame(spark, [])
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0


def test_ftrl_and_temperature():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 600)
    x = np.hstack([np.eye(3)[y] + rng.normal(0, 0.3, (600, 3)), rng.normal(0, 0.3, (600, 5))]).astype(np.float32)
    w = language_id.fit_ftrl(x, y, 3, l1=0.5)
    logits = x @ w[:-1] + w[-1]
    assert (logits.argmax(1) == y).mean() > 0.9
    assert np.abs(w[:3]).sum() > 5 * np.abs(w[3:8]).sum()
    many = language_id.fit_ftrl(x, y, 3, l1=50.0)
    assert (many == 0).mean() > (w == 0).mean()
    t = language_id.fit_temperature(logits * 7, y)
    assert t == pytest.approx(7 * language_id.fit_temperature(logits, y), rel=0.1)


def test_temperature_rests_on_every_row_that_is_not_fitted(spark, monkeypatch):
    words = {"en": "the house and some water with old trees", "de": "das Haus und etwas Wasser mit alten Bäumen", "fr": "la maison et une eau avec des arbres"}
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        lang = list(words)[i % 3]
        mixed = words[lang].split() + words["en"].split()[:4]
        rows.append((i, " ".join(rng.choice(mixed, 4)), lang, None))
    rows += [(300, "123 !", "en", None), (301, None, "de", None), (302, "eau", None, None), (None, "Haus", "de", None)]
    seen = {}
    monkeypatch.setattr(language_id, "fit_ftrl", lambda x, *a, own=language_id.fit_ftrl: seen.update(fitted=len(x)) or own(x, *a))
    monkeypatch.setattr(language_id, "_calibrated", lambda rest, model, own=language_id._calibrated: seen.update(
        rest=[tuple(r) for r in rest.select("id", "text", "lang").collect()]) or own(rest, model))
    for train_rows in (20, 600):
        model = language_id.fit(frame(spark, rows), train_rows=train_rows)
        assert seen["fitted"] + len(seen["rest"]) == 301 and 0 < seen["fitted"] <= 3 * train_rows
        assert len({r[0] for r in seen["rest"]}) == len(seen["rest"])
        lettered = [r for r in seen["rest"] if any(c.isalpha() for c in r[1])]
        counts, some = model.counts([r[1] for r in lettered])
        assert some.all()
        logits = model.vectors(counts) @ model.weights[:-1] + model.weights[-1]
        y = np.array([model.languages.index(r[2]) for r in lettered])
        # the plain formula, at every temperature
        wrong = 1 / (len(y) + 2)
        target = np.full(logits.shape, wrong / 2)
        target[np.arange(len(y)), y] = 1 - wrong
        loss = [-(target * np.log(np.maximum(language_id.softmax(logits / t), 1e-300))).sum() for t in language_id.GRID]
        assert model.temperature == language_id.GRID[int(np.argmin(loss))]


# -- decontamination -----------------------------------------------------------------------

ITEMS = [(1, prose(901, 40)), (2, prose(902, 25)), (3, prose(903, 60)), (4, None), (5, ""), (6, "only four words here"),
         (7, prose(901, 40)), (8, prose(904, 9)), (None, prose(905, 20)), (9, "rep rep rep rep rep rep rep rep rep rep x y")]


def swapped(text, *places):
    words = text.split(" ")
    for p in places:
        words[p] = "changed"
    return " ".join(words)


def leak_rows():
    text = dict(ITEMS)
    return [(1, prose(1, 50) + " " + text[1] + " " + prose(2, 50), None, None), (2, prose(3, 200), None, None), (3, text[2].upper(), None, None),
            (4, prose(4, 9) + "\n" + swapped(text[3], 0, 1) + "\n" + prose(5, 9), None, None), (5, swapped(text[3], 20, 40, 50), None, None),
            (6, prose(6, 10) + " Only Four\twords here " + prose(7, 4), None, None), (7, text[8] + " " + text[8] + " " + text[2], None, None),
            (8, text[1][:-40], None, None), (9, "rep " * 30 + "x y", None, None), (10, text[None], None, None),
            (11, prose(8, 15000) + " " + text[3], None, None), (1, text[2], None, None),
            *[(r[0] and r[0] + 100, *r[1:]) for r in awkward_texts()]]


def decontaminate_brute(rows, items, width=5, threshold=0.8):
    grams = lambda w: [tuple(w[i:i + width]) for i in range(len(w) - width + 1)] or ([tuple(w)] if w else [])
    own = [(i, lowered(t)) for i, t in items]
    weight = lambda g: sum(len(w.encode()) for w in g)
    out = []
    for i, text, *_ in rows:
        words = lowered(text)
        for item, target in own:
            want, best, count = Counter(grams(target)), None, 0
            for s in range(max(len(words) - len(target), 0) + 1) if target else ():  # a shorter document is one window
                have = Counter(grams(words[s:s + len(target)]))
                shared = sum(weight(g) * min(c, want[g]) for g, c in have.items() if g in want)
                if shared:
                    total = sum(weight(g) * c for g, c in (have | want).items())
                    if shared / total >= threshold:
                        count += 1
                        best = max(best or (-1, 0), (shared / total, -s))
            if best:
                out.append((i, item, -best[1], round(best[0], 9), count))
    return sorted(out, key=str)


def test_leaks_match_brute_force(spark):
    rows = leak_rows()
    items = spark.createDataFrame([(*r, 3) for r in ITEMS], "item_id long, text string, doc_id int")
    want = decontaminate_brute([r for r in rows if r[0] != 119], ITEMS)
    for block in (1000, 3):
        got = decontaminate.contaminated(frame(spark, rows), items, block_items=block)
        assert sorted(((r[0], r[1], r[2], round(r[3], 9), r[4]) for r in got.collect() if r[0] != 119), key=str) == want
    kept = decontaminate.drop_contaminated(frame(spark, rows), items, block_items=3)
    hit = {i for i, *_ in want}
    assert kept.columns == frame(spark, []).columns
    assert {2, 5, 119} <= {r["doc_id"] for r in kept.collect()} and not {3, 4, 6, 7, 8, 10, 11} & {r["doc_id"] for r in kept.collect()}
    assert {3, 4, 6, 7, 8, 10, 11} <= hit


def test_documents_shorter_than_an_item(spark):
    """Brute force over cut items: the whole document is the one window."""
    items = [(1, prose(901, 40)), (2, prose(903, 60)), (3, prose(904, 9)), (4, prose(901, 38))]
    texts = {i: t.split(" ") for i, t in items}
    docs = [(i * 1000 + head * 100 + tail, " ".join(w[head:len(w) - tail])) for i, w in texts.items()
            for head in range(0, 6) for tail in range(0, 14) if 0 < len(w) - tail - head] + [(9999, prose(77, 30))]
    weigh = lambda c: sum(n * sum(map(len, g)) for g, n in c.items())
    grams = lambda w: Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    want = {}
    for d, text in docs:
        for i, target in texts.items():
            have, whole = grams(text.split(" ")), grams(target)
            if len(text.split(" ")) < len(target) and have and weigh(have & whole) / weigh(have | whole) >= 0.8:
                want[d, i] = (0, round(weigh(have & whole) / weigh(have | whole), 9), 1)
    assert (1002, 1) in want and (1004, 1) in want and (1013, 1) not in want
    rows = [(d, t, None, None) for d, t in docs]
    table = spark.createDataFrame(items, "item_id long, text string")
    words = {d: len(t.split(" ")) for d, t in docs}
    for block in (1000, 1):
        got = decontaminate.contaminated(frame(spark, rows), table, block_items=block).collect()
        assert {(r[0], r[1]): (r[2], round(r[3], 9), r[4]) for r in got if words[r[0]] < len(texts[r[1]])} == want
        kept = {r["doc_id"] for r in decontaminate.drop_contaminated(frame(spark, rows), table, block_items=block).collect()}
        assert kept == {d for d, _ in docs} - {r[0] for r in got} and 9999 in kept


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, []), items).count() == 0
    assert decontaminate.contaminated(frame(spark, leak_rows()), none).count() == 0
    assert decontaminate.drop_contaminated(frame(spark, leak_rows()), none).count() == len(leak_rows())


def test_index_returns_every_pair_within_the_radius():
    block = decontaminate.ItemBlock(list(range(40)), [prose(k, 30) for k in range(40)], 5, 22)
    members, own, *_ = block.index[30]
    rng = np.random.default_rng(2)
    prints = np.concatenate([own ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (int(k), len(own))).astype(np.uint64), axis=0)
                             for k in rng.integers(1, 30, 30)])
    got = set(zip(*(x.tolist() for x in block.candidates(30, prints))))
    want = {(i, int(members[j])) for i, p in enumerate(prints) for j, q in enumerate(own) if int(p ^ q).bit_count() <= 22}
    assert got == want and want


# -- queries and pipeline --------------------------------------------------------------------

def test_every_operator_is_registered():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES] == list(range(1, 14))


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    from test_text_operators import base_counts, jaccard_brute, junk, repeats_brute
    text = {1: prose(901, 40)}
    passage = prose(555, 60)
    rows = [(i, prose(i, 60 + i % 20), "en", "abc"[i % 3]) for i in range(60)]
    rows += [(100 + i, prose(i, 60 + i % 20), "en", "a") for i in range(10)]  # copies
    rows += [(200 + i, junk(i), "en", "b") for i in range(15)]
    rows += [(300 + i, prose(700 + i, 30) + " " + passage + " " + prose(800 + i, 30), "en", "c") for i in range(5)]
    rows += [(400, prose(31, 20) + " " + text[1] + " " + prose(32, 20), "en", "a"), (401, "too short", "en", "a"), (402, None, None, None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long") \
        .repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 0 if 200 <= r[0] < 300 else 1, 0) for r in rows if r[0] % 2 == 0], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text[1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
        assert k == 4 or docs.columns == columns
    texts = {r[0]: r for r in rows}
    good = {i for i, r in texts.items() if not base_counts(r[1])[5] and not 200 <= i < 300}
    assert set(seen[0]) == good
    assert set(seen[1]) == {i for i, _, c in jaccard_brute([texts[i] for i in sorted(good)]) if i == c}
    removed = {r[0]: r[2] for r in repeats_brute([texts[i] for i in sorted(seen[1])], 50)}
    assert set(seen[2]) == set(seen[1]) and all(r["n_chars"] == len(r["text"]) for r in seen[2].values())
    assert all(len(texts[i][1]) - len(r["text"]) == removed[i] for i, r in seen[2].items())
    assert sum(passage in r["text"] for r in seen[2].values()) == 1
    assert set(seen[3]) == set(seen[2]) - {400}
    assert set(seen[4]) <= set(seen[3]) and all(1 <= r["copies"] <= 2 for r in seen[4].values())
    whole = {r["doc_id"]: r["copies"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: r["copies"] for i, r in seen[4].items()}


def test_nothing_else_imports_the_subpackage():
    code = ("import sys; sys.modules['claimspark.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e\nnames = e.queries()\n"
            "assert 'pipeline' not in names and not any(n.startswith('op') for n in names) and set(e.oracle_sql()) <= set(names)")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])
