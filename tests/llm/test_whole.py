"""Scores, the pipeline and scans against brute force on odd tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from test_llm import SCHEMA, labelled_corpus, odd, prose, slow_quality, split_labels, table  # noqa: F401

import corpus_pipeline
from benchtide.llm import decontaminate, language_model, license_scan, packing, quality


def slow_scores(texts, train, deleted, steps):
    """Deleted interpolation by dictionaries, one token after the other."""
    tokens = [[None, *(t or "").encode().lower().split(), "end"] for t in texts]

    def counts(use):
        c = Counter()
        for ws, x in zip(tokens, use, strict=True):
            if x:
                c.update(ws)
                c.update(zip(ws, ws[1:]))
        return c, sum(len(ws) - 1 for ws, x in zip(tokens, use, strict=True) if x)

    def bucket(n):
        return min(int(math.log2(n)) + 1, language_model.LEVELS - 1) if n else 0

    def parts(c, n, v, w):
        return bucket(c[v]), np.array([c[v, w] / max(1, c[v]), c[w] / max(1, n), 1 / (words + 1)])

    every, n = counts(train)
    words = sum(isinstance(k, bytes | str) for k in every)
    kept, m = counts([a and not b for a, b in zip(train, deleted, strict=True)])
    weights = np.full((language_model.LEVELS, 3), 1 / 3)
    for _ in range(steps):
        total = np.zeros_like(weights)
        for ws, a, b in zip(tokens, train, deleted, strict=True):
            if a and b:
                for v, w in zip(ws, ws[1:]):
                    k, p = parts(kept, m, v, w)
                    total[k] += weights[k] * p / (weights[k] * p).sum()
        new = weights.copy()
        for k in np.flatnonzero(total.sum(axis=1) > 0):
            y = np.maximum(total[k] / total[k].sum(), language_model.FLOOR)
            new[k] = y / y.sum()
        done, weights = np.abs(new - weights).max() < 1e-4, new
        if done:
            break
    out = []
    for ws in tokens:
        found = [parts(every, n, v, w) for v, w in zip(ws, ws[1:])]
        out.append(sum(math.log10((weights[k] * p).sum()) for k, p in found))
    return out


@pytest.mark.parametrize("steps", [0, 3])
def test_scores_equal_brute_force(spark, odd, steps):  # noqa: F811
    """With equal weights, and with those that the deleted texts teach; repeated rows and a null doc_id among the texts."""
    from pyspark.sql import functions as F

    ids = [None, 5, 5, *range(10, 10 + len(odd) - 3)]
    docs = table(spark, odd, ids)
    marks = {r.doc_id: (r.train, r.deleted) for r in docs.select("doc_id", (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) != 2).alias("train"), (F.pmod(F.xxhash64("doc_id", F.lit("deleted")), F.lit(language_model.DELETED)) == 0).alias("deleted")).collect()}
    want = slow_scores(odd, [marks[i][0] for i in ids], [marks[i][1] for i in ids], steps)
    assert any(a and b for a, b in marks.values())
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score) for r in language_model.score(docs, batch=50_000, steps=steps).collect())
    want = sorted((-1 if i is None else i, len((t or "").encode().split()) + 1, s) for i, t, s in zip(ids, odd, want, strict=True))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_scores_without_training_texts(spark):
    from pyspark.sql import functions as F

    got = language_model.score(table(spark, ["a b", None, "a b"], [1, 2, 1]), train=F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 3, 0, 0), (1, 3, 0, 0), (2, 1, 0, 0)]
    assert all(r.held_out and r.score == pytest.approx(r.n_tokens * math.log10(1 / 3)) for r in got)


def near_classes(texts):
    """The least index of each text's component, by all pairs; texts without words are alone."""
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


@pytest.mark.parametrize("taught", [False, True])
def test_pipeline_equals_brute_force(spark, odd, tmp_path, taught):  # noqa: F811
    """All five stages, without labels and with labels of both classes, over a table with a null doc_id, repeated rows and columns whose names operators use inside."""
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    rng = np.random.default_rng(21)
    item = [f"b{k}" for k in range(40)]
    leaks = [f"{prose(rng, 30)} {' '.join(item)}", " ".join(item[20:] + item[:20])]
    own, labels = labelled_corpus(rng)
    texts = [*own, *odd, *leaks, "known by nobody", prose(rng, 60), prose(rng, 60)]
    ids = [*range(len(texts) - 3), None, 5000, 5000]
    texts[-1] = texts[-2]
    docs = table(spark, texts, ids)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lab, target, held = split_labels(spark, labels)
    (lab if taught else lab.limit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, " ".join(item)), (8, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    drawn = {*range(len(texts))}
    if taught:
        weights, k = slow_quality(texts, target, held)
        noise = {(r.doc_id, r.text or ""): r.noise for r in docs.select("doc_id", "text", quality._key(F.lit(0.0), F.col("doc_id"), F.col("text"), 1.0, 7).alias("noise")).collect()}
        key = [w + noise[i, t or ""] for w, i, t in zip(weights, ids, texts, strict=True)]
        drawn = {p for p in drawn if key[p] >= sorted(key)[-k]}
        assert 100 < len(drawn) < len(texts) - 50
    last = {}
    for p in sorted(drawn, key=lambda p: -1 if ids[p] is None else ids[p]):
        last[texts[p] or ""] = p  # of equal texts the largest doc_id
    left = sorted(last.values())
    root = near_classes([texts[p] or "" for p in left])
    want = [p for k, p in enumerate(left) if root[k] == k and texts[p] not in leaks]
    encode = Tokenizer.from_file(packing.default_tokenizer()).encode
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {ids[p]: len(encode(texts[p] or "", add_special_tokens=False).ids) + 1 for p in want}
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_decontamination_of_odd_tables(spark):
    """Empty tables, repeated rows, a long text, a text of one word, and matches of equal length."""
    rng = np.random.default_rng(31)
    item = " ".join(f"b{k}" for k in range(30))
    bench = spark.createDataFrame([(1, item), (2, " ".join(["same"] * 40)), (2, " ".join(["same"] * 40))], "item_id long, text string")
    empty = spark.createDataFrame([], SCHEMA)
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.clean(empty, bench).count() == 0
    texts = [f"{prose(rng, 40_000)} {item} {prose(rng, 10)}", "same " * 3_000, f"{item} {item}", f"{item} {item}", " ".join(f"c{k}" for k in range(90)), None]
    got = Counter((r.doc_id, r.item_id, r.covered_tokens, r.tiles) for r in decontaminate.contaminated(table(spark, texts, [0, 1, 2, 2, 4, None]), bench).collect())
    assert got == {(0, 1, 30, 1): 1, (1, 2, 40, 1): 2, (2, 1, 30, 1): 2}
    kept = decontaminate.clean(table(spark, texts, [0, 1, 2, 2, 4, None]), bench).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["4", "None"]


def test_license_scan_of_odd_tables(spark):
    """Repeated rows, a long text, and two windows that hold the template alike: the first is reported."""
    rng = np.random.default_rng(41)
    header = license_scan.TEMPLATES["apache-2.0-header"]
    lead = prose(rng, 30_000)
    texts = [f"{lead} {header}", header, header, f"{header}\n{prose(rng, 700)}\n{header}", lead, None]
    got = [(r.doc_id, r.first_word, r.containment) for r in license_scan.scan(table(spark, texts, [0, 1, 1, 3, 4, None])).filter("license = 'apache-2.0-header'").collect()]
    assert Counter(i for i, *_ in got) == {0: 1, 1: 2, 3: 1} and all(c == 1.0 for *_, c in got)
    where = {i: w for i, w, _ in got}
    assert where[1] == where[3] == 0 and 29_000 < where[0] <= 30_000


def _windows(words, s):
    """The windows of 2 * s shingles that begin every s shingles, as sets."""
    g = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    return [(a, set(g[a : a + 2 * s])) for a in range(0, max(len(g), 1), s)]


def test_full_licenses_equal_brute_force(spark):
    """Every template against every window of every text: whole, reflowed, with a word changed here and there, cut short, and two in a row."""
    rng = np.random.default_rng(43)
    full = {k: v for k, v in license_scan.TEMPLATES.items() if k.endswith("-full")}
    texts = []
    for own in full.values():
        words = own.split()
        texts += [f"{prose(rng, 90)} {own} {prose(rng, 60)}", own.upper().replace(" ", "\n * ", 40), " ".join(words[: len(words) * 17 // 20]), " ".join(words[: len(words) // 2])]
        for every in (60, 33, 12):
            texts.append(" ".join("changed" if k % every == every - 1 else w for k, w in enumerate(words)))
    texts += [" ".join(full.values()), prose(rng, 2000)]
    want = {}
    split = re.compile(r"[0-9A-Za-z_\u0080-\U0010ffff]+").findall
    for name, template in license_scan.TEMPLATES.items():
        t = split(template.lower())
        t = {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
        s = 1 << (len(t) - 1).bit_length()
        for i, text in enumerate(texts):
            share, at = max((len(t & w) / len(t), -a) for a, w in _windows(split(text.lower()), s))
            if share >= 0.8:
                want[i, name] = (share, -at)
    got = {(r.doc_id, r.license): (r.containment, r.first_word) for r in license_scan.scan(table(spark, texts)).collect()}
    assert got.keys() == want.keys() and {n for _, n in got} >= set(full)
    assert all(got[k] == (pytest.approx(want[k][0]), want[k][1]) for k in want)
    assert len(want) > 3 * len(full) and not [i for i, _ in want if i == len(texts) - 1]
