"""The llm operators against brute force, on small and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from benchtide.llm import common as C
from benchtide.llm import decontaminate, exact_dedup, html_extract, jaccard, language_model, license_scan, packing, quality, repeats, secret_scan

SCHEMA = "doc_id long, text string, kept string, node int, row double"
WORDS = "the of and in to a is that for it as with was on by are be this from at or an which not but have".split()


def prose(rng, n):
    return " ".join(WORDS[k] if k < len(WORDS) else f"w{k}" for k in rng.zipf(1.3, n) % 400)


def table(spark, texts, ids=None):
    """Documents with extra columns whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd():
    """Nulls, empties, ties, repeats and a very long text."""
    rng = np.random.default_rng(3)
    long = prose(rng, 60_000)
    passage = prose(rng, 90)
    own = [prose(rng, 120) for _ in range(40)]
    near = [own[0].replace(" ", "  ", 3), own[0] + " end", *(f"{own[1]} {k}" for k in range(12))]
    return [None, "", " \n\t ", "one", "One", "two words", None, long, long, *own, own[2], own[2], *near, f"{passage} {prose(rng, 50)}", f"{prose(rng, 70)} {passage}", "é" * 500, "é" * 500, "a" * 1000, "password = 'x9Kq2ZmP4vLw8Rt' token: abc " + "deadbeef" * 3 + " AKIA" + "Q" * 16]


EMPTY = [exact_dedup.decisions, exact_dedup.dedup, packing.pack, secret_scan.scan, jaccard.components_of, jaccard.dedup, repeats.dedup, language_model.score, license_scan.scan]


@pytest.mark.parametrize("fn", EMPTY, ids=lambda f: f"{f.__module__.rpartition('.')[2]}.{f.__name__}")
def test_empty_tables(spark, fn):
    assert fn(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_dedup(spark, odd):
    ids = [None, 5, 5, *range(10, 10 + len(odd) - 3)]
    got = exact_dedup.decisions(table(spark, odd, ids), support=0.1).collect()
    groups = {}
    for i, t in zip(ids, odd, strict=True):
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    assert len(got) == len(odd)
    for r in got:
        own = groups[r.text_sha256]
        assert r.group_size == len(own) and r.keep_id == max((x for x in own if x is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(dict.fromkeys(groups, 1))
    for most in (exact_dedup.LOSERS, 0):  # the second joins by a shuffle
        kept = exact_dedup.dedup(table(spark, odd, ids), support=0.1, most=most)
        assert kept.columns == table(spark, odd, ids).columns
        assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter((max((x for x in g if x is not None), default=None), t) for g, t in ((groups[hashlib.sha256(t.encode()).hexdigest()], t) for t in {t or "" for t in odd}))


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    got = packing.pack(table(spark, odd), with_ids=True).collect()
    encode = Tokenizer.from_file(packing.default_tokenizer()).encode
    by = {}
    for r in got:
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in got}) == len(got)
    for i, t in enumerate(odd):
        ids = [*encode(t or "", add_special_tokens=False).ids, 2]
        rows = sorted(by[i], key=lambda r: r.start)
        assert [x for r in rows for x in r.ids] == ids and {r.doc_tokens for r in rows} == {len(ids)}


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    texts = ["<|endoftext|> a<|ENDOFTEXT|>b İ ÉÉ don't DON'T!!'s x's. 12.5%!! ….. ’s \x1c\x85z ΣΣ a_b _ ...''s.", " 　 \U0001f600!! finﬁ. İstanbul K"]
    for t, e in zip(texts, Tokenizer.from_file(packing.default_tokenizer()).encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(packing.Encoder(packing.default_tokenizer(), 3).encode(t.encode()), "<u4").tolist() == e.ids


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 12_345])
def test_binary_lengths(n):
    x = packing.lengths(n)
    assert sum(x) == n and all(k & (k - 1) == 0 for k in x) and len({k for k in x if k < 4096}) == sum(k < 4096 for k in x)


def test_repeated_windows(spark, odd):
    got = {r.doc_id: r for r in repeats.dedup(table(spark, odd), with_text=True).collect()}
    texts = [(t or "").encode() for t in odd]
    seen = Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    for i, t in enumerate(texts):
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)


def components(texts, ids):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(sets)):
        if sets[i]:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: (len(s), least[find(i)] if s else ids[i]) for i, s in enumerate(sets)}


def test_jaccard_components(spark, odd):
    want = components(odd, list(range(len(odd))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(table(spark, odd)).collect()}
    assert got == want
    kept = {r.doc_id for r in jaccard.dedup(table(spark, odd)).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_jaccard_chains(spark):
    """Links that only chains make, many of them in the same tiles."""
    rng = np.random.default_rng(5)
    base, texts = [f"u{k}" for k in range(150)], []
    for k in range(60):
        base = base[:]
        base[int(rng.integers(0, len(base)))] = f"new{k}"
        texts.append(" ".join(base))
    texts += [" ".join(rng.permutation(base)) for _ in range(10)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(table(spark, texts), percent=85).collect()}
    assert got == components(texts, list(range(len(texts))))


def test_jaccard_large_tiles(spark):
    """A third of the rows are near copies of one text, some of them linked by chains only: pieces of tiles, cells of several blocks."""
    rng = np.random.default_rng(12)
    base, texts = [f"u{k}" for k in range(60)], [prose(rng, 30) for _ in range(600)]
    for k in range(300):
        own = base[:]
        for x in rng.integers(0, len(base), int(rng.integers(0, 4))):
            own[x] = f"new{k}x{x}"
        texts.append(" ".join(own))
    texts += ["same " * 20_000, " ".join(f"l{k}" for k in range(20_000)), " ".join(f"m{k}" for k in range(20_000))]
    want = components(texts, list(range(len(texts))))
    found = jaccard.classes(table(spark, texts), tile_block=32)
    least = {r.root: r.least for r in found.groupBy("root").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "least").collect()}
    assert {r.doc_id: (r.n, least[r.root]) for r in found.collect()} == want


def test_bitmaps_fold():
    """A wide bitmap folded has the bits of a narrow one, and keeps its bound."""
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:19_000], rng.integers(0, 2**63, 900, dtype=np.uint64)]))
    c = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    bits = jaccard.bitmaps(np.concatenate([a, b, c]), np.cumsum([0, len(a), len(b), len(c)]))
    two = jaccard.folded([bits[0], jaccard.bitmaps(a[:100], np.array([0, 100]))[0]])
    assert two.shape == (2, jaccard.bits_of(100) // 8) and not (two[1] & ~two[0]).any()
    x, y, z = jaccard.folded(bits)
    assert jaccard.may_link(len(a), x, len(b), y) and not jaccard.may_link(len(a), x, len(c), z)


@pytest.mark.parametrize("size", [3, 8, 30, 200, 1500])
def test_linked_sets_share_a_tile(size):
    rng = np.random.default_rng(size)
    for _ in range(40):
        both = rng.integers(0, 2**63, size, dtype=np.uint64)
        extra = int(size * 0.15 / 0.85 * rng.random())
        a = np.unique(np.concatenate([both, rng.integers(0, 2**63, extra // 2, dtype=np.uint64)]))
        b = np.unique(np.concatenate([both, rng.integers(0, 2**63, extra - extra // 2, dtype=np.uint64)]))
        if len(a) == len(b) == size or not jaccard.linked(a, b):
            continue
        keys, whose = jaccard.tiles(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert set(keys[whose == 0]) & set(keys[whose == 1])
        bits = jaccard.folded(jaccard.bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
        assert jaccard.may_link(np.array([len(a)]), bits[:1], np.array([len(b)]), bits[1:])[0]


@pytest.mark.parametrize("percent", [20, 50, 65, 80, 95])
def test_linked_sets_share_a_tile_at_any_bound(percent):
    rng = np.random.default_rng(percent)
    seen = 0
    for size in (2, 3, 5, 9, 40, 300):
        for _ in range(40):
            b = np.unique(rng.integers(0, 2**63, size * 100 // percent, dtype=np.uint64))
            a = np.sort(rng.permutation(b)[:size])
            own = np.unique(np.concatenate([a, rng.integers(0, 2**63, int(rng.integers(0, size + 1)), dtype=np.uint64)]))
            for x, y in ((a, b), (own, a)):
                if len(x) == len(y) == len(np.intersect1d(x, y)) or not jaccard.linked(x, y, percent):
                    continue
                keys, whose = jaccard.tiles(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), percent)
                assert set(keys[whose == 0]) & set(keys[whose == 1])
                seen += 1
    assert seen


def test_pipeline_near_duplicates(spark, odd):
    """The pipeline's stage links five-word shingles at 0.8, by brute force."""
    rng = np.random.default_rng(11)
    texts = list(odd)
    for n, changes in ((900, 19), (900, 19), (900, 22), (60, 1), (60, 2), (12, 1), (300, 6), (300, 7)):
        base = [f"v{len(texts)}x{k}" for k in range(n)]
        texts.append(" ".join(base))
        for k in range(changes):
            base[(k + 1) * n // (changes + 1)] = f"other{k}"
        texts.append(" ".join(base))
    texts += [" ".join(f"q{k}" for k in range(n)) for n in (40, 46, 50, 60)] + [prose(rng, 3)]
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    want = {i for i in range(len(texts)) if not sets[i] or i == root.index(root[i])}
    assert len(odd) in want and len(odd) + 1 not in want
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, table(spark, texts), "").collect()}
    assert kept == want


def test_language_model(spark, odd):
    got = language_model.score(table(spark, odd), batch=50_000).collect()
    tokens = [[*(t or "").encode().lower().split(), None] for t in odd]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(odd))]
    c = Counter(w for ws, x in zip(tokens, train, strict=True) if x for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(odd)
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, not train[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))


def test_language_model_beats_its_base(spark):
    rng = np.random.default_rng(8)
    follow = {k: rng.permutation(60)[:4] for k in range(60)}
    texts = []
    for _ in range(400):
        x, ws = int(rng.integers(60)), []
        for _ in range(60):
            ws.append(f"t{x}")
            x = int(rng.choice(follow[x]))
        texts.append(" ".join(ws))
    d = language_model.score(table(spark, texts), batch=20_000).filter("held_out").selectExpr("sum(score) / sum(n_tokens) AS s", "sum(base_score) / sum(n_tokens) AS b").first()
    assert d.s > d.b + 0.5 and d.s > math.log10(1 / 6)  # four followers of equal odds, and a start


def test_mixture_probabilities_add_up():
    """Over all known words and one unknown, given any context."""
    x = language_model.Tokens([b"a b a c", b"b a b"])
    count = np.bincount(np.concatenate([x.token, x.pair]), minlength=len(x.keys))
    words = np.unique(x.token)
    w = np.array([0.5, 0.3, 0.2])
    for context in words:
        if (x.context == context).any():
            pairs = {int(x.token[k]): int(x.pair[k]) for k in np.flatnonzero(x.context == context)}
            p = sum(w[0] * (count[pairs[t]] / (x.context == context).sum() if t in pairs else 0) + w[1] * count[t] / len(x.token) + w[2] / (len(words) + 1) for t in words.tolist())
            assert p + w[2] / (len(words) + 1) == pytest.approx(1)


def test_decontamination(spark):
    rng = np.random.default_rng(4)
    item = " ".join(f"b{k}" for k in range(40))
    parts = item.split()
    docs = [f"{prose(rng, 50)} {item.upper()}, {prose(rng, 30)}", " ".join([*parts[25:], *prose(rng, 20).split(), *parts[:25]]), " ".join(parts[:12]) + " " + prose(rng, 60), prose(rng, 300), None, ""]
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.tiles) for r in decontaminate.contaminated(table(spark, docs), bench, block=100).collect()}
    assert got == {(0, 7): (1.0, 1), (1, 7): (1.0, 2)}
    assert sorted(r.doc_id for r in decontaminate.clean(table(spark, docs), bench).collect()) == [2, 3, 4, 5]
    assert decontaminate.clean(table(spark, docs), bench.limit(0)).count() == 6 and decontaminate.contaminated(table(spark, docs), bench.limit(0)).count() == 0


def slow_tiling(a, b, tile):
    """Greedy string tiling by looking at every pair of places."""
    ua, ub, tiles = set(), set(), []
    while True:
        best = None
        for j in range(len(b)):
            for i in range(len(a)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in ua and j + k not in ub:
                    k += 1
                if k >= tile and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return tiles
        tiles.append(best)
        ua.update(range(best[0], best[0] + best[2]))
        ub.update(range(best[1], best[1] + best[2]))


def test_tiling_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 4, 50).tolist(), rng.integers(0, 4, 20).tolist()
        seeds = [(i, j) for i in range(48) for j in range(18) if a[i : i + 3] == b[j : j + 3]]
        if seeds:
            i, j = np.array(seeds).T
            assert sum(k for *_, k in decontaminate.tiling(i, j, 3)) == sum(k for *_, k in slow_tiling(a, b, 3))


def test_license_scan(spark):
    rng = np.random.default_rng(6)
    mit = license_scan.TEMPLATES["mit-text"]
    docs = [f"{prose(rng, 300)}\nReleased under the MIT License. {prose(rng, 40)}", f"{prose(rng, 11)} {mit.lower()} {prose(rng, 5)}", mit[: len(mit) // 3], prose(rng, 500), None, "", "MIT License", license_scan.TEMPLATES["apache-2.0-header"]]
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scan(table(spark, docs)).collect()}
    assert got == {(0, "mit-notice"): 1.0, (1, "mit-text"): 1.0, (7, "apache-2.0-header"): 1.0, (7, "apache-2.0-notice"): 1.0}
    with pytest.raises(ValueError):
        license_scan.Templates({"x": "four words are few"})


def test_secret_scan(spark, odd):
    got = {r.doc_id: r for r in secret_scan.scan(table(spark, odd)).collect()}
    text = odd[-1]
    want = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            want.append((m.start(), 0, m.end()))
    want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    line = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(want))
    r = got[len(odd) - 1]
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 1, 1) and r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and "guess:" in r.spans
    assert got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_guess_costs():
    c = secret_scan.costs_of(None, None)
    weak = ["password123", "P@ssw0rd2019", "qwertyuiop", "aaaaaaaaaaaa", "abcabcabcabc", "12-05-1987"]
    strong = ["x9$kL2!qZ7vB", "deadbeef01234567", "hT7vQz29LmXw"]
    assert max(map(c.least, weak)) < secret_scan.GUESSES < min(map(c.least, strong))
    assert secret_scan.guess_spans("my login: x9kL2QqZ7vB! and pwd: password123", c) == [(10, 21, 3)]


def slow_least(c, s):
    """Over all cuts of a value, by what each piece is."""
    size = math.log10(c.alphabet(s))

    def piece(x):
        n, low = len(x), secret_scan.lowered(x)
        found = [max(size * n, math.log10(11)), c.word(x), c.date(x), c.prose(x)]
        if n >= 3 and all(p in c.next_key for p in zip(low, low[1:])):
            found.append(c.walk(n))
        if n >= 3 and len(set(x)) == 1:
            found.append(size + math.log10(n))
        for u in range(2, n // 2 + 1):
            if n % u == 0 and x == x[:u] * (n // u):
                found.append(min(size * u, c.word(x[:u]) or math.inf) + math.log10(n // u))
        return min(y for y in found if y is not None)

    best = math.inf
    for cut in range(1 << (len(s) - 1)):
        at = [0, *(k + 1 for k in range(len(s) - 1) if cut >> k & 1), len(s)]
        best = min(best, sum(piece(s[a:b]) for a, b in zip(at, at[1:])) + math.lgamma(len(at)) / math.log(10))
    return best


def test_guess_costs_equal_brute_force():
    """On a thousand random values, among them parts of words, dates, walks, runs and repeats."""
    rng = np.random.default_rng(3)
    c = secret_scan.costs_of(None, None)
    parts = ["pass", "word", "lomi", "Xu", "QR", "ñ", "P@ss", "qwe", "123", "aaa", "1987", "12-05-87", "x9", "$", "mama", "abab", "drow", "0", "é", "zz"]
    for _ in range(1000):
        s = "".join(parts[k] for k in rng.integers(0, len(parts), 4))[: int(rng.integers(1, 10))]
        assert c.least(s) == pytest.approx(slow_least(c, s)), s


def test_guess_costs_of_long_values_lose_nothing_by_looking_near():
    """Long runs, walks and repeats with other pieces at their ends: as cheap as the cut that is meant, at most."""
    c = secret_scan.costs_of(None, None)
    size = math.log10(36)
    for s, most in (("a" * 500 + "password1", [size + math.log10(500), 0, size]), ("passw" + "0" * 90 + "1987", [2 * size * 2.5, size + math.log10(90), math.log10(120)]), ("qw" * 200 + "xyz7", [c.walk(400), c.walk(3), size]), ("x7k2" * 90 + "monkey", [4 * size + math.log10(90), math.log10(20)])):
        assert c.least(s) <= sum(most) + math.lgamma(len(most) + 1) / math.log(10) + 1e-9


def test_secrets_outside_the_base(spark):
    """Planted values that no fixed pattern finds, and values that people put into prose; nulls and repeated rows."""
    found = ["my login: x9kL2QqZ7vB!", "pwd => tR8-vq_Zk3#mW", "the passphrase is 7fHq2LwZx9"]
    clean = ["password: elephant99", "login: keyboard77", "pwd: yesterday2018", "password is forbidden", "credentials: " + "-" * 900, None, ""]
    got = {r.doc_id: r for r in secret_scan.scan(table(spark, [*found, *clean, found[0], "token: " + "7fHq2LwZx9" * 3000])).collect()}
    assert all(got[k].n_guess == 1 and got[k].n_assign == 0 for k in range(3)) and not any(got[k].n_guess for k in range(3, 10))
    assert got[10].spans == got[0].spans and got[11].n_assign == 1


def test_guess_costs_of_every_shape_and_length():
    c = secret_scan.costs_of(None, None)
    for value in ("qkzvxwmtplrnbdhs", "QKZVXWMTPLRNBDHS", "xkqzjvwpmtrfgbdc", "x9kL2QqZ7vB" * 7, "correcthorsebatterystaple", "x$9~Qé", "q~X4$wK"):
        assert secret_scan.guess_spans(f"pwd: {value}", c) == [(5, 5 + len(value), 3)], value
    for value in ("-" * 60, "-" * 70, "-" * 1000, "ab" * 100, "password" * 40, "forbidden", "Authentication", "einverstanden", "REQUIRED", "obligatoire", "contraseña", "verpflichtend", "Zurücksetzen", "réinitialiser", "5", "x", "abc"):
        assert secret_scan.guess_spans(f"password: {value}", c) == [], value
    assert c.least("".join(chr(33 + k * k % 89) for k in range(2_000))) > secret_scan.GUESSES


def test_spoken_values_cost_by_their_length():
    """Random values that can be spoken: from 12 letters on a secret, and a longer one is never cheaper for its length."""
    rng, c = np.random.default_rng(14), secret_scan.costs_of(None, None)
    middle = []
    for n in (12, 14, 20, 40, 120):
        values = ["".join(("bdfgklmnprstvz" if k % 2 == 0 else "aeiou")[rng.integers(0, 5 if k % 2 else 14)] for k in range(n)) for _ in range(100 if n < 40 else 10)]
        costs = [c.least(v) for v in values]
        assert np.mean(np.array(costs) >= secret_scan.GUESSES) >= 0.99, n
        middle.append(np.median(costs) / n)
    assert max(middle) < 1.5 * min(middle)


def test_html(spark):
    pages = [
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu item</a></nav><div class='ad'>Buy now</div><article><h1>Head &amp; line</h1><p><b>First <i>long</i> paragraph of the text,\n with more.<br>And on.<p>Short.</p><script>var t='</p>';</script><form>Name <input></form><div class=comments><p>Nice!</p></div></article><aside>Side</aside><footer>Foot</footer></body></html>",
        None,
        "",
        "plain &lt;text&gt;",
        "<p>a<p>b</div></div><p>c",
    ]
    df = spark.createDataFrame([(k, f"u{k}", p, "x") for k, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[0].text == "Head & line\n\nFirst long paragraph of the text, with more. And on.\n\nShort."
    assert [got[k].text for k in (1, 2, 3, 4)] == ["", "", "plain <text>", "a\n\nb\n\nc"] and all(r.n_chars == len(r.text) for r in got.values())


def test_html_keeps_all_running_text():
    long = [f"Paragraph {k} runs on with enough words to be the text of an article, and it says one thing more." for k in range(5)]
    p = [f"<p>{x}</p>" for x in long]
    all_of = "\n\n".join
    assert html_extract.main_text(f"<body><main><article>{p[0]}{p[1]}</article><article>{p[2]}{p[3]}</article></main></body>") == all_of(long[:4])
    assert html_extract.main_text(f"<body><main>{p[0]}{p[1]}<article>{p[2]}{p[3]}{p[4]}</article></main></body>") == all_of(long)
    assert html_extract.main_text(f"<body><div class=post><div class=title><h1>Headline</h1></div><div class=text>{''.join(p)}</div></div></body>") == all_of(["Headline", *long])
    assert html_extract.main_text(f"<body><div><section>{''.join(p) * 4}</section><section>{p[0]}</section></div></body>") == all_of([*long * 4, long[0]])


def soup(rng, n):
    """Pages without roles: menus, teasers and footers in plain elements around an article of paragraphs and short lines. (html, blocks of the article)"""
    for _ in range(n):
        blocks = [f"Head {rng.integers(99)}"]
        for _ in range(int(rng.integers(3, 9))):
            blocks.append(" ".join(f"word{k}" for k in rng.integers(0, 500, int(rng.integers(25, 90)))))
            if rng.random() < 0.3:
                blocks.append("Short line")
        menu = "".join(f"<div><a href='/{k}'>Go {k}</a></div>" for k in range(int(rng.integers(5, 15))))
        foot = "".join(f"<li><a href='/{k}'>Foot <b>{k}</b></a></li>" for k in range(int(rng.integers(8, 15))))
        body = "".join(f"<p>{b}</p>" if k else f"<h1>{b}</h1>" for k, b in enumerate(blocks))
        yield f"<html><body><div class=x1>{menu}</div><div class=x2>{body}</div><div class=x3><ul>{foot}</ul></div></body></html>", blocks


def test_html_regions_come_from_the_ratio(monkeypatch):
    """On pages without roles the ratio finds every block of the article and nothing else; without it, no page is right."""
    pages = list(soup(np.random.default_rng(4), 60))
    assert all(html_extract.blocks_of(h) == b for h, b in pages)
    monkeypatch.setattr(html_extract, "running", lambda lines: (np.ones(len(lines), bool),) * 2)
    assert not any(html_extract.blocks_of(h) == b for h, b in pages)


def test_html_keeps_what_only_looks_like_a_part():
    long = "This paragraph runs on with enough words to be the text of an article, and it says one thing more."
    inner = f"<div class='related-work'><p>{long}</p></div><p class='search'>{long} Search.</p><h2 class='share'>Share of the market</h2><p>{long} <button>Press</button> <math><mi>x</mi></math></p><div class='post-header'><h3>Kept</h3></div>"
    gone = "<div class='related-posts'><p>Gone, though it is long enough to count as running text in any page.</p></div><div id='comments'><p>Gone as well, a reader's view of what stands above it here.</p></div><p hidden>Gone</p>"
    want = [long, f"{long} Search.", "Share of the market", f"{long} Press x", "Kept"]
    assert html_extract.blocks_of(f"<body><article>{inner}{gone}</article><div class='site-header'>Top</div></body>") == want


LONG = [f"Paragraph {k} runs on with enough words to be the text of an article, and it says one thing more, as such texts do." for k in range(6)]


def test_html_keeps_short_lines_beside_the_region():
    """Without article or main: a byline after the headline, a short first and last paragraph; menus, footers and teasers around stay out."""
    p = "".join(f"<p>{x}</p>" for x in LONG)
    menu, foot = "<div><a href=a>Home</a></div><div><a href=b>News</a></div>", "<ul><li><a href=c>About us</a></li></ul><div>All rights reserved</div>"
    blocks = html_extract.blocks_of
    assert blocks(f"<body>{menu}<h1>Head</h1><p>By A. Writer</p>{p}<p>The end.</p>{foot}</body>") == ["Head", "By A. Writer", *LONG, "The end."]
    assert blocks(f"<body>{menu}<h1>Head</h1><div>By A. Writer</div><div>{p}</div><p>The end.</p>{foot}</body>") == ["Head", "By A. Writer", *LONG, "The end."]
    assert blocks(f"<body><nav>Menu</nav><p>To begin with.</p>{p}<p>The end.</p><footer>Foot</footer><p>Imprint</p></body>") == ["To begin with.", *LONG, "The end."]
    assert blocks(f"<body>{menu}<div><h1>Head</h1></div><p>By A. Writer</p><article>{p}<p>The end.</p></article><p>Imprint</p></body>") == ["Head", "By A. Writer", *LONG, "The end."]
    assert blocks(f"<body><h1>Head</h1><p>By <a href=x>A. Writer</a> of this paper</p>{p}<div><p>Another site's note</p></div></body>") == ["Head", "By A. Writer of this paper", *LONG]


def test_html_parts_that_are_the_articles_own():
    """Single words that may name something of the article: kept with running text or as lists, gone as links and buttons; comments, adverts and forms are gone in any case."""
    p = "".join(f"<p>{x}</p>" for x in LONG)
    for part, want in (
        (f"<div class=share><p>{LONG[0]}</p></div>", [LONG[0]]),
        (f"<div id=related><p>{LONG[0]}</p><p>{LONG[1]}</p></div>", LONG[:2]),
        ("<ul class=menu><li>Soup</li><li>Bread</li></ul>", ["Soup", "Bread"]),
        ("<ul class=menu><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>", []),
        ("<div class=share><a href=a>Send</a> <a href=b>Post</a></div>", []),
        ("<div class=share><button>Send</button></div>", []),
        (f"<div class=related><p><a href=a>{LONG[0]}</a></p></div>", []),
        (f"<div class=comments><p>{LONG[0]}</p></div><div class=ad><p>{LONG[1]}</p></div><div class=related-posts><p>{LONG[2]}</p></div><form class=search><p>{LONG[3]}</p></form>", []),
    ):
        assert html_extract.blocks_of(f"<body><article><h1>Head</h1>{p}{part}{p}</article></body>") == ["Head", *LONG, *want, *LONG], part
    assert html_extract.blocks_of(f"<body><div id=menu><p>{LONG[0]}</p></div><article>{p}</article></body>") == LONG


def slow_running(lines):
    """The rule of running text line by line: ratios, their Gaussian means, and clusters cut back to lines above the threshold."""
    ratio = [len(x.text) / max(1, x.tags) for x in lines]
    g = lambda d: math.exp(-0.5 * (d / html_extract.SIGMA) ** 2) if abs(d) <= math.ceil(3 * html_extract.SIGMA) else 0.0
    n = len(lines)
    soft = [sum(g(i - j) * ratio[j] for j in range(n)) / sum(g(i - j) for j in range(n)) for i in range(n)]
    least = min(float(np.std(soft)), float(np.mean(soft)))
    on = [s >= least for s in soft]
    for step in (range(n), range(n - 1, -1, -1)):
        cutting = True
        for k in step:
            if not soft[k] >= least:
                cutting = True
            elif cutting and ratio[k] < least:
                on[k] = False
            else:
                cutting = False
    return on


def test_html_running_text_equals_a_slow_version():
    rng = np.random.default_rng(8)
    for html, _ in soup(rng, 40):
        p = html_extract.Lines()
        p.feed(html)
        p.close()
        p.flush()
        assert html_extract.running(p.lines)[0].tolist() == slow_running(p.lines)


def test_html_odd_pages(spark):
    """Empty tables, repeated rows, null columns, very long and deeply nested pages in time that grows with their size."""
    import time

    schema = "page_id long, url string, html string, text string"
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0
    long = "<p>word</p>" * 50_000
    deep = "<div>" * 20_000 + "deep text" + "</p></b></div>" * 20_000
    at = time.time()
    assert html_extract.blocks_of(deep) == ["deep text"] and len(html_extract.blocks_of(long)) == 50_000
    assert html_extract.blocks_of("<b><p>" + "<article><div>" * 5_000 + "x" + "</b></p>" * 5_000) == ["x"]
    assert time.time() - at < 20
    rows = [(1, "u", "<p>a &amp; b</p>", "y"), (1, "u", "<p>a &amp; b</p>", "y"), (None, None, None, None)]
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, schema)).collect()) == [("1", "a & b", 5), ("1", "a & b", 5), ("None", "", 0)]


def test_quality(spark):
    rng = np.random.default_rng(9)
    texts, labels = [], []
    for k in range(900):
        t = prose(rng, 80)
        kind = k % 3
        texts.append(t if kind == 0 else t.upper().replace(" ", "!! ") if kind == 1 else t.replace(" of ", " idiot scum ", 3))
        labels.append((k, 1 if kind == 0 else k % 2, 1 if kind == 2 else 0))
    texts += [None, ""]
    lab = spark.createDataFrame([x for x in labels if x[0] % 5 < 3 and (x[1], x[2]) in ((1, 0), (0, 0), (1, 1), (0, 1)) and not (x[0] % 3 == 1 and x[1])], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.resample(table(spark, texts), lab).collect()}
    hit = [len(kept & {k for k in range(900) if k % 3 == x}) / 300 for x in range(3)]
    assert hit[0] > 0.97 and hit[1] < 0.03 and hit[2] < 0.1
    assert quality.resample(table(spark, texts), lab.limit(0)).count() == len(texts)
    assert quality.resample(table(spark, texts), lab, k=100).count() == 100
    empty = quality.resample(spark.createDataFrame([], SCHEMA), lab)
    assert empty.count() == 0


def test_draws_follow_the_weights(spark):
    """Over many seeds the texts are drawn as often as their weights say, the first by softmax, the second by the rest's."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    w = [0.0, 0.5, 1.0, 1.5, -1.0]
    p = np.exp(w) / np.exp(w).sum()
    rows = spark.createDataFrame([(k, f"t{k}", x) for k, x in enumerate(w)], "doc_id long, text string, w double").crossJoin(spark.range(4000).withColumnRenamed("id", "seed"))
    for temperature in (1.0, 2.0):
        q = p ** (1 / temperature) / (p ** (1 / temperature)).sum()
        two = [sum(q[i] * q[j] / (1 - q[i]) for i in range(5) if i != j) + q[j] for j in range(5)]
        key = quality._key(F.col("w"), F.col("doc_id"), F.col("text"), temperature, F.col("seed"))
        place = rows.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy(key.desc())))
        got = {r.doc_id: (r.one, r.two) for r in place.groupBy("doc_id").agg(F.avg((F.col("place") == 1).cast("int")).alias("one"), F.avg((F.col("place") <= 2).cast("int")).alias("two")).collect()}
        for k in range(5):
            assert abs(got[k][0] - q[k]) < 0.03 and abs(got[k][1] - two[k]) < 0.03


def test_ratios_grow_with_what_is_counted():
    """Near 0 for few labels, near the plain ratio for many, nothing in between that jumps."""
    before = 0.0
    for n in range(0, 400):
        raw, target = np.full(5000, 1000), np.full(5000, n)
        raw[:50], target[:50] = 1000, 0
        got = quality.ratios(np.stack([raw, target]))
        assert got[0] <= before + 1e-6 and before - got[0] < 1.5 and np.abs(got[50:]).max() < 0.02
        before = float(got[0])
    share = target.sum() / raw.sum()
    assert got[0] == pytest.approx(math.log(0.5 / (1000 * share + 0.5)), abs=0.02)
    assert not quality.ratios(np.zeros((2, 9), int)).any()


def slow_features(text):
    """The buckets of one text, token by token."""
    spread = lambda x: int(C.mix(np.array([x % 2**64], np.uint64))[0])
    found, shapes, last, again = set(), [], None, 0
    for token in re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^\x09-\x0d\x20 0-9A-Za-z_\x80-\xff]+", (text or "").encode()):
        raw = np.frombuffer(token.lower(), np.uint8)
        h = int(C.hashes(raw, np.array([0]), np.array([len(raw)]))[0])
        found.add(spread(h + 1) >> 64 - quality.BITS)
        if re.match(rb"[0-9A-Za-z_\x80-\xff]", token):
            upper, digit = len(re.findall(rb"[A-Z]", token)), len(re.findall(rb"[0-9]", token))
            shape = (3 if not re.search(rb"[a-z]", token) else 4) if upper >= 2 else upper
            shape += (8 if digit == len(token) else 16) if digit else 0
            again = again + 1 if h == last else 0
            shape = 32 + min(int(math.log2(again)), 6) if again else shape
            last = h
        else:
            shape = h
        shapes.append(shape)
    for a, b in zip(shapes, shapes[1:]):
        found.add(spread(spread(a + 7) * 0xD6E8FEB86659FD93 + b) >> 64 - quality.BITS)
    return found


def slow_quality(texts, target, labelled):
    """log weights of texts, and the default k: target has the texts of the target model, labelled (place, good) those held out."""
    features = [slow_features(t) for t in texts]
    raw, own = Counter(), Counter()
    for k, f in enumerate(features):
        raw.update(f)
        own.update(f if k in target else ())
    share, log_own = 0.01, {}
    expected = {b: n * sum(own.values()) / sum(raw.values()) for b, n in raw.items()}
    for b, e in expected.items():
        t = own[b]
        log_own[b] = math.lgamma(t + 0.5) - math.lgamma(0.5) + 0.5 * math.log(0.5 / (0.5 + e)) + t * math.log(e / (0.5 + e)) - (t * math.log(e) - e)
    for _ in range(quality.ROUNDS):
        post = {b: 1 / (1 + math.exp(-max(-700, min(700, x + math.log(share / (1 - share)))))) for b, x in log_own.items()}
        share = min(max(sum(post.values()) / len(post), 1e-6), 0.5)
    ratio = {b: math.log(1 - p + p * (own[b] + 0.5) / (expected[b] + 0.5)) for b, p in post.items()}
    w = [sum(ratio[b] for b in f) for f in features]
    above = lambda c, x: 1 - math.exp(-math.exp(min(x - c, 700)))
    good, bad = [w[k] for k, g in labelled if g], [w[k] for k, g in labelled if not g]
    places = np.quantile(good + bad, np.linspace(0, 1, 200))
    gain, bound = max((np.mean([above(c, x) for x in good]) - np.mean([above(c, x) for x in bad]), -c) for c in {p + x for p in places for x in (-1, 0, 1, 2, 3)})
    if gain <= 1.36 * math.sqrt((len(good) + len(bad)) / (len(good) * len(bad))):
        return w, len(texts)
    return w, max(1, round(sum(above(-bound, x) for x in w)))


def labelled_corpus(rng, n=360):
    """Texts of good, noisy and toxic kinds with ids, and labels of most of them: (texts, labels)."""
    texts, labels = [], []
    for k in range(n):
        t = prose(rng, 20 + k % 50)
        t = t if k % 3 else t.replace(" ", " ## ") if k % 2 else f"{t[:40]} idiot scum moron {t[40:]}"
        texts.append(t)
        if k % 5:
            labels.append((k, int(k % 3 > 0 or k % 2), int(k % 3 == 0 and k % 2)))
    return texts, labels


def split_labels(spark, labels):
    """Which labelled documents teach the target model, and which are held out with what label, as the operator deals them."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.held for r in df.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 1).alias("held")).collect()}
    good = {i: bool(q and not t) for i, q, t in labels}
    return df, {i for i in good if good[i] and not out[i]}, [(i, good[i]) for i in good if out[i]]


def test_weights_and_k_equal_brute_force(spark):
    texts, labels = labelled_corpus(np.random.default_rng(17))
    texts += [None, "", "Same SAME same same 12 a1 !! é_", prose(np.random.default_rng(18), 30_000)]
    lab, target, held = split_labels(spark, labels)
    want, k = slow_quality(texts, target, held)
    found = quality.fit(table(spark, texts), lab)
    got = {r.doc_id: (r.log_weight, r.key >= found.cut) for r in found.weights.collect()}
    assert [got[i][0] for i in range(len(texts))] == pytest.approx(want, rel=1e-4, abs=1e-4)
    assert 100 < k < len(texts) and sum(x for _, x in got.values()) in (k - 1, k, k + 1)
    kept = {i for i, (_, x) in got.items() if x}
    share = {x: np.mean([i in kept for i, g in held if g == x]) for x in (True, False)}
    assert share[True] > 0.8 and share[False] < 0.2


@pytest.mark.parametrize("n", [12, 30, 60, 120])
def test_few_labels(spark, n):
    """However few labels there are, texts stay, and good ones no more seldom than others; no number of labels is a cliff."""
    texts, labels = labelled_corpus(np.random.default_rng(19), 600)
    kept = {r.doc_id for r in quality.resample(table(spark, texts), spark.createDataFrame(labels[:n], "doc_id long, quality int, toxic int")).collect()}
    good = [i for i, q, t in labels if q and not t]
    bad = [i for i, q, t in labels if not q or t]
    assert len(kept) > 150 and np.mean([i in kept for i in good]) >= np.mean([i in kept for i in bad])


def test_labels_that_part_nothing(spark):
    """All weights equal, or labels dealt by chance: all texts stay."""
    chance = spark.createDataFrame([(k, k * 7 % 3 % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    assert quality.resample(table(spark, ["one text"] * 300), chance).count() == 300
    rng = np.random.default_rng(20)
    assert quality.resample(table(spark, [prose(rng, 50) for _ in range(300)]), chance).count() == 300


def test_quality_of_odd_tables(spark, odd):
    """Repeated rows go or stay together, null labels count as none, a k of 0 or beyond the table, ties at k."""
    ids = [None, 5, 5, *range(10, 10 + len(odd) - 3)]
    docs = table(spark, odd, ids)
    lab = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2, None) for i in range(10, 60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = Counter((r.doc_id, r.text) for r in quality.resample(docs, lab).collect())
    every = Counter(zip(ids, odd, strict=True))
    assert all(every[x] == n for x, n in kept.items())
    assert quality.resample(docs, lab, k=0).count() == 0 and quality.resample(docs, lab, k=10_000).count() == len(odd)
    tied = table(spark, ["same text"] * 6 + ["other"], [1] * 6 + [2])
    assert quality.resample(tied, lab, k=3).count() in (6, 7)
    assert quality.resample(docs, lab).columns == docs.columns


def test_kth_largest(spark):
    xs = np.random.default_rng(1).normal(size=500).round(2)
    df = spark.createDataFrame([(float(x),) for x in xs], "key double")
    for k in (1, 7, 250, 500):
        assert quality.kth_largest(df, k) == sorted(xs)[-k]


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_components(spark, most):
    """In one task, and in rounds over several."""
    from benchtide.llm.graph import components

    rng = np.random.default_rng(7)
    edges = [(k, k + 1) for k in range(0, 90)] + [(200 + int(x), 300 + int(y)) for x, y in rng.integers(0, 60, (70, 2))] + [(500, 501), (501, 500), (502, 502)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(edges)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5), most).collect()}
    assert {k: v for k, v in root.items() if k != 502} == got
