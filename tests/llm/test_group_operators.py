"""Near-dedup of texts and vectors, line dedup, URL filters, components and the pipeline: against brute force and odd tables."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpusweave.llm")
import corpus_pipeline  # noqa: E402
from corpusweave.llm import bpe, common, decontaminate, embedding_dedup, language_id, line_dedup, minhash_dedup, url_filters  # noqa: E402
from corpusweave.llm.components import connected_components  # noqa: E402

DOC = "doc_id bigint, text string"


def smallest(n, links, names):
    """The smallest name that each node can reach."""
    label = embedding_dedup.forest(n, np.array([a for a, _ in links], int), np.array([b for _, b in links], int)) if links else np.arange(n)
    low = {}
    for i, x in enumerate(label):
        low[x] = min(low.get(x, names[i]), names[i])
    return [low[x] for x in label]


# ---------------------------------------------------------------- components


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    path = [(i + 1, i) for i in range(200, 260)]
    star = [(500, i) for i in range(501, 560)]
    edges = path + star + [(r.randrange(100), r.randrange(100)) for _ in range(60)] + [(7, 7)]
    r.shuffle(edges)
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    at = {x: i for i, x in enumerate(nodes)}
    want = smallest(len(nodes), [(at[a], at[b]) for a, b in edges if a != b], nodes)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == dict(zip(nodes, want))
    assert connected_components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0


# ---------------------------------------------------------------- 4


def near_docs(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[r.choice(words) for _ in range(r.choice([1, 3, 4, 30, 80, 200]))] for _ in range(n // 5)]
    out = []
    for i in range(n):
        own = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 5, 12])):
            own[r.randrange(len(own))] = r.choice(words)
        if r.random() < 0.3:
            own = [w.upper() for w in own]
        out.append((i, r.choice([" ", "  ", "\n"]).join(own)))
    return out


def brute_near(docs, k, least=80, of=100):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    good = [i for i, (d, _) in enumerate(docs) if d is not None and sets[i]]
    links = [(a, b) for i, a in enumerate(good) for b in good[:i] if of * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    by: dict = {}
    for i, (d, _) in enumerate(docs):
        if d is not None and d in by and i in good:
            links.append((by[d], i))
        elif i in good:
            by[d] = i
    names = [d if d is not None else 1 << 62 for d, _ in docs]
    low = smallest(len(docs), links, names)
    return sorted(((d, len(s), None if d is None else c, d is None or c == d) for (d, _), s, c in zip(docs, sets, low)), key=str)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    docs = near_docs(3, 160)
    got = minhash_dedup.dedup(spark.createDataFrame(docs, DOC).repartition(4), k=k)
    want = brute_near(docs, k)
    assert sorted(map(tuple, got.collect()), key=str) == want and len({x[2] for x in want}) < 140


@pytest.mark.parametrize("group", [4096, 10])
def test_near_duplicates_in_blocks_when_groups_and_chunks_are_small(spark, monkeypatch, group):
    monkeypatch.setattr(minhash_dedup, "GROUP", group)
    monkeypatch.setattr(minhash_dedup, "CHUNK", 7)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    monkeypatch.setattr(minhash_dedup, "SALT", 2)
    r = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(60):  # one dense group, many pairs just above or below the threshold, of different lengths
        own = list(base) + [f"y{i} {k}" for k in range(r.choice([0, 0, 5, 12]))]
        for _ in range(r.randint(0, 8)):
            own[r.randrange(150)] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    got = minhash_dedup.dedup(spark.createDataFrame(docs, DOC), k=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute_near(docs, 4)


def test_links_do_not_depend_on_chunks_and_need_a_shared_band():
    r = np.random.default_rng(21)
    base = r.integers(0, 1 << 62, 200).astype(np.uint64)
    rows = []
    for i in range(40):
        own = np.unique(np.concatenate([base[r.random(200) < 0.9], r.integers(0, 1 << 62, int(r.integers(0, 30))).astype(np.uint64)]))
        rows.append((i, i % 33, r.integers(0, 3, 4), own))
    want = set()
    for i, a in enumerate(rows):
        for b in rows[:i]:
            both = len(np.intersect1d(a[3], b[3]))
            if a[1] != b[1] and (a[2] == b[2]).any() and 100 * both >= 80 * (len(a[3]) + len(b[3]) - both):
                want.add((b[0], a[0]))
    whole = minhash_dedup.Members(rows)
    got = set(zip(*(x.tolist() for x in minhash_dedup.block_links(whole, (0, 40), whole, (0, 40), 80, 100))))
    assert {(a, b) for a, b in got if a < b} == want and want
    one, two = minhash_dedup.Members(rows[:25]), minhash_dedup.Members(rows[25:])
    parts = [minhash_dedup.tile_links(*x, 80, 100) for x in ((one, None), (two, None), (one, two))]
    links = [(int(a), int(b)) for x in parts for a, b in zip(*x)]
    assert smallest(40, links, list(range(40))) == smallest(40, sorted(want), list(range(40)))


def test_rows_of_one_id_keep_the_links_of_their_own_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = [(3, b), (5, a), (5, b), (7, a + " end"), (8, c), (9, c)]
    got = sorted({(x.doc_id, x.component_id) for x in minhash_dedup.dedup(spark.createDataFrame(docs, DOC), k=4).collect()})
    assert got == [(3, 3), (5, 3), (7, 3), (8, 8), (9, 8)]


def test_words_that_fool_polynomials_are_not_equal(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    got = minhash_dedup.dedup(spark.createDataFrame([(1, a), (2, b), (3, a)], DOC), k=4).collect()
    assert {x.doc_id: x.component_id for x in got} == {1: 1, 2: 2, 3: 1}


def test_bands_meet_at_the_threshold():
    """Pairs of a Jaccard similarity of exactly 0.8 that share no band: 1.8e-5 are expected, so more than one of 6000 is a fault."""
    r = np.random.default_rng(22)
    missed = 0
    for n in (36, 90, 360):
        for _ in range(20):
            x = r.integers(0, 1 << 63, (100, n + n // 4)).astype(np.uint64)
            sets = [np.sort(row[cut]) for row in x for cut in (np.s_[:n], np.r_[0 : n - n // 9, n : n + n // 9])]
            h, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            assert len(np.intersect1d(sets[0], sets[1])) * 100 >= 80 * len(np.union1d(sets[0], sets[1]))
            keys = minhash_dedup.band_keys(minhash_dedup.signatures(h, at, minhash_dedup.BANDS * minhash_dedup.ROWS), minhash_dedup.BANDS, minhash_dedup.ROWS)
            missed += int((~(keys[::2] == keys[1::2]).any(axis=1)).sum())
    assert missed <= 1


def test_near_duplicates_of_odd_tables(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    docs = [(1, None), (2, ""), (3, " \n"), (None, "a b c d e f"), (5, "a b c d e f"), (6, "A b c d e f"), (6, "A b c d e f"), (7, "a"), (8, "A"), (9, long), (10, long + " end")]
    df = spark.createDataFrame(docs, DOC).withColumns({x: F.lit(1) for x in ("n", "k1", "bands", "rep", "component", "kept")})
    got = sorted(map(tuple, minhash_dedup.dedup(df, k=4).collect()), key=str)
    assert got == brute_near(docs, 4)
    assert minhash_dedup.dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        minhash_dedup.dedup(df, similarity=(1, 2))


def test_signatures_estimate_similarity():
    r = np.random.default_rng(5)
    a, b = np.unique(r.integers(0, 1 << 63, 1000).astype(np.uint64)), np.unique(r.integers(0, 1 << 63, 250).astype(np.uint64))
    sets = [a, np.sort(np.concatenate([a[125:], b[:125]]))]
    h, at = np.concatenate(sets), np.array([0, len(a), len(a) + len(sets[1])])
    sig = minhash_dedup.signatures(h, at, 512)
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.08


# ---------------------------------------------------------------- 7


def brute_lines(docs, m):
    last = 1 << 62
    rows = []
    for i, t in docs:
        lines = None if t is None else t.split("\n")
        real = [k for k, x in enumerate(lines or []) if x.strip(" \t\r\x0b\x0c")]
        rows.append((i, lines, real, [lines[k].strip(" \t\r\x0b\x0c") for k in real]))
    order = sorted({(last if i is None else i, t) for (i, t) in docs if t is not None}, key=lambda x: x[0])
    assert len({k for k, _ in order}) == len(order), "one text an id here"
    seen = {}
    for key, t in order:
        q = [x.strip(" \t\r\x0b\x0c") for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
        for a in range(len(q) - m + 1):
            seen.setdefault(tuple(q[a : a + m]), (key, a))
    out = []
    for i, lines, real, q in rows:
        gone = set()
        for a in range(len(q) - m + 1):
            if seen[tuple(q[a : a + m])] < (last if i is None else i, a):
                gone.update(real[a : a + m])
        out.append((i, None if lines is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(q), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_lines_equal_brute_force(spark, m):
    r = random.Random(6)
    docs = []
    for i in range(80):
        lines = [r.choice(["a", "b ", " c", "d", "e", "", "  "]) if r.random() < 0.5 else f"line {r.randrange(40)}" for _ in range(r.randint(0, 12))]
        docs.append((i, "\n".join(lines)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None)]
    r.shuffle(docs)
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, DOC).repartition(3), m)
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=str) == brute_lines(docs, m)


def brute_runs(docs, m):
    """Per id (distinct texts): the number of maximal later copies and the longest, each against the first suffix with its first m lines."""
    lines = {i: [x.strip(" \t\r\x0b\x0c") for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")] for i, t in docs}
    first, out = {}, {}
    for i in sorted(lines):
        end, n, longest = 0, 0, 0
        for a in range(len(lines[i]) - m + 1):
            d, b = first.setdefault(tuple(lines[i][a : a + m]), (i, a))
            if (d, b) == (i, a):
                continue
            k = 0
            while a + k < len(lines[i]) and b + k < len(lines[d]) and lines[i][a + k] == lines[d][b + k]:
                k += 1
            if a + k > end:
                n, longest, end = n + 1, max(longest, k), a + k
        out[i] = (n, longest)
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 6])
def test_maximal_runs_equal_brute_force(spark, m):
    r = random.Random(16)
    blocks = [[f"line {r.randrange(60)}" for _ in range(n)] for n in (2, 3, 7, 16, 33, 70)]
    docs = []
    for i in range(50):
        own = [f"own {i} {k}" for k in range(r.randint(0, 3))]
        for _ in range(r.randint(1, 3)):
            x = r.choice(blocks)
            a = r.randrange(len(x))
            own += x[a : a + r.randint(1, len(x))] + [r.choice("ab")] * r.randint(0, 2)
        docs.append((i, "\n".join(own) + "\n" * i))  # no two texts are equal
    docs.append((60, "z\n" * 300))
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, DOC).repartition(3), m)
    assert {x.doc_id: (x.n_runs, x.longest_run) for x in got.collect()} == brute_runs(docs, m)
    assert brute_runs(docs, m)[60] == (1, 299)


def test_lines_of_odd_tables(spark):
    docs = [(1, None), (2, ""), (3, "a\nb\nc"), (4, "a\nb\nc"), (4, "a\nb\nc"), (None, "x\na\nb\ny"), (6, "z\n" * 5000)]
    df = spark.createDataFrame(docs, DOC).withColumns({x: F.lit("extra") for x in ("starts", "copy", "t1", "key", "row", "lines", "n_lines")})
    got = line_dedup.dedup_lines(df)
    assert set(df.columns) | set(line_dedup.RESULTS) == set(got.columns)
    assert sorted(map(tuple, got.select("doc_id", "text", F.col("n_lines"), "n_removed").collect()), key=str) == brute_lines(docs, 2)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def brute_long_lines(docs, m, most):
    """brute_lines where a line of more than ``most`` words is a run by itself."""
    cut = {(i, t): None for i, t in docs}
    places = lambda t: [(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
    seen = {}
    for i, t in sorted((x for x in cut if x[1] is not None), key=lambda x: 1 << 62 if x[0] is None else x[0]):
        real, gone = places(t), set()
        for a in range(len(real)):
            for n in {m, 1}:
                run = tuple(x for _, x in real[a : a + n])
                if len(run) == n and (n == m or len(run[0].split()) > most):
                    if run in seen.setdefault(n, set()):
                        gone.update(k for k, _ in real[a : a + n])
                    seen[n].add(run)
        cut[i, t] = ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(real), len(gone))
    return sorted(((i, *(cut[i, t] or (None, 0, 0))) for i, t in docs), key=str)


@pytest.mark.parametrize("m", [1, 2, 3])
def test_long_lines_are_runs_by_themselves(spark, m):
    r = random.Random(7)
    lines = [" ".join(f"w{r.randrange(9)}" for _ in range(n)) for n in (1, 2, 49, 50, 51, 52, 90, 700)] + ["a  b\t" * 25 + "c", "x" * 500]
    docs = [(i, "\n".join(r.choice(lines) if r.random() < 0.4 else f" line {r.randrange(1000)}" for _ in range(r.randint(1, 6)))) for i in range(60)]
    docs += [(100, lines[6]), (101, lines[6]), (102, lines[0]), (103, lines[0]), (104, lines[4] + "\nonce"), (105, lines[4] + "\nonce"), (106, "new\n\t" + lines[7] + " \nown"), (107, None), (None, lines[5])]
    r.shuffle(docs)
    got = sorted(map(tuple, line_dedup.dedup_lines(spark.createDataFrame(docs, DOC).repartition(3), m).select("doc_id", "text", "n_lines", "n_removed").collect()), key=str)
    assert got == brute_long_lines(docs, m, 50)
    assert m != 2 or {(101, "", 1, 1), (103, lines[0], 1, 0)} <= set(got)


# ---------------------------------------------------------------- 8


def brute_vectors(rows, least=0.95):
    good = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, n = [], [0] * len(rows)
    for a in good:
        for b in good:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links.append((a, b))
                    n[a] += 1
    low = smallest(len(rows), links, [d if d is not None else 1 << 62 for d, _ in rows])
    return sorted(((d, k, None if d is None else c, d is None or d == c) for (d, _), k, c in zip(rows, n, low)), key=str)


@pytest.mark.parametrize("dim, block", [(3, 1 << 20), (8, 64 * 64), (40, 64 * 8 * 40)])
def test_vectors_equal_brute_force(spark, monkeypatch, dim, block):
    monkeypatch.setattr(embedding_dedup, "LEAF", 16)
    r = np.random.default_rng(dim)
    centres = r.standard_normal((12, dim))
    rows = [(i, (centres[r.integers(12)] + r.standard_normal(dim) * r.choice([0.02, 0.1, 0.3])).astype(np.float32).tolist()) for i in range(260)]
    rows += [(1000 + i, rows[5][1]) for i in range(6)] + [(2000, [2 * x for x in rows[7][1]])]
    got = embedding_dedup.dedup_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3), block_bytes=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute_vectors(rows)


def test_vectors_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0, 0.001]), (10, [1.0, 0.0, 0.0]), (11, [1e30, 0.0]), (12, [1e-30, 0.0]), (13, [5.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({x: F.lit(1) for x in ("label", "good", "h1", "rep", "links", "component", "kept")})
    assert sorted(map(tuple, embedding_dedup.dedup_embeddings(df).collect()), key=str) == brute_vectors(rows)
    assert embedding_dedup.dedup_embeddings(df.limit(0)).count() == 0
    assert sorted(r.n_links for r in embedding_dedup.dedup_embeddings(df.where("vec_id < 7")).collect()) == [0] * 6


# ---------------------------------------------------------------- 6


def test_url_filters_as_of_the_fetch(spark):
    entries = [("spam", "Bad.example", "add", 10), ("spam", "bad.example", "remove", 20), ("spam", "bad.example", "remove", 20), ("adult", "x.bad.example/gallery", "add", 5), ("spam", "bad.example", "add", 30), ("mal", "tie.example", "add", 7), ("mal", "tie.example", "remove", 7), (None, "a", "add", 1), ("l", None, "add", 1), ("l", "other.example", "keep", 1), ("l", "example", "add", 1), ("l", "late.example", "add", None), ("l", "y" * 300, "add", 1)]
    caps = [(1, "https://x.bad.example/gallery/1", 9), (2, "https://x.bad.example/gallery/1", 10), (3, "http://BAD.example", 19), (4, "https://bad.example/", 20), (5, "https://bad.example:8080/?q", 30), (6, "https://notbad.example/", 15), (7, "https://tie.example/", 7), (8, None, 15), (9, "nowhere", 15), (10, "https://bad.example/", None), (11, "https://other.example/", 9), (12, "http://user@bad.example/", 15), (12, "http://user@bad.example/", 15)]
    c = spark.createDataFrame(caps, "page_id bigint, url string, fetched_at bigint").withColumns({x: F.lit(1) for x in ("pattern", "list", "begin", "end", "lists")})
    e = spark.createDataFrame(entries, "list string, pattern string, action string, at bigint")
    got = {r.page_id: r.lists for r in url_filters.filter_urls(c, e).collect()}
    assert got == {1: ["adult"], 2: ["adult", "spam"], 3: ["spam"], 4: [], 5: ["spam"], 6: [], 7: ["mal"], 8: [], 9: [], 10: [], 11: [], 12: ["spam"]}
    assert all(r.lists == [] for r in url_filters.filter_urls(c, e.limit(0)).collect()) and url_filters.filter_urls(c.limit(0), e).count() == 0


def test_url_filters_stay_in_the_jvm(spark):
    c = spark.createDataFrame([(1, "https://a.example/", 1)], "page_id bigint, url string, fetched_at bigint")
    e = spark.createDataFrame([("l", "a.example", "add", 1)], "list string, pattern string, action string, at bigint")
    plan = url_filters.filter_urls(c, e)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# ---------------------------------------------------------------- the pipeline


def test_pipeline_against_brute_force_stage_by_stage(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    r = random.Random(12)
    parts = {"en": ["ing", "the", "and"], "de": ["sch", "ung", "ein"]}
    line = lambda lang, n=12: " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(n))
    docs = []
    for i in range(90):
        lang = ["en", "de"][i % 2]
        docs.append([i, "\n".join(line(lang) for _ in range(r.randint(2, 6))), lang, "s"])
    shared = line("en") + "\n" + line("en")
    for i in (3, 40, 41):
        docs[i][1] += "\n" + shared
    docs[50][1] = docs[10][1].replace("\n", " ") + " extra"
    docs[51][1] = docs[10][1].replace("\n", " ")
    docs[60][1] = docs[4][1]
    docs[70][1], docs[71][1] = "1234 !!", None
    item = line("en", 14)
    docs[80][1] += "\n" + item
    rows = [(*d, len(d[1] or "")) for d in docs]
    spark.createDataFrame(rows, DOC + ", lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    texts = {d: t for d, t, *_ in rows if t and any(map(str.isalpha, t))}
    lines = {d: (t, n) for d, t, _, n in brute_lines(list(texts.items()), line_dedup.MIN_RUN)}
    texts = {d: t for d, (t, n) in lines.items() if not n or t.strip()}
    near = brute_near(sorted(texts.items()), 5)
    texts = {d: texts[d] for d, _, _, kept in near if kept}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = {tuple(words(item)[a : a + 10]) for a in range(5)}
    texts = {d: t for d, t in texts.items() if not any(tuple(words(t)[a : a + 10]) in windows for a in range(len(words(t))))}
    codec = bpe.codec(public.path(bpe.VOCABULARY))
    got = {x.doc_id: bytes(x.ids) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {d: codec.encode(t) for d, t in texts.items()}
    assert not {60, 70, 71, 80} & set(got) and {10, 3} <= set(got) and len({10, 50, 51} & set(got)) == 1


def test_stages_return_the_columns_of_documents_and_take_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (None, "and the ing", None, None, None), (2, "", "en", "s", 0), (3, "and the ing\nthe and", "en", "s", 5), (3, "and the ing\nthe and", "en", "s", 5), (4, "sch ung ein", "de", "s", 5)]
    docs = spark.createDataFrame(rows, DOC + ", lang string, source string, n_chars bigint").withColumns({x: F.lit(7) for x in ("score", "kept", "row", "starts", "n_words")})
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).count() == table.count()
    assert corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).where("doc_id = 3").count() == 1


def test_operators_do_not_depend_on_local_checkpoints():
    folder = os.path.dirname(common.__file__)
    assert not any("localCheckpoint" in open(os.path.join(folder, f)).read() for f in os.listdir(folder) if f.endswith(".py"))
    assert decontaminate.WINDOW == 10 and language_id.UND == "und"


def test_a_host_of_very_many_labels(spark):
    import time

    host = ".".join(["a"] * 50_000) + ".evil.example"
    captures = spark.createDataFrame([(1, f"https://{host}/x", 10), (2, "https://b.evil.example/", 10), (3, "https://example/", 10)], "page_id bigint, url string, fetched_at bigint")
    entries = spark.createDataFrame([("spam", "evil.example", "add", 1), ("deep", "a.a.a.evil.example", "add", 1), ("top", "example", "add", 1)], "list string, pattern string, action string, at bigint")
    began = time.perf_counter()
    got = {r.page_id: r.lists for r in url_filters.filter_urls(captures, entries).collect()}
    assert got == {1: ["deep", "spam"], 2: ["spam"], 3: ["top"]} and time.perf_counter() - began < 20
