"""Decontamination, substring dedup, BPE, token counts, language ID, personal data: against brute force and odd tables."""

import hashlib
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpusweave.llm")
from corpusweave.llm import bpe, common, decontaminate, language_id, pii, substring_dedup, token_counts  # noqa: E402

DOC = "doc_id bigint, text string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, "   \n\t"), (None, "one two three"), (5, "one two three"), (5, "one two three"), (6, LONG), (7, "Ünï çødé 日本語 \U0001f600 " * 5), (8, "x" * 5000)]


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    extra = {x: F.lit("extra") for x in ("n_words", "item_ids", "starts", "ends", "key", "block", "ids", "decoded", "n_tokens", "n_bytes", "lang_pred", "score", "base", "added", "row")}
    return spark.createDataFrame(ODD, DOC).withColumns(extra)


def vocabulary(seed=1, n=40):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgäß") for _ in range(r.randint(1, 8))) for _ in range(n)]


def random_docs(seed, n, length=60, words=None):
    r = random.Random(seed)
    words = words or vocabulary()
    out = []
    for i in range(n):
        text = " ".join(r.choice(words) + r.choice(["", ".", ",", "\n"]) for _ in range(r.randint(0, length)))
        if out and r.random() < 0.4:
            old = r.choice(out)[1].split(" ")
            a = r.randint(0, len(old))
            text += " " + " ".join(old[a : a + r.randint(5, 40)])
        out.append((i, text))
    return out


def thue_morse(n=10):
    """Two words of 2**n letters that a polynomial modulo a power of two can't tell apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


# ---------------------------------------------------------------- 1


def brute_contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    spans = {}
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            spans.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in set(map(len, spans)):
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in spans:
                    hit.update(range(a, a + k))
                    found |= spans[tuple(w[a : a + k])]
        out.append((d, len(w), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 200])
def test_contamination_equals_brute_force(spark, broadcast_bytes):
    docs = random_docs(2, 60)
    r = random.Random(3)
    items = [(i, " ".join((r.choice(docs)[1].upper() if i % 3 else "Abc DEF").split()[: r.choice([1, 3, 9, 10, 25])])) for i in range(15)] + [(3, "again here"), (None, docs[9][1]), (90, None), (91, ""), (92, "!!")]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id bigint, text string"), broadcast_bytes=broadcast_bytes)
    rows = got.select("row.doc_id", "n_words", decontaminate.n_hit().alias("n"), "item_ids").collect()
    assert sorted(((x[0], x[1], x[2], list(x[3])) for x in rows), key=str) == brute_contamination(docs, items)
    assert any(x[2] for x in rows)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_contamination_of_odd_tables(spark, broadcast_bytes):
    items = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    rows = decontaminate.decontaminate(odd(spark), items, broadcast_bytes=broadcast_bytes).select("row.*", F.col("n_words").alias("n"), F.size("starts").alias("hits")).collect()
    assert sorted((r.doc_id or 0, r.n, r.hits) for r in rows) == [(0, 3, 1), (1, 0, 0), (2, 0, 0), (3, 0, 0), (5, 3, 1), (5, 3, 1), (6, 30_000, 0), (7, 20, 0), (8, 1, 0)]
    none = items.limit(0)
    assert decontaminate.decontaminate(odd(spark), none).where("size(starts) > 0").count() == 0
    assert decontaminate.decontaminate(odd(spark).limit(0), items).count() == 0


def test_the_index_is_small_and_does_not_rest_on_hashes(monkeypatch):
    import pickle

    import numpy as np

    r = random.Random(23)
    items = [(i, " ".join(str(r.randrange(1000)) for _ in range(r.choice([3, 40, 4000])))) for i in range(60)]
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(decontaminate.Index(items))) < 10 * size  # words of three letters
    monkeypatch.setattr(common, "gram_hashes", lambda w, k, base=0: np.zeros(max(0, len(w) - k + 1), common.U64))
    few = [(i, " ".join(t.split()[:30])) for i, t in items[:12]]
    index = decontaminate.Index(few)
    docs = [(i, t) for i, (_, t) in enumerate(few)] + [(99, "1 2 3 4 5 6 7 8 9 10 11 12")]
    for d, t in docs:
        raw = np.frombuffer(t.encode(), np.uint8)
        found = list(decontaminate.hits(decontaminate.Words(raw, np.array([0, len(raw)])), index))
        want = brute_contamination([(d, t)], few)[0]
        assert sorted({int(x) for n, _, w in found for text in index.ids_of(n, np.unique(w)) for x in index.ids[text]}) == want[3]
        assert len({p for n, at, _ in found for a in at.tolist() for p in range(a, a + n)}) == want[2]


# ---------------------------------------------------------------- 3


def brute_substrings(docs, k):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first = {}
    last = float("inf")
    for i, w in words:
        for a in range(len(w) - k + 1):
            g = tuple(w[a : a + k])
            first[g] = min(first.get(g, last), last if i is None else i)
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] < (last if i is None else i):
                gone.update(range(a, a + k))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, sum(e - s for s, e in zip(r.starts, r.ends)), r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("k, block, part", [(13, 4 << 20, 8 << 20), (5, 500, 300), (1, 2000, 2000)])
def test_substrings_equal_brute_force(spark, k, block, part):
    docs = random_docs(4, 120) + [(500, LONG), (501, "head " + LONG), (502, LONG)]
    r = random.Random(5)
    r.shuffle(docs)
    got = substring_dedup.dedup_substrings(spark.createDataFrame(docs, DOC).repartition(5), k, block, part)
    assert rows_of(got) == brute_substrings(docs, k)


def test_substrings_tell_words_apart_that_fool_polynomials(spark):
    docs = []
    for i, w in enumerate([w for n in (10, 11) for w in thue_morse(n)]):
        docs.append((i, " ".join([*"abcdef", w, *"ghijkl"])))
    assert rows_of(substring_dedup.dedup_substrings(spark.createDataFrame(docs, DOC))) == brute_substrings(docs, 13)
    assert all(x[2] == 0 for x in brute_substrings(docs, 13))


@pytest.mark.parametrize("bins, block", [(512, 300), (6, 400), (2, 150)])
def test_blocks_rise_with_the_key_and_follow_bytes(spark, bins, block):
    r = random.Random(17)
    last = (1 << 63) - 1
    keys = [10**15, *range(1000, 1200), *([777] * 90), *([last] * 60), *(r.randrange(10**6) for _ in range(60))]
    rows = [(k, "x" * r.choice([5, 30, 100])) for k in keys]
    total = sum(len(t) for _, t in rows)
    df, bytes_ = common.order_blocks(spark.createDataFrame(rows, "key bigint, text string").repartition(3), "key", block, bins)
    got = df.collect()
    assert bytes_ == total and len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x.block, []).append(x)
    ranks = {}
    for b, xs in by.items():
        ranks.setdefault(b >> common.PART_BITS, []).append((b, {x.key for x in xs}))
    for parts in ranks.values():  # several blocks of a rank: one key
        assert len(parts) == 1 or len(set.union(*(k for _, k in parts))) == 1
    spans = sorted((rank, min(min(k) for _, k in p), max(max(k) for _, k in p)) for rank, p in ranks.items())
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))
    if bins == 512:
        assert max(sum(len(x.text) + 16 for x in xs) for xs in by.values()) < 8 * block


def test_substrings_with_null_and_repeated_ids_in_many_blocks(spark):
    base = random_docs(18, 80)
    docs = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in base]
    docs += [(7, docs[4][1])] * 3 + [(None, docs[0][1])]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(docs, DOC).repartition(3), 5, 400, 300)
    assert rows_of(got) == brute_substrings(docs, 5)


def test_windows_do_not_rest_on_one_hash(spark, monkeypatch):
    docs = random_docs(19, 50)
    import numpy as np

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    raw = np.frombuffer("".join(t for _, t in docs).encode(), np.uint8)
    bounds = np.cumsum([0, *(len(t.encode()) for _, t in docs)])
    h, check, at, docs_ = substring_dedup.window_hashes(raw, bounds, 5)
    seen = {}
    text = [w for _, t in docs for w in words(t)]
    for i, a in enumerate(at.tolist()):
        seen.setdefault(tuple(text[a : a + 5]), set()).add((int(h[i]), int(check[i])))
    assert all(len(x) == 1 for x in seen.values()) and len(set.union(*seen.values())) == len(seen)
    few = h % common.U64(7)  # hashes that agree by chance
    order, new = substring_dedup._in_order(np.zeros(len(h), np.int8), few, check)
    table, checks = few[order[new]], check[order[new]]
    assert len(table) == len({(int(a), int(b)) for a, b in zip(few, check)})
    place = common.places(few, check, table, checks)
    assert (table[place] == few).all() and (checks[place] == check).all()
    assert (common.places(few, check + np.uint32(1), table, checks) >= 0).sum() == sum((int(a), (int(b) + 1) % 2**32) in {(int(x), int(y)) for x, y in zip(few, check)} for a, b in zip(few, check))


def test_substrings_of_odd_tables(spark):
    assert rows_of(substring_dedup.dedup_substrings(odd(spark), 3)) == brute_substrings(ODD, 3)
    assert substring_dedup.dedup_substrings(odd(spark).limit(0)).count() == 0


# ---------------------------------------------------------------- 2 and 9


def random_texts(seed, n):
    r = random.Random(seed)
    pools = ["abc XYZ  '\n\t12", "éÉßßſ İIΣσς ", "…<|startoftext|><|endoftext|>'s't 've", "日本語 한국 가 ", "\x1c\x1d\x85\xa0 a ²½Ⅷ٣", "▁▁ a b", "😀👍🏽 é "]
    return ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 50))) for _ in range(n)]


def test_bpe_equals_the_library_and_round_trips(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path(bpe.VOCABULARY))
    texts = [*random_texts(6, 2000), "", None, LONG, "ΑΣ ΣΑΣ."]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(3)
    for r in bpe.encode_decode(docs).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids) and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(odd(spark)).where("length(ids) > 0").count() == 6 and bpe.encode_decode(odd(spark).limit(0)).count() == 0


def test_bpe_equals_the_library_on_every_code_point():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path(bpe.VOCABULARY)
    t, own = Tokenizer.from_file(path), bpe.Codec(path)
    points = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000 and (x < 0x32400 or 0xE0000 <= x < 0xE0200 or x % 1009 == 0)]
    texts = [f"a{x}b {x} x{x}\u0327\u0301" for x in points]
    for i in range(0, len(texts), 4096):
        for x, ids in zip(texts[i : i + 4096], t.encode_batch(texts[i : i + 4096], add_special_tokens=False)):
            assert own.encode(x) == b"".join(n.to_bytes(4, "little") for n in ids.ids), ascii(x)


def test_bpe_of_long_words_equals_the_library_within_seconds():
    public = pytest.importorskip("public_tokenizers")
    from time import perf_counter

    from tokenizers import Tokenizer

    path = public.path(bpe.VOCABULARY)
    t, own, r = Tokenizer.from_file(path), bpe.Codec(path), random.Random(15)
    mixed = "".join(r.choice("etaoinshrdlu") for _ in range(300_000))
    texts = ["x" * 300_000, mixed, *("".join(chr(r.randrange(a, b)) for _ in range(100_000)) for a, b in ((0xE01, 0xE3B), (0x4E00, 0x9FA0)))]
    texts += [mixed[a : a + n] for n in range(bpe.LONG - 3, bpe.LONG + 4) for a in range(0, 20_000, 1000)]
    began = perf_counter()
    got = [own.encode(x) for x in texts]
    assert perf_counter() - began < 30
    assert got == [b"".join(n.to_bytes(4, "little") for n in t.encode(x, add_special_tokens=False).ids) for x in texts]
    for n in (2, 50, 700):
        parts = [own.first[b] for b in mixed[:n].encode()]
        assert own._scanned(list(parts)) == own._merged(list(parts))


def test_bpe_cache_forgets_and_stays_right():
    cache = bpe.Generations(lambda x: x * 2, 3)
    assert [cache[i % 7] for i in range(50)] == [i % 7 * 2 for i in range(50)] and len(cache) <= 3 and len(cache.old) <= 3


@pytest.mark.parametrize("rows", [0, 7, 65536])
def test_token_counts_equal_the_library(spark, rows):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public.path(token_counts.MODEL))
    texts = [*random_texts(7, 1500), *["the same words again and again"] * 30, "", None, LONG, " ", "  ", "a ", " a", *(w for n in (10, 11) for w in thue_morse(n)), " ".join(w for n in (10, 11) for w in thue_morse(n))]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, rows=rows).collect()}
    assert got == {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(texts)}


def test_token_counts_do_not_rest_on_hashes(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    import numpy as np

    hashes = common.span_hashes
    monkeypatch.setattr(common, "span_hashes", lambda *x: hashes(*x) % common.U64(5))  # nearly all pre-tokens collide
    lib = token_counts.library(public.path(token_counts.MODEL))
    words = sorted({w.encode() for w in vocabulary(3, 60)})
    table = token_counts.Table(words[:30], lib.pretoken_lengths([w.decode() for w in words[:30]]))
    texts = [t for t in random_texts(8, 200) if t] + [" ".join(w.decode() for w in words)]
    raw, bounds = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    assert token_counts._counts(lib, table, raw, bounds).tolist() == lib.lengths(texts)


def test_token_counts_shuffle_no_pre_tokens(spark):
    pytest.importorskip("public_tokenizers")
    plan = token_counts.count_tokens(spark.createDataFrame([(1, "a b")], DOC))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_token_counts_of_odd_tables(spark):
    pytest.importorskip("public_tokenizers")
    assert token_counts.count_tokens(odd(spark)).count() == len(ODD) and token_counts.count_tokens(odd(spark).limit(0)).count() == 0


# ---------------------------------------------------------------- 5


def language_docs(n=400, seed=8):
    r = random.Random(seed)
    parts = {"xx": ["ka", "lo", "mi"], "yy": ["sch", "ung", "ein"], "zz": ["tion", "que", "é"]}
    return [(i, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(r.randint(3, 30))), lang) for i in range(n) for lang in [list(parts)[i % 3]]]


def test_language_id_is_right_on_held_out_rows(spark):
    docs = spark.createDataFrame(language_docs(), DOC + ", lang string")
    out = language_id.identify(docs.withColumn("score", F.lit("clash")), language_id.train(docs)).withColumn("held", language_id.held_out())
    rows = out.where("held").collect()
    assert len(rows) > 60 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 < r.score < 1 for r in rows)


def test_held_out_labels_teach_nothing_and_prediction_reads_the_text_alone(spark):
    docs = spark.createDataFrame(language_docs(), DOC + ", lang string")
    lied = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("lie")).otherwise(F.col("lang")))
    a, b = language_id.train(docs), language_id.train(lied)
    assert a.languages == b.languages == ["xx", "yy", "zz"] and all((x == y).all() for x, y in zip(a.columns, b.columns))


def test_the_sample_to_learn_from_is_bounded(spark):
    rows = [(i, f"ka lo {i}", "xx") for i in range(3000)] + [(5000 + i, f"mi {i} " + "lo " * 40, "yy") for i in range(300)] + [(9000, "za " * 3000, "zz"), (9001, "zo " * 4000, "zz")]
    docs = spark.createDataFrame(rows, DOC + ", lang string").repartition(7)
    got = language_id.sample(docs, per_language=100, sample_docs=150, sample_bytes=4000, sample_text=500)
    count = {x: sum(r.lang == x for r in got) for x in ("xx", "yy", "zz")}
    assert 20 < count["xx"] < 90 and count["yy"] < 40 and len(got) <= 300 and sum(len(r.text) for r in got) <= 8000 + 9000
    assert all(len(r.text) <= 9000 for r in got)  # of zz, which has no short text, the shortest alone
    assert got == language_id.sample(docs.repartition(2), per_language=100, sample_docs=150, sample_bytes=4000, sample_text=500)
    hot = docs.select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("one text of all rows").alias("text"), F.lit("xx").alias("lang"))
    assert len(language_id.sample(hot, sample_docs=50)) <= 100
    assert {r.lang for r in language_id.sample(docs, languages=1)} == {"xx"}


def plain_ftrl(rows, labels, seen, k, epochs=4, alpha=0.3, beta=1.0, l1=0.02, l2=0.1):
    """The update rule weight by weight, with dictionaries; rows: [(bucket, value)]."""
    import math

    z, q, zb, qb = {}, {}, [0.0] * k, [0.0] * k
    sign = lambda x: (x > 0) - (x < 0)
    weight = lambda key: 0.0 if abs(z.get(key, 0.0)) <= l1 else -(z[key] - sign(z[key]) * l1) / ((beta + math.sqrt(q[key])) / alpha + l2)
    bias = lambda j: -zb[j] / ((beta + math.sqrt(qb[j])) / alpha)
    for _ in range(epochs):
        for i in seen:
            w = {(u, j): weight((u, j)) for u, _ in rows[i] for j in range(k)}
            b = [bias(j) for j in range(k)]
            logit = [b[j] + sum(x * w[u, j] for u, x in rows[i]) for j in range(k)]
            e = [math.exp(v - max(logit)) for v in logit]
            for j in range(k):
                slope = e[j] / sum(e) - (labels[i] == j)
                for u, x in rows[i]:
                    g, old = x * slope, q.get((u, j), 0.0)
                    z[u, j] = z.get((u, j), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[u, j]
                    q[u, j] = old + g * g
                zb[j] += slope - (math.sqrt(qb[j] + slope * slope) - math.sqrt(qb[j])) / alpha * b[j]
                qb[j] += slope * slope
    return weight, [bias(j) for j in range(k)]


def test_training_and_temperature_equal_a_plain_second_version():
    import math
    from collections import Counter

    import numpy as np

    docs = language_docs(40)
    texts, langs = [d[1] for d in docs], [d[2] for d in docs]
    model = language_id.fit(texts, langs, seed=3)
    counts = [Counter(language_id.grams([t])[0].tolist()) for t in texts]
    df = Counter(u for x in counts for u in x)
    idf = {u: math.log((1 + len(texts)) / (1 + n)) + 1 for u, n in df.items()}
    rows = [[(u, n / sum(x.values()) * language_id.SCALE * idf[u]) for u, n in sorted(x.items())] for x in counts]
    labels = [sorted(set(langs)).index(x) for x in langs]
    order = np.random.default_rng(3).permutation(len(texts)).tolist()
    held = order[::5]
    weight, bias = plain_ftrl(rows, labels, [i for k, i in enumerate(order) if k % 5], 3)
    assert np.allclose(model.bias, bias)
    assert all(abs(model.columns[j][u] - weight((u, j)) * idf[u]) < 1e-9 for u in df for j in range(3))
    logits = [[b + sum(x * weight((u, j)) for u, x in rows[i]) for j, b in enumerate(bias)] for i in held]
    sure = (len(held) + 1) / (len(held) + 2)

    def loss(t):
        total = 0.0
        for i, z in zip(held, logits):
            norm = math.log(sum(math.exp((v - max(z)) / t) for v in z)) + max(z) / t
            total -= sum((sure if labels[i] == j else (1 - sure) / 2) * (v / t - norm) for j, v in enumerate(z))
        return total

    assert model.temperature == pytest.approx(min(np.geomspace(0.05, 20, 61), key=loss))


def test_language_of_odd_tables(spark):
    model = language_id.train(spark.createDataFrame(language_docs(60), DOC + ", lang string"))
    got = {(r.doc_id, r.lang_pred == "und") for r in language_id.identify(odd(spark), model).collect()}
    assert got == {(1, True), (2, True), (3, True), (None, False), (5, False), (6, False), (7, False), (8, False)}
    empty = spark.createDataFrame([(None, "a", "x"), (1, None, "x"), (2, "a", None)], DOC + ", lang string")
    assert language_id.train(empty) is None and language_id.train(empty.limit(0)) is None
    assert {r.lang_pred for r in language_id.identify(empty, None).collect()} == {"und"}


def test_elastic_net_makes_weights_zero():
    docs = language_docs(200)
    strong = language_id.fit([d[1] for d in docs], [d[2] for d in docs], l1=0.5)
    weak = language_id.fit([d[1] for d in docs], [d[2] for d in docs], l1=0.0)
    assert sum((x != 0).sum() for x in strong.columns) < sum((x != 0).sum() for x in weak.columns)


# ---------------------------------------------------------------- 10


def plain_spans(t):
    dg = lambda s: [int(x) for x in s if x in "0123456789"]
    luhn = lambda d: sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(dg(m[0])) <= 19 and luhn(dg(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(dg(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    r = random.Random(9)
    for _ in range(20_000):
        t = "".join(r.choice("aZ09._%+-@@. ()1234567890.+é\n") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("4111 1111 1111 1111") == [("card", 0, 19)]
    for hard in ("a" * 200_000 + "@", "1" * 200_000, "+1" + "(" * 200_000, "1." * 100_000):
        assert pii.base_spans(hard) == [] or hard.startswith("1.")


@pytest.fixture(scope="module")
def field():
    return pii.field_from(pii.labelled_table())


def test_field_is_right_on_sentences_it_has_not_seen(field):
    rows = pii.labelled_table(seed=99, copies=6)
    by = {}
    for s, _, w, t in rows:
        by.setdefault(s, []).append((w, t))
    tags = field.decode([[w for w, _ in x] for x in by.values()])
    right = [pii.TAGS[t] == g for x, got in zip(by.values(), tags) for (_, g), t in zip(x, got)]
    assert sum(right) / len(right) > 0.95


def test_field_adds_and_never_touches_base_spans(field):
    texts = ["call me at (555) 123-4567 today", "write john (at) example (dot) com now", "price $12.50 in 2024-01-02 for 123 456 789", "mail a.b@c.example ok", "plain words only", ""]
    bases = [pii.base_spans(t) for t in texts]
    added = pii.added_spans(texts, bases, field)
    assert [[(k, t[s:e]) for k, s, e in x] for t, x in zip(texts, added)] == [[("phone", "(555) 123-4567")], [("email", "john (at) example (dot) com")], [], [], [], []]


def test_viterbi_equals_search_over_all_paths(field):
    import itertools

    import numpy as np

    words = ["call", "555-123-4567", "now"]
    e, _ = field.emissions([words])
    best = max(itertools.product(range(len(pii.TAGS)), repeat=3), key=lambda p: field.moves[-1, p[0]] + sum(e[0, i, t] for i, t in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:])))
    assert np.array_equal(field.decode([words])[0], best)


def test_personal_data_of_odd_tables(spark, field):
    docs = odd(spark).select("doc_id", "text", "base", "added").unionByName(spark.createDataFrame([(9, "x@y.zz " * 3, "", "")], DOC + ", base string, added string"))
    rows = {r.doc_id: len(r.base) for r in pii.find(docs, field).collect()}
    assert rows[9] == 3 and sum(rows.values()) == 3 and pii.find(docs.limit(0), field).count() == 0


def test_word_and_window_hashes_follow_the_words():
    import numpy as np

    raw = np.frombuffer(b"ab cd ab  cd", np.uint8)
    s, e, docs = common.word_bounds(raw, np.array([0, 5, 12]), common.WHITESPACE_WORD)
    h = common.span_hashes(raw, s, e)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1] and docs.tolist() == [0, 2, 4]
    g = common.gram_hashes(h, 2)
    assert g[0] == g[2] and common.gram_starts(docs, 2).tolist() == [True, False, True]
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 999).astype(np.uint64))
    assert np.array_equal(common.unpack_sorted(common.pack_sorted(v)), v)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_shapes_are_of_whole_words():
    url = "https://" + "a-" * 40
    assert pii.shape(url + "x42") != pii.shape(url + "x") and pii.shape(url + "x42").endswith("a99")
    assert pii.features(url + "B7")[0] != pii.features(url + "b7")[0]
    assert pii.shape("Ab--c12") == "Aa-a99" and pii.shape("") == "" and pii.shape("7" * 100) == "9" * 100


def test_many_copies_of_an_item_against_a_text_that_repeats_it():
    import time
    import tracemalloc

    item = "one two three four five six seven eight nine ten eleven twelve"
    items = [(i, item) for i in range(20_000)] + [(None, item), (30_000, item.upper() + " thirteen"), (30_001, "two words")]
    tracemalloc.start()
    began = time.perf_counter()
    index = decontaminate.Index(items)
    batch = pa.RecordBatch.from_pydict({"row": [1, 2, 3], "text": [" ".join([item] * 20_000), None, "two words " + item]})
    out = next(iter(decontaminate._scan(type("Held", (), {"value": index}))([batch]))).to_pydict()
    assert time.perf_counter() - began < 10 and tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    assert out["n_words"] == [240_000, 0, 14] and out["starts"] == [[0], [], [0]] and out["ends"] == [[240_000], [], [14]]
    assert out["item_ids"] == [[*range(20_000), 30_000], [], [*range(20_000), 30_000, 30_001]]


def test_many_copies_of_an_item_on_both_paths(spark):
    r = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(40))
    items = [(i, r.choice([passage, passage + f" tail{i % 3}", f"other {i % 7} " * 6])) for i in range(300)] + [(None, passage), (5, None)]
    docs = [(i, " ".join(r.choice([passage, "noise here", f"other {i % 7} " * 8, passage[:60]]) for _ in range(6))) for i in range(60)] + [(99, None)]
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    get = lambda **kw: sorted((x.row.doc_id, x.n_words, x.item_ids, x.starts, x.ends) for x in decontaminate.decontaminate(docs, items, **kw).collect())
    one = get()
    assert one == get(broadcast_bytes=0) and any(len(x[2]) > 100 for x in one)


def colliding_words(seed):
    """Two different words of 16 bytes with equal hashes under the key 0: the first lanes are chosen, a second lane is solved for."""
    import numpy as np

    mask, base = (1 << 64) - 1, common._BASE
    mix = lambda x: int(common.mix(np.array([x], common.U64))[0])

    def unmix(y):
        def unshift(v, n):
            out = v
            for _ in range(64 // n + 1):
                out = v ^ (out >> n)
            return out

        y = unshift(y, 31) * pow(0x94D049BB133111EB, -1, 1 << 64) & mask
        y = unshift(y, 27) * pow(0xBF58476D1CE4E5B9, -1, 1 << 64) & mask
        return unshift(y, 30)

    salt = mix(1)
    lane = lambda word, number: mix((mix(int.from_bytes(word, "little") ^ salt) + number * base) & mask)
    r = random.Random(seed)
    good = set(range(0x21, 0x7F))
    one = bytes(r.choice(sorted(good)) for _ in range(16))
    total = (lane(one[:8], 1) + lane(one[8:], 2)) & mask
    while True:
        head = bytes(r.choice(sorted(good)) for _ in range(8))
        tail = (unmix((unmix((total - lane(head, 1)) & mask) - 2 * base) & mask) ^ salt).to_bytes(8, "little")
        if not set(tail) & set(b" \t\n\x0b\x0c\r") and tail.isascii() and 0 not in tail:
            return one.decode(), (head + tail).decode()


def test_words_made_to_collide_are_told_apart(spark):
    import numpy as np

    from corpusweave.llm import minhash_dedup

    pairs = [("abcdefghijklmnop", "yalbpjgt%x}9{d1*"), colliding_words(1), colliding_words(2)]
    docs = []
    for n, (a, b) in enumerate(pairs):
        raw = np.frombuffer((a + b).encode(), np.uint8)
        h = common.span_hashes(raw, np.array([0, len(a)]), np.array([len(a), len(a) + len(b)]))
        assert a != b and h[0] == h[1]  # without a key they collide
        same = " ".join([f"same{n}"] * 12)
        docs += [(10 * n, f"{same} {a}"), (10 * n + 1, f"{same} {b}"), (10 * n + 2, f"{a} w{n}"), (10 * n + 3, f"{b} w{n}")]
    df = spark.createDataFrame(docs, DOC)
    got = {r.doc_id: (r.n_words, list(zip(r.starts, r.ends)), r.kept) for r in substring_dedup.dedup_substrings(df).collect()}
    assert all(not spans and kept == dict(docs)[i] for i, (_, spans, kept) in got.items())
    sets = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash_dedup.dedup(df, k=4).collect()}
    assert all(sets[i][0] == i for i, _ in docs)


def test_a_chain_in_time_steps_is_the_same_chain(spark, monkeypatch):
    r = random.Random(31)
    field = pii.default_field(spark)
    texts = [" ".join(r.choice(["call", "555-123-4567", "12", "10.2.3.4:80", "4111", "a (at) b (dot) com", "x" * 90, "+49"]) for _ in range(n)) for n in (1, 5, 200, 900)]
    bases = [pii.base_spans(t) for t in texts]
    want = pii.added_spans(texts, bases, field)
    monkeypatch.setattr(pii, "STEPS", 7)
    assert pii.added_spans(texts, bases, field) == want and any(want)


def test_two_million_numbers_in_one_text():
    """In a process of its own, whose memory is its peak."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np
from corpusweave.llm import pii
held = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
r = np.random.default_rng(1)
k = len(pii.TAGS)
field = pii.Field(*(r.normal(0, 1, (pii.FEATURES, k)) for _ in range(3)), r.normal(0, 1, (k + 1, k)))
text = " ".join(str(i % 1000) for i in range(2_000_000))
before = held()
pii.added_spans([text], [pii.base_spans(text)], field)
print(held() - before)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert int(said.stdout) < 500, said.stderr
