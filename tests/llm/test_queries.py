"""The registered queries with every column of their contract: against DuckDB, the libraries or brute force."""

import hashlib
import os
import re
import struct
import zlib

import pytest

pytest.importorskip("corpusweave.llm")
from corpusweave.llm import bpe, entry, pii, token_counts  # noqa: E402

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """A small table with odd texts: doc_id, text, lang."""
    d = str(tmp_path_factory.mktemp("queries"))
    texts = [None, "", "Mail a.b@c.example or call +49 30 1234567.", "ip 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111", "Grüße aus Köln 日本語 \U0001f600", "<|endoftext|> 's 12", "ref 4111111111111112 +1 (2) 3", "x" * 600, "call (555) 123-4567 now"]
    words = ["ka lo mi", "sch ung ein"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(100 + i, " ".join([words[i % 2]] * (3 + i % 5)), ["xx", "yy"][i % 2]) for i in range(120)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{d}/documents.parquet")
    return d, rows


def test_every_operator_is_registered():
    assert sorted(QUERIES, key=lambda n: int(n.split("_")[0][2:])) == ["op1_decontaminate", "op2_bpe", "op3_substring_dedup", "op4_minhash_dedup", "op5_language_id", "op6_url_filters", "op7_line_dedup", "op8_embedding_dedup", "op9_token_counts", "op10_pii", "op11_quality", "op12_vector_codes", "op13_conversations"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are absent")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.execute(f"create view {t.removesuffix('.parquet')} as from '{DIR}/{t}'")
    rel = con.sql(SQL[name])
    df = QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(x) for x in df.columns]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_bpe_digests(spark, documents):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    d, rows = documents
    t = Tokenizer.from_file(public.path(bpe.VOCABULARY))
    want = {}
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op2_bpe"](spark, d).collect()} == want


def test_language_columns(spark, documents):
    d, rows = documents
    got = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, d).collect()}
    assert {i: r.held_out for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if lang)
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {0, 1} and all(0 <= r.score <= 1 for r in got.values())


def test_token_columns(spark, documents):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    d, rows = documents
    model = sentencepiece.SentencePieceProcessor(model_file=public.path(token_counts.MODEL))
    want = {i: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, _ in rows}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op9_token_counts"](spark, d).collect()} == want


def base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(x) * 2, 10)) if k % 2 else int(x) for k, x in enumerate(reversed(d))) % 10 == 0
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in kinds.items() for m in re.finditer(p, t) if ok(m[0])]


def test_personal_data_columns(spark, documents):
    d, rows = documents
    got = {r.doc_id: r for r in QUERIES["op10_pii"](spark, d).collect()}
    text = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    for i, t, _ in rows:
        spans, r = base(t or ""), got[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in spans) for k in pii.KINDS]
        assert r.base_sha256 == sha(text(spans))
        every = [x for x in r.spans.split(",") if x]
        assert set(every) >= {x for x in text(spans).split(",") if x} and len(every) == len(spans) + r.n_added
        assert every == sorted(every, key=lambda x: (pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])))
    assert got[8].spans == "phone:5:19" and got[8].n_phone == 0


def test_the_field_is_trained_along_its_gradient(monkeypatch):
    """A step of training without AdaGrad's scale against differences of the log-likelihood summed over all tag sequences."""
    import itertools

    import numpy as np

    sentences = [[("call", "O"), ("555-1234", "B-phone"), ("now", "O")], [("a@b.example", "B-email"), ("x", "O")]]
    def likelihood(field):
        total = 0.0
        for s in sentences:
            e, _ = field.emissions([[w for w, _ in s]])
            score = lambda path, e=e: field.moves[-1, path[0]] + sum(e[0, i, t] for i, t in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))
            gold = [pii.TAGS.index(t) for _, t in s]
            z = np.logaddexp.reduce([score(p) for p in itertools.product(range(len(pii.TAGS)), repeat=len(s))])
            total += score(gold) - z
        return total / len(sentences)

    names = ("own", "before", "after", "moves")
    monkeypatch.setattr(pii.np, "sqrt", lambda x: 1.0)
    first = pii.train(sentences, rounds=1, rate=0.5)
    second = pii.train(sentences, rounds=2, rate=0.5, penalty=0.0)
    monkeypatch.undo()
    zero = pii.Field(*(np.zeros_like(getattr(first, n)) for n in names))
    plain = pii.Field(*(getattr(first, n).copy() for n in names))  # a penalty plays no part at zero
    for before, after in ((zero, first), (plain, second)):
        checked = 0
        for name in names:
            step = getattr(after, name) - getattr(before, name)
            for at in list(zip(*np.nonzero(step)))[:25]:
                up, down = (pii.Field(*(getattr(before, n).copy() for n in names)) for _ in range(2))
                getattr(up, name)[at] += 1e-4
                getattr(down, name)[at] -= 1e-4
                assert step[at] == pytest.approx(0.5 * (likelihood(up) - likelihood(down)) / 2e-4, abs=1e-6)
                checked += 1
        assert checked > 50
    assert likelihood(first) > likelihood(zero)


def test_the_field_adds_most_spans_of_layouts_without_base_patterns():
    """Recall of added spans over sentences from another seed, of those that no base pattern finds and that have a valid form."""
    field = pii.field_from(pii.labelled_table())
    by = {}
    for s, _, w, t in pii.labelled_table(seed=77, copies=12):
        by.setdefault(s, []).append((w, t))
    found = asked = 0
    for words in by.values():
        text, spans, at = "", [], 0
        for w, t in words:
            if t.startswith("B-"):
                spans.append([t[2:], at, at + len(w)])
            elif t.startswith("I-"):
                spans[-1][2] = at + len(w)
            text += w + " "
            at += len(w) + 1
        base_spans = pii.base_spans(text)
        added = pii.added_spans([text], [base_spans], field)[0]
        for kind, s, e in spans:
            e = s + len(text[s:e].rstrip(".,"))
            if pii.valid(kind, text[s:e]) and not any(a < e and s < z for _, a, z in base_spans):
                asked += 1
                found += any(k == kind and a < e and s < z for k, a, z in added)
    assert asked > 80 and found / asked > 0.9, (found, asked)
