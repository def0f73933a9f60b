"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features.

Base spans (leftmost, non-overlapping, each kind for itself):
email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts of
at most 255; card ``[0-9]([\\x20-]?[0-9])+`` with 16 to 19 digits passing Luhn; phone ``\\+[0-9][\\x20().0-9-]+[0-9]`` with
8 to 15 digits. A match that fails its test is dropped without another try. Offsets are code points, ends exclusive.

The field adds spans of the same kinds that the patterns miss (numbers without a plus, "name (at) host (dot) tld", cards
and addresses in other layouts). Tokens are runs of non-spaces. Chains are the tokens within ``REACH`` of a token that has
a digit, an at sign, a plus or a bracketed "at"/"dot"; a token farther away is outside by definition, so the field sees
every place where it could tag something. It is trained from the small labelled table of labelled_table(), by
gradient ascent on the penalised log-likelihood (forward-backward), and decoded by Viterbi in numpy batches of chains. An
added span must hold what its kind needs (a valid() test) and overlap no base span, so base spans stay as they are.

Defined cases: null is the empty text, without spans; repeated rows are judged each for itself; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
REACH = 3
FEATURES = 1 << 12
STEPS = 4096  # tokens whose scores are held at a time
REMEMBERED = 64  # characters of a word whose features are cached
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")  # possessive: nothing follows, so no step is remembered
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")
TRIGGER = re.compile(r"[0-9@+]|[\[(](?:at|dot)[\])]", re.I)
TOKEN = re.compile(r"\S+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


# ---------------------------------------------------------------- base spans


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return NO_DIGIT.sub("", text)


def emails(text: str) -> list[tuple[int, int]]:
    """From at sign to at sign: the local part is the run before it, so no text is scanned twice."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
            last = host.end()
        else:
            last = at + 1  # the local characters before this sign can't belong to the next one
        at = text.find("@", last)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four parts at a time from each maximal run of dotted digits."""
    out = []
    for run in DOTTED.finditer(text):
        parts = run[0].split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CARD.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *s) for s in ips(text)] if text.count(".") >= 3 else []
        out += [("card", *s) for s in cards(text)]
        out += [("phone", *s) for s in phones(text)] if "+" in text else []
    return out


# ---------------------------------------------------------------- the field


def _bucket(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "little") % (FEATURES - 1) + 1


#: Words whose identity is a feature of its own.
LEXICON = frozenset("phone tel tel. mobile cell call fax email e-mail mail contact reach write card visa mastercard amex credit account ip address host server at dot version v page section on in of year total price".split())


def shape(word: str) -> str:
    """Letters as a, capitals as A, digits as 9, other characters as they are; runs of letters are one."""
    out: list[str] = []
    for x in word:
        s = "9" if "0" <= x <= "9" else "A" if x.isupper() else "a" if x.isalpha() else x
        if s == "9" or not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def features(word: str) -> list[int]:
    """Seven buckets: shape, its short form, digits, marks, word, ending, and one for all."""
    s = shape(word)
    n = sum("0" <= x <= "9" for x in word)
    low = word.lower().strip(".,;:!?()[]\"'")
    marks = "".join(sorted({x for x in word if x in "@+.-()/:[]#"}))
    return [_bucket(f"shape {s}"), _bucket("short " + re.sub("9+", "9", s)), _bucket(f"digits {min(n, 20)}"), _bucket(f"marks {marks}"), _bucket(f"word {low if low in LEXICON else '-'}"), _bucket(f"end {s[-1:]} {'@' in word} {n > 0}"), _bucket("all")]


class Field:
    """Weights of features at the token and its two neighbours, and of tag transitions."""

    def __init__(self, own: np.ndarray, before: np.ndarray, after: np.ndarray, moves: np.ndarray):
        self.own, self.before, self.after, self.moves = own, before, after, moves
        self.cache = None

    def known(self, word: str) -> np.ndarray:
        if self.cache is None:
            from .bpe import Generations

            self.cache = Generations(lambda w: np.array(features(w)), 20_000)
        return self.cache[word] if len(word) <= REMEMBERED else np.array(features(word))

    def emissions(self, chains: list, start: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """((chains, tokens, tags) scores of the tokens from start to stop, padded; the chains' lengths). Chains are sequences of words
        that can be sliced."""
        sizes = np.array([len(x) for x in chains])
        stop = int(sizes.max()) if stop is None else stop
        x = np.zeros((len(chains), stop - start + 2, 7), np.int32)  # bucket 0 stands beyond the ends
        for i, chain in enumerate(chains):
            words = chain[max(0, start - 1) : stop + 1]
            if len(words):
                at = 0 if start else 1
                x[i, at : at + len(words)] = [self.known(w) for w in words]
        return self.own[x[:, 1:-1]].sum(2) + self.before[x[:, :-2]].sum(2) + self.after[x[:, 2:]].sum(2), sizes

    def decode(self, chains: list[list[str]]) -> list[np.ndarray]:
        """Viterbi over batches of chains of similar lengths."""
        out: list = [None] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        i = 0
        while i < len(order):
            longest = max(8, 2 * len(chains[order[i]]))
            j = i
            while j < len(order) and j - i < max(1, 40_000 // longest) and len(chains[order[j]]) <= longest:
                j += 1
            for k, tags in zip(order[i:j], self._viterbi([chains[k] for k in order[i:j]])):
                out[k] = tags
            i = j
        return out

    def _viterbi(self, chains):
        """Tags of chains of similar lengths. Emissions are made for STEPS tokens at a time; a byte for each token and tag is kept."""
        sizes = np.array([len(x) for x in chains])
        n, steps = len(chains), int(sizes.max())
        back = np.zeros((n, steps, len(TAGS)), np.int8)
        score = None
        for start in range(0, steps, STEPS):
            stop = min(start + STEPS, steps)
            e, _ = self.emissions(chains, start, stop)
            for t in range(start, stop):
                if score is None:
                    score = e[:, 0] + self.moves[-1]
                    continue
                s = score[:, :, None] + self.moves[None, :-1]
                back[:, t] = s.argmax(1)
                score = np.where((t < sizes)[:, None], s.max(1) + e[:, t - start], score)
        tags = np.zeros((n, steps), np.int8)
        rows = np.arange(n)
        tags[rows, sizes - 1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = np.where(t < sizes, back[rows, t, tags[:, t]], tags[:, t - 1])
        return [tags[i, :s] for i, s in enumerate(sizes.tolist())]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def train(sentences: list[list[tuple[str, str]]], rounds: int = 60, rate: float = 0.5, penalty: float = 1e-3) -> Field:
    """AdaGrad on the mean penalised log-likelihood; gradients are observed minus expected counts."""
    k = len(TAGS)
    words = [[w for w, _ in s] for s in sentences]
    gold = [[TAGS.index(t) for _, t in s] for s in sentences]
    params = [np.zeros((FEATURES, k)) for _ in range(3)] + [np.zeros((k + 1, k))]
    squares = [np.full_like(p, 1e-8) for p in params]
    field = Field(*params)
    n, sizes = len(words), np.array([len(w) for w in words])
    steps = int(sizes.max())
    x = np.zeros((n, steps + 2, 7), np.int32)
    y = np.zeros((n, steps), np.int64)
    for i, w in enumerate(words):
        x[i, 1 : len(w) + 1] = [field.known(v) for v in w]
        y[i, : len(w)] = gold[i]
    live = np.arange(steps)[None] < sizes[:, None]
    rows = np.arange(n)
    for _ in range(rounds):
        e = params[0][x[:, 1:-1]].sum(2) + params[1][x[:, :-2]].sum(2) + params[2][x[:, 2:]].sum(2)
        m = params[3]
        a = np.zeros((n, steps, k))
        a[:, 0] = e[:, 0] + m[-1]
        for t in range(1, steps):
            a[:, t] = np.where(live[:, t, None], _lse(a[:, t - 1, :, None] + m[None, :-1], 1) + e[:, t], a[:, t - 1])
        b = np.zeros((n, steps, k))
        for t in range(steps - 2, -1, -1):
            b[:, t] = np.where(live[:, t + 1, None], _lse(m[None, :-1] + (e[:, t + 1] + b[:, t + 1])[:, None], 2), 0)
        z = _lse(a[:, -1], 1)
        miss = -np.exp(a + b - z[:, None, None])
        miss[rows[:, None], np.arange(steps)[None], y] += 1
        miss *= live[:, :, None]
        grads = [np.zeros_like(p) for p in params]
        for g, part in zip(grads, (x[:, 1:-1], x[:, :-2], x[:, 2:])):
            for f in range(part.shape[2]):
                np.add.at(g, part[:, :, f], miss)
        grads[3][-1] = miss[:, 0].sum(0)
        for t in range(1, steps):
            p = np.exp(a[:, t - 1, :, None] + m[None, :-1] + (e[:, t] + b[:, t])[:, None] - z[:, None, None]) * live[:, t, None, None]
            grads[3][:-1] -= p.sum(0)
            np.add.at(grads[3], (y[live[:, t], t - 1], y[live[:, t], t]), 1)
        for p, q, g in zip(params, squares, grads):
            g = g / n - penalty * p
            q += g * g
            p += rate * g / np.sqrt(q)
    return Field(*(p.copy() for p in params))


def labelled_table(seed: int = 11, copies: int = 16) -> list[tuple[int, int, str, str]]:
    """The small labelled table (sentence, place, token, tag), filled from templates by rule."""
    r = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(r.integers(len(xs)))]
    num = lambda n: "".join(str(int(d)) for d in r.integers(0, 10, n))
    word = lambda: "".join(pick(*"aeioulnrst") for _ in range(int(r.integers(2, 9))))
    words = lambda n: " ".join(word() for _ in range(n))
    # Sentences with {kind:form} slots; the rest is outside.
    spots = {
        "phone": [lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"+{num(2)} {num(3)} {num(3)} {num(4)}", lambda: f"0{num(3)} {num(6)}", lambda: f"+{num(11)}", lambda: f"+{num(1)}-{num(3)}-{num(3)}-{num(4)}"],
        "email": [lambda: f"{word()}@{word()}.com", lambda: f"{word()} (at) {word()} (dot) com", lambda: f"{word()} [at] {word()} [dot] org", lambda: f"{word()}.{word()}@{word()}.co.uk", lambda: f"{word()}{num(2)}(at){word()}.net"],
        "ip": [lambda: f"{num(3)}.{num(2)}.{num(1)}.{num(2)}", lambda: f"10.{num(2)}.{num(2)}.{num(1)}:{num(4)}", lambda: "192.168." + num(1) + "." + num(2)],
        "card": [lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}", lambda: f"{num(4)}-{num(4)}-{num(4)}-{num(4)}", lambda: num(16), lambda: f"{num(4)}.{num(4)}.{num(4)}.{num(4)}", lambda: f"{num(4)} {num(6)} {num(5)}"],
    }
    cues = {"phone": ("call", "phone:", "tel", "mobile", "fax", "reach us at", "tel."), "email": ("email", "write to", "contact", "mail:"), "ip": ("host", "server", "address", "from"), "card": ("card", "visa", "credit card", "account")}
    plain = [lambda: num(int(r.integers(1, 6))), lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: f"${num(3)}.{num(2)}", lambda: f"20{num(2)}-{num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"{num(2)}%", lambda: f"{num(3)} {num(3)} {num(3)}", lambda: f"{word()}{num(2)}", lambda: f"v{num(1)}.{num(1)}", lambda: f"{num(1)} + {num(1)}", lambda: f"{word()}_{num(3)}", lambda: f"{num(4)} | {num(3)} | {num(4)}", lambda: f"@{word()}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: num(24)]
    out: list[tuple[int, int, str, str]] = []
    sentence = 0

    def add(parts: list[tuple[str, str | None]]):
        nonlocal sentence
        row = []
        for text, kind in parts:
            for i, w in enumerate(text.split()):
                row.append((w, f"{'I' if i else 'B'}-{kind}" if kind else "O"))
        out.extend((sentence, i, w, t) for i, (w, t) in enumerate(row))
        sentence += 1

    for _ in range(copies):
        for kind, forms in spots.items():
            for form in forms:
                cue = pick(*cues[kind]) if r.random() < 0.7 else word()
                add([(f"{words(int(r.integers(0, 4)))} {cue}", None), (form() + pick("", "", ".", ","), kind), (words(int(r.integers(0, 4))), None)])
        for form in plain:
            add([(words(int(r.integers(1, 4))), None), (form() + pick("", ".", ","), None), (words(int(r.integers(0, 4))), None)])
        add([(words(8), None)])
    return out


def labelled_frame(spark: SparkSession, **how) -> DataFrame:
    return spark.createDataFrame(labelled_table(**how), "sentence bigint, place int, token string, tag string")


def field_from(rows) -> Field:
    """The field of a labelled table: rows of sentence, place, token, tag."""
    by: dict[int, list] = {}
    for sentence, place, token, tag in rows:
        by.setdefault(sentence, []).append((place, token, tag))
    return train([[(w, t) for _, w, t in sorted(x)] for x in by.values()])


_default: list[Field] = []


def default_field(spark: SparkSession) -> Field:
    """The field of the labelled table, trained once in a driver."""
    if not _default:
        _default.append(field_from(labelled_frame(spark).collect()))  # a table of fixed size
    return _default[0]


def valid(kind: str, span: str) -> bool:
    """What an added span must hold."""
    n = len(digits_of(span))
    if kind == "phone":
        return 9 <= n <= 15 and not re.search("[A-Za-z_/:]", span)
    if kind == "card":
        return 15 <= n <= 19 and not re.search("[A-Za-z]", span) and luhn(digits_of(span))
    if kind == "ip":
        parts = re.fullmatch(r"\[?([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\]?(?::[0-9]{1,5})?", span)
        return bool(parts) and all(int(p) <= 255 for p in parts.groups())
    return bool(re.search(r"@|[\[(]at[\])]", span, re.I)) and bool(re.search(r"\.[A-Za-z]{2}|[\[(]dot[\])]", span, re.I))


class Chain:
    """Tokens of a text as bounds; a slice is the words."""

    def __init__(self, text: str, bounds: np.ndarray):
        self.text, self.bounds = text, bounds

    def __len__(self) -> int:
        return len(self.bounds)

    def __getitem__(self, part: slice) -> list[str]:
        return [self.text[s:e] for s, e in self.bounds[part].tolist()]


def chains_of(text: str) -> list[Chain]:
    """The tokens around triggers."""
    if not TRIGGER.search(text):
        return []
    flat = array("q")
    for m in TOKEN.finditer(text):
        flat.extend(m.span())
    bounds = np.frombuffer(flat, np.int64).reshape(-1, 2)
    at = np.frombuffer(array("q", (m.start() for m in TRIGGER.finditer(text))), np.int64)
    hot = np.unique(np.searchsorted(bounds[:, 0], at, "right") - 1)
    cut = np.flatnonzero(np.diff(hot) > 2 * REACH) + 1
    return [Chain(text, bounds[max(0, int(g[0]) - REACH) : int(g[-1]) + REACH + 1]) for g in np.split(hot, cut)]


def added_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], field: Field) -> list[list[tuple[str, int, int]]]:
    flat = [(d, chain) for d, t in enumerate(texts) for chain in chains_of(t)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not flat:
        return out
    taken = [(np.array(sorted(s for _, s, _ in b)), np.array(sorted(e for *_, e in b))) for b in bases]
    for (d, chain), tags in zip(flat, field.decode([chain for _, chain in flat])):
        for i in np.flatnonzero((tags > 0) & ((np.concatenate([[0], tags[:-1]]) != tags) & (np.concatenate([[0], tags[:-1]]) != tags - 1) | (tags % 2 == 1))).tolist():
            kind = (int(tags[i]) - 1) // 2
            j = i + 1
            while j < len(tags) and tags[j] == 2 * kind + 2:
                j += 1
            s, e = int(chain.bounds[i, 0]), int(chain.bounds[j - 1, 1])
            while e > s and texts[d][e - 1] in ".,;:!?)>]}\"'|" and not texts[d][max(s, e - 5) : e].lower().endswith(("(dot)", "(at)")):
                e -= 1
            while s < e and texts[d][s] in "<\"'{|:,;":
                s += 1
            begins, ends = taken[d]
            if s < e and valid(KINDS[kind], texts[d][s:e]) and np.searchsorted(begins, e) <= np.searchsorted(ends, s, "right"):
                out[d].append((KINDS[kind], s, e))
    return out


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end), by kind as listed and then start."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    field = field or default_field(spark)
    shared = spark.sparkContext.broadcast(Field(field.own, field.before, field.after, field.moves))
    kind = "array<struct<kind:string,start:int,end:int>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            extra = added_spans(texts, bases, own)
            rank = {k: i for i, k in enumerate(KINDS)}
            lists = [[[dict(zip(("kind", "start", "end"), s)) for s in sorted(x, key=lambda s: (rank[s[0]], s[1]))] for x in col] for col in (bases, extra)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, arrow) for x in lists)], ["doc_id", "base", "added"])

    return c.map_batches(docs, run, f"doc_id bigint, base {kind}, added {kind}")


def joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: personal data of every document; the counts are those of base spans."""
    out = find(c.read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    of = lambda k: F.filter(F.concat("base", "added"), lambda s: s["kind"] == k)
    every = F.concat(*[F.array_sort(of(k), lambda a, b: a["start"] - b["start"]) for k in KINDS])
    return out.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("added").cast("bigint").alias("n_added"))
