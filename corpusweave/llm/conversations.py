"""Conversation structure repair by weighted finite-state composition.

Three machines: the input acceptor is the chain of a conversation's messages by turn; the edit transducer keeps a message (K, 0),
gives it another role (R, 2), deletes it (D, 3; a must for blank and repeated messages) or inserts an empty one (I, 2), and adds 1 to a truncated
message that stays; the grammar acceptor takes the role initials ``(s?(ua)+)?``. A state of their composition is (place,
insertions made here, grammar state); its arcs are made when they are asked for. A third insertion at one place would come back to a
grammar state, at a cost, so the transducer counts to two and the composition has no cycle. Weights are pairs (cost, label
string), ordered lexicographically, added by concatenation. From a state at most one arc leaves for each label, so of two paths of
equal cost the first label that differs decides, and a shortest path over costs, from the end backwards, with ties to the least label,
is the one whose label string is least. Steps are remembered by (message class, costs ahead less their least).

A conversation of at most ``hot_bytes`` is repaired in the task that its id's hash falls to. A larger one is ordered by range, whatever
its share of the rows, and cut into chunks of at most about ``hot_bytes``. Of a chunk only the 4 x 4 costs from grammar state to
grammar state, the messages that also occur in an earlier chunk and the role at its ends leave it; folding these small
rows gives the costs at every chunk's end, then the state at its start, with which chunks are repaired one by one. Texts are hashed in
order, as a stream in bounded memory: a digest of one conversation is one chain of bytes. The audit of one conversation is one string.

Messages of one turn come in the order of the SHA-256 of role and text; null turns come first. Null roles and texts are one space. A message's
first fault counts: blank, then repeated (role and text seen earlier), then truncated (its last character but space isn't one of ``.!?``).

Defined cases: rows with a null conv_id are one conversation. A conversation without messages (all marked ``dropped``) has zeros, an empty
audit and the digest of an empty text. A role whose initial isn't s, u or a can't be kept; an empty role has no initial. An empty table gives
an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
STAYS_TRUNCATED = 1
#: The grammar: state -> {initial: next state}. 0 nothing yet, 1 after s, 2 after u, 3 after a.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(("su", "ua", "au"))
MOST_INSERTS = 2
FAR = 1 << 60
SPACE = " \t\n\x0b\x0c\r"
HOT_BYTES = 16 << 20


# ---------------------------------------------------------------- the machines


def edits(symbol: str, fault: int):
    """Arcs of the edit transducer that read one message: (label, cost, what it writes)."""
    stays = STAYS_TRUNCATED if fault == TRUNCATED else 0
    yield DELETE, COST[DELETE], None
    if fault not in (BLANK, DUPLICATE):
        yield KEEP, COST[KEEP] + stays, symbol
        for role in ROLES:
            yield REROLE, COST[REROLE] + stays, role


def arcs(symbol: str | None, fault: int, inserted: int, state: int):
    """Arcs of the composition from (a place before this message, insertions made there, grammar state): (label, cost, reads the
    message, next grammar state). symbol None: the end of the input."""
    if inserted < MOST_INSERTS:
        for role in ROLES:
            if role in GRAMMAR[state]:
                yield INSERT, COST[INSERT], False, GRAMMAR[state][role]
    if symbol is not None:
        for label, cost, writes in edits(symbol, fault):
            if writes is None:
                yield label, cost, True, state
            elif writes in GRAMMAR[state]:
                yield label, cost, True, GRAMMAR[state][writes]


@lru_cache(1 << 14)
def _step(symbol: str | None, fault: int, ahead: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[tuple[str, int] | None, ...], ...]]:
    """(costs from the place before the message by grammar state; for each number of insertions and state the best arc's label and next
    state, None where the path ends). ahead: costs from behind it."""
    costs: list[list[int]] = [[0] * len(GRAMMAR) for _ in range(MOST_INSERTS + 1)]
    best: list[list] = [[None] * len(GRAMMAR) for _ in range(MOST_INSERTS + 1)]
    for inserted in range(MOST_INSERTS, -1, -1):
        for state in range(len(GRAMMAR)):
            found = [(ahead[state], "", None)] if symbol is None else []
            for label, cost, reads, to in arcs(symbol, fault, inserted, state):
                found.append((cost + (ahead[to] if reads else costs[inserted + 1][to]), label, to))
            costs[inserted][state], label, to = min(found, key=lambda x: x[:2])
            best[inserted][state] = (label, to) if label else None
    return tuple(min(x, FAR) for x in costs[0]), tuple(map(tuple, best))


def step(symbol: str | None, fault: int, ahead: tuple[int, ...]):
    least = min(ahead)
    costs, best = _step(symbol, fault, tuple(x - least if x < FAR else FAR for x in ahead))
    return tuple(x + least if x < FAR else FAR for x in costs), best


#: Costs at the end of the input: final states have none, insertions may follow.
END, _CLOSE = step(None, 0, tuple(0 if g in FINAL else FAR for g in range(len(GRAMMAR))))


def backward(messages: list[tuple[str, int]], ahead: tuple[int, ...]) -> tuple[tuple[int, ...], list]:
    """Costs before the first of (initial, fault) messages, and the best arcs at every place. ahead: costs behind the last."""
    out = []
    for symbol, fault in reversed(messages):
        ahead, best = step(symbol, fault, ahead)
        out.append(best)
    return ahead, out[::-1]


def forward(places: list, state: int, last: bool) -> tuple[str, list[str | None], int]:
    """Follows the best arcs: (labels, the role that each R and I gives, else None; the state behind). last: the input ends here."""
    labels, roles = [], []
    for best in [*places, _CLOSE] if last else places:
        inserted = 0
        while (arc := best[inserted][state]) is not None:
            label, to = arc
            labels.append(label)
            roles.append(ROLES["u" if to == 2 else "a"] if label in (REROLE, INSERT) else None)
            state = to
            if label != INSERT:
                break
            inserted += 1
    return "".join(labels), roles, state


def initial(role: str) -> str:
    return role[:1]


def faults_of(messages: list[tuple[str, str]], known: frozenset = frozenset()) -> list[int]:
    """The first fault of each (role, text), 0 for none. known: digests of messages seen before these."""
    seen, out = set(), []
    for role, text in messages:
        body = text.strip(SPACE)
        own = (role, text)
        if not body:
            out.append(BLANK)
        elif own in seen or (known and message_digest(role, text) in known):
            out.append(DUPLICATE)
        else:
            out.append(0 if body[-1] in ".!?" else TRUNCATED)
        seen.add(own)
    return out


def message_digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def rebuilt(messages: list[tuple[str, str]], labels: str, roles: list[str | None]) -> list[tuple[str, str]]:
    """The messages after the edits."""
    out, at = [], 0
    for label, role in zip(labels, roles):
        if label == INSERT:
            out.append((role, ""))
            continue
        if label != DELETE:
            out.append((role or messages[at][0], messages[at][1]))
        at += 1
    return out


# ---------------------------------------------------------------- damage


def damage(conversations: DataFrame) -> DataFrame:
    """Seeded faults by crc32 of ``conv_id:turn`` modulo 20: 0 marks the row ``dropped``, 1 empties its text, 2 removes its ``.!?``, 3 repeats it,
    4 makes its role user; others stay. Adds ``dropped``."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), said("role").alias("role"), said("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


# ---------------------------------------------------------------- Spark side

REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
MESSAGES = "conv_id bigint, place bigint, role string, text string"
_ROWS = ("conv_id", "turn", "role", "text", "dropped")


def _conversations(batches, most: int | None = None):
    """(conv_id, [(turn, role, text)]) of sorted rows, those dropped left out; most: cuts where so many bytes are held."""
    now, rows, held, open_ = None, [], 0, False
    for batch in batches:
        for conv, turn, role, text, dropped in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if open_ and (conv != now or most and held > most):
                yield now, rows
                rows, held = [], 0
            now, open_ = conv, True
            if not dropped:
                rows.append((turn, role, text))
                held += len(text.encode()) + 64
    if open_:
        yield now, rows


def _summary(messages: list[tuple[str, str]], faults: list[int]) -> list[int]:
    """Counts of blank, repeated and truncated messages and of illegal neighbours."""
    first = [initial(r) for r, _ in messages]
    return [faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), sum(a + b not in LEGAL for a, b in zip(first, first[1:]))]


def gaps(least: int | None, most: int | None, distinct: int) -> int:
    return 0 if least is None else most - least + 1 - distinct


def _repair(rows: list[tuple[int | None, str, str]]) -> tuple[list[int], str, list[tuple[str, str]]]:
    """(gaps, counts and cost; audit; the messages repaired) of a whole conversation."""
    messages = [(role, text) for _, role, text in rows]
    turns = {t for t, _, _ in rows if t is not None}
    faults = faults_of(messages)
    costs, places = backward([(initial(r), f) for (r, _), f in zip(messages, faults)], END)
    labels, roles, _ = forward(places, 0, True)
    return [gaps(min(turns, default=None), max(turns, default=None), len(turns)), *_summary(messages, faults), costs[0]], labels, rebuilt(messages, labels, roles)


def _reports(batches):
    out = []
    for conv, rows in _conversations(batches):
        numbers, audit, messages = _repair(rows)
        out.append((conv, *numbers, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest()))
        if len(out) == 1000:
            yield _batch(out, _REPORT)
            out = []
    if out:
        yield _batch(out, _REPORT)


def _messages(batches):
    for conv, rows in _conversations(batches):
        made = _repair(rows)[2]
        if made:
            yield _batch([(conv, i, r, t) for i, (r, t) in enumerate(made)], _MESSAGES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), schema)], schema=schema)


_L, _S = pa.int64(), pa.string()
_REPORT = pa.schema([("conv_id", _L), *[(x, _L) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", _S), ("repaired_sha256", _S)])
_MESSAGES = pa.schema([("conv_id", _L), ("place", _L), ("role", _S), ("text", _S)])


def _ordered(rows: DataFrame) -> DataFrame:
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return rows.select(*_ROWS, F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), digest.alias("digest"))


def split(rows: DataFrame, hot_bytes: int) -> tuple[DataFrame, DataFrame | None, int, int]:
    """(rows of small conversations, rows of large ones or None, bytes of each)."""
    weight = F.sum(F.octet_length("text") + F.octet_length("role") + 64)
    sizes = c.staged(rows.groupBy("key").agg(weight.alias("bytes")), "sizes")
    large = F.col("bytes") > hot_bytes
    total, hot = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(F.when(large, F.col("bytes"))), F.lit(0))).first()
    if not hot:
        c.unstage(sizes)
        return rows, None, total, 0
    keys = sizes.where(large).select("key")
    return rows.join(keys, "key", "left_anti"), rows.join(keys, "key", "left_semi"), total - hot, hot


def _together(rows: DataFrame, size: int) -> DataFrame:
    """The rows of a conversation in one partition, in order."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // (32 << 20)))
    return rows.repartition(n, "key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "digest").select(*_ROWS)


def repair(rows: DataFrame, hot_bytes: int = HOT_BYTES) -> tuple[DataFrame, DataFrame]:
    """rows: conv_id, turn, role, text, dropped. Returns (a report of every conversation, the repaired messages by conversation
    and place; places rise with the order, and leave gaps between the chunks of a large conversation)."""
    spark = rows.sparkSession
    c.small_batches(spark)
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), said("role").alias("role"), said("text").alias("text"), F.coalesce(F.col("dropped"), F.lit(False)).alias("dropped"))
    small, large, size, hot = split(_ordered(rows), hot_bytes)
    together = _together(small, size)
    reports, messages = together.mapInArrow(_reports, REPORT), together.mapInArrow(_messages, MESSAGES)
    if large is not None:
        report, repaired = _repair_large(large, hot, hot_bytes)
        reports, messages = reports.unionByName(report), messages.unionByName(repaired)
    return reports, messages


# ---------------------------------------------------------------- large conversations

_CHUNK = "key string, conv_id bigint, chunk bigint, turns array<bigint>, roles array<string>, texts array<string>, digests array<binary>"
_FACTS = "key string, chunk bigint, symbols array<string>, faults array<int>, costs array<bigint>, turns array<bigint>, counts array<bigint>, ends array<string>"


def _pack(hot_bytes: int):
    schema = pa.schema([("key", _S), ("conv_id", _L), ("chunk", _L), ("turns", pa.list_(_L)), ("roles", pa.list_(_S)), ("texts", pa.list_(_S)), ("digests", pa.list_(pa.binary()))])

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32  # partitions are in order, and so are the chunks of one
        for conv, rows in _conversations(batches, hot_bytes):
            digests = sorted({message_digest(r, t) for _, r, t in rows})
            yield _batch([("" if conv is None else str(conv), conv, number, [t for t, _, _ in rows], [r for _, r, _ in rows], [t for _, _, t in rows], digests)], schema)
            number += 1

    return run


def _facts(batches):
    """Faults, costs from state to state and what the neighbours need, of chunks with the digests that were seen before."""
    schema = pa.schema([("key", _S), ("chunk", _L), ("symbols", pa.list_(_S)), ("faults", pa.list_(pa.int32())), ("costs", pa.list_(_L)), ("turns", pa.list_(_L)), ("counts", pa.list_(_L)), ("ends", pa.list_(_S))])
    for batch in batches:
        for r in batch.to_pylist():
            messages = list(zip(r["roles"], r["texts"]))
            faults = faults_of(messages, frozenset(r["late"] or ()))
            symbols = [initial(x) for x in r["roles"]]
            own = list(zip(symbols, faults))
            to = [backward(own, tuple(0 if g == q else FAR for g in range(len(GRAMMAR))))[0] for q in range(len(GRAMMAR))]
            turns = [t for t in r["turns"] if t is not None]
            yield _batch([(r["key"], r["chunk"], symbols, faults, [to[q][p] for p in range(len(GRAMMAR)) for q in range(len(GRAMMAR))], [turns[0], turns[-1], len(set(turns))] if turns else [], _summary(messages, faults), symbols[:1] + symbols[-1:])], schema)


def _fold_costs(table: pa.Table) -> pa.Table:
    """For the chunks of a conversation the costs behind each; and the conversation's numbers, on its first chunk."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    ahead, out = END, []
    for r in reversed(rows):
        out.append((r["key"], r["chunk"], list(ahead), r is rows[-1]))
        m = r["costs"]
        ahead = tuple(min(min(m[4 * p + q] + ahead[q] for q in range(4)), FAR) for p in range(4))
    counts = [sum(x) for x in zip(*(r["counts"] for r in rows))]
    turns = [r["turns"] for r in rows if r["turns"]]
    distinct = sum(t[2] for t in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:]))
    ends = [r["ends"] for r in rows if r["ends"]]
    counts[3] += sum(a[-1] + b[0] not in LEGAL for a, b in zip(ends, ends[1:]))
    numbers = [gaps(turns[0][0] if turns else None, turns[-1][1] if turns else None, distinct), *counts, ahead[0]]
    schema = pa.schema([("key", _S), ("chunk", _L), ("ahead", pa.list_(_L)), ("last", pa.bool_()), ("numbers", pa.list_(_L))])
    return pa.Table.from_batches([_batch([(*x, numbers if x is out[-1] else None) for x in out], schema)])


def _passage(batches):
    """Which state each state at a chunk's start leads to."""
    schema = pa.schema([("key", _S), ("chunk", _L), ("to", pa.list_(pa.int32()))])
    for batch in batches:
        for r in batch.to_pylist():
            places = backward(list(zip(r["symbols"], r["faults"])), tuple(r["ahead"]))[1]
            yield _batch([(r["key"], r["chunk"], [forward(places, p, False)[2] for p in range(len(GRAMMAR))])], schema)


def _fold_states(table: pa.Table) -> pa.Table:
    state, out = 0, []
    for r in sorted(table.to_pylist(), key=lambda r: r["chunk"]):
        out.append((r["key"], r["chunk"], state))
        state = r["to"][state]
    return pa.Table.from_batches([_batch(out, pa.schema([("key", _S), ("chunk", _L), ("start", pa.int32())]))])


def _edited(batches):
    schema = pa.schema([("key", _S), ("conv_id", _L), ("chunk", _L), ("audit", _S), ("roles", pa.list_(_S)), ("texts", pa.list_(_S))])
    for batch in batches:
        for r in batch.to_pylist():
            places = backward(list(zip(r["symbols"], r["faults"])), tuple(r["ahead"]))[1]
            labels, roles, _ = forward(places, r["start"], r["last"])
            made = rebuilt(list(zip(r["roles"], r["texts"])), labels, roles)
            yield _batch([(r["key"], r["conv_id"], r["chunk"], labels, [x for x, _ in made], [x for _, x in made])], schema)


def _digests(batches):
    """Audit and digest of conversations whose chunks come in order; texts pass through."""
    schema = pa.schema([("key", _S), ("conv_id", _L), ("audit", _S), ("repaired_sha256", _S)])
    now, conv, audit, digest, some = None, None, [], hashlib.sha256(), False
    for batch in batches:
        for r in batch.to_pylist():
            if now is not None and r["key"] != now:
                yield _batch([(now, conv, "".join(audit), digest.hexdigest())], schema)
                audit, digest, some = [], hashlib.sha256(), False
            now, conv = r["key"], r["conv_id"]
            audit.append(r["audit"])
            for role, text in zip(r["roles"], r["texts"]):
                digest.update(("\n" * some + f"{role}:{text}").encode())
                some = True
    if now is not None:
        yield _batch([(now, conv, "".join(audit), digest.hexdigest())], schema)


def _repair_large(rows: DataFrame, size: int, hot_bytes: int) -> tuple[DataFrame, DataFrame]:
    n = min(1 << 16, max(1, -(-size // hot_bytes)))
    order = ["key", F.asc_nulls_first("turn"), "digest", "salt"]  # the salt parts rows that are equal and may come in any order
    ranged = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    chunks = c.staged(ranged.select(*_ROWS).mapInArrow(_pack(hot_bytes), _CHUNK), "chunks")
    seen = chunks.select("key", "chunk", F.explode("digests").alias("digest"))
    first = seen.groupBy("key", "digest").agg(F.min("chunk").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    late = seen.join(first, ["key", "digest"]).where(F.col("chunk") > F.col("first")).groupBy("key", "chunk").agg(F.collect_list("digest").alias("late"))  # one chunk's
    facts = c.staged(chunks.drop("digests", "conv_id").join(late, ["key", "chunk"], "left").mapInArrow(_facts, _FACTS), "facts")
    ahead = c.staged(facts.select("key", "chunk", "costs", "turns", "counts", "ends").groupBy("key").applyInArrow(_fold_costs, "key string, chunk bigint, ahead array<bigint>, last boolean, numbers array<bigint>"), "ahead")
    own = facts.select("key", "chunk", "symbols", "faults").join(ahead.drop("numbers"), ["key", "chunk"])
    passage = own.mapInArrow(_passage, "key string, chunk bigint, to array<int>")
    start = c.staged(passage.groupBy("key").applyInArrow(_fold_states, "key string, chunk bigint, start int"), "starts")
    whole = chunks.select("key", "conv_id", "chunk", "roles", "texts").join(own.join(start, ["key", "chunk"]), ["key", "chunk"])
    edited = c.staged(whole.mapInArrow(_edited, "key string, conv_id bigint, chunk bigint, audit string, roles array<string>, texts array<string>"), "edited")
    c.unstage(chunks, facts, start)
    digests = edited.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_digests, "key string, conv_id bigint, audit string, repaired_sha256 string")
    numbers = ahead.where("numbers is not null").select("key", *[F.col("numbers")[i].alias(x) for i, x in enumerate(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))])
    report = digests.join(numbers, "key").select(*_REPORT.names)
    messages = edited.select("conv_id", "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "m"))
    rank = F.floor(F.col("chunk") / (1 << 32)) * (1 << 47) + F.col("chunk") % (1 << 32) * (1 << 32)
    return report, messages.select("conv_id", (rank + F.col("i")).cast("bigint").alias("place"), F.col("m.roles").alias("role"), F.col("m.texts").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every conversation, damaged by its rows' hashes and repaired: faults, cost, edits and the digest of what it becomes."""
    return repair(damage(c.read(spark, sf_dir, "conversations")))[0]


def _sql() -> str:
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    keep = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    path = lambda cost, label, g, of="v.": f"{{'c': {cost} + {of}w{g}.c, 'a': '{label}' || {of}w{g}.a}}"
    read = ", ".join(
        "list_min(list_filter([" + path(3, "D", g) + ", case when not gone then " + path("2 + late", "R", after[g]) + " end, "
        + ", ".join(f"case when not gone and letter = '{x}' then {path('late', 'K', to)} end" for x, to in keep[g]) + f"], lambda x: x is not null)) as r{g}"
        for g in range(4)
    )
    once = ", ".join(f"list_min([r{g}, {{'c': 2 + r{after[g]}.c, 'a': 'I' || r{after[g]}.a}}]) as o{g}" for g in range(4))
    twice = ", ".join(f"list_min([r{g}, {{'c': 2 + o{after[g]}.c, 'a': 'I' || o{after[g]}.a}}]) as w{g}" for g in range(4))
    return f"""with recursive crc as materialized (select list(x order by b) as t from (select b, list_reduce(list_concat([b], range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as x from range(256) as r(b))),
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
h as (select k.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)), lambda x, b: xor(t[(xor(x, b) & 255) + 1], x >> 8)), 4294967295) % 20 as h from k, crc),
d as (select conv_id, turn, case h when 4 then 'user' else role end as role, case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from (select h.*, unnest(case h when 3 then [0, 1] when 0 then [] else [0] end) as copy from h)),
m as materialized (select *, trim(text, {space}) as body, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || text)) as i from d),
f as materialized (select *, case when body = '' then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2 when right(body, 1) not in ('.', '!', '?') then 3 else 0 end as fault, left(role, 1) as letter,
lag(left(role, 1)) over (partition by conv_id order by i) as before from m),
n as materialized (select conv_id, count(*) as n, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
count(*) filter (before is not null and before || letter not in ('su', 'ua', 'au')) as illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps from f group by 1),
v as (select conv_id, n + 1 as i, {{'c': 0::bigint, 'a': ''}} as w0, {{'c': 4::bigint, 'a': 'II'}} as w1, {{'c': 2::bigint, 'a': 'I'}} as w2, {{'c': 0::bigint, 'a': ''}} as w3 from n union all
select conv_id, i, {twice} from (select *, {once} from (select f.conv_id, f.i, {read} from (select *, fault in (1, 2) as gone, (fault = 3)::bigint as late from f) f join v on f.conv_id = v.conv_id and f.i = v.i - 1))),
p as (select conv_id, w0.c as cost, w0.a as audit from v where i = 1),
e as (select conv_id, audit, unnest(string_split(audit, '')) as label, unnest(range(1, length(audit) + 1)) as place from p where audit <> ''),
o as (select conv_id, label, place, sum((label <> 'I')::int) over w as i, sum((label <> 'D')::int) over w as j, sum((label <> 'D')::int) over (partition by conv_id) % 2 as shift from e window w as (partition by conv_id order by place)),
t as (select o.conv_id, string_agg(case when label = 'K' then role when (j + shift) % 2 = 1 then 'user' else 'assistant' end || ':' || case when label = 'I' then '' else text end, chr(10) order by place) as text
from o left join f on o.conv_id = f.conv_id and o.i = f.i where label <> 'D' group by 1)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(t.text, '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join n using (conv_id) left join p using (conv_id) left join t using (conv_id)"""


SQL = _sql()
