"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

A document is the sequence of its lines that aren't blank (lines are compared without surrounding blanks). Every line has
a place: a number that rises in text order, by one inside a document, with a gap after each document. Suffixes are ranked by their
first line, then by two, four ... lines: the rank of 2h lines is the rank of the pair (rank of h lines here, rank of h
lines h places on), in sorted order. Suffixes whose prefix occurs once leave at once, for no longer prefix of theirs can repeat;
doubling goes on until no rank repeats. The suffixes of one rank are the LCP interval of that depth. Ranking is a sum by
pair first, which also finds the interval's first place, so a hot line is one row before anything is sorted, then a range
sort of the distinct pairs; the ranks go back by an equi-join that adaptive execution splits where it's skewed.

In the intervals of depth ``min_run`` every suffix but the first in text order begins a later copy. How far the copy goes is its longest
common prefix with the interval's first suffix, found by descending through the ranks from the deepest to the
single line: where both have the same rank, the prefix grows by its depth. These lines are deleted; runs that don't lie in another one
are the maximal repeated runs, and their number and the longest are returned. A line of more than ``long_line`` words is a
run by itself: its copies are found by its rank of one line, and all but the first are deleted too, so only short
recurring lines may stand alone again. The first copy of a line is never deleted. Documents with equal texts are ranked
once: all but the first lose every line of theirs, if they have min_run, or else their long lines. Words are what blanks part.

Text order: by doc_id, null last, then by text, then by line. Rows with the same id and text are the same document and
keep or lose the same lines. A null text has no lines and stays null. Lines are known by two 64-bit hashes.
Extra columns pass through; columns called n_lines, n_removed, n_runs and longest_run give
way to the results.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

MIN_RUN = 2
#: A line of more words than this is a run, whatever min_run is.
LONG_LINE = 50
BLANKS = " \t\r\x0b\x0c"
LAST = (1 << 63) - 1
RESULTS = ("n_lines", "n_removed", "n_runs", "longest_run")


def _hashes(col) -> list[F.Column]:
    return [F.xxhash64(col), F.xxhash64(F.lit("second"), col)]


def _ranked(suffixes: DataFrame, by: list[str]) -> DataFrame | None:
    """suffixes whose ``by`` columns occur more than once, with their rank in the order of these columns instead of them,
    and the first place of that rank. None if there are none."""
    classes = suffixes.groupBy(*by).agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1").drop("n")
    order = classes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())
    order = c.staged(order, "line-ranks")  # ids that depend on the partition are fixed by writing them
    return None if order.isEmpty() else c.staged(suffixes.drop("first").join(order, by).drop(*by), "line-suffixes")


def _pairs(ranks: DataFrame, step: int) -> DataFrame:
    """Suffixes whose rank is known here (a) and step places on (b)."""
    ahead = ranks.select((F.col("place") - step).alias("place"), F.col("rank").alias("b"))
    return ranks.select("place", "doc", F.col("rank").alias("a")).join(ahead, "place")


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """place, doc, rank, first (and long at depth 1): for the depths 1, 2, 4 ... the suffixes with a repeated prefix.

    lines: place, doc (the place of the document's first line), a, b (two hashes of the line), long.
    """
    levels, level = [], _ranked(lines, ["a", "b"])
    while level is not None:
        levels.append(level)
        level = _ranked(_pairs(level, 1 << (len(levels) - 1)), ["a", "b"])
    return levels


def repeated_runs(lines: DataFrame, min_run: int) -> DataFrame:
    """doc, place, first, length: every place where min_run lines, or one long line, begin that also stand earlier (at first).

    length: of the longest common prefix of the suffixes at place and first; 1 for long lines.
    """
    levels = suffix_ranks(lines)
    runs = None
    if (below := min_run.bit_length() - 1) < len(levels):  # the deepest level of at most min_run lines
        base = levels[below]
        if 1 << below < min_run:
            base = _ranked(_pairs(base, min_run - (1 << below)), ["a", "b"])
        if base is not None:
            runs = base.where("place > first").select("doc", "place", "first", F.lit(min_run).cast("bigint").alias("length"))
            for depth, level in reversed(list(enumerate(levels))):
                here = level.select(F.col("place").alias("x"), F.col("rank").alias("r"))
                there = level.select(F.col("place").alias("y"), F.col("rank").alias("s"))
                runs = runs.join(here, F.col("place") + F.col("length") == F.col("x"), "left").join(there, F.col("first") + F.col("length") == F.col("y"), "left")
                runs = runs.select("doc", "place", "first", (F.col("length") + F.when(F.col("r") == F.col("s"), 1 << depth).otherwise(0)).alias("length"))
    none = lines.limit(0).select("doc", "place", F.col("place").alias("first"), F.lit(1).cast("bigint").alias("length"))
    alone = levels[0].where("long and place > first").select("doc", "place", "first", F.lit(1).cast("bigint").alias("length")) if levels else none
    out = c.staged(alone if runs is None else runs.unionByName(alone), "line-runs")
    c.unstage(*levels)
    return out


def _cut(min_run: int, long_line: int):
    blanks = re.compile(f"[{BLANKS}]+")

    def clean(text: str | None, runs: list | None, copy: bool) -> tuple[str | None, int, int, int, int]:
        if text is None:
            return None, 0, 0, 0, 0
        lines = text.split("\n")
        real = [i for i, x in enumerate(lines) if x.strip(BLANKS)]
        if copy and len(real) >= min_run:
            found = [(0, len(real))]
        else:
            found = [(r["at"], r["length"]) for r in runs or ()]
            if copy:
                found += [(k, 1) for k, i in enumerate(real) if len(blanks.split(lines[i].strip(BLANKS))) > long_line]
        gone, many, longest, end = set(), 0, 0, 0
        for at, length in sorted(found, key=lambda r: (r[0], -r[1])):
            if at + length > end:  # not inside a run before
                many, longest = many + 1, max(longest, length)
                gone.update(real[max(at, end) : at + length])
                end = at + length
        return ("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text), len(real), len(gone), many, longest

    def run(batches):
        for b in batches:
            get = lambda n: b.column(b.schema.get_field_index(n))
            rows = [clean(*x) for x in zip(get("text").to_pylist(), get("runs").to_pylist(), get("copy").to_pylist())]
            text, *numbers = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([get("row"), pa.array(text, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], ["row", "text", *RESULTS])

    return run


def dedup_lines(docs: DataFrame, min_run: int = MIN_RUN, long_line: int = LONG_LINE) -> DataFrame:
    """docs (doc_id, text and any other columns) with repeated line runs cut from text, and n_lines, n_removed, n_runs (maximal
    repeated runs) and longest_run (lines)."""
    if min_run < 1 or long_line < 0:
        raise ValueError("min_run must be 1 or more, long_line 0 or more")
    docs = docs.drop(*RESULTS).withColumn("text", F.col("text").cast("string"))
    row = docs.select(F.col("doc_id").cast("bigint").alias("own_id"), "text", F.struct(*[x for x in docs.columns if x != "text"]).alias("row"))
    t1, t2 = _hashes("text")
    keyed = row.select("row", "text", t1.alias("t1"), t2.alias("t2"), F.coalesce("own_id", F.lit(LAST)).alias("key"))
    long = lambda x: (F.length(x) > 2 * long_line) & (F.size(F.split(x, f"[{BLANKS}]+")) > long_line)
    lines = F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != ""), lambda x: F.struct(_hashes(x)[0].alias("a"), _hashes(x)[1].alias("b"), long(x).alias("long")))
    texts = keyed.where("text is not null").select("t1", "t2", "key", lines.alias("lines")).groupBy("t1", "t2").agg(F.min("key").alias("key"), F.max("key").alias("most"), F.first("lines").alias("lines"))
    ends = F.array_append("lines", F.lit(None).cast(texts.schema["lines"].dataType.elementType))  # the gap after a document
    placed = texts.repartitionByRange("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2").select("t1", "t2", "key", "most", F.posexplode(ends).alias("at", "line"))
    placed = placed.withColumn("place", F.monotonically_increasing_id()).where("line is not null")
    placed = c.staged(placed.select("place", (F.col("place") - F.col("at")).alias("doc"), "line.a", "line.b", "line.long", "t1", "t2", "key", "most"), "line-places")
    runs = repeated_runs(placed.select("place", "doc", "a", "b", "long"), min_run).groupBy("doc").agg(F.collect_list(F.struct((F.col("place") - F.col("doc")).alias("at"), "length")).alias("runs"))
    heads = placed.where("place = doc").select("doc", "t1", "t2", "key", "most")
    marks = heads.join(runs, "doc", "left").where("runs is not null or most > key").select("t1", "t2", "runs", F.when(F.col("most") > F.col("key"), F.col("key")).alias("head"))
    joined = keyed.join(marks, ["t1", "t2"], "left").select("row", "text", "runs", F.coalesce(F.col("key") > F.col("head"), F.lit(False)).alias("copy"))
    schema = T.StructType([joined.schema["row"], joined.schema["text"], *(T.StructField(x, T.LongType()) for x in RESULTS)])
    out = c.map_batches(joined, _cut(min_run, long_line), schema)
    return out.select(*["text" if x == "text" else F.col("row")[x].alias(x) for x in docs.columns], *RESULTS)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: what line dedup removes from every document, its maximal repeated runs, and the text it leaves."""
    out = dedup_lines(c.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *RESULTS, F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
with raw as (select doc_id, text, string_split(text, chr(10)) as all_lines from documents),
v as (select doc_id, i as at_raw, all_lines[i] as line, trim(all_lines[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as x from raw, unnest(range(1, len(all_lines) + 1)) t(i)),
real as (select *, row_number() over (partition by doc_id order by at_raw) - 1 as place from v where x <> ''),
d as (select doc_id, list(x order by place) as w from real group by 1),
e as (select *, min(doc_id) over (partition by text) as head from raw where text is not null),
g as (select doc_id, i - 1 as place, w[i] || chr(10) || w[i + 1] as k from d, unnest(range(1, len(w))) t(i)),
f as (select k, min(struct_pack(doc := doc_id, place := place)) as first from g group by 1),
q as (select g.doc_id, g.place, first.doc as fd, first.place as fa from g join f using (k) where (first.doc, first.place) <> (g.doc_id, g.place)),
lcp as (select q.doc_id, q.place, list_transform(range(1, len(a.w) - q.place + 1), lambda k: a.w[q.place + k] = b.w[q.fa + k] and q.fa + k <= len(b.w)) as same from q join d a on a.doc_id = q.doc_id join d b on b.doc_id = q.fd),
long as (select doc_id, place, x, min(struct_pack(doc := doc_id, place := place)) over (partition by x) as first from real where len(regexp_split_to_array(x, '[ \t\r\x0B\x0C]+')) > 50),
run as (select doc_id, place, coalesce(list_position(same, false) - 1, len(same)) as length from lcp
        union all select doc_id, place, 1 from long where (first.doc, first.place) <> (doc_id, place)),
own as (select run.* from run join e using (doc_id) where not (e.head < e.doc_id and len((select w from d where d.doc_id = e.doc_id)) >= 2)
        union all select e.doc_id, 0, len(d.w) from e join d using (doc_id) where e.head < e.doc_id and len(d.w) >= 2),
o as (select *, coalesce(max(place + length) over (partition by doc_id order by place, length desc rows between unbounded preceding and 1 preceding), 0) as before from own),
s as (select doc_id, count(*) as n_runs, max(length) as longest_run from o where place + length > before group by 1),
gone as (select distinct doc_id, unnest(range(place, place + length)) as place from own),
c as (select doc_id, count(*) as n_removed from gone group by 1),
cut as (select v.doc_id, string_agg(v.line, chr(10) order by v.at_raw) as kept from v left join real using (doc_id, at_raw) where not exists (select 1 from gone where gone.doc_id = v.doc_id and gone.place = real.place) group by 1)
select raw.doc_id, coalesce(len(d.w), 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_runs, 0)::bigint as n_runs, coalesce(longest_run, 0)::bigint as longest_run,
       case when raw.text is null then null when n_removed is null then sha256(raw.text) else sha256(coalesce(kept, '')) end as kept_sha256
from raw left join d using (doc_id) left join c using (doc_id) left join s using (doc_id) left join cut using (doc_id)
"""
