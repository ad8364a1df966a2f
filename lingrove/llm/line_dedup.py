"""Line dedup by a suffix array over line ids (operator 1).

The corpus is the sequence of its line ids, by (doc_id, line); a document's end ends every suffix. Distributed prefix doubling ranks the
suffixes: at depth 1 by line id, and from depth h to 2h by the pair of ranks at a position and h lines on. A rank is the place of its key in a range sort,
so order is kept and no task holds more than its range. A suffix whose first h lines occur nowhere else has its place in the array and takes part no
more, so each round works on what is still repeated; it ends when nothing is.

Suffixes with one rank at depth h are a longest-common-prefix interval of h lines or more. Its first position, by (doc_id, line), is the original; each of the
others begins a later copy of h lines at least. A later copy of n lines is covered by the intervals of the largest depth h <= n at its two ends, so the deepest
intervals of all positions, joined where they overlap or touch, are the maximal repeated runs (document, first line, number of lines): ``runs``. Their lines go.

A run has ``min_lines`` lines, or is a single line of ``MIN_WORDS_ONE`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, chunks, drop_written, fresh, strings, text_buffers, word_counts, written
from .substring_dedup import NO_ID

MIN_LINES, MIN_WORDS_ONE = 2, 50


def line_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, number in its row) of every line; a line ends before its line feed, and a row has one line more than line feeds."""
    n = len(offs) - 1
    feed = np.flatnonzero(data == 10)
    of = np.searchsorted(offs, feed, "right") - 1
    many = np.bincount(of, minlength=n) + 1
    row = np.repeat(np.arange(n), many)
    first = np.cumsum(many) - many
    nth = np.arange(len(row)) - first[row]
    start, end = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    start[first], end[first + many - 1] = offs[:-1], offs[1:]
    inner = np.ones(len(row), bool)
    inner[first] = False
    start[inner] = feed + 1
    inner = np.ones(len(row), bool)
    inner[first + many - 1] = False
    end[inner] = feed
    return start, end, row, nth


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tags = np.asarray(batch.column(0)), np.asarray(batch.column(2))
        data, offs, _ = text_buffers(batch.column(1))
        for a, b in chunks(offs):
            part, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            start, end, row, nth = line_bounds(part, o)
            line = Rolling(part).spans(start, end).view(np.int64)
            long = word_counts(part, o, start, end) >= MIN_WORDS_ONE
            yield pa.RecordBatch.from_arrays([pa.array(ids[a + row]), pa.array(tags[a + row]), pa.array(nth.astype(np.int32)), pa.array(line), pa.array(long)], names=["doc", "tag", "i", "line", "long"])


def _place() -> Column:
    return F.struct("doc", "tag", "i")


def _ranked(keys: DataFrame, *cols: str) -> DataFrame:
    """``keys`` (each once) with ``rank``: increasing in the order of ``cols``; written, as ranks must not change."""
    return written(keys.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("rank", F.monotonically_increasing_id()))


def _at(h: int) -> Column:
    """The rank h lines on, where that position is still repeated."""
    return F.max("rank").over(Window.partitionBy("doc", "tag").orderBy("i").rangeBetween(h, h))


def levels(docs: DataFrame, min_lines: int = MIN_LINES) -> Iterator[tuple[int, DataFrame]]:
    """(depth, table) at depth 1, 2, 4, ... (and ``min_lines``), until no suffix is repeated.

    table: (doc, tag, i, rank, later, long) of the positions whose first ``depth`` lines occur more than once. Equal rank: the same lines; rank follows the
    order of the suffixes; ``later``: not the first position of its rank; ``i``: the line's number from 0; ``long``: one line of ``MIN_WORDS_ONE`` words (at depth 1).
    """
    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), "text", F.expr("xxhash64(text) & 2147483647").alias("tag"))
    # rows that repeat id and text give the same positions; they count once
    lines = written(rows.mapInArrow(_emit, "doc bigint, tag bigint, i int, line bigint, long boolean"))
    ids = _ranked(lines.groupBy("line").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1").select("line", "first"), "line")
    level = written(lines.join(ids, "line").select("doc", "tag", "i", "rank", (_place() != F.col("first")).alias("later"), "long").distinct())
    drop_written(lines, ids)
    depth = 1
    yield depth, level
    while not level.isEmpty():
        if depth < min_lines < 2 * depth:
            yield min_lines, _joined(level, min_lines - depth)
        level, depth = _joined(level, depth), 2 * depth
        yield depth, level


def _joined(level: DataFrame, ahead: int) -> DataFrame:
    """Positions whose rank together with the rank ``ahead`` lines on occurs more than once, ranked by the two."""
    pairs = written(level.select("doc", "tag", "i", "rank", _at(ahead).alias("next")).where("next is not null"))
    new = pairs.groupBy("rank", "next").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1").select(F.col("rank").alias("r1"), F.col("next").alias("r2"), "first")
    new = _ranked(new, "r1", "r2").withColumnRenamed("rank", "made")
    out = written(pairs.join(new, (F.col("rank") == F.col("r1")) & (F.col("next") == F.col("r2"))).select("doc", "tag", "i", F.col("made").alias("rank"), (_place() != F.col("first")).alias("later"), F.lit(False).alias("long")))
    drop_written(pairs, new)
    return out


def runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc, tag, start, length): the maximal runs of lines that are later copies."""
    every = list(levels(docs, min_lines))
    copies = None
    for depth, level in every:
        some = level.where("later" if depth >= min_lines else "later and long") if depth in (1, min_lines) or depth > min_lines else None
        if some is not None:
            some = some.select("doc", "tag", "i", F.lit(depth).alias("depth"))
            copies = some if copies is None else copies.unionByName(some)
    by = Window.partitionBy("doc", "tag").orderBy("i", F.desc("depth"))
    before = F.max(F.col("i") + F.col("depth")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    # an interval within an earlier one says nothing new; one beyond the end of all earlier ones begins a run
    new = copies.withColumn("before", before).where("before is null or i + depth > before").withColumn("run", F.count_if(F.col("before").isNull() | (F.col("i") > F.col("before"))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = written(new.groupBy("doc", "tag", "run").agg(F.min("i").alias("start"), (F.max(F.col("i") + F.col("depth")) - F.min("i")).alias("length")).select("doc", "tag", "start", "length"))
    drop_written(*(level for _, level in every))
    return out


def _remove(text: pa.Array, gone_runs: pa.Array) -> pa.Array:
    data, offs, null = text_buffers(text)
    n = len(offs) - 1
    many = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(gone_runs), 0)).astype(np.int64)
    flat, at = gone_runs.flatten(), np.r_[0, np.cumsum(many)]
    begin, length = (np.asarray(flat.field(k)).astype(np.int64) for k in range(2))
    out, size, total, removed = [], [], np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a, b in chunks(offs):
        o, part = offs[a : b + 1] - offs[a], data[offs[a] : offs[b]]
        start, end, row, _ = line_bounds(part, o)
        total[a:b] = np.bincount(row, minlength=b - a)
        first = np.searchsorted(row, np.arange(b - a))
        depth = np.zeros(len(row) + 1, np.int32)
        p = np.repeat(first, many[a:b]) + begin[at[a] : at[b]]
        np.add.at(depth, p, 1)
        np.add.at(depth, p + length[at[a] : at[b]], -1)
        gone = np.cumsum(depth)[:-1] > 0
        removed[a:b] = np.bincount(row[gone], minlength=b - a)
        if not gone.any():
            out.append(part)
            size.append(np.diff(o))
            continue
        # kept lines are joined by line feeds: a line takes the feed before it along, unless it is the first that stays
        edge = np.zeros(len(part) + 1, np.int32)
        keep = np.flatnonzero(~gone)
        lead = np.r_[True, row[keep][1:] != row[keep][:-1]] if len(keep) else np.zeros(0, bool)
        np.add.at(edge, np.where(lead, start[keep], start[keep] - 1), 1)
        np.add.at(edge, end[keep], -1)
        mask = np.cumsum(edge)[:-1] > 0
        kept = np.zeros(len(part) + 1, np.int64)
        np.cumsum(mask, out=kept[1:])
        out.append(part[mask])
        size.append(np.diff(kept[o]))
    ends = np.r_[0, np.cumsum(np.concatenate(size))] if size else np.zeros(1, np.int64)
    made = strings(text.type, np.concatenate(out) if out else np.zeros(0, np.uint8), ends, null)
    return pa.StructArray.from_arrays([made, pa.array(total, mask=null), pa.array(removed, mask=null)], ["text", "n_lines", "n_removed"])


def _cleaned(docs: DataFrame, min_lines: int) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (text, n_lines, n_removed), and its name."""
    doc, tag, gone, made = fresh(docs, "doc", "tag", "runs", "made")
    found = runs(docs.select("doc_id", "text"), min_lines).groupBy(F.col("doc").alias(doc), F.col("tag").alias(tag)).agg(F.collect_list(F.struct("start", "length")).alias(gone))
    on = (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)) == F.col(doc)) & (F.xxhash64(docs["text"]).bitwiseAND(F.lit(2147483647)) == F.col(tag))
    # said to be nondeterministic, or a filter on what it gives would run it a second time, in a second Python worker of each task
    f = F.arrow_udf(_remove, "text string, n_lines bigint, n_removed bigint").asNondeterministic()
    # a shuffle at every size: the runs grow with the documents
    return docs.join(found.hint("merge"), on, "left").withColumn(made, f(docs["text"], F.col(gone))), made


def dedup(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) for every row of ``docs``: the text without later copies of runs of ``min_lines`` or more lines, or of one line of ``MIN_WORDS_ONE`` words.

    Null text: all null. An empty text has one, empty, line. A text of which nothing is left is empty. Rows that repeat id and
    text are one document: they lose the same lines, and aren't copies of each other; rows with one id and different texts are told apart (the
    order between them is that of their texts' hashes). A null id counts as the smallest; ids are whole numbers. A text of any length is read whole, and is
    worked on as one piece. Equal lines tie by (doc_id, line). Further columns aren't read. Empty table: no rows.
    """
    found, made = _cleaned(docs.select("doc_id", "text"), min_lines)
    return found.select("doc_id", f"{made}.text", f"{made}.n_lines", f"{made}.n_removed")


def keep_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with later copies removed from ``text`` (``n_chars``, where there is one, follows); a row of which no line is left goes.

    A row whose text was null or empty before stays as it is. Rows that repeat id and text stay or go together. All columns stay, whatever their
    names. Empty table: no rows. Null ids, ties and long texts: as in ``dedup``.
    """
    found, made = _cleaned(docs, min_lines)
    found = found.where(F.col(f"{made}.n_removed").isNull() | (F.col(f"{made}.n_removed") < F.col(f"{made}.n_lines")))
    new = {"text": F.col(f"{made}.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(f"{made}.n_removed") > 0, F.length(f"{made}.text").cast("bigint")).otherwise(F.col("n_chars"))
    return found.withColumns(new).select(*docs.columns)


ORACLE = f"""
with one as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents
), runs as (
  select a.doc_id, a.i, {MIN_LINES} as n, string_agg(b.line, chr(10) order by b.i) as k
  from one a join one b on a.doc_id = b.doc_id and b.i between a.i and a.i + {MIN_LINES - 1} group by a.doc_id, a.i having count(*) = {MIN_LINES}
  union all
  select doc_id, i, 1, line from one where len(regexp_split_to_array(trim(line, ' ' || chr(9) || chr(13)), '[ \t\r]+')) >= {MIN_WORDS_ONE}
), later as (
  select doc_id, i, n from (select *, row_number() over (partition by n, k order by doc_id, i) as turn from runs) where turn > 1
), gone as (
  select distinct o.doc_id, o.i from one o join later l on o.doc_id = l.doc_id and o.i between l.i and l.i + l.n - 1
)
select o.doc_id, coalesce(string_agg(o.line, chr(10) order by o.i) filter (where g.i is null), '') as text, count(*) as n_lines, count(g.i) as n_removed
from one o left join gone g on o.doc_id = g.doc_id and o.i = g.i group by o.doc_id
"""
