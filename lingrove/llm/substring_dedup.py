"""Substring dedup by sliding sentence spans (operator 5).

A sentence ends after . ! or ? before white space, or at a line end. A *span* is a run of consecutive sentences that is just long enough:
at least ``MIN_SENTENCES`` sentences with ``MIN_WORDS`` words, or ``MIN_WORDS_ONE`` words whatever the number of sentences. Every shortest
such run that begins with a sentence and every shortest such run that ends with one is hashed, so the spans inside a repeated passage cover all of its sentences. Spans are
joined globally by hash; a sentence covered by any span that isn't the first of its hash, by (doc_id, place), goes.

One shuffle carries the spans (29 bytes each). Within a batch only the first span of a hash needs the global look, as the others are later
copies already; these go along under a key of their own. So a span that a million documents share is a row per batch, not a million rows, at
one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, Rolling, _powers, chunks, mix, strings, text_buffers

MIN_SENTENCES, MIN_WORDS, MIN_WORDS_ONE = 2, 25, 50
NO_ID = -(1 << 63)  # stands for a null id, which so comes first

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


class Sentences:
    """The sentences of the rows of a byte buffer: ``first``/``last`` (end) of their words, ``piece`` (start; the next one's start ends it), ``row``, ``words``."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        n = len(data)
        full = np.zeros(n + 2, np.int8)
        full[1:-1] = ~_SPACE[data]
        edge = np.diff(full)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        inner = np.unique(offs[1:-1])
        inner = inner[(inner > 0) & (inner < n)]
        cut = inner[(full[inner] == 1) & (full[inner + 1] == 1)]
        if len(cut):
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        row = np.searchsorted(offs, start, "right") - 1
        lines = np.zeros(n + 1, np.int32)
        np.cumsum(data == 10, out=lines[1:])
        new = np.ones(len(start), bool)
        if len(start):
            new[1:] = (row[1:] != row[:-1]) | _STOP[data[end[:-1] - 1]] | (lines[start[1:]] > lines[end[:-1]])
        at = np.flatnonzero(new)
        self.row = row[at]
        self.first = start[at]
        self.last = end[np.r_[at[1:] - 1, len(end) - 1]] if len(at) else end
        self.words = np.diff(np.r_[at, len(start)])
        begins = np.r_[True, self.row[1:] != self.row[:-1]] if len(at) else np.zeros(0, bool)
        self.piece = np.where(begins, offs[self.row], self.first)
        self.begin = np.searchsorted(self.row, np.arange(len(offs) - 1))  # of each row's sentences
        self.end = np.searchsorted(self.row, np.arange(len(offs) - 1), "right")


def spans(data: np.ndarray, offs: np.ndarray, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, min_words_one: int = MIN_WORDS_ONE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place of the first sentence in its row, sentences, hash) of every span."""
    s = Sentences(data, offs)
    n = len(s.row)
    if not n:
        return s.row, s.row, s.row, np.zeros(0, U)
    h = Rolling(data).spans(s.first, s.last)
    pw, inv = _powers(n + 1)
    run = np.zeros(n + 1, U)
    np.cumsum(h * pw[:n], out=run[1:])
    words = np.r_[0, np.cumsum(s.words)]
    i = np.arange(n)
    ahead = np.minimum(np.maximum(np.searchsorted(words, words[i] + min_words), i + min_sentences), np.searchsorted(words, words[i] + min_words_one))
    ok = ahead <= s.end[s.row]
    j = np.arange(1, n + 1)
    back = np.maximum(np.minimum(np.searchsorted(words, words[j] - min_words, "right") - 1, j - min_sentences), np.searchsorted(words, words[j] - min_words_one, "right") - 1)
    ok2 = back >= s.begin[s.row]
    both = np.unique(np.concatenate([(i[ok] << 31) | (ahead[ok] - i[ok]), (back[ok2] << 31) | (j[ok2] - back[ok2])]))
    i, size = both >> 31, both & (1 << 31) - 1
    value = mix((run[i + size] - run[i]) * inv[i] + size.astype(U) * U(0x9FB21C651E98DF25))
    return s.row[i], i - s.begin[s.row[i]], size, value


def _emit(min_sentences: int, min_words: int, min_words_one: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            data, offs, _ = text_buffers(batch.column(1))
            doc, tag, where, value = [], [], [], []
            for a, b in chunks(offs):
                row, place, size, h = spans(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], min_sentences, min_words, min_words_one)
                doc.append(ids[a + row])
                tag.append(tags[a + row])
                where.append((place << 31) | size)
                value.append(h)
            if not doc:
                continue
            doc, tag, where, value = np.concatenate(doc), np.concatenate(tag), np.concatenate(where), np.concatenate(value).view(np.int64)
            order = np.lexsort((where, tag, doc, value))
            doc, tag, where, value = doc[order], tag[order], where[order], value[order]
            head = np.r_[True, value[1:] != value[:-1]] if len(value) else np.zeros(0, bool)
            lead = np.flatnonzero(head)[np.cumsum(head) - 1]
            later = (doc != doc[lead]) | (tag != tag[lead]) | (where != where[lead])  # a repeated row is the same place
            key = np.where(later, mix((doc ^ (where + tag) * 0x5851F42D).view(U)).view(np.int64), value)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(tag.astype(np.int32)), pa.array(where), pa.array(later)], names=["k", "doc", "tag", "place", "later"])

    return run


def repeated(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, min_words_one: int = MIN_WORDS_ONE) -> DataFrame:
    """(doc, tag, places): by document the spans that aren't the first of their hash; a place holds the first sentence and the number of them."""
    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), "text", F.expr("xxhash64(text) & 2147483647").alias("tag"))
    found = rows.mapInArrow(_emit(min_sentences, min_words, min_words_one), "k bigint, doc bigint, tag int, place bigint, later boolean")
    turn = F.rank().over(Window.partitionBy("k").orderBy("doc", "tag", "place"))
    gone = found.withColumn("turn", turn).where("later or turn > 1")
    return gone.groupBy("doc", "tag").agg(F.collect_list("place").alias("places"))


def _remove(text: pa.Array, places: pa.Array) -> pa.Array:
    data, offs, null = text_buffers(text)
    n = len(offs) - 1
    many = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(places), 0)).astype(np.int64)
    flat = np.asarray(places.flatten()).astype(np.int64)
    at = np.r_[0, np.cumsum(many)]
    out, size, total, removed = [], [], np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a, b in chunks(offs):
        o = offs[a : b + 1] - offs[a]
        part = data[offs[a] : offs[b]]
        s = Sentences(part, o)
        total[a:b] = s.end - s.begin
        if at[a] == at[b]:
            out.append(part)
            size.append(np.diff(o))
            continue
        p = flat[at[a] : at[b]]
        first = s.begin[np.repeat(np.arange(b - a), many[a:b])] + (p >> 31)
        depth = np.zeros(len(s.row) + 1, np.int32)
        np.add.at(depth, first, 1)
        np.add.at(depth, first + (p & (1 << 31) - 1), -1)
        gone = np.cumsum(depth)[:-1] > 0
        removed[a:b] = np.bincount(s.row[gone], minlength=b - a)
        stop = np.r_[s.piece[1:], len(part)]  # a row without a sentence is left as it is: its bytes belong to no piece
        stop = np.minimum(stop, o[1:][s.row])
        edge = np.zeros(len(part) + 1, np.int32)
        np.add.at(edge, s.piece[gone], 1)
        np.add.at(edge, stop[gone], -1)
        keep = np.cumsum(edge)[:-1] == 0
        kept = np.zeros(len(part) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        out.append(part[keep])
        size.append(np.diff(kept[o]))
    flat_out = np.concatenate(out).tobytes() if out else b""
    ends = np.r_[0, np.cumsum(np.concatenate(size))] if size else np.zeros(1, np.int64)
    made = strings(text.type, np.frombuffer(flat_out, np.uint8), ends, null)
    return pa.StructArray.from_arrays([made, pa.array(total, mask=null), pa.array(removed, mask=null)], ["text", "n_sentences", "n_removed"])


def _cleaned(docs: DataFrame, *limits: int) -> DataFrame:
    """docs: (doc_id, text)."""
    gone = repeated(docs, *limits).select(F.col("doc").alias("_lr_doc"), F.col("tag").alias("_lr_tag"), F.col("places").alias("_lr_places"))
    on = (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)) == F.col("_lr_doc")) & (F.xxhash64(docs["text"]).bitwiseAND(F.lit(2147483647)) == F.col("_lr_tag"))
    f = F.arrow_udf(_remove, "text string, n_sentences bigint, n_removed bigint")
    # a shuffle at every size: what is repeated grows with the documents
    return docs.join(gone.hint("merge"), on, "left").withColumn("_lr_made", f(docs["text"], F.col("_lr_places")))


def dedup(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, min_words_one: int = MIN_WORDS_ONE) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed) for every row of ``docs``: the text without the repeated sentences.

    A sentence goes with the white space after it. Null text: all null. Empty or blank text: as it is, 0 sentences. A text of which nothing is
    left is empty. Rows that repeat id and text are one document: both lose the same. Rows with one id and different texts are told apart. A null id counts as the
    smallest; ids are whole numbers. Equal spans tie by (doc_id, place). A text of any length, with any number of sentences, is read whole. Further columns aren't read, so their names can't clash. Empty table: no rows.
    """
    return _cleaned(docs.select("doc_id", "text"), min_sentences, min_words, min_words_one).select("doc_id", "_lr_made.text", "_lr_made.n_sentences", "_lr_made.n_removed")


_BREAK = "([.!?][ \\t\\n\\r]+|[ \\t\\r]*\\n[ \\t\\n\\r]*)"
ORACLE = f"""
with pieces as (
  select doc_id, text, string_split(regexp_replace(text, '{_BREAK}', '\\1' || chr(1), 'g'), chr(1)) as p from documents
), one as (
  select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as i from pieces
), real as (
  select doc_id, piece, cast(row_number() over (partition by doc_id order by i) as int) as i,
         trim(piece, ' ' || chr(9) || chr(10) || chr(13)) as core
  from one where trim(piece, ' ' || chr(9) || chr(10) || chr(13)) <> ''
), counted as (
  select *, length(regexp_replace(core, '[^ \\t\\n\\r]+', '', 'g')) as blanks,
         len(regexp_split_to_array(core, '[ \\t\\n\\r]+')) as w from real
), runs as (
  select a.doc_id, a.i as s, b.i as e, sum(b.w) over (partition by a.doc_id, a.i order by b.i) as words, a.w as w_first, b.w as w_last
  from counted a join counted b on a.doc_id = b.doc_id and b.i between a.i and a.i + {MIN_WORDS_ONE}
), good as (
  select *, (words >= {MIN_WORDS} and e - s + 1 >= {MIN_SENTENCES}) or words >= {MIN_WORDS_ONE} as ok,
         (words - w_last >= {MIN_WORDS} and e - s >= {MIN_SENTENCES}) or words - w_last >= {MIN_WORDS_ONE} as ok_without_last,
         (words - w_first >= {MIN_WORDS} and e - s >= {MIN_SENTENCES}) or words - w_first >= {MIN_WORDS_ONE} as ok_without_first
  from runs
), spans as (
  select doc_id, s, e from good where ok and (not ok_without_last or not ok_without_first)
), keyed as (
  select x.doc_id, x.s, x.e, string_agg(c.core, chr(1) order by c.i) as k
  from spans x join counted c on c.doc_id = x.doc_id and c.i between x.s and x.e group by all
), later as (
  select doc_id, s, e from (select *, row_number() over (partition by k order by doc_id, s) as turn from keyed) where turn > 1
), gone as (
  select distinct c.doc_id, c.i from counted c join later l on c.doc_id = l.doc_id and c.i between l.s and l.e
), made as (
  select r.doc_id, coalesce(string_agg(r.piece, '' order by r.i) filter (where g.i is null), '') as text, count(*) as n_sentences, count(g.i) as n_removed
  from real r left join gone g on r.doc_id = g.doc_id and r.i = g.i group by r.doc_id
)
select d.doc_id, coalesce(m.text, d.text) as text, coalesce(m.n_sentences, 0) as n_sentences, coalesce(m.n_removed, 0) as n_removed
from documents d left join made m on d.doc_id = m.doc_id
"""
