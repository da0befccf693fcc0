"""Quality rules: how far a document's character classes and common words are from those of its language.

Over all documents of a language, the `common` most frequent words (of equal ones, the first in byte order) are counted, and the
median share of each character class, in thousandths, is found; these are its reference. Medians and not sums of characters,
which a few long documents of junk would move. A document's own histograms are compared with it by Jensen-Shannon distance
(base 2, so 0 to 1): classes where it has `min_chars` characters, common words and the rest where it has `min_words` words. A
document passes a rule that its length keeps from being judged, since a short text is far from any reference by chance.

Words are runs of letters and digits in ASCII lower case; bytes of other characters are letters. Documents without a word,
nulls among them, are rejected; rows without doc_id are left out. A null lang is a language of its own. Rows that repeat a
doc_id are judged each and count as one document by the worst of them. Columns besides doc_id, text and lang are ignored. An
empty table gives no rows. The reference holds a few hundred words a language; Spark broadcasts it where its size allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindlegraph.llm.shared import staged, text_chunks
from spindlegraph.llm.words import LOWER, NOT_ALNUM, raw, words

#: lower, upper, digit, space, stop, cry, other ASCII, not ASCII; 8 goes uncounted (a character's further bytes).
CLASSES = 8
CLASS = np.array([0 if 97 <= b < 123 else 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 3 if b in (9, 10, 11, 12, 13, 32) else 4 if chr(b) in ".,;:'\"-()" else 5 if chr(b) in "!?" else 6 if b < 128 else 8 if b < 192 else 7 for b in range(256)])
HELD = 500_000


def classes(texts: pa.Array) -> np.ndarray:
    """Characters of each class in each text."""
    data, at = raw(texts)
    n = len(at) - 1
    row = np.repeat(np.arange(n) * (CLASSES + 1), np.diff(at))
    return np.bincount(row + CLASS[data], minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1)[:, :CLASSES]


def _groups(column: pa.Array) -> Iterator[tuple[str | None, np.ndarray]]:
    coded = column.dictionary_encode(null_encoding="encode")
    at = np.asarray(coded.indices)
    for k, value in enumerate(coded.dictionary.to_pylist()):
        yield value, np.flatnonzero(at == k)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, word, step, n): n documents with step thousandths of class kind, or with kind -1 n times the word; words are summed up until HELD of them are held."""
    names = ["lang", "kind", "word", "step", "n"]
    held: dict[str | None, tuple[np.ndarray, np.ndarray, list[bytes]]] = {}

    def emit():
        for lang, (_, n, text) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), -1, np.int32)), pa.array(text, pa.binary()).cast(pa.string()), pa.nulls(len(n), pa.int32()), pa.array(n)], names=names)
        held.clear()

    for chunk in text_chunks(batches):
        by_class, w = classes(chunk.column(1)), words(chunk.column(1), LOWER, NOT_ALNUM)
        for lang, rows in _groups(chunk.column(0)):
            own = by_class[rows]
            own = own[own.sum(1) > 0]
            step, n = np.unique(np.arange(CLASSES) * 1001 + 1000 * own // own.sum(1, keepdims=True), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array((step // 1001).astype(np.int32)), pa.nulls(len(n), pa.string()), pa.array((step % 1001).astype(np.int32)), pa.array(n)], names=names)
            inside = np.zeros(len(by_class), bool)
            inside[rows] = True
            at = np.flatnonzero(inside[w.row])
            h, first, n = np.unique(w.hash[at], return_index=True, return_counts=True)
            at = at[first]
            known, total, text = held.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64), []))
            k = np.searchsorted(known, h)
            old = known[np.minimum(k, len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
            total[k[old]] += n[old]
            fresh = np.flatnonzero(~old)
            some = w.data.tobytes() if len(fresh) else b""
            both = np.concatenate([known, h[fresh]])
            by = np.argsort(both)
            more = text + [some[a:b] for a, b in zip(w.start[at[fresh]].tolist(), w.end[at[fresh]].tolist())]
            held[lang] = both[by], np.concatenate([total, n[fresh]])[by], [more[i] for i in by.tolist()]
        if sum(len(x[0]) for x in held.values()) > HELD:
            yield from emit()
    yield from emit()


def references(docs: DataFrame, common: int = 50) -> DataFrame:
    """(lang, words, counts, total, chars) of each language: its common words, how often each is there, the number of all words, and the share of each character class."""
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sums = staged(texts.mapInArrow(_survey, "lang string, kind int, word string, step int, n long").groupBy("lang", "kind", "word", "step").agg(F.sum("n").alias("n")))
    top = sums.where("kind = -1").withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("nth") <= common)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("nth", "word", "n"))).alias("t")).select(F.col("lang").alias("l"), F.col("t.word").alias("words"), F.col("t.n").alias("counts"))
    total = sums.where("kind = -1").groupBy("lang").agg(F.sum("n").alias("total"))
    of_class = Window.partitionBy("lang", "kind")
    half = sums.where("kind >= 0").withColumn("up_to", F.sum("n").over(of_class.orderBy("step"))).withColumn("all", F.sum("n").over(of_class)).where("2 * up_to >= all")
    median = half.groupBy("lang", "kind").agg(F.min("step").alias("step"))
    chars = median.groupBy(F.col("lang").alias("m")).agg(F.sort_array(F.collect_list(F.struct("kind", "step"))).alias("c")).select("m", F.col("c.step").alias("chars"))
    both = chars.join(total, F.col("lang").eqNullSafe(F.col("m")), "left").join(top, F.col("l").eqNullSafe(F.col("m")), "left")
    return staged(both.select(F.col("m").alias("lang"), "words", "counts", "total", "chars"))


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts from the reference counts; 0 for rows without any."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    q = reference / max(1, reference.sum())
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(1)
    return np.where(counts.sum(1) > 0, np.sqrt(np.maximum(0, (part(p) + part(np.broadcast_to(q, p.shape))) / 2)), 0)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batches):
        by_class, w = classes(chunk.column(1)), words(chunk.column(1), LOWER, NOT_ALNUM)
        n, at = chunk.num_rows, [chunk.schema.get_field_index(c) for c in ("lang", "words", "counts", "total", "chars")]
        d_class, d_word = np.zeros(n), np.zeros(n)
        for _, rows in _groups(chunk.column(at[0])):
            ref = [chunk.column(i)[int(rows[0])].as_py() for i in at[1:]]
            if ref[3]:
                d_class[rows] = distance(by_class[rows], np.array(ref[3]))
            if not ref[0]:
                continue
            h = words(pa.array(ref[0])).hash
            by, size = np.argsort(h), len(h) + 1
            k = np.minimum(np.searchsorted(h[by], w.hash), len(h) - 1)
            column = np.where(h[by][k] == w.hash, by[k], size - 1)
            inside = np.full(n, -1)
            inside[rows] = np.arange(len(rows))
            own = inside[w.row] >= 0
            found = np.bincount(inside[w.row[own]] * size + column[own], minlength=len(rows) * size).reshape(-1, size)
            d_word[rows] = distance(found, np.array([*ref[1], ref[2] - sum(ref[1])]))
        yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(w.count.astype(np.int64)), pa.array(by_class.sum(1).astype(np.int64)), pa.array(d_class), pa.array(d_word)], names=["doc_id", "n_words", "chars", "class_distance", "word_distance"])


def distances(docs: DataFrame, common: int = 50) -> DataFrame:
    """(doc_id, n_words, chars, class_distance, word_distance) of every row."""
    ref = references(docs, common).withColumnRenamed("lang", "l")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.join(ref, F.col("lang").eqNullSafe(F.col("l")), "left").drop("l").mapInArrow(_judge, "doc_id long, n_words long, chars long, class_distance double, word_distance double")


def passing(docs: DataFrame, common: int = 50, max_class: float = 0.2, max_word: float = 0.4, min_chars: int = 300, min_words: int = 100) -> DataFrame:
    """(doc_id, class_distance, word_distance) of the documents that pass; a distance that isn't judged is null."""
    d = distances(docs, common)
    judged = d.select("doc_id", "n_words", F.when(F.col("chars") >= min_chars, F.round("class_distance", 6)).alias("c"), F.when(F.col("n_words") >= min_words, F.round("word_distance", 6)).alias("w"))
    worst = judged.groupBy("doc_id").agg(F.min("n_words").alias("n"), F.max("c").alias("class_distance"), F.max("w").alias("word_distance"))
    return worst.where(f"n > 0 and coalesce(class_distance, 0) <= {max_class} and coalesce(word_distance, 0) <= {max_word}").drop("n")


_SYMBOLS = {0: "[a-z]", 1: "[A-Z]", 2: "[0-9]", 3: "[ \\t\\n\\x0B\\f\\r]", 4: "[.,;:''\"()-]", 5: "[!?]", 7: "[^\\x00-\\x7F]"}
_COUNTS = ", ".join(f"len(regexp_replace(text, '{'[^' + x[1:] if x[1] != '^' else '[' + x[2:]}', '', 'g')) as c{k}" for k, x in _SYMBOLS.items())
_JS = "sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: (case when z[1] > 0 then z[1] * log2(2 * z[1] / (z[1] + z[2])) else 0 end + case when z[2] > 0 then z[2] * log2(2 * z[2] / (z[1] + z[2])) else 0 end) / 2))))"
PASSING_SQL = f"""
with t as (select row_number() over () as id, doc_id, lang, coalesce(text, '') as text from documents where doc_id is not null),
c as (select id, doc_id, lang, len(text) as n, {_COUNTS} from t),
v as (select id, doc_id, lang, [c0, c1, c2, c3, c4, c5, n - c0 - c1 - c2 - c3 - c4 - c5 - c7, c7] as v, n from c),
st as (select lang, k, (1000 * v[k]) // n as step, count(*) as n from v, range(1, 9) as ks(k) where n > 0 group by all),
mc as (select *, sum(n) over (partition by lang, k order by step) as up_to, sum(n) over (partition by lang, k) as total from st),
md as (select lang, k, min(step) as step from mc where 2 * up_to >= total group by lang, k),
cv as (select lang, list(step order by k) as r, sum(step) as rn from md group by lang),
w as (select id, lang, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) as word from t),
f as (select lang, word, count(*) as n from w group by all),
k as (select *, row_number() over (partition by lang order by n desc, word) as nth from f),
ft as (select lang, sum(n) as total from f group by lang),
top as (select lang, word, n, nth from k where nth <= 50),
d as (select id, lang, count(*) as n from w group by all),
o as (select w.id, top.nth, count(*) as n from w join top on w.word = top.word and w.lang is not distinct from top.lang group by all),
full_ as (select d.id, d.lang, d.n as dn, top.nth, top.n as rn, coalesce(o.n, 0) as n from d join top on d.lang is not distinct from top.lang left join o on o.id = d.id and o.nth = top.nth),
h as (select id, any_value(dn) as dn, list(n order by nth) || [any_value(dn) - sum(n)] as p, list(full_.rn order by nth) || [any_value(ft.total) - sum(full_.rn)] as q, any_value(ft.total) as total from full_ join ft on ft.lang is not distinct from full_.lang group by id),
wd as (select id, dn, {_JS.format(p='list_transform(p, lambda x: x / dn)', q='list_transform(q, lambda x: x / total)')} as dist from h),
cd as (select v.id, v.doc_id, v.n, {_JS.format(p='list_transform(v.v, lambda x: x / v.n)', q='list_transform(cv.r, lambda x: x / cv.rn)')} as dist from v join cv on v.lang is not distinct from cv.lang where v.n > 0),
j as (select t.doc_id, coalesce(wd.dn, 0) as n, case when cd.n >= 300 then round(cd.dist, 6) end as c, case when wd.dn >= 100 then round(wd.dist, 6) end as w from t left join cd on cd.id = t.id left join wd on wd.id = t.id),
x as (select doc_id, min(n) as n, max(c) as class_distance, max(w) as word_distance from j group by doc_id)
select doc_id, class_distance, word_distance from x where n > 0 and coalesce(class_distance, 0) <= 0.2 and coalesce(word_distance, 0) <= 0.4
"""
