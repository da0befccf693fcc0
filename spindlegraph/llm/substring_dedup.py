"""Passages of `window` words or more that occur in more than one document, found with an FM-index per shard.

Each run of `window` words holds a sampled k-gram, the first of its least hashes, so two documents that share a run share that
gram. Grams that two different texts have choose, wherever they occur, a segment of the runs that they are sampled from; all
segments of one gram go to one shard. A shard indexes its segments and streams each of them against the index: backward search gives the
matching statistics, and places where they reach `window` are reported. So the work follows the input, and no passage is lost.
Texts that are equal word for word are one text there, and wholly repeated.

Words are runs without ASCII white space. Nulls count as empty texts, rows without doc_id are left out, texts of fewer than
`window` words have no passage. Rows that repeat a doc_id are one document with several texts; what repeats only within one
document is no passage. Columns besides doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlegraph.llm.fm_index import Index
from spindlegraph.llm.shared import staged, text_chunks
from spindlegraph.llm.words import U, Words, mix, words

GRAM = 8
SHARD_WORDS = 300_000


def _idents(w: Words) -> np.ndarray:
    """A hash of each text's words in their order."""
    nth = (np.arange(len(w.hash)) - w.first[w.row]).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hash + mix(nth + U(1))))])
    return mix(sums[w.first[1:]] - sums[w.first[:-1]] + w.count.astype(np.uint64)).view(np.int64)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value in x[i : i + width] for each i."""
    have, at = 1, np.arange(len(x), dtype=np.int32)
    while have < width:
        step = min(have, width - have)
        later = x[step:] < x[: len(x) - step]
        x, at = np.where(later, x[step:], x[: len(x) - step]), np.where(later, at[step:], at[: len(at) - step])
        have += step
    return at


def _sampled(w: Words, window: int) -> tuple[np.ndarray, ...]:
    """Grams that are the first least of some window: hash, first word, and from where to where its windows go."""
    none = np.zeros(0, np.int64)
    long = np.flatnonzero(w.count >= window)
    if not len(long):
        return np.zeros(0, np.uint64), none, none, none
    g, at = w.grams(GRAM)
    in_long = w.count[w.row[at]] >= window
    g, at = g[in_long], at[in_long]
    width = window - GRAM + 1
    inside = np.flatnonzero(w.row[at[: len(at) - width + 1]] == w.row[at[width - 1 :]])
    least = _least(g, width)[inside]
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    k = least[first]
    return g[k], at[k], at[inside[first]], at[inside[last]] + window


def _parts(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return edges, np.append(edges, len(part))


def _survey(window: int, ranges: int):
    """Long texts (part -1) and their sampled grams, packed by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            w = words(chunk.column(1))
            ident, has = _idents(w), np.flatnonzero(w.count >= window)
            g, at, _, _ = _sampled(w, window)
            owner = ident[w.row[at]]
            part = ((mix(g) >> U(32)) * U(ranges) >> U(32)).astype(np.int64)  # sampled hashes are small ones
            by = np.argsort(part, kind="stable")
            g, owner, part = g[by], owner[by], part[by]
            edges, cut = _parts(part)
            none = [None] * len(has)
            pack = lambda x: pa.array(none + [x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
            zeros = np.zeros(len(edges), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(has), -1), part[edges]]).astype(np.int32)), pa.array(np.concatenate([np.asarray(chunk.column(0))[has], zeros])), pa.array(np.concatenate([ident[has], zeros])), pa.array(np.concatenate([w.count[has], zeros])), pack(g), pack(owner)], names=["part", "doc_id", "ident", "n", "grams", "owners"])

    return run


def _shared(group: pa.Table) -> pa.Table:
    """Grams that more than one text has: for each text, its own of them, and how often they occur in it."""
    g = np.frombuffer(b"".join(x.as_py() for x in group["grams"]), np.uint64)
    owner = np.frombuffer(b"".join(x.as_py() for x in group["owners"]), np.int64)
    by = np.lexsort((owner, g))
    g, owner = g[by], owner[by]
    new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])])) if len(g) else np.zeros(0, np.int64)
    often = np.diff(np.append(new, len(g)))
    g, owner = g[new], owner[new]
    same = g[1:] == g[:-1]
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(g) else np.zeros(0, bool)
    g, owner, often = g[many], owner[many], often[many]
    by = np.argsort(owner, kind="stable")
    g, owner, often = g[by], owner[by], often[by]
    edges, cut = _parts(owner)
    return pa.table({"ident": owner[edges], "grams": pa.array([g[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()), "n": np.add.reduceat(often, edges) if len(edges) else edges})


def _segments(window: int, shards: int):
    """Words around each shared gram, packed by shard: 32 bits of hash a word, length, document, first word, and place of the gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, max_rows=1000):
            w = words(chunk.column(1))
            g, at, a, b = _sampled(w, window)
            wanted = [np.frombuffer(b"".join(x), np.uint64) if x else np.zeros(0, np.uint64) for x in chunk.column(2).to_pylist()]
            size = [len(x) for x in wanted]
            want = np.sort(mix(np.concatenate([*wanted, np.zeros(0, np.uint64)]) ^ mix(np.repeat(np.arange(len(wanted), dtype=np.uint64), size))))
            key = mix(g ^ mix(w.row[at].astype(np.uint64)))
            i = np.minimum(np.searchsorted(want, key), max(0, len(want) - 1))
            ok = want[i] == key if len(want) else np.zeros(len(g), bool)
            g, at, a, b = g[ok], at[ok], a[ok], b[ok]
            row = w.row[at]
            part = ((mix(g) >> U(32)) * U(shards) >> U(32)).astype(np.int64)  # sampled hashes are small ones
            by = np.argsort(part, kind="stable")
            part, a, b, at, row = part[by], a[by], b[by], at[by], row[by]
            ids = np.asarray(chunk.column(0))
            edges, cut = _parts(part)
            symbols = (w.hash >> U(32)).astype(np.uint32)
            pack = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part[edges].astype(np.int32)), pa.array([b"".join(symbols[x:y].tobytes() for x, y in zip(a[i:j].tolist(), b[i:j].tolist())) for i, j in zip(cut[:-1], cut[1:])], pa.binary()), pack((b - a).astype(np.int32)), pack(ids[row]), pack(_idents(w)[row]), pack((a - w.first[row]).astype(np.int32)), pack((at - a).astype(np.int32))], names=["part", "words", "lengths", "docs", "idents", "starts", "grams"])

    return run


def _keys(flat: np.ndarray, length: np.ndarray, ends: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """A hash of each segment, its words in order and the place of its gram."""
    out = np.zeros(len(length), np.uint64)
    for some in np.array_split(np.arange(len(length)), max(1, len(flat) // 500_000)):
        if len(some):
            a, b = int(ends[some[0]] - length[some[0]]), int(ends[some[-1]])
            n, e = length[some], ends[some] - a
            nth = (np.arange(b - a) - np.repeat(e - n, n)).astype(np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat[a:b] + mix(nth + U(1))))])
            out[some] = mix(sums[e] - sums[e - n] + mix(n.astype(np.uint64) * U(4096) + gram[some].astype(np.uint64)))
    return out


def _search(window: int):
    """Runs of places that are repeated: (doc_id, from, to, earlier); earlier: places whose words a document of smaller id has."""

    def run(group: pa.Table) -> pa.Table:
        join = lambda c, kind: np.frombuffer(b"".join(x.as_py() for x in group[c]), kind)
        length, doc, start, gram = join("lengths", np.int32).astype(np.int64), join("docs", np.int64), join("starts", np.int32).astype(np.int64), join("grams", np.int32).astype(np.int64)
        flat, ends = join("words", np.uint32), np.cumsum(length)
        # copies have equal segments: each is indexed and streamed once
        key = _keys(flat, length, ends, gram)
        by = np.lexsort((doc, key))
        edges, cut = _parts(key[by])
        one, low, many = by[edges], doc[by][edges], doc[by][edges] != doc[by][cut[1:] - 1]
        of, symbols = np.unique(np.concatenate([flat[e - n : e] for e, n in zip(ends[one].tolist(), length[one].tolist())]), return_inverse=True)
        stops = np.cumsum(length[one])
        segments = [symbols[e - n : e] + 1 for e, n in zip(stops.tolist(), length[one].tolist())]
        s, p, least = Index(segments, low, many, window).repeats((gram[one], gram[one] + GRAM))
        # runs of places with one smallest document, for every document that has the segment
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1) | (least[1:] != least[:-1])]) if len(s) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s)) - 1 if len(first) else first
        copies = np.diff(cut)[s[first]]
        run = np.repeat(np.arange(len(first)), copies)
        member = by[edges[s[first]][run] + np.arange(len(run)) - np.repeat(np.cumsum(copies) - copies, copies)]
        begin, end, earlier = p[first][run] + start[member], p[last][run] + start[member] + window, least[first][run] < doc[member]
        texts, of = np.unique(np.stack([doc, join("idents", np.int64)]), axis=1, return_inverse=True)
        of = of.ravel()[member]
        out = []
        for sub, mark in ((slice(None), False), (earlier, True)):
            t, a, b = of[sub], begin[sub], end[sub]
            by_start = np.lexsort((a, t))
            t, a, b = t[by_start], a[by_start], b[by_start]
            span = np.int64(int(b.max(initial=0)) + 2)
            up_to = np.maximum.accumulate(t * span + b)
            fresh = np.concatenate([[True], t[1:] * span + a[1:] > up_to[:-1]]) if len(t) else np.zeros(0, bool)
            at = np.flatnonzero(fresh)
            out.append((t[at], a[at], up_to[np.append(at[1:], len(t)) - 1] % span if len(at) else a[at], np.full(len(at), mark)))
        t, b, c, e = (np.concatenate(v) for v in zip(*out))
        return pa.table({"doc_id": texts[0, t], "ident": texts[1, t], "start_word": b, "end_word": c, "earlier": e})

    return run


def _found(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts that are equal (ident, n, low, many), the documents that have them (doc_id, ident, n), and places repeated in the text of each low: (doc_id, ident, start_word, end_word, earlier); earlier: what a document of smaller id has."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    survey = staged(texts.mapInArrow(_survey(window, max(8, math.ceil(total / 20_000_000))), "part int, doc_id long, ident long, n long, grams binary, owners binary"))
    members = survey.where("part = -1").select("doc_id", "ident", "n").distinct()
    groups = staged(members.groupBy("ident", "n").agg(F.min("doc_id").alias("low"), F.count("*").alias("many")))
    shared = staged(survey.where("part >= 0").select("part", "grams", "owners").groupBy("part").applyInArrow(_shared, "ident long, grams binary, n long"))
    much = shared.agg(F.sum("n")).first()[0] or 0
    shards = max(8, math.ceil(much * 3 * window / 2 / SHARD_WORDS))
    chosen = shared.groupBy("ident").agg(F.collect_list("grams").alias("grams")).join(groups.select("ident", "low"), "ident").groupBy("low").agg(F.flatten(F.collect_list("grams")).alias("grams")).withColumnRenamed("low", "doc_id")
    segments = texts.join(chosen, "doc_id").select("doc_id", "text", "grams").mapInArrow(_segments(window, shards), "part int, words binary, lengths binary, docs binary, idents binary, starts binary, grams binary")
    hits = segments.groupBy("part").applyInArrow(_search(window), "doc_id long, ident long, start_word long, end_word long, earlier boolean")
    return groups, members, hits


def _merged(intervals: DataFrame, by: str) -> DataFrame:
    """Intervals of each `by` that overlap or touch as one."""
    before = f"max(end_word) over (partition by {by} order by start_word, end_word rows between unbounded preceding and 1 preceding)"
    marked = intervals.selectExpr("*", f"if(start_word <= {before}, 0, 1) as __new")
    return marked.selectExpr("*", f"sum(__new) over (partition by {by} order by start_word, end_word rows unbounded preceding) as __run").groupBy(*by.split(", "), "__run").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("__run")


def repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, start_word, end_word): the words, counted from 0 and end_word left out, that are in a run of `window` words which another document has too."""
    groups, members, hits = _found(docs, window)
    whole = members.join(groups.where("many > 1").select("ident"), "ident", "left_semi").select("doc_id", "ident", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"))
    part = hits.where("not earlier").join(groups.where("many = 1").select("ident"), "ident", "left_semi").select("doc_id", "ident", "start_word", "end_word")
    return whole.union(_merged(part, "doc_id, ident").select("doc_id", "ident", "start_word", "end_word")).select("doc_id", "start_word", "end_word").distinct()


def _cut(schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(iter([batch.rename_columns([*batch.schema.names[:-1], "__cuts"])])):
                k = chunk.schema.get_field_index("text")
                cuts = chunk.column(chunk.num_columns - 1)
                some = np.flatnonzero(~np.asarray(cuts.is_null()))
                texts = batch_texts = chunk.column(k)
                gone = np.zeros(chunk.num_rows, bool)
                if len(some):
                    w = words(texts.take(pa.array(some)))
                    ident, new = _idents(w), batch_texts.to_pylist()
                    for r, i in enumerate(some.tolist()):
                        drop = np.zeros(int(w.count[r]), bool)
                        for c in cuts[i].as_py():
                            if c["ident"] == ident[r]:
                                drop[c["start_word"] : c["end_word"]] = True
                        if not drop.any():
                            continue
                        gone[i] = drop.all()
                        at, base = w.first[r], w.text_at[r]
                        text, pieces, last = w.data[base : w.text_at[r + 1]], [], 0
                        flips = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
                        for a, b in zip(flips[::2].tolist(), flips[1::2].tolist()):
                            pieces.append(text[last : w.start[at + a] - base])
                            last = w.start[at + b] - base if b < len(drop) else len(text)
                        new[i] = np.concatenate([*pieces, text[last:]]).tobytes().decode("utf-8", "replace")
                    texts = pa.array(new, pa.string())
                out = chunk.set_column(k, "text", texts.cast(pa.string()))
                yield out.filter(pa.array(~gone)).select(schema)

    return run


def drop_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs without the passages that a document of smaller doc_id has too; n_chars, where it is a column, follows the text. Documents of which nothing is left go, all others stay; null texts stay null."""
    groups, members, hits = _found(docs, window)
    whole = members.join(groups.where("many > 1"), ["ident", "n"]).where("doc_id <> low").select("doc_id", "ident", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"))
    later = whole.union(hits.where("earlier").select("doc_id", "ident", "start_word", "end_word"))
    cuts = later.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct("ident", "start_word", "end_word")).alias("__cuts"))
    joined = docs.withColumn("__null", F.col("text").isNull()).join(cuts, F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
    names = joined.columns[:-1]
    cut = joined.mapInArrow(_cut(names), joined.drop("__cuts").schema)
    cut = cut.withColumn("text", F.when(~F.col("__null"), F.col("text")))
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__null"), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.select(*docs.columns)


PASSAGES_SQL = """
with t as (select doc_id, text, row_number() over (order by doc_id, text) as id from (select distinct doc_id, text from documents where doc_id is not null and text is not null)),
w as (select doc_id, id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') as w from t),
p as (select doc_id, id, w, unnest(range(0, len(w) - 49)) as s from w where len(w) >= 50),
h as (select doc_id, id, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) as h from p),
r as (select doc_id, id, s from h where h in (select h from h group by h having count(distinct doc_id) > 1)),
m as (select *, case when s <= lag(s) over (partition by id order by s) + 50 then 0 else 1 end as new from r),
i as (select *, sum(new) over (partition by id order by s rows unbounded preceding) as run from m)
select distinct doc_id, start_word, end_word from (select doc_id, id, run, min(s)::bigint as start_word, (max(s) + 50)::bigint as end_word from i group by doc_id, id, run)
"""
