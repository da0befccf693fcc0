"""Text and identity functions of the graph, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spindlegraph.functions import plain
from spindlegraph.functions.plain import SECRETS, STOPWORDS, TIERS

_ASCII = r"^[\x00-\x7F]*$"


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility composition, which Spark has no function for. Only texts beyond ASCII are sent to Python."""
    return F.coalesce(F.pandas_udf(_composed, StringType())(F.when(~text.rlike(_ASCII), text)), text)


def folded(text: Column) -> Column:
    return F.lower(nfkc(text))


def slug(label: Column) -> Column:
    """Lower-case letters and digits with single hyphens between; unnamed where there are none. Apply nfkc before where labels aren't ASCII."""
    s = F.regexp_replace(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    return F.when(s == "", "unnamed").otherwise(s)


def node_id(kind: Column, label: Column) -> Column:
    return F.concat(kind, F.lit(":"), slug(nfkc(label)))


def triple_id(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("t_"), F.substring(F.sha2(F.concat_ws("\0", s, p, o).cast("binary"), 256), 1, 16))


def review_id(kind: Column, payload: Column) -> Column:
    """payload: JSON with sorted keys."""
    return F.concat(F.lit("rv_"), F.substring(F.sha2(F.concat_ws("\0", kind, payload).cast("binary"), 256), 1, 8))


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def utf16(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def estimated_tokens(text: Column) -> Column:
    return F.ceil(utf16(text) / 4)


def local_part(id_: Column) -> Column:
    return F.when(F.instr(id_, ":") > 0, F.regexp_replace(id_, "(?s)^[^:]*:", "")).otherwise(id_)


def prose(predicate: Column) -> Column:
    return F.replace(predicate, F.lit("_"), F.lit(" "))


def rank(tier: Column) -> Column:
    return reduce(lambda c, k: c.when(tier == TIERS[k], k), range(3), F.when(F.lit(False), 0)).cast("int")


def tier(rank_: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), rank_ + 1)


def redacted(text: Column) -> Column:
    return reduce(lambda t, rx: F.regexp_replace(t, rx, "[REDACTED]"), SECRETS, text)


def tokens(question: Column) -> Column:
    """ASCII tokens of two characters or more that aren't stop words."""
    return F.filter(F.split(F.lower(question), "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))


def words(text: Column) -> Column:
    """ASCII words of two characters or more of a folded text."""
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda w: F.length(w) >= 2)


def _forms(w: Column) -> Column:
    n, cut = F.length(w), lambda k: F.substring(w, F.lit(1), F.length(w) - k)
    return F.array_compact(F.array(w, F.when((n >= 4) & w.endswith("ies"), F.concat(cut(3), F.lit("y"))), F.when((n >= 4) & w.endswith("es"), cut(2)), F.when((n >= 3) & w.endswith("s") & ~w.endswith("ss"), cut(1))))


def stems(text: Column) -> Column:
    """Each word of a folded text and what it may be the plural of."""
    return F.array_distinct(F.flatten(F.transform(words(text), _forms)))


def mentions(text: Column, token: str) -> Column:
    """Whether a folded text holds the token, or a word of it and the token may be forms of one word."""
    return text.contains(token) | F.arrays_overlap(stems(text), F.array(*map(F.lit, plain.variants(token))))


question_tokens = plain.tokens


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    dot = lambda x, y: F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
