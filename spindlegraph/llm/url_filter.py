"""URL filters: pattern rules indexed by their rarest literal token; only rules whose token a URL has run on it.

A rule is a pattern over the lower-case URL: `*` is anything, `^` a separator or the end, `|` at either end anchors there, `||` at
the start anchors at a label of the host, `@@` before all makes an exception, and a pattern between two slashes is a regular
expression. Every literal token (a run of letters and digits that the pattern doesn't let go on) must be in a URL that matches,
so each rule is filed under the one that the fewest URLs have; the frequencies of the rules' tokens are counted over all URLs.
The index, bounded by the rules that the caller holds, goes to the tasks; there a URL's tokens fetch candidate rules, and only
those, and the rules without such a token, run their regular expressions, each compiled once. So nothing but URLs is shuffled,
and a token that all URLs have makes no hot key. URLs that repeat are matched once. A page is allowed if an exception matches,
else blocked if a rule matches, else it has no verdict.

Null and empty URLs have no verdict. Each row gets a row, so repeated rows and rows without page_id are answered each. Columns
besides page_id and url are ignored. An empty table gives no rows; without rules no page has a verdict.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlegraph.llm.shared import staged

RULES = (
    "||spam-farm.example.*^", "||cheap-pills.example.com^", "||casino-*.example.*^", "||ads.*^", "||adserver.*^", "||tracker.*^", "||click.*^", "||doubleclick.net^", "||malware.*^", "||phish.*^",
    "/banner/*/img^", "/adframe.", "/pagead/", "/popunder.", "/affiliate/*", "&affid=", "?utm_source=", "&gclid=", "?session_id=", "&sid=", "/wp-login.php|", "/xmlrpc.php|", "/cgi-bin/", "/search?q=", "/tag/*/page/",
    "/print/*?", "/login^", "/signin^", "/cart^", "/checkout^", "|ftp://", "|javascript:", "|data:", ".exe|", ".zip|", ".pdf|", ".jpg|", ".mp4|", "?page=2&ref=", "||m.*.example.org/de/*", "||blog.*.example.net/*.html|",
    "/porn|xxx|adult-/", "/^https?:\\/\\/[0-9]{1,3}(\\.[0-9]{1,3}){3}([:\\/]|$)/", "/\\/([a-z0-9]{2,})\\/[0-9]{4,}$/", "@@||spam-farm.example.org/en/*.html|", "@@||wiki.*^", "@@/en/*#top|", "@@?utm_source=feed&trusted=",
)


def compiled(rule: str) -> tuple[bool, str, list[str]]:
    """Whether the rule is an exception, its regular expression, and the tokens that every URL it matches has."""
    allow = rule.startswith("@@")
    p = (rule[2:] if allow else rule).lower()
    if len(p) > 2 and p[0] == p[-1] == "/" and re.search(r"[\\()\[\]{}$+|]", p[1:-1]):
        return allow, (rule[2:] if allow else rule)[1:-1], []
    head, tail = "", ""
    if p.startswith("||"):
        head, p = r"^[a-z][a-z0-9+.-]*://([^/?#]*[.])?", p[2:]
    elif p.startswith("|"):
        head, p = "^", p[1:]
    if p.endswith("|"):
        tail, p = "$", p[:-1]
    regex = "".join(".*" if c == "*" else "([^a-z0-9_.%-]|$)" if c == "^" else c if c.isalnum() and c.isascii() else "[" + c + "]" if c not in "\\^[]" else "\\" + c for c in p)
    tokens = []
    for m in re.finditer("[a-z0-9]+", p):
        starts = head if m.start() == 0 else p[m.start() - 1] != "*"
        ends = tail if m.end() == len(p) else p[m.end()] != "*"
        if starts and ends:
            tokens.append(m[0])
    return allow, head + regex + tail, list(dict.fromkeys(tokens))


TOKEN = re.compile("[a-z0-9]+")


def _often(wanted: frozenset[str]):
    """How many URLs have each wanted token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in batches:
            for low in batch.column("low").to_pylist():
                n.update(wanted.intersection(TOKEN.findall(low)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    return run


def _match(rules: list[tuple[int, bool, str]], index: dict[str, list[int]], loose: list[int]):
    """rules: rule_id, allow, regex; index and loose: places in rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(i, allow, re.compile(regex).search) for i, allow, regex in rules]
        tokens = index.keys()
        for batch in batches:
            rows = []
            for url, low in zip(batch.column("url").to_pylist(), batch.column("low").to_pylist()):
                fetched = [r for t in tokens & set(TOKEN.findall(low)) for r in index[t]]
                rows += [(url, i, allow) for i, allow, search in (made[r] for r in fetched + loose) if search(low)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.bool_()))], names=["url", "rule_id", "allow"])

    return run


def filed(parsed: Sequence[tuple[int, bool, str, list[str]]], often: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Places in parsed by the rarest token of each (of equal ones the longest, then the first), and those without a token. A token that no URL has leaves its rule without candidates."""
    index: dict[str, list[int]] = {}
    loose = []
    for at, (_, _, _, tokens) in enumerate(parsed):
        if tokens:
            index.setdefault(min(tokens, key=lambda t: (often.get(t, 0), -len(t), t)), []).append(at)
        else:
            loose.append(at)
    return index, loose


def matching(urls: DataFrame, rules: Sequence[str]) -> DataFrame:
    """(url, rule_id, allow) of every rule that matches a URL; urls: distinct, in a column url. rule_id is the place in rules, from 0."""
    parsed = [(i, *compiled(r)) for i, r in enumerate(rules)]
    low = urls.select("url", F.lower("url").alias("low"))
    wanted = frozenset(t for r in parsed for t in r[3])
    often = dict(low.select("low").mapInArrow(_often(wanted), "token string, n long").groupBy("token").agg(F.sum("n")).collect()) if wanted else {}  # as many rows as the rules have tokens
    index, loose = filed(parsed, often)
    return low.mapInArrow(_match([r[:3] for r in parsed], index, loose), "url string, rule_id int, allow boolean")


def filtered(pages: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """(page_id, verdict, rule_id, n_rules) of every row: allow, block or none; the first rule that decided; how many rules matched."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = staged(rows.select("url").where("url <> ''").distinct())
    hits = matching(urls, rules).groupBy("url").agg(F.min(F.when(F.col("allow"), F.col("rule_id"))).alias("yes"), F.min(F.when(~F.col("allow"), F.col("rule_id"))).alias("no"), F.count("*").alias("n"))
    verdict = F.when(F.col("yes").isNotNull(), "allow").when(F.col("no").isNotNull(), "block").otherwise("none")
    return rows.join(hits, "url", "left").select("page_id", verdict.alias("verdict"), F.coalesce("yes", "no").alias("rule_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_rules"))


def _sql() -> str:
    values = ", ".join("({}, {}, '{}')".format(i, str(a).lower(), x.replace("'", "''")) for i, (a, x, _) in enumerate(map(compiled, RULES)))
    return f"""
with r(rule_id, allow, regex) as (values {values}),
u as (select distinct url from pages where url <> ''),
m as (select url, min(rule_id) filter (allow) as yes, min(rule_id) filter (not allow) as no, count(*) as n from u join r on regexp_matches(lower(url), regex) group by url)
select page_id, case when yes is not null then 'allow' when no is not null then 'block' else 'none' end as verdict, coalesce(yes, no) as rule_id, coalesce(n, 0) as n_rules
from pages p left join m on p.url = m.url
"""


VERDICTS_SQL = _sql()
