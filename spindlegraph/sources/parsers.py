"""Parsers of one source file each: Markdown and plain text, JSON and JSON lines, flat YAML. They yield nodes, evidence of triples and diagnostics.

A file is bounded by the discovery limit, and its grammar has state from line to line, so a file is parsed by one task, in
Python; files are parsed apart from one another and nothing is shuffled for it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from spindlegraph.functions import plain

#: What JavaScript, whose text rules the grammars follow, calls white space.
SPACE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_S, _ANY = f"[{SPACE}]", "[^\n\r\u2028\u2029]"
_NAME = "[a-z][a-z0-9_]*"
PREDICATE = re.compile(_NAME)
LINES = re.compile("\r?\n")
EDGES = (
    re.compile(rf"\[\[(?P<s>[^\]]+)\]\]{_S}*--(?P<p>{_NAME})-->{_S}*\[\[(?P<o>[^\]]+)\]\]"),
    re.compile(rf"^(?P<s>{_ANY}+?){_S}+--(?P<p>{_NAME})-->{_S}+(?P<o>{_ANY}+?){_S}*$"),
    re.compile(rf"^(?P<s>{_ANY}+?){_S}+-(?P<p>{_NAME})->{_S}+(?P<o>{_ANY}+?){_S}*$"),
)
HEADING = re.compile(rf"^#{{1,2}}{_S}+({_ANY}+)$")
DEFINITION = re.compile(rf"^([^:\n]{{1,80}}){_S}*:{_S}+({_ANY}+)$")
WIKI, LINK = re.compile(r"\[\[([^\]]+)\]\]"), re.compile(r"\[([^\]]+)\]\(([^)]+)\)")
TAG = re.compile(rf"(?:^|[{SPACE}(\[{{])#([A-Za-z][A-Za-z0-9_-]*)(?a:\b)")
FILE_LIKE = re.compile(r"^(?:https?://|\.{0,2}/|[A-Za-z]:\\)|(?i:\.(?:markdown|md|txt|jsonl?))(?a:\b|$)")
TAG_KEYS, FIELD_KEYS = {"tags", "topics", "keywords"}, {"title", "description", "summary"}
RELATIONS = frozenset("about authored blocked_by blocks causes cites contradicts delivers depends_on deploys derived_from evaluates implements located_in member_of mentions mitigates owns part_of precedes related_to requires same_as supports uses uses_method works_for".split())
COMMENT = re.compile("(?:^|[ \t])#")
KEY = re.compile("[A-Za-z_][A-Za-z0-9_-]*")
MOST_DIAGNOSTICS = 8


def trim(text: str) -> str:
    return text.strip(SPACE)


def clean(label: str) -> str:
    return plain.redacted(label)


@dataclass
class Found:
    """What a file gives: nodes by id, evidence in order, and diagnostics."""

    path: str
    content_hash: str
    nodes: dict[str, dict] = field(default_factory=dict)
    evidence: list[dict] = field(default_factory=list)
    keys: set[tuple] = field(default_factory=set)
    diagnostics: list[tuple[str, str]] = field(default_factory=list)

    def node(self, kind: str, label: str, description: str | None = None, id_: str | None = None, aliases: list[str] | None = None) -> str:
        label = clean(label)
        id_ = id_ or plain.node_id(kind, label)
        known = self.nodes.setdefault(id_, {"id": id_, "type": kind, "label": label, "description": None, "aliases": None})
        if description and not known["description"]:
            known["description"] = clean(description)
        if aliases:
            known["aliases"] = list(dict.fromkeys([*(known["aliases"] or ()), *aliases]))
        return id_

    def triple(self, s: str, p: str, o: str, extractor: str, line: int | None = None, repeats: bool = False) -> None:
        """One more piece of evidence; of equal ones (by triple and extractor) the first counts, unless the grammar repeats them."""
        key = (s, p, o, extractor)
        if key in self.keys and not repeats:
            return
        self.keys.add(key)
        self.evidence.append({"s": s, "p": p, "o": o, "extractor": extractor, "line": line})

    def note(self, code: str, message: str) -> None:
        self.diagnostics.append((code, message))


def base_name(path: str) -> str:
    return re.split(r"[/\\]", path)[-1] or path


def _bare(label: str) -> str:
    return trim(label.removeprefix("[[").removesuffix("]]"))


def edge_line(line: str) -> tuple[str, str, str] | None:
    """Subject, predicate and object of a line that states an edge; the double arrow goes before the single one."""
    if "->" not in line:
        return None
    for k, form in enumerate(EDGES):
        m = form.search(line)
        if not m:
            continue
        s, p, o = _bare(m["s"]), m["p"], _bare(m["o"])
        if k == 0 or s and o and not (k == 1 and ("--" in s or "-->" in o)):
            return s, p, o
    return None


def markdown(path: str, content: str, content_hash: str) -> Found:
    found = Found(path, content_hash)
    context: str | None = None
    block, content = front_matter(content)
    if block is not None:
        yaml(path, block, content_hash, "markdown/frontmatter", 1, found)
        context = next((n["id"] for n in found.nodes.values() if n["type"] == "Document"), None)
    for number, raw in enumerate(LINES.split(content), 1):
        line = raw.rstrip(SPACE)
        text = trim(line)
        if not text:
            continue
        if text[0] == "#" and (heading := HEADING.match(text)):
            context = found.node("Document", trim(heading[1]))
            continue
        if edge := edge_line(text):
            s, o = trim(clean(edge[0])), trim(clean(edge[2]))
            if s and o:
                found.triple(found.node("Concept", s), edge[1], found.node("Concept", o), "markdown/edge-line", number)
                continue
        if ":" in text and text[0] != "#" and (term := DEFINITION.match(text)) and "[[" not in line and not LINK.search(line):
            name, meaning = clean(trim(term[1])), clean(trim(term[2]))
            if name and meaning and "[" not in name and not name.startswith("http"):
                found.nodes[found.node("Concept", name, meaning)]["description"] = meaning
                continue
        for label in (clean(trim(m[1])) for m in (WIKI.finditer(line) if "[[" in line else ())):
            if label:
                concept = found.node("Concept", label)
                if context:
                    found.triple(context, "mentions", concept, "markdown/wiki", number)
        pointed = [("Document" if FILE_LIKE.search(trim(m[2])) else "Concept", clean(trim(m[1])), "markdown/link") for m in (LINK.finditer(line) if "](" in line else ())]
        pointed += [("Topic", clean(trim(m[1])), "markdown/tag") for m in (TAG.finditer(line) if "#" in line else ())]
        for kind, label, extractor in pointed:
            if label:
                target = found.node(kind, label)
                if context is None:
                    context = found.node("Document", base_name(path))
                found.triple(context, "mentions", target, extractor, number)
    return found


def front_matter(content: str) -> tuple[str | None, str]:
    """The block between --- and --- or ... at the start, if there is one, and the content with its lines empty."""
    if trim(content.partition("\n")[0]) == "---":
        lines = LINES.split(content)
        for i, line in enumerate(lines[1:], 1):
            if trim(line) in ("---", "..."):
                return "\n".join(lines[1:i]), "\n".join([""] * (i + 1) + lines[i + 1 :])
    return None, content


def _unquoted(value: str) -> str:
    value = trim(value)
    return value[1:-1] if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"" else value


def _uncommented(line: str) -> str:
    if "#" not in line:
        return line
    if "'" not in line and '"' not in line:
        found = COMMENT.search(line)
        return line[: found.end() - 1] if found else line
    quote = ""
    for i, c in enumerate(line):
        if c in "'\"" and quote in ("", c):
            quote = "" if quote else c
        elif c == "#" and not quote and (i == 0 or line[i - 1] in " \t"):
            return line[:i]
    return line


def flat_yaml(content: str) -> tuple[list[dict], bool]:
    """Top-level entries (key, values, is_list, line), and whether nested content was skipped."""
    entries: list[dict] = []
    open_: dict | None = None
    nested = False
    for number, raw in enumerate(LINES.split(content), 1):
        line = _uncommented(raw)
        text = trim(line)
        if text in ("", "---", "..."):
            continue
        if text == "-" or text.startswith("- "):
            item = _unquoted(text[1:].lstrip(SPACE))
            if open_ is not None and ":" in item:
                nested = True
            elif open_ is not None and item:
                open_["is_list"] = True
                open_["values"].append(item)
            continue
        if line[0] in " \t":
            nested = True
            continue
        key, colon, value = text.partition(":")
        key, value = trim(key), trim(value)
        if not colon or not KEY.fullmatch(key):
            continue
        entry = {"key": key.lower(), "values": [], "is_list": False, "line": number}
        if value[:1] == "[" and value[-1:] == "]":
            entry["is_list"], entry["values"] = True, [v for v in map(_unquoted, trim(value[1:-1]).split(",")) if v]
        elif value and _unquoted(value) not in ("", "null", "~"):
            entry["values"] = [_unquoted(value)]
        entries.append(entry)
        open_ = None if value else entry
    return entries, nested


def yaml(path: str, content: str, content_hash: str, extractor: str = "yaml/field", offset: int = 0, found: Found | None = None) -> Found:
    found = found or Found(path, content_hash)
    entries, nested = flat_yaml(content)
    if nested:
        found.note("YAML_NESTED_SKIPPED", "nested content is left out; top-level keys with values and lists count")
    if not entries:
        return found
    title = next((e["values"][0] for e in entries if e["key"] == "title" and e["values"]), base_name(path))
    doc = found.node("Document", title)
    summary, notes = "", []
    for e in entries:
        key, values = e["key"], e["values"]
        if not values or key == "title":
            continue
        if key in FIELD_KEYS:
            summary = summary or clean(values[0])
        elif key in TAG_KEYS:
            for v in values:
                found.triple(doc, "mentions", found.node("Topic", v), extractor, e["line"] + offset, repeats=True)
        elif key in RELATIONS:
            for v in values:
                if plain.utf16(v) <= 120:
                    found.triple(doc, key, found.node("Concept", v), extractor, e["line"] + offset, repeats=True)
        elif plain.utf16(note := f"{key}: {', '.join(values)}") <= 200:
            notes.append(clean(note))
    found.nodes[doc]["description"] = " · ".join(x for x in (summary, *notes) if x) or None
    return found


def _parsed(text: str):
    def refuse(name: str):
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, parse_constant=refuse)


def _records(found: Found, content: str, form: str) -> Iterator[tuple[int, object]]:
    """(line or place, value) of every record. Of lines one at a time is held as a value."""
    if form == "document" or form == "auto" and content.lstrip(SPACE)[:1] in ("[", "{"):
        try:
            value = _parsed(content)
            yield from enumerate(value, 1) if isinstance(value, list) else [(1, value)]
            return
        except (ValueError, RecursionError) as why:
            if form == "document":
                found.note("JSON_INVALID", f"not a JSON document: {why}")
                return
    bad, ahead = 0, len(found.diagnostics)
    for number, line in enumerate(LINES.split(content), 1):
        if trim(line):
            try:
                value = _parsed(line)
            except (ValueError, RecursionError) as why:
                bad += 1
                if bad <= MOST_DIAGNOSTICS:
                    # before those of records, as if all lines were read first
                    found.diagnostics.insert(ahead + bad - 1, ("JSON_LINE_INVALID", f"line {number}: {why}"))
            else:
                yield number, value
    if bad > MOST_DIAGNOSTICS:
        found.diagnostics.insert(ahead + MOST_DIAGNOSTICS, ("JSON_LINE_INVALID_TRUNCATED", f"{bad - MOST_DIAGNOSTICS} more lines are not JSON"))


def json_records(path: str, content: str, content_hash: str, form: str = "auto") -> Found:
    """Records of type and label, perhaps with id, aliases and edges. form: document, lines or auto."""
    found = Found(path, content_hash)
    if not content:
        found.note("CONTENT_EMPTY", "the file is empty")
        return found
    text = lambda record, key: trim(record[key]) if isinstance(record.get(key), str) else ""
    bad = 0

    def reject(code: str, message: str) -> None:
        nonlocal bad
        bad += 1
        if bad <= MOST_DIAGNOSTICS:
            found.note(code, message)

    def target(o) -> str:
        if isinstance(o, str):
            return trim(o)
        if not isinstance(o, dict):
            return ""
        id_, kind, label = text(o, "id"), text(o, "type"), text(o, "label")
        return found.node(kind, label, id_=id_ or None) if kind and label else id_

    for number, record in _records(found, content, form):
        if not isinstance(record, dict):
            reject("RECORD_INVALID", f"record {number} is not an object")
            continue
        kind, label = text(record, "type"), text(record, "label")
        if not kind or not label:
            reject("RECORD_INVALID", f"record {number} has no type or no label")
            continue
        raw = record.get("aliases")
        aliases = [clean(trim(a)) for a in raw if isinstance(a, str) and trim(a)] if isinstance(raw, list) else []
        s = found.node(kind, label, id_=text(record, "id") or None, aliases=aliases)
        for edge in record["edges"] if isinstance(record.get("edges"), list) else []:
            if not isinstance(edge, dict) or not (p := text(edge, "p")):
                reject("EDGE_INVALID", f"an edge of record {number} has no predicate")
            elif o := target(edge.get("o")):
                found.triple(s, p, o, "jsonl/field-map")
            else:
                found.note("EDGE_INVALID", f"an edge of record {number} has no object")
    if bad > MOST_DIAGNOSTICS:
        found.note("RECORD_DIAGNOSTICS_TRUNCATED", f"{bad - MOST_DIAGNOSTICS} more records are invalid")
    return found


Parser = Callable[[str, str, str], Found]
BUILT_IN: dict[str, tuple[tuple[str, ...], Parser]] = {
    "markdown": ((".md", ".markdown", ".txt"), markdown),
    "jsonl": ((".jsonl",), lambda path, content, hash_: json_records(path, content, hash_, "lines")),
    "json-document": ((".json",), lambda path, content, hash_: json_records(path, content, hash_, "document")),
    "yaml": ((".yml", ".yaml"), yaml),
}
