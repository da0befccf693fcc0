"""The text and identity rules for single Python strings: what parsers and the driver use. Columns have them in text.py."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

TIERS = ("AMBIGUOUS", "INFERRED", "EXTRACTED")
STOPWORDS = frozenset("a an and are did do does for how in is of on or the to what why".split())
SECRETS = (r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", r"\bAKIA[0-9A-Z]{16}\b", r"\bsk-[A-Za-z0-9_-]{10,}\b")
_SECRETS = [re.compile(rx, re.ASCII) for rx in SECRETS]
_BETWEEN = re.compile("[^a-z0-9]+")


def redacted(text: str) -> str:
    if "sk-" not in text and "AKIA" not in text and "-----BEGIN " not in text:
        return text
    for rx in _SECRETS:
        text = rx.sub("[REDACTED]", text)
    return text


def slug(label: str) -> str:
    """Letters and digits of the label's compatibility form in lower case, with single hyphens between; unnamed where there are none."""
    if label.isascii():
        return _BETWEEN.sub("-", label.lower()).strip("-") or "unnamed"
    folded = unicodedata.normalize("NFKC", label).lower()
    kept = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in folded)
    return "-".join(x for x in kept.split(" ") if x) or "unnamed"


def node_id(kind: str, label: str) -> str:
    return f"{kind}:{slug(label)}"


def triple_id(s: str, p: str, o: str) -> str:
    return "t_" + hashlib.sha256(f"{s}\0{p}\0{o}".encode()).hexdigest()[:16]


def rank(tier: str) -> int:
    return TIERS.index(tier)


def best_tier(tiers) -> str:
    return max(tiers, key=rank, default=TIERS[0])


def canonical(value) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def review_id(kind: str, payload: dict) -> str:
    return "rv_" + hashlib.sha256(f"{kind}\0{canonical(payload)}".encode()).hexdigest()[:8]


def content_hash(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def utf16(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


def tokens(question: str) -> list[str]:
    """ASCII tokens of two characters or more that aren't stop words, repeated ones too."""
    return [t for t in re.split("[^a-z0-9]+", folded(question)) if len(t) >= 2 and t not in STOPWORDS]


def singular(word: str) -> str:
    if len(word) > 3 and word.endswith("ies"):
        return word[:-3] + "y"
    return word[:-1] if len(word) > 2 and word.endswith("s") and not word.endswith("ss") else word


def variants(word: str) -> list[str]:
    """The word and what it may be the plural of."""
    out = [word]
    if len(word) > 3 and word.endswith("ies"):
        out.append(word[:-3] + "y")
    if len(word) > 3 and word.endswith("es"):
        out.append(word[:-2])
    if len(word) > 2 and word.endswith("s") and not word.endswith("ss"):
        out.append(word[:-1])
    return list(dict.fromkeys(out))


def stems(text: str) -> set[str]:
    return {v for w in re.split("[^a-z0-9]+", text) if len(w) >= 2 for v in variants(w)}


def local_part(id_: str) -> str:
    return id_.partition(":")[2] if ":" in id_ else id_


def prose(predicate: str) -> str:
    return predicate.replace("_", " ")
