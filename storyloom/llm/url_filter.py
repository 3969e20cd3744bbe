"""URL rules, indexed by their rarest literal token.

A rule names a host and the start of a path; it fits the host and all its subdomains. Each
rule is filed under one token that every fitting URL must hold whole: the one that is rarest
in the URLs at hand. The tokens of a URL fetch the few rules filed under them, and only
those run their regular expression. The longest fitting rule decides.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKENS = re.compile(r"[^\W_]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Where no rule fits, hosts that match one of these patterns are blocked, others allowed.
#: Each pattern matches a label part; its token is the literal that every match holds.
PATTERNS = tuple((t, rf"(?:.*[.-])?{t}(?:[.-].*)?") for t in ("ads", "adult", "bets", "betting", "casino", "porn", "spam", "xxx"))
DEFAULT = "allow"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path; both empty without ``://`` or without a URL."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_UPPER), re.match(r"[^?#]*", rest[len(host) :])[0]


def whole_tokens(rule: Rule) -> list[str]:
    """Tokens that stand whole in each fitting URL; one that ends the rule may go on in the URL."""
    return [m[0] for m in _TOKENS.finditer(rule.text) if m.end() < len(rule.text)]


class RuleIndex:
    def __init__(self, rules, counts: dict[str, int], patterns=PATTERNS):
        self.patterns: dict[str, list] = {}
        for token, text in patterns:
            self.patterns.setdefault(token, []).append(re.compile(text, re.S))
        self.by_token: dict[str, list] = {}
        self.always: list = []
        for rule in rules:
            entry = (len(rule.text), rule.text, rule.verdict, re.compile(r"(?:[^/]*\.)?" + re.escape(rule.text), re.S))
            tokens = whole_tokens(rule)
            if tokens:
                self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """The deciding rule and the verdict; of equally long rules the first in order of text."""
        where = host + path
        tokens = set(_TOKENS.findall(where))
        held = [e for t in tokens for e in self.by_token.get(t, ())] + self.always
        # a rule without a path fits the host's end only
        fits = [e for e in held if (m := e[3].match(where)) and (m.end() >= len(host))]
        if not fits:
            bad = any(p.fullmatch(host) for t in tokens for p in self.patterns.get(t, ()))
            return None, "block" if bad else DEFAULT
        best = min(fits, key=lambda e: (-e[0], e[1], e[2]))
        return best[1], best[2]


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` per row of ``pages``.

    A null URL or one without ``://`` has an empty host and path; no rule fits it. Without a
    fitting rule ``rule`` is null and the patterns on the host decide. Repeated
    rows are judged each. Other columns are not used; an empty table gives an empty result.
    """
    rules = tuple(rules)
    asked = sorted({t for r in rules for t in whole_tokens(r)})
    tokens = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col("url"), F.lit(r"(?U)([^\W_]+)"), F.lit(1)))).alias("t"))
    # one row for each token of the given rules at most
    counts = {r.t: r.n for r in tokens.filter(F.col("t").isin(asked)).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    index = RuleIndex(rules, counts)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            found = [index.judge(*p) for p in parts]
            columns = [[p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], [f[1] for f in found]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
