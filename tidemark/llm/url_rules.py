"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that every URL it matches must hold.
Tokens are counted over all URLs of the table, and each rule is filed under its rarest one.
A URL fetches the rules filed under its own tokens, and only these are run on it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import map_batches, text_or_empty

ALLOW, BLOCK = "allow", "block"
TOKEN = re.compile(r"[A-Za-z0-9]+")


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is searched in host plus path; ``tokens`` are whole tokens of every match, lower-case.

    Fixed rules (``name`` set) come before the others, the longest name first; of the others a
    blocking one wins.
    """

    verdict: str
    pattern: str
    tokens: tuple[str, ...] = ()
    name: str | None = None


def host_path_rule(verdict: str, host: str, path: str = "/") -> UrlRule:
    """A rule for a host with its subdomains and the paths that start with ``path``."""
    cut = path if path.endswith("/") else path[: path.rfind("/") + 1]  # what comes last may be part of a longer token
    tokens = dict.fromkeys(t.lower() for t in TOKEN.findall(f"{host} {cut}"))
    return UrlRule(verdict, f"^(?:[^/]*\\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), f"{host}{path}")


def word_rule(verdict: str, word: str, where: str = r"[./?&=_-]") -> UrlRule:
    """A rule for a token sequence that stands between separators anywhere in host and path."""
    return UrlRule(verdict, rf"(?:^|{where}){re.escape(word)}(?:\Z|{where})", tuple(t.lower() for t in TOKEN.findall(word)))


#: The method's own rules: tokens of hosts and paths that crawlers leave out.
OWN_RULES = tuple(word_rule(BLOCK, w) for w in ("spam-farm", "spam", "casino", "adserver", "ads", "doubleclick", "tracker", "tracking", "porn", "xxx", "login", "signin", "cart", "checkout")) + (
    UrlRule(BLOCK, r"/wp-(?:admin|login)", ("wp",)), UrlRule(BLOCK, r"/cgi-bin/", ("cgi", "bin")), UrlRule(BLOCK, r"\.(?:exe|apk|torrent)\Z"),
)


def url_parts(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.regexp_extract(text_or_empty(url), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _tokens(host: str, path: str) -> set[str]:
    return {t.lower() for t in TOKEN.findall(f"{host} {path}")}


def token_frequencies(parts: DataFrame, rules: tuple[UrlRule, ...]) -> dict[str, int]:
    """URLs that hold each token of the rules, over the whole table; as many rows as rule tokens at most."""
    wanted = sorted({t for rule in rules for t in rule.tokens})
    if not wanted:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "host", "path")), F.lit("[a-z0-9]+"), 0))
    held = parts.select(F.explode(F.filter(words, lambda w: w.isin(wanted))).alias("token"))
    return {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every row.

    ``rule`` names the fixed rule that decided, if any. A URL that no rule fits is allowed, a
    null URL or one without ``://`` too. Repeated rows are judged each; other columns are left out.
    """
    host, path = url_parts(url)
    parts = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    seen = token_frequencies(parts, rules)
    filed: dict[str | None, list[int]] = defaultdict(list)
    for i, rule in enumerate(rules):
        filed[min(rule.tokens, key=lambda t: (seen.get(t, 0), t)) if rule.tokens else None].append(i)
    kind = dict(parts.dtypes)["_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(rule.pattern) for rule in rules]
        always, empty = filed.get(None, []), ()
        for batch in batches:
            names, verdicts = [], []
            for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                fetched = [i for t in _tokens(h, p) for i in filed.get(t, empty)] + always
                fits = [rules[i] for i in fetched if compiled[i].search(h + p)]
                fixed = max((r for r in fits if r.name), key=lambda r: len(r.name), default=None)
                names.append(fixed.name if fixed else None)
                verdicts.append(fixed.verdict if fixed else BLOCK if any(r.verdict == BLOCK for r in fits) else ALLOW)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["_key", "host", "path", "rule", "verdict"])

    judged = map_batches(parts, run, f"_key {kind}, host string, path string, rule string, verdict string")
    return judged.withColumnRenamed("_key", key)
