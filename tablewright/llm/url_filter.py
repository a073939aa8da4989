"""Verdicts on page addresses: rules for hosts and paths, else a weighted vocabulary.

One pass of an Aho-Corasick automaton over host and path finds the terms of the vocabulary; a
hit counts only where no letter or digit touches it. The weights of the different terms found
are added, and an address is blocked from a total of `limit` on: a strict term weighs as much
alone, soft terms need company.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm import words as W
from tablewright.llm.shared import ship

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with its own.
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
STRICT = (
    "casino", "hentai", "malware", "nsfw", "phishing", "porn", "spam", "viagra", "warez", "xxx",
)
SOFT = (
    "ads", "adult", "bet", "bets", "bonus", "cams", "cheap", "clicks", "crack", "dating", "escort", "farm", "free",
    "hot", "jackpot", "keygen", "loans", "pills", "poker", "popup", "sex", "slots", "torrent", "track", "win", "x",
)
LIMIT = 2
VOCABULARY = {**dict.fromkeys(STRICT, LIMIT), **dict.fromkeys(SOFT, 1)}

_UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    """Only A-Z change."""
    return text.translate(_UPPER_TO_LOWER)


def host_and_path(url: str | None) -> tuple[str, str]:
    """The host in lower case and the path as it is; both empty without `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [k if (k := rest.find(c)) >= 0 else len(rest) for c in "/?#"]
    host, path = rest[: min(ends)], rest[min(ends) : min(ends[1:])]
    return lowered(host), path


class Filter:
    """Rules by host, and the automaton of a vocabulary."""

    def __init__(self, rules: Sequence[tuple[str, str, str]], vocabulary: Mapping[str, int], limit: int):
        import ahocorasick

        self.rules: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.rules.setdefault(host, []).append((path, verdict))
        self.limit, self.machine = limit, ahocorasick.Automaton()
        for term, weight in vocabulary.items():
            self.machine.add_word(lowered(term), (lowered(term), weight))
        if vocabulary:
            self.machine.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its verdict."""
        best, verdict, at = None, None, 0
        while host and at >= 0:
            parent = host[at:]
            for start, its in self.rules.get(parent, ()):
                if path.startswith(start) and (best is None or len(parent + start) > len(best)):
                    best, verdict = parent + start, its
            at = host.find(".", at) + 1 or -1
        return best, verdict

    def hits(self, host: str, path: str) -> dict[str, int]:
        """The different terms that stand alone in the address, and their weights."""
        text = lowered(host + path)
        if not len(self.machine):
            return {}
        return {
            term: weight for end, (term, weight) in self.machine.iter(text)
            if not _joins(text[end + 1 : end + 2]) and not _joins(text[max(0, end - len(term)) : end - len(term) + 1])
        }

    def judge(self, url: str | None) -> tuple:
        host, path = host_and_path(url)
        rule, verdict = self.rule(host, path)
        weights = self.hits(host, path).values()
        strict = sum(w >= self.limit for w in weights)
        return host, path, rule, verdict or ("block" if sum(weights) >= self.limit else "allow"), strict, len(weights) - strict


def _joins(neighbour: str) -> bool:
    """Whether a character would make the term part of a longer word."""
    return neighbour.isascii() and neighbour.isalnum() or neighbour > "\x7f"


_FIELDS = [("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()),
           ("strict_terms", pa.int64()), ("soft_terms", pa.int64())]


def _judged(rules, vocabulary, limit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(rules, vocabulary, limit)
        for batch in W.pieces(batches, "url"):
            rows = [own.judge(u) for u in W.column(batch, "url").to_pylist()]
            arrays = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_FIELDS)]
            yield pa.RecordBatch.from_arrays([W.column(batch, "page_id"), *arrays], ["page_id", *[n for n, _ in _FIELDS]])
    return run


def url_verdicts(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, vocabulary: Mapping[str, int] = VOCABULARY,
    limit: int = LIMIT, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_terms, soft_terms for each row of pages.

    Of the rules that fit the longest gives the verdict, of equally long ones the first; without
    one the vocabulary does. strict_terms and soft_terms count different terms in host and path
    (query and fragment are not searched), also where a rule decides. A missing url or one without
    `://` has an empty host and path, no rule and no terms, and is allowed. Rows stand for
    themselves, repeated ones and those without an id too; other columns are not read; an empty
    table gives no rows. Rules and vocabulary go to each task: they are configuration, not data.
    """
    ship(pages.sparkSession)
    urls = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"))
    return urls.mapInArrow(
        _judged(tuple(rules), dict(vocabulary), limit),
        "page_id long, host string, path string, rule string, verdict string, strict_terms long, soft_terms long")


def _sql_list(terms: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALONE = "regexp_matches(address, '(^|[^0-9a-z\\x{80}-\\x{10FFFF}])' || t || '($|[^0-9a-z\\x{80}-\\x{10FFFF}])')"

ORACLE = f"""
WITH split AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages)),
rules(rule_host, rule_path, says) AS (VALUES {", ".join(str(r) for r in RULES)}),
fits AS (
    SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           arg_max(says, length(rule_host || rule_path)) AS says
    FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id),
terms AS (
    SELECT page_id, host, path,
           CAST(len(list_filter({_sql_list(STRICT)}, lambda t: {_ALONE})) AS BIGINT) AS strict_terms,
           CAST(len(list_filter({_sql_list(SOFT)}, lambda t: {_ALONE})) AS BIGINT) AS soft_terms
    FROM (SELECT *, translate(host || path, '{_UPPER}', '{_LOWER}') AS address FROM split))
SELECT terms.page_id, host, path, rule,
       coalesce(says, CASE WHEN strict_terms * {LIMIT} + soft_terms >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_terms, soft_terms
FROM terms LEFT JOIN fits ON terms.page_id = fits.page_id"""
