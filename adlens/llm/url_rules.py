"""URL verdicts from pattern rules that are indexed by their rarest literal token.

Two kinds of rules exist. A site rule names a host and a path, fits that host and its
subdomains, and the longest fitting one decides. Where none fits, filter patterns decide:
``*`` stands for any text, ``^`` for a separator (anything but a letter or digit) or an end,
``|`` at an end of the pattern for that end of the URL; again the longest one decides.

A rule is filed under one of its literal tokens (runs of letters and digits that cannot be
part of a longer run in a matching URL), the one that the fewest URLs of the table have.
The tokens of a URL fetch its candidate rules; only their expressions run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"

# ---- fixed values: site rules and filter patterns
SITE_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
FILTERS = (
    ("block", "^ads^"),
    ("block", "^adserver^"),
    ("block", "^banner^"),
    ("block", "^bets^"),
    ("block", "^casino^"),
    ("block", "^lottery^"),
    ("block", "^payday^"),
    ("block", "^pills^"),
    ("block", "^poker^"),
    ("block", "^porn^"),
    ("block", "^spam^"),
    ("block", "^tracker^"),
    ("block", "^viagra^"),
    ("block", "^xxx^"),
)


@dataclass(frozen=True)
class Rule:
    """A rule as written, its verdict, its expression and the tokens it can be filed under."""

    text: str
    verdict: str
    expression: str
    tokens: tuple[str, ...]


def site_rule(verdict: str, text: str) -> Rule:
    """Rule over ``host + path``; the path is compared as it stands, the host in lower case."""
    host, slash, path = text.partition("/")
    expression = r"^(?:[^/]*\.)?" + re.escape(host.lower() + slash + path)
    inner = [m for m in re.finditer(TOKEN, text.lower())]
    # the last run may go on in the URL unless something follows it in the rule
    safe = tuple(m.group() for m in inner if m.end() < len(text))
    return Rule(text, verdict, expression, safe)


def filter_rule(verdict: str, text: str) -> Rule:
    """Rule over the whole URL in lower case."""
    body = text.lower()
    start, end = body.startswith("|"), body.endswith("|")
    body = body[start : len(body) - end]
    parts = {"*": ".*", "^": "(?:[^a-z0-9]|^|$)"}
    expression = ("^" if start else "") + "".join(parts.get(c, re.escape(c)) for c in body) + ("$" if end else "")
    safe = []
    for m in re.finditer(TOKEN, body):
        left = body[m.start() - 1] if m.start() else ("|" if start else "*")
        right = body[m.end()] if m.end() < len(body) else ("|" if end else "*")
        if left != "*" and right != "*":
            safe.append(m.group())
    return Rule(text, verdict, expression, tuple(safe))


def _token_counts(pages: DataFrame, url_col: str, wanted: set[str]) -> dict[str, int]:
    """URLs that have each token of the rules; one number per token comes back."""
    if not wanted:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url_col)), F.lit(TOKEN), F.lit(0)))
    known = F.array(*[F.lit(t) for t in sorted(wanted)])
    rows = pages.select(F.explode(F.array_intersect(tokens, known)).alias("t")).groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in rows}


def build_index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest token, and the rules that have no safe token and always run."""
    index: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return index, always


def _ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without ``://``."""
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return _ascii_lower(host), path


class Matcher:
    """Judges URLs one after another with the indexed rules."""

    def __init__(self, rules: list[Rule], index: dict[str, list[int]], always: list[int]):
        self.rules, self.index, self.always = rules, index, always
        self.expressions = [re.compile(r.expression, re.S) for r in rules]

    def best(self, text: str) -> Rule | None:
        """The longest rule that matches; of equally long ones the first by text."""
        candidates = {i for token in set(re.findall(TOKEN, text.lower())) for i in self.index.get(token, ())}
        hits = [self.rules[i] for i in {*candidates, *self.always} if self.expressions[i].search(text)]
        return min(hits, key=lambda r: (-len(r.text), r.text, r.verdict), default=None)


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", site_rules=SITE_RULES, filters=FILTERS,
    default: str = "allow",
) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` (the site rule or NULL) and ``verdict`` of every row.

    A URL that is NULL or has no ``://`` has an empty host and path, so no site rule fits;
    filters see a NULL URL as an empty text. Without any match the verdict is ``default``.
    Rules are parameters of the job and go to every task; repeated rows stay repeated,
    other columns are not looked at, an empty table gives an empty table.
    """
    sites = [site_rule(v, t) for v, t in site_rules]
    patterns = [filter_rule(v, t) for v, t in filters]
    counts = _token_counts(pages, url_col, {t for r in [*sites, *patterns] for t in r.tokens})
    plan = [(sites, *build_index(sites, counts)), (patterns, *build_index(patterns, counts))]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        by_site, by_filter = (Matcher(*x) for x in plan)
        for batch in batches:
            out = []
            for value in batch.column(1):
                url = value.as_py()
                host, path = split_url(url)
                site = by_site.best(host + path)
                other = None if site else by_filter.best((url or "").lower())
                chosen = site or other
                out.append((host, path, site.text if site else None, chosen.verdict if chosen else default))
            columns = [pa.array([r[k] for r in out], type=pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "host", "path", "rule", "verdict"])

    found = rows.mapInArrow(run, f"id {id_type}, host string, path string, rule string, verdict string")
    return found.withColumnRenamed("id", id_col)
