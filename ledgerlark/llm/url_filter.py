"""URL filter: pattern rules indexed by their rarest literal token.

The literal tokens that any url must hold to fit a rule are read off its regular expression. The rule is filed under
the rarest of them (rules without any apart); a url is cut into tokens, each token fetches the rules filed under it,
and only those run their regular expressions. Host and path rules are filed the same way, under their host: a url asks for its own host and
each parent domain. Work per url depends on its tokens, not on the number of rules, and nothing is shuffled.

Patterns are read with ``re._parser``, the standard library's own, of CPython 3.11 to 3.13: a token is only taken
where its parse says for sure that every fitting url has it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .columns import ascii_lower, fresh, q

#: Host, path prefix, verdict.
HOST_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_TOKEN = re.compile("[a-z0-9]+")


#: Letters of other alphabets that a pattern which ignores case takes for these.
_FOLDED = str.maketrans("ſı", "si")


def _parts(code: int) -> bool:
    """Whether a character parts tokens, whatever its case: ASCII, and no letter or digit."""
    return code < 128 and not chr(code).isalnum()


def _closed(items: list, i: int, step: int) -> bool:
    """Whether what stands at place ``i`` of a parsed pattern, read in the direction ``step``, surely parts a token from its neighbour."""
    if not 0 <= i < len(items):
        return False
    op, arg = items[i]
    inner = lambda sub: _closed(list(sub), 0 if step > 0 else len(sub) - 1, step)
    if op is _parser.LITERAL:
        return _parts(arg)
    if op is _parser.IN:
        return all(kind is _parser.LITERAL and _parts(x) for kind, x in arg)
    if op is _parser.SUBPATTERN:
        return inner(arg[-1])
    if op is _parser.BRANCH:
        return all(inner(x) for x in arg[1])
    if op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
        return inner(arg[2]) and (arg[0] > 0 or _closed(items, i + step, step))
    return op is _parser.AT and arg is not _parser.AT_NON_BOUNDARY


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """Alphanumeric runs that every fitting url has as whole tokens: literals of the pattern, in lower case, with a sure end on both sides."""
    items, found, run = list(_parser.parse(pattern)), [], ""
    for i, (op, arg) in enumerate([*items, (None, None)]):
        if op is _parser.LITERAL and _TOKEN.fullmatch(chr(arg).lower()):
            run += chr(arg).lower()
            continue
        if run and _closed(items, i - len(run) - 1, -1) and _closed(items, i, 1):
            found.append(run)
        run = ""
    return tuple(found)


@dataclass(frozen=True)
class PatternRule:
    """``pattern``, flags included, runs on the lower-cased url; its verdict is block, or allow: a url that an allow rule fits is never blocked."""

    pattern: str
    verdict: str = "block"


def read_rules(spark: SparkSession, path: str) -> list[PatternRule]:
    """Rules of a text file, one a line: verdict, white space, pattern. Empty lines and those that begin with # are left out."""
    lines = [r["value"].strip() for r in spark.read.text(path).collect()]
    return [PatternRule(*line.split(None, 1)[::-1]) for line in lines if line and not line.startswith("#")]


#: Words that a host of a kind of page has which a training corpus leaves out: advertising and counting, gambling, adult, medicines by mail, and pirated or forged goods.
HOST_WORDS = (
    "ads adserver adclick adtrack banners popads popunder sponsored doubleclick track tracker tracking pixel beacon clickstat counters "
    "bets betting bookmaker casino casinos jackpot lottery poker roulette slots "
    "porn porno sex sexcam sexchat xxx nude escort hentai camgirls milf "
    "pills viagra cialis steroids pharma-online "
    "warez torrents cracked keygen serials replica-watches fake-ids"
).split()
#: Pages of no text of their own: what a path ends in (as patterns), and arguments that make the same page again.
PATH_ENDS = (r"wp-login\.php", r"wp-admin\.php", r"xmlrpc\.php", "phpmyadmin")
SESSION_KEYS = ("sessionid", "phpsessid", "jsessionid", "sid")
PATTERN_RULES = [
    *[PatternRule(rf"://(?:[^/?#]*[.-])?{w}(?:[.-]|$)") for w in HOST_WORDS],
    PatternRule(r"://(?:[^/?#]*[.-])?adult-(?:videos?|chat)(?:[.-]|$)"),
    PatternRule(r"://(?:[^/?#]*[.-])?cheap-(?:pills|meds)(?:[.-]|$)"),
    *[PatternRule(rf"/{x}(?:[?#]|$)") for x in PATH_ENDS],
    *[PatternRule(rf"[?&;]{x}=[0-9a-f]{{16}}") for x in SESSION_KEYS],
]


def pattern_index(rules: list[PatternRule]) -> dict[str, list[tuple[re.Pattern, str]]]:
    """Rules by the one of their tokens that fewest rules name (the longer, then the smaller, among equals); those without any under the empty text."""
    tokens = [literal_tokens(r.pattern) for r in rules]
    named = Counter(t for own in tokens for t in set(own))
    index = defaultdict(list)
    for rule, own in zip(rules, tokens, strict=True):
        index[min(own, key=lambda t: (named[t], -len(t), t), default="")].append((re.compile(rule.pattern), rule.verdict))
    return dict(index)


def host_index(rules: list[tuple[str, str, str]]) -> dict[str, list[tuple[str, str]]]:
    """Path and verdict of the rules of each host, longest path first."""
    index = defaultdict(list)
    for host, path, verdict in sorted(rules, key=lambda r: -len(r[1])):
        index[host].append((path, verdict))
    return dict(index)


def longest_rule(host: str, path: str, index: dict[str, list[tuple[str, str]]]) -> tuple[str | None, str | None]:
    """The rule (as host then path) and verdict of the longest fit, asking for the host and each parent domain."""
    best: tuple[str | None, str | None] = (None, None)
    at = 0
    while at >= 0 and host:
        name = host[at:]
        for prefix, verdict in index.get(name, ()):
            if path.startswith(prefix):
                if best[0] is None or len(name) + len(prefix) > len(best[0]):
                    best = (name + prefix, verdict)
                break
        at = host.find(".", at) + 1 or -1
    return best


def pattern_verdict(url: str, index: dict[str, list[tuple[re.Pattern, str]]]) -> str:
    """``block`` if a fetched rule that says so fits and none that says allow, else ``allow``. Rules without a token are always fetched."""
    low = url.lower()
    fetched = [rule for token in dict.fromkeys(["", *_TOKEN.findall(low if low.isascii() else low.translate(_FOLDED))]) for rule in index.get(token, ())]
    fits = {verdict for verdict in {v for _, v in fetched} if any(v == verdict and p.search(low) for p, v in fetched)}
    return "block" if fits == {"block"} else "allow"


def judge_urls(df: DataFrame, url_col: str = "url", host_rules: list[tuple[str, str, str]] = HOST_RULES, pattern_rules: list[PatternRule] = PATTERN_RULES) -> DataFrame:
    """Every row of ``df`` with ``host, path, rule, verdict`` added (renamed if ``df`` has such names).

    A host rule fits its host and all subdomains if the path starts with the rule's; the longest wins and gives the
    verdict. Other urls get the pattern rules' verdict: block if one fits, else allow.

    Defined cases: a null url or one without ``://`` has empty host and path, so no host rule fits it; pattern rules
    still see it, and a null is allowed. Repeated rows are judged one by one; an empty table gives an empty result.
    """
    hosts, patterns = host_index(host_rules), pattern_index(pattern_rules)
    host, path, rule, verdict, told = fresh(df, "host", "path", "rule", "verdict", "told")

    @F.pandas_udf("rule string, verdict string")
    def told_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for urls, names, paths in batches:
            found = [(longest_rule(h, p, hosts), u or "") for u, h, p in zip(urls, names, paths, strict=True)]
            yield pd.DataFrame([(r, v or pattern_verdict(u, patterns)) for (r, v), u in found], columns=["rule", "verdict"], dtype=object)

    part = r"://([^/?#]*)([^?#]*)"
    url = F.coalesce(q(url_col), F.lit(""))
    out = df.select("*", ascii_lower(F.regexp_extract(url, part, 1)).alias(host), F.regexp_extract(url, part, 2).alias(path))
    out = out.withColumn(told, told_of(q(url_col), q(host), q(path)))
    return out.select(*[q(c) for c in df.columns], q(host), q(path), q(told)["rule"].alias(rule), q(told)["verdict"].alias(verdict))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).drop("url")


def _sql() -> str:
    fits = "\n    ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for h, p, _ in sorted(HOST_RULES, key=lambda r: -len(r[0] + r[1]))
    )
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in HOST_RULES)
    pattern = "|".join(f"(?:{r.pattern})" for r in PATTERN_RULES).replace("'", "''")
    return f"""
WITH u AS (
  SELECT page_id, lower(coalesce(url, '')) AS low,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages), r AS (
  SELECT *, CASE {fits} END AS rule FROM u)
SELECT page_id, host, path, rule,
       coalesce(CASE rule {verdicts} END, CASE WHEN regexp_matches(low, '{pattern}') THEN 'block' ELSE 'allow' END) AS verdict
FROM r
"""


ORACLE_SQL = _sql()
