"""URL filters [native]: rules indexed by their rarest literal token.

Each rule is a regular expression. The literal tokens that every URL it fits must contain are found from its syntax
(``literals``): runs of letters and digits that stand whole between other characters, outside alternatives that can do
without them. The corpus says how often each of those tokens occurs; a rule is filed under its rarest one. A URL's own
tokens fetch the rules filed under them, and only those run their regular expression. A rule without such a token is
filed under the empty token, which every URL has. Everything is DataFrame functions.

Two classes of rules share the index: list rules (host and path prefix, the longest wins) and pattern rules (any
expressions), which decide where no list rule fits. A URL that nothing fits is allowed.

Defined results: a null URL, or one without ``://``, has an empty host and path and is allowed; rows keep their
multiplicity (a repeated row appears again, with the same verdict); between list rules of one length, and between pattern
rules of one length, the greater text wins; columns other than the id and URL are dropped; an empty table gives an empty
result, and an empty list of rules allows all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as op  # the names of the parts that the parser of the standard library gives
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rules up to this many are broadcast, and with them the tokens that are counted; more are joined by shuffle, salted for
#: the rules. A rule takes well under 1 KB.
BROADCAST_RULES = 50_000
#: Parts that each token is dealt over when the rules are shuffled.
SALTS = 32

#: Words that mark a host as unwanted when they are a whole label or a whole hyphenated part of one.
BLOCKED_WORDS = ["adult", "betting", "bets", "casino", "jackpot", "malware", "phishing", "poker", "porn", "spam", "viagra", "warez", "xxx"]


#: Paths of click counters, advertisement servers and unwanted downloads.
BLOCKED_PATHS = [
    r"/(?:ads?|adserver|banners?)/(?:click|count|view)[./?]",
    r"/affiliate/click(?:/|$)",
    r"/wp-content/uploads/.*\.(?:exe|scr)$",
    r"/cgi-bin/(?:counter|redirect)\.(?:pl|cgi)$",
]


@dataclass(frozen=True)
class Rule:
    """``rank`` orders classes (list rules 1, patterns 0), ``length`` orders rules inside one. Expressions are in the dialect
    that Java and Python share; they are searched for in ``.host/path``."""

    name: str
    verdict: str
    regex: str
    rank: int
    length: int


_EDGE = None  # in a run of literals: a place where no letter or digit can be


def _is_edge(items: Iterable) -> bool:
    """Whether a character class has ASCII characters only, and none that is a letter or a digit."""
    chars = []
    for kind, value in items:
        if kind is op.LITERAL:
            chars.append(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < 128:
            chars += map(chr, range(value[0], value[1] + 1))
        else:
            return False
    return bool(chars) and all(c.isascii() and not c.isalnum() for c in chars)


def _runs(tree, out: list) -> None:
    """Appends to ``out`` what every match has in this order: characters, ``_EDGE``, and 0 for what is not known; sets of
    tokens stand for alternatives that have them in common."""
    for kind, value in tree:
        if kind is op.LITERAL:
            out.append(chr(value))
        elif kind is op.IN:
            out.append(_EDGE if _is_edge(value) else 0)
        elif kind is op.AT:
            if value in (op.AT_BEGINNING, op.AT_BEGINNING_STRING, op.AT_END_STRING, op.AT_END):
                out.append(_EDGE)
        elif kind is op.SUBPATTERN:
            _runs(value[3], out)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            inner: list = []
            _runs(value[2], inner)
            if inner == [_EDGE]:
                out.append(_EDGE)
            else:
                out += [0, _tokens_of(inner), 0]
        elif kind is op.BRANCH:
            every = []
            for branch in value[1]:
                inner = []
                _runs(branch, inner)
                every.append(_tokens_of(inner))
            out += [0, set.intersection(*every), 0]
        elif kind is op.ATOMIC_GROUP:
            _runs(value, out)
        elif kind not in (op.ASSERT, op.ASSERT_NOT):
            out.append(0)
        elif kind is op.ASSERT and value[0] > 0:
            if all(len(b) == 1 and (b[0][0] is op.IN and _is_edge(b[0][1]) or b[0][0] is op.LITERAL and not chr(b[0][1]).isalnum() or b[0][0] is op.AT and b[0][1] is op.AT_END) for b in _branches(value[1])):
                out.append(_EDGE)


def _branches(tree) -> list:
    return list(tree[0][1][1]) if len(tree) == 1 and tree[0][0] is op.BRANCH else [tree]


def _tokens_of(run: list) -> set[str]:
    found, token, whole = set(), "", False
    for x in [*run, 0]:
        if isinstance(x, set):
            found |= x
            x = 0
        if isinstance(x, str) and x.isascii() and x.isalnum():
            token += x
            continue
        edge = x is _EDGE or isinstance(x, str) and x.isascii()
        if token and whole and edge:
            found.add(token.lower())
        token, whole = "", edge
    return found


def literals(regex: str) -> tuple[str, ...]:
    """Whole tokens (letters and digits in lower case) of every text that the expression is found in. None for syntax that
    is not understood."""
    try:
        tree = _parser.parse(regex)
    except (re.error, OverflowError):
        return ()
    if tree.state.flags & re.VERBOSE:
        return ()
    run: list = []
    _runs(tree, run)
    return tuple(sorted(_tokens_of(run)))


def list_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains where the URL's path starts with ``path``."""
    text = host + path
    end = "" if path else "(?=/|$)"
    return Rule(text, verdict, rf"^[^/]*\.{re.escape(text)}{end}", 1, len(text))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """Fits a host that has ``word`` between dots, hyphens or its ends."""
    return Rule(word, verdict, rf"^[^/]*[.\-]{re.escape(word)}(?=[.\-/]|$)", 0, len(word))


def path_rule(regex: str, verdict: str = "block") -> Rule:
    """Fits a URL whose path has the expression."""
    return Rule(regex, verdict, rf"^[^/]*(?=/).*?(?:{regex})", 0, len(regex))


def default_patterns() -> list[Rule]:
    return [word_rule(w) for w in BLOCKED_WORDS] + [path_rule(r) for r in BLOCKED_PATHS]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    rows = [(r.name, r.verdict, r.regex, list(literals(r.regex)) or [""], r.rank, r.length) for r in rules]
    schema = "name string, verdict string, regex string, tokens array<string>, rank int, length int"
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in schema.split(", ")])
    return common.inline(spark, rows, ["name", "verdict", "regex", "tokens", "rank", "length"])


def _tokens(target: Column) -> Column:
    """Of a URL: its tokens, and the empty one (the target begins with a dot)."""
    return F.array_distinct(F.split(F.lower(target), "[^a-z0-9]+"))


def index(urls: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """Each rule with ``token``, the one of its tokens that the fewest URLs have (ties: the smaller text)."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode(_tokens(F.col("target"))).alias("token"))
    if n_rules <= BROADCAST_RULES:
        seen = seen.join(F.broadcast(wanted), "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count("*").alias("n"))
    each = rules.withColumn("token", F.explode("tokens")).join(counts, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")
    return each.groupBy("name", "verdict", "regex", "rank", "length").agg(rarest)


def candidates(urls: DataFrame, indexed: DataFrame, n_rules: int) -> DataFrame:
    """A row for each URL and rule filed under one of its tokens."""
    seen = urls.withColumn("token", F.explode(_tokens(F.col("target"))))
    if n_rules <= BROADCAST_RULES:
        return seen.join(F.broadcast(indexed), "token")
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)))
    dealt = indexed.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return seen.join(dealt, ["token", "salt"])


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: id, host, path, rule (of the list rules), verdict, pattern (of the pattern rules)."""
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    n_rules = table.count() if isinstance(rules, DataFrame) else len(rules)
    host, path = host_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("target", F.concat(F.lit("."), "host", "path"))
    hits = candidates(urls, index(urls, table, n_rules), n_rules).filter(F.regexp_like("target", F.col("regex")))
    best = lambda rank: F.max(F.when(F.col("rank") == rank, F.struct("length", "name", "verdict")))
    won = hits.groupBy("id", "url").agg(best(1).alias("listed"), best(0).alias("matched"))
    won = won.select(F.col("id").alias("won_id"), F.col("url").alias("won_url"), "listed", "matched")
    same = F.col("id").eqNullSafe(F.col("won_id")) & F.col("url").eqNullSafe(F.col("won_url"))
    return urls.join(won, same, "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("listed.name").alias("rule"),
        F.coalesce("listed.verdict", "matched.verdict", F.lit("allow")).alias("verdict"), F.col("matched.name").alias("pattern"),
    )
