"""URL filters: pattern rules indexed by their rarest literal token.

Each pattern rule is a regular expression with the literal tokens that any match must hold: whole runs of [a-z0-9] in the
lower-cased URL. Rules are a table of any size. Each is filed under the one of its tokens that the fewest of the URLs to be
judged hold, counted over all of them; the distinct tokens of each distinct URL fetch candidate rules by an equi-join
with that index, and only those candidates run their expression. Host and path rules, which are few, need no
expression: they are compared with the host's end and the path's start.

Defined cases: null URLs and URLs without ``://`` have empty host and path, match no host rule, and get the default
verdict unless a pattern finds its token. Ties between pattern rules go to ``allow``, then to the first name. Rows with
a null key, and repeated rows, are rows like others; extra columns are left out; URLs of any length are read whole; a
rule without tokens is never fetched; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HostRule:
    """``allow`` or ``block`` for a host with its subdomains, and paths that start with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased URL; ``tokens`` are [a-z0-9]+ runs that every match holds."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]


HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)

#: Words from which the pattern rules are made.
_BAIT = ("adult", "ads", "bonus", "casino", "cheap", "crack", "download", "escort", "free", "hot", "instant", "loan", "lottery", "poker", "spam", "viagra")
_HOOK = ("bets", "cash", "chat", "codes", "deals", "farm", "games", "keygen", "loans", "movies", "pills", "slots", "track", "win", "x")
_PRIVATE = ("account", "admin", "basket", "cart", "checkout", "login", "logout", "password", "register", "signin", "signup", "unsubscribe")
_SESSION = ("jsessionid", "phpsessid", "session", "sessionid", "sid", "token")
_PAGED = ("p", "page", "pg", "start")


def pattern_rules() -> tuple[PatternRule, ...]:
    """The rules by default: hosts or paths of two such words are bait; private pages and sessions are blocked; numbered
    pages are let through."""
    rules = [PatternRule(f"bait-{a}-{b}", "block", rf"[/.-]{a}-{b}[./-]", (a, b)) for a in _BAIT for b in _HOOK]
    rules += [PatternRule(f"private-{w}", "block", rf"/{w}([/?#.]|$)", (w,)) for w in _PRIVATE]
    rules += [PatternRule(f"session-{w}", "block", rf"[?&;]{w}=[0-9a-f]{{8,}}([&#]|$)", (w,)) for w in _SESSION]
    return (*rules, *(PatternRule(f"paged-{w}", "allow", rf"[?&]{w}=[0-9]+([&#]|$)", (w,)) for w in _PAGED))


PATTERN_RULES = pattern_rules()


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def _host_rule(host: Column, path: Column, rules: tuple[HostRule, ...]) -> Column:
    """The longest fitting rule as struct(rule, action), or null. Rules are few: one expression, no join."""
    best = F.lit(None).cast("struct<rule:string,action:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.action == "allow", r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        best = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"))).otherwise(best)
    return best


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit("([a-z0-9]+)"), F.lit(1)))


RULES = "name string, action string, regex string, tokens array<string>"


def rule_table(spark: SparkSession, rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """Pattern rules as a table, the form that ``judge`` takes; rules by the million come from files."""
    return spark.createDataFrame([(r.name, r.action, r.regex, list(r.tokens)) for r in rules], RULES)


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, name, action, regex): each rule filed under the token of its literals that the fewest URLs hold."""
    literal = rules.select("name", "action", "regex", F.explode(F.array_distinct("tokens")).alias("token"))
    held = urls.select(F.explode(url_tokens(F.col("_url"))).alias("token"))
    counts = held.join(literal.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    return literal.join(counts, "token", "left").groupBy("name", "action", "regex").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))


def judge(pages: DataFrame, host_rules: tuple[HostRule, ...] = HOST_RULES, patterns: DataFrame | None = None, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: key, host, path, rule, verdict, pattern (the deciding pattern rule's name or null).

    patterns: a table (name, action, regex, tokens); by default ``PATTERN_RULES``. Each distinct URL that no host rule
    decides meets the index once.
    """
    rules = rule_table(pages.sparkSession) if patterns is None else patterns
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", _host_rule(F.col("host"), F.col("path"), host_rules))
    open_urls = rows.where("_rule is null and _url is not null").select("_url").distinct()
    fetched = open_urls.select("_url", F.explode(url_tokens(F.col("_url"))).alias("token")).join(rule_index(open_urls, rules), "token")
    hits = fetched.where(F.regexp_like(F.lower("_url"), F.col("regex")))
    first = hits.groupBy("_url").agg(F.min(F.struct((F.col("action") != "allow").alias("blocks"), "name")).alias("_hit"))
    rows = rows.join(first, "_url", "left").withColumn("_hit", F.when(F.col("_rule").isNull(), F.col("_hit")))
    by_pattern = F.when(F.col("_hit").isNull(), F.lit(default)).when(F.col("_hit.blocks"), "block").otherwise("allow")
    return rows.select(F.col("_key").alias(key), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.action"), by_pattern).alias("verdict"), F.col("_hit.name").alias("pattern"))
