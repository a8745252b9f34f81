"""URL filters: pattern rules indexed by their rarest literal token.

A rule's regular expression is known to match only URLs that hold all of its literal tokens
(runs of ``[a-z0-9]``). The tokens of all URLs are counted, every rule is filed under its
token with the fewest URLs, and a URL's tokens fetch the rules filed under them; only those
run their expression. Ties go to the longer token, then the alphabet. Host and path rules
come first: the longest that fits gives the verdict, else a matching pattern rule blocks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): fixed by the contract of the query.
HOST_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Words that tell what a site is for wherever they stand in its host between dots and hyphens.
HOST_WORDS = (
    "porn", "porno", "porntube", "pornhub", "sexcam", "sexcams", "sextube", "camgirls", "hentai", "xvideos", "escorts", "upskirt",
    "casino", "casinos", "poker", "roulette", "blackjack", "baccarat", "sportsbook", "sportsbooks", "bookmaker", "bookmakers",
    "viagra", "cialis", "levitra", "xanax", "tramadol", "phentermine",
    "warez", "keygen", "keygens", "serialz", "crackz", "phishing", "malware", "spyware",
    "popunder", "popunders", "adserver", "adservers", "clickfraud",
)
#: (first words, second words): a host with both, joined by a hyphen, is of that kind; either alone says nothing.
HOST_PHRASES = (
    (("cheap", "buy", "order", "discount", "online", "generic"), ("pills", "meds", "drugs", "pharmacy", "steroids", "painkillers")),
    (("payday", "quick", "instant", "fast", "easy"), ("loan", "loans", "cash", "money")),
    (("cheap", "buy", "discount", "replica"), ("replicas", "watches", "handbags", "followers", "backlinks", "essays")),
    (("free", "live", "hot", "adult"), ("sex", "cams", "webcams", "nudes", "girls", "dating", "hookups")),
    (("best", "free", "online", "win", "real"), ("slots", "jackpot", "betting", "bets", "gambling", "lottery")),
    (("free", "full", "cracked"), ("cracks", "serials", "torrents", "downloads", "software")),
)
#: Hosts that serve advertisements and count visitors.
AD_HOSTS = (
    "2mdn.net", "adcolony.com", "adform.net", "adnxs.com", "adsrvr.org", "advertising.com", "amazon-adsystem.com", "casalemedia.com",
    "criteo.com", "criteo.net", "doubleclick.net", "exoclick.com", "googleadservices.com", "googlesyndication.com", "moatads.com",
    "openx.net", "outbrain.com", "popads.net", "propellerads.com", "pubmatic.com", "quantserve.com", "rubiconproject.com",
    "scorecardresearch.com", "taboola.com", "trafficjunky.net", "zedo.com",
)
#: Folders that hold copied software, if a download follows.
COPY_FOLDERS = ("torrent", "torrents", "warez", "keygens", "cracks", "serials")
#: names of rules that are not their words
_NAMES = {"doubleclick.net": "doubleclick"}


def _tokens(text: str) -> tuple[str, ...]:
    return tuple(re.findall("[a-z0-9]+", text))


def general_rules() -> list[tuple[str, tuple[str, ...], str]]:
    """(name, literal tokens, expression on the lower-cased URL) of the rules that the lists above make.

    A token must be bounded by characters other than [a-z0-9] wherever the expression matches.
    """
    inside, below = r"://([^/?#]*[.-])?", r"://([^/?#]*\.)?"
    rules = {
        "casino-win": (("casino", "win"), below + r"casino-win\."),
        "adult": (("xxx",), inside + "xxx[.-]"),
        "pills": (("pills", "cheap"), inside + "cheap-pills[.-]"),
        "loans": (("loans",), inside + "(payday|quick)-loans[.-]"),
    }
    rules |= {word: ((word,), f"{inside}{word}[.-]") for word in HOST_WORDS}
    for firsts, seconds in HOST_PHRASES:
        rules |= {f"{one}-{two}": ((one, two), f"{inside}{one}-{two}[.-]") for one in firsts for two in seconds}
    for host in AD_HOSTS:
        rules[_NAMES.get(host, host)] = (_tokens(host), f"{below}{re.escape(host)}([/:?#]|$)")
    for folder in COPY_FOLDERS:
        rules[folder] = ((folder, "download"), f"/{folder}/[^?#]*/download([/?#]|$)")
    return [(name, literals, expression) for name, (literals, expression) in rules.items()]


PATTERN_RULES = tuple(general_rules())
#: URLs with a common token are spread over this many groups by their hash.
SALTS = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = HOST_RULES) -> Column:
    """The longest fitting rule as ``struct<rule, verdict>``; null if none fits.

    Equally long rules: the first in the alphabet.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(
    pages: DataFrame,
    host_rules: Sequence[tuple[str, str, str]] = HOST_RULES,
    pattern_rules: Sequence[tuple[str, Sequence[str], str]] | DataFrame = PATTERN_RULES,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` for every row of ``pages``.

    ``pattern_rules`` is a list of (name, literal tokens, expression), or a table of any size with the columns
    pattern, literals, expression; rules without a token or an expression match nothing, one that repeats counts once.

    ``pattern`` is the name (the first in the alphabet) of the pattern rules that match, or
    null. A null URL, or one without ``://``, has an empty host and path; pattern rules see its
    whole text. Repeated rows and repeated or null ``page_id`` keep their own rows, as URLs and
    not pages are matched. An empty table gives an empty one.
    """
    spark = pages.sparkSession
    own = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    urls = own.where(F.col("url").isNotNull()).select("url").distinct()
    tokens = urls.select(
        "url", F.explode(F.array_distinct(F.regexp_extract_all(F.translate("url", _UPPER, _LOWER), F.lit("[a-z0-9]+"), 0))).alias("token")
    )
    rules = pattern_rules
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(
            [(name, list(literals), expression) for name, literals, expression in rules],
            "pattern string, literals array<string>, expression string",
        )
    literals = rules.where(F.col("expression").isNotNull()).select("pattern", "expression", F.explode("literals").alias("token"))
    seen = tokens.join(literals.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    index = (
        literals.join(seen, "token", "left")
        .groupBy("pattern", "expression")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), -F.length("token"), "token")).alias("rarest"))
        .select("pattern", "expression", F.col("rarest.token").alias("token"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    matched = (
        tokens.withColumn("salt", F.pmod(F.hash("url"), F.lit(SALTS)))
        .join(index, ["token", "salt"])
        .where(F.regexp_like(F.translate("url", _UPPER, _LOWER), F.col("expression")))
        .groupBy("url")
        .agg(F.min("pattern").alias("pattern"))
    )
    found = own.join(matched, "url", "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return (
        found.withColumns({"host": host, "path": path})
        .withColumn("_rule", host_rule(F.col("host"), F.col("path"), host_rules))
        .select(
            "page_id", "host", "path",
            F.col("_rule.rule").alias("rule"),
            F.coalesce("_rule.verdict", F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")).alias("verdict"),
            "pattern",
        )
    )


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The query in DuckDB's SQL."""
    rules = " UNION ALL ".join(f"SELECT {_sql_text(v)} AS verdict, {_sql_text(h)} AS h, {_sql_text(p)} AS p" for v, h, p in HOST_RULES)
    patterns = ", ".join(f"({_sql_text(n)}, {_sql_text(e)})" for n, _, e in PATTERN_RULES)
    return f"""
WITH rules AS ({rules}), patterns(pattern, expression) AS (VALUES {patterns}),
u AS (SELECT row_number() OVER () AS i, page_id, url,
  translate(coalesce(regexp_extract(url, '^(?:.|\\n)*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
  coalesce(regexp_extract(url, '^(?:.|\\n)*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
best AS (SELECT i, arg_min(h || p, (-length(h || p), h || p)) AS rule, arg_min(verdict, (-length(h || p), h || p)) AS verdict
  FROM u, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i),
m AS (SELECT i, min(pattern) AS pattern FROM u, patterns
  WHERE regexp_matches(translate(url, '{_UPPER}', '{_LOWER}'), expression) GROUP BY i)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern
FROM u LEFT JOIN best USING (i) LEFT JOIN m USING (i)"""
