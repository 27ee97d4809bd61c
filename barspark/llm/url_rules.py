"""URL rules indexed by their rarest literal token.

A rule is a pattern; the regular expression that it stands for, and the literal tokens (runs of letters and digits) without
which that can't hold, are drawn from it. A rule is filed under the one of its tokens that the fewest URLs have; the tokens
of a URL fetch the rules filed under them, and only those are run. Both sides are tables, so neither the rules nor the URLs
need fit anywhere.

In a pattern ``*`` stands for anything, ``^`` for the border of a label or segment (a dot, a slash, an end), ``~`` for the
border of a word (anything but a letter or digit, an end); ``||`` in front is the start of the host or of one of its labels,
``|`` in front or behind an end of the whole. Everything else stands for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9]+"
SCHEMA = "rule string, pattern string, verdict string, scope string, site boolean"
#: Rules without any literal, each of which is tried on every URL, that one pass over the URLs tries.
WITHOUT_LITERAL = 100


@dataclass(frozen=True)
class Rule:
    """``rule``: as reported; ``scope``: host, or place for host and path; ``site``: goes before all that are not."""

    rule: str
    pattern: str
    verdict: str = "block"
    scope: str = "place"
    site: bool = False


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with ``path``."""
    return Rule(f"{host}{path}", f"||{host}{path}", verdict, "place", True)


SITES = (
    site_rule("block", "net", "/"),
    site_rule("allow", "example.net", "/en/"),
    site_rule("block", "example.com", "/de/"),
    site_rule("allow", "org", "/fr/"),
)
#: Words of a host's name that tell what its pages are: adult sites, betting, pills, spam, advertising.
HOST_WORDS = (
    "adult", "porn", "porno", "sex", "xxx", "nude", "escort", "casino", "casinos", "poker", "bet", "bets", "betting", "slots", "jackpot", "pills", "viagra", "cialis",
    "payday", "spam", "warez", "torrent", "ads", "adserver", "adservice", "doubleclick", "tracker", "clickbank",
)
#: Labels and segments of pages without prose: forms, shops, files.
SEGMENTS = (
    "login", "signin", "signup", "register", "cart", "checkout", "porn", "casino", "xxx", "wp-admin", "wp-login", "cgi-bin", "jpg", "jpeg", "png", "gif", "zip", "exe", "mp4",
)
#: Places where a crawl goes round or finds no page of its own: segments that come again, sessions in the path, other forms of a page,
#: downloads at the end; and hosts whose first label begins as those of advertising and counting do.
TRAPS = (
    "^page^*^page^", "^tag^*^tag^", "^category^*^category^", "^calendar^*^calendar^", "^search^*^search^", "*;jsessionid=*", "*^sid=*", "^feed|", "^feed/|", "^rss|", "^print|",
    "^print/|", "^trackback|", "^trackback/|", "^amp|", "^amp/|", "^wp-json^*", "^xmlrpc.php|", "*.pdf|", "*.tar.gz|", "*.mp3|", "*.apk|", "*.iso|", "*.webm|", "^index.php^index.php^",
)
HOST_STARTS = ("|ad.*", "|ads*.*", "|adserv*.*", "|track*.*", "|click*.*", "|pixel*.*", "||banner*.*", "||affiliate*.*")
PLAIN = (
    *(Rule(w, f"~{w}~", scope="host") for w in HOST_WORDS),
    *(Rule(w, f"^{w}^") for w in SEGMENTS),
    *(Rule(t, t) for t in TRAPS),
    *(Rule(h, h, scope="host") for h in HOST_STARTS),
)


def table_of(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.rule, r.pattern, r.verdict, r.scope, r.site) for r in rules], SCHEMA)


def regex_of(pattern: Column) -> Column:
    """The regular expression that a pattern stands for."""
    bare = F.regexp_replace(pattern, r"^\|\|?|\|$", "")
    escaped = F.regexp_replace(bare, r"([.+?$|(){}\[\]\\])", r"\\$1")
    escaped = F.replace(F.replace(escaped, F.lit("^"), F.lit("(?:^|[./]|$)")), F.lit("~"), F.lit("(?:^|[^A-Za-z0-9]|$)"))
    body = F.replace(escaped, F.lit("*"), F.lit("(?s:.*)"))
    front = F.when(pattern.startswith("||"), r"^(?:[^/]*\.)?").when(pattern.startswith("|"), "^").otherwise("")
    return F.concat(front, body, F.when(pattern.rlike(r"[^|]\|$"), r"\z").otherwise(""))


def literals_of(pattern: Column) -> Column:
    """The runs of letters and digits that a match has as whole tokens: those between two other marks than ``*``."""
    return F.array_distinct(F.regexp_extract_all(pattern, F.lit(r"(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])"), F.lit(0)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and where there is no ``://``; A-Z of the host are lowered."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def candidates(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path`` and the fields of each rule that a place's tokens fetch. ``places``: ``host, path, n``, how many URLs have
    them; ``rules``: as in SCHEMA."""
    compiled = rules.select("rule", "verdict", "scope", "site", regex_of(F.col("pattern")).alias("regex"), literals_of(F.col("pattern")).alias("tokens"))
    found = F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(TOKEN), F.lit(0)))
    tokens = places.select("host", "path", "n", F.explode(found).alias("token"))
    wanted = compiled.where(F.size("tokens") > 0).select("*", F.explode("tokens").alias("token")).drop("tokens")
    common = tokens.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum("n").alias("n"))
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")
    filed = wanted.join(common, "token", "left").groupBy("rule", "verdict", "scope", "site", "regex").agg(rarest)
    return tokens.drop("n").join(filed, "token").drop("token")


def judge(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = SITES + PLAIN, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row for each row of ``pages``: id, host, path, ``rule`` (longest site rule that fits, or null), ``verdict``.

    A site rule decides; without one the longest of the other rules that fit; without any the URL is allowed, as are null
    URLs and those without ``://``. Equal URLs are judged once. Of rules of one length one wins, always the same. ``rules``
    may be a table; those of its rules that have no literal come to the driver and are tried on all URLs, WITHOUT_LITERAL of
    them in one pass. Other columns are not read; an empty table gives no row.
    """
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else table_of(spark, rules)
    host, path = host_and_path(F.col("url"))
    cut = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url")).select("id", host.alias("host"), path.alias("path"))
    places = cut.where("host <> '' or path <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))

    def fits(regex: Column, scope: Column) -> Column:
        return F.when(scope == "host", F.rlike("host", regex)).otherwise(F.rlike(F.concat("host", "path"), regex))

    hit = F.struct("rule", "verdict", "site")
    hits = candidates(places, table).where(fits(F.col("regex"), F.col("scope"))).select("host", "path", hit.alias("hit"))
    bare = table.where(F.size(literals_of(F.col("pattern"))) == 0).withColumn("regex", regex_of(F.col("pattern"))).collect()
    for at in range(0, len(bare), WITHOUT_LITERAL):
        tried = [
            F.when(fits(F.lit(r.regex), F.lit(r.scope)), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.site).alias("site")))
            for r in bare[at : at + WITHOUT_LITERAL]
        ]
        hits = hits.unionByName(places.select("host", "path", F.explode(F.array_compact(F.array(*tried))).alias("hit")))
    best = hits.groupBy("host", "path").agg(F.max_by("hit", F.struct("hit.site", F.length("hit.rule"), F.xxhash64("hit.rule", "hit.verdict"))).alias("hit"))
    joined = cut.join(best, ["host", "path"], "left")
    return joined.select(
        "id", "host", "path", F.when(F.col("hit.site"), F.col("hit.rule")).alias("rule"), F.coalesce("hit.verdict", F.lit("allow")).alias("verdict")
    )
