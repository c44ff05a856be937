r"""URL filters: pattern rules, indexed by their rarest literal token.

A pattern is a text in which `*` stands for anything, `^` for a character that is no ASCII letter or digit,
or for an edge, `||` at the start for the start of the host or of a label in it, `|` at the start or the end for
the start or end of the address. The address is what follows the first `://`, its host in small ASCII letters.

A token is a run of ASCII letters and digits. A literal run of a pattern that has a certain end on both
sides (not `*`, not an open edge) is a whole token of every address that the pattern fits. So each rule is
filed under that token of its own which the addresses have most rarely; an address looks up its own tokens
and tries the regular expressions of the rules found there alone. A rule without such a token is tried on
all addresses.

Null urls and urls without `://`: host and path are empty, no rule fits, and the verdict is that of the
default. Repeated rows and null or repeated page_ids keep a row each. An empty table gives no rows. Extra
columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: So many rules are sent to every task; more are joined by a shuffle where Spark deems that better.
BROADCAST_RULES = 100_000
TOKEN = "[0-9A-Za-z]+"
DEFAULT = "allow"


@dataclass(frozen=True)
class UrlRule:
    """`level` 0: the longest fitting rule decides; level 1: looked at where none of level 0 fits, exceptions (allow) first."""

    name: str
    action: str
    pattern: str
    level: int = 1
    ignore_case: bool = True

    def _pieces(self) -> list[str]:
        return re.findall(rf"^\|\||^\||\|$|\*|\^|{TOKEN}|.", self.pattern, re.S)

    @property
    def regex(self) -> str:
        kinds = {"||": r"^(?:[^/?#]*\.)?", "*": ".*", "^": r"(?:^|[^0-9A-Za-z]|\z)"}
        out, pieces = "", self._pieces()
        for k, p in enumerate(pieces):
            if p == "|" and k in (0, len(pieces) - 1):
                out += r"\z" if k else "^"
            else:
                out += kinds.get(p) or re.sub(r"([^0-9A-Za-z])", r"\\\1", p)
        return ("(?is)" if self.ignore_case else "(?s)") + out

    @property
    def tokens(self) -> list[str]:
        """The literal runs between certain ends, small."""
        p = ["", *self._pieces(), ""]
        return sorted({p[k].lower() for k in range(1, len(p) - 1) if re.fullmatch(TOKEN, p[k]) and p[k - 1] not in ("", "*") and p[k + 1] not in ("", "*")})


def site_rule(action: str, site: str) -> UrlRule:
    """A rule for a host with its subdomains and the start of a path, like `example.net/en/`; letters count as they are."""
    return UrlRule(site, action, "||" + site, 0, False)


SITES = [site_rule("block", "net/"), site_rule("allow", "example.net/en/"), site_rule("block", "example.com/de/"), site_rule("allow", "org/fr/")]

#: Patterns of this library for pages that add nothing to a corpus of prose.
PATTERNS = {
    "block": [
        "||ads.", "||ad.", "||adserver.", "||doubleclick.", "||banner.", "||track.", "||tracker.", "||tracking.", "||pixel.", "||analytics.", "||metrics.", "||clicks.",
        "^casino^", "^casinos^", "^poker^", "^slots^", "^jackpot^", "^bets^", "^betting^", "^lottery^", "^roulette^",
        "^pills^", "^pharmacy^cheap", "^viagra^", "^cialis^", "^weight-loss^", "^payday^loan", "^replica^watch", "^essay^writing^", "^backlinks^", "^link-farm^", "^spam^", "^warez^", "^keygen^", "^torrent^", "^torrents^",
        "^adult^", "^xxx^", "^porn^", "^nude^", "^escort^", "^escorts^", "^sexcams^",
        "/wp-login.php", "/wp-admin/", "/cgi-bin/", "/xmlrpc.php", "/signin^", "/login^", "/logout^", "/register^", "/checkout^", "/cart^", "/basket^", "/unsubscribe^", "/print^", "/share^", "/feed|", "/rss|", "/amp|", "/trackback|",
        "^sessionid=", "^phpsessid=", "^jsessionid=", "^replytocom=", "^sid=", "^sort=", "^orderby=",
        ".jpg|", ".jpeg|", ".png|", ".gif|", ".svg|", ".css|", ".js|", ".zip|", ".gz|", ".exe|", ".dmg|", ".apk|", ".mp3|", ".mp4|", ".avi|", ".iso|", ".woff|", ".ttf|",
        "*.onion^", "^data:*;base64,",
    ],
    "allow": ["^casino-royale^", "/login^help^", "/wiki/*poker^", "^adult^education^", "^adult^literacy^", "^spam^filter^", "/print^shop^", "/register^office^"],
}
RULES = SITES + [UrlRule(p, action, p) for action, patterns in PATTERNS.items() for p in patterns]


def rule_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    """A row for each rule; a list of millions can be given as a table of the same columns instead."""
    row = lambda r: F.struct(*[F.lit(v).alias(k) for k, v in (("name", r.name), ("action", r.action), ("level", r.level), ("regex", r.regex))], F.array(*map(F.lit, r.tokens)).cast("array<string>").alias("tokens"))
    return spark.range(1).select(F.inline(F.array(*map(row, rules))))


def _small(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and address of a url."""
    host = _small(F.regexp_extract(url, "://([^/?#]*)", 1))
    rest = F.regexp_extract(url, "(?s)://[^/?#]*(.*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit("")), F.coalesce(F.concat(host, rest), F.lit(""))


def _tokens(address: Column) -> Column:
    """What an address looks up: its distinct tokens, and the empty one, under which rules without a token are filed."""
    return F.array_append(F.array_distinct(F.regexp_extract_all(_small(address), F.lit(TOKEN), F.lit(0))), F.lit(""))


def rarest_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rules with `token`, the rarest of theirs among `tokens` (ties: the least); one that never occurs is rarest."""
    filed = rules.select("name", "action", "level", "regex", F.explode_outer("tokens").alias("token"))
    wanted = filed.select("token").where("token is not null").distinct()
    counts = tokens.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = filed.join(counts, "token", "left").groupBy("name", "action", "level", "regex").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("token"))
    return ranked.select("name", "action", "level", "regex", F.coalesce("token", F.lit("")).alias("token"))


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule (of level 0, else null), verdict and `pattern` (the rule of level 1 that decided, else null).

    Fits are found where the pages are read. They are gathered by address (combined before the shuffle)
    before they meet the pages again, so an address that many pages share is one row on that side."""
    host, path, address = parts(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"), address.alias("address"))
    tokens = read.where("address != ''").select("address", F.explode(_tokens(F.col("address"))).alias("token"))
    index = rarest_index(rules, tokens)
    index = F.broadcast(index) if rules.count() <= BROADCAST_RULES else index
    fits = tokens.join(index, "token").where(F.rlike("address", F.col("regex")))
    longest = F.when(F.col("level") == 0, F.struct(F.length("name").alias("length"), F.col("name").alias("name"), F.col("action").alias("action")))
    first = F.when(F.col("level") == 1, F.struct("action", "name"))  # `allow` is less than `block`
    found = fits.groupBy("address").agg(F.max(longest).alias("site"), F.min(first).alias("own"))
    verdict = F.coalesce(F.col("site.action"), F.col("own.action"), F.lit(DEFAULT))
    out = read.join(found, "address", "left")
    return out.select("page_id", "host", "path", F.col("site.name").alias("rule"), verdict.alias("verdict"), F.when(F.col("site").isNull(), F.col("own.name")).alias("pattern"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _first_own(action: str) -> str:
    """The least fitting pattern of an action, without any index."""
    tried = ", ".join(f"CASE WHEN regexp_matches(address, {_sql_text(r.regex)}) THEN {_sql_text(r.name)} END" for r in sorted(RULES, key=lambda r: r.name) if r.level == 1 and r.action == action)
    return f"coalesce({tried})"


_SITE_CASES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r.name}'" for r in sorted(SITES, key=lambda r: -len(r.name)) for h, _, p in [r.name.partition("/")]
)

#: Sites by comparing hosts and paths; every pattern is tried on every address.
OP13_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '(?s)://[^/?#]*(.*)', 1), '') AS rest FROM pages
), a AS (SELECT *, host || rest AS address FROM p
), j AS (SELECT *, CASE {_SITE_CASES} END AS rule, {_first_own("allow")} AS allowed, {_first_own("block")} AS blocked FROM a)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({", ".join(_sql_text(r.name) for r in SITES if r.action == "allow")}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN allowed IS NOT NULL THEN 'allow' WHEN blocked IS NOT NULL THEN 'block' ELSE '{DEFAULT}' END AS verdict,
  CASE WHEN rule IS NULL THEN coalesce(allowed, blocked) END AS pattern
FROM j
"""
