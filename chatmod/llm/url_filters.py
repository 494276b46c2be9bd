"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame operations only.

A rule (host, path, action) fits its host and all subdomains, for addresses whose path starts with the rule's
path; ``*`` in a path stands for any run of characters and an empty host for any host. A literal token is a run of
letters and digits that every fitting address holds as a whole token. Tokens are counted over all addresses, and
every rule is filed under the one that occurs least (a rule without any under ""). The tokens of an address fetch
their rules, and only those run as regular expressions. The longest fitting rule decides (ties: the smaller rule
text, then block), else ``default`` does.

Skew: only tokens that rules are filed under are joined, by a broadcast of the index while it is at most
``INDEX_ROWS`` rows (beyond that as a shuffle join, split by AQE); the best rule of an address is a maximum, combined
in every task before its shuffle, so an address or host of a third of all rows is one row per task.

Defined cases: an address that is null or without ``://`` has empty host and path and only fits rules without host;
null host or path of a rule counts as empty, a rule without action is ignored; rows that repeat are judged alike;
no rules or no rows give the default or no rows; other columns pass through, but host, path, rule and verdict are
replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmod.session import bounded_broadcast

INDEX_ROWS = 100_000
_TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str | Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; "" without."""
    rest = F.regexp_extract(F.coalesce(url if isinstance(url, Column) else F.col(url), F.lit("")), r"\A[\s\S]*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; "" without ``://``."""
    return F.regexp_extract(F.coalesce(url if isinstance(url, Column) else F.col(url), F.lit("")), r"\A[\s\S]*?://[^/?#]*([^?#]*)", 1)


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, f"(?:(?!{_TOKEN})[\\s\\S])+"), lambda t: t != ""))


def _literal(text: Column) -> Column:
    """``text`` as a regular expression in which only ``*`` is special."""
    return F.regexp_replace(F.regexp_replace(text, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", r"\\$1"), r"\\\*", r"[\\s\\S]*")


def compile_rules(rules: DataFrame) -> DataFrame:
    """(rule, action, regex, literals) of every distinct rule. The regular expression is for host, ``/`` and path in a row
    (a host holds no ``/``); literals are the tokens that every fitting address holds."""
    clean = rules.where("action is not null").select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("h"),
                                                     F.coalesce("path", F.lit("")).alias("p"), "action").distinct()
    # a token beside a wildcard, or at the end of a path, may go on in an address
    whole = F.regexp_replace(F.regexp_replace("p", rf"{_TOKEN}*\*(?:{_TOKEN}|\*)*", "*"), rf"{_TOKEN}+\z", "")
    any_host = F.when(F.col("h") == "", F.lit("[^/]*")).otherwise(F.concat(F.lit(r"(?:[^/]*\.)?"), _literal(F.regexp_replace("h", r"\*", ""))))
    return clean.select(F.concat("h", "p").alias("rule"), "action", F.concat(F.lit(r"\A"), any_host, F.lit("/"), _literal(F.col("p"))).alias("regex"),
                        _tokens(F.concat_ws("/", "h", whole)).alias("literals"))


def index_rules(compiled: DataFrame, addresses: DataFrame, index_rows: int = INDEX_ROWS) -> DataFrame:
    """(token, rule, action, regex): every rule under its token that occurs in the fewest rows of ``addresses`` (address)."""
    literals = compiled.select(F.explode("literals").alias("token")).distinct()
    seen = addresses.select(F.explode(_tokens(F.col("address"))).alias("token"))
    counts = seen.join(bounded_broadcast(literals, index_rows), "token").groupBy("token").agg(F.count("*").alias("n"))
    by_token = compiled.select("rule", "action", "regex", F.explode_outer("literals").alias("token"))
    rated = by_token.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    least = F.min(F.struct("n", F.coalesce("token", F.lit("")).alias("token"))).alias("least")
    return rated.groupBy("rule", "action", "regex").agg(least).select("least.token", "rule", "action", "regex")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", index_rows: int = INDEX_ROWS) -> DataFrame:
    """``pages`` with host, path, rule (the text of the longest fitting rule, else null) and verdict (its action, else ``default``)."""
    address = F.concat(host_of(url_col), F.lit("/"), path_of(url_col))
    addresses = pages.select(address.alias("address"))
    index = index_rules(compile_rules(rules), addresses, index_rows)
    asked = addresses.select("address", F.explode(F.array_append(_tokens(F.col("address")), F.lit(""))).alias("token"))
    fits = asked.join(bounded_broadcast(index, index_rows), "token").where(F.regexp_like("address", F.col("regex")))
    # the longest rule, then the smaller text, then block before allow
    best = fits.groupBy("address").agg(F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), _descending("rule"), "action")).alias("__best"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.withColumns({"__address": address, "__host": host_of(url_col), "__path": path_of(url_col)})
    rows = rows.join(best.withColumnRenamed("address", "__address"), "__address", "left")
    return rows.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"),
                       F.coalesce("__best.action", F.lit(default)).alias("verdict"))


def _descending(text: str) -> Column:
    """Orders rule texts of one length from large to small: the code points' complements."""
    return F.transform(F.split(text, ""), lambda c: -F.ascii(c))


def keep_allowed(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``pages`` whose verdict is not block, unchanged."""
    names: Sequence[str] = pages.columns
    tagged = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(url_col).alias("__url"))
    return judge(tagged, rules, "__url", default).where("verdict <> 'block'").select("__row.*")
