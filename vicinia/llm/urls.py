"""URL rules by hashed expressions, in DataFrame functions only.

A rule is a host and a path: it fits its host and all subdomains, where the URL's path starts with the
rule's. Every URL is expanded into expressions: each suffix of its host by whole labels, with each prefix
of its path that ends in ``/`` (and the empty one). The expressions meet the rules in two steps:

1. by the first 32 bits of a digest, which names the *stems* that rules have (host and path up to the last
   ``/``) and how many more characters of path the rules of a stem take;
2. by the full SHA-256 of host and path of the rule. What only shared the short prefix falls out here.

Of all rules that fit, the longest (in characters of host and path) decides; of equally long ones that with
the longer host; of two verdicts of one rule ``block``.

Scale: rules are measured before they are broadcast; beyond ``broadcast_bytes`` both steps are shuffled joins
whose rule side is copied to ``SPLITS`` keys, so that an expression held by a third of all URLs (``org/``) is
dealt over as many tasks. URLs are expanded once per distinct (host, path) and ``SPLITS`` hash part of the row
ID: equal URLs combine before the shuffle, and a hot URL is joined back over as many keys. Expansions go no
deeper than the deepest rule.

Defined results: a null URL and one without ``://`` have an empty host and path and no rule. Empty tables of
pages give no rows; without rules every verdict is the default. Repeated rows and null IDs are kept one by one.
Rules with a null host or a verdict other than ``allow`` and ``block`` are left out; a null path is an empty one.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of the short prefix: 32 bits.
PREFIX_DIGITS = 8
#: Tables of rules up to this size are broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes a broadcast rule takes beside its text: digests and row overhead.
RULE_BYTES = 200
SPLITS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column | str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column | str) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column | str) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _count(text: str, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(F.col(text), F.lit(mark), F.lit("")))


def _folder(path: Column) -> Column:
    """The path up to its last slash."""
    return F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)))


def _prefix(stem: Column) -> Column:
    return F.left(F.sha2(stem, 256), F.lit(PREFIX_DIGITS))


def prepared(rules: DataFrame) -> DataFrame:
    """``rules(host, path, verdict)`` → one row per rule: ``digest, rule, rule_host, verdict, prefix, more, ...``."""
    rows = rules.select(
        F.translate("host", _UPPER, _LOWER).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
        "verdict",
    ).where(F.col("rule_host").isNotNull() & F.col("verdict").isin("allow", "block"))
    rows = rows.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    folder = _folder(F.col("rule_path"))
    rule = F.concat("rule_host", "rule_path")
    return rows.select(
        F.sha2(rule, 256).alias("digest"),
        rule.alias("rule"),
        "rule_host",
        "verdict",
        _prefix(F.concat("rule_host", folder)).alias("prefix"),
        (F.length("rule_path") - F.length(folder)).alias("more"),
        _count("rule_path", "/").alias("depth"),
        (_count("rule_host", ".") + 1).alias("labels"),
    )


def expressions(urls: DataFrame, labels: int, depth: int) -> DataFrame:
    """A row per host suffix of at most ``labels`` labels and path prefix of at most ``depth`` slashes."""
    hosts = F.explode(F.sequence(F.lit(1), F.least(_count("host", ".") + 1, F.lit(labels))))
    paths = F.explode(F.sequence(F.lit(0), F.least(_count("path", "/"), F.lit(depth))))
    rows = urls.withColumn("h", hosts).withColumn("p", paths)
    suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("h"))
    folder = F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), F.col("p")), F.lit("/"))
    rows = rows.withColumns({"suffix": suffix, "folder": F.when(F.col("p") > 0, folder).otherwise("")})
    return rows.withColumn("prefix", _prefix(F.concat("suffix", "folder"))).drop("h", "p")


def judge(
    pages: DataFrame,
    rules: DataFrame,
    *,
    row_id: str = "page_id",
    url: str = "url",
    keep: Sequence[str] = (),
    default: str = "allow",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``row_id``, columns ``keep``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``pages``."""
    listed = prepared(rules)
    size = listed.agg(
        F.count(F.lit(1)).alias("n"), F.max("labels").alias("labels"), F.max("depth").alias("depth"),
        F.sum(2 * F.octet_length("rule")).alias("bytes"),
    ).first()
    names = [row_id, *keep]
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.col(url).alias("url"))
    part = F.pmod(F.xxhash64("k0"), F.lit(SPLITS)).cast("int")
    rows = rows.select(
        *[f"k{i}" for i in range(len(names))], host_of("url").alias("host"), path_of("url").alias("path"), part.alias("part")
    )
    if not size["n"]:
        found = rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    else:
        small = size["bytes"] + RULE_BYTES * size["n"] <= broadcast_bytes
        urls = rows.select("host", "path", "part").distinct()
        found = rows.join(_fitting(urls, listed, size["labels"], size["depth"], small), ["host", "path", "part"], "left")
    return found.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "host", "path", "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )


def _fitting(urls: DataFrame, rules: DataFrame, labels: int, depth: int, small: bool) -> DataFrame:
    """The deciding rule of each of ``urls(host, path, part)`` that has one."""
    stems = rules.groupBy("prefix").agg(F.collect_set("more").alias("mores"))
    full = rules.select("digest", "rule", "rule_host", "verdict")
    asked = expressions(urls, labels, depth)
    on = []
    if small:
        stems, full = F.broadcast(stems), F.broadcast(full)
    else:
        on = ["split"]
        asked = asked.withColumn("split", F.pmod(F.hash("host", "path", "part"), F.lit(SPLITS)))
        copies = F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1)))
        stems, full = stems.withColumn("split", copies), full.withColumn("split", copies)
    likely = asked.join(stems, ["prefix", *on]).withColumn("more", F.explode("mores"))
    taken = F.length("folder") + F.col("more")
    likely = likely.where(taken <= F.length("path"))
    likely = likely.withColumn("digest", F.sha2(F.concat("suffix", F.left("path", taken)), 256))
    fits = likely.select("host", "path", "part", "digest", *on).join(full, ["digest", *on])
    best = F.max(F.struct(F.length("rule"), F.length("rule_host"), "verdict", "rule")).alias("best")
    return fits.groupBy("host", "path", "part").agg(best).select(
        "host", "path", "part", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")
    )
