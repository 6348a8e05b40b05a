"""URL rules by a sort-merge range join.

A rule is a host suffix (whole labels) with a path prefix.  The labels of a host
in reverse order, each closed by a dot, make a key in which a host and all its
subdomains are one interval.  Rules whose paths are equally long form a class;
in a class the path comes before the host key, so a rule is one interval of
``(path, host key)`` and two intervals are nested or apart.  A URL probes each
class of which a rule's path begins its own.

Openings and closings of the rules and the distinct probes are sorted into ranges of
``(class, path, host key)``.  Each range is swept in order: the running sum of openings
less closings is the height of the stack of active rules, and the last opening that
reached a probe's height is the top of the stack there, the longest rule that fits it.
A range starts with the stack as it stands there: the rules opened before it that hold
its first key, found by the key's own prefixes.

Only distinct hosts with the beginnings of their paths are sorted, so a host or URL
that makes up a third of all rows is one probe; every rule is moved once, and rows are
joined to their verdicts by host and path.  The distinct lengths of rule paths, at most
as many as the longest of them has characters, are all that reaches the driver.

Defined results: a null URL, or one without ``://``, has an empty host and path
and no rule.  Of fitting rules the one with the longest host and path together
wins, then the longer host.  Of equal rules a block wins.  Rules with a null
field don't apply.  Each repeated row gets its own result; an empty table of
rules leaves every URL to ``default``.  An input column with the name of the result
(``out_col``) is replaced by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``a.b.c`` becomes ``c.b.a.``, as bytes."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit(".")).cast("binary")


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", out_col: str = "judged") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict`` in a struct ``judged``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block)."""
    kept = [c for c in urls.columns if c.lower() != out_col.lower()]
    rows = urls.select(F.struct(*kept).alias("row"), url_host(F.col(url_col)).alias("u_host"), url_path(F.col(url_col)).alias("u_path"))
    rules = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    )
    won = F.struct((F.char_length("host") + F.char_length("path")).alias("size"), F.char_length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    rules = stored(rules.select(F.char_length("path").alias("size"), F.col("path").alias("part"), host_key(F.col("host")).alias("key"), won.alias("won")))
    sizes = sorted(r[0] for r in rules.select("size").distinct().collect())
    if not sizes:
        return rows.select("row.*", F.struct(F.col("u_host").alias("host"), F.col("u_path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")).alias(out_col))

    # 1. Distinct probes of classes that the path begins with a rule of.
    paths = rules.select(F.col("size").alias("r_size"), F.col("part").alias("r_part")).distinct()
    few = rules.agg(F.sum(F.octet_length("part") + 64)).first()[0] <= BROADCAST_BYTES
    begins = F.array(*[F.struct(F.lit(s).alias("size"), F.expr(f"left(u_path, {s})").alias("part")) for s in sizes])
    tried = rows.select("u_host", "u_path").distinct().select("u_host", "u_path", F.inline(begins))
    tried = stored(tried.join(F.broadcast(paths) if few else paths, (F.col("size") == F.col("r_size")) & (F.col("part") == F.col("r_part")), "left_semi").withColumn("key", host_key(F.col("u_host"))))

    # 2. The sorted sweep, range by range.  Turn 0 opens, 1 probes, 2 closes.
    nothing = F.lit(None).cast(rules.schema["won"].dataType)
    at = lambda turn, key, won: [F.lit(turn).alias("turn"), "size", "part", key.alias("key"), won.alias("won")]
    closed = F.concat("key", F.lit(bytearray(b"\xff")))  # past every key that starts alike
    events = rules.select(*at(0, F.col("key"), F.col("won"))).union(rules.select(*at(2, closed, nothing))).union(tried.select(*at(1, F.col("key"), nothing)).distinct())
    order = ["size", "part", "key", "turn"]
    events = stored(events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    events = events.withColumn("range", F.shiftright("at", 33))
    heads = events.groupBy("range").agg(F.min_by(F.struct("size", "part", "key", "turn"), "at").alias("h"), F.min("at").alias("at"))
    own = F.when(F.col("h.turn") == 2, F.substring("h.key", F.lit(1), F.octet_length("h.key") - 1)).otherwise(F.col("h.key"))
    labels = F.split(own.cast("string"), "\\.")  # the last is empty
    upper = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")).cast("binary"))
    heads = heads.select("range", "at", *[F.col(f"h.{c}").alias(f"h_{c}") for c in order], F.explode(upper).alias("above"))
    heads = heads.filter((F.col("above") != F.col("h_key")) | (F.col("h_turn") > 0))  # a rule that opens with the range isn't open before
    seeds = heads.join(rules, (F.col("h_size") == F.col("size")) & (F.col("h_part") == F.col("part")) & (F.col("above") == F.col("key")))
    # The rows of a range begin with its seeds, outer rules first.
    seeds = seeds.select(F.lit(0).alias("turn"), "size", "part", "key", "won", (F.col("at") - 1).alias("at"), "range", F.octet_length("key").alias("depth"))
    swept = events.withColumn("depth", F.lit(0)).unionByName(seeds)
    place = [F.col("at"), F.col("depth")]
    upto = Window.partitionBy("range").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    swept = swept.withColumn("height", F.sum(1 - F.col("turn")).over(upto))
    level = Window.partitionBy("range", "height").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("turn") == 0, F.col("won")), ignorenulls=True).over(level)
    found = swept.withColumn("top", top).filter("turn = 1 AND height > 0").select(F.col("size").alias("f_size"), F.col("part").alias("f_part"), F.col("key").alias("f_key"), "top")

    # 3. The best of a URL's classes, and back to the rows.
    best = tried.join(found, (F.col("size") == F.col("f_size")) & (F.col("part") == F.col("f_part")) & (F.col("key") == F.col("f_key"))).groupBy("u_host", "u_path").agg(F.max("top").alias("top"))
    best = best.select(F.col("u_host").alias("b_host"), F.col("u_path").alias("b_path"), "top")
    out = rows.join(best, (F.col("u_host") == F.col("b_host")) & (F.col("u_path") == F.col("b_path")), "left")
    return out.select("row", F.struct(F.col("u_host").alias("host"), F.col("u_path").alias("path"), F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict")).alias("_j")).select("row.*", F.col("_j").alias(out_col))
