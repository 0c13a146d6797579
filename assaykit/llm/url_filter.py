"""Allow and block lists of URL prefixes: a blocked Bloom filter in front of an exact hash join.

A listed entry is a canonical host and a path prefix. It fits its host and every subdomain, if the path starts
with the entry's; of several that fit, the longest decides. The candidates of a url are therefore its host
suffixes, each with the prefixes of its path that have the length of some entry's path for just that host.

Plan: urls -> distinct (host, path) -> candidates (explode) -> filter (its bits are packed in a few arrays, which are
broadcast, so that what it rules out is never exchanged) -> exact hash join on the key -> longest entry per (host,
path) -> join back to the rows. Above ``filter_bytes`` the filter isn't broadcast but left out: a filter that has to be
joined costs as much as the exact join that it should spare. DataFrame functions only.

Defined cases: a null url, or one without ``://``, has an empty host and path and gets the default verdict;
repeated rows are judged alike; of a very long host only as many labels are looked at as a listed host has, which is
exact; a very long path is looked at in the listed lengths only; an empty list gives every row the default verdict, an
empty table no rows; other columns, whatever their names, are kept unless they clash with those added, which win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import cut, free_name, named, small_side

#: A block is eight words of 32 bits; a key sets one bit in each.
WORDS = 8
#: Blocks in a row of the packed filter.
PACKED = 512
ADDED = ("host", "path", "rule", "verdict")


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host follows the first ``://``, in lower case; both are empty for null or without it."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    host = _lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("long")


def _bits(key: Column) -> list[Column]:
    """For each word of a block, an int with the key's bit: five bits of one hash choose it."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter's rows: pack long, words array<int> of PACKED blocks, in order, with zeros where no key is."""
    at = _block(F.col("key"), blocks) * WORDS
    some = keys.select(F.explode(F.array(*[F.struct((at + i).alias("at"), b.alias("word")) for i, b in enumerate(_bits(F.col("key")))])).alias("x")).select("x.at", "x.word")
    words = PACKED * WORDS
    every = keys.sparkSession.range(-(-blocks // PACKED) * words).select(F.col("id").alias("at"), F.lit(0).alias("word"))
    merged = some.unionByName(every).groupBy("at").agg(F.bit_or("word").alias("word"))
    packed = merged.groupBy(F.floor(F.col("at") / words).cast("long").alias("pack")).agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    return packed.select("pack", F.transform("words", lambda w: w["word"]).alias("words"))


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    url: str = "url",
    default: str = "allow",
    keys_per_block: int = 16,
    filter_bytes: int = 64 << 20,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict.

    rules: host, path, verdict ("allow" or "block"). keys_per_block sets the filter's size: 256 bits for that
    many listed keys. The filter is used up to filter_bytes; the list is broadcast only up to broadcast_rows rows, beyond
    that its joins shuffle.
    """
    listed = (
        rules.select(_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .where(F.col("rule_host").isNotNull())
        .groupBy("rule_host", "rule_path")
        .agg(F.min("rule_verdict").alias("rule_verdict"))  # of contradictory entries, allow wins
        .withColumn("key", F.concat("rule_host", F.lit(" "), "rule_path"))
    )
    # Lengths of the paths listed for a host; the hosts, keyed, are part of the filter's keys too.
    hosts = listed.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths")).withColumn("key", F.concat(F.lit("host "), "rule_host"))
    listed, hosts = cut(listed), cut(hosts)
    n_keys, labels_at_most = listed.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(F.split("rule_host", r"\.", -1))), F.lit(1))).first()
    blocks = max(1, (n_keys * 2 + keys_per_block - 1) // keys_per_block)
    filtered = blocks * WORDS * 4 <= filter_bytes
    bloom = F.broadcast(cut(bloom_filter(listed.select("key").unionByName(hosts.select("key")), blocks))) if filtered else None

    def possible(candidates: DataFrame) -> DataFrame:
        """The rows whose key the Bloom filter doesn't rule out."""
        if not filtered:
            return candidates
        block = _block(F.col("key"), blocks)
        begin = (F.pmod(block, F.lit(PACKED)) * WORDS).cast("int")
        test = F.lit(True)
        for i, b in enumerate(_bits(F.col("key"))):
            test = test & (F.get("words", begin + i).bitwiseAND(b) != 0)
        return candidates.withColumn("pack", F.floor(block / PACKED).cast("long")).join(bloom, "pack").where(test).drop("pack", "words")

    host, path = url_parts(F.col(url))
    kept = pages.drop(*ADDED)
    h, p, best = (free_name(kept, name) for name in ("host_of_url", "path_of_url", "best"))
    parted = kept.withColumns({h: host, p: path})
    distinct = parted.select(F.col(h).alias("host"), F.col(p).alias("path")).distinct()
    labels = F.split("host", r"\.", -1)
    # A suffix of more labels than any listed host has can't be listed.
    first = F.greatest(F.lit(1), F.size(labels) - labels_at_most + 1)
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    by_host = possible(distinct.withColumn("suffix", F.explode(suffixes)).withColumn("key", F.concat(F.lit("host "), "suffix")))
    known = by_host.drop("key").join(small_side(hosts.select("rule_host", "lengths"), broadcast_rows), F.col("suffix") == F.col("rule_host"))
    prefixed = known.withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path")))).withColumn("prefix", F.expr("substring(path, 1, n)"))
    by_path = possible(prefixed.withColumn("key", F.concat("suffix", F.lit(" "), "prefix")).select("host", "path", "key"))
    exact = by_path.join(small_side(listed, broadcast_rows), "key")
    rule = F.concat("rule_host", "rule_path")
    decided = exact.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), F.col("rule_verdict").alias("verdict")), F.struct(F.length(rule), rule)).alias("found"))
    decided = decided.select(F.struct("host", "path", "found.rule", "found.verdict").alias(best))
    joined = parted.join(decided, (F.col(h) == F.col(f"{best}.host")) & (F.col(p) == F.col(f"{best}.path")), "left")
    return joined.select(*named(kept), F.col(h).alias("host"), F.col(p).alias("path"), F.col(f"{best}.rule").alias("rule"), F.coalesce(f"{best}.verdict", F.lit(default)).alias("verdict"))
