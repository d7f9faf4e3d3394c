"""Operator 12: allow and block rules for URLs by host suffixes and path prefixes.

A rule (host, path, verdict) fits a URL whose host is the rule's or a subdomain of
it and whose path starts with the rule's.  A URL's expressions are its host suffixes,
each followed by its path prefixes; a rule's expression is its host followed by its
path.  The two meet in an equi-join on the first 32 bits of their SHA-256, the whole
digests are compared behind it, and the longest rule found decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import cut, written

#: Hex digits of a digest that the join is made on.
SHORT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")


def host_of(url: str = "url") -> Column:
    """What follows the first ``://`` up to a slash, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: str = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def filed(rules: DataFrame) -> DataFrame:
    """``digest, short, rule, labels, letters, block``: one row for each host and path.

    ``labels`` counts the host's labels, ``letters`` those of the path.  A null path counts
    as empty.  Rules without a host or with another verdict than allow or block are left
    out; of rules for the same host and path, block wins.
    """
    host, path = F.translate("host", _UPPER, _LOWER), F.coalesce("path", F.lit(""))
    r = rules.where("verdict in ('allow', 'block') and host <> ''").select(
        host.alias("h"), path.alias("p"), (F.col("verdict") == "block").alias("block"))
    r = r.groupBy("h", "p").agg(F.max("block").alias("block"))
    digest = F.sha2(F.concat("h", "p").cast("binary"), 256)
    return r.select(digest.alias("digest"), F.substring(digest, 1, SHORT).alias("short"), F.concat("h", "p").alias("rule"),
                    F.size(F.split("h", "\\.")).alias("labels"), F.length("p").alias("letters"), "block")


def _expression(host: Column, path: Column, labels, letters) -> Column:
    """Digest of the host's last labels and the path's first letters; null where the URL has fewer."""
    suffix = F.substring_index(host, ".", -labels)
    # a host of fewer labels is its own suffix, which the next smaller number gives already
    has = (suffix != F.substring_index(host, ".", 1 - labels)) if labels > 1 else (host != "")
    whole = F.sha2(F.concat(suffix, F.substring(path, 1, letters)).cast("binary"), 256)
    return F.when(has & (F.length(path) >= letters), whole)


def _of_letters(host: Column, path: Column, labels: int):
    return lambda letters: _expression(host, path, labels, letters)


def _digest_is(digest: Column):
    return lambda entry: entry["digest"] == digest


def _rank(entry: Column, size: Column, labels: Column) -> Column:
    return F.struct(size.alias("size"), labels.alias("labels"), entry["block"].alias("block"), entry["rule"].alias("rule"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", most_rules: int = 100_000,
          most_shapes: int = 32, most_rows: int = 1_000_000) -> DataFrame:
    """All columns of ``pages`` with ``host, path, rule, verdict`` (columns of these names are replaced).

    Of the rules that fit, the one with the longest host and path together decides; among
    equally long ones the one with more host labels, then block.  ``rule`` is its host followed by its path,
    null where none fits; the verdict is then ``default``.

    Only expressions as long as some rule's are made: one for each pair of (labels, path
    letters) among the rules.  Up to ``most_rules`` rules of ``most_shapes`` such pairs are
    broadcast (both are counted first) and looked up where the rows are, without a
    shuffle.  Beyond that the expressions go out as rows and meet the rules by shuffle;
    what more than ``most_rows`` expressions share is looked up once and its few
    findings are broadcast, so no task gets all rows of a frequent host.

    A null URL or one without ``://`` has an empty host and path, which no rule fits.
    Empty labels and ports are part of the host as they stand.  Repeated rows are judged
    each; very long URLs are read whole.  No rules: every row gets ``default``.  An empty
    table gives no rows.
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    base = pages.select(F.struct(*kept).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    book = cut(filed(rules))
    n_rules = book.count()
    # one small row for each distinct (labels, letters), however many rules there are
    shapes = [tuple(s) for s in book.select("labels", "letters").distinct().orderBy("labels", "letters").collect()]
    if n_rules <= most_rules and len(shapes) <= most_shapes:
        judged = _looked_up(base, book, shapes)
    else:
        judged = _by_shuffle(base, book, shapes, most_rows)
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.block"), "block").otherwise("allow")
    return judged.select("row.*", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def _looked_up(base: DataFrame, book: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """``row, host, path, best`` by one broadcast join for each shape: rows stay where they are."""
    entries = F.collect_list(F.struct("digest", "rule", "block"))
    out, found = base, []
    for i, (labels, letters) in enumerate(shapes):
        mine = book.where((F.col("labels") == labels) & (F.col("letters") == letters))
        mine = F.broadcast(mine.groupBy("short").agg(entries.alias(f"e{i}")).withColumnRenamed("short", f"s{i}"))
        out = out.withColumn(f"d{i}", _expression(F.col("host"), F.col("path"), labels, letters))
        out = out.join(mine, F.substring(f"d{i}", 1, SHORT) == F.col(f"s{i}"), "left")
        hit = F.get(F.filter(f"e{i}", _digest_is(F.col(f"d{i}"))), F.lit(0))
        out = out.withColumn(f"m{i}", hit).drop(f"d{i}", f"s{i}", f"e{i}")
        entry = F.col(f"m{i}")
        found.append(F.when(entry.isNotNull(), _rank(entry, F.length(entry["rule"]), F.lit(labels))))
    none = F.lit(None).cast("struct<size:int,labels:int,block:boolean,rule:string>")
    best = F.array_max(F.array(*found)) if found else none
    return out.select("row", "host", "path", best.alias("best"))


def _by_shuffle(base: DataFrame, book: DataFrame, shapes: list[tuple[int, int]], most_rows: int) -> DataFrame:
    """``row, host, path, best`` for rules of any number; a row number brings findings back to their page."""
    # written, so that the numbers stay what they are
    base = written(base.withColumn("row_no", F.monotonically_increasing_id()), "url-rows")
    host, path = F.col("host"), F.col("path")
    by_labels: dict[int, list[int]] = {}
    for labels, letters in shapes:
        by_labels.setdefault(labels, []).append(letters)
    parts = [F.transform(F.array(*map(F.lit, lengths)), _of_letters(host, path, labels)) for labels, lengths in by_labels.items()]
    digest = F.explode(F.array_compact(F.concat(*parts)))
    out = base.select("row_no", digest.alias("d")).withColumn("s", F.substring("d", 1, SHORT))
    out = written(out, "url-expressions")
    hot = cut(out.groupBy("s").count().where(F.col("count") > most_rows).select(F.col("s").alias("hot")))  # few: each has many rows
    entry = F.struct("rule", "block")
    book = book.select("short", "digest", "labels", entry.alias("entry"))
    often = book.join(F.broadcast(hot), F.col("short") == F.col("hot"), "left_semi")  # at most one a frequent expression, and collisions
    same = (F.col("s") == F.col("short")) & (F.col("d") == F.col("digest"))
    seldom = out.join(F.broadcast(hot), F.col("s") == F.col("hot"), "left_anti").join(book, same)
    met = seldom.select("row_no", "entry", "labels").unionByName(
        out.join(F.broadcast(often), same).select("row_no", "entry", "labels"))
    ranked = _rank(F.col("entry"), F.length("entry.rule"), F.col("labels"))
    best = met.groupBy("row_no").agg(F.max(ranked).alias("best")).withColumnRenamed("row_no", "n_")
    return base.join(best, F.col("row_no") == F.col("n_"), "left").select("row", "host", "path", "best")
