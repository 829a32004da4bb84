"""How far the sources of a language differ in their words.

Counting is an Arrow compute pipeline inside mapInArrow: ascii_lower, split_pattern_regex, dictionary_encode and a hash group_by per slice of texts. Slices merge into partial
counts that a task sends on whenever they reach `PARTIAL` rows, so memory is bounded and the shuffle carries (language, source, term) with counts, not words.

Terms that occur in enough documents of their language are kept. Each group's smoothed share of a term is an exact integer. Terms of a language are
dealt to shards of `SHARD` terms; each shard becomes a dense table (sources x terms) in which all pairs of sources are subtracted, and the shards' sums
add up to the divergences. Terms that neither source has count too, as their smoothed shares differ. A language that holds most rows has more shards, not larger
ones; a shard grows with the number of sources, whose pairs are the result itself.

Defined results: NULL text, language and source are read as empty strings; repeated rows and ids count once each; a group without terms takes part with
count 0 everywhere; a language without kept terms has pairs of value 0 and no term rows; a language with one source has no pairs; an empty table
gives no rows. Ties go to the smaller item by its UTF-8 bytes. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.llm.common import stored

BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  #: everything that is no term: ASCII but for letters
LEAST_DOCS = 30
SMOOTH = 5
UNIT = 1_000_000_000
TOP = 50
SHARD = 2048
PARTIAL = 200_000  #: rows of partial counts
SLICE = 4 << 20  #: bytes of text that are split at once

KEYS = ["lang", "source", "term"]


def _counts(part: pa.RecordBatch) -> pa.Table:
    """lang, source, term, docs, n of a few rows."""
    words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(part.column("text"), "")), BREAKS)
    row, term = pc.list_parent_indices(words), pc.list_flatten(words)
    full = pc.not_equal(term, "")
    code = pc.dictionary_encode(term.filter(full))
    by_row = pa.table({"row": row.filter(full), "code": code.indices}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    row = by_row["row"].combine_chunks()
    groups = {k: pc.dictionary_encode(pc.fill_null(part.column(k), "")) for k in ("lang", "source")}
    t = pa.table({"lang": groups["lang"].indices.take(row), "source": groups["source"].indices.take(row), "code": by_row["code"], "n": by_row["count_all"]})
    t = t.group_by(["lang", "source", "code"], use_threads=False).aggregate([("n", "count"), ("n", "sum")])
    return pa.table({**{k: groups[k].dictionary.take(t[k].combine_chunks()) for k in groups}, "term": code.dictionary.take(t["code"].combine_chunks()), "docs": t["n_count"], "n": t["n_sum"]})


def _merged(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(KEYS, use_threads=False).aggregate([("docs", "sum"), ("n", "sum")])
    return t.select([*KEYS, "docs_sum", "n_sum"]).rename_columns([*KEYS, "docs", "n"])


def _slices(batch: pa.RecordBatch):
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = int(size[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + SLICE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _partial(batches):
    held, rows = [], 0
    for batch in batches:
        for part in _slices(batch):
            held.append(_counts(part))
            rows += held[-1].num_rows
            if rows > PARTIAL:
                held = [_merged(held)]
                rows = held[0].num_rows
                if rows > PARTIAL // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from _merged(held).to_batches()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * terms)) without rounding, whatever the size of the counts."""
    top = (n + SMOOTH).cast("decimal(28,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", top, (total + terms * SMOOTH).cast("decimal(28,0)")) + 1


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, lang_n: occurrences in the group and in the language, of terms in at least `least_docs` documents of the language."""
    kinds = docs.select(F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))
    partial = kinds.mapInArrow(_partial, "lang string, source string, term string, docs bigint, n bigint")
    counts = partial.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    w = Window.partitionBy("lang", "term")  # a row per source
    every = counts.select(*KEYS, "n", F.sum("docs").over(w).alias("docs"), F.sum("n").over(w).alias("lang_n"))
    return every.where(F.col("docs") >= least_docs).drop("docs")


def _distances(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of |p - q| over the terms of a shard, for every ordered pair of sources. `groups` has each source with its share of a term it lacks."""
    names = groups["source"].combine_chunks()
    none = groups["none"].to_numpy()
    code = pc.dictionary_encode(terms["term"].combine_chunks())
    p = np.repeat(none[:, None], len(code.dictionary), axis=1)
    p[pc.index_in(terms["source"].combine_chunks(), names).to_numpy(), code.indices.to_numpy()] = terms["p"].to_numpy()
    k = np.arange(len(names))
    value = [np.abs(p - p[i]).sum(1)[k != i] for i in k]
    a, b = np.repeat(k, len(k) - 1), np.concatenate([np.zeros(0, int), *[k[k != i] for i in k]])
    return pa.table({"source": names.take(pa.array(a)), "item": names.take(pa.array(b)), "value": pa.array(np.concatenate([np.zeros(0, np.int64), *value]))})


def audited(docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS, shard: int = SHARD) -> DataFrame:
    """lang, source, part, item, value, rank. `pair`: the summed distance to each other source of the language; `term`: the `top` terms
    that the source has more often than its language."""
    counts = stored(term_counts(docs, least_docs), "term-counts")
    terms = counts.groupBy("lang").agg(F.countDistinct("term").alias("terms"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total")).join(terms, "lang")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct()
    groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left") \
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "terms", "lang_total")])
    groups = stored(groups.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("terms") / shard)).cast("int")), "groups")

    known = counts.join(groups, ["lang", "source"]).select(
        *KEYS, share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
        F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    known = stored(known, "shares")
    lacking = F.when(F.col("terms") > 0, share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms"))).otherwise(0).cast("bigint")
    sides = groups.select("lang", "source", lacking.alias("none"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def one(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        t = _distances(left, right)
        return t.add_column(0, "lang", pa.array([key[0].as_py()] * t.num_rows, pa.string()))

    sums = known.groupBy("lang", "shard").cogroup(sides.groupBy("lang", "shard")).applyInArrow(one, "lang string, source string, item string, value bigint")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    more = known.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by).alias("rank")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select("*", rank).select(*columns) \
        .unionByName(more.withColumn("part", F.lit("term")).select("*", rank).where(F.col("rank") <= top).select(*columns))
