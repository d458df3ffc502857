"""Operator 3: n-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are the different shingle sets (documents with equal sets are one row,
linked with each other), columns are shingles. Pairs with 100 * overlap >= 80 * union are the
entries of the product of the matrix with its transpose that reach a bound that the sizes give:

* sizes differ by a factor of 0.8 at most, so a block of the product is one column and one class of
  sizes with its neighbours;
* in any one order of all columns, a linked pair shares one of the first n - ceil(0.8 n) + 1
  entries of both rows, so only these are multiplied. Columns are in hash order, those that many
  rows have last, so common passages make no products unless a row holds little else (which columns
  are common is counted over all texts, in units of some millions of entries each);
* an entry in one of two sets only flips one of ``PARITIES`` parity bits at most, so the bits that
  differ bound the sum of both sizes less twice the overlap;
* the overlap counted so far plus what the smaller prefix leaves open bounds the overlap, and pairs
  below 4/9 of their summed sizes are discarded. The rest are verified on their whole sets.

Links are wanted as components, so groups of near copies are not multiplied out: first every row is
checked against one leading row per column (a number of pairs in proportion to the rows), then the
exact product is taken between rows of different components only, of which each column gives pairs
with at least one row outside the column's largest component. A pair that is left out is in one
component already; every link between different components is found.

Null or empty text has an empty set and is linked with nothing; a null doc_id comes after all
others; rows that repeat a doc_id are documents of their own; an empty table gives an empty result.
Only ``doc_id`` and ``text`` are read. Vertices are numbers of the different sets, in order of their
smallest id, so texts that share an id (or have none) are never taken for each other; a component's
id is looked up at the end. A row is told by its id and a 64-bit key of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, attach, documents, has_repeats, id_of, keep_rows, original_id, strip_ws, text_of
from .components import connected_components
from .textgrams import blocks, mixed, shingle_sets

WIDTH = 5
#: Common columns: at most so many, found in at least LEAST_COMMON rows, counted where a unit of
#: UNIT entries or less holds them in at least LEAST_IN_UNIT different sets: with two, what escapes grows
#: with the root of the number of units. They only change the order.
MOST_COMMON, LEAST_COMMON, LEAST_IN_UNIT, UNIT = 1 << 18, 10, 2, 4_000_000
PARITIES = 512
#: A column of at most so many rows isn't cut into size classes.
FEW_ROWS = 64
PARITY = [f"p{i}" for i in range(PARITIES // 64)]
#: Documents whose sets are wanted are broadcast if there are at most so many (24 MB of ids, keys and vertices); more are shuffled.
MOST_IDS = 1 << 20


def prefix_length(n: int) -> int:
    """n - ceil(0.8 n) + 1."""
    return n - (4 * n + 4) // 5 + 1


def rest_length(n: Column) -> Column:
    """What a prefix leaves open: ceil(0.8 n) - 1."""
    return F.floor((n * 4 + 4) / 5) - 1


def sizes_fit(a: Column, b: Column) -> Column:
    return (a * 4 <= b * 5) & (b * 4 <= a * 5)


def size_class(n: Column) -> Column:
    """Sizes in a ratio of at most 1.25 are in the same or in neighbouring classes."""
    return F.floor(F.log(n) / np.log(1.25) + 1e-9).cast("int")


def row_key() -> Column:
    return F.xxhash64(text_of())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(id_of().alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("key"))


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """One scan, two kinds of rows: of each document (kind 0) doc_id, text key, set size, a 128-bit
    fingerprint of the set and its parities; of each unit's common columns (kind 1) the hash and its rows."""
    schema = pa.schema([("kind", pa.int32()), *((x, pa.int64()) for x in ("doc_id", "key", "n", "f1", "f2", *PARITY, "h", "rows"))])

    def common(sets: list[np.ndarray]) -> pa.RecordBatch:
        held = np.concatenate(sets)
        sets.clear()
        held.sort()  # in place: a unit is tens of megabytes
        often = held[LEAST_IN_UNIT - 1:] == held[:len(held) - LEAST_IN_UNIT + 1]
        h, rows = np.unique(held[:len(often)][often], return_counts=True)
        return batch_of(1, len(h), h=h.view(np.int64), rows=rows + LEAST_IN_UNIT - 1)

    def batch_of(kind: int, size: int, **columns) -> pa.RecordBatch:
        arrays = [pa.array(np.full(size, kind, np.int32))]
        arrays += [pa.array(columns[f.name]) if f.name in columns else pa.nulls(size, pa.int64()) for f in list(schema)[1:]]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, seen, held = [], set(), 0
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets = shingle_sets(block, width)
                n = np.array([len(s) for s in sets], np.int64)
                f1 = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                f2 = np.array([mixed(~s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                joined = np.concatenate([*sets, np.zeros(0, np.uint64)])
                bit = np.repeat(np.arange(len(n)), n) * PARITIES + (joined >> np.uint64(64 - PARITIES.bit_length() + 1)).astype(np.int64)
                odd = (np.bincount(bit, minlength=len(n) * PARITIES) & 1).astype(np.uint8)
                parity = np.packbits(odd).view(np.int64).reshape(len(n), PARITIES // 64)
                ids, keys = (batch.column(c).slice(block.first, len(n)).to_numpy() for c in (0, 2))
                yield batch_of(0, len(n), doc_id=ids, key=keys, n=n, f1=f1, f2=f2, **{p: np.ascontiguousarray(parity[:, i]) for i, p in enumerate(PARITY)})
                fresh = [np.zeros(0, np.uint64)]
                for s, key in zip(sets, zip(f1.tolist(), f2.tolist())):
                    if key not in seen:  # equal sets are one row
                        seen.add(key)
                        fresh.append(s)
                unit.append(np.concatenate(fresh))
                held += len(unit[-1])
                if held >= UNIT:
                    yield common(unit)
                    unit, seen, held = [], set(), 0
        if unit:
            yield common(unit)

    return _texts(docs).mapInArrow(run, "kind int, " + ", ".join(f"{f.name} long" for f in list(schema)[1:]))


def common_columns(units: DataFrame) -> np.ndarray:
    """Hashes of the most common columns, sorted: MOST_COMMON at most, two megabytes."""
    counts = units.groupBy("h").agg(F.sum("rows").alias("rows")).where(F.col("rows") > LEAST_COMMON)
    found = counts.orderBy(F.desc("rows"), "h").limit(MOST_COMMON).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def prefixes(docs: DataFrame, common: np.ndarray, width: int) -> DataFrame:
    """doc_id, text key, n and the prefix of each document's set, common columns last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets = shingle_sets(block, width)
                cut = []
                for s in sets:
                    held = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
                    ordered = np.concatenate([s[~held], s[held]]) if held.any() else s
                    cut.append(ordered[:prefix_length(len(s))] if len(s) else s)
                offsets = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int32)
                values = np.concatenate([*cut, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(block.first, len(sets)) for c in (0, 2)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "key", "n", "prefix"])

    return _texts(docs).mapInArrow(run, "doc_id long, key long, n long, prefix array<long>")


def whole_sets(docs: DataFrame, ids: DataFrame, width: int, repeated: bool) -> DataFrame:
    """vertex, shingles (sorted 64-bit hashes, packed) of the documents in ``ids`` (vertex, doc_id,
    key); with ``repeated`` documents, one row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(block, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(sets)), pa.array(sets, pa.binary())],
                                                 names=["vertex", "shingles"])

    wanted = F.broadcast(ids) if ids.count() <= MOST_IDS else ids
    sets = _texts(docs).join(wanted, ["doc_id", "key"]).select("vertex", "text").mapInArrow(run, "vertex long, shingles binary")
    return sets.dropDuplicates(["vertex"]) if repeated else sets


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b; repeats allowed on b) that are linked. The set of a much-used b is copied
    once per thousand of its pairs, so that they needn't meet in one task."""
    uses = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("pairs")).withColumn("parts", F.floor(F.col("pairs") / 1000) + 1)
    total = pairs.count()
    salted = attach(pairs, uses, ["b"], "pairs", total).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts"))).select("a", "b", "part")
    right = (sets.withColumnRenamed("vertex", "b").join(uses, "b")
             .select("b", F.col("shingles").alias("right"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")))
    left = sets.select(F.col("vertex").alias("a"), F.col("shingles").alias("left"))
    both = salted.join(left, "a").join(right, ["b", "part"]).select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            linked = np.zeros(len(left), bool)
            for i in range(len(left)):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                overlap = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                linked[i] = 100 * overlap >= 80 * (len(x) + len(y) - overlap)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    return both.mapInArrow(run, "a long, b long")


def may_reach(overlap: Column, a: Column, b: Column) -> Column:
    """The counted overlap and what the prefixes leave open can make 4/9 of both sizes."""
    return (overlap + F.greatest(rest_length(a), rest_length(b))) * 9 >= (a + b) * 4


def leading_pairs(entries: DataFrame) -> DataFrame:
    """a, b: each row with the leading row (the first vertex) that it shares most columns with."""
    led = entries.where("a <> lead.a")
    counted = led.groupBy("a", "n", F.col("lead.a").alias("b"), F.col("lead.n").alias("m")).agg(F.count(F.lit(1)).alias("overlap"))
    counted = counted.where(sizes_fit(F.col("n"), F.col("m")) & may_reach(F.col("overlap"), F.col("n"), F.col("m")))
    return counted.groupBy("a").agg(F.max_by("b", F.struct("overlap", "b")).alias("b"))


def product_pairs(entries: DataFrame, labels: DataFrame, parities: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: rows of different components whose product reaches the bound."""
    held = entries.select("h", "a", "n").join(labels.select(F.col("vertex").alias("a"), "component"), "a", "left")
    held = held.withColumn("component", F.coalesce("component", "a")).withColumn("class", size_class(F.col("n")))
    held = scratch.write(held, "entries-labelled")
    scratch.drop("entries")
    per = held.groupBy("h", "component").agg(F.count(F.lit(1)).alias("k"))
    mixed_columns = (per.groupBy("h").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("rows"),
                                          F.count(F.lit(1)).alias("parts")).where("parts > 1").select("h", "main", "rows"))
    mixed_columns = scratch.write(mixed_columns, "columns")
    total = mixed_columns.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    # a column of few rows is one block, whatever their sizes; a larger one is cut into classes
    few = F.col("rows") <= FEW_ROWS
    rows = attach(held, mixed_columns, ["h"], "rows", total).withColumn("class", F.when(few, -1).otherwise(F.col("class")))
    rows = scratch.write(rows.drop("rows").join(parities, "a"), "entries-mixed")
    scratch.drop("entries-labelled")
    near = F.when(F.col("class") < 0, F.array("class")).otherwise(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))
    outside = rows.where("component <> main").withColumn("class", F.explode(near))
    o, r = outside.alias("o"), rows.alias("r")
    once = (F.col("r.component") == F.col("r.main")) | (F.col("o.a") < F.col("r.a"))
    meet = ((F.col("o.h") == F.col("r.h")) & (F.col("o.class") == F.col("r.class"))
            & (F.col("o.component") != F.col("r.component")) & once & sizes_fit(F.col("o.n"), F.col("r.n"))
            & (sum(F.bit_count(F.col(f"o.{p}").bitwiseXOR(F.col(f"r.{p}"))) for p in PARITY) * 9 <= F.col("o.n") + F.col("r.n")))
    a, b = F.least("o.a", "r.a"), F.greatest("o.a", "r.a")
    pairs = (o.join(r, meet).groupBy(b.alias("a"), a.alias("b"), (F.col("o.n") + F.col("r.n")).alias("sum"),
                                     F.greatest("o.n", "r.n").alias("larger")).agg(F.count(F.lit(1)).alias("overlap")))
    return pairs.where((F.col("overlap") + rest_length(F.col("larger"))) * 9 >= F.col("sum") * 4).select("a", "b")


def linked_rows(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, bool]:
    """(rows, firsts, repeated): doc_id, n_shingles, component_id of every row of ``docs``, null ids as
    the last id; doc_id and key of the first row of every component of rows that have words; whether
    any (doc_id, key) of such rows occurs twice."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    found = scratch.write(profiles(docs, width), "profiles", ["kind"])
    sets, units = found.where("kind = 0").drop("kind", "h", "rows"), found.where("kind = 1").select("h", "rows")
    common = common_columns(units)
    repeated = has_repeats(sets.where("n > 0"), "key")
    same = sets.where("n > 0").groupBy("n", "f1", "f2").agg(
        F.min(F.struct("doc_id", "key")).alias("lead"), F.count(F.lit(1)).alias("copies"), *(F.first(p).alias(p) for p in PARITY))
    same = same.select("lead.*", "n", "f1", "f2", "copies", *PARITY).orderBy("doc_id", "key", "n", "f1", "f2")
    same = scratch.write(same.withColumn("vertex", F.monotonically_increasing_id()), "classes")
    total = same.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    parities = same.select(F.col("vertex").alias("a"), *PARITY)
    leads = same.select("doc_id", "key", "vertex")
    rows = scratch.write(prefixes(docs, common, width), "prefixes").where("n > 0")
    rows = (rows.dropDuplicates(["doc_id", "key"]) if repeated else rows).join(leads, ["doc_id", "key"]).withColumnRenamed("vertex", "a")
    entries = rows.select("a", "n", F.explode("prefix").alias("h"))
    # the many columns of few rows are looked at where a shuffle brings them together; common ones by broadcast
    first = F.min(F.struct("a", "n"))
    is_common = scratch.spark.createDataFrame(pa_table(common)) if len(common) else None
    spread = entries if is_common is None else entries.join(F.broadcast(is_common), "h", "left_anti")
    spread = (spread.withColumn("lead", F.expr("min(struct(a, n)) OVER (PARTITION BY h)"))
              .withColumn("rows", F.expr("count(1) OVER (PARTITION BY h)")).where("rows > 1").select("h", "a", "n", "lead"))
    if is_common is not None:
        often = entries.join(F.broadcast(is_common), "h", "left_semi")
        leading = often.groupBy("h").agg(first.alias("lead"))  # MOST_COMMON rows at most
        spread = spread.unionByName(often.join(F.broadcast(leading), "h").select("h", "a", "n", "lead"))
    entries = scratch.write(spread, "entries")
    scratch.drop("prefixes")
    near = scratch.write(leading_pairs(entries), "pairs-1")
    whole = scratch.write(whole_sets(docs, scratch.write(ids_of(near, leads), "ids-1"), width, repeated), "whole-1")
    edges = scratch.write(verified(near, whole), "edges-1")
    scratch.drop("whole-1")
    labels = connected_components(edges, scratch, "leads")
    across = scratch.write(product_pairs(entries, labels, parities, scratch), "pairs-2")
    more = verified(across, scratch.write(whole_sets(docs, scratch.write(ids_of(across, leads), "ids-2"), width, repeated), "whole-2"))
    labels = connected_components(edges.unionByName(more), scratch, "all")
    scratch.drop("whole-2", "entries-mixed")
    # a component is named by its smallest row, which is that of one of its sets
    inside = labels.join(leads, "vertex").groupBy("component").agg(F.min(F.struct("doc_id", "key", "vertex")).alias("first"), F.count(F.lit(1)).alias("size"))
    named = attach(labels, inside, ["component"], "size", labels.count()).select("vertex", "first")
    classes = same.drop(*PARITY).join(named, "vertex", "left").withColumn("first", F.coalesce("first", F.struct("doc_id", "key", "vertex")))
    classes = scratch.write(classes, "components")
    linked = attach(sets.where("n > 0").select("doc_id", "n", "f1", "f2"),
                    classes.select("n", "f1", "f2", "copies", F.col("first.doc_id").alias("component_id")), ["n", "f1", "f2"], "copies", total)
    alone = sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "n", "component_id").unionByName(alone).withColumnRenamed("n", "n_shingles")
    return out, classes.where("vertex = first.vertex").select("doc_id", "key"), repeated


def jaccard_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``; null ids as the last id."""
    return linked_rows(docs, width)[0]


def ids_of(pairs: DataFrame, leads: DataFrame) -> DataFrame:
    """vertex, doc_id, key of the vertices in ``pairs``."""
    return leads.join(pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct(), "vertex")


def pa_table(hashes: np.ndarray) -> pa.Table:
    return pa.table({"h": pa.array(hashes.view(np.int64))})


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(documents(spark, sf_dir))
    return out.select(original_id().alias("doc_id"), "n_shingles", original_id("component_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row of ``docs`` of every component, of its smallest id, with all their columns; rows without
    words are linked with nothing, so all of them stay."""
    _, firsts, repeated = linked_rows(docs, width)
    empty = F.length(strip_ws(text_of())) == 0
    return keep_rows(docs.where(~empty), firsts, row_key(), repeated).union(docs.where(empty))
