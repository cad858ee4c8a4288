"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles. DataFrame only.

Does a document hold at least `threshold` of a benchmark item's five-word shingles? Jaccard similarity is no help where a
30-word item hides in a 20,000-word text, so the search is for containment, and uneven on purpose:

1. Items are small: each gets a MinHash sketch, the smallest shingle under each of `sketch` hash functions. Items are
   partitioned by size class (powers of two of their shingle count); a class has a bound below which a document is too
   small to contain `threshold` of any item in it, and documents smaller than that never meet the class.
2. Documents are large: they are not sketched. A sketch entry is looked up among all shingles of a whole text, which hits
   with the probability of the containment itself, whatever the document's length. At containment 0.8, fewer than
   `least_hits` = 4 of 16 entries hit with a probability near 1e-8 (3e-6 for one hit less than 6).
3. A candidate pair is verified with the exact share of the item's shingles in the document. Only candidate documents are
   read a second time.

Words are runs of letters and digits, in lower case. Sketches are broadcast up to MOST_SKETCH rows and joined by a
shuffle beyond. Shingles are compared by 64-bit hashes.

Cases. Null text: no words. Items or documents under five words have no shingle and match nothing. Rows that share an id
are one document (or item): their shingles are pooled. Rows with a null id are left out of pairs and stay in
`without_leaks`. Empty tables: no pairs. Extra columns are dropped in pairs and kept by `without_leaks`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, only

SIZE = 5
MOST_SKETCH = 200_000
MOST_CANDIDATES = 1_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_shingles(rows: DataFrame) -> DataFrame:
    """rows (id, text and others) with shingles in place of the text."""
    keep = [c for c in rows.columns if c != "text"]
    words_ = rows.select(*keep, words(F.col("text")).alias("words"))
    places = F.when(F.size("words") >= SIZE, F.sequence(F.lit(1), F.size("words") - (SIZE - 1))).otherwise(F.array().cast("array<int>"))
    return words_.select(*keep, F.transform(places, lambda i: F.xxhash64(F.slice("words", i, SIZE))).alias("shingles"))


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """Distinct (item_id, shingle, n_item_shingles)."""
    rows = with_shingles(only(benchmark, item_id="long", text="string").where("item_id IS NOT NULL").withColumnRenamed("item_id", "id"))
    each = rows.select(F.col("id").alias("item_id"), F.explode("shingles").alias("shingle")).distinct()
    return each.join(each.groupBy("item_id").agg(F.count("*").alias("n_item_shingles")), "item_id")


def sketches(items: DataFrame, sketch: int, threshold: float) -> DataFrame:
    """(shingle, sketched): for each shingle the items with it in their sketch, as an array of structs.

    entries: bits of the hash functions under which it is the item's smallest; least: of the item's size class, the
    shingles that a document needs to contain `threshold` of its smallest item.
    """
    size_class = F.floor(F.log2("n_item_shingles"))
    least = F.ceil(F.pow(F.lit(2.0), size_class) * threshold).cast("long")
    by_function = items.select("item_id", "shingle", least.alias("least"), F.posexplode(F.array(*[F.xxhash64("shingle", F.lit(j)) for j in range(sketch)])).alias("j", "h"))
    smallest = by_function.groupBy("item_id", "j", "least").agg(F.min_by("shingle", "h").alias("shingle"))
    entries = smallest.groupBy("item_id", "shingle", "least").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("entries"))
    return entries.groupBy("shingle").agg(F.collect_list(F.struct("item_id", "entries", "least")).alias("sketched"))


def candidates(docs: DataFrame, items: DataFrame, threshold: float, sketch: int, least_hits: int) -> DataFrame:
    """Pairs (doc_id, item_id) with enough sketch hits. docs: (id, text)."""
    entries = cut(sketches(items, sketch, threshold))
    if entries.count() <= MOST_SKETCH:
        entries = F.broadcast(entries)
    # a document of several rows may hold more shingles than any row, so its rows pass every size class
    pooled = cut(docs.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id", F.lit(True).alias("pooled")))
    n_pooled = pooled.count()
    size, any_size = F.size("shingles"), F.lit(2**31 - 1)
    if 0 < n_pooled <= MOST_CANDIDATES:
        docs = docs.join(F.broadcast(pooled), "id", "left")
        size = F.when(F.col("pooled"), any_size).otherwise(size)
    elif n_pooled:
        size = any_size
    # explode_outer: for explode() Spark adds a filter that works the shingles out twice; nulls join with nothing
    each = with_shingles(docs).select("id", size.alias("n"), F.explode_outer("shingles").alias("shingle"))
    hits = each.join(entries, "shingle").select("id", "n", F.inline("sketched")).where("n >= least")
    found = hits.groupBy("id", "item_id").agg(F.bit_count(F.bit_or("entries")).alias("hits")).where(F.col("hits") >= least_hits)
    return found.select(F.col("id").alias("doc_id"), "item_id")


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, sketch: int = 16, least_hits: int = 4) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of all pairs at or over the threshold."""
    rows = only(docs, doc_id="long", text="string").where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "id")
    items = item_shingles(benchmark)
    pairs = cut(candidates(rows, items, threshold, sketch, least_hits))
    ids = pairs.select(F.col("doc_id").alias("id")).distinct()
    if pairs.count() <= MOST_CANDIDATES:
        ids = F.broadcast(ids)
    again = with_shingles(rows.join(ids, "id", "left_semi")).select(F.col("id").alias("doc_id"), F.explode_outer(F.array_distinct("shingles")).alias("shingle")).distinct()
    wanted = pairs.join(items, "item_id")
    shared = again.join(wanted, ["doc_id", "shingle"]).groupBy("doc_id", "item_id", "n_item_shingles").agg(F.count("*").alias("n_shared"))
    out = shared.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))
    return out.where(F.col("containment") >= threshold)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with the columns they came with."""
    found = cut(contained(docs, benchmark, **options).select(F.col("doc_id").alias("__leaked")).distinct())
    if found.count() <= MOST_CANDIDATES:
        found = F.broadcast(found)
    return docs.join(found, docs["doc_id"].cast("long") == found["__leaked"], "left_anti")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item_shingles, count(*) AS n_shared, count(*) / n_item_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item_shingles HAVING count(*) >= 0.8 * n_item_shingles"""
