"""Mixing sources to target weights by Sainte-Lague apportionment (operator 5); DataFrame functions only.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and
share all words by weight, but none beyond three times its own size; the excess
goes to the others.  Sorted by size over weight, a source is capped exactly if
the level that holds once all before it are capped still lies above its own
ratio, so running sums give the targets without iterating.

Quotas: every source gets blocks of ``BLOCK`` words by highest quotients
t / (2 j + 1) of its target t.  Each source is cut into shards of about
``SHARD`` words by a hash of the document id, so a source that holds a third of
all rows is many small groups; its blocks are apportioned to its shards by
highest quotients of their sizes.  Only seats that the bounds
floor(t (n -+ k/2) / sum + 1/2) leave open are ranked, at most three for each of
the k parties, never one row a block.

Selection: a shard's documents, in seeded order, are one stream of words cut
into equal blocks.  A quota of q over n blocks takes every block q div n times
and q mod n of them once more, chosen by a seeded permutation
k -> (prime k + start) mod n, so a document's share follows from its place alone.

Defined cases: null text has size zero; a source of size zero has target zero;
a null source is a source of its own; a null id counts as an empty one; repeated
rows are mixed like any others (rows with equal id and size are interchangeable);
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codefacts.llm.common import cut, n_words, ship, words_of

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 16
SHARD = 250_000
#: A prime above any number of blocks in a shard.
PRIME = 1_000_000_007


def _hash(*parts: str) -> str:
    return f"cast(conv(substr(md5(concat({', '.join(parts)})), 1, 15), 16, 10) as bigint)"


def apportion(parties: DataFrame, group: str | None, order: list, weight: str, seats: str) -> DataFrame:
    """Sainte-Lague: the parties with a column ``quota``, by highest quotients within each group.

    ``order`` names the columns that tell parties of a group apart and settle ties.
    """
    by = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    rows = parties.withColumn("_sum", F.sum(weight).over(by)).withColumn("_k", F.count("*").over(by) / 2)
    share = lambda n: F.when(F.col("_sum") > 0, F.floor(F.greatest(F.lit(0.0), F.col(weight) * n / F.col("_sum") + 0.5))).otherwise(0).cast("long")
    rows = rows.withColumn("_low", F.when(F.col(seats) > F.col("_k"), share(F.col(seats) - F.col("_k"))).otherwise(0)).withColumn("_high", share(F.col(seats) + F.col("_k")) + 1)
    rows = rows.withColumn("_open", F.col(seats) - F.sum("_low").over(by))
    asked = rows.select("*", F.explode_outer(F.expr(f"if({weight} > 0, sequence(_low, _high), array())")).alias("_j"))
    asked = asked.withColumn("_rank", F.row_number().over(by.orderBy(F.desc_nulls_last(F.col(weight) / (2 * F.col("_j") + 1)), *order)))
    won = F.sum(F.when(F.col("_j").isNotNull() & (F.col("_rank") <= F.col("_open")), 1).otherwise(0))
    kept = parties.columns
    return asked.groupBy(*kept, "_low").agg(won.alias("_won")).select(*kept, (F.col("_low") + F.col("_won")).cast("long").alias("quota"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of (source, size) rows; one row a source."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    rank = (F.row_number().over(one.orderBy(F.asc_nulls_last("source"))) - 1) % len(WEIGHTS)
    each = each.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), rank + 1).cast("long")).withColumn("ratio", F.col("source_size").cast("double") / F.col("w"))
    up = one.orderBy("ratio", F.asc_nulls_last("source"))
    before, rest = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    each = each.withColumn("left", F.sum("source_size").over(one) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("ws", F.sum("w").over(rest))
    each = each.withColumn("level", F.col("left").cast("double") / F.col("ws"))
    each = each.withColumn("capped", F.col("level") > MOST * F.col("ratio"))
    each = each.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(one))
    return each.select("source", "source_size", F.when(F.col("capped"), (MOST * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"))


def mixed(docs: DataFrame, seed: str = "mix", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for every row of (doc_id, text, source); ids of any type that casts to a string."""
    sized = cut(docs.select("doc_id", n_words(F.col("text").cast("string")).alias("size"), F.col("source").cast("string").alias("source")))
    aims = targets(sized).withColumn("_seats", F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block + 0.5))
    quotas = apportion(aims, None, [F.asc_nulls_last("source")], "target", "_seats").select("source", "source_size", "target", F.col("quota").alias("blocks"))
    quotas = cut(quotas)
    q = quotas.select(F.col("source").alias("_s"), "source_size", "target", "blocks")
    rows = sized.join(q, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("h", F.expr(_hash(f"'{seed}:'", "coalesce(cast(doc_id as string), '')")))
    rows = cut(rows.withColumn("shard", F.expr(f"h % greatest(1L, (source_size + {shard} - 1) div {shard})")))
    parts = rows.groupBy("source", "source_size", "blocks", "shard").agg(F.sum("size").alias("words"))
    parts = parts.withColumn("n", F.expr(f"if(words = 0, 0L, greatest(1L, cast(floor(words / {block}D + 0.5) as bigint)))"))
    own = Window.partitionBy("source")
    parts = parts.withColumn("weight", F.col("n").cast("double")).withColumn("seats", F.when(F.col("source_size") > 0, F.floor(F.col("blocks") * F.lit(float(block)) * F.sum("n").over(own) / F.col("source_size") + 0.5)).otherwise(0))
    parts = apportion(parts, "source", ["shard"], "weight", "seats")
    parts = parts.select(F.col("source").alias("_s"), F.col("shard").alias("_p"), "words", "n", F.least("quota", MOST * F.col("n")).alias("quota"), F.expr(f"{_hash(f"'{seed}:'", "coalesce(source, '')", "':'", 'shard')} % greatest(1L, n)").alias("start"))
    stream = Window.partitionBy("source", "shard").orderBy("h", F.asc_nulls_last("doc_id"), "size")
    placed = rows.withColumn("p1", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0))).withColumn("p0", F.col("p1") - F.col("size"))
    placed = placed.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_p")))
    extra = f"""aggregate(sequence(((p0 + 1) * n - 1) div words, (p1 * n - 1) div words), 0L, (a, k) -> a + if((k * {PRIME} + start) % n < quota % n,
        least(p1, ((k + 1) * words) div n) - greatest(p0, (k * words) div n), 0L))"""
    taken = F.expr(f"if(size = 0, 0L, (quota div n) * size + if(quota % n = 0, 0L, {extra}))")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


def applied(docs: DataFrame) -> DataFrame:
    """The mix itself: whole copies of each document, and one cut to as many words as are taken beyond them.

    Rows equal in all columns are one document that is taken for all of them.  A
    row is known by SHA-256 over all its columns; ``mixed`` orders rows by a
    64-bit part of it, with the whole digest settling ties.
    """
    digest = F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256)
    keyed = docs.select(F.struct("*").alias("row"), digest.alias("k"))
    takes = mixed(keyed.select(F.col("k").alias("doc_id"), "row.text", "row.source")).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count("*").alias("rows"))
    takes = cut(takes.where("taken > 0"))
    if takes.where("rows > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["k"])
    rows = keyed.join(takes, F.col("k") == F.col("doc_id")).select("row", "taken", "size", F.explode(F.expr("sequence(1L, (taken + size - 1) div size)")).alias("copy"))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    text = F.when(left >= F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(words_of("row.text"), F.lit(1), left.cast("int")), " "))
    columns = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[columns[c].alias(c) if c in columns else F.col(f"row.{c}") for c in docs.columns])


def oracle() -> str:
    """The same mix in DuckDB's SQL over a table ``documents``."""
    digest = lambda x: f"('0x' || substr(md5({x}), 1, 15))::BIGINT"

    def seats(name: str, of: str, by: str, order: str, weight: str, n: str, keep: str) -> str:
        own = f"PARTITION BY {by}" if by else ""
        return f"""
{name}_a AS (SELECT *, sum({weight}) OVER ({own}) AS _sum, (count(*) OVER ({own}))::DOUBLE / 2 AS _k FROM {of}),
{name}_b AS (SELECT *, CASE WHEN {n} > _k AND _sum > 0 THEN floor(greatest(0, {weight} * ({n} - _k) / _sum + 0.5))::BIGINT ELSE 0 END AS _low,
  CASE WHEN _sum > 0 THEN floor(greatest(0, {weight} * ({n} + _k) / _sum + 0.5))::BIGINT ELSE 0 END + 1 AS _high FROM {name}_a),
{name}_c AS (SELECT *, {n} - sum(_low) OVER ({own}) AS _open FROM {name}_b),
{name}_d AS (SELECT *, unnest(range(_low, _high + 1)) AS _j FROM {name}_c WHERE {weight} > 0),
{name}_e AS (SELECT *, row_number() OVER ({own} ORDER BY {weight} / (2 * _j + 1) DESC, {order}) AS _rank FROM {name}_d),
{name} AS (SELECT {keep}, any_value(_low) + count(*) FILTER (_rank <= _open) AS quota FROM {name}_e GROUP BY ALL)"""

    return f"""WITH sized AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, source FROM documents),
each AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % {len(WEIGHTS)} + 1] AS w FROM each),
levels AS (SELECT *, source_size::DOUBLE / w AS ratio, (sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(w) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM weighed),
aims AS (SELECT source, source_size, CASE WHEN level > {MOST} * ratio THEN ({MOST} * source_size)::DOUBLE ELSE (max(level) FILTER (NOT level > {MOST} * ratio) OVER ()) * w END AS target FROM levels),
seated AS (SELECT *, floor(sum(target) OVER () / {BLOCK} + 0.5)::BIGINT AS seats FROM aims),
{seats("first", "seated", "", "source NULLS LAST", "target", "seats", "source, source_size, target")},
quotas AS (SELECT a.*, coalesce(f.quota, 0) AS blocks FROM aims a LEFT JOIN first f ON a.source IS NOT DISTINCT FROM f.source),
hashed AS (SELECT s.*, q.source_size, q.target, q.blocks, {digest("'mix:' || coalesce(doc_id::VARCHAR, '')")} AS h FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source),
rowz AS (SELECT *, h % greatest(1, (source_size + {SHARD} - 1) // {SHARD}) AS shard FROM hashed),
shards AS (SELECT source, source_size, blocks, shard, sum(size)::BIGINT AS words FROM rowz GROUP BY ALL),
blocked AS (SELECT *, CASE WHEN words = 0 THEN 0 ELSE greatest(1, floor(words / {BLOCK} + 0.5)::BIGINT) END AS n FROM shards),
parties AS (SELECT *, n::DOUBLE AS weight, CASE WHEN source_size > 0 THEN floor(blocks * {BLOCK}.0::DOUBLE * (sum(n) OVER (PARTITION BY source))::DOUBLE / source_size + 0.5)::BIGINT ELSE 0 END AS seats FROM blocked),
{seats("second", "parties", "source", "shard", "weight", "seats", "source, shard, words, n")},
parts AS (SELECT b.source, b.shard, b.words, b.n, least(coalesce(s.quota, 0), {MOST} * b.n)::BIGINT AS quota, {digest("'mix:' || coalesce(b.source, '') || ':' || b.shard")} % greatest(1, b.n) AS start
  FROM blocked b LEFT JOIN second s ON b.source IS NOT DISTINCT FROM s.source AND b.shard = s.shard),
placed AS (SELECT *, (sum(size) OVER (PARTITION BY source, shard ORDER BY h, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS p1 FROM rowz)
SELECT p.doc_id, p.size, p.source_size, p.target, (CASE WHEN p.size = 0 THEN 0 ELSE (t.quota // t.n) * p.size + CASE WHEN t.quota % t.n = 0 THEN 0 ELSE coalesce(list_sum(list_transform(
  range(((p.p1 - p.size + 1) * t.n - 1) // t.words, (p.p1 * t.n - 1) // t.words + 1),
  lambda k: CASE WHEN (k * {PRIME} + t.start) % t.n < t.quota % t.n THEN least(p.p1, ((k + 1) * t.words) // t.n) - greatest(p.p1 - p.size, (k * t.words) // t.n) ELSE 0 END)), 0) END END)::BIGINT AS taken, p.source
FROM placed p JOIN parts t ON p.source IS NOT DISTINCT FROM t.source AND p.shard = t.shard"""


ship(__name__)
