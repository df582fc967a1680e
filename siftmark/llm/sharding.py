"""Operator 4: reproducible sharding by a Feistel permutation of row numbers.

Native: DataFrame and SQL functions only. Every row gets its global number in
the order of its keys; a keyed Feistel network with cycle walking permutes
0..N-1; shard and slot follow from the permuted place by arithmetic. The same
table, seed and shard count give the same shards on any cluster, and a row's
shard can be computed from its number alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import number_rows

#: Rounds of the network, and the most passes of a cycle walk. The network's domain a * b exceeds N by less
#: than a = ceil(sqrt(N)): a walk needs at most a passes, and each of them stays outside with chance 1 / sqrt(N).
ROUNDS = 6
WALKS = 16


def permuted(number: str, n: int, seed: int) -> Column:
    """The place of column `number` (0..n-1) in a pseudo-random permutation of 0..n-1."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def network(x: str) -> str:
        """Halves l in 0..a-1 and r in 0..b-1 take turns in receiving a hash of the other."""
        rounds = ", ".join(map(str, range(ROUNDS)))
        return f"""aggregate(array({rounds}), named_struct('l', {x} div {b}L, 'r', {x} % {b}L), (h, k) ->
            if(k % 2 = 0,
               named_struct('l', (h.l + pmod(xxhash64(h.r, k, {seed}L), {a}L)) % {a}L, 'r', h.r),
               named_struct('l', h.l, 'r', (h.r + pmod(xxhash64(h.l, k, {seed}L), {b}L)) % {b}L)),
            h -> h.l * {b}L + h.r)"""

    first = network(f"cast({number} as bigint)")
    walked = f"aggregate(sequence(1, {WALKS}), {first}, (x, w) -> if(x < {n}L, x, {network('x')}))"
    return F.expr(f"transform(array({walked}), x -> if(x < {n}L, x, cast(raise_error('cycle walk did not end') as bigint)))[0]")


def feistel_shards(df: DataFrame, keys: list[str], shards: int, seed: int = 7) -> DataFrame:
    """Add `row_no`, `place` (the row's place in the shuffle), `shard` (int) and `slot` (long, gapless from 0 in its shard).

    Shard sizes differ by one row at most. Rows are numbered by `keys`, nulls
    first; rows with equal keys get distinct numbers in any order, so give keys
    that tell rows apart. An empty table gives no rows. All columns of `df` stay; the four
    new names replace columns of the same name.
    """
    rows = number_rows(df.drop("row_no", "place", "shard", "slot"), keys)
    n = rows.count()  # of the checkpointed layout
    return (
        rows.withColumn("place", permuted("row_no", n, seed))
        .withColumn("shard", (F.col("place") % shards).cast("int"))
        .withColumn("slot", F.expr(f"place div {shards}L"))
    )


def op4_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, shard and slot under law `rows`; a null text has no bytes. See `feistel_shards`."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    sized = documents.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = feistel_shards(sized, ["doc_id", "text_crc32", "size"], 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no", "place")
