"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

In a uniform shuffle the numbers of rows that go from each block of the input to each
shard are a matrix with given sums of rows and columns, and follow the multivariate
hypergeometric law. So the matrix is drawn first: the blocks are halved again and again,
and at each step the rows that a half sends to each shard are drawn from what both
send. Then every block permutes its rows and deals them out by its row of the matrix,
and every shard permutes what it has got. No row looks at another block, shard sizes are
exact, and any order of the rows is equally likely.

What depends on the rows is hashed from their place in the table, which is written to the
shared folder with the place first: a task that runs again gives the same rows the same
places. Blocks have BLOCK rows at most, and a shard is permuted in ranges of its second
hash, so no task holds a shard. Nothing here runs in Python.
"""

from __future__ import annotations

import uuid
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwise.llm.common import shared_folder

SHARDS = 24
#: Rows of a block at most, as a power of two, and rows of a shard that are sorted together, about.
BLOCK_BITS, RANGE = 20, 1 << 16
#: Standard deviations, and rows besides, that a draw looks at on either side of the likeliest number; what is beyond has less weight than a double's last bit.
DEVIATIONS, BESIDES = 12, 24


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with name bound to value, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def uniform(*keys: str) -> str:
    """SQL of a number in [0, 1) that the keys decide."""
    return f"shiftrightunsigned(xxhash64({', '.join(keys)}), 11) * pow(2D, -53)"


def hypergeometric(good: str, bad: str, draws: str, u: str) -> str:
    """SQL of the number of good ones among `draws` drawn of good + bad without replacement, by inversion of u in [0, 1).

    Weights are taken relative to the likeliest number m and go from there up, then
    down, by their ratios, so no factorial is needed; ranges start at 0 to be never empty.
    """
    up = "a.w * (p.k - q.m - i + 1D) * (p.n - q.m - i + 1D) / ((q.m + i) * (p.b - p.n + q.m + i))"
    down = "a.w * (q.m - i + 1D) * (p.b - p.n + q.m - i + 1D) / ((p.k - q.m + i) * (p.n - q.m + i))"

    def fold(ratio: str, steps: str, start: str, counted: str, end: str) -> str:
        """s: the weights before the last, and start; c: how many of the running sums `counted` holds for."""
        step = f"named_struct('w', if(i = 0, 1D, {ratio}), 's', a.s + a.w, 'c', a.c + if({counted}, 1L, 0L))"
        return f"aggregate(sequence(0L, {steps}), named_struct('w', 0D, 's', {start}, 'c', 0L), (a, i) -> {step}, a -> {end})"

    upward, downward = "least(q.reach, q.high - q.m)", "least(q.reach, q.m - q.low)"
    sums = f"named_struct('up', {fold(up, upward, '0D', 'false', 'a.s + a.w')}, 'down', {fold(down, downward, '-1D', 'false', 'a.s + a.w')})"
    above = fold(up, upward, "0D", "i > 0 and a.s + a.w <= t", "a.c")
    below = fold(down, downward, "-1D", "i > 1 and a.s + a.w <= t - s.up", "a.c")
    found = f"if(t < s.up, q.m + {above}, q.m - 1 - {below})"
    spread = f"{DEVIATIONS} * sqrt(p.n / p.t * p.k * (p.b / p.t) * ((p.t - p.n) / greatest(p.t - 1D, 1D)))"
    likeliest = "cast(floor((p.n + 1D) * (p.k + 1D) / (p.t + 2D)) as bigint)"
    ends = "'low', greatest(0L, p.n - p.b), 'high', least(p.n, p.k)"
    q = f"named_struct({ends}, 'm', least(greatest({likeliest}, greatest(0L, p.n - p.b)), least(p.n, p.k)), 'reach', cast(ceil({spread}) as bigint) + {BESIDES}L)"
    within = f"least(q.high, greatest(q.low, {_let('s', sums, _let('t', 'p.u * (s.up + s.down)', found))}))"
    p = f"named_struct('k', {good}, 'b', {bad}, 'n', {draws}, 't', cast({good} + {bad} as double), 'u', {u})"
    # Without good ones, without draws or without bad ones there is nothing to draw.
    return f"case when {good} = 0 or {draws} = 0 then 0L when {bad} = 0 then {draws} else {_let('p', p, _let('q', q, within))} end"


def sizes_of(rows: int, shards: int) -> list[int]:
    """Rows of each shard: equal, but for one more in the first ones."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def communication_matrix(blocks: DataFrame, shards: list[int], count: int, seed: int = 0) -> DataFrame:
    """block, n, to (the rows that go to each shard), of `count` rows (block, n) whose n add up to the sum of shards."""
    one = F.sort_array(F.collect_list(F.struct("block", "n")))
    nodes = blocks.agg(one.alias("own")).select("own", F.array(*(F.lit(n).cast("long") for n in shards)).alias("to"))
    first = "slice(own, 1, size(own) div 2)"
    rows = f"aggregate({first}, 0L, (s, x) -> s + x.n)"
    total = "aggregate(to, 0L, (s, x) -> s + x)"
    draw = hypergeometric("z.good", "z.bad", "z.need", f"{uniform(f'{seed}L', 'own[0].block', 'own[size(own) - 1].block', 'j')}")
    taken = _let("z", "named_struct('good', to[j], 'bad', a.pool - to[j], 'need', a.need)", draw)
    step = _let("x", taken, "named_struct('need', a.need - x, 'pool', a.pool - to[j], 'out', array_append(a.out, x))")
    drawn = f"aggregate(sequence(0, size(to) - 1), named_struct('need', {rows}, 'pool', {total}, 'out', cast(array() as array<bigint>)), (a, j) -> {step}, a -> a.out)"
    halves = f"array(named_struct('own', {first}, 'to', left), named_struct('own', slice(own, size(own) div 2 + 1, size(own)), 'to', zip_with(to, left, (x, y) -> x - y)))"
    for level in range(ceil(log2(max(1, count)))):
        if level == 10:
            nodes = nodes.repartition()  # the many small draws of the last levels are the most work
        halved = nodes.withColumn("left", F.expr(f"if(size(own) > 1, {drawn}, null)"))
        nodes = halved.select(F.inline(F.expr(f"if(size(own) > 1, {halves}, array(named_struct('own', own, 'to', to)))")))
    return nodes.where("size(own) = 1").select("own.block", "own.n", "to").select(F.col("block")[0].alias("block"), F.col("n")[0].alias("n"), "to")


def _hashed(seed: int, at: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(at))


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = 0, block_bits: int = BLOCK_BITS, range_rows: int = RANGE) -> DataFrame:
    """The rows of docs with shard (int, from 0) and slot (long, gapless from 0 in each shard), in a uniformly random order.

    Shards have equal numbers of rows, the first ones one more where they do not
    divide. Every row counts for itself: rows that repeat, null ids and null or empty
    texts are placed as any other, so copies of a text are spread as chance has it. Columns of docs named
    shard or slot are replaced; an empty table gives no rows. The order depends on the
    seed and on the files of docs; asking for it once more draws the same only while
    those are read in the same splits.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/sharding-{uuid.uuid4().hex}"
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    docs.select(*(F.col(f"`{c}`") for c in own), F.monotonically_increasing_id().alias("__bx_at")).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows").withColumn("__bx_block", F.shiftright("__bx_at", block_bits))
    counts = rows.groupBy(F.col("__bx_block").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    n_blocks, n_rows = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    matrix = communication_matrix(counts, sizes_of(n_rows, shards), n_blocks, seed)
    local = Window.partitionBy("__bx_block").orderBy(_hashed(seed + 1, "__bx_at"), "__bx_at")
    permuted = rows.withColumn("__bx_k", F.row_number().over(local) - 1).join(matrix.select(F.col("block").alias("__bx_block"), "to"), "__bx_block")
    dealt = F.expr("aggregate(to, named_struct('s', 0L, 'c', 0), (a, x) -> named_struct('s', a.s + x, 'c', a.c + if(a.s + x <= __bx_k, 1, 0)), a -> a.c)")
    permuted.select(*(F.col(f"`{c}`") for c in own), "__bx_at", dealt.alias("shard")).write.parquet(f"{folder}/dealt")

    bits = ceil(log2(max(1, n_rows / shards / range_rows)))
    again = _hashed(seed + 2, "__bx_at")
    sent = spark.read.parquet(f"{folder}/dealt").withColumn("__bx_range", F.shiftrightunsigned(again, 64 - bits) if bits else F.lit(0).cast("long"))
    before = Window.partitionBy("shard").orderBy("__bx_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sent.groupBy("shard", "__bx_range").count().select("shard", "__bx_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__bx_before"))
    inner = Window.partitionBy("shard", "__bx_range").orderBy(again, "__bx_at")
    placed = sent.withColumn("__bx_k", F.row_number().over(inner) - 1).join(ranges, ["shard", "__bx_range"])
    return placed.select(*(F.col(f"`{c}`") for c in own), "shard", (F.col("__bx_before") + F.col("__bx_k")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 0) -> None:
    """The rows of docs as Parquet, a folder shard=k for each shard, with the slot that each row has in it."""
    shuffled(docs, shards, seed).write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """One row a document: doc_id, size (UTF-8 bytes of the text and 8), text_crc32, law, shard, slot, grown_shard (null: the law is `rows`).

    A null text has size 8 and the checksum of an empty one. Texts are read once and not moved.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffled(slim, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
