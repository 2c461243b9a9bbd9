"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into 16-bit segments, and the index has a row for each code and segment. Two codes at most ``m*(r+1) - 1``
bits apart, with m segments, have a segment at most r bits apart. So the search probes every segment of a query with all
values r bits away, for r = 0, 1, 2, ...; each code that a probe meets is verified by its whole distance. A query is done
when its k-th verified distance is covered by the radius; only the others go on.

A code that several probes meet is verified for one of them: its nearest segment, the first of equals. Rows with equal
codes are one entry of the index, and at most k + 1 of them can be among the k nearest. Spark's functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigscope.llm.tables import materialize

SEGMENT = 16
FIRST_RADIUS = 2     # radii up to this one are probed in the first round


def sign_bits(embedding: Column, bits: int) -> list[Column]:
    """Long columns with bit i set where entry i of the embedding is above zero (nulls and missing entries are not)."""
    word = lambda w: reduce(Column.bitwiseOR, (
        F.when(F.get(embedding, F.lit(i)) > 0, F.shiftleft(F.lit(1).cast("long"), i % 64)).otherwise(F.lit(0).cast("long"))
        for i in range(w, min(w + 64, bits))))
    return [word(w) for w in range(0, bits, 64)]


def _segments(words: list[Column], bits: int) -> list[Column]:
    return [F.shiftrightunsigned(words[b // 64], b % 64).bitwiseAND(F.lit((1 << min(SEGMENT, bits - b)) - 1)).cast("int")
            for b in range(0, bits, SEGMENT)]


def _within(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts every task's groups to n rows before it shuffles them."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(f"_rank <= {n}")


def nearest(rows: DataFrame, queries: Column, k: int, bits: int, id_col: str = "vec_id",
            embedding_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbour_id, distance): for each row where ``queries`` holds, the k other rows whose sign bits
    are the fewest bits away, equals by id; fewer if there are no more.

    Rows without an id or embedding take no part. A row counts once however often it is repeated; the rows of an id are
    never neighbours of that id. Other columns are not read; an empty table gives no rows.
    """
    names = [f"w{i}" for i in range(-(-bits // 64))]
    words = [c.alias(n) for c, n in zip(sign_bits(F.col(embedding_col), bits), names)]
    kept = rows.where(F.col(id_col).isNotNull() & F.col(embedding_col).isNotNull())
    points = kept.select(F.col(id_col).alias("id"), queries.alias("asks"), *words)
    points = materialize(points.groupBy("id", *names).agg(F.max("asks").alias("asks")), "search-points")
    members = materialize(_within(points.select("id", *names), names, ["id"], k + 1).select("id", *names), "search-members")
    asked = points.where("asks").select("id", *names)
    found = _nearest_codes(members.groupBy(*names).agg(F.min("id").alias("least")), asked.select(*names).distinct(),
                           k + 1, bits, names)
    other = [f"c{i}" for i in range(len(names))]
    known = members.select(F.col("id").alias("neighbour_id"), *[F.col(n).alias(c) for n, c in zip(names, other)])
    pairs = (asked.withColumnRenamed("id", "query_id").join(found, names).join(known, other)
             .where("neighbour_id <> query_id")
             .groupBy("query_id", *names, "neighbour_id").agg(F.min("distance").alias("distance")))
    best = _within(pairs, ["query_id", *names], ["distance", "neighbour_id"], k)
    return best.select("query_id", F.col("_rank").alias("rank"), "neighbour_id", F.col("distance").cast("int").alias("distance"))


def _nearest_codes(codes: DataFrame, queries: DataFrame, n: int, bits: int, names: list[str]) -> DataFrame:
    """(query's words, code's words c0.., distance): at least the n codes nearest to each query, by (distance, least id).

    Any code behind n others has n better rows before its first one, so n = k + 1 codes hold the k best rows beside the
    query's own."""
    m = -(-bits // SEGMENT)
    segments = lambda words: F.posexplode(F.array(*_segments([F.col(w) for w in words], bits))).alias("segment", "value")
    other = [f"c{i}" for i in range(len(names))]
    codes = codes.select(*[F.col(a).alias(b) for a, b in zip(names, other)], "least")
    index = materialize(codes.select(*other, "least", segments(other)), "search-index")
    tasks = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = codes.count()
    wanted = min(n, total)
    active = materialize(queries.withColumn("bound", F.lit(bits)), "search-queries")
    done, best, low, high = None, None, 0, min(FIRST_RADIUS, SEGMENT)
    apart = [F.col(a).bitwiseXOR(F.col(b)) for a, b in zip(names, other)]
    distance = reduce(Column.__add__, (F.bit_count(x) for x in apart))
    near = [F.bit_count(x) * m + i for i, x in enumerate(_segments(apart, bits))]
    first = F.least(*near) if m > 1 else near[0]
    while wanted and not active.isEmpty():
        masks = F.filter(F.sequence(F.lit(0), F.lit((1 << SEGMENT) - 1)), lambda x: F.bit_count(x).between(low, high))
        # a few queries make many probes: dealt out first, or one task would make them all
        dealt = active.select(*names, "bound", segments(names)).repartition(tasks, *names, "segment")
        probes = dealt.select("*", F.explode(masks).alias("mask"))
        probes = probes.select(*names, "bound", "segment", F.bit_count("mask").alias("off"),
                               F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        # Spark can't foresee how many probes the few queries make, and would send them all to every task
        met = (probes.join(index.hint("merge"), ["segment", "value"]).where(first == F.col("off") * m + F.col("segment"))
               .select(*names, *other, "least", "bound", distance.alias("distance")).where("distance <= bound"))
        met = met.select(*names, *other, "least", "distance")
        met = met if best is None else met.unionByName(best)
        best = materialize(_within(met, names, ["distance", "least"], wanted).drop("_rank"), "search-best")
        covered = m * (high + 1) - 1
        state = best.groupBy(*names).agg(F.count("*").alias("n"), F.max("distance").alias("bound"))
        state = active.drop("bound").join(state, names, "left").withColumn("n", F.coalesce("n", F.lit(0)))
        over = (F.col("n") >= wanted) & (F.col("bound") <= covered)
        ready = best.join(state.where(over).select(*names), names, "left_semi").drop("least")
        done = ready if done is None else done.unionByName(ready)
        bound = F.when(F.col("n") >= wanted, F.col("bound")).otherwise(F.lit(bits)).alias("bound")
        active = materialize(state.where(~over).select(*names, bound), "search-queries")
        best = best.join(active.select(*names), names, "left_semi")
        low, high = high + 1, high + 1
    if done is None:                                          # nothing was asked, or there is nothing to find
        kinds = ", ".join(f"{c} long" for c in (*names, *other))
        done = codes.sparkSession.createDataFrame([], f"{kinds}, distance int")
    return done


def op2_sql(k: int = 10, bits: int = 64) -> str:
    """DuckDB SQL for ``queries.op2_exact_top_k``: every query against every row."""
    return f"""
WITH code AS (
  SELECT vec_id, list_sum(list_transform(range({bits}), lambda i:
    CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << i ELSE 0::HUGEINT END))::UBIGINT AS word
  FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, CAST(bit_count(xor(q.word, c.word)) AS INTEGER) AS distance
  FROM code q JOIN code c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= {k}
"""
