"""Ordered work on keyed series whose keys may be arbitrarily large.

A window over a whole key puts the key into one task. These helpers cut every key into chunks of
its order column, work per (key, chunk), and carry what must cross a chunk's edge through a
summary with one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazeloom.session import cut_lineage

BEFORE = (W.unboundedPreceding, -1)
SPAN = 1 << 14
"""Chunks of a key that one window over chunks holds; spans of chunks are added up one level higher."""


def carried(
    df: DataFrame, keys: list[str], chunk: str, order: list[str], sums: dict[str, Column] | None = None,
    last: list[str] | None = None, first: list[str] | None = None,
) -> DataFrame:
    """What crosses the edges of chunks, one row per (keys, chunk).

    - for each name of sums: name, its total over the key's earlier chunks, and name_all, over all;
    - with last: _previous, a struct of these fields of the last row before the chunk;
    - with first: _next, a struct of these fields of the first row after the chunk, and _first, of
      the key's first row.

    One row per chunk leaves the partial aggregation. The rest goes in two levels: over the chunks
    of a span of SPAN chunk numbers, and over spans. So a window stays small also where the order is
    sparse (microseconds since an epoch, say) and each chunk has few rows.
    """
    names, sort = list(sums or {}), F.struct(*order)
    own = [F.sum(c).alias(n) for n, c in (sums or {}).items()]
    own += [F.max_by(F.struct(*last), sort).alias("_l")] if last else []
    own += [F.min_by(F.struct(*first), sort).alias("_f")] if first else []
    # the span is an aggregate, so that a join's filter on it stays above, and df's own shuffle is the same for all its readers
    span = F.max(F.floor(F.col(chunk) / SPAN)).alias("_span")
    chunks = df.groupBy(*keys, chunk).agg(*own, span).repartition(*keys, "_span")

    def over(rows: DataFrame, by: list[str], place: str) -> list[Column]:
        w = W.partitionBy(*by).orderBy(place)
        whole = W.partitionBy(*by)
        found = [c for n in names for c in (F.coalesce(F.sum(n).over(w.rowsBetween(*BEFORE)), F.lit(0)).alias(f"_b{n}"), F.sum(n).over(whole).alias(f"_a{n}"))]
        found += [F.lag("_l").over(w).alias("_p")] if last else []
        found += [F.lead("_f").over(w).alias("_n"), F.first("_f").over(w).alias("_1")] if first else []
        return found

    ends = [F.sum(n).alias(n) for n in names] + ([F.max_by("_l", chunk).alias("_l")] if last else []) + ([F.min_by("_f", chunk).alias("_f")] if first else [])
    spans = chunks.groupBy(*keys, "_span").agg(*ends, F.max(chunk).alias("_most"))
    spans = spans.select(*keys, "_span", "_most", *over(spans, keys, "_span"))
    spans = spans.select(*keys, "_span", "_most", *[F.col(c).alias(f"_s{c}") for c in spans.columns if c not in (*keys, "_span", "_most")])
    within = chunks.select(*keys, chunk, "_span", *over(chunks, [*keys, "_span"], chunk))
    # the condition always holds; with it both sides need all columns, so they are the same shuffle
    both = within.join(spans, [*keys, "_span"]).where(F.col(chunk) <= F.col("_most"))
    out = [c for n in names for c in ((F.col(f"_b{n}") + F.col(f"_s_b{n}")).alias(n), F.col(f"_s_a{n}").alias(f"{n}_all"))]
    out += [F.coalesce("_p", "_s_p").alias("_previous")] if last else []
    out += [F.coalesce("_n", "_s_n").alias("_next"), F.col("_s_1").alias("_first")] if first else []
    return both.select(*keys, chunk, *out)


def prefix_sums(df: DataFrame, keys: list[str], chunk: str, sums: dict[str, Column]) -> DataFrame:
    """Per (keys, chunk): for each name of sums, its total over the key's earlier chunks."""
    return carried(df, keys, chunk, [chunk], sums).select(*keys, chunk, *sums)


def with_position(df: DataFrame, keys: list[str], chunk: str, order: list[str], out: str) -> DataFrame:
    """Adds the 0-based position of each row within its keys by order, without a window per key.

    chunk must not fall as order rises. Rows with a null key are dropped.
    """
    base = prefix_sums(df, keys, chunk, {"_before": F.lit(1)})
    inside = W.partitionBy(*keys, chunk).orderBy(*order)
    return (
        df.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(base, [*keys, chunk])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside")
    )


def with_next(df: DataFrame, keys: list[str], chunk: str, order: list[str], fields: list[str], out: str) -> DataFrame:
    """Adds a struct of the following row's fields (null in a key's last row), across chunks."""
    return _with_neighbour(df, keys, chunk, order, fields, out, forward=True)


def with_previous(df: DataFrame, keys: list[str], chunk: str, order: list[str], fields: list[str], out: str) -> DataFrame:
    """Adds a struct of the preceding row's fields (null in a key's first row), across chunks."""
    return _with_neighbour(df, keys, chunk, order, fields, out, forward=False)


def _with_neighbour(df, keys, chunk, order, fields, out, forward):
    side = {"first": fields} if forward else {"last": fields}
    edge = carried(df, keys, chunk, order, **side).select(*keys, chunk, F.col("_next" if forward else "_previous").alias("_edge"))
    inside = W.partitionBy(*keys, chunk).orderBy(*order)
    step = F.lead if forward else F.lag
    return (
        df.withColumn("_inside", step(F.struct(*fields)).over(inside))
        .join(edge, [*keys, chunk])
        .withColumn(out, F.coalesce("_inside", "_edge"))
        .drop("_inside", "_edge")
    )


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows sorted into ranges of order, written once: adds _part (number of the range) and _inside (0-based place in it).

    Ranges are of about equal size whatever the values are, and rise with order. What must cross a
    range's edge goes through a summary of one row per range. Ties fall in any order.
    """
    place = F.monotonically_increasing_id()  # the partition's number above 33 bits of the row's
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    rows = cut_lineage(sorted_rows)
    return rows.select(*df.columns, F.shiftright("_place", 33).alias("_part"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_inside"))


def clean_number(column: Column | str) -> Column:
    """The column with NaN as null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(column), column)


def known(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows in which no column is null, by plain conditions.

    Said so before a shuffle, a later join on these columns adds no filter of its own to one side,
    and both of its sides can share the shuffle.
    """
    for column in columns:
        df = df.where(F.col(column).isNotNull())
    return df


BLOCK = 1 << 14
"""Rows of a key that one window over blocks holds, besides its neighbours."""


def in_blocks(df: DataFrame, keys: list[str], order: str, before: int, after: int = 0, size: int = BLOCK) -> DataFrame:
    """Adds _at (0-based position by order), _block and _core, and repeats rows near a block's edges.

    Every block of `size` rows of a key also gets the `before` rows that precede it and the `after`
    rows that follow it, with _core false. A window over (keys, _block) by order then sees for each
    core row what a window over the whole key would, as far as `before` rows back and `after` rows
    ahead, while no task holds a key as a whole. order is a whole number that is unique in a key;
    rows with a null key or order are left out.
    """
    if before > size or after > size:
        raise ValueError("a block must be larger than what its windows look back on or ahead to")
    rows = known(df.withColumn("_chunk", F.floor(F.col(order) / size)), [*keys, "_chunk"])
    rows = with_position(rows.repartition(*keys, "_chunk"), keys, "_chunk", [order], "_at").drop("_chunk")
    block, place = F.floor(F.col("_at") / size), F.col("_at") % size
    copy = lambda to, core: F.struct(to.alias("_block"), F.lit(core).alias("_core"))
    copies = F.array(
        copy(block, True),
        F.when((place < after) & (block > 0), copy(block - 1, False)),
        F.when(place >= size - before, copy(block + 1, False)),
    )
    return rows.select("*", F.inline(F.filter(copies, lambda c: c.isNotNull())))
