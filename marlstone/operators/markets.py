"""Market listings: flattening, ordered union without duplicates, prices, first and latest rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.scalars import first_price, first_text, once


def flatten(events: DataFrame, nested: str, parents: Sequence[str] = ()) -> DataFrame:
    """A row for each element of the array of structs, with columns of its parent; null arrays give none."""
    return events.select(*parents, F.explode(F.coalesce(F.col(nested), F.array())).alias("m")).select(*parents, "m.*")


def union_first(sources: Sequence[DataFrame], key: Column, order: str = "ord") -> DataFrame:
    """All sources in turn, of each key the first row; rows without a key go.

    First means: in the earliest source, then by ``order``.
    """
    tagged = [df.withColumn("src", F.lit(k)) for k, df in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).withColumn("__key", key).where("__key is not null")
    place = F.row_number().over(Window.partitionBy("__key").orderBy("src", order))
    return both.withColumn("__n", place).where("__n = 1").drop("__n", "__key")


def market_key(*columns: str) -> Column:
    return first_text(*(F.col(c).cast("string") for c in columns))


def with_price(markets: DataFrame, book: DataFrame) -> DataFrame:
    """Add ``price`` and ``price_source``: the order book's price of the token, else the listing's own."""
    quoted = markets.join(book.select("token_id", F.col("price").alias("__book")), "token_id", "left")
    quoted = once(quoted, "__listed", first_price(F.col("outcome_prices")))
    source = F.when(F.col("__book").isNotNull(), F.lit("book")).when(F.col("__listed").isNotNull(), F.lit("listing"))
    return quoted.withColumns({"price": F.coalesce("__book", "__listed"), "price_source": source}).drop("__book", "__listed")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, most: int) -> DataFrame:
    """The first rows of each group in the given order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


def latest(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The last row of each key, by the given columns; a partial aggregate, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("row")).select(*keys, "row.*")


def recent(df: DataFrame, most: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The newest rows; equal times by ``tie``."""
    return df.orderBy(F.desc(ts), F.col(tie)).limit(most)


def unseen(batch: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key was not seen before; repeats inside the batch stay."""
    return batch.join(seen.select(*keys).distinct(), list(keys), "left_anti")


#: Bits of a filter of keys, at most: 16 MB to each executor, whatever the batch.
MOST_BITS = 1 << 27
_PAGE = 32_768


def key_place(keys: Sequence[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def key_bits(rows: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """(page, bitmap): a filter of the rows' keys, a page of 4 kB for each part that has any; pages add up by aggregation."""
    at = key_place(keys, bits)
    return rows.select(F.floor(at / _PAGE).cast("long").alias("page"), (at % _PAGE).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def possible(rows: DataFrame, pages: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """Rows whose key may be in the filter: all that are, and few others. Nothing is shuffled."""
    at = key_place(keys, bits)
    placed = rows.withColumns({"__page": F.floor(at / _PAGE).cast("long"), "__bit": (at % _PAGE).cast("int")})
    found = placed.join(F.broadcast(pages.select(F.col("page").alias("__page"), "bitmap")), "__page")  # MOST_BITS at most
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(byte.bitwiseAND(F.expr("shiftleft(1, __bit % 8)")) != 0).drop("__page", "__bit", "bitmap")


def unseen_of_many(batch: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``unseen`` for a seen side that is far larger than the batch: of it only rows that the batch's key filter lets through are shuffled.

    The batch is read three times: for its size, its filter, and itself.
    """
    wanted = max(batch.count(), 1) * 16
    bits = min(MOST_BITS, max(_PAGE, 1 << (wanted - 1).bit_length()))
    return unseen(batch, possible(seen.select(*keys), key_bits(batch, keys, bits), keys, bits), keys)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` replaces rows of equal key and adds the rest. Write the result to a new path and swap."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old`` are added."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def source_status(sources: Sequence[tuple[str, DataFrame]], text: str = "question") -> DataFrame:
    """(source, n, sample): rows and the first two questions of each source, by ``ord``."""

    def one(name: str, df: DataFrame) -> DataFrame:
        # each task keeps two rows, and the first two of those are joined
        head = df.orderBy("ord").limit(2).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", text))), lambda x: x[text]), " / ").alias("sample"))
        return df.agg(F.count(F.lit(1)).alias("n")).crossJoin(head).select(F.lit(name).alias("source"), "n", "sample", (F.col("n") > 0).alias("ok"))  # one row each

    return reduce(DataFrame.unionByName, [one(name, df) for name, df in sources])


def spot_prices(symbols: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """(symbol, spot): the first source's price, else the second's; symbols that neither has, or at 0, are left out."""
    first, second = primary.select("symbol", F.col("spot").alias("__a")), secondary.select("symbol", F.col("spot").alias("__b"))
    found = symbols.select("symbol").join(first, "symbol", "left").join(second, "symbol", "left")
    return found.select("symbol", F.coalesce("__a", "__b").alias("spot")).where("spot <> 0")


def all_ok(status: DataFrame) -> DataFrame:
    """One row: whether every source is fine; without sources it is."""
    return status.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_ok"), F.count(F.lit(1)).alias("sources"))


def running_counts(batches: DataFrame, order: str, *counters: str) -> DataFrame:
    """Totals after each cycle; the input has a row for each cycle."""
    so_far = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return batches.select(order, *(F.sum(c).over(so_far).alias(c) for c in counters))


def listing_pages(listed: DataFrame, pages: dict[str, tuple[Column, int]]) -> DataFrame:
    """(listing, place, ...): of each listing, a condition and a page size, the first rows in order.

    One pass: each row comes with the listings that it is in. No listing needs more than the
    largest page, so each task keeps only that many rows of each.
    """
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(name).alias("listing"), F.lit(size).alias("size"))) for name, (test, size) in pages.items())))
    rows = listed.withColumn("__in", F.explode(found)).select("*", "__in.listing", "__in.size").drop("__in")
    place = F.row_number().over(Window.partitionBy("listing").orderBy("ord"))
    return rows.withColumn("place", place).where(F.col("place") <= max(size for _, size in pages.values())).where("place <= size").drop("size")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row with that key; none where it is unknown."""
    return df.where(F.col(key) == value)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, columns that ``new`` lacks null."""
    return old.unionByName(new, allowMissingColumns=True)


def update(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``old`` with the columns of ``changes`` set where its key is named there, null values too; other keys of ``changes`` are ignored.

    Of several changes of one key any counts: reduce them first. Write the result as a new version.
    """
    columns = [c for c in changes.columns if c != key]
    held = changes.dropDuplicates([key]).select(key, F.struct(*columns).alias("__new"))
    both = old.join(held, key, "left")
    return both.select(*(F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns))


def prepend(new: DataFrame, old: DataFrame, most: int, order: str) -> DataFrame:
    """New rows ahead of old ones, each in their order, of all the first ``most``: (place, ...)."""
    both = new.withColumn("__src", F.lit(0)).unionByName(old.withColumn("__src", F.lit(1)))
    first = both.orderBy("__src", order).limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy("__src", order))).drop("__src")  # at most ``most`` rows


def nested_status(events: DataFrame, nested: str, title: str, order: str) -> DataFrame:
    """(n, nested, sample): parents, rows nested in them, and the first two titles."""
    head = events.orderBy(order).limit(2).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, title))), lambda x: x[title]), " / ").alias("sample"))
    return events.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(F.coalesce(F.col(nested), F.array()))), F.lit(0)).alias("nested")).crossJoin(head)  # one row each
