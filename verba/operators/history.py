"""History, users and ownership as relational Spark plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verba.sources.commits import CommittedTable

# ---- fixed values ----
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
MAX_FULL_NAME = 255
EMAIL_TAKEN = "Email already registered"
NOT_FOUND = "History item not found"


def history_count(history: DataFrame) -> DataFrame:
    """HIS1: rows per user (anonymous rows belong to nobody)."""
    return history.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))


def _newest_first():
    return [F.col("created_at").desc(), F.col("id").desc()]


def history_page(history: DataFrame, user_id: int, page: int, size: int) -> DataFrame:
    """HIS2: one user, newest first (id breaks ties), OFFSET (page-1)*size LIMIT size."""
    return (history.filter(F.col("user_id") == user_id).orderBy(*_newest_first())
            .offset((page - 1) * size).limit(size))


def write_clustered(history: DataFrame, path: str, row_group_bytes: int = 16 << 20) -> None:
    """HIS2, HIS9: history laid out for its lookups. Rows are range-partitioned and sorted by (user, newest first),
    so a user's page lies in one or a few row groups, which the reader finds by their least and greatest
    values; ids lie anywhere in that order and get Parquet bloom filters."""
    n = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("user_id").asc(), *_newest_first()]
    (history.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite")
     .option("parquet.bloom.filter.enabled#id", "true").option("parquet.block.size", row_group_bytes).parquet(path))


def history_after(history: DataFrame, user_id: int, after: tuple | None, size: int) -> DataFrame:
    """HIS2 by seeking: the ``size`` rows that follow the row with key ``after`` = (created_at, id), the last of
    the page before (None: the first page). The condition is on the columns that the table is clustered by, so
    page 1,000 reads as little as page 1, where an OFFSET reads all the pages before."""
    rows = history.filter(F.col("user_id") == user_id)
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        rows = rows.filter((F.col("created_at") <= at) & ((F.col("created_at") < at) | (F.col("id") < last)))
    return rows.orderBy(*_newest_first()).limit(size)


def history_pages_all_users(history: DataFrame, page: int, size: int) -> DataFrame:
    """HIS3: the same page cut for every user. The filter rn <= page*size lets Spark put a
    per-partition window group limit before the shuffle, so a user with a third of all rows
    ships at most page*size rows per map partition."""
    w = Window.partitionBy("user_id").orderBy(*_newest_first())
    lo, hi = (page - 1) * size, page * size
    ranked = history.filter(F.col("user_id").isNotNull()).withColumn("rn", F.row_number().over(w))
    return ranked.filter((F.col("rn") <= hi) & (F.col("rn") > lo))


def history_total_pages(history: DataFrame, size: int) -> DataFrame:
    """HIS4: ceil(total / size) per user."""
    return history_count(history).withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))


def delete_history_items(history: DataFrame, requests: DataFrame):
    """HIS5: requests (request_id, item_id, requester). An item goes only if it belongs to the requester, and
    once: of several requests for it the first by request_id deletes it, the rest (equal rows of one
    request included) don't find it any more. Returns (history kept, an outcome for each request row)."""
    h = history.select(F.col("id").alias("item_id"), F.col("user_id").alias("requester"))
    key = ["item_id", "requester"]
    asked = requests.groupBy("request_id", *key).agg(F.count(F.lit(1)).alias("_n"))
    first = asked.groupBy(*key).agg(F.min(F.struct("request_id")).alias("_first"))
    owned = first.join(h, key, "left_semi")
    kept = history.join(owned.select(F.col("item_id").alias("id"), F.col("requester").alias("user_id")), ["id", "user_id"], "left_anti")
    each = asked.join(owned, key, "left").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    hit = (F.col("_i") == 1) & F.col("_first").isNotNull() & F.struct("request_id").eqNullSafe(F.col("_first"))
    return kept, each.select("request_id", F.when(hit, F.lit("deleted")).otherwise(F.lit(NOT_FOUND)).alias("outcome"))


def delete_all_history(history: DataFrame, users: DataFrame):
    """HIS6: remove all rows of the given users; deleted_count per user (zero kept), once for a user listed twice."""
    users = users.select("user_id").distinct()
    counts = history.join(users, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("deleted_count"))
    per_user = users.join(counts, "user_id", "left").select(
        "user_id", F.coalesce("deleted_count", F.lit(0)).cast("long").alias("deleted_count"))
    return history.join(users, "user_id", "left_anti"), per_user


def active_user_results(history: DataFrame, users: DataFrame) -> DataFrame:
    """HIS7: only active users' rows count as owned."""
    active = users.filter("is_active").select(F.col("id").alias("user_id"))
    return history.join(active, "user_id", "left_semi")


def results_with_user(history: DataFrame, users: DataFrame) -> DataFrame:
    """HIS8: rows beside their owner; anonymous rows kept."""
    return history.join(users.select(F.col("id").alias("user_id"), "email", "is_active"), "user_id", "left")


def lookup_by_key(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """HIS9 bulk form: rows whose key is in the key list."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def insert_new_users(existing: DataFrame, batch: DataFrame):
    """VAL7: insert users whose email is new. Rows are validated first: a bad or missing email or an
    over-long name rejects that row alone. Of the valid rows of an email that is not registered, one is
    inserted: the first by seq, then by its other columns; the rest count as registered, equal rows
    included. Returns (inserted, rejected) — rejected carries a reason."""
    shape_ok = F.coalesce(F.col("email").rlike(EMAIL_SHAPE), F.lit(False)) & (F.coalesce(F.length("full_name"), F.lit(0)) <= MAX_FULL_NAME)
    cols = batch.columns
    rest = ["seq", *[c for c in cols if c not in ("email", "seq")]]
    bad = batch.filter(~shape_ok).withColumn("reason", F.lit("Invalid email or name"))
    valid = batch.filter(shape_ok)
    taken = valid.join(existing.select("email"), "email", "left_semi").select(*cols).withColumn("reason", F.lit(EMAIL_TAKEN))
    fresh = valid.join(existing.select("email"), "email", "left_anti").groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    # first row per email by a combinable min (no window over a possibly hot email)
    first = fresh.groupBy("email").agg(F.min(F.struct(*rest)).alias("_first"))
    marked = fresh.join(first, "email").withColumn("_is", F.struct(*rest).eqNullSafe(F.col("_first")))
    inserted = marked.filter("_is").select(*cols)
    extra = F.col("_n") - F.col("_is").cast("int")
    later = marked.filter(extra > 0).select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), extra))).select(*cols)
    return inserted, bad.unionByName(taken).unionByName(later.withColumn("reason", F.lit(EMAIL_TAKEN)))


def save_user_results(results: DataFrame, table: CommittedTable, batch: str, before_commit=None) -> bool:
    """SNK4: append the results of a job's batch to the saved history, those with a known user; anonymous ones
    are dropped. False if that batch is saved already: a job may be run again from any point."""
    return table.append(results.filter(F.col("user_id").isNotNull()), batch, before_commit)
