"""Listing, lookup and maintenance of datasets and examples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.functions.columns import metadata_text, stable_id
from evalspark.operators.changes import deleted_datasets
from evalspark.operators.ranking import page, top_k_per_key
from evalspark.operators.row_functions import REQUIRED, tried
from evalspark.sources.adapters import Adapter

SAMPLE_ROWS = 3
POSITION_BUCKETS = 4096


# -- reading -------------------------------------------------------------------------------------


def list_examples(
    examples: DataFrame,
    dataset_id: int | None = None,
    subject: str | None = None,
    limit: int = 20,
    offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """A page of examples by id, and the one-row total of the same filter."""
    schemas.check_page(limit, offset)
    found = examples
    if dataset_id is not None:
        found = found.where(F.col("dataset_id") == dataset_id)
    if subject is not None:
        found = found.where(metadata_text(found, "subject") == subject)
    return page(found, [F.asc("id")], limit, offset), found.agg(F.count("*").alias("total"))


def list_examples_after(
    examples: DataFrame,
    after_id: int | None = None,
    dataset_id: int | None = None,
    subject: str | None = None,
    limit: int = 20,
) -> DataFrame:
    """The page by id that follows ``after_id``, the last id of the page before; no rows are skipped one by one.

    The first step reads ids and filter columns alone and ends with the page's last id. The second reads whole rows
    between the two ids: over files sorted by id (``write_examples``) these are the row groups that hold the page.
    """
    schemas.check_page(limit, 0)
    found = examples if after_id is None else examples.where(F.col("id") > after_id)
    if dataset_id is not None:
        found = found.where(F.col("dataset_id") == dataset_id)
    if subject is not None:
        found = found.where(metadata_text(found, "subject") == subject)
    ids = page(found.select("id"), [F.asc("id")], limit)
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    if high is None:
        return found.where(F.lit(False))
    return page(found.where((F.col("id") >= low) & (F.col("id") <= high)), [F.asc("id")], limit)


def lookup(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of a table whose ``id`` is wanted; ids of any number, by semi join."""
    return table.join(ids.select("id"), "id", "left_semi")


def list_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.orderBy("name")


def dataset_counts(datasets: DataFrame, examples: DataFrame) -> DataFrame:
    """Example count of every dataset, zero included."""
    counted = examples.groupBy(F.col("dataset_id").alias("id")).agg(F.count("*").alias("n"))
    return datasets.join(counted, "id", "left").withColumn(
        "example_count", F.coalesce("n", F.lit(0).cast("long"))
    ).drop("n")


def dataset_subjects(examples: DataFrame, dataset_id: int | None = None) -> DataFrame:
    """Subject distribution; examples without a subject are left out."""
    if dataset_id is not None:
        examples = examples.where(F.col("dataset_id") == dataset_id)
    subject = metadata_text(examples, "subject").alias("subject")
    return (
        examples.select("dataset_id", subject)
        .where(F.col("subject").isNotNull())
        .groupBy("dataset_id", "subject")
        .agg(F.count("*").alias("n"))
    )


def ingest_audit(examples: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Total of every dataset beside its first rows."""
    narrow = examples.select("dataset_id", "id")
    totals = narrow.groupBy("dataset_id").agg(F.count("*").alias("total"))
    first = top_k_per_key(narrow, ["dataset_id"], [F.asc("id")], rows, "sample_no", spread=["id"])
    return first.join(totals, "dataset_id")


# -- ingest --------------------------------------------------------------------------------------


def take_in_split_order(raw: DataFrame, splits: tuple[str, ...], limit: int) -> DataFrame:
    """The first ``limit`` rows, split after split in the declared order, by source position.

    Whole splits are kept by name and the one split that is cut by a position bound, so no row is
    sorted or moved and the filter reaches the scan. Counting reads the split and position columns.
    """
    sizes = {
        row["split"]: row
        for row in raw.where(F.col("split").isin(*splits))
        .groupBy("split")
        .agg(F.count("*").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"))
        .collect()
    }
    keep = F.lit(False)
    for split in splits:
        if limit <= 0:
            break
        if split not in sizes:
            continue
        inside = F.col("split") == split
        found = sizes[split]
        if found["n"] > limit:
            rows = raw.where(inside).select("pos")
            inside &= F.col("pos") <= _nth_position(rows, found["low"], found["high"], limit)
        keep |= inside
        limit -= found["n"]
    return raw.where(keep)


def _nth_position(rows: DataFrame, low: int, high: int, n: int) -> int:
    """The n-th smallest position in [low, high], by histograms of ever smaller ranges."""
    while low < high:
        width = -(-(high - low + 1) // POSITION_BUCKETS)
        bucket = F.floor((F.col("pos") - low) / width)
        counted = rows.where(F.col("pos").between(low, high)).groupBy(bucket.alias("b")).count()
        for row in counted.orderBy("b").collect():
            if row["count"] >= n:
                low, high = low + row["b"] * width, min(high, low + (row["b"] + 1) * width - 1)
                break
            n -= row["count"]
    return low


def register(known: DataFrame, offered: DataFrame) -> DataFrame:
    """Known datasets plus the offered ones with a new name; ids of new ones follow the name."""
    fresh = offered.dropDuplicates(["name"]).join(known.select("name"), "name", "left_anti")
    fresh = fresh.withColumn("id", stable_id(F.col("name")))
    return known.withColumn("is_new", F.lit(False)).unionByName(
        fresh.select(*known.columns).withColumn("is_new", F.lit(True))
    )


def write_examples(examples: DataFrame, path: str) -> None:
    """Appends or replaces whole dataset partitions: ingesting a dataset again replaces it.

    Rows are dealt by ranges of (dataset, id) and sorted, so that a file holds a range of ids, its row groups tell apart
    what an id lookup or a page needs, and a dataset of any size is written by many tasks.
    """
    key = ["dataset_id", "id"]
    (
        examples.repartitionByRange(*key)
        .sortWithinPartitions(*key)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_id")
        .parquet(path)
    )


def subject_stats(examples: DataFrame) -> DataFrame:
    """Per dataset ``{"subjects": {subject: count}}`` as JSON text."""
    counted = examples.groupBy(
        "dataset_id", metadata_text(examples, "subject").alias("subject")
    ).agg(F.count("*").alias("n"))
    return counted.groupBy("dataset_id").agg(
        F.to_json(F.struct(_count_map("subject", "n").alias("subjects"))).alias("stats")
    )


def _count_map(key: str, value: str) -> Column:
    """A map of counted labels; one entry per split or subject of a dataset."""
    entries = F.array_sort(
        F.collect_list(F.when(F.col(key).isNotNull(), F.struct(F.col(key), F.col(value))))
    )
    return F.map_from_entries(entries)


def stats_record(examples: DataFrame, adapter: Adapter | None = None) -> DataFrame:
    """Per dataset ``{total_examples, splits{}, ...}``; subjects join in where the source has them."""
    counted = examples.groupBy(
        "dataset_id", metadata_text(examples, "split").alias("split")
    ).agg(F.count("*").alias("n"))
    base = counted.groupBy("dataset_id").agg(
        F.sum("n").alias("total_examples"), _count_map("split", "n").alias("splits")
    )
    members = [F.col("total_examples"), F.col("splits")]
    if adapter is not None and adapter.stats_by is not None:
        custom = examples.groupBy(
            "dataset_id", metadata_text(examples, adapter.stats_by).alias("label")
        ).agg(F.count("*").alias("n"))
        custom = custom.groupBy("dataset_id").agg(_count_map("label", "n").alias("subjects"))
        base = base.join(custom, "dataset_id")
        members.append(F.col("subjects"))
    return base.select("dataset_id", F.to_json(F.struct(*members)).alias("stats"))


def row_errors(parsed: DataFrame) -> DataFrame:
    """Every parsed row with its list of errors; a missing column is an error of each row."""
    checks = []
    for name in REQUIRED:
        missing = name not in parsed.columns
        flag = F.lit(True) if missing else F.col(name).isNull()
        if name != "question" or missing:
            checks.append(F.when(flag, F.lit(f"missing {name}")))
    if "question" in parsed.columns:
        empty = F.coalesce(F.length("question"), F.lit(0)) == 0
        checks.append(F.when(empty, F.lit("question is empty or None")))
    return parsed.withColumn("errors", F.array_compact(F.array(*checks)))


def error_summary(parsed: DataFrame) -> DataFrame:
    """How many rows show each error, and how many none."""
    checked = row_errors(parsed).select(
        F.explode(
            F.when(F.size("errors") == 0, F.array(F.lit("ok"))).otherwise(F.col("errors"))
        ).alias("error")
    )
    return checked.groupBy("error").agg(F.count("*").alias("n"))


def ingest_custom(
    raw: DataFrame, parse_row: Callable[[dict, int, str], dict], dataset_id: int
) -> DataFrame:
    """Examples from a caller's row function, run on the executors batch by batch.

    ``raw`` carries ``split`` and a unique ``pos``; the split ends up in the metadata. A row that fails ends the job with
    its position and reason; ``row_functions.ingest_checked`` sets such rows aside.
    """
    results = tried(raw, parse_row, dataset_id, lenient=True)
    reason = F.concat(F.lit("row "), F.col("pos").cast("string"), F.lit(": "), F.array_join("errors", "; "))
    question = F.when(F.size("errors") > 0, F.raise_error(reason)).otherwise(F.col("question"))
    return results.withColumn("question", question).drop("errors", "source")


# -- referential actions -------------------------------------------------------------------------


def cascade_delete(
    examples: DataFrame, links: DataFrame, events: DataFrame, deleted: DataFrame, key: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deletes datasets: their examples and links go, events stay with the ids set to NULL.

    ``deleted`` lists the values of ``key``, the dataset column of ``examples``, beside dataset_id.
    """
    gone = deleted.select(key).distinct()
    gone_ids = examples.join(gone, key, "left_semi").select("id")
    changes = deleted_datasets(gone, deleted.select("dataset_id"), gone_ids, key)
    return (
        changes.applied(examples, "examples"),
        changes.applied(links, "links"),
        changes.applied(events, "events"),
    )
