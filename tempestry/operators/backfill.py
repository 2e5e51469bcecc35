"""Examples completed in place: missing columns filled from what can be had, only changed rows written anew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempestry.operators.fits import store, stored
from tempestry.operators.tables import kept


def plan(examples: DataFrame, found: DataFrame, key: str, columns: Sequence[str], force: bool = False) -> DataFrame:
    """examples with filled values and `status`: complete (nothing was missing), updated (all of it was found), partial
    (some of it), failed (none of it). A row of `found` may lack columns' values too. With `force`, all columns are
    looked for again, and a value that isn't found stays as it was. Keys of found that no example has are ignored; of
    its rows of one key the smallest counts.
    """
    one = found.groupBy(key).agg(F.min(F.struct(*columns)).alias("_found"))
    both = examples.join(one, key, "left")
    asked = {c: F.lit(True) if force else F.col(c).isNull() for c in columns}
    got = {c: F.col(f"_found.{c}").isNotNull() & asked[c] for c in columns}
    n_asked, n_got = (sum((x.cast("int") for x in w.values()), F.lit(0)) for w in (asked, got))
    status = F.when(n_asked == 0, "complete").when(n_got == n_asked, "updated").when(n_got > 0, "partial").otherwise("failed")
    filled = {c: F.when(got[c], F.col(f"_found.{c}")).otherwise(F.col(c)) for c in columns}
    # values and status look at the same columns, so they are made in one step
    return both.select(*(filled[c].alias(c) if c in filled else F.col(c) for c in examples.columns), status.alias("status"))


def run(spark: SparkSession, path: str, found: DataFrame, key: str, columns: Sequence[str], dry_run: bool = False, force: bool = False) -> DataFrame:
    """key, status of each example at a path (fits.store), whose changed rows are added as a new version.

    A dry run writes nothing and says would-update where something is missing. Run again with the same findings, no row
    changes, so nothing is written. A run that is lost has written nothing that counts.
    """
    before = stored(spark, path, [key])
    after = plan(before, found, key, columns, force)
    if dry_run:
        return after.select(key, F.when(F.col("status") == "complete", "complete").otherwise("would-update").alias("status"))
    columns_ = [c for c in after.columns if c != "status"]
    old = before.select(key, F.struct(*columns).alias("_old"))
    changed = after.join(old, key).where(~F.struct(*columns).eqNullSafe(F.col("_old"))).select(*columns_)
    statuses = after.select(key, "status")
    if not changed.isEmpty():
        statuses = kept(statuses, "statuses")  # what was found, before the examples change
        store(changed, path)
    return statuses

