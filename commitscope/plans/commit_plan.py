"""OP-36: the commit plan as a table (no git is run).

Steps per key: 0 unstage everything; for the k-th selected candidate (in
execution order) 1+2k stage its files and 2+2k commit its message; finally
1+2n restage the files of unselected candidates, if any.  Step numbers let
a runner stop at the first failure and report it, as the original does.

Nothing is collected per key: ``k`` is a bucketed running count (a session
holding a third of all candidates still spreads over many tasks), a stage
row lists one candidate's files (bounded by that candidate row), and the
restage step is one row per leftover file, ordered by ``file_ord``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scans import running_count


def commit_plan(selected: DataFrame, leftovers: DataFrame, keys: list[str],
                order_col: str = "list_pos") -> DataFrame:
    """``selected``: keys, candidate_id, message, files, order_col;
    ``leftovers``: keys, list_pos, file_pos, path (from ``unselected_files``).
    Output: keys, step, action, files, message, file_ord.  Keys without a
    selected candidate get no plan.

    Each ranked candidate emits its own step rows with one ``explode``
    (the first one also emits ``unstage_all``), so the selection is read by
    one branch; the restage rows come from the leftovers."""
    ranked = running_count(selected, keys, [order_col], "_k")
    null_s = F.lit(None).cast("string")
    k = F.col("_k")

    def step(number, action, files, message):
        return F.struct(number.cast("int").alias("step"), F.lit(action).alias("action"),
                        files.alias("files"), message.alias("message"))
    steps = F.array(
        F.when(k == 0, step(F.lit(0), "unstage_all", null_s, null_s)),
        step(1 + 2 * k, "stage", F.array_join("files", ","), null_s),
        step(2 + 2 * k, "commit", null_s, F.col("message")))
    planned = (ranked.select(*keys, F.explode(steps).alias("s")).filter(F.col("s").isNotNull())
               .select(*keys, "s.*", F.lit(None).cast("int").alias("file_ord")))
    n_sel = selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    left = running_count(leftovers, keys, ["list_pos", "file_pos"], "_f")
    restage = (left.join(n_sel, keys)
               .select(*keys, (1 + 2 * F.col("_n")).cast("int").alias("step"), F.lit("restage").alias("action"),
                       F.col("path").alias("files"), null_s.alias("message"), F.col("_f").cast("int").alias("file_ord")))
    return planned.unionByName(restage)
