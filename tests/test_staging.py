"""What staging leaves on disk."""

import time

from helixlake.plans.staging import stage, unstage


def test_shuffles_end_with_the_write(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: {x for i in range(blocks.getAllFiles().size()) if (x := blocks.getAllFiles().apply(i).getName()).startswith("shuffle_")}
    before = shuffles()
    rows = spark.range(20_000).selectExpr("id", "id % 77 as x").repartition(4, "id")
    made = stage(rows.join(rows.groupBy("x").count(), "x"), "left")
    deadline = time.time() + 5
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not shuffles() - before and made.count() == rows.count() == 20_000
    unstage(made)
