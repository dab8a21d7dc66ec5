"""Blocks that meet tile by tile: each pair once, ids of two kinds, few copies of a row."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import ranking, write
from mnemospark.operators.ranking import tiled_blocks


@pytest.mark.parametrize("block_rows, tile", [(40, 7), (1000, 16), (1000, 1000)])
def test_every_pair_of_a_key_meets_once(spark, block_rows, tile):
    left = spark.range(90).select(F.concat(F.lit("n"), "id").alias("id"), (F.col("id") % 2).alias("k"))
    right = spark.range(70).select((F.col("id") + 2**60 + 1).alias("id"), (F.col("id") % 3).alias("k"))

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        assert len(a) <= tile and len(b) <= tile
        return a.merge(b, how="cross")[["l_id", "r_id"]]

    got = [tuple(r) for r in tiled_blocks(left, right, ["k"], match, "l_id string, r_id long", block_rows, tile).collect()]
    want = {(r.l, r.r) for r in left.withColumnRenamed("id", "l").join(right.withColumnRenamed("id", "r"), "k").collect()}
    assert len(got) == len(want) and set(got) == want


def test_links_of_several_tiles_are_whole(spark):
    new = spark.range(3000).select("id", F.lit("p").alias("project_id"), F.concat(F.lit("word alpha"), F.col("id") % 1500, F.lit(" beta"), F.col("id") % 1500).alias("summary"),
                                   F.lit(None).cast("array<float>").alias("context_vector"))
    old = new.withColumn("id", F.col("id") + 100000).withColumn("obsoleted_at", F.lit(None).cast("timestamp")).withColumn("weight", F.lit(1.0))
    # Each pair of rows with the same words links: 1500 texts, two rows on either side.
    linked = write.related_links(new, old).filter(F.col("strength") == 1.0)
    assert linked.count() == 6000 and linked.distinct().count() == 6000


@pytest.mark.parametrize("kind", ["vectors", "grams"])
def test_a_block_is_held_by_a_few_left_rows_at_a_time(kind):
    """One full square of doubles of such a block takes 72 MB; before, a block held several of them."""
    rng, n = np.random.default_rng(3), 3000
    if kind == "vectors":
        left, right = (pd.DataFrame({f"{side}_id": np.arange(n), "vector": list(rng.normal(size=(n, 4))), "position": 0.0}) for side in ("left", "right"))
        match, more = (lambda t: ranking._rank_block(5, False, tile=t)), right.assign(right_weight=0.5, until=np.inf)
    else:
        grams = [np.unique(g) for g in rng.integers(0, 500, (n, 20))]
        left = pd.DataFrame({"l_id": np.arange(n), "l_grams": grams, "l_refs": [[]] * n, "l_after": np.nan, "l_before": np.nan})
        match, more = (lambda t: ranking._overlap_block(5, 0.0, tile=t)), pd.DataFrame({"r_id": np.arange(n), "r_grams": grams, "r_name": None, "r_at": np.nan})
    tracemalloc.start()
    got = match(ranking.TILE)(left, more)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1e8 and len(got) == 5 * n
    key = [c for c in got.columns if c.endswith("_id")]
    one = match(n)(left, more)
    assert sorted(map(tuple, got[key].to_numpy().tolist())) == sorted(map(tuple, one[key].to_numpy().tolist()))
