"""Similar pairs without a stored copy of every set."""

import random
import re
from pathlib import Path

import pytest

from sparkloom import plans
from sparkloom.operators import duplicates
from sparkloom.session import shared_folder


def left(spark) -> int:
    return sum(p.stat().st_size for p in Path(re.sub("^file:/*", "/", shared_folder(spark))).rglob("*.parquet"))


@pytest.mark.parametrize("name", ["j06_band_recall", "l15_resolve_duplicates", "l16_content_similarity"])
def test_sets_are_not_stored_as_a_whole(spark, tmp_path, name):
    rng = random.Random(3)
    texts = [" ".join(f"x{rng.randrange(10**9)}q" for _ in range(2000)) for _ in range(100)]
    rows = [(i, t, "s") for i, t in enumerate([*texts, texts[7] + " more"])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    before = left(spark)
    found = plans.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(found) == 1 and (found[0].pairs == 1 if name[0] == "j" else (found[0].a, found[0].b) == (7, 100))
    assert left(spark) - before < 101 * 1996 * 8 / 2  # half of the hashes of all shingles


def test_pairs_of_a_large_group_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", 4)
    rng = random.Random(5)
    sets = [rng.sample(range(60), 40) for _ in range(15)] + [[1000 * i + k for k in range(9 - i % 3)] for i in range(1, 5) for _ in range(2)]
    rows = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "id long, n int, g array<long>")
    pairs = [(a, b) for b in range(15) for a in range(b)] + [(15, 16), (17, 18), (19, 20), (15, 22), (0, 22)]
    pairs = spark.createDataFrame(pairs, "a long, b long")
    assert {tuple(r) for r in duplicates.compared(pairs, rows).collect()} == {tuple(r) for r in duplicates.jaccard(pairs, rows).collect()}


def test_pairs_that_share_too_few_first_shingles_are_left_out(spark):
    sets = [list(range(100)), [*range(3), *range(1000, 1097)], [*range(90), *range(2000, 2010)]]
    own = spark.createDataFrame([(i, 100, s[:41]) for i, s in enumerate(sets)], "id long, n int, p array<long>")
    assert [tuple(r) for r in duplicates.met(own, 0.6).collect()] == [(0, 2)]
