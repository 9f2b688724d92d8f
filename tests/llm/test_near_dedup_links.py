"""The near-dedup's candidates by SimHash alone."""

import random

from sparkloom.llm import simhash
from sparkloom.llm.common import words, written


def test_near_copies_by_simhash_alone(spark, monkeypatch):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        text = [f"w{rng.randrange(10000)}" for _ in range(600)]
        texts += [" ".join(text), " ".join([*text[:-1], "last"])]
    docs = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    monkeypatch.setattr(simhash, "chained", lambda keyed: keyed.selectExpr("b as a", "b").where("false"))
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    fps = [simhash.fingerprint(simhash.hashes(words(t), 5)) for t in texts]
    near = {i + 1 for i in range(0, len(texts), 2) if ((fps[i] ^ fps[i + 1]) & (2**64 - 1)).bit_count() <= 3}
    assert len(near) > 5 and kept == set(range(len(texts))) - near
