"""Shares told from every position, not from some."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from helixlake.plans.catalogue import REGISTRY, SQL


@pytest.fixture(scope="module")
def docs(tmp_path_factory):
    """A query of which a subject has only a stretch that holds no eighth position: 32 letters from the second on."""
    d = tmp_path_factory.mktemp("whole")
    own = "".join("acgt"[(i * i // 7 + i // 3 + (i >> 4)) % 4] for i in range(90))
    pq.write_table(pa.table({"doc_id": [0, 1], "text": [own, "t" * 40 + own[1:33]], "source": ["src0", "src1"]}), d / "documents.parquet")
    return str(d)


def test_decay_and_divergence_look_at_every_position(spark, docs):
    # the two 31-mers at 1 and 2 are shared
    shares = {(r["subject"], r["class"]): r["share"] for r in REGISTRY["q_decay"](spark, docs).collect()}
    assert shares["hg002", "unique"] > 0 and shares["chimp", "unique"] == 0
    assert {r["subject"]: r["share"] for r in REGISTRY["q_divergence"](spark, docs).collect()}["hg002"] == shares["hg002", "unique"]
    assert "pos % 8" not in SQL["q_decay"] + SQL["q_divergence"]
