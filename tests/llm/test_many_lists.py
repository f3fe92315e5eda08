import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from groundwork.llm import ann


def test_recall_where_lists_are_skipped(spark, tmp_path):
    """64,000 vectors without clusters make 506 lists, of which a query visits a part."""
    n, d, every = 64_000, 32, 2_000
    x = np.random.default_rng(12).normal(size=(n, d)).astype(np.float32)
    table = pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), d).cast(pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "v.parquet")
    got = {}
    for r in ann.search(spark.read.parquet(str(tmp_path / "v.parquet")), every=every).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for i in range(0, n, every):
        score = x.astype(float) @ x[i].astype(float)
        score[i] = -np.inf
        hits += len(got[i] & set(np.argpartition(-score, 20)[:20].tolist()))
    assert hits / (20 * n / every) >= 0.9
