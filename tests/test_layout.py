"""Every batch query gives the same answer on the written layout as on the derived tables."""

from check_oracles import norm
from tollgate.sources.fixtures import Tables
from tollgate.sources.layout import LaidOutTables, time_range_files, write_layout
from tollgate.streaming import runner

STREAMS = ("s3_", "s3r_", "s5_", "t1_", "t1s_", "t2_", "t2v_", "t2s_", "t3_", "t3t_", "t4_rate", "t5_", "t5t_", "t6_")


def _rows(df):
    return sorted((tuple(norm(v) for v in r) for r in df.collect()), key=repr)


def test_layout_same_results_and_disjoint_files(spark, sf_small):
    from tollgate.plans import catalog, registry  # noqa: F401  (catalog registers every key)
    path = runner.run_folder(spark, "layout-test")
    write_layout(Tables(spark, sf_small), path, files=4)
    laid = LaidOutTables(spark, sf_small, path)
    plain = Tables(spark, sf_small)
    keys = [k for k in registry.REGISTRY if not k.startswith(STREAMS)]
    assert len(keys) > 90
    for key in keys:
        fn = registry.REGISTRY[key]
        body = fn.fn.__wrapped__ if hasattr(fn.fn, "__wrapped__") else None
        assert body is not None, key
        assert _rows(body(laid)) == _rows(body(plain)), key
    ranges = sorted((r.lo, r.hi) for r in time_range_files(laid.sessions, "started_at").collect())
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
