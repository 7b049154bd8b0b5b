import numpy as np
import pytest

from lodestar import run
from lodestar.operators import search


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def test_options():
    cfg = run.parse(["--nlist", "8", "--bvec", "2", "--b-dim", "2", "--commcost", "0.5", "--mode", "auto"])
    assert (cfg.nlist, cfg.b_vec, cfg.b_dim, cfg.comm_cost, cfg.mode, cfg.k, cfg.nprobe, cfg.prewarm) == (8, 2, 2, 0.5, "auto", 100, 32, 500)
    with pytest.raises(SystemExit):
        run.parse(["--mode", "square"])
    with pytest.raises(SystemExit):
        run.parse(["--unknown", "1"])


@pytest.mark.parametrize("mode", ["hybrid", "auto"])
def test_report(spark, mode):
    rng = np.random.default_rng(0)
    base, q = table(spark, rng.standard_normal((300, 8))), search.query_set(table(spark, rng.standard_normal((12, 8))))
    cfg = run.Config(nlist=6, iters=2, mode=mode, nprobe=6, k=5, nq=10, prewarm=20, warmup=5)
    found, report = run.run(cfg, base, q)
    m = {r["metric"]: r["value"] for r in report.collect()}
    assert found.count() == 50 and m["recall"] == 1 and m["differing"] == 0 and m["queries"] == 10 and m["vectors"] == 300
    assert m["b_vec"] * m["b_dim"] == 4 and m["scanned"] + m["prewarmed"] == 3000 and 0 < m["work_pct"] <= 100


def test_main(spark, tmp_path, capsys):
    from lodestar.sources import flatvec

    rng = np.random.default_rng(1)
    for name, n in (("base", 60), ("query", 5)):
        flatvec.write_vectors(table(spark, rng.standard_normal((n, 4))), str(tmp_path / f"{name}.bin"))
    run.main(["--base", str(tmp_path / "base.bin"), "--query", str(tmp_path / "query.bin"), "--gt", "", "--nlist", "3", "--iters", "1", "--nprobe", "3", "--k", "4"])
    out = capsys.readouterr().out
    assert "recall: 1\n" in out and "queries: 5\n" in out
