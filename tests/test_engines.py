"""The engines read every sample, and the report compares them."""

import numpy as np

from gridloom import engines
from gridloom.sources import ztensor


def test_engines_and_probes(spark, tmp_path, capsys):
    url = str(tmp_path / "z")
    ztensor.write_array(url, "x", np.arange(24 * 6, dtype="f4").reshape(24, 2, 3), (8, 2, 3), codec="zstd")
    assert engines.main([url, "--variable", "x", "--out", str(tmp_path / "rows"), "--epochs", "2", "--batch-size", "5"]) == 0
    shown = capsys.readouterr().out
    assert all(e in shown for e in engines.ENGINES) and "pct_of_ceiling" in shown
    rows = {r.engine: r for r in engines.report(spark, str(tmp_path / "rows")).collect()}
    assert set(rows) == set(engines.ENGINES) and abs(rows["memory"].pct_of_ceiling - 100) < 1e-6 and all(r.spc == 8 and r.median > 0 for r in rows.values())
    probe = engines.probe_decode(url, "x")
    assert probe["raw_mb_per_s"] > 0 and probe["decoded_mb_per_s"] > 0 and 0 < probe["stored_share"] < 2
    assert engines.peak_rss_mb() > 10
