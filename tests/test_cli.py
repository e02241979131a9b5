"""The command line over small tables."""

import json

from spawnlens.__main__ import main
from spawnlens.sources import views


def test_detect_traces_metrics_evaluate(spark, sf_dir, tmp_path):
    path = lambda x: str(tmp_path / x)
    views.contracts(spark, sf_dir).write.parquet(path("contracts"))
    views.traces(spark, sf_dir).write.parquet(path("traces"))
    views.ground_truth(spark, sf_dir).drop("is_factory_detected").write.parquet(path("truth"))
    first = main(["detect", path("contracts"), path("results")], spark)
    assert {r["chain"] for r in first} == {"ethereum", "polygon"} and all(r["total_factories"] > 0 for r in first)
    assert main(["detect", path("contracts"), path("results"), "--resume", path("results")], spark) == first  # nothing is added twice
    made = main(["traces", path("traces"), path("made")], spark)
    assert made == main(["traces", path("traces"), path("made")], spark)
    main(["metrics", path("made"), path("metrics")], spark)
    assert spark.read.option("header", True).csv(path("metrics/daily_active_factories")).count() > 0
    r = main(["evaluate", path("truth"), path("evaluated")], spark)[0]
    assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == r["n"] > 0


def test_plan_and_cluster(spark, tmp_path):
    root = tmp_path / "sources" / "ethereum"
    root.mkdir(parents=True)
    for i in range(30):
        text = f"contract C{i} {{ {'function f() public {}' * (i % 5)} }}" + ("create2(0, 0, 0, salt);" if i % 2 else "")
        (root / f"0x{i:02d}.json").write_text(json.dumps({"files": [{"path": "a.sol", "content": text}]}))
    (tmp_path / "list.csv").write_text("chain,factory_address,unique_creations\nethereum,0x01,3\nethereum,0x99,3\nethereum,0x98,0\n")
    assert main(["plan", str(tmp_path / "list.csv"), str(tmp_path / "plan"), "--sources", str(tmp_path / "sources")], spark) == [{"chain": "ethereum", "count": 1}]
    got = main(["cluster", str(tmp_path / "sources"), str(tmp_path / "clusters"), "-k", "3"], spark)
    assert sum(r["size"] for r in got) == 30 and len(got) <= 3


def test_scan_and_dry_runs(spark, sf_dir, tmp_path, capsys):
    path = lambda x: str(tmp_path / x)
    contracts = views.contracts(spark, sf_dir)
    contracts.where("chain = 'ethereum'").write.parquet(path("in/ethereum/contracts.parquet"))
    views.transactions(spark, sf_dir).write.parquet(path("in/arbitrum/transactions.parquet"))
    views.receipts(spark, sf_dir).write.parquet(path("in/arbitrum/receipts.parquet"))
    args = ["scan", path("in"), path("out"), "--chains", "ethereum,arbitrum", "--start", "1990-01-01"]
    assert main([*args, "--dry-run"], spark) == [] and "Scan parquet" in capsys.readouterr().out and not (tmp_path / "out").exists()
    assert {r["chain"] for r in main(args, spark)} == {"ethereum", "arbitrum"}
    assert main(["detect", path("out"), path("results"), "--dry-run"], spark) == [] and not (tmp_path / "results").exists()
    first = main(["detect", path("out"), path("results"), "--longest", "600"], spark)
    assert main(["detect", path("out"), path("results"), "--longest", "600"], spark) == first  # an append that is run again adds nothing
