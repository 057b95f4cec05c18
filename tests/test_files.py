"""Finding run files by listing, and log types of any name in seed ids."""

from pyspark.sql import functions as F

from traceloom.functions import names as N
from traceloom.sources import readers as R


def test_listing(spark, tmp_path):
    for f in ("emb/audit/seeds_S1_2018-11-03_18_k1000.pkl", "emb/other log/seeds_2018-11-03_18_k5.pkl", "emb/audit/seeds_S1_k5.pkl", "emb/audit/notes.txt",
              "emb/dns/continual_clusters_M1_h1_2018-11-03_18_denstream.json", "g/a+b/subgraph_12.json", "g/a+b/subgraph_x.json"):
        p = tmp_path / f
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    got = R.seed_files(R.list_files(spark, str(tmp_path), "seeds_*.pkl")).collect()
    assert sorted((r.scenario, r.log_type, r.timestamp) for r in got) == [("", "other log", "2018-11-03_18"), ("S1", "audit", "2018-11-03_18")]
    got = R.cluster_files(R.list_files(spark, str(tmp_path), "continual_clusters_*.json")).collect()
    assert [(r.scenario, r.log_type, r.timestamp) for r in got] == [("M1_h1", "dns", "2018-11-03_18")]
    got = R.attack_graph_files(R.list_files(spark, str(tmp_path), "*.json")).collect()
    assert [(r.attack, r.number) for r in got] == [("a+b", 12)]


def test_seed_ids(spark):
    rows = spark.createDataFrame([("M1_h1_audit_2018-11-03_18_7",), ("S1_audit_dns_2018-11-03_18_7",), ("S1_smtp_2018-11-03_18_9",), ("nothing",)], "s string")

    def got(kinds):
        return [tuple(r) for r in rows.select(*N.parse_seed_id(F.col("s"), kinds).values()).collect()]
    assert got(("audit", "dns", "firefox")) == [("M1_h1", "audit", "2018-11-03_18", 7), ("S1", "audit", "dns_2018-11-03_18", 7), ("", "", "", None), ("", "", "", None)]
    assert got(None) == [("M1_h1", "audit", "2018-11-03_18", 7), ("S1_audit", "dns", "2018-11-03_18", 7), ("S1", "smtp", "2018-11-03_18", 9), ("", "", "", None)]
