import pytest

from tallyforge.operators import entity as E
from tallyforge.sources import portals
from tallyforge.streaming import incremental


@pytest.mark.parametrize("raw,want", [
    ("DEPARTMENT OF PUBLIC WORKS", "Department of Public Works"), ("ACME SERVICES LLC", "Acme Services LLC"), ("BOLT INC", "Bolt Inc"), ("Already Cased Inc.", "Already Cased Inc."), ("KRMW", "KRMW"), ("brsk ohio", "BRSK Ohio"),
    ("lynch bros", "Lynch Bros"), ("st mark health", "St Mark Health"), ("waste of ky llc", "Waste of KY LLC"), ("invest in homes", "Invest in Homes"), ("tn dept of revenue", "TN Dept of Revenue"), ("JOE'S TIRES", "Joe's Tires"), ("", ""), (None, None),
])
def test_labels(raw, want):
    assert E.label_of(raw) == want


def weights(spark, pairs):
    return spark.createDataFrame(pairs, "raw string, weight double")


def test_clusters_and_drafts(spark):
    w = weights(spark, [("ACME INC", 3.0), ("acme inc", 3.0), ("Acme, Inc.", 1.0), ("Solo Vendor LLC", 5.0), (None, 1.0), ("###", 1.0)])
    c = {r["key"]: r for r in E.clusters(w).collect()}
    assert set(c) == {"ACME", "SOLO VENDOR"} and c["ACME"]["winner"] == "acme inc" and c["ACME"]["weight"] == 7.0 and c["ACME"]["canonical"] == "Acme Inc"
    assert {r["source"] for r in E.draft_map(w).collect()} == {"ACME INC", "acme inc", "Acme, Inc."}
    assert {r["source"] for r in E.draft_map(w, case_insensitive=True).collect()} == {"ACME INC", "Acme, Inc."}
    old = spark.createDataFrame([("ACME INC", "Hand Made")], "source string, canonical string")
    assert {r["source"]: r["canonical"] for r in E.merge_drafts(old, E.draft_map(w)).collect()} == {"ACME INC": "Hand Made", "acme inc": "Acme Inc", "Acme, Inc.": "Acme Inc"}


def test_suggestions(spark):
    w = weights(spark, [("RIVER GAS AND ELECTRIC", 100.0), ("RIVER GAS AND ELE", 20.0), ("WQTS", 50.0), ("Water Quality Testing Section", 80.0), ("FUEL #4", 10.0), ("FUEL #17", 5.0), ("HALL #2 WEST", 3.0)])
    c = E.clusters(w)
    (pair,) = E.near_duplicates(c).collect()
    assert pair["ratio"] >= 0.86 and pair["key_a"] == "RIVER GAS AND ELECTRIC"
    assert [(r["short_key"], r["long_key"]) for r in E.initialisms(c).collect()] == [("WQTS", "WATER QUALITY TESTING SECTION")]
    assert [(r["prefix"], r["canonical"], r["members"]) for r in E.prefix_candidates(w).collect()] == [("FUEL #", "Fuel #4", 2)]
    assert E.residual(c, c.where("key = 'WQTS'")).first()["key"] == "RIVER GAS AND ELECTRIC"
    text = E.report([r.asDict() for r in c.collect()], [], [pair.asDict()], [], [], [], "dollars", compared=2)
    assert "Compared the 2 heaviest of" in text and "RIVER GAS AND ELE" in text


def test_weights(spark):
    df = spark.createDataFrame([("A", "100", False), ("A", "50", False), ("A", "9", True), ("B", "x", False)], "p string, amt string, is_data_artifact boolean")
    assert {r["raw"]: r["weight"] for r in E.weights(df, "p", "amt", "is_data_artifact").collect()} == {"A": 150.0, "B": 0.0}
    assert {r["raw"]: r["weight"] for r in E.weights(df, "p", None).collect()} == {"A": 3.0, "B": 1.0}


def test_bulk_files_and_env_keys(tmp_path):
    import io

    tries = []

    def opened(url):
        tries.append(url)
        if len(tries) == 1:
            raise OSError("down")
        return io.BytesIO(b"a,b\n")

    assert portals.bulk_file(opened, "u", str(tmp_path / "f.csv"), sleep=lambda s: None) == 4 and len(tries) == 2
    p = tmp_path / ".env"
    p.write_text("A=1\nexport K=old\n")
    portals.set_env_key(str(p), "K", "new")
    portals.set_env_key(str(p), "B", "2")
    assert p.read_text() == "A=1\nK=new\nB=2\n"


def test_streams_take_each_file_once_and_equal_the_batch(spark, tmp_path, small):
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("i,s\n1,x\n")
    incremental.ingest(spark, src, out, chk, "i int, s string")
    (tmp_path / "in" / "b.csv").write_text("i,s\n2,y\n")
    incremental.ingest(spark, src, out, chk, "i int, s string")
    assert sorted(r["i"] for r in spark.read.parquet(out).collect()) == [1, 2]
    ev = spark.read.parquet(f"{small}/events.parquet")
    ev.write.parquet(str(tmp_path / "ev"))
    q = incremental.windowed(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))).writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("win")) == key(incremental.windowed(ev))


def test_prompt(spark):
    from tallyforge import catalog, cli

    cat = catalog.Catalog()
    cat.add("cli_t", spark.createDataFrame([("a", 1)], "s string, i int"))
    said = []
    cli.repl(spark, cat, ["schema", "sql SELECT * FROM cli_t", "DROP TABLE cli_t", "", "quit", "never"], said.append)
    assert "cli_t(1 rows)" in said[0] and "a" in said[1] and said[2].startswith("error: not a query") and len(said) == 3
