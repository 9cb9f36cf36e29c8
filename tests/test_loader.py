import pytest

from tallyforge import catalog
from tallyforge.pack import Pack, Source, load_pack
from tallyforge.sources import files, portals


def write(path, text):
    path.write_text(text)
    return str(path)


def test_years_and_missing_files(tmp_path):
    for y in (2020, 2022):
        write(tmp_path / f"exp_{y}.csv", "a\n1\n")
    got = files.source_files(Source("exp_{year}.csv", years=(2019, 2022)), str(tmp_path))
    assert [y for y, _ in got] == [2020, 2022]
    with pytest.raises(ValueError):
        files.source_files(Source("exp.csv", years=(2019, 2020)), str(tmp_path))
    assert len(files.source_files(Source("exp_*.csv"), str(tmp_path))) == 2


def test_union_by_name_not_by_position(spark, tmp_path):
    p = [write(tmp_path / "a.csv", "x,y\n1,u\n"), write(tmp_path / "b.csv", "y,z\nv,2\n")]
    got = sorted((r["x"], r["y"], r["z"]) for r in files.scan_csv(spark, p).fillna(-1).collect())
    assert got == [(-1, "v", 2), (1, "u", -1)]


def test_codes_keep_their_zeros_and_quotes_their_names(spark, tmp_path):
    df = files.scan_csv(spark, [write(tmp_path / "a.csv", 'no,"weird""name"\n00012,5\n7,6\n')])
    assert [r[0] for r in df.select("no").collect()] == ["00012", "7"]
    assert files.rename(df, {'weird"name': "plain", "no": "no", "absent": "q"}).columns == ["no", "plain"]


def test_first_source_sets_the_columns(spark, tmp_path):
    write(tmp_path / "new.csv", "payee,amount\nAcme,12.5\n")
    write(tmp_path / "old.csv", "Vendor,Amt,Gone\nBolt,3.25,9\n")
    s = [Source("new.csv"), Source("old.csv", reader="mapped", rename={"Vendor": "payee", "Amt": "amount"})]
    df = files.load_sources(spark, s, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("Acme", 12.5), ("Bolt", 3.25)]
    with pytest.raises(ValueError):
        files.load_sources(spark, [s[0], Source("old.csv")], str(tmp_path))
    with pytest.raises(ValueError):
        files.load_sources(spark, [Source("new.csv", reader="other")], str(tmp_path))
    assert files.load_sources(spark, [Source("none.csv")], str(tmp_path)) is None


def test_catalog_of_a_pack(spark, tmp_path):
    write(tmp_path / "l.csv", "fiscal_year,payee,extended_amount\n2025,ACME #1,10\n2025,ACME #2,-10\n2026,Bolt,5\n")
    write(tmp_path / "pm.csv", "prefix,canonical\nACME #,Acme\n")
    write(tmp_path / "city.yaml", """name: t
sources: [{path: l.csv}]
canonical: [{source: payee, target: payee_canonical, prefix: pm.csv}]
flags: {offsetting: {keys: [payee_canonical]}}
enrichment: {licences: none.csv}
summaries:
  by_year: {sql: "SELECT fiscal_year, sum(extended_amount) AS s FROM expenditures GROUP BY 1", requires: [expenditures]}
  empty: {sql: "SELECT * FROM expenditures WHERE fiscal_year = 1"}
  needs: {sql: "SELECT 1", requires: [licences]}
  broken: {sql: "SELECT nothing FROM expenditures"}
facts: ["through {day}", "since {first}"]
""")
    pack = load_pack(str(tmp_path / "city.yaml"))
    cat = catalog.build(spark, pack, str(tmp_path))
    assert [r[0] for r in spark.sql("SELECT payee_canonical FROM expenditures WHERE is_offsetting").collect()] == ["Acme", "Acme"]
    assert cat.tables["by_year"].count() == 2
    assert sorted(m.split(":")[0] for m in cat.messages) == ["broken", "empty", "licences", "needs"]
    assert pack.facts_for({"first": 2020}) == ["since 2020"]
    assert catalog.split_statements("SELECT ';' ; -- a;b\nSELECT 2;") == ["SELECT ';'", "-- a;b\nSELECT 2"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    p = files.write_single_file(df, str(tmp_path / "o.csv"))
    assert open(p).read() == "i,s\n1,a\n"
    files.write_map(str(tmp_path / "m.csv"), [('A, "b"', "A")])
    assert Pack("x", base_dir=str(tmp_path)).load_map("m.csv") == [('A, "b"', "A")]
    assert files.keep_existing(df, ["s", "none"]).columns == ["s"]


def server(n, cap, deaf=False):
    def fetch(url, params):
        if params.get("returnCountOnly"):
            return {"count": n}
        o = 0 if deaf else params["resultOffset"]
        rows = list(range(o, min(n, o + cap)))
        return {"features": [{"attributes": {"id": i}} for i in rows], "exceededTransferLimit": o + len(rows) < n}

    return fetch


def test_paging_takes_every_row_once_and_breaks_off_when_it_loops():
    assert [r["id"] for r in portals.layer_records("u", server(2500, 1000))] == list(range(2500))
    with pytest.raises(RuntimeError):
        list(portals.layer_records("u", server(2500, 1000, deaf=True)))


def test_portal_shapes():
    meta = {"fields": [{"name": "T", "domain": {"codedValues": [{"code": 1, "name": "One"}, {"code": 2, "name": "Two"}]}}]}
    assert portals.layer_dictionary(meta)[0]["values"] == "1=One; 2=Two"
    pages = [[{"MatterId": 1, "MatterTitle": " a \n b ", "MatterIntroDate": "2020-01-02T00:00:00"}, {"MatterId": 2, "MatterTitle": "  "}], []]
    assert [m["text"] for m in portals.matters(lambda u, p: pages.pop(0), "u", top=2)] == ["a b"]
    assert portals.best_entity([{"name": "x", "id": 1}, {"name": "Acme", "status": "Active", "id": 2}], "ACME")["id"] == 2
    assert portals.format_officers([{"title": "CEO", "name": "A"}, {"title": "CEO", "name": "A"}, {"name": "B"}]) == "CEO: A; B"
    assert portals.is_agent_service("Ct Corporation System") and not portals.is_agent_service(None)


@pytest.mark.parametrize("cap", [1000, 700, 2000, 5000])
def test_layer_source_reads_all_rows_whatever_the_page_cap(monkeypatch, cap):
    from tallyforge.sources import portals as P

    def server(url, params):
        if params.get("returnCountOnly"):
            return {"count": 2500}
        first = params["resultOffset"]
        last = min(2500, first + min(cap, params["resultRecordCount"]))
        return {"features": [{"attributes": {"id": k}} for k in range(first, last)]}

    monkeypatch.setattr(P, "http_fetch", server)
    schema = type("S", (), {"names": ["id"]})()
    reader = P._LayerReader({"url": "http://x/0/query", "batch": "2000"}, schema)
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == list(range(2500))
