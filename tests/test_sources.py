import csv
import hashlib
import io
import threading
import time
import tracemalloc
import zipfile
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from contrastkit.operators import audit
from contrastkit.plans import catalog
from contrastkit.sources import fetch, files, report, single, tables, xlsx
from contrastkit.streaming import ingest


def book(path, rows, shared=()):
    cell = lambda ref, v: f'<c r="{ref}" t="s"><v>{shared.index(v)}</v></c>' if v in shared else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if not v.isdigit() else f'<c r="{ref}"><v>{v}</v></c>'
    body = "".join("<row>" + "".join(cell(f"{chr(65 + j)}{k}", v) for j, v in enumerate(r) if v) + "</row>" for k, r in enumerate(rows, 1))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


def test_xlsx(spark, tmp_path):
    book(tmp_path / "a.xlsx", [["", ""], ["id", "name", "label 10"], ["X1", "", "1"], ["", "", ""], ["X2", "two", "0"], ["X1", "again", ""]], shared=("id", "name", "two"))
    xlsx.register(spark)
    frame = spark.read.format("xlsx").load(str(tmp_path / "a.xlsx"))
    assert frame.columns == ["id", "name", "label 10", "_row"]
    assert [tuple(r) for r in frame.orderBy("_row").collect()] == [("X1", "", "1", 0), ("X2", "two", "0", 1), ("X1", "again", "", 2)]
    assert [r["id"] for r in tables.distinct_ids(frame, "id", "_row").collect()] == ["X1", "X2"]
    read = xlsx.read_workbooks(spark, str(tmp_path))
    assert read.columns == frame.columns and sorted(map(tuple, read.collect())) == sorted(map(tuple, frame.collect()))
    with pytest.raises(ValueError):
        tables.distinct_ids(frame, "absent", "_row")
    got = {(r["column"], r["value"]): r["n"] for r in tables.label_profile(frame).collect()}
    assert got == {("label 10", "1"): 1, ("label 10", "0"): 1, ("label 10", "<blank>"): 1}
    assert len(list(xlsx.sheet_rows((tmp_path / "a.xlsx").read_bytes(), drop_blank=False))) == 6
    with pytest.raises(ValueError):
        xlsx.column_place("12", strict=True)
    assert xlsx.column_place("AB3", strict=False) == 27 and xlsx.column_place("", strict=False) == 0


def test_fetch_list(spark):
    ids = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, place int")
    manifest = spark.createDataFrame([("a", "ok", "10"), ("b", "http_404", "0")], "adc_id string, status string, bytes string")
    assert [r["id"] for r in tables.to_fetch(ids, manifest).orderBy("place").collect()] == ["b", "c"]
    assert [r["id"] for r in tables.to_fetch(ids, manifest, limit=1).collect()] == []
    assert tables.to_fetch(ids, manifest, force=True).count() == 3


@pytest.fixture
def site():
    """A server of pages by id that remembers what it was asked for and when."""
    asked, late = [], {"slow"}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            name = self.path.rpartition("/")[2]
            asked.append((name, time.monotonic(), self.headers["User-Agent"]))
            if name in late:
                time.sleep(1.5)
            self.send_response(404 if name.startswith("no") else 200)
            self.end_headers()
            self.wfile.write(b"" if name.startswith(("no", "empty")) else b"<p>\xff" + name.encode() * 3)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/page/", asked, late
    server.shutdown()


def test_fetching_resumes(spark, tmp_path, site):
    url, asked, late = site
    folder, manners = str(tmp_path / "pages"), fetch.Manners(delay=0.0, timeout=0.5, agent="me")
    names = ["a", "b", "no1", "slow", "empty"]
    ids = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "id string, place int")
    row = lambda frame: {r["adc_id"]: (r["status"], r["bytes"], r["path"].rpartition("/")[2]) for r in frame.collect()}
    assert row(fetch.fetch_pages(spark, ids, url, folder, limit=2, manners=manners)) == {"a": ("ok", 7, "run=0"), "b": ("ok", 7, "run=0")}
    second = fetch.fetch_pages(spark, ids, url, folder, manners=manners)
    assert row(second) == {"a": ("cached", 7, "run=0"), "b": ("cached", 7, "run=0"), "no1": ("http_404", 0, ""), "slow": ("timeout", 0, ""), "empty": ("ok", 0, "")}
    assert second.where("adc_id = 'no1'").first()["error"] == "HTTP Error 404: Not Found" and {a for _, _, a in asked} == {"me"}
    assert Counter(n for n, *_ in asked) == Counter(names)
    late.clear()
    assert row(fetch.fetch_pages(spark, ids, url, folder, manners=manners))["slow"] == ("ok", 16, "run=2")
    assert Counter(n for n, *_ in asked) == Counter(names + ["no1", "slow", "empty"])
    before = len(asked)
    have = ids.where("id in ('a', 'slow')")
    assert {v[0] for v in row(fetch.fetch_pages(spark, have, url, folder, manners=manners)).values()} == {"cached"} and len(asked) == before
    forced = fetch.fetch_pages(spark, have, url, folder, force=True, manners=manners)
    assert row(forced) == {"a": ("ok", 7, "run=3"), "slow": ("ok", 16, "run=3")} and len(asked) == before + 2
    pages = {r["key"]: (r["page"], r["path"].rpartition("/")[2]) for r in fetch.stored_pages(spark, folder).collect()}
    assert pages == {"a": ("<p>\ufffdaaa", "run=3"), "b": ("<p>\ufffdbbb", "run=0"), "slow": ("<p>\ufffd" + "slow" * 3, "run=3")}
    gone = fetch.fetch_pages(spark, ids.where("id = 'a'"), "http://127.0.0.1:1/", str(tmp_path / "none"), manners=manners)
    assert gone.first()["status"] == "url_error" and fetch.stored_pages(spark, str(tmp_path / "none")).count() == 0
    assert fetch.fetch_pages(spark, ids.limit(0), url, str(tmp_path / "void")).count() == 0


def test_a_host_is_asked_at_its_pace(spark, tmp_path, site):
    url, asked, _ = site
    manners = fetch.Manners(delay=0.1, lanes=2, tasks=4)
    ids = spark.range(16).selectExpr("concat('p', id) as id", "id as place")
    assert fetch.fetch_pages(spark, ids, url, str(tmp_path / "pages"), manners=manners).where("status = 'ok'").count() == 16
    times = sorted(t for _, t, _ in asked)
    assert len(times) == 16 and all(b - a > 0.15 for a, b in zip(times, times[2:]))


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "q", b', ""), ("2", "line\nbreak", "z")], "id string, text string, more string")
    tables.write_csv(rows, str(tmp_path / "out"), ["id", "text", "absent"], parts=1)
    back = tables.read_csv(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.collect()) == [("1", 'a "q", b', ""), ("2", "line\nbreak", "")]
    assert tables.read_inferred_csv(spark, str(tmp_path / "out")).dtypes[0] == ("id", "int")
    tables.write_csv(rows, str(tmp_path / "crlf"), ["id"], parts=1, crlf=True)
    assert next((tmp_path / "crlf").glob("*.csv")).read_bytes() == b"id\r\n1\r\n2\r\n"
    tables.write_csv(rows.limit(0), str(tmp_path / "none"), ["id", "absent"], parts=1)
    assert next((tmp_path / "none").glob("*.csv")).read_bytes() == b"id,absent\n"
    both = tables.stacked(rows.select("id"), rows.select("more"))
    assert both.columns == ["id", "more"] and both.count() == 4


def python_csv(rows, header):
    held = io.StringIO(newline="")
    writer = csv.DictWriter(held, header, extrasaction="ignore", restval="")
    writer.writeheader()
    writer.writerows(rows)
    return held.getvalue().encode()


def test_single_files_are_those_of_one_writer(spark, tmp_path):
    rows = [{"k": k, "text": f'a "q", {k}\nnext' if k % 3 else "", "x": k / 7, "flag": k % 2 == 0} for k in range(500)]
    frame = spark.createDataFrame([(r["k"], r["text"], r["x"], r["flag"]) for r in rows], "k int, text string, x double, flag boolean").repartition(7).orderBy("k")
    path = tmp_path / "new" / "folder" / "all.csv"
    single.write_single_csv(frame, str(path))
    assert path.read_bytes() == python_csv(rows, ["k", "text", "x", "flag"])
    single.write_single_csv(frame, f"file://{path}", ["text", "absent", "k"])  # replaces it
    assert path.read_bytes() == python_csv(rows, ["text", "absent", "k"])
    other = [{"k": 900, "more": "é"}, {"k": 901, "more": None}]
    both = tables.stacked(frame, spark.createDataFrame([(r["k"], r["more"]) for r in other], "k int, more string")).orderBy("k")
    single.write_single_csv(both, str(path))
    assert path.read_bytes() == python_csv(rows + [{k: v for k, v in r.items() if v} for r in other], ["k", "text", "x", "flag", "more"])
    single.write_single_csv(frame.limit(0), str(path))
    assert path.read_bytes() == b"k,text,x,flag\r\n"
    single.write_single_csv(frame.limit(0), str(path), no_rows="blank")
    assert path.read_bytes() == b"\r\n"
    with pytest.raises(Exception, match="zero"):
        single.write_single_csv(frame.withColumn("k", F.when(F.col("k") == 400, F.raise_error(F.lit("zero"))).otherwise(F.col("k"))), str(tmp_path / "failed.csv"))
    assert not (tmp_path / "failed.csv").exists() and [p.name for p in path.parent.iterdir()] == ["all.csv"]


def test_manifest_file(spark, tmp_path, site):
    url, *_ = site
    ids = spark.createDataFrame([("b", 0), ("no", 1), ("a", 2)], "id string, place int")
    manifest = fetch.fetch_pages(spark, ids, url, str(tmp_path / "pages"), manners=fetch.Manners(delay=0.0))
    single.write_manifest(manifest, str(tmp_path / "manifest.csv"))
    held = f"{tmp_path}/pages/run=0"
    wanted = [{"adc_id": "b", "url": f"{url}b", "path": held, "status": "ok", "bytes": 7}, {"adc_id": "no", "url": f"{url}no", "status": "http_404", "bytes": 0, "error": "HTTP Error 404: Not Found"}, {"adc_id": "a", "url": f"{url}a", "path": held, "status": "ok", "bytes": 7}]
    assert (tmp_path / "manifest.csv").read_bytes() == python_csv(wanted, ["adc_id", "url", "path", "status", "bytes", "error"])
    back = tables.read_csv(spark, str(tmp_path / "manifest.csv"))
    assert tables.to_fetch(ids, back).first()["id"] == "no"


def test_large_files_get_digests(spark, tmp_path):
    with open(tmp_path / "large one.bin", "wb") as f:
        f.truncate(3 << 30)
        f.seek(1 << 31)
        f.write(b"x")
    (tmp_path / "small.txt").write_bytes(b"abc")
    digest, zeros = hashlib.sha256(), bytes(1 << 20)
    for k in range(3 << 10):
        digest.update(b"x" + zeros[1:] if k == 2 << 10 else zeros)
    found = {r["relative_path"]: (r["bytes"], r["sha256"]) for r in tables.inventory(spark, str(tmp_path)).collect()}
    assert found == {"large one.bin": (3 << 30, digest.hexdigest()), "small.txt": (3, hashlib.sha256(b"abc").hexdigest())}
    assert files.sha256(f"file:{tmp_path}/small.txt") == files.sha256(f"{tmp_path}/small.txt") == files.sha256(f"file://{tmp_path}/small.txt")


def test_large_sheets_are_read_as_they_go(spark, tmp_path, monkeypatch):
    shared = [f"s{k}" for k in range(50)]
    rows = [["id", "name"], *([str(k), shared[k % 50]] for k in range(60000))]
    fast = {v: k for k, v in enumerate(shared)}
    cell = lambda ref, v: f'<c r="{ref}" t="s"><v>{fast[v]}</v></c>' if v in fast else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    book(tmp_path / "b.xlsx", [], shared)
    body = "".join(f"<row>{cell(f'A{k}', a)}{cell(f'B{k}', b)}</row>" for k, (a, b) in enumerate(rows, 1))
    with zipfile.ZipFile(tmp_path / "b.xlsx") as old, zipfile.ZipFile(tmp_path / "a.xlsx", "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            new.writestr(name, old.read(name) if "sheet1" not in name else old.read(name).replace(b"<sheetData>", b"<sheetData>" + body.encode()))
    (tmp_path / "b.xlsx").unlink()
    tracemalloc.start()
    with open(tmp_path / "a.xlsx", "rb") as f:
        assert sum(1 for _ in xlsx.sheet_rows(f)) == 60001
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
    xlsx.register(spark)
    for frame in (spark.read.format("xlsx").load(str(tmp_path)), xlsx.read_workbooks(spark, str(tmp_path))):
        got = frame.agg(F.count("*"), F.sum(F.col("id").cast("long")), F.max("_row"), F.count_distinct("name")).first()
        assert tuple(got) == (60000, 60000 * 59999 // 2, 59999, 50)


def test_pages_to_activity(spark, tmp_path):
    cell = '<tr><td class="pad-20">IC50 <a href="#ACT{k}">x</a></td><td class="h-center"><div>{v}</div></td><td class="h-center"><div>nM</div></td><td class="pad-20"><div>Cell {k}</div></td><td class="pad-20"><div>Disease</div></td></tr>'
    page = '<th>Name</th><td>Drug &amp; Co</td><th>Payload Name</th><td>MMAE <a href="/p/PAY7">link</a></td> ACTIVITY CELLS ' + cell.format(k=1, v="&lt;5") + cell.format(k=2, v="12.5") + " CLINICAL " + cell.format(k=3, v="1")
    (tmp_path / "D1.html").write_text(page)
    (tmp_path / "D2.html").write_bytes(b"no section \xff")
    (tmp_path / "other.txt").write_text("x")
    pages = tables.read_pages(spark, str(tmp_path), "D*.html")
    assert sorted(r["key"] for r in pages.collect()) == ["D1", "D2"]
    rows = tables.activity_rows(pages, {"adc_name": "Name", "payload_name": "Payload Name"}, {"payload_id": ("Payload Name", "/p")}, ("ACTIVITY", "CELLS", "CLINICAL", '<div class="u">'), "https://example.org/")
    got = rows.orderBy("row_no").collect()
    assert rows.columns == [*tables.ACTIVITY, "row_no"] and len(got) == 2
    assert (got[0]["adc_name"], got[0]["payload_identity"], got[0]["payload_mechanism"]) == ("Drug & Co", "PAY7", "microtubule-disrupting")
    assert [(r["relation"], r["value_numeric"], r["activity_id"], r["cell_line"], r["is_molar_unit"]) for r in got] == [("<", 5.0, "ACT1", "Cell 1", "1"), ("=", 12.5, "ACT2", "Cell 2", "1")]
    files = tables.inventory(spark, str(tmp_path), [(r"^D\d", "page")])
    found = {r["relative_path"]: (r["suffix"], r["note"], len(r["sha256"])) for r in files.collect()}
    assert found["D1.html"] == (".html", "page", 64) and found["other.txt"] == (".txt", "", 64)
    assert tables.inventory_summary(files.withColumn("top_level", F.lit("all"))).first()["suffixes"] == ".html:2, .txt:1"


def test_report(spark):
    rows = spark.createDataFrame([("a|b", 0.25), ("c", None), ("d", -0.00001)], "name string, value double")
    assert report.markdown(rows, limit=2).splitlines() == ["| name | value |", "| --- | --- |", "| a\\|b | 0.2500 |", "| c |  |", "| ... | ... |"]
    assert report.decimals(-0.00001) == "0.0000" and report.decimals(float("nan")) == "" and report.percent(0.123) == "12.3%"
    assert (report.significant(1 / 3, 6), report.significant(1234.5), report.significant(0.0), report.significant(None)) == ("0.333333", "1234.5", "0", "")
    generic = audit.generic_audit(spark.createDataFrame([("a", "x", "k"), ("b", "y", "k")], "cls string, ident string, key string"), "cls", "ident", ["key"])
    text = report.analysis_report("Audit", generic, report.GENERIC)
    assert [line for line in text.splitlines() if line.startswith("#")] == ["# Audit", "## Classes", "## Identities by class", "## Identities in one class", "## shared_key"]
    assert report.bars(rows, "name", "value", "A & B").count("<rect") == 3 and "A &amp; B" in report.bars(rows, "name", "value", "A & B")
    assert report.dots(rows, "name", "value", "t").count("<circle") == 2
    assert report.sections("T", [("One", "text"), ("Two", rows)]).startswith("# T\n\n## One")


def test_stream_equals_batch(spark, tmp_path):
    cases = [("=", "5", "nM", "IC50", "1"), ("<", "20", "nM", "IC50", "1"), ("=", "x", "nM", "IC50", "1"), ("=", "5", "nM", "Cmax", "0"), (">", "20", "nM", "EC 50", "0")]
    rows = spark.createDataFrame(cases, "relation string, value_numeric string, units string, standard_type string, is_potency_endpoint string")
    tables.write_csv(rows, str(tmp_path / "in"), tables.ACTIVITY, parts=2)
    stream = ingest.routed_stream(ingest.activity_stream(spark, str(tmp_path / "in")))
    ingest.write_routed(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = ingest.routed_stream(tables.read_csv(spark, str(tmp_path / "in"), tables.ACTIVITY))
    key = lambda r: repr((r["relation"], r["value_numeric"], r["label"], r["reason"]))
    assert sorted(map(key, got.collect())) == sorted(map(key, batch.collect()))
    assert got.where("kind = 'usable'").count() == 2


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_single_file_is_read_in_ranges(spark, tmp_path, monkeypatch, end):
    """Whatever byte a range begins at: in a cell in quotes, between \r and \n, at the first byte of a row."""
    cells = ["", "a", 'say "x"', '"', '""', "two\nlines", "\n", "\r\n", ",", "é\n\"\n", "end"]
    rows = [(cells[k % 11], cells[k * 7 % 11], str(k)) for k in range(40)]
    path = str(tmp_path / "one.csv")
    single.write_single_csv(spark.createDataFrame(rows, "x string, y string, z string").repartition(3), path, line_sep=end)
    for size in (1, 2, 7, 64, 1 << 20):
        if size < 7:  # a task for each range
            found, data = [], open(path, "rb").read()
            for k in range(-(-len(data) // size)):
                found += [next(csv.reader([r.decode()])) for r in single._records(path, k * size, min(len(data), (k + 1) * size), data[: k * size].count(b'"') % 2 == 1)]
            found = [tuple(r) for r in found]
        else:
            monkeypatch.setattr(single, "RANGE", size)
            frame = single.read_single_csv(spark, path, ["x", "y", "z"])
            assert frame.rdd.getNumPartitions() == -(-len(open(path, "rb").read()) // size)
            found = [tuple(r) for r in frame.collect()]
        assert sorted(found) == sorted(rows), size


def test_page_files_share_folders(spark, tmp_path, monkeypatch):
    """Fewer folders than pages, and pages without an id or text as in the SQL."""
    rows = [(k, f"<p>{k}</p>\r\n" if k % 3 else "é" * (k % 5)) for k in range(2000)] + [(2000, None), (None, "lost")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/in/pages.parquet")
    (tmp_path / "scratch").mkdir()
    monkeypatch.setattr(catalog, "scratch_dir", lambda spark: f"file://{tmp_path}/scratch")
    got = catalog.QUERIES["src3_page_files"](spark, f"{tmp_path}/in").collect()
    digest = lambda html: None if html is None else hashlib.md5(f"{html}\n".encode()).hexdigest()
    assert len(got) == 2002
    assert {(r["key"], r["page"]) for r in got} == {(None if k is None else str(k), digest(html)) for k, html in rows}
    found = list((tmp_path / "scratch").rglob("*"))
    assert sum(x.is_file() for x in found) == 2000 and sum(x.is_dir() for x in found) <= tables.FOLDERS + 1


def test_page_files_of_any_names(spark, tmp_path):
    pages = [("a.b", "1"), ("x/y", "2"), ("50%", ""), ("Ä ö", "3"), ("..", "4")]
    assert tables.write_pages(spark.createDataFrame(pages, "key string, page string").repartition(3), str(tmp_path)) == 5
    for _ in range(2):  # written again, it is the same
        tables.write_pages(spark.createDataFrame(pages, "key string, page string"), str(tmp_path))
    wanted = sorted((key.replace("%", "%25").replace("/", "%2F").replace("Ä", "%C3%84").replace("ö", "%C3%B6"), page) for key, page in pages)
    assert sorted((r["key"], r["page"]) for r in tables.read_pages(spark, str(tmp_path), folders=tables.page_folders(spark)).collect()) == wanted
