import datetime as dt
import gzip
import io
import json
import random
import re
import zipfile

import pyarrow as pa
import pytest
from barspark.functions import html
from barspark.plans import control
from barspark.sources import days, files
from pyspark.sql import functions as F

D = dt.date.fromisoformat

PAGES = [  # page, title, text
    ('<p title="a>b">One</p><!-- <p>no</p> --><p>Two<b>bold</b> three</p>', None, "One\nTwo\nbold\nthree"),
    ("<head><title> T &amp; U </title></head><body>&#8211; &eacute;&#x27;&nbsp;x &unknown; 1 &lt; 2</body>", "T & U", "– é'\xa0x &unknown; 1 < 2"),
    ("<body>a<script>if (a < b) { '<p>x</p>' }</script>b<style>p {}</style>c<script src=x></script>d", None, "a\nb\nc\nd"),
    ("<html><head><meta charset=utf-8><title>T</title><style>x</style><p>Body of an unclosed head", "T", "Body of an unclosed head"),
    ("<script>never closed <p>x</p>", None, ""), ("", None, ""), ("plain", None, "plain"), ("<h2> Head <i>ing</i> </h2><h1>Other</h1>", "Heading", "Head\ning\nOther"),
    ("<p>a</p>\n \n<p> </p><p>b\n\n\n\nc</p>", None, "a\nb\n\nc"), ("<title></title><h3>H</h3>", "H", "H"), ("<div>x<br/>y<br>z</div", None, "x\ny\nz"),
    ("a < b and c<d> e", None, "a < b and c\ne"), ("<table><tr><td>1<td>2</table>", None, "1\n2"), ("<?xml version='1.0'?><!DOCTYPE html><p>x</p>", None, "x"),
]


@pytest.mark.parametrize("case", PAGES, ids=range(len(PAGES)))
def test_pages(case):
    page, title, text = case
    assert html.page(page) == (title, text)


@pytest.mark.parametrize("text", ["a&amp", "a&amp&lt", "&ampx; &notit;", "&#39 &#x27 &quo &", "&amp;amp;lt;"])
def test_references_need_their_semicolon(text):
    want = text.replace("&amp;", "&")
    assert html.page(f"<title>{text}</title><h1>{text}</h1><p title='&amp'>{text}</p>") == (want, f"{want}\n{want}")
    assert html.page(text) == (None, want)


def test_pages_as_columns(spark):
    frame = spark.createDataFrame([(i, p) for i, (p, _, _) in enumerate(PAGES)] + [(99, None)], "i int, p string")
    got = {r.i: (r.t, r.x) for r in frame.select("i", html.title_of(F.col("p")).alias("t"), html.text_of(F.col("p")).alias("x")).collect()}
    assert got == {i: (t, x) for i, (_, t, x) in enumerate(PAGES)} | {99: (None, None)}


def test_the_short_way_through_plain_tags(monkeypatch):
    class Seen(html.Tags):
        def __init__(self, text):
            super().__init__()
            self.seen = []
            self.feed(text)
            self.close()

        handle_starttag = lambda self, tag, attrs: self.seen.append((tag, attrs))
        handle_startendtag = lambda self, tag, attrs: self.seen.append((tag, attrs, "/"))
        handle_endtag = handle_data = handle_comment = handle_decl = handle_pi = unknown_decl = lambda self, text: self.seen.append(text)

    bits = ("<p>", "</P>", "<tr class='obb'>", "<a href=\"/x?f=1\" ID=''>", "<a b='&lt;' c=d>", "<br/>", "<td", "<", ">", "x ", "&amp;", "&#39", "<script>", "</script>", "<title>",
            "</title>", "<!-- c -->", "<!--", "<!doctype html>", "<?x?>", "</p class='x'>", "'", '"', "<a b='c'd='e'>")
    pick = random.Random(3)
    texts = ["".join(pick.choices(bits, k=pick.randint(1, 10))) for _ in range(5000)]
    short = [Seen(t).seen for t in texts]
    monkeypatch.setattr(html, "PLAIN", re.compile("(?!)"))
    assert short == [Seen(t).seen for t in texts]


def _files(*contents):
    return pa.RecordBatch.from_pydict({"path": [str(i) for i in range(len(contents))], "content": [c.encode("cp932") for c in contents]})


def test_rows_of_files_go_on_in_bounded_batches():
    run = files.batched(lambda path, content: ((path, line) for line in str(content, "cp932").split()), "path string, line string")
    assert [b.num_rows for b in run(iter([_files(*["x y"] * 50), _files("z")]))] == [101]
    big = list(run(iter([_files("x " * (2 * files.ROWS + 5), ("y" * (files.CHARACTERS // 2) + " ") * 3)])))
    assert [b.num_rows for b in big] == [files.ROWS, files.ROWS, 7, 1] and big[2]["path"].to_pylist() == ["0"] * 5 + ["1"] * 2


def test_margin_files_of_odd_lines(spark):
    head = ",".join(reversed(files.MARGIN))
    row = "0,,,,,,\"1,000\",確報,東証,1301,,2024/01/05"
    content = f"{head}\r\n{row},more\r\n\r\n{row.replace('0,,', '7,,')}\n東証\n{row.replace('東証', '名証')}".encode("cp932")
    got = files.margin_rows(spark.createDataFrame([("a", bytearray(content))], "path string, content binary")).collect()
    assert [(r.code, r.date, r.settle_date, r.kind, r.yushi_new, r.net_balance) for r in got] == [("1301", D("2024-01-05"), None, "final", 1000, n) for n in (0, 7)]
    with pytest.raises(Exception, match="columns missing"):
        files.margin_rows(spark.createDataFrame([("a", bytearray())], "path string, content binary")).collect()


@pytest.mark.parametrize("n", [0, 3, 70_000])
def test_stored_zips_are_read_by_zipfile(n):
    given = [(f"a/{i}.htm", f"é{i}" * (i % 3)) for i in range(n)]
    with zipfile.ZipFile(io.BytesIO(control._stored(given))) as archive:
        assert archive.testzip() is None and [(m, archive.read(m).decode()) for m in archive.namelist()] == given


def test_texts_of_filings_file_by_file(spark):
    def pack(**pages):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for name, page in pages.items():
                archive.writestr(name.replace("_", "/") + ".htm", page)
        return bytearray(out.getvalue())

    given = [("a", pack(PublicDoc_2="<p>two", PublicDoc_1="<h1>T</h1>", other="<p>no")), ("b", pack(x="<p></p>")), ("c", bytearray(b"no zip")), ("d", pack())]
    made = files.filing_texts(spark.createDataFrame(given, "path string, content binary"), most=5)
    assert sorted(made.collect()) == [("a", "T", "T\n\ntw", True), ("b", None, "", False), ("c", None, "", False), ("d", None, "", False)]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def filings(n, status="200", **more):
    return json.dumps({"metadata": {"status": status}, "results": [{"docID": f"S{n}", "edinetCode": 7, "docTypeCode": "120", "periodStart": "", "withdrawalStatus": "1", "disclosureStatus": 2, "new": {"a": [1]}, "flag": True} | more, {"docID": None, "withdrawalStatus": "x"}]})


def test_list_fields_of_any_type(spark):
    frame = spark.createDataFrame([(filings(1),), (filings(2, secCode="13010", withdrawalStatus=None),), ("[1, 2]",), ("",), (None,)], "text string")
    a, b, *rest = sorted(files.filing_rows(frame).collect(), key=lambda r: r.docID or "z")
    assert (a.docID, a.edinetCode, a.periodStart, a.withdrawalStatus, a.disclosureStatus, a.other) == ("S1", "7", None, 1, 2, {"new": '{"a":[1]}', "flag": "true"})
    assert (b.secCode, b.withdrawalStatus) == ("13010", None) and len(rest) == 2 and rest[0].docID is None and rest[0].withdrawalStatus is None
    assert set(a.asDict()) == {*files.FILING, *files.FILING_NUMBERS, "other"} and len(files.FILING) + len(files.FILING_NUMBERS) == 17


def test_dates_by_names_alone(spark, tmp_path):
    for day, content in (("2024-01-04", b""), ("2024-01-05", b"no gzip"), ("2024-01-06", b"x" * 5000), ("2024-13-01", b""), ("2024-1-7", b"")):
        (tmp_path / f"date={day}").mkdir()
        (tmp_path / f"date={day}" / "part.txt.gz").write_bytes(content)
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "date=2024-01-08.txt").write_text("x")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 0)  # a file that were opened would be an error
    try:
        with pytest.raises(Exception, match="maxLength|exceeds"):
            files.binary_files(spark, str(tmp_path / "date=2024-01-06")).collect()
        assert [r.date for r in files.kept_dates(spark, str(tmp_path)).collect()] == ["2024-01-04", "2024-01-05", "2024-01-06"]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_days_as_a_source_and_as_a_stream(spark, tmp_path):
    days.register(spark)
    at = str(tmp_path / "kept")
    put = lambda *rows: files.write_days(spark.createDataFrame(list(rows), "date string, text string"), at)
    put(("2024-01-04", filings(4)), ("2024-01-05", filings(5, flag=None)), ("2024-01-06", "{ not json"))
    read = lambda: spark.read.format("filing_days").option("path", at).load()
    plain = lambda df: sorted(map(repr, df.drop("date").collect()))
    assert plain(read()) == plain(files.filing_rows(files.kept_days(spark, at))) and read().count() == 4
    assert {r.date for r in read().collect()} == {D("2024-01-04"), D("2024-01-05")}

    (tmp_path / "kept" / "date=2024-01-07").mkdir()
    bad = tmp_path / "kept" / "date=2024-01-07" / "part.txt.gz"
    bad.write_bytes(gzip.compress(filings(7, status="404").encode()))
    with pytest.raises(Exception, match="status 404"):
        read().collect()
    one = read().where("date = date '2024-01-05' and docID is not null")
    assert [r.docID for r in one.collect()] == ["S5"] and one.rdd.getNumPartitions() == 1  # the bad day isn't opened
    assert read().where("date < date '2024-01-05'").count() == 2 and read().where("date > date '2024-02-01'").count() == 0
    bad.write_bytes(gzip.compress(filings(7).encode())[:-9])  # cut off

    seen = []

    def run():
        stream = spark.readStream.format("filing_days").option("path", at).load()
        stream.writeStream.foreachBatch(lambda b, n: seen.append(b.toPandas())).option("checkpointLocation", str(tmp_path / "c")).start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()

    run()
    put(("2024-01-08", filings(8)))
    run()
    got = [sorted(x for x in b["docID"] if x) for b in seen if len(b)]
    assert got == [["S4", "S5"], ["S8"]]
