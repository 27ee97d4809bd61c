import datetime as dt
import io
import zipfile

import pytest
from barspark.functions import html
from barspark.functions import scalars as sc
from barspark.operators import context, control, export, filings, fundamentals, merge, metering, supply
from barspark.sources import files
from pyspark.sql import functions as F

D = dt.date.fromisoformat


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_short_totals_scenario(spark):
    data = [
        ("X", D("2026-01-01"), "a", 1.5, 150000, None), ("X", D("2026-01-01"), "b", 1.3, 130000, None), ("X", D("2026-01-05"), "c", 1.0, 100000, None),
        ("X", D("2026-01-10"), "a", 2.05, 205000, None), ("X", D("2026-01-10"), "d", 0.4, 40000, None), ("Y", D("2026-01-01"), "a", 0.9, 9, "報告義務消失"),
        ("Z", D("2026-01-01"), "a", None, None, None),
    ]
    reports = spark.createDataFrame(data, "symbol string, calc_date date, holder_id string, ratio double, quantity long, note string")
    got = rows(supply.short_totals(reports), "symbol", "date")
    assert got == [
        ("X", D("2026-01-01"), 2.8, 280000, 2), ("X", D("2026-01-05"), 3.8, 380000, 3), ("X", D("2026-01-10"), 4.35, 435000, 3),
        ("Y", D("2026-01-01"), 0.0, 0, 0), ("Z", D("2026-01-01"), 0.0, 0, 1),
    ]
    assert supply.short_totals(reports.limit(0)).count() == 0


def test_next_bar_bounds(spark):
    bars = spark.createDataFrame([("X", D(f"2024-01-{d:02d}")) for d in (2, 3, 5, 8)], "symbol string, date date")
    docs = spark.createDataFrame([(1, "X", D("2024-01-01")), (2, "X", D("2024-01-02")), (3, "X", D("2024-01-04")), (4, "X", D("2024-01-09")), (5, "X", None), (6, "Q", D("2024-01-03"))], "doc_id long, symbol string, day date")
    got = {r.doc_id: r.marker_date for r in supply.next_bar(docs, bars, F.col("day")).collect()}
    assert got == {1: None, 2: D("2024-01-02"), 3: D("2024-01-05"), 4: None, 5: None, 6: None}


def test_runs_and_carry(spark):
    data = spark.createDataFrame([("X", D(f"2024-01-{i:02d}"), f) for i, f in enumerate((True, True, None, False, True), 1)], "symbol string, date date, f boolean")
    assert rows(supply.runs(data, F.col("f")), "start") == [("X", D("2024-01-01"), D("2024-01-02"), 2), ("X", D("2024-01-05"), D("2024-01-05"), 1)]


def test_merges_are_idempotent_and_independent_of_order(spark):
    margin = spark.createDataFrame([("X", "d", "prelim", 1, 1), ("X", "d", "final", 2, 2), ("X", "d", "prelim", 3, 3), ("X", "e", "final", 4, 4), ("X", "e", "final", 5, 5)], "symbol string, date string, kind string, balance int, batch int")
    best = merge.final_over_prelim(margin, ["symbol", "date"], "balance")
    assert {r.date: r.balance for r in best.collect()} == {"d": 2, "e": 5}
    again = merge.final_over_prelim(best.unionByName(margin.orderBy(F.desc("batch"))), ["symbol", "date"], "balance")
    assert rows(again, "date") == rows(best.select(*again.columns), "date")
    old = spark.createDataFrame([("k", 1, "a"), ("m", None, "b")], "k string, v int, fixed string")
    new = spark.createDataFrame([("k", None, "z"), ("m", 7, "z"), ("n", 9, "z")], "k string, v int, fixed string")
    assert rows(merge.keep_old_where_missing(old, new, ["k"], ("fixed",)), "k") == [("k", 1, "a"), ("m", 7, "b"), ("n", 9, "z")]
    assert rows(merge.replace_suffix(old, old.limit(0), "k", "v"), "k") == rows(old, "k")


def test_withdrawals_follow_their_document(spark):
    docs = spark.createDataFrame([(1, dt.datetime(2024, 1, 5), 0), (2, dt.datetime(2024, 1, 5), 0), (3, dt.datetime(2024, 1, 5), 1)], "doc_id long, submit_at timestamp, withdrawal int")
    stubs = spark.createDataFrame([(9, 1, 1, D("2024-01-07")), (2, None, 2, D("2024-01-05")), (8, 3, 2, D("2024-01-01"))], "doc_id long, parent long, status int, date date")
    got = {r.doc_id: (r.withdrawal, r.changed) for r in merge.withdrawals(docs, stubs).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}


def test_role_rules(spark):
    docs = spark.createDataFrame([(1, "350", "E1", "E2", None, "S1"), (2, "240", "E1", None, "E2", "S9"), (3, "120", "E9", None, None, "S9"), (4, "239", "E2", None, "E1", None), (5, "321", "E1", None, "E2", None)], "doc_id long, doc_type string, filer string, issuer string, subject string, sec_code string")
    targets = spark.createDataFrame([("A", "E1", "S1"), ("B", "E2", "S2"), ("C", None, "S9")], "symbol string, entity string, sec_code string")
    got = sorted(rows(filings.match_roles(docs, targets)))
    assert got == [(1, "B", "issuer"), (2, "A", "filer"), (2, "B", "subject"), (2, "C", "filer"), (3, "C", "filer"), (4, "B", "filer"), (5, "A", "filer")]
    names = docs.select("doc_type", filings.label(F.col("doc_type")).alias("l"), filings.category(F.col("doc_type")).alias("c"))
    assert {r.doc_type: (r.l, r.c) for r in names.collect()} == {"350": ("大量保有", "supply"), "240": ("TOB", "supply"), "120": ("有報", "report"), "239": ("その他", "other"), "321": ("その他", "other")}


def test_growth_cagr_trend_position(spark):
    cases = [([100.0, 110.0, 121.0], "pct"), ([-100.0, 50.0], "pct"), ([-100.0, 0.0], "pct"), ([0.0, 5.0], "pct"), ([5.0, 5.0], "pt"), ([2.0, None, 8.0], "pt"), ([1.0], "pct"), ([100.0, None, 121.0], "pct")]
    h = F.col("h")
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, h array<double>, mode string").select(
        "i", fundamentals.steps(h).alias("s"), fundamentals.cagr(h).alias("c"), fundamentals.trend(h, F.col("mode"), F.lit(1.0)).alias("t"), fundamentals.position(h).alias("p")
    ).orderBy("i").collect()
    assert got[0].s[0] is None and got[0].s[1] == pytest.approx(10) and got[0].c == pytest.approx(10) and got[0].t == "better" and got[0].p == 100
    assert got[1].s == [None, None] and got[1].c is None and got[1].t is None
    assert got[2].s[1] == pytest.approx(100)  # from a loss to zero is valid
    assert got[3].s[1] is None and got[3].c is None
    assert got[4].p == 50 and got[4].t == "flat" and got[5].t == "better" and got[6].p is None and got[6].t is None
    assert got[7].c == pytest.approx(21)


def test_fact_file_to_rows(spark, tmp_path):
    lines = ["要素ID\tコンテキストID\tユニットID\t値"]
    tail = "SummaryOfBusinessResults"
    for el, ctx, unit, value in (
        (f"jpcrp_cor:NetSales{tail}", "CurrentYearDuration", "JPY", "1,000"), (f"jpcrp_cor:OperatingRevenue1{tail}", "CurrentYearDuration", "JPY", "5"),
        (f"jpcrp_cor:RateOfReturnOnEquity{tail}", "Prior1YearDuration", "pure", "0.29"), (f"jpcrp_cor:DividendPaidPerShare{tail}", "CurrentYearInstant_NonConsolidatedMember", "JPYPerShares", "12.5"),
        (f"jpcrp_cor:NetSales{tail}", "CurrentYearDuration_NonConsolidatedMember", "JPY", "7"), (f"jpcrp_cor:NetAssets{tail}", "CurrentYearInstant_SegmentMember", "JPY", "1"),
        (f"jpcrp_cor:TotalAssets{tail}", "CurrentYearInstant", "JPY", "－"), ("jpdei_cor:Standard", "FilingDateInstant", "", "IFRS"),
    ):
        lines.append("\t".join((el, ctx, unit, value)))
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("XBRL_TO_CSV/jpcrp030000-asr-001.csv", "\r\n".join(lines).encode("utf-16"))
    raw = files.fact_rows(files.binary_files(spark, str(tmp_path / "f.zip")))
    assert fundamentals.header(raw).first().items == {"Standard": "IFRS"} or fundamentals.header(raw).first()["items"] == {"Standard": "IFRS"}
    ends = {"fy_end": F.lit("2026-02-28").cast("date"), "interim_end": F.lit(None).cast("date"), "prior_interim_end": F.lit(None).cast("date")}
    facts = fundamentals.one_each(fundamentals.valued(fundamentals.placed(fundamentals.mapped(raw).withColumns(ends))))
    got = {(r.item, str(r.period_end)): (r.number, r.unit, r.basis) for r in fundamentals.based(facts).collect()}
    assert got == {("revenue", "2026-02-28"): (1000.0, "JPY", "consolidated"), ("roe", "2025-02-28"): (29.0, "%", "consolidated"), ("dps", "2026-02-28"): (12.5, "JPY/share", "consolidated")}


def test_code_list_html_table_and_margin_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "codes.zip", "w") as z:
        z.writestr("list.csv", "ダウンロード,2026\r\nコード,証券,名前\r\nE1,13010,甲\r\n,,\r\nE2,,乙\r\nE3,130A0,丙\r\n".encode("cp932"))
    codes = files.code_list(files.binary_files(spark, str(tmp_path / "codes.zip")), "list.csv", {"コード": "entity", "証券": "sec_code"})
    assert rows(codes, "entity") == [("E1", "13010"), ("E2", None), ("E3", "130A0")]
    html = "<table><tr><td>decoy</td></tr></table><table id='sort'><tr class='obb'><td>2026/01/05</td><td><a href='/1/?f=901'>Fund</a></td><td>0.61%</td><td>+0.10%</td><td>1,234株</td><td>-5株</td><td></td></tr>" + "<tr class='occ'><td>2026/01/05</td><td><a href='/1/?f=901'>Fund B</a></td><td>0.40%</td><td></td><td>-</td><td>-</td><td>報告義務消失</td></tr><tr class='x'><td>no</td></tr></table>"
    (tmp_path / "page.html").write_text(html)
    table = files.html_rows(files.binary_files(spark, str(tmp_path / "page.html")))
    found = files.short_positions(table).collect()
    assert len(found) == 1 and found[0].holder == "Fund B" and found[0].ratio == 0.4 and found[0].quantity is None and found[0].note == "報告義務消失"
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    (tmp_path / "m.csv").write_bytes('"申込日","コード","市場","区分"\r\n"2026/01/05","1301","東証","確報"\r\n"2026/01/05","1301","名証","確報"\r\n"2026/01/06","130A","東証","?"\r\n'.encode("cp932"))
    margin = files.margin_balances(spark, str(tmp_path / "m.csv"), ("申込日", "コード", "区分"), "市場", "区分")
    assert [(r["コード"], r["kind"]) for r in margin.orderBy("申込日").collect()] == [("1301", "final"), ("130A", "prelim")]
    with pytest.raises(ValueError, match="missing"):
        files.margin_balances(spark, str(tmp_path / "m.csv"), ("残高",), "市場", "区分")


def test_calendar_and_metering(spark):
    days = spark.createDataFrame([(D("2026-02-28"), 2), (D("2024-02-29"), 2), (D("2025-03-31"), 2), (D("2025-03-15"), 1)], "d date, k int")
    got = [r[0] for r in days.select(control.year_end_back(F.col("d"), F.col("k"))).collect()]
    assert got == [D("2024-02-29"), D("2022-02-28"), D("2023-03-31"), D("2024-03-15")]
    ts = dt.datetime(2026, 3, 8, 7, 59, 59)
    t0 = dt.datetime(2026, 1, 1, 12, 0, 0)
    events = spark.createDataFrame([("m", t0, 10, True, 1), ("m", t0 + dt.timedelta(seconds=59), 20, True, 2), ("m", t0 + dt.timedelta(seconds=60), 5, False, 3)], "model string, ts timestamp, tokens long, is_request boolean, event_id long")
    assert [(r.requests_60s, r.tokens_60s) for r in metering.trailing_minute(events).orderBy("ts").collect()] == [(1, 10), (2, 30), (1, 25)]
    assert spark.range(1).select(metering.pacific_day(F.lit(ts))).first()[0] == D("2026-03-07")
    wait = metering.waits(events, F.lit(t0 + dt.timedelta(seconds=59)), 2, 0, 1).first().wait_s
    assert wait == pytest.approx(1.0)
    assert metering.waits(events, F.lit(t0 + dt.timedelta(seconds=59)), 0, 30, 5).first().wait_s == pytest.approx(1.0)


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(sc.number_tokens(F.lit("on 2024-01-05 1,234.5 and -7 of 12345"))) == ["2024-01-05", "1,234.5", "-7", "12345"]
    assert [pick(sc.trimmed_number(F.lit(x))) for x in (1.5, 2.0, -0.00001, 0.12345)] == ["1.5", "2", "0", "0.1235"]
    assert pick(sc.scrub_number(F.lit(" -1,234.5% "))) == -1234.5 and pick(sc.scrub_number(F.lit("-"))) is None
    assert pick(sc.thin(F.lit(10), 4)) == [0, 3, 6, 9] and pick(sc.thin(F.lit(2), 4)) == [0, 1]
    assert pick(sc.mask_secrets(F.lit("a?API_KEY=abc&x=1"))) == "a?API_KEY=***&x=1" and pick(sc.first_four(F.lit("abcdef"))) == "abcd**"
    page = "<head><title>x</title></head><body><script>1</script><p>One &amp; two</p><p> </p><div>Three</div></body>"
    assert pick(html.text_of(F.lit(page))) == "One & two\nThree"
    assert spark.createDataFrame([("ｔｏｙｏｔａ ",)], "q string").select(files.folded(F.col("q"))).first()[0] == "TOYOTA"


def test_verification_rounds_either_way(spark):
    claims = spark.createDataFrame([(1, t) for t in ("1,234.6", "12.345", "2024-01-05", "2024-01-06", "7", "99")], "k int, token string")
    sources = spark.createDataFrame([(1, t) for t in ("1234.56", "12.3", "2024-01-05", "7")], "k int, token string")
    assert rows(context.verify(claims, sources, ["k"])) == [(1, 5, 3, 0.6)]


def test_csv_for_people(spark, tmp_path):
    bars = spark.createDataFrame([("A", D("2024-01-05"), 1.26, 2.0, 1.0, None, 5, "JPY"), ("A", D("2024-01-09"), 1.0, 2.0, 1.0, 1.5, 6, "JPY")], "symbol string, date date, open double, high double, low double, close double, volume long, currency string")
    export.write_human_csv(export.human_prices(bars), str(tmp_path / "out"))
    (file,) = (tmp_path / "out" / "symbol=A").glob("*.csv")
    lines = file.read_bytes().decode("utf-8").splitlines()
    assert lines[0].startswith("﻿day,open") and lines[1].startswith("2024/01/09") and lines[2] == "2024/01/05,1.3,2.0,1.0,,5"


def test_stream_of_bars(spark, tmp_path):
    from barspark.streaming import ingest

    def put(name, data):
        spark.createDataFrame(data, ingest.BAR).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    bar = lambda s, d, c: (s, D(d), c, c, c, c, 1)
    put("a", [bar("A", "2024-01-01", 1.0), bar("B", "2024-01-01", 5.0)])
    run = lambda: ingest.keep_merged(ingest.bar_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    put("b", [bar("A", "2024-01-01", 2.0), bar("A", "2024-01-02", 3.0)])
    run()
    got = sorted((r.symbol, str(r.date), r.close) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    assert got == [("A", "2024-01-01", 2.0), ("A", "2024-01-02", 3.0), ("B", "2024-01-01", 5.0)]


def test_json_lists(spark, tmp_path):
    good = '{"metadata":{"status":"200"},"results":[{"docID":"S1","docTypeCode":"120","submitDateTime":"2024-01-05 10:00"},{"docID":"S2","withdrawalStatus":"1","parentDocID":"S1"},{"docID":"S3","withdrawalStatus":"0"}]}'
    (tmp_path / "2024-01-05.json").write_text(good)
    (tmp_path / "2024-01-06.json").write_text("{ not json")
    docs, stubs = files.split_stubs(files.filing_list(spark, str(tmp_path)))
    assert [r.docID for r in docs.collect()] == ["S1"] and [r.docID for r in stubs.collect()] == ["S2"]
    (tmp_path / "2024-01-07.json").write_text('{"metadata":{"status":"404"},"results":[]}')
    with pytest.raises(Exception, match="status 404"):
        files.filing_list(spark, str(tmp_path)).collect()


def test_days_are_kept_apart(spark, tmp_path):
    put = lambda rows: files.write_days(spark.createDataFrame(rows, "date string, text string"), str(tmp_path / "d"))
    put([("2024-01-05", "one"), ("2024-01-04", "two"), ("2024-1-6", "odd")])
    put([("2024-01-05", "again")])
    broken = tmp_path / "d" / "date=2024-01-08"
    broken.mkdir()
    (broken / "part.txt.gz").write_bytes(b"no gzip")
    assert {(r.date, r.text.strip()) for r in files.kept_days(spark, str(tmp_path / "d")).collect()} == {("2024-01-05", "again"), ("2024-01-04", "two")}
    assert [r.date for r in files.kept_dates(spark, str(tmp_path / "d")).collect()][:2] == ["2024-01-04", "2024-01-05"]


def test_next_bar_grows_with_the_rows(spark):
    """The plan has no frame that looks ahead of a row, which would read the rest of its symbol again for each."""
    docs = spark.createDataFrame([("A", D("2024-01-06")), ("A", None), ("A", D("2023-01-01")), ("A", D("2024-02-01")), ("B", D("2024-01-05"))], "symbol string, day date")
    bars = spark.createDataFrame([("A", D("2024-01-05")), ("A", D("2024-01-09")), ("A", D("2024-01-20"))], "symbol string, date date")
    found = supply.next_bar(docs, bars, F.col("day"))
    assert "unboundedfollowing$()), None, true" not in found._jdf.queryExecution().toString() and "currentrow$(), unboundedfollowing$()" not in found._jdf.queryExecution().toString()
    assert {(r.symbol, str(r.day)): str(r.marker_date) for r in found.collect()} == {
        ("A", "2024-01-06"): "2024-01-09", ("A", "None"): "None", ("A", "2023-01-01"): "None", ("A", "2024-02-01"): "None", ("B", "2024-01-05"): "None",
    }


def test_next_bar_of_a_symbol_is_dealt_by_month(spark):
    """Gaps of months and years between bars, many filings of one symbol, days that are missing, a symbol without bars."""
    import random
    from datetime import timedelta

    r, begin = random.Random(11), D("2019-03-10")
    held = sorted({begin + timedelta(days=d) for d in [*r.sample(range(400), 60), *r.sample(range(1100, 1500), 40)]})
    asked = [(i, "X" if i % 9 else "Q", None if i % 50 == 7 else begin + timedelta(days=r.randrange(-60, 1700))) for i in range(900)]
    bars = spark.createDataFrame([*[("X", d) for d in held], ("X", None)], "symbol string, date date")
    found = supply.next_bar(spark.createDataFrame(asked, "doc_id long, symbol string, day date"), bars, F.col("day"))
    got = {x.doc_id: x.marker_date for x in found.collect()}
    want = {i: min((h for h in held if s == "X" and d and held[0] <= d <= h), default=None) for i, s, d in asked}
    assert got == want and len(set(got.values())) > 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and "block" in plan.split("Window")[1]
    empty = bars.limit(0)
    assert supply.next_bar(spark.createDataFrame(asked, "doc_id long, symbol string, day date"), empty, F.col("day")).where("marker_date is not null").count() == 0
