import inspect

import pytest
from barspark import api, fixtures
from barspark.plans import supply as plans


@pytest.fixture(scope="module")
def store(spark, sf):
    stocks = spark.createDataFrame([(s, f"Name {s}", "JPY") for s in "ANRZ"], "symbol string, name string, currency string")
    links = spark.range(1, 400).selectExpr("id * 7 AS doc_id", "'A' AS symbol", "'filer' AS role")
    return api.Store(stocks, fixtures.bars(spark, sf), fixtures.short_reports(spark, sf), fixtures.filings(spark, sf), links)


def test_dashboard_and_lists(store):
    page = api.dashboard(store, "A")
    assert page["quote"].count() == 1 and page["table"].count() == 60 and page["cards"].count() >= 14
    assert page["signals"].count() <= 12 and page["short_points"].count() > 0
    assert page["filing_counts"].first()["total"] == api.get_filings(store, "A").count()
    assert {r.symbol: r.bars for r in api.list_stocks(store).collect()}["Z"] == 0


def test_export_and_context(store):
    assert api.export_rows(store, ["A", "N", "A"], 30).count() == 60
    for symbols, days in (([], 5), (["A"], 0)):
        with pytest.raises(ValueError):
            api.export_rows(store, symbols, days)
    made = api.text_context(store, "A", 120)
    assert made["recent"].count() == 20 and made["summary"].first()["bars"] == 100
    assert "short" not in inspect.getsource(api.text_context) and plans.QUERIES
