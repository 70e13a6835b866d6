from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomline.operators import asof
from loomline.operators import units as U


def parsed(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r[0]: (r[1], r[2]) for r in df.select("t", U.currency_of(F.col("t")), U.scale_of(F.col("t"))).collect()}


def test_texts_of_units(spark):
    want = {
        "USD": ("USD", None), " usd ": ("USD", None), "US$": ("USD", None), "U.S. dollar": ("USD", None), "US cents": ("USD", "c"), "USc": ("USD", "c"), "USX": ("USD", "c"), "A$": ("AUD", None), "CA$": ("CAD", None), "C$": ("CAD", None),
        "GBp": ("GBP", "c"), "gbp": ("GBP", None), "GBX ": ("GBP", "c"), "GBP pence": ("GBP", "c"), "pence": ("GBP", "c"), "STG": ("GBP", None), "ZAc": ("ZAR", "c"), "ZAR cents": ("ZAR", "c"), "Rand": ("ZAR", None), "agorot": ("ILS", "c"), "NIS": ("ILS", None),
        "JPY (100)": ("JPY", "h"), "¥100": ("JPY", "h"), "100 JPY": ("JPY", "h"), "JPY/100": ("JPY", "h"), "¥": ("JPY", None), "kUSD": ("USD", "k"), "USDk": ("USD", "k"), "USDx1000": ("USD", "k"), "USD '000": ("USD", "k"), "TEUR": ("EUR", "k"), "k€": ("EUR", "k"),
        "£'000": ("GBP", "k"), "USD (in thousands)": ("USD", "k"), "MUSD": ("USD", "m"), "USD 1e6": ("USD", "m"), "mio CHF": ("CHF", "m"), "USDm": ("USD", "m"), "USD MM": ("USD", "m"), "Fr.": ("CHF", None), "EUR cent": ("EUR", "c"), "Eurocent": ("EUR", "c"),
        "VENUE_B": (None, None), "VENUE_B; amt in 000s": (None, "k"), "VENUE_B unit: 1/100": (None, "c"), "VENUE_B unit: 1": (None, "1"), "VENUE_B amt in cents/pence": (None, "c"), "VENUE_B (USD, thousands)": ("USD", "k"), "VENUE_B Beträge in Tsd.": (None, "k"),
        "VENUE_B full amounts": (None, "1"), "VENUE_B all PLN amounts in millions": ("PLN", "m"), "VENUE_B ccy=SEK": ("SEK", None), "": (None, None), "nonsense": (None, None), None: (None, None), "x" * 50_000: (None, None),
    }
    assert parsed(spark, *want) == want


def test_graph_compositions_and_cycles():
    g = U.ConversionGraph()
    g.add("C", "K", 1.0, 273.15)
    g.add("F", "C", 5 / 9, -160 / 9)
    back = {(s, t): (a, b) for s, t, a, b, _ in g.compositions(["K", "F"])}
    a, b = back["F", "K"]
    assert a * 32 + b == pytest.approx(273.15) and back["K", "F"][0] * 273.15 + back["K", "F"][1] == pytest.approx(32)
    assert g.inconsistent() == []
    g.add("F", "K", 5 / 9, 255.0)
    assert g.inconsistent()
    with pytest.raises(ValueError):
        g.add("a", "b", 0)
    money = {(s, t): (a, b, n) for s, t, a, b, n in U.money_graph(["USD"]).compositions(["USD|1"])}
    assert money["USD|m", "USD|1"][0] == pytest.approx(1e6) and money["USD|c", "USD|1"][0] == pytest.approx(0.01)


FX = "as_of_date date, ccy string, usd_rate decimal(18,8), rate_id bigint, loaded_at timestamp_ntz"


def fx(spark, *data):
    return spark.createDataFrame([(date(2024, 1, d), c, None if r is None else Decimal(str(r)), i, datetime(2024, 1, *at)) for d, c, r, i, at in data], FX)


def test_quotes(spark):
    q = U.quotes(fx(spark, (1, "USD/JPY", 150, 1, (1, 3)), (1, "JPY/100", 0.66, 2, (1, 3)), (1, "cad-usd", 0.7, 3, (1, 3)), (1, "?", 1, 4, (1, 3)), (1, "EUR", None, 5, (1, 3)), (1, "USDSEK", 10, 6, (1, 3)), (1, "USDSEK", 10, 6, (1, 3))))
    assert [(c, round(u, 6)) for c, u in rows(q.select("ccy", "usd"))] == sorted([("JPY", round(1 / 150, 6)), ("JPY", 0.0066), ("CAD", 0.7), ("SEK", 0.1)], key=repr)


def late(spark, trades, rates):
    t = spark.createDataFrame(trades, "trade_id bigint, trade_ts timestamp_ntz, currency string, known string")
    return rows(U.rates_known_late(t, rates))


def test_known_and_final_rates(spark):
    rates = fx(spark, (1, "EUR", 1.0, 1, (1, 1)), (2, "EUR", 1.1, 2, (2, 1)), (2, "eur", 1.2, 3, (4, 1)), (3, "EUR", 1.3, 4, (6, 1)), (3, "EUR", 1.3, 4, (6, 1)), (9, "EUR", None, 5, (3, 1)))
    ts = lambda d, h=12: datetime(2024, 1, d, h)
    trades = [(1, ts(1), "EUR", "x"), (2, ts(2), "EUc", "x"), (3, ts(5), "Euro", "x"), (4, ts(7), "€", "x"), (5, None, "EUR", "x"), (6, ts(3), None, "x"), (7, ts(3), "??", "x"), (8, ts(1, 0), "EUR", "x"), (9, ts(2), "GBP", "x"), (2, ts(2), "EUc", "x")]
    assert late(spark, trades, rates) == [(2, 2), (2, 2), (3, 3)]
    assert late(spark, [], rates) == [] and late(spark, trades, fx(spark)) == []


def test_asof_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    hist = {(e, rnd.randint(0, 5000)): rnd.randint(1, 99) for e in "abc" for _ in range(40)}
    ev = [(i, rnd.choice("abcd"), rnd.randint(-100, 6000)) for i in range(300)]
    at = lambda m: datetime.fromtimestamp(1_700_000_000 + m * 60)
    h = spark.createDataFrame([(e, at(m), v) for (e, m), v in hist.items()], "entity string, valid_from timestamp_ntz, value bigint")
    e = spark.createDataFrame([(i, k, at(m), 1, "clash") for i, k, m in ev], "i bigint, k string, ts timestamp_ntz, from_us bigint, v string")
    got = {r["i"]: r["v"] for r in asof.match(e, "k", "ts", {"v": h}, 3600).collect()}
    want = {i: max(((m, v) for (k2, m), v in hist.items() if k2 == k and m <= t), default=(0, None))[1] for i, k, t in ev}
    assert got == want


def test_units_found(spark):
    a = [(i, datetime(2024, 1, 2), "XA1", Decimal("10"), "USD", "VENUE_A") for i in range(20)] + [(50, datetime(2024, 1, 2), "xa 1", Decimal("1000"), "USD", "VENUE_A"), (51, None, "XA1", Decimal("1000"), "USX", None), (52, None, None, None, "USX", None), (53, None, None, Decimal("5"), None, None), (54, None, "XA1", Decimal("0"), "GBp", "x")]
    b = [(1, datetime(2024, 1, 5), "TK.B", Decimal("100"), Decimal("1"), "USD", "VENUE_B"), (2, datetime(2024, 1, 5), "TK", Decimal("100"), Decimal("1000"), "USD", "VENUE_B"), (3, datetime(2024, 1, 5), "TK", Decimal("100"), Decimal("0.001"), None, "VENUE_B USD mn"), (4, datetime(2024, 1, 5), None, None, Decimal("1"), "USD", None), (5, None, "TK", Decimal("100"), None, "kUSD", None), (6, datetime(2024, 1, 5), "TK", Decimal("100"), Decimal("1"), "USD", "VENUE_B full amounts")]
    fa = spark.createDataFrame([(*r, "extra") for r in a], "trade_id bigint, trade_ts timestamp_ntz, isin string, price decimal(18,6), currency string, source_system string, unit_ccy string")
    fb = spark.createDataFrame([(*r, "extra") for r in b], "id bigint, exec_time timestamp_ntz, ticker string, qty decimal(20,4), gross_amount decimal(18,6), ccy string, source_system string, isin string")
    ref = spark.createDataFrame([(1, date(2024, 1, 1), '{"isin": "XA1", "ticker": "tk"}', datetime(2024, 1, 1, 9))], "id bigint, as_of_date date, payload string, loaded_at timestamp_ntz")
    rates = fx(spark, (1, "USD", 1, 1, (1, 1)), (1, "GBP", 1.25, 2, (1, 1)))
    table = U.conversions(spark, U.money_graph(), [f"{c}|1" for c in U.CURRENCIES])
    got = rows(U.units_found(U.trade_units(fa, fb, ref, rates), table))
    assert got == sorted([("a", 50, "USD", -2), ("a", 51, "USD", -2), ("a", 54, "GBP", -2), ("b", 1, "USD", 3), ("b", 3, "USD", 6)], key=repr)
    assert rows(U.units_found(U.trade_units(fa.limit(0), fb.limit(0), ref.limit(0), rates.limit(0)), table)) == []
    usd = {(r["feed"], r["row_id"]): r["amount_usd"] for r in U.amounts_in_usd(U.trade_units(fa, fb, ref, rates), rates).collect()}
    assert usd["a", 50] == 10 and usd["b", 3] == 1000 and usd["b", 1] == 1000 and usd["a", 51] is None


def test_rates_are_edges_as_they_are_quoted(spark):
    q = U.quoted(fx(spark, (1, "USD/JPY", 150, 1, (1, 3)), (1, "JPY/100", 0.66, 2, (1, 3)), (1, "EUR/GBP", 0.85, 3, (1, 3)), (1, "GBX", 0.0125, 4, (1, 3)), (1, "Euro", 1.1, 5, (1, 3)), (1, "?", 1, 6, (1, 3)), (1, "EUR", 0, 7, (1, 3))))
    assert rows(q.select("source", "target", "slope")) == sorted([("USD|1", "JPY|1", 150.0), ("JPY|h", "USD|1", 0.66), ("EUR|1", "GBP|1", 0.85), ("GBP|c", "USD|1", 0.0125), ("EUR|1", "USD|1", 1.1)], key=repr)


def day_of(d):
    return (date(2024, 1, d) - date(1970, 1, 1)).days


def test_daily_compositions(spark):
    rates = fx(spark, (1, "GBP", 1.25, 1, (1, 3)), (1, "EUR/GBP", 0.8, 2, (1, 3)), (3, "USD/JPY", 150, 3, (3, 1)), (3, "JPY/100", 0.7, 4, (3, 5)), (4, "GBP", 1.5, 5, (4, 1)), (4, "GBP", 1.0, 6, (4, 2)))
    at = int(datetime(2024, 1, 5).timestamp() * 1_000_000)
    got = {(r["day"], r["unit"]): r["slope"] for r in U.daily_conversions(rates, at).collect()}
    assert got[day_of(1), "GBP|c"] == pytest.approx(0.0125) and got[day_of(1), "EUR|1"] == pytest.approx(1.0)  # through GBP
    assert (day_of(2), "JPY|1") not in got and got[day_of(3), "JPY|1"] == pytest.approx(0.007)  # of one date the quotation loaded last
    assert got[day_of(4), "EUR|k"] == pytest.approx(800.0) and got[day_of(5), "GBP|1"] == 1.0  # corrected, and in force on the next day


def test_conflicting_rates_are_reported(spark):
    good = [(1, "GBP", 1.25, 1, (1, 3)), (1, "EUR", 1.0, 2, (1, 3)), (1, "EUR/GBP", 0.8, 3, (1, 3)), (2, "GBP", 1.25, 4, (2, 3)), (2, "EUR", 1.0, 5, (2, 3))]
    at = int(datetime(2024, 1, 3).timestamp() * 1_000_000)
    assert rows(U.rate_conflicts(fx(spark, *good), at)) == []
    bad = U.rate_conflicts(fx(spark, *good, (2, "EUR/GBP", 0.9, 6, (2, 3))), at).collect()
    assert {r["day"] for r in bad} == {day_of(2)} and len(bad) == 1 and bad[0]["error"] > 0.05


def test_texts_are_read_alike_once_or_row_by_row(spark, monkeypatch):
    df = spark.createDataFrame([("kUSD", "x"), (None, "VENUE_B (EUR, thousands)"), ("GBp", None), (None, None), ("kUSD", "x")], "ccy string, src string")
    want = rows(U.stated(df, "ccy", "src"))
    monkeypatch.setattr(U.store, "is_small", lambda *a, **k: False)
    assert rows(U.stated(df, "ccy", "src")) == want and ("kUSD", "x", "USD", "k") in want and len(want) == 5
