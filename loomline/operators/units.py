"""Quantities recorded in different units: reading unit texts, a conversion graph, and unit evidence.

A *unit* is written as `ISO|scale` (`USD|k`, `GBP|c`, `JPY|h`). Conversions are edges of a graph with affine
functions y = slope * x + offset: the scales of a currency, and every exchange rate as it is quoted (`USD/JPY` from USD to
JPY, `JPY/100` from a hundred yen to USD, `EUR/GBP` from EUR to GBP), dated. For each day the shortest compositions to the
canonical units are precomputed (fresh rates are short, old ones long), cycles are checked for consistency, and amounts are
converted by one equi-join on (source unit, canonical unit, day).

The graph has a few nodes for each currency and scale and a few edges for each quotation, whatever the number of rows; its
composed table has units x days rows and is broadcast only if proven small. Unit texts are read once for each different
text and joined back. Amounts without a stated unit are judged against the median unit price of their instrument, an
aggregate with map-side partials.

Defined cases: rows with a null amount or without a readable currency anywhere have no unit; a stated unit
holds whatever the prices say; without one, rows without instrument or quantity, with amounts of zero or less,
and rows of instruments with fewer than three prices count as single units; empty texts state nothing, texts
of any length are read whole; amounts without a time, or before the first rate of their currency, have no USD amount;
repeated rows come out as often as they come; empty tables give no rows; columns that are named like results are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
import sys
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from . import asof, history

#: ISO codes of the market, and power of ten of each scale.
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "SGD", "HKD", "SEK", "PLN", "ILS", "ZAR", "MXN", "NOK", "DKK", "NZD", "CNY", "INR", "BRL", "KRW", "TRY", "CZK", "HUF", "THB")
SCALES = {"1": 0, "c": -2, "h": 2, "k": 3, "m": 6, "bn": 9}

#: Texts that name a currency (regular expressions over the text in upper case, in order).
NAMES = (
    (r"U\.? ?S\.? ?DOLLAR|US ?\$|U\.S\.\$|\bUS ?CENTS?\b|AMERICAN DOLLAR", "USD"),
    (r"\bAU?\$|AUSTRALIAN DOLLAR", "AUD"),
    (r"\bCA?\$|CANADIAN DOLLAR|\bCAN\$", "CAD"),
    (r"\bHK\$|HONG KONG DOLLAR", "HKD"),
    (r"\bSG?\$|SINGAPORE DOLLAR", "SGD"),
    (r"MX\$|MEX\$|MEXICAN PESO|\bPESOS?\b", "MXN"),
    (r"¥|\bYEN\b|円", "JPY"),
    (r"₪|\bNIS\b|\bAGOROT\b|\bAGORA\b|SHEKEL|\bILA\b|\bILX\b", "ILS"),
    (r"€|\bEUROS?\b|EUROCENT|\bEUX\b", "EUR"),
    (r"£|\bSTG\b|STERLING|(?<!/)\bPENCE\b|\bPENNY\b|\bPOUNDS?\b|\bGBX\b", "GBP"),
    (r"\bSFR\b|\bFR\.|SWISS FRANC|\bFRANKEN\b", "CHF"),
    (r"\bRANDS?\b|\bZAX\b", "ZAR"),
    (r"ZŁ|\bZLOTY|\bZLOTYCH", "PLN"),
    (r"\bSKR\b|SWEDISH KRON|\bKRONOR\b", "SEK"),
    (r"\bUSX\b", "USD"),
    (r"^\$$", "USD"),
)


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\xa0]+", " "))


def currency_of(text: Column) -> Column:
    """ISO code that a text names, or null."""
    t = _clean(text)
    u = F.upper(t)
    codes = "|".join(CURRENCIES)
    minor = "|".join(c[:2] + c[2].lower() for c in CURRENCIES) + "|" + "|".join(sorted({c[:2] + "c" for c in CURRENCIES}))
    two = {c[:2]: c for c in reversed(CURRENCIES)}
    by_two = F.create_map(*[F.lit(x) for kv in sorted(two.items()) for x in kv])
    word = F.coalesce(*[F.when(u.rlike(p), F.lit(c)) for p, c in NAMES])
    # a code may touch k, M, T, x1000 or 000: kUSD, TUSD, USDk, USDm, USDx1000
    code = F.regexp_extract(u, rf"(?:^|[^A-Z])(?:[KMT]|MIO|MN|TSD)?({codes})(?:[KM]|MM|BN|X|MN|MLN|MIO)?(?:$|[^A-Z])", 1)
    return (
        F.when(t.isin(*CURRENCIES), t)
        .when(t == "", F.lit(None).cast("string"))
        .when(t.rlike(rf"^(?:{minor})$"), F.element_at(by_two, F.substring(t, 1, 2)))
        .otherwise(F.coalesce(F.when(code != "", code), word))
    )


def scale_of(text: Column) -> Column:
    """Key of SCALES that a text states (`1` only if it says so), or null where it says nothing."""
    t = _clean(text)
    u = F.upper(t)
    codes = "|".join(CURRENCIES)
    minor = "|".join(c[:2] + c[2].lower() for c in CURRENCIES) + "|" + "|".join(sorted({c[:2] + "c" for c in CURRENCIES}))
    symbols = r"US\$|A\$|C\$|HK\$|S\$|\$|£|€|¥|₪"
    one = rf"(?:{codes}|{symbols})"
    return (
        F.when(t.isin(*CURRENCIES) | (t == ""), F.lit(None).cast("string"))
        .when(t.rlike(rf"^(?:{minor})$") | u.rlike(r"\b(?:GBX|ZAX|USX|ILA|ILX|EUX)\b|PENCE|\bPENNY\b|\bAGOROT\b|\bAGORA\b|CENTS?\b|CENTAVOS?\b|\bMINOR UNITS?\b|1/100|\bHUNDREDTHS?\b"), F.lit("c"))
        .when(u.rlike(rf"{one} ?\(100\)|{one} ?/ ?100(?!0)|(?:^|[^0-9A-Z])100 ?{one}|{one} ?100(?!0)|\bHUNDREDS?\b|{one} ?X ?100(?!0)"), F.lit("h"))
        .when(u.rlike(r"\bBILLIONS?\b|\bBN\b|\bMRD\b"), F.lit("bn"))
        .when(u.rlike(rf"MILLIONS?\b|\bMILLIONEN\b|\bMIO\b|\bMLN\b|\bMM\b|\bMN\b|1E6|1,?000,?000|'000,?000|\bM{one}|{one} ?M(?:M|N|LN|IO)?\b|(?:^| )M$"), F.lit("m"))
        .when(u.rlike(rf"THOUSANDS?\b|\bTSD\b|'?\b000S?\b|'000|X ?1,?000\b|1E3|\b1,?000\b|\bK(?:{codes})|\bK[€£¥₪$]|\bT(?:{codes})\b|{one} ?K\b|(?:^|[ :])K\b"), F.lit("k"))
        .when(u.rlike(r"FULL AMOUNTS?|\bIN UNITS\b|UNIT: ?1$|SINGLE UNITS?|MAJOR UNITS?"), F.lit("1"))
        .otherwise(F.lit(None).cast("string"))
    )


def with_readings(df: DataFrame, texts: Sequence[str], readings: Mapping[str, Callable[[], Column]]) -> DataFrame:
    """df with columns that are read from its text columns: each different combination is read once and joined back by broadcast.

    Where the combinations aren't proven few, every row is read where it is; nothing is shuffled either way.
    """
    different = store.materialize(df.select(*texts).distinct(), "texts")
    if not store.is_small(different):
        return df.withColumns({name: reading() for name, reading in readings.items()})
    side = different.select(*[F.col(t).alias(f"__{i}") for i, t in enumerate(texts)], *[reading().alias(name) for name, reading in readings.items()])
    side = store.materialize(side, "read-texts")
    on = [df[t].eqNullSafe(side[f"__{i}"]) for i, t in enumerate(texts)]
    return df.drop(*readings).join(F.broadcast(side), on, "left").drop(*[f"__{i}" for i in range(len(texts))])


# --- the conversion graph -------------------------------------------------------------------------


class ConversionGraph:
    """Units as nodes, affine conversions y = slope * x + offset as edges (each with its inverse)."""

    def __init__(self) -> None:
        self.edges: dict[str, dict[str, tuple[float, float, float]]] = {}
        self.all: list[tuple[str, str, float, float]] = []

    def add(self, source: str, target: str, slope: float, offset: float = 0.0, cost: float = 1.0) -> None:
        """An edge and its inverse; of several between two units the cheapest is kept to be walked, and all are checked."""
        if slope == 0 or not math.isfinite(slope):
            raise ValueError(f"{source} -> {target}: slope {slope} can't be inverted")
        self.all.append((source, target, slope, offset))
        if source == target or self.edges.get(source, {}).get(target, (0, 0, math.inf))[2] <= cost:
            return
        self.edges.setdefault(source, {})[target] = (slope, offset, cost)
        self.edges.setdefault(target, {})[source] = (1 / slope, -offset / slope, cost)

    def compositions(self, targets: Iterable[str]) -> list[tuple[str, str, float, float, int]]:
        """(source, target, slope, offset, steps) of the shortest composition from each unit that reaches a target."""
        out = []
        for target in targets:
            best: dict[str, tuple[float, float, float, int]] = {target: (0.0, 1.0, 0.0, 0)}
            heap = [(0.0, target)]
            while heap:
                cost, unit = heapq.heappop(heap)
                if cost > best[unit][0]:
                    continue
                _, slope, offset, steps = best[unit]
                for before in self.edges.get(unit, {}):
                    a, b, c = self.edges[before][unit]
                    found = (cost + c, slope * a, slope * b + offset, steps + 1)
                    if before not in best or found[0] < best[before][0] - 1e-12:
                        best[before] = found
                        heapq.heappush(heap, (found[0], before))
            out += [(unit, target, slope, offset, steps) for unit, (_, slope, offset, steps) in sorted(best.items())]
        return out

    def inconsistent(self, tolerance: float = 1e-9) -> list[tuple[str, str, float]]:
        """Edges that disagree with the composition along a tree of cheapest ways: (source, target, relative error).

        Every cycle is made of ways in the tree and further edges, so checking all edges checks all cycles.
        """
        potential: dict[str, tuple[float, float]] = {}
        for root in sorted(self.edges):
            if root not in potential:
                potential |= {unit: (slope, offset) for unit, _, slope, offset, _ in self.compositions([root])}
        bad = []
        for source, target, slope, offset in self.all:
            a, b = potential.get(target, (1.0, 0.0))
            of_source = potential.get(source, (1.0, 0.0))
            composed = (a * slope, a * offset + b)
            error = abs(composed[0] / of_source[0] - 1) + abs(composed[1] - of_source[1]) / max(1.0, abs(composed[1]))
            if error > tolerance:
                bad.append((source, target, error))
        return bad


#: A step between scales of a currency costs next to nothing beside a rate.
SCALE_COST = 1e-6


def money_graph(currencies: Iterable[str] = CURRENCIES) -> ConversionGraph:
    """Scales of each currency. Only neighbours are edges; the rest comes from compositions."""
    g = ConversionGraph()
    for c in currencies:
        chain = sorted(SCALES, key=SCALES.get)
        for low, high in itertools.pairwise(chain):
            g.add(f"{c}|{high}", f"{c}|{low}", 10.0 ** (SCALES[high] - SCALES[low]), cost=SCALE_COST)
    return g


def conversions(spark: SparkSession, graph: ConversionGraph, targets: Iterable[str]) -> DataFrame:
    """The composed table (unit, target, slope, offset, steps); its size is that of the graph, not of the data."""
    if bad := graph.inconsistent():
        raise ValueError(f"conversion cycles that don't close: {bad[:5]}")
    return spark.createDataFrame(graph.compositions(targets), "unit string, target string, slope double, offset double, steps int")


def convert(df: DataFrame, amount: str, unit: str, target: Column, table: DataFrame, into: str) -> DataFrame:
    """df with `into` = the amount in the target unit; null where the graph has no path. The equi-join is on (unit, target)."""
    side = F.broadcast(table.select(F.col("unit").alias("__u"), F.col("target").alias("__t"), F.col("slope").alias("__a"), F.col("offset").alias("__o")))
    joined = df.withColumn("__target", target)
    joined = joined.join(side, (joined[unit] == side["__u"]) & (joined["__target"] == side["__t"]), "left")
    return joined.withColumn(into, F.col(amount).cast("double") * F.col("__a") + F.col("__o")).drop("__u", "__t", "__a", "__o", "__target")


# --- exchange rates -------------------------------------------------------------------------------


def quoted(fx_rates: DataFrame) -> DataFrame:
    """(source, target, slope, as_of_date, loaded_at, rate_id): each rate as an edge between units, as its text quotes it.

    `X/Y`, `X-Y` and `XY` are Y for one X; any other text names a unit, and the rate is USD for one of it. Null rates, unreadable
    currencies, null dates and rates of zero or less are left out; duplicates are merged.
    """
    codes = "|".join(CURRENCIES)
    pair = lambda i: F.regexp_extract(F.upper(_clean(F.col("ccy"))), rf"^({codes}) ?[/\- ]? ?({codes})$", i)
    single = F.concat_ws("|", currency_of(F.col("ccy")), F.coalesce(scale_of(F.col("ccy")), F.lit("1")))
    texts = {"source": lambda: F.when(pair(1) != "", F.concat(pair(1), F.lit("|1"))).when(currency_of(F.col("ccy")).isNotNull(), single), "target": lambda: F.when(pair(1) != "", F.concat(pair(2), F.lit("|1"))).otherwise("USD|1")}
    rates = fx_rates.where("usd_rate > 0 AND as_of_date IS NOT NULL").select("ccy", F.col("usd_rate").cast("double").alias("slope"), "as_of_date", "loaded_at", "rate_id")
    return with_readings(rates, ["ccy"], texts).where("source IS NOT NULL").select("source", "target", "slope", "as_of_date", "loaded_at", "rate_id").distinct()


def quotes(fx_rates: DataFrame) -> DataFrame:
    """The rates against USD as (ccy, usd: USD for one single unit, as_of_date, loaded_at, rate_id), whichever way they are quoted."""
    part = lambda c, i: F.split(c, r"\|")[i]
    power = lambda c: F.coalesce(*[F.when(part(c, 1) == k, F.lit(10.0**p)) for k, p in SCALES.items()])
    q = quoted(fx_rates)
    direct, inverse = F.col("target") == "USD|1", F.col("source") == "USD|1"
    ccy = F.when(direct, part("source", 0)).when(inverse, part("target", 0))
    usd = F.when(direct, F.col("slope") / power("source")).when(inverse, 1 / F.col("slope"))
    return q.select(ccy.alias("ccy"), usd.alias("usd"), "as_of_date", "loaded_at", "rate_id").where("ccy IS NOT NULL").distinct()


def daily_edges(fx_rates: DataFrame, latest: int | None) -> DataFrame:
    """(day, source, target, slope, age, loaded): the rates in force on each day up to a time in microseconds, with their age in days.

    Of the rates of one quotation and date the one loaded last counts; it is in force until the next date of its quotation.
    """
    last = F.max_by(F.struct("slope", "loaded_at"), F.struct("loaded_at", "rate_id"))
    steps = quoted(fx_rates).groupBy("source", "target", "as_of_date").agg(last.alias("r"))
    history = steps.select(F.concat_ws(">", "source", "target").alias("entity"), F.col("as_of_date").cast("timestamp_ntz").alias("valid_from"), F.struct("r.slope", "r.loaded_at", "source", "target", F.unix_date("as_of_date").alias("at")).alias("value"))
    cut = asof.intervals(history, asof.DAY, F.lit(latest if latest is not None else 0))
    return cut.select(F.col("bucket").alias("day"), "value.source", "value.target", "value.slope", (F.col("bucket") - F.col("value.at")).alias("age"), F.unix_micros(F.col("value.loaded_at").cast("timestamp")).alias("loaded"))


def graph_of_day(edges: Iterable[tuple[str, str, float, int, float]]) -> ConversionGraph:
    """The graph of one day's rates (source, target, slope, age, loaded): a fresh rate is a short way, an old one a long one; of two of one
    date the one loaded last is shorter."""
    edges = sorted(edges, key=lambda e: (-e[4] if e[4] == e[4] else math.inf, e[0], e[1]))
    g = money_graph(sorted({u.split("|")[0] for e in edges for u in e[:2]}))
    for rank, (source, target, slope, age, _) in enumerate(edges):
        g.add(source, target, slope, cost=1.0 + age + min(rank, 400) * 1e-3)
    return g


#: Days whose graphs are built in one call.
DAYS = 32


def _each_day(edges: DataFrame, result: Callable[[ConversionGraph], list[tuple]], columns: str, fresh: int | None = None) -> DataFrame:
    """(day, columns) of the result of each day's graph; a call gets DAYS days, a few quotations for each currency and day."""
    names = ["day", *[c.split()[0] for c in columns.split(", ")]]

    def run(pdf):
        import pandas as pd

        days: dict[int, list] = {}
        for day, *edge in pdf[["day", "source", "target", "slope", "age", "loaded"]].itertuples(index=False, name=None):
            if fresh is None or edge[3] <= fresh:
                days.setdefault(day, []).append(tuple(edge))
        return pd.DataFrame([(day, *r) for day, of_day in days.items() for r in result(graph_of_day(of_day))], columns=names)

    return edges.groupBy(F.floor(F.col("day") / DAYS).alias("__days")).applyInPandas(run, f"day bigint, {columns}")


def daily_conversions(fx_rates: DataFrame, latest: int | None, targets: Sequence[str] = ("USD|1",)) -> DataFrame:
    """(day, unit, target, slope, offset, steps): the shortest composition of each unit on each day, from that day's rates."""
    wanted = list(targets)
    return _each_day(daily_edges(fx_rates, latest), lambda g: g.compositions(wanted), "unit string, target string, slope double, offset double, steps int")


def rate_conflicts(fx_rates: DataFrame, latest: int, tolerance: float = 0.02, fresh: int = 0) -> DataFrame:
    """(day, source, target, error): rates of at most `fresh` days that don't close the cycles of their day's graph within the tolerance."""
    return _each_day(daily_edges(fx_rates, latest), lambda g: g.inconsistent(tolerance), "source string, target string, error double", fresh)


def typical_graph(fx_rates: DataFrame) -> ConversionGraph:
    """Scales and the median rate of each quotation over all dates: a row for each quotation reaches the driver."""
    g = money_graph()
    for r in quoted(fx_rates).groupBy("source", "target").agg(F.percentile_approx("slope", 0.5).alias("slope"), F.count("*").alias("n")).orderBy(F.desc("n"), "source", "target").collect():
        g.add(r["source"], r["target"], r["slope"], cost=1.0 + 1.0 / r["n"])
    return g


def rate_histories(q: DataFrame) -> dict[str, DataFrame]:
    """Two independent histories: the rate known at a time, and the final one of its date."""
    return {"known": asof.known_steps(q, "ccy", "as_of_date", "loaded_at", "rate_id"), "final": final_steps(q, "rate_id")}


def final_steps(q: DataFrame, value: str) -> DataFrame:
    """What counts from each date on in the end, with all corrections."""
    last = q.groupBy(F.col("ccy").alias("entity"), F.col("as_of_date").cast("timestamp_ntz").alias("valid_from")).agg(F.max(F.struct(F.col("loaded_at"), F.col("rate_id"), F.col(value).alias("v"))).alias("r"))
    return last.select("entity", "valid_from", F.col("r.v").alias("value"))


def rates_known_late(trades: DataFrame, fx_rates: DataFrame) -> DataFrame:
    """(trade_id, rate_id): trades for which the rate known at trade_ts is not the final one of its date."""
    slim = store.spread(trades.select("trade_id", "trade_ts", "currency").where("trade_ts IS NOT NULL"))
    events = with_readings(slim, ["currency"], {"ccy": lambda: currency_of(F.col("currency"))}).where("ccy IS NOT NULL")
    q = store.materialize(quotes(fx_rates), "quotes")
    both = asof.match(events, "ccy", "trade_ts", rate_histories(q), latest=asof.latest(trades, "trade_ts"))
    return both.where("known IS NOT NULL AND known <> final").select("trade_id", F.col("known").alias("rate_id"))


# --- units of trades ------------------------------------------------------------------------------

#: Hidden scales that amounts may be in where their texts say nothing.
HIDDEN = ("c", "k", "m")


def ticker_steps(snapshots: DataFrame) -> DataFrame:
    """(entity = ticker, valid_from, value = isin): which instrument bears a ticker from when on."""
    tickers = history.build(snapshots, ("ticker",)).where("ticker IS NOT NULL")
    return tickers.groupBy(F.upper("ticker").alias("entity"), F.col("valid_from").cast("timestamp_ntz").alias("valid_from")).agg(F.max("entity").alias("value"))


def instrument_of_ticker(trades: DataFrame, snapshots: DataFrame, latest: int | None = None, days: int = 366) -> DataFrame:
    """trades with isin: the instrument that last took the ticker by exec_time (as-of match)."""
    ticker = F.regexp_replace(F.upper(F.trim(F.col("ticker"))), r"[. ][A-Z]{1,2}$", "")
    rows = trades.withColumn("__ticker", F.regexp_replace(ticker, r"[\s\-_]", ""))
    return asof.match(rows, "__ticker", "exec_time", {"isin": ticker_steps(snapshots)}, bucket_seconds=asof.DAY * days, latest=latest).drop("__ticker")


def stated(rows: DataFrame, ccy: str, source: str) -> DataFrame:
    """rows with unit_ccy and scale as the texts of the row say, the currency text before the source text."""
    return with_readings(rows, [ccy, source], {"unit_ccy": lambda: F.coalesce(currency_of(F.col(ccy)), currency_of(F.col(source))), "scale": lambda: F.coalesce(scale_of(F.col(ccy)), scale_of(F.col(source)))})


def trade_units(feed_a: DataFrame, feed_b: DataFrame, snapshots: DataFrame, fx_rates: DataFrame) -> DataFrame:
    """(feed, row_id, ts, amount, unit_ccy, unit) of every row with an amount and a stated currency.

    The unit is what the texts state. Where they state no scale, the row's unit price, converted to USD by the graph of typical
    rates, is held against the median of its instrument's rows: if a hidden scale explains how far it is off, that is it.
    """
    spark = feed_a.sparkSession
    graph = typical_graph(fx_rates)
    slim_a = store.spread(feed_a.select("trade_id", "trade_ts", "isin", "price", "currency", "source_system").where("price IS NOT NULL"))
    a = stated(slim_a, "currency", "source_system").select(
        F.lit("a").alias("feed"), F.col("trade_id").alias("row_id"), F.col("trade_ts").alias("ts"), F.upper(F.regexp_replace("isin", r"[^A-Za-z0-9]", "")).alias("isin"), F.col("price").cast("double").alias("amount"), F.lit(1.0).alias("pieces"), "unit_ccy", "scale")
    slim = store.spread(feed_b.select("id", "exec_time", "ticker", "qty", "gross_amount", "ccy", "source_system").where("gross_amount IS NOT NULL"))
    named = instrument_of_ticker(slim, snapshots, asof.latest(feed_b, "exec_time"))
    b = stated(named, "ccy", "source_system").select(
        F.lit("b").alias("feed"), F.col("id").alias("row_id"), F.col("exec_time").alias("ts"), "isin", F.col("gross_amount").cast("double").alias("amount"), F.col("qty").cast("double").alias("pieces"), "unit_ccy", "scale")
    rows = store.materialize(a.unionByName(b).where("unit_ccy IS NOT NULL").withColumn("unit", F.concat_ws("|", "unit_ccy", F.coalesce("scale", F.lit("1")))), "trade-units")
    level = F.broadcast(spark.createDataFrame([(u, math.log10(slope)) for u, _, slope, _, _ in graph.compositions(["USD|1"])], "unit string, level double"))  # a row for each unit
    logs = rows.join(level, "unit", "left").withColumn("log_price", F.when((F.col("amount") > 0) & (F.col("pieces") > 0), F.log10(F.col("amount") / F.col("pieces")) + F.col("level")))
    medians = logs.where("isin IS NOT NULL AND log_price IS NOT NULL").groupBy("isin").agg(F.percentile_approx("log_price", 0.5, 1000).alias("median"), F.count("*").alias("n"))
    medians = store.checked_broadcast(store.materialize(medians.where("n > 2").drop("n"), "medians"))
    gap = F.col("log_price") - F.col("median")
    steps = {u.split("|")[1]: math.log10(slope) for u, _, slope, _, _ in money_graph(["USD"]).compositions(["USD|1"])}
    hidden = F.coalesce(*[F.when(F.col("scale").isNull() & (F.abs(gap + steps[k]) < 0.5), F.lit(k)) for k in HIDDEN])
    judged = logs.join(medians, "isin", "left")
    return judged.select("feed", "row_id", "ts", "amount", "unit_ccy", F.when(hidden.isNotNull(), F.concat_ws("|", "unit_ccy", hidden)).otherwise(F.col("unit")).alias("unit"))


def units_found(units: DataFrame, table: DataFrame) -> DataFrame:
    """(feed, row_id, unit_ccy, unit_pow10): rows whose amount isn't in single units, by the slope of their unit's composition to the single unit."""
    side = F.broadcast(table.where("unit <> target").select("unit", F.col("target").alias("__t"), F.round(F.log10("slope")).cast("bigint").alias("unit_pow10")))  # a row for each unit
    done = units.join(side.where(F.split("unit", r"\|")[0] == F.split("__t", r"\|")[0]), "unit")
    return done.select("feed", "row_id", "unit_ccy", "unit_pow10")


def amounts_in_usd(units: DataFrame, fx_rates: DataFrame) -> DataFrame:
    """(feed, row_id, unit, amount_usd) of each record, by the compositions of the day of ts from the final rates."""
    latest = asof.latest(units, "ts")
    table = store.materialize(daily_conversions(fx_rates, latest), "daily-conversions")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp_ntz").cast("timestamp")) / (asof.DAY * 1_000_000))
    side = store.checked_broadcast(table.select(F.col("day").alias("__day"), F.col("unit").alias("__unit"), F.col("slope").alias("__a"), F.col("offset").alias("__b")))
    rows = units.withColumn("__on", day)
    done = rows.join(side, (rows["unit"] == side["__unit"]) & (rows["__on"] == side["__day"]), "left")
    return done.select("feed", "row_id", "unit", F.round((F.col("amount") * F.col("__a") + F.col("__b")).cast("decimal(38,8)"), 2).cast("double").alias("amount_usd"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have the library installed
