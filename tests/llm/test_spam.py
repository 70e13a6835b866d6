from loomline.llm import spam

COLUMNS = "doc_id bigint, text string, source string, project_id string"

PROSE = "The pricing desk asked for the mapping of the late files. Before the close, two procedures write to raw_market.fx_daily, and only one of them is documented. "
CASES = {
    "keywords": ", ".join(f"{w} {x}" for w in ("cheap", "best", "buy", "online") for x in ("broker app", "loan guide", "tax tool", "fx feed")),
    "lines": "\n".join(f"Account Dashboard in {x}" for x in ("Mori", "Kano", "Lisb", "Tova", "Rude", "Sela", "Nopu", "Drama", "Pufa", "Bork", "Zara")),
    "links": " | ".join(f"http://shop{i}.example/page loan list" for i in range(12)),
    "anchors": " ".join(f'<a href="http://s{i}.test/x">broker guide</a>' for i in range(12)),
    "hidden links": "\n".join(f"hxxps://www[.]shop{i}[.]invalid/x loan list" for i in range(12)),
    "list items": "<ul>" + "".join(f"<li>best <b>broker app {i}</b></li>" for i in range(12)) + "</ul>",
    "said shortly": " ".join(f"{a} broker {b}" for a in ("Best", "Cheap", "Buy", "Free") for b in ("app!", "guide?", "tool.")),
    "mostly": PROSE + "\n" + ", ".join(["broker app", "tax tool", "loan guide"] * 20),
}
CLEAN = {
    "prose": PROSE * 4, "tags at the end": PROSE * 4 + "\nTags: broker, tax, loan, fx, feed, gold, app, tool, list, guide, cash", "references": PROSE * 3 + "".join(f"\n- The backlog contradicts the checksum in both zones. http://docs{i}.example/x" for i in range(12)),
    "code": "CREATE TABLE a.b (\n    c BIGINT,\n    d DATE\n);\nSELECT c, d\nFROM a.b\nWHERE c IS NOT NULL;", "log": "\n".join(f"2024-01-{d:02} 10:00 INFO load_positions - done" for d in range(1, 20)), "table": "\n".join("| 1 | 2 | 3 | 4 |" for _ in range(20)),
    "contents": "Contents\n" + "\n".join(f"{i}. How nav_roll fills raw_market.lot_match ..... {i * 3}" for i in range(1, 15)), "columns": "\n".join(f"- col_{c}" for c in "abcdefghijklmnop"), "tables": ", ".join(f"raw_market.t_{c}" for c in "abcdefghijklmnop"),
    "japanese": "担当者がlot_idの照合を終えました。為替は金曜日の値を使います。" * 5, "russian": "Столбец price_ccy остался пустым. Сверка run_seq завершена вчера. " * 5, "empty": "", "blank": " \n ", "short": "TODO", "null": None,
}

RUNS = {
    "blanks": "kurs daten " * 20,
    "blanks and fillers": "hedge robot free HEDGE ROBOT now hedge robots top side discount hedge robot side side new hedgerobot hedge robot side online " * 3,
    "ended": PROSE + "\n" + "tax alert venti cash account mapping tax alert venti cash " * 10 + "tax alert.",
    "slashes": " / ".join(["stock converter", "tax formatter", "portfolio export", "cheap tax formatter"] * 5),
}
VARIED = {
    "said twice": "El turno de noche quiere saber qué script cambió file_hash, porque el turno de noche lo pidió. " * 5,
    "without marks": " ".join(f"then the desk{i} moved row{i} to the zone{i} and the check{i} of it came back late" for i in range(30)),
    "paths": PROSE + "The split is 3/4 to 1/4 and either/or, see reports/daily/fx for it. " * 3,
}


TAGS = {
    "tags": "#CheapSnapshotConverter #theFxWidget #FreeSnapshotConverter #CatalogueDonnées " * 6,
    "tags on lines": "\n".join(f"#FxWidget{x} #theLoan{x}" for x in ("Top", "Best", "Buy", "New", "Free", "Pro", "Now")),
    "tags run together": PROSE + "\n" + "#FxWidget#BestLoan#TaxTool " * 12,
    "tags after a word": "Follow " + "#FxWidget, #BestLoan, " * 12,
    "from": "\n".join(f"From {x} loan guide, create broker app, best tax tool, import fx feed" for x in ("cheap", "top", "free", "new")),
    "create": "Create cheap account, where best broker app, select online loan guide, " * 5,
}
CODED = {
    "comments": "\n".join(f"# load the rates of day {i} and the trades" for i in range(12)),
    "includes": "\n".join(f"#include <fx_{i}.h>\n#ifdef FX\n#endif" for i in range(12)),
    "select lists": "\n".join(f"select isin, price, ccy, side\nfrom trades t\nwhere side is null\ngroup by isin, side\nimport os, sys\nreturn x{i}" for i in range(6)),
    "statements": "\n".join(f"create or replace view v{i} as\nselect a.isin, b.rate\nfrom raw_market.t_{i}\nwhere x = 'new loan', 'cheap loan'" for i in range(6)),
    "tags at the end": PROSE * 4 + "\n#FxWidget #BestLoan #TaxTool #NavList #GoldFeed #CashApp #LotMatch #SideBook #TradeTs #LoadId",
}

#: Pages of words that lists of other pages have too; each is judged beside LISTS, which stand on three hosts.
LISTS = [f"{a} broker app, {b} loan guide, {a} tax tool, {b} fx feed, {a} gold login, {b} app shop" for a in ("cheap", "best", "top", "free") for b in ("online", "new", "buy")]
STITCHED = {
    "one sentence over and over": "Buy the cheap broker app of the best loan guide and a free tax tool with new fx feed today. " * 15,
    "no separators": "cheap broker app online loan guide best tax tool new fx feed top gold login free broker app buy loan guide",
    "no blanks": "cheap broker app,online loan guide,best tax tool,new fx feed,top gold login,free broker app,buy loan guide,cheap fx feed",
    "own-looking tags": "\n".join(["broker_app", "loan_guide", "tax_tool", "fx_feed", "gold_login", "app_shop"]),
    "half prose": PROSE + "\n" + "cheap broker app online loan guide best tax tool new fx feed top gold login free broker app buy loan guide cheap tax tool. " * 2 + PROSE[:80],
    "assignments": "\n".join(f"brand = {a} broker app {b} loan guide {a} tax tool" for a in ("cheap", "best") for b in ("online", "new", "buy")),
    "imports": "\n".join(f"Import {a} broker app, select {b} loan guide, create {a} tax tool" for a in ("cheap", "best") for b in ("online", "new", "buy")),
    "links between keywords": " ".join(f"cheap broker app http://shop{i}.example/a best loan guide" for i in range(8)),
}
EXPLAINED = {
    "links that sentences explain": "\n".join(f"The desk keeps the mapping of the late files of day {i} under http://docs{i}.example/x and checks it." for i in range(8)),
    "prose that names a product": PROSE * 2 + "The vendor offers a free broker app and a tax tool for the audit office of the group.",
    "own columns": "\n".join(f"- {c}" for c in ("account_code", "book_id", "fee_bps", "load_id", "lot_id", "price_ccy", "run_seq", "side", "ticker", "trade_ts")),
    "short sentences": "The night shift left. Nobody objected. It ran twice. She asked again. The check stays. Rates moved. " * 3,
}


def corpus(*parts):
    texts = [t for p in parts for t in p]
    return [(i, t, "web", f"p{i % 3}" if i % 4 else None) for i, t in enumerate(texts)]


def flagged(spark, rows, more=""):
    return sorted(r["doc_id"] for r in spam.pages(spark.createDataFrame(rows, COLUMNS + more)).where("flagged").select("doc_id").distinct().collect())


def test_pages_are_told_apart(spark):
    bad = [*CASES.values(), *RUNS.values(), *TAGS.values(), *STITCHED.values(), *LISTS]
    good = [*CLEAN.values(), *VARIED.values(), *CODED.values(), *EXPLAINED.values()]
    rows = corpus(bad, good)
    got = flagged(spark, rows)
    names = [*CASES, *RUNS, *TAGS, *STITCHED, *range(len(LISTS)), *CLEAN, *VARIED, *CODED, *EXPLAINED]
    assert [names[i] for i in range(len(bad)) if i not in got] == []
    assert [names[i] for i in got if i >= len(bad)] == []


def test_stitched_pages_need_the_phrases_of_others(spark):
    """Alone on their host, these pages look like sentences, code or own names; the lists of other hosts tell what they are."""
    for name in ("no separators", "own-looking tags", "assignments"):
        text = STITCHED[name]
        alone = flagged(spark, [(1, text, "web", "p1")])
        beside = flagged(spark, [(1, text, "web", "p1"), *((i + 2, t, "web", f"p{i % 3}") for i, t in enumerate(LISTS))])
        assert alone == [] and 1 in beside, name


def test_defined_cases(spark):
    spam_text = CASES["keywords"]
    rows = [(None, spam_text, None, None, "x", 1), (None, PROSE, None, None, "x", 1), (5, spam_text, None, "p", "x", 1), (5, PROSE, None, "p", "x", 1), (6, "cheap broker, " * 30_000, "web", "p", "x", 1), (7, None, None, None, "x", 1), (8, "", None, None, "x", 1), (9, "cheap, best", None, None, "x", 1)]
    df = spark.createDataFrame([*rows, rows[2]], COLUMNS + ", phrase string, support int")
    got = [r["doc_id"] for r in spam.pages(df).where("flagged").collect()]
    assert sorted(x for x in got if x is not None) == [5, 6] and got.count(None) == 1
    assert spam.pages(df.limit(0)).collect() == []


def test_repeated_rows_count_once(spark):
    rows = [(1, "cheap, best", "web", "p")] * 9
    assert flagged(spark, rows) == []


def test_phrases_count_hosts(spark):
    """Two hosts' lists make a phrase stuffed, one host's never, and prose that has it more often takes it back."""
    listed, prose = "broker app, tax tool", "The broker app of the desk writes the mapping of late files again."
    phrases = lambda rows: {r["n"] for r in spam.stuffed(spam.evidence(spark.createDataFrame(rows, COLUMNS))).collect()}
    assert phrases([(1, listed, "s", "a"), (2, listed, "s", "a")]) == set()
    assert phrases([(1, listed, "s", "a"), (2, listed, "s", "b")]) == {2}
    with_prose = [(1, "broker app", "s", "a"), (2, "broker app", "s", "b"), *((i, prose, "s", "c") for i in range(3, 5))]
    assert phrases(with_prose) == set()


def test_rare_and_common_phrases_by_either_way(spark, monkeypatch):
    rows = corpus([*STITCHED.values(), *LISTS], CLEAN.values())
    want = flagged(spark, rows)
    monkeypatch.setattr(spam, "HEAVY", 0.01)
    monkeypatch.setattr(spam.store, "is_small", lambda *a, **k: False)
    assert flagged(spark, rows) == want
