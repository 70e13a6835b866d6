import math

from loomline.llm import bpe, mixing

TOKENIZER = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"
DOCS = "doc_id bigint, text string, source string, rate string, copies string"
TARGETS = "source string, target_share double, max_repeats int"


def mix(spark, docs, targets, **kw):
    m, r = mixing.mix(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), spark.createDataFrame(targets, TARGETS), TOKENIZER, **kw)
    return [tuple(x) for x in m.select("doc_id", "source", "copy_no").collect()], {x["source"]: x for x in r.collect()}


def test_rates_caps_and_shares(spark):
    docs = [(i, f"word {'a ' * 20}{i}", " Web-Crawl ") for i in range(400)] + [(1000 + i, f"word {'b ' * 20}{i}", "glossary") for i in range(30)] + [(5000, "same text", "wiki"), (5001, "same text", "glossary"), (5002, "same text", "wiki"), (6000, None, "wiki"), (6001, "", "wiki"), (6002, "alone", None), (6003, "stray", "unknown")]
    rows, report = mix(spark, docs, [("web_crawl", 0.5, 1), ("glossary", 0.4, 4), ("wiki", 0.0, 2), ("nothing", 0.1, 3)])
    assert report["glossary"]["rate"] == 4.0 and report["glossary"]["most_copies"] == 4
    assert report["nothing"]["mixed_tokens"] == 0 and report["wiki"]["mixed_tokens"] == 0
    assert abs(report["web_crawl"]["actual_share"] - 5 / 9) < 0.06
    uses = {}
    for d, s, _ in rows:
        uses[d] = uses.get(d, 0) + 1
    assert max(n for d, n in uses.items() if d < 1000) == 1 and not uses.keys() & {5001, 5002, 6000, 6001, 6002, 6003}
    rate = report["web_crawl"]["rate"]
    assert abs(sum(1 for d in uses if d < 1000) - 400 * rate) < 4 * math.sqrt(400 * rate * (1 - rate)) + 1
    assert rows and sorted(rows) == sorted(mix(spark, docs, [("web_crawl", 0.5, 1), ("glossary", 0.4, 4), ("wiki", 0.0, 2), ("nothing", 0.1, 3)])[0])


def test_asked_total_is_capped(spark):
    rows, report = mix(spark, [(1, "hello there", "a"), (2, "hello world", "b")], [("a", 0.9, 2), ("b", 0.1, 1)], total_tokens=1e9)
    assert sorted(rows) == [(1, "a", 1), (1, "a", 2), (2, "b", 1)]


def test_empty(spark):
    rows, report = mix(spark, [], [("a", 1.0, 2)])
    assert rows == [] and report["a"]["actual_share"] == 0
    assert mix(spark, [(1, "x", "a")], [])[0] == []
    assert mix(spark, [(1, "x", "a")], [("a", None, None)])[0] == []


def test_fraction_is_a_probability(spark):
    docs = [(i, f"t{i}", "a") for i in range(2000)]
    _, report = mix(spark, docs, [("a", 1.0, 3)], total_tokens=0)
    assert report["a"]["mixed_texts"] == 0
    tokens = report["a"]["tokens"]
    rows, report = mix(spark, docs, [("a", 1.0, 3)], total_tokens=tokens * 1.25)
    assert 2000 + 400 < len(rows) < 2000 + 600 and report["a"]["most_copies"] == 2
