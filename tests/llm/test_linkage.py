import base64
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomline import store
from loomline.llm import linkage as L

SCHEMA = "id string, project_id string, filename string, relative_path string, file_hash string, file_size_bytes bigint, created_at timestamp_ntz, path string, digest string, class_id string"
H = "941dfcacaddfefb9b27a1c7a55f4fd6c5ca255ef4a2ca876581c77536fe082a1"
G = "519d4e3716ff4cd73bb989ba190be1864e621e29199934029ab7a08c0c2e85e5"
AT = datetime(2024, 1, 1)


def frame(spark, data):
    """data: (id, project, path, hash, hours)"""
    return spark.createDataFrame([(i, p, path and path.split("/")[-1], path, h, 10, None if at is None else AT + timedelta(hours=at), "x", "y", "z") for i, p, path, h, at in data], SCHEMA)


def found(spark, data, batches=2):
    return sorted(map(tuple, L.repeated(frame(spark, data), batches).collect()))


def one(spark, df, column):
    return df.select(column).first()[0]


def test_digests_and_paths(spark):
    forms = [H, H.upper(), f" {H} ", f"sha256:{H}", f"SHA256={H.upper()}", f"0x{H}", f"{H}\n"]
    df = spark.createDataFrame([(f,) for f in forms], "h string")
    assert {r[0] for r in df.select(L.digest_of(F.col("h"))).collect()} == {H}
    short = spark.createDataFrame([("",), ("zz",), (None,), ("sha256:",), (f"{H[:16]}...",)], "h string")
    assert [r[0] for r in short.select(L.digest_of(F.col("h"))).collect()] == [None, None, None, None, H[:16]]
    same = ["daten/größe/load_rates_1.sql", "Daten\\Größe\\Load_Rates_1.SQL", "/daten//größe/./load-rates-1.sql", "upload/daten/größe/load rates 1.sql", "tmp/extract/daten/größe/load__rates__1.sql", "repo-main/daten/größe/load_rates_1 (1).sql", "daten/größe/load_rates_1_copy.sql", "daten/größe/load_rates_1 - Kopie.sql", "daten/größe/load_rates_1-copy2.sql", "daten/größe/load_rates_1.sql.bak", "daten/größe/load_rates_1.sql~", "daten%2Fgr%C3%B6%C3%9Fe%2Fload%5Frates%5F1.sql", "daten/größe/load_rates_1.sql", "./daten/größe/load_rates_1.sql.orig"]
    df = spark.createDataFrame([(f,) for f in same], "p string")
    assert len({r[0] for r in df.select(L.path_of(F.col("p"), F.lit("f"))).collect()}) == 1
    df = spark.createDataFrame([(None, "a/b.sql"), (" ", "a/b.sql"), (None, None), ("", "")], "p string, f string")
    assert [r[0] for r in df.select(L.path_of(F.col("p"), F.col("f"))).collect()] == ["a/b.sql", "a/b.sql", None, None]


def test_base64_digests(spark):
    plain = base64.b64encode(bytes.fromhex(H)).decode()
    dashed = base64.urlsafe_b64encode(bytes.fromhex(H)).decode()
    assert plain != dashed
    forms = [plain, dashed, plain[:-1], f" {plain}\n", f"sha256:{plain}", f"SHA256-{plain}"]
    df = spark.createDataFrame([(f,) for f in forms], "h string")
    assert [r[0] for r in df.select(L.digest_of(F.col("h"))).collect()] == [H] * len(forms)
    odd = f"0X{plain[2:]}"  # begins like the prefix of hex digits
    whole = [(odd, base64.b64decode(odd).hex()), (H[:43], H[:43]), (H[:44], H[:44]), (f"sha256-{H[:36]}", H[:36]), ("-".join(H[i : i + 2] for i in range(0, 30, 2))[:43], H[:29])]
    df = spark.createDataFrame(whole, "h string, want string")
    assert [r[0] for r in df.select(L.digest_of(F.col("h"))).collect()] == [want for _, want in whole]
    # a twin in either order is a repeat, and another file's digest is none
    data = [("a", "p", "x/load_rates_10.sql", H, 0), ("b", "p", "x/load_rates_10.sql", plain, 1), ("c", "p", "x/load_rates_10.sql", dashed, 2), ("d", "p", "y/other_thing_9.sql", base64.b64encode(bytes.fromhex(G)).decode(), 3), ("e", "p", "y/other_thing_9.sql", G, 4)]
    for batches in (1, 2):
        assert found(spark, data, batches) == [("a", "b"), ("a", "c"), ("d", "e")]


def test_cases_and_non_cases(spark):
    data = [
        ("a", "p", "x/load_rates_10.sql", H, 0), ("b", "p", "x/load_rates_10.sql", H, 1), ("c", "p", "x/laod_rates_10.sql", H[:20], 2), ("d", "p", "upload/x/load_rtes_10.sql", H[:30] + "0" + H[31:], 3),
        ("e", "p", "y/load_rates_10.sql", H, 4),  # another file's path (one slip of a short folder would be too, so the name counts)
        ("f", "p", "x/load_rates_10.sql", G, 5), ("g", "q", "x/load_rates_10.sql", H, 6), ("h", "p", "x/load_rates_11.sql", H, 7),
        ("i", None, "x/load_rates_10.sql", H, 8), ("j", "p", None, H, 9), ("k", "p", "x/load_rates_10.sql", None, 9), ("l", "p", "x/load_rates_10.sql", H, None), (None, "p", "x/load_rates_10.sql", H, 9),
    ]
    got = found(spark, [*data, data[1]])
    assert {p for p in got if "e" not in p} == {("a", "b"), ("a", "c"), ("a", "d")}
    for batches in (1, 3):
        assert found(spark, data, batches) == got


def test_empty(spark):
    assert found(spark, []) == []


def test_hot_content_and_ties(spark):
    # one content under many paths, and one file loaded again and again, a third of the rows at one time
    data = [(f"t{i}", "p", f"dir{i % 26}{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'zyxwvutsrqponmlkjihgfedcba'[i // 26]}q/conftest.py", H, i) for i in range(200)]
    data += [(f"s{i:03}", "p", "main/again.py", G, i // 50) for i in range(150)]
    got = found(spark, data, 2)
    assert {p for p in got if p[0].startswith("s")} == {("s000", f"s{i:03}") for i in range(50, 150)}
    slow = set()
    seen = []
    for i, _, path, _, at in sorted((d for d in data if d[0].startswith("t")), key=lambda d: d[4]):
        first = next((j for j, q in seen if near(path, q)), None)
        if first:
            slow.add((min(first, i), max(first, i)))
        seen.append((i, path))
    assert {p for p in got if p[0].startswith("t")} == slow


def near(a, b):
    """One edit or swap, not in digits."""
    import re

    if re.sub(r"\D", "", a) != re.sub(r"\D", "", b):
        return False
    if a == b:
        return True
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    s, t = sorted((a, b), key=len)
    return len(t) - len(s) == 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def test_brute_force_with_slips(spark):
    rnd = random.Random(2)
    data, n = [], 0
    for k in range(25):
        digest = "".join(rnd.choice("0123456789abcdef") for _ in range(64))
        path = f"{rnd.choice(['quality', 'pricing'])}/{rnd.choice(['load', 'build'])}_{rnd.choice(['rates', 'trades'])}_{k:04}.sql"
        for j in range(rnd.randint(1, 4)):
            h, p = digest, path
            if j and rnd.random() < 0.5:
                i = rnd.randrange(64)
                h = rnd.choice([h[:i] + h[i + 1 :], h[:20], h[:i] + "0" + h[i:], h.upper()])
            if j and rnd.random() < 0.5:
                i = rnd.randrange(2, 12)
                p = p[:i] + p[i + 1 :]
            data.append((f"f{n:03}", "p", p, h, n))
            n += 1
    want, groups = set(), {}
    for i, _, p, h, at in data:
        key = p.split("_")[-1]
        for j, q, g in groups.get(key, []):
            if near(p.replace("_", ""), q.replace("_", "")):
                want.add((j, i))
                break
        groups.setdefault(key, []).append((i, p, h))
    assert set(found(spark, data, 2)) == want


def test_clusters_follow_batches(spark):
    linker = L.Linker(spark, store.fresh_path(spark, "linker"))
    linker.ingest(frame(spark, [("a", "p", "x/load_rates_10.sql", H, 0), ("b", "p", "x/laod_rates_10.sql", H, 1)])).collect()
    linker.ingest(frame(spark, [("c", "p", "x/load_rates_10.sql", H[:20], 2), ("d", "p", "x/other_thing_9.sql", G, 3)])).collect()
    reps = {r["class_id"]: r["representative"] for r in linker.representatives().collect()}
    assert len(reps) == 3 and len(set(reps.values())) == 1


def accepted(counts):
    """Patterns of counts that the weights learned from them accept."""
    weights, least = L.learn(list(counts.items()))
    return {p for p in counts if all(sum(weights[k, f, v] for f, v in enumerate(p)) >= least[k - 1] for k in (1, 2))}


SEEN = {(2, 2, 2): 2700, (2, 1, 2): 320, (1, 2, 2): 230, (1, 1, 2): 52, (2, 0, 2): 100, (1, 0, 2): 4, (0, 1, 2): 3, (0, 2, 2): 3, (0, 2, 0): 900}


def test_weights_at_any_number_of_pairs():
    """What is learned from few pairs or very many, or beside a crowd of other pairs of either kind, accepts the same patterns."""
    for times in (0.01, 1, 100, 10_000):
        for crowd in (0, 1e4, 1e8):
            for kind in ((2, 0, 2), (0, 2, 0)):
                counts = {p: n * times + (crowd if p == kind else 0) for p, n in SEEN.items()}
                assert accepted(counts) == {p for p in SEEN if 0 not in p[:2]}, (times, crowd, kind)
    assert accepted({p: 0 for p in SEEN}) == {p for p in SEEN if 0 not in p[:2]}


def test_weights_follow_the_pairs():
    """A level that certain matches have is worth more than one they don't."""
    weights, _ = L.learn(list(SEEN.items()))
    assert weights[1, 1, 2] > weights[1, 1, 1] > 0 > weights[1, 1, 0] and weights[2, 0, 2] > weights[2, 0, 1] > 0 > weights[2, 0, 0]


def batch_of(spark, n, start, project="p"):
    """n files of their own content, and every third a second time."""
    import hashlib

    data = []
    for i in range(start, start + n):
        h = hashlib.sha256(f"{project}{i // 3 if i % 3 else i}".encode()).hexdigest()
        data.append((f"{project}{i:06}", project, f"x/load_{'abcdefghij'[i % 10]}_{i:06}.sql", h, i))
    return frame(spark, data)


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    """What a small batch opens of the history is the same number of bucket files' rows, however long the history is."""
    read = []
    for k, history in enumerate((300, 1200)):
        linker = L.Linker(spark, f"file://{tmp_path}/{k}", buckets=64, rows_per_bucket=50)
        for at in range(0, history, 300):
            linker.ingest(batch_of(spark, 300, at)).collect()
        manifest = linker.store.manifest()
        batch = linker.rows_of(batch_of(spark, 3, history))
        seen = linker.classes_like(batch)
        rows = 0
        for table, keys in (("classes", batch), ("blocks", linker.blocks_of(seen))):
            found = linker.store.read(manifest, table, linker.store.touched(manifest, table, keys))
            rows += 0 if found is None else found.count()
        read.append(rows)
    assert read[1] < 2 * read[0] + 100, read


def test_only_new_classes_are_written(spark, tmp_path):
    linker = L.Linker(spark, f"file://{tmp_path}/l")
    files = batch_of(spark, 30, 0)
    linker.ingest(files).collect()
    before = linker.store.manifest()["tables"]
    linker.ingest(files).collect()
    after = linker.store.manifest()
    assert [g["rows"] for g in after["tables"]["classes"]["generations"]] == [g["rows"] for g in before["classes"]["generations"]]
    assert after["more"]["weights"] and after["version"] == 2


def test_learned_counts_dont_depend_on_the_size_of_compared_blocks(spark, tmp_path, monkeypatch):
    data = [(f"t{i}", "p", f"dir{i % 26}{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'zyxwvutsrqponmlkjihgfedcba'[i // 26]}q/conftest.py", H, i) for i in range(60)]
    counts = []
    for k, small in enumerate((8, 1000)):
        monkeypatch.setattr(L, "SMALL", small)
        linker = L.Linker(spark, f"file://{tmp_path}/{k}")
        linker.ingest(frame(spark, data)).collect()
        counts.append(dict(linker.patterns))
    many = [sum(n for p, n in c.items() if p[1] == 0) for c in counts]
    assert abs(many[0] - many[1]) <= 0.05 * many[1] and {p: n for p, n in counts[0].items() if p[1]} == {p: n for p, n in counts[1].items() if p[1]}
