"""New file batches against all history: incremental record linkage.

Files with one project, digest and canonical path form a *class*; only classes are compared. Persisted tables, filed by
key (`sources.keyed`), hold the classes, their blocking keys with what is compared, the links between classes, and the
clusters. A batch reads the buckets its own keys fall into: the classes it names, the blocks its new classes are in, the
links and clusters they touch. It writes new classes only, and all of a batch is published in one step.

Candidate pairs are scored by learned weights (Fellegi-Sunter log odds of the agreement levels of content, path and size).
They are fitted to the agreement patterns of all pairs seen so far, whose counts are kept with the tables: exact repeats
are matches for certain, pairs without agreement of content or path are none, and expectation-maximisation shares out those
between. Pairs that are no matches are of two kinds (another path, other content), and a pair is accepted if its scores against
both reach the thresholds learned with the weights, the odds of their numbers. Accepted links update the representatives of the clusters they touch (union-find as label propagation over those
clusters' roots alone, never on the driver).

Blocking: the head, the tail and two middles of the digest within a project. A block of up to SMALL classes is compared
as it is. A larger one (one content under a thousand paths) is blocked further by the path and the path
without each one of its characters, which loses no pair that differs by a single slip, so there is no cap; the pairs
left out differ in path, and are counted for the weights by group sizes, so what is learned doesn't depend on SMALL.

Same content: equal digests, one the head of the other (at least 8 digits), or at most two edits apart. Same
file: canonical paths equal or one slip (an edit or a swap of neighbours, not in digits) apart.

Defined cases: rows without id, project, created_at, path or digest (fewer than 8 hex digits) have no case;
rows with one id are one record; a row is paired with the earliest class it repeats, and only with an
earlier created_at; ties of created_at go by id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..sources import keyed

SMALL = 32
PIECE = 12
#: Folders and repository names that deliveries put before a path.
DELIVERY = r"^(?:/|\./|(?:upload|raw_source|tmp|temp|extract|extracted|unzipped|downloads?)/|[^/]+-(?:main|master)/)+"
#: Endings of backups, and marks of copies before the extension.
BACKUP = r"(?:\.(?:bak|orig|old|tmp|backup|save|swp)|~)+$"
COPY = r"(?:[ _\-]*\(\d+\)|[ _\-]+(?:copy|kopie|copia|copie|kopia)[ _\-]*\(?\d*\)?)+(?=(?:\.[a-z0-9]+)?$)"
COPY_OF = r"(^|/)(?:copy of|kopie von|copia de|copie de) "
ACCENTS = ("àáâãäåāçćčèéêëēęìíîïīñńòóôõöøōùúûüūýÿžźżšśł", "aaaaaaaccceeeeeeiiiiinnooooooouuuuuyyzzzssl")
#: A whole SHA-256 in base64 (url-safe too): 43 characters, not all of them hex digits, and perhaps padding.
BASE64 = r"^\s*(?:[sS][hH][aA][-_ ]?256(?:[:=\s]+|-))?+(?=[0-9a-fA-F-]*[G-Zg-z+/_])([A-Za-z0-9+/_-]{43})=?\s*$"
#: Pairs (content, path, size) that are counted as seen beforehand, so that the first small batches have weights: matches, pairs of
#: another path and pairs of other content.
EXPECTED = (
    {(2, 2, 2): 20.0, (2, 2, 1): 1.0, (2, 2, 0): 1.0, (1, 2, 2): 4.0, (2, 1, 2): 4.0, (1, 1, 2): 1.0},
    {(2, 0, 2): 20.0, (2, 0, 1): 1.0, (2, 0, 0): 1.0, (1, 0, 2): 1.0, (0, 0, 0): 4.0},
    {(0, 2, 0): 20.0, (0, 2, 1): 1.0, (0, 2, 2): 1.0, (0, 1, 0): 1.0},
)
#: What every level has been seen besides.
LEAST = 0.001


def digest_of(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^\s*(?:sha[-_ ]?256|0x)[:=\s]*", "")
    coded = F.regexp_extract(c, BASE64, 1)
    decoded = F.lower(F.hex(F.unbase64(F.concat(F.translate(coded, "-_", "+/"), F.lit("=")))))
    digits = F.when(coded != "", decoded).otherwise(F.regexp_replace(bare, "[^0-9a-f]", ""))
    return F.when(F.length(digits) >= 8, digits)


def path_of(relative_path: Column, filename: Column) -> Column:
    """The path without traces of writing, copying and delivery."""
    raw = F.coalesce(F.when(F.trim(relative_path) != "", relative_path), filename)
    p = F.when(raw.contains("%"), F.coalesce(F.try_url_decode(raw), raw)).otherwise(raw)
    p = F.regexp_replace(F.translate(F.lower(p), *ACCENTS), r"\p{M}+", "")
    p = F.regexp_replace(F.translate(F.trim(p), "\\", "/"), r"^[a-z]:", "")
    p = F.regexp_replace(F.regexp_replace(p, r"/(?:\s*\.?/)+", "/"), DELIVERY, "")
    p = F.regexp_replace(F.regexp_replace(F.trim(p), BACKUP, ""), COPY, "")
    p = F.regexp_replace(F.regexp_replace(p, COPY_OF, "$1"), r"[^\p{L}\p{N}./]+", "")
    return F.when(p != "", p)


def _swap(a: Column, b: Column) -> Column:
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    one, two = F.try_element_at(at, F.lit(1)), F.try_element_at(at, F.lit(2))
    crossed = (F.substring(a, one, F.lit(1)) == F.substring(b, two, F.lit(1))) & (F.substring(a, two, F.lit(1)) == F.substring(b, one, F.lit(1)))
    return (F.length(a) == F.length(b)) & (F.size(at) == 2) & (two == one + 1) & crossed


def content_level(a: Column, b: Column) -> Column:
    """2 equal, 1 incomplete or slightly wrong, 0 other."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    head = F.substring(long, F.lit(1), F.length(short))
    near = F.levenshtein(a, b, 2) >= 0
    return F.when(a == b, 2).when((head == short) | near | ((F.length(short) < 56) & (F.levenshtein(short, head, 2) >= 0)), 1).otherwise(0)


def path_level(a: Column, b: Column) -> Column:
    """2 equal, 1 one slip apart, 0 other."""
    numbers = F.regexp_replace(a, r"\D+", "") == F.regexp_replace(b, r"\D+", "")
    slip = numbers & (F.least(F.length(a), F.length(b)) >= 6) & ((F.levenshtein(a, b, 1) >= 0) | _swap(a, b))
    return F.when(a == b, 2).when(slip, 1).otherwise(0)


FIELDS = ("content", "path", "size")


def certain(pattern: tuple[int, ...]) -> tuple[float, float, float] | None:
    """How much of a pattern's pairs are matches, pairs of another path and of other content, where that is certain."""
    content, path = pattern[:2]
    return (0.0, 1.0, 0.0) if path == 0 else (0.0, 0.0, 1.0) if content == 0 else (1.0, 0.0, 0.0) if (content, path) == (2, 2) else None


def learn(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 20) -> tuple[dict[tuple[int, int, int], float], tuple[float, float]]:
    """((kind of other pair, field, level) -> log2 odds of a match, least score against each kind), by EM over the counts of all patterns.

    patterns has one entry for each combination of levels, a few dozen whatever the data. Pairs that are no matches are of two
    kinds, same content under another path and same path with other content, whose levels have nothing in common; a match must
    win against both. The threshold is where a pair is as likely a match as of that kind: the log2 odds of their numbers.
    """
    kinds, fields = range(3), range(len(FIELDS))
    # those between begin as matches by how much they agree
    likely = {p: certain(p) or (sum(p) / 6, (1 - sum(p) / 6) / 2, (1 - sum(p) / 6) / 2) for p, _ in patterns}
    for _ in range(rounds):
        seen = [{(f, v): LEAST for f in fields for v in (0, 1, 2)} for _ in kinds]
        for k in kinds:
            for p, n in [*EXPECTED[k].items(), *((p, n * likely[p][k]) for p, n in patterns)]:
                for f in fields:
                    seen[k][f, p[f]] += n
        totals = [sum(seen[k][0, v] for v in (0, 1, 2)) for k in kinds]
        chance = [{key: n / totals[k] for key, n in seen[k].items()} for k in kinds]
        for p in likely:
            if certain(p) is None:
                odds = [totals[k] * math.prod(chance[k][f, p[f]] for f in fields) for k in kinds]
                likely[p] = tuple(o / sum(odds) for o in odds)
    weights = {(k, *key): math.log2(chance[0][key] / chance[k][key]) for k in (1, 2) for key in chance[k]}
    return weights, (math.log2(totals[1] / totals[0]), math.log2(totals[2] / totals[0]))


def accepts(weights: dict[tuple[int, int, int], float], least: tuple[float, float]) -> Column:
    """Whether a pair's score, the sum of the weights of its levels, reaches the threshold against both kinds of other pairs."""
    scores = []
    for k in (1, 2):
        total = F.lit(0.0)
        for f, name in enumerate(FIELDS):
            for v in (0, 1, 2):
                total = total + F.when(F.col(name) == v, F.lit(weights[k, f, v])).otherwise(F.lit(0.0))
        scores.append(total >= least[k - 1])
    return scores[0] & scores[1]


def size_level(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), 1).when(a == b, 2).otherwise(0)


class Linker:
    """Persisted classes, blocking keys, links and clusters, and the ingestion of batches."""

    KEYS = {"classes": ("class_id",), "blocks": ("block",), "links": ("class_id",), "clusters": ("class_id",), "members": ("representative",)}

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, rows_per_bucket: int = 1_000_000):
        self.spark, self.store = spark, keyed.KeyedStore(spark, path, self.KEYS, buckets, rows_per_bucket)

    @staticmethod
    def rows_of(files: DataFrame) -> DataFrame:
        """(id, created_at, project_id, digest, path, size, class_id) of each record that can have a case.

        Rows without a case leave with the generator: a filter on what was read would be pushed below and read it twice.
        """
        there = files.where("id IS NOT NULL AND created_at IS NOT NULL AND project_id IS NOT NULL AND file_hash IS NOT NULL")
        read = F.struct(digest_of(F.col("file_hash")).alias("digest"), path_of(F.col("relative_path"), F.col("filename")).alias("path"))
        kept = F.explode(F.filter(F.array(read), lambda r: r["digest"].isNotNull() & r["path"].isNotNull()))
        rows = there.select("id", "created_at", "project_id", F.col("file_size_bytes").alias("size"), kept.alias("r")).select("id", "created_at", "project_id", "r.digest", "r.path", "size")
        return rows.withColumn("class_id", F.xxhash64("project_id", "digest", "path"))

    @staticmethod
    def classes_like(rows: DataFrame) -> DataFrame:
        """(class_id, project_id, digest, path, first, size, most, n) of the rows' classes: the first record, least and greatest size, rows."""
        return rows.groupBy("class_id", "project_id", "digest", "path").agg(F.min(F.struct("created_at", "id")).alias("first"), F.min("size").alias("size"), F.max("size").alias("most"), F.count("*").alias("n"))

    @staticmethod
    def blocks_of(classes: DataFrame) -> DataFrame:
        """(block, class_id, digest, path, size, head): the blocking keys of each class, with what is compared."""
        head = F.xxhash64("project_id", F.lit("head"), F.substring("digest", 1, PIECE))
        tail = F.when(F.length("digest") >= 48, F.xxhash64("project_id", F.lit("tail"), F.substring(F.col("digest"), -PIECE, PIECE)))
        # two slips leave the head, the tail or one of the middles as it was
        middle = F.when(F.length("digest") >= 48, F.xxhash64("project_id", F.lit("middle"), F.substring("digest", 27, PIECE)))
        from_end = F.when(F.length("digest") >= 48, F.xxhash64("project_id", F.lit("from end"), F.substring(F.col("digest"), -38, PIECE)))
        # a digest cut to fewer digits than PIECE meets all that begin like it
        short = F.xxhash64("project_id", F.lit("short"), F.substring("digest", 1, 8))
        keys = F.filter(F.array(head, tail, middle, from_end, short), lambda k: k.isNotNull())
        return classes.select(F.posexplode(keys).alias("kind", "block"), "class_id", "digest", "path", "size").select("block", "class_id", "digest", "path", "size", (F.col("kind") == 0).alias("head"))

    def _compared(self, blocks: DataFrame) -> tuple[DataFrame, list[tuple[tuple[int, ...], int]]]:
        """((a, b, content, path, size) of the candidate pairs with a new class, counts of the pairs left out by pattern).

        blocks: rows of blocks_of with `new`; old classes meet new ones only.
        """
        sizes = blocks.groupBy("block").agg(F.count("*").alias("n"), F.max("new").alias("any")).where("n > 1 AND any").select("block", "n")
        sized = store.materialize(blocks.join(sizes, "block"), "link-blocks")
        side = lambda df, p: df.select("key", F.struct("class_id", "digest", "path", "size", "new").alias(p))

        def paired(keyed_rows: DataFrame) -> DataFrame:
            new, every = side(keyed_rows.where("new"), "x"), side(keyed_rows, "y")
            # of two new classes the smaller meets the larger
            met = new.join(every, "key").where("x.class_id <> y.class_id AND (NOT y.new OR x.class_id < y.class_id)")
            a, b = F.least("x.class_id", "y.class_id"), F.greatest("x.class_id", "y.class_id")
            content, path, size = content_level(F.col("x.digest"), F.col("y.digest")), path_level(F.col("x.path"), F.col("y.path")), size_level(F.col("x.size"), F.col("y.size"))
            return met.select(a.alias("a"), b.alias("b"), content.alias("content"), path.alias("path"), size.alias("size"))

        pairs = paired(sized.where(f"n <= {SMALL}").withColumn("key", F.col("block")))
        crowded = sized.where(f"n > {SMALL}")
        left_out = self._left_out(crowded)
        if left_out:  # there are crowded blocks
            n = F.length("path")
            cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.col("block"), F.concat(F.substring(F.col("path"), F.lit(1), i - 1), F.substring(F.col("path"), i + 1, n))))
            variants = F.array_distinct(F.concat(F.array(F.xxhash64("block", "path")), cut))
            pairs = pairs.unionByName(paired(crowded.withColumn("key", F.explode(variants))))
        return store.materialize(pairs.distinct(), "link-compared"), left_out

    @staticmethod
    def _left_out(crowded: DataFrame) -> list[tuple[tuple[int, ...], int]]:
        """Counts by pattern of all pairs with a new class in crowded head blocks, as pairs of different paths (nearly all are)."""
        pairs = lambda n, k: n * (n - 1) / 2 - (n - k) * (n - k - 1) / 2  # noqa: E731 - of n classes, k of them new
        alike = crowded.where("head").groupBy("block", "digest", "size").agg(F.count("*").alias("n"), F.sum(F.col("new").cast("int")).alias("k"))
        same = alike.groupBy("block", "digest").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(pairs(F.col("n"), F.col("k"))).alias("equal"))
        whole = same.groupBy("block").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("equal").alias("equal"), F.sum(pairs(F.col("n"), F.col("k"))).alias("same"))
        equal, same_digest, every = whole.agg(F.sum("equal"), F.sum("same"), F.sum(pairs(F.col("n"), F.col("k")))).first()
        return [] if every is None else [((2, 0, 2), int(equal)), ((2, 0, 0), int(same_digest - equal)), ((1, 0, 0), int(every - same_digest))]

    def ingest(self, files: DataFrame) -> DataFrame:
        """(id_1, id_2): the batch's records that repeat an accepted one (or one of the batch), with the earliest."""
        manifest = self.store.manifest()
        rows = store.materialize(self.rows_of(files), "link-rows")
        known = self.store.near(manifest, "classes", rows.select("class_id"))
        seen = self.classes_like(rows)
        if known is not None:
            before = known.groupBy("class_id").agg(F.min("first").alias("before"))
            seen = seen.join(before, "class_id", "left")
        else:
            seen = seen.withColumn("before", F.lit(None).cast(seen.schema["first"].dataType))
        seen = store.materialize(seen, "link-seen")
        fresh = seen.where("before IS NULL")
        self.store.write(manifest, "classes", seen.where("before IS NULL OR first < before").select("class_id", "first"))
        blocks = self.store.write(manifest, "blocks", self.blocks_of(fresh))
        old = self.store.near(self.store.manifest(), "blocks", blocks)
        probed = blocks.withColumn("new", F.lit(True))
        probed = probed if old is None else probed.unionByName(old.withColumn("new", F.lit(False)))
        compared, left_out = self._compared(probed)
        self._learn(manifest, seen, compared, left_out)
        accepted = compared.where(accepts(self.weights, self.least_score))
        links = self.store.write(manifest, "links", accepted.select(F.col("a").alias("class_id"), F.col("b").alias("other")).unionByName(accepted.select(F.col("b").alias("class_id"), F.col("a").alias("other"))))
        if any(n for p, n in self.patterns if p[0] and p[1] and p[:2] != (2, 2)):  # there may be links
            self._unite(manifest, links)
        hits = self._hits(manifest, rows, seen, links)
        self.store.publish(self.store.tidy(manifest))
        return hits

    def _learn(self, manifest: dict, seen: DataFrame, compared: DataFrame, left_out: list[tuple[tuple[int, ...], int]]) -> None:
        """Add the batch's pattern counts (at most 27) to those kept, and fit weights and threshold to all of them."""
        counts = {tuple(p): n for p, n in manifest["more"].get("patterns", [])}
        near = {tuple(r[f] for f in FIELDS): r["n"] for r in compared.groupBy(*FIELDS).agg(F.count("*").alias("n")).collect()}
        repeats = seen.where("n > 1 OR before IS NOT NULL").groupBy(size_level(F.col("size"), F.col("most")).alias("size")).agg(F.sum(F.col("n") - F.when(F.col("before").isNull(), 1).otherwise(0)).alias("n"))
        exact = {(2, 2, r["size"]): r["n"] for r in repeats.collect()}
        for p, n in [*near.items(), *exact.items(), *left_out]:
            counts[p] = counts.get(p, 0) + n
        self.patterns = sorted((p, n) for p, n in counts.items() if n > 0)
        self.weights, self.least_score = learn(self.patterns)
        manifest["more"] = {"patterns": [[list(p), n] for p, n in self.patterns], "weights": [[*key, w] for key, w in sorted(self.weights.items())], "least_score": list(self.least_score)}

    def _hits(self, manifest: dict, rows: DataFrame, seen: DataFrame, links: DataFrame) -> DataFrame:
        now = seen.select("class_id", F.least("first", F.coalesce("before", "first")).alias("first"))
        mine = seen.select("class_id")
        sides = links.join(mine, "class_id", "left_semi").select("class_id", "other")
        earlier = self.store.near(self.store.manifest(), "links", mine)
        if earlier is not None:
            sides = sides.unionByName(earlier.select("class_id", "other"))
        sides = store.materialize(sides.distinct(), "link-sides")
        firsts = now
        classes = self.store.near(self.store.manifest(), "classes", sides.select(F.col("other").alias("class_id")))
        if classes is not None:
            firsts = firsts.unionByName(classes.select("class_id", "first"))
        firsts = firsts.groupBy("class_id").agg(F.min("first").alias("first"))
        linked = sides.join(firsts.withColumnRenamed("class_id", "other"), "other").select("class_id", "first")
        best = linked.unionByName(now).groupBy("class_id").agg(F.min("first").alias("first"))
        hits = rows.join(best, "class_id").where(F.col("first.created_at") < F.col("created_at"))
        return store.materialize(hits.select(F.least("id", F.col("first.id")).alias("id_1"), F.greatest("id", F.col("first.id")).alias("id_2")).distinct(), "link-hits")

    def representatives(self) -> DataFrame | None:
        """(class_id, representative) of every class in a cluster of more than one; the newest entry counts."""
        return self._newest(self.store.read(self.store.manifest(), "clusters"))

    @staticmethod
    def _newest(clusters: DataFrame | None) -> DataFrame | None:
        return None if clusters is None else clusters.groupBy("class_id").agg(F.max_by("representative", "version").alias("representative"))

    def _unite(self, manifest: dict, links: DataFrame) -> None:
        """Union the clusters that new links touch: the labels of their roots alone are propagated, then given to their members."""
        published = self.store.manifest()
        near = self._newest(self.store.near(published, "clusters", links))
        pairs = links.where("class_id < other")
        if near is None:
            arcs = pairs.select(F.col("class_id").alias("u"), F.col("other").alias("v"))
        else:
            root = lambda df, c, into: df.join(near.select(F.col("class_id").alias(c), F.col("representative").alias("__r")), c, "left").withColumn(into, F.coalesce("__r", c)).drop("__r")
            arcs = root(root(pairs, "class_id", "u"), "other", "v").select("u", "v")
        arcs = store.materialize(arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "link-arcs")
        labels = store.materialize(arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "link-labels")
        while True:
            least = arcs.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("least"))
            moved = labels.join(least, "u", "left").select("u", F.least("label", F.coalesce("least", "label")).alias("label"), (F.col("least") < F.col("label")).alias("moved"))
            # pointer jumping: take the label of the label
            jumped = moved.join(moved.select(F.col("u").alias("label"), F.col("label").alias("far")), "label", "left").select("u", F.least("label", F.coalesce("far", "label")).alias("label"), "moved")
            step = store.materialize(jumped, "link-labels")
            if not step.where("moved").limit(1).count():
                break
            labels = step.drop("moved")
        roots = labels.select(F.col("u").alias("representative"), F.col("label").alias("after"))
        members = roots.select(F.col("representative").alias("class_id"), "after")
        old = self.store.near(published, "members", roots)
        if old is not None:
            members = members.unionByName(old.join(roots, "representative").select("class_id", "after")).distinct()
        version = published["version"] + 1
        update = store.materialize(members.select("class_id", F.col("after").alias("representative")), "link-members")
        self.store.write(manifest, "clusters", update.withColumn("version", F.lit(version)))
        self.store.write(manifest, "members", update)


def repeated(files: DataFrame, batches: int = 2, buckets: int = 16) -> DataFrame:
    """All repeats of a table, taken in as batches in the order of created_at."""
    spark = files.sparkSession
    linker = Linker(spark, store.fresh_path(spark, "linker"), buckets)
    slim = files.select("id", "project_id", "filename", "relative_path", "file_hash", "file_size_bytes", "created_at")
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    cuts = slim.agg(F.percentile_approx(at, [k / batches for k in range(1, batches)], 1000).alias("c")).first()["c"] or []
    out = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = slim.where((at > low) if low is not None else F.lit(True)).where((at <= high) if high is not None else F.lit(True))
        pairs = linker.ingest(part)
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()
