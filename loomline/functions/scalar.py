"""Column functions (URNs, paths, tokens, hashes, vectors, text). All are built-in expressions, so they
stay inside generated code; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- URNs and paths -------------------------------------------------------------------------------


def normalize_path(c: Column) -> Column:
    """Forward slashes, no repeated ones, none at the ends; null is an empty path."""
    return F.trim(F.regexp_replace(F.translate(F.trim(F.coalesce(c, F.lit(""))), "\\", "/"), "/+", "/"), F.lit("/"))


def urn(entity: Column, project: Column, path: Column) -> Column:
    def filled(c: Column, empty: str) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(empty))

    return F.concat_ws(":", F.lit("urn"), F.lit("li"), F.trim(filled(entity, "unknown")), F.trim(filled(project, "default")), filled(normalize_path(path), "unknown"))


def urn_parts(c: Column) -> Column:
    """struct(entity_type, project_id, asset_path), null for what is no URN. The asset keeps its colons."""
    p = F.split(c, ":", 5)
    valid = (F.size(p) == 5) & (p[0] == "urn") & (p[1] == "li")
    return F.when(valid, F.struct(p[2].alias("entity_type"), p[3].alias("project_id"), p[4].alias("asset_path")))


def is_urn(c: Column) -> Column:
    return F.coalesce(urn_parts(c).isNotNull(), F.lit(False))


def sanitize_filename(c: Column) -> Column:
    base = F.regexp_extract(c, r"([^/]*)$", 1)
    safe = F.ltrim(F.regexp_replace(base, r"[^\w\-.]", "_"))
    return F.coalesce(F.nullif(F.regexp_replace(safe, r"^\.+", ""), F.lit("")), F.lit("unnamed_file"))


def sanitize_relative_path(c: Column) -> Column:
    parts = F.filter(F.split(c, "/"), lambda p: ~p.isin("", ".", ".."))
    return F.coalesce(F.nullif(F.array_join(F.transform(parts, sanitize_filename), "/"), F.lit("")), F.lit("unnamed_file"))


def file_type(c: Column) -> Column:
    ext = F.lower(F.regexp_extract(c, r"[^/]\.([^./]+)$", 1))
    return F.when(ext == "py", "python").when(ext != "", ext).otherwise("unknown")


def kebab(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def database_name(path: Column, explicit: Column | None = None) -> Column:
    """Explicit name, else the file name up to its first hyphen or underscore, else its folder, else default."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    folder = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    found = F.when(stem.contains("-"), F.substring_index(stem, "-", 1)).when(stem.contains("_"), F.substring_index(stem, "_", 1)).when(~folder.isin("", ".", "data"), folder)
    guessed = F.coalesce(kebab(found), F.lit("default"))
    return guessed if explicit is None else F.coalesce(kebab(F.nullif(explicit, F.lit(""))), guessed)


def relationship_name(c: Column) -> Column:
    s = F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), "[^A-Z0-9_]", "_")
    return F.when(s == "", "RELATED_TO").when(s.rlike("^[0-9]"), F.concat(F.lit("REL_"), s)).otherwise(s)


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# --- texts ----------------------------------------------------------------------------------------

#: Patterns of personal data and their replacements, in this order.
PERSONAL = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (r"\b\d{3}[-.]?\d{2}[-.]?\d{4}\b", "[SSN]"),
    (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "[CARD]"),
    (r"\b\d{10,11}\b", "[PHONE]"),
)
#: Words that tell a question about lineage.
LINEAGE_WORDS = ("lineage", "upstream", "downstream", "depends", "dependency", "derive", "derived", "reads", "writes", "impact", "flows")


def redact(c: Column) -> Column:
    for pattern, mark in PERSONAL:
        c = F.regexp_replace(c, f"(?i){pattern}", F.lit(mark).cast("string"))
    return c


def tokens(c: Column) -> Column:
    """Token estimate of context budgets: a quarter of the characters."""
    return F.floor(F.length(c) / 4).cast("int")


def terms(c: Column, most: int = 15) -> Column:
    """Names in a question longer than three characters, with singulars, in order, without repeats."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z_][A-Za-z0-9_\\.]*"), F.lit(0)), lambda t: F.trim(t, F.lit(".,")))
    long = F.filter(found, lambda t: F.length(t) > 3)
    pairs = F.flatten(F.transform(long, lambda t: F.when(t.endswith("s") & (F.length(t) > 4), F.array(t, F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(F.array(t))))
    return F.slice(F.array_distinct(pairs), 1, most)


def asks_lineage(c: Column) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in LINEAGE_WORDS]), lambda w: F.contains(F.lower(c), w))


def salvage_json(c: Column) -> Column:
    """The JSON object inside a model's answer: without thoughts and fences, first to last brace; null if unreadable."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def tag_block(name: str, body: Column) -> Column:
    """<name>body</name> on three lines, or null for an empty body, so that concat_ws skips it."""
    return F.when(F.trim(body) != "", F.concat(F.lit(f"<{name}>\n"), F.trim(body), F.lit(f"\n</{name}>")))


# --- vectors and keyword weights ------------------------------------------------------------------

WIDTH = 262_144


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where the sizes differ or a vector is zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def term_index(term: Column) -> Column:
    return F.conv(F.right(F.md5(term), F.lit(5)), 16, 10).cast("bigint") % WIDTH


def term_weight(frequency: Column) -> Column:
    """Saturating weight of a term frequency (k1 = 1.5, without length normalisation)."""
    return 2.5 * frequency / (frequency + 1.5)


# --- types ----------------------------------------------------------------------------------------

#: Families of types that are compatible among themselves.
NUMERIC = ("int", "integer", "bigint", "decimal", "float", "double", "numeric")
TEXTUAL = ("varchar", "nvarchar", "char", "text", "string")


def compatible(a: Column, b: Column) -> Column:
    x, y = (F.substring_index(F.lower(c), "(", 1) for c in (a, b))
    return (x == y) | (x.isin(*NUMERIC) & y.isin(*NUMERIC)) | (x.isin(*TEXTUAL) & y.isin(*TEXTUAL))


def cache_key(parts: Sequence[Column]) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)
