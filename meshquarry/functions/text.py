"""Column expressions that bring names written in many ways to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File endings that may follow a name (fixed values).
ENDINGS = r"\.(obj|off|ply|stl|msh|json|jsonl|csv|tsv|txt|parquet|log)$"
#: Statuses that say success, squeezed (fixed values).
SUCCESS = ("success", "succeeded", "successful", "succeed", "ok", "okay", "done", "passed", "pass", "complete", "completed", "finished")
#: Author entries that stand for nobody, squeezed (fixed values).
NOBODY = ("", "na", "nan", "none", "null", "nil", "unknown", "unknownauthor", "unk", "anonymous", "anon", "nobody", "noname", "noauthor", "tbd", "unnamed", "unspecified", "notavailable", "notapplicable", "undefined", "missing", "user", "author", "various", "unbekannt", "inconnu", "desconocido")


def basename(c: Column) -> Column:
    """Lower case, trimmed, without path and file ending."""
    s = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    s = F.regexp_replace(s, r"^.*[/\\]", "")
    return F.regexp_replace(s, ENDINGS, "")


def squeeze(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")


def name_key(c: Column) -> Column:
    """One key for a name however written: case, blanks, path, file ending, separators play no part. Null stays null."""
    return squeeze(basename(c))


def author_key(c: Column) -> Column:
    """Key of an author however written; null for one that stands for nobody."""
    k = squeeze(F.lower(c))
    return F.when(~k.isin(*NOBODY), k)


def category_key(c: Column) -> Column:
    """Key of a category however written, without the leading collection name; null for null, empty and unknown."""
    k = F.regexp_replace(name_key(c), r"^shapenet", "")
    return F.when(~k.isin("", "unknown", "none", "null", "nan", "na"), k)


def source_key(c: Column) -> Column:
    """Key of a source however written; a host ending such as ``.example`` plays no part."""
    s = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return squeeze(F.regexp_replace(F.regexp_replace(s, r"^(https?://)?(www\.)?", ""), r"\.(example|invalid|test|com|org|net)(/.*)?$", ""))


def is_success(c: Column) -> Column:
    """Whether a status says success, in whatever wording; false for null."""
    return F.coalesce(squeeze(F.lower(c)).isin(*SUCCESS), F.lit(False))


def epoch_seconds(c: Column) -> Column:
    """Epoch time in whatever unit (s, ms, us, ns) as seconds; null for null, NaN, 0 and less."""
    v = c.cast("double")
    s = F.when(v < 1e11, v).when(v < 1e14, v / 1e3).when(v < 1e17, v / 1e6).otherwise(v / 1e9)
    return F.when((v > 0) & ~F.isnan(v), s)
