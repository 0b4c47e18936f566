"""Scalar functions over ids, names, paths and counts, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the projected tables declare of their edge types. An undeclared type is lexical.
CLASSES = {
    "placed_by": ("depends", "reaches"),
    "orders": ("depends", "reaches"),
    "supplied_by": ("depends", "reaches"),
    "in_nation": ("depends",),
    "within": ("structural",),
    "contains": ("structural",),
    "follows": ("lexical",),
    "emits": ("lexical",),
}
#: What is walked where no lane declares a class; fixed values.
DEFAULTS = {"depends": ("calls", "inherits", "imports", "decorates"), "reaches": ("calls",)}
#: What Python source declares of its edge types.
CODE_CLASSES = {"calls": ("depends", "reaches"), "inherits": ("depends",), "imports": ("depends",), "decorates": ("depends",), "contains": ("structural",)}
#: Directories, suffixes and name marks that tell what a file is; fixed values.
TEST_DIRS = ("tests", "test", "__tests__", "testing", "fixtures", "conftest")
SLOP_DIRS = ("archive", "scp", "uploads", "bin", "logs", "migrations", "scratchpad")
DOC_DIRS = ("review", "reviews", "handoffs")
DOC_SUFFIXES = ("json", "jsonl", "md", "rst", "txt", "yaml", "yml")
#: Edge types whose salience is high; fixed values.
SALIENT = ("serves", "fetches", "fetches_static", "navigates")


def scheme(c: Column) -> Column:
    """Text before ``://``; null without it, so that it never joins."""
    return F.when(c.contains("://"), F.substring_index(c, "://", 1))


def kind(c: Column) -> Column:
    """Text between ``://`` and the next slash; empty without either."""
    return F.coalesce(F.regexp_extract(c, r"^[^:]+://([^/]*)/", 1), F.lit(""))


def body(c: Column) -> Column:
    """What follows the kind; the rest after the scheme without one; the whole id without a scheme."""
    rest = F.when(c.contains("://"), F.regexp_replace(c, r"^[^:]*://", "")).otherwise(c)
    return F.when(c.contains("://") & rest.contains("/"), F.regexp_replace(rest, r"^[^/]*/", "")).otherwise(rest)


def last(c: Column) -> Column:
    return F.substring_index(body(c), ".", -1)


def posix(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def dotted_prefix(c: Column, depth: int) -> Column:
    return F.substring_index(c, ".", depth)


def tails(c: Column, separator: str = ".") -> Column:
    """Every suffix of a dotted name that starts after a separator, the whole one included."""
    parts = F.split(c, re.escape(separator))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), separator))


def prefixes(c: Column, separator: str = ".") -> Column:
    parts = F.split(c, re.escape(separator))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))


def split_identifier(c: Column) -> Column:
    """Lower-cased parts at camel humps, digits, hyphens, underscores, dots and spaces."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), 1), F.lower)


def spellings(c: Column) -> Column:
    """snake, kebab, dotted, spaced, joined, camel and Pascal spelling of an identifier."""
    parts = split_identifier(c)
    pascal = F.array_join(F.transform(parts, F.initcap), "")
    camel = F.concat(F.lower(F.substring(pascal, 1, 1)), F.substring(pascal, F.lit(2), F.length(pascal)))
    return F.array(F.array_join(parts, "_"), F.array_join(parts, "-"), F.array_join(parts, "."), F.array_join(parts, " "), F.array_join(parts, ""), camel, pascal)


def tolerant_pattern(name: str, loose: bool = False) -> str:
    """A case-blind Java pattern that lets one separator stand between the parts (or, loosely, the letters) of a name."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)] or [name]
    if loose:
        parts = [x for p in parts for x in p]
    return "(?i)" + r"[-_./\\\s]?".join(re.escape(p) for p in parts)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\S+|\s+)"), 1)


def route(c: Column) -> Column:
    """A URL path whose numeric and uuid segments, and those with an at sign, plain or escaped, are replaced by ``{}``; host,
    query and fragment go, and nothing left is ``/``."""
    path = F.regexp_replace(F.regexp_replace(c, r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    varies = r"^([0-9]+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$|@|%40"
    joined = F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(varies), F.lit("{}")).otherwise(s)), "/")
    return F.when(joined == "", "/").otherwise(joined)


def route_pattern(route: str) -> str:
    """A Java pattern that finds a normalised route, each ``{}`` standing for one segment, where no longer one goes on."""
    return r'[^/\s"?]+'.join(re.escape(p) for p in route.split("{}")) + r"(?![\w./-])"


def change_kind(c: Column) -> Column:
    return F.when(c.contains("#"), "pr").when(c.rlike("^[0-9a-f]{7,40}$"), "commit").otherwise("file")


def cursor(c: Column) -> Column:
    """Hexadecimal cursors of up to forty characters cut to eight; others as they are."""
    return F.when(c.rlike("^[0-9a-f]{8,40}$"), F.substring(c, 1, 8)).otherwise(c)


def source_kind(c: Column, ignored: Column | None = None) -> Column:
    """test, slop, doc or live, by path, in that order; ``ignored`` says which paths the repository ignores."""
    path = F.lower(posix(c))
    within = lambda names: path.rlike(rf"(^|/)({'|'.join(names)})/")
    test = path.rlike(r"(^|/)(test_[^/]*|conftest\.py)$|_test(\.[^./]*)?$|\.(test|spec)\.[^/]*$") | within(TEST_DIRS)
    slop = within(SLOP_DIRS) if ignored is None else within(SLOP_DIRS) | ignored
    doc = path.rlike(rf"\.({'|'.join(DOC_SUFFIXES)})$") | within(DOC_DIRS)
    return F.when(test, "test").when(slop, "slop").when(doc, "doc").otherwise("live")


def liveness(live: Column, prose: Column, others: Column) -> Column:
    """LIVE, MENTION-ONLY, FALSE LIVENESS or DARK from how often a term stands in live code, in its comments and strings,
    and in test, slop and doc files."""
    return F.when(live > 0, "LIVE").when((prose > 0) & (others == 0), "MENTION-ONLY").when((prose > 0) | (others > 0), "FALSE LIVENESS").otherwise("DARK")


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def distribution(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[-_.]+", "-")


def archive_date(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))


def lift(support: Column, n_a: Column, n_b: Column, total: Column) -> Column:
    return F.when((n_a > 0) & (n_b > 0), support * total / (n_a * n_b)).otherwise(F.lit(0.0))


def credibility(support: Column) -> Column:
    return F.when(support > 0, support / (support + 5)).otherwise(F.lit(0.0))


def edge_salience(c: Column) -> Column:
    return F.when(c.isin(*SALIENT), F.lit(5.0)).otherwise(F.lit(1.0))


def classes_of(c: Column) -> Column:
    out = F.array(F.lit("lexical"))
    for name, held in CLASSES.items():
        out = F.when(c == name, F.array(*map(F.lit, held))).otherwise(out)
    return out


def relations(cls: str) -> tuple[str, ...]:
    return tuple(t for t, held in CLASSES.items() if cls in held)
