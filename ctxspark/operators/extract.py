"""Documents out of request texts, and back into them: XML tags, numbers, separators, headers, JSON results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import stripped

# Wrapper tags, item tags and id fields, in the order in which they are tried.
WRAPPERS = ("documents", "contexts", "docs", "passages", "references", "files")
ITEMS = ("document", "context", "doc", "passage", "reference", "file")
ID_FIELDS = ("url", "path", "file", "filename", "uri", "href")
SINGLE_MIN_CHARS = 100
_RESULT = ", ".join(f"{f} string" for f in (*ID_FIELDS, "title", "content", "text", "snippet"))


def _tagged(text: Column, tag: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.+?)</{tag}>"), F.lit(1))
    return F.filter(F.transform(found, stripped), lambda d: d != "")


def _none() -> Column:
    return F.lit(None).cast("array<string>")


def xml(text: Column) -> Column:
    """Items inside a wrapper; without one, at least two bare items; else null."""
    inside = F.coalesce(*(F.nullif(F.regexp_extract(text, rf"(?s)<{w}(?:\s[^>]*)?>(.*?)</{w}>", 1), F.lit("")) for w in WRAPPERS))
    wrapped = F.coalesce(*(F.when(F.size(_tagged(inside, t)) >= 1, _tagged(inside, t)) for t in ITEMS), _none())
    bare = F.coalesce(*(F.when(F.size(_tagged(text, t)) >= 2, _tagged(text, t)) for t in ITEMS), _none())
    return F.coalesce(wrapped, bare)


def _parts(text: Column, pattern: str, least: int, skip_first: bool = False) -> Column:
    cut = F.split(text, pattern, -1)
    if skip_first:
        cut = F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))
    parts = F.filter(F.transform(cut, stripped), lambda d: d != "")
    return F.when(F.size(parts) >= least, parts).otherwise(_none())


def numbered(text: Column, least: int = 2) -> Column:
    """What follows [1], [2], ...; null with fewer than two."""
    return _parts(text, r"\[\d+\]\s*", least, skip_first=True)


def separated(text: Column, least: int = 3) -> Column:
    """Parts between lines of --- or else of ===."""
    return F.coalesce(_parts(text, r"\n---\n", least), _parts(text, r"\n===\n", least))


def markdown(text: Column, least: int = 2) -> Column:
    """Sections that begin with a header of one or two signs."""
    parts = F.filter(F.transform(F.split(text, r"(?m)(?=^#{1,2}\s)", -1), stripped), lambda d: d.rlike(r"^#{1,2}\s"))
    return F.when(F.size(parts) >= least, parts).otherwise(_none())


def json_results(text: Column, least: int = 2) -> Column:
    """array<struct(id, text)> of an object's results: the id is the first field that has one, else the row itself."""
    rows = F.from_json(text, "results array<string>")["results"]

    def one(row: Column) -> Column:
        r = F.from_json(row, _RESULT)
        return F.struct(F.coalesce(*(F.nullif(F.trim(r[f]), F.lit("")) for f in ID_FIELDS), row).alias("id"), row.alias("text"))

    return F.when(F.size(rows) >= least, F.transform(rows, one))


def auto(text: Column) -> Column:
    """struct(mode, documents): the first way that finds documents: XML, numbers, JSON results."""
    tried = (("xml", xml(text)), ("numbered", numbered(text)), ("json", F.transform(json_results(text), lambda r: r["id"])))
    return F.coalesce(*(F.when(docs.isNotNull(), F.struct(F.lit(mode).alias("mode"), docs.alias("documents"))) for mode, docs in tried))


def to_xml(docs: Column, wrapper: str = "documents", item: str = "document") -> Column:
    return F.concat(F.lit(f"<{wrapper}>\n"), F.array_join(F.transform(docs, lambda d: F.concat(F.lit(f"<{item}>"), d, F.lit(f"</{item}>"))), "\n"), F.lit(f"\n</{wrapper}>"))


def to_numbered(docs: Column) -> Column:
    return F.array_join(F.transform(docs, lambda d, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), d)), "\n")


def to_separated(docs: Column, mark: str = "---") -> Column:
    return F.array_join(docs, f"\n{mark}\n")


def to_markdown(docs: Column) -> Column:
    return F.array_join(docs, "\n\n")


def to_json_results(text: Column, docs: Column) -> Column:
    """An object with its results in the order of ``docs``, which are their ids; the n-th of an id is the n-th result that has it.

    Results that are not named go; the object's other fields stay.
    """
    fields = F.from_json(text, "map<string,variant>")
    found = json_results(text, 0)

    def one(d: Column, k: Column) -> Column:
        earlier = F.size(F.filter(F.slice(docs, 1, k), lambda x: x == d))
        return F.get(F.filter(found, lambda r: r["id"] == d), earlier)["text"]

    rows = F.filter(F.transform(docs, one), lambda r: r.isNotNull())
    rest = F.map_filter(fields, lambda k, _: k != "results")
    listed = F.parse_json(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")))
    return F.to_json(F.map_concat(rest, F.create_map(F.lit("results"), listed)))


def single_document(text: Column, least: int = SINGLE_MIN_CHARS) -> Column:
    """The stripped text, if it is long enough to be a document and holds none by other ways."""
    s = stripped(text)
    return F.when((F.length(s) >= least) & auto(text).isNull(), s)
