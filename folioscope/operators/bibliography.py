"""Reference entries: recovered from wrapped lines, read by competing grammars, validated against their text.

Lines become entries within their document's row, as arrays in their order: where an entry starts depends on the line before (is
it open?) and on those after (does a year follow?). Only numbered labels need a fold, as what is accepted depends on the label
accepted last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Greatest first number of a numbered list, greatest step between labels, least length and multiple of the median
#: beyond which an entry is an outlier, characters kept after its last element.
FIRST_LABEL, STEP, LONG, TIMES, AFTER = 20, 3, 700, 3, 20

#: What may stand before a family name in lower case.
PARTICLES = r"(?:(?:van|von|der|den|de|di|da|la|le) )*"
YEAR = r"(?:1[5-9]|20)[0-9]{2}"
_LABEL = r"^(?:\[([0-9]{1,4})\]|\(([0-9]{1,4})\)|([0-9]{1,4})[.)])(?:\s+(.*))?$"
#: A family name with initials after it, or an institution with a date after it, at the start of a line.
_HEAD = rf"^{PARTICLES}\p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)*(?:, ?\p{{Lu}}\.| \p{{Lu}}{{1,3}}(?:,|\.)|\. \({YEAR}[a-z]?\))"
_OPEN = r"(?:,|;|&|-|\band|(?:^|[ .])\p{Lu}\.)$"
#: What prose hardly has: identifiers, addresses, page ranges, volume with issue and page, publishers' words.
_STRONG = r"10\.[0-9]{4,9}/\S+|https?://\S+|\bpp?\. ?[0-9]+ ?[-–] ?[0-9]+|[0-9]+ ?\([0-9]+\) ?[:,] ?[0-9]+|\b(?:Press|Publishers|Verlag)\b"
_IDENTIFIER = r"^(?:https?://(?:dx\.)?doi\.org/\S+|(?:doi: ?)?10\.[0-9]{4,9}/\S+)$"


def joined_lines(text: Column) -> Column:
    """Lines of one entry as one: words cut by a hyphen, ranges and identifiers are put together, other breaks are blanks."""
    text = F.regexp_replace(text, r"(?<=\p{L})-\n(?=\p{Ll})", "")
    text = F.regexp_replace(text, r"-\n(?=[0-9])", "-")
    text = F.regexp_replace(text, r"(https?://(?:dx\.)?doi\.org/)\n(?=10\.)", "$1")
    # After a full stop only a token with a digit goes on with the identifier; else the stop ended it.
    text = F.regexp_replace(text, r"(10\.[0-9]{4,9}/(?:\S*[/_-])?)\n(?=\S)", "$1")
    text = F.regexp_replace(text, r"(10\.[0-9]{4,9}/\S*\.)\n(?=\S*[0-9])", "$1")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _labels(found: Column) -> Column:
    """Places of the labels that continue their list, of all labels (i, number, clear) in order. A step of over STEP needs a line that
    looks like an entry's first.

    A list counts as numbered if its first label is FIRST_LABEL at most. Labels kept go up, so there are 9,999 of them at most.
    """
    first = F.get(found, F.lit(0))["number"]
    start = F.struct((first - 1).alias("last"), F.array().cast("array<int>").alias("at"))
    goes_on = lambda a, x: (x["number"] > a["last"]) & ((x["number"] <= a["last"] + STEP) | x["clear"])
    kept = F.aggregate(found, start, lambda a, x: F.when(goes_on(a, x), F.struct(x["number"].alias("last"), F.concat(a["at"], F.array(x["i"])).alias("at"))).otherwise(a), lambda a: a["at"])
    return F.when(first <= FIRST_LABEL, kept).otherwise(F.array().cast("array<int>"))


def _places(array: str, test) -> Column:
    """Places (from 0) of an array column's elements that pass test(element, place)."""
    return F.filter(F.transform(array, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())


def entries(docs: DataFrame) -> DataFrame:
    """(doc_id, text: a bibliography's lines) -> doc_id, n, mode, raw, cut: an entry a row.

    mode: `numbered` (labels that go up; n is the label), `dated` (lines that start with authors and have a year near) or `lines` (one
    an entry; an entry that is only an identifier belongs to the one before). Empty lines and page numbers are left out. Entries
    without a year go to the one before. Of three entries or more, one far longer than the middle one is cut after its last strong
    element if more than half of it follows. Null and empty texts have no entries. No row leaves its task: a text is one row.
    """
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.filter(F.transform(F.split("text", r"\r?\n"), lambda t: F.trim(t)), lambda t: ~t.rlike(r"^[-–— ]*[0-9]*[-–— ]*$")).alias("t"))

    def labelled(t: Column) -> Column:
        number = F.coalesce(*[F.nullif(F.regexp_extract(t, _LABEL, i), F.lit("")) for i in (1, 2, 3)]).cast("int")
        return F.when(t.rlike(_LABEL), F.struct(number.alias("number"), F.regexp_extract(t, _LABEL, 4).alias("rest"))).otherwise(F.struct(F.lit(None).cast("int").alias("number"), t.alias("rest")))

    def marked(x: Column, i: Column) -> Column:
        t, number, rest = F.get("t", i), x["number"], x["rest"]
        ahead = F.concat_ws("\n", rest, *[F.get("t", i + k) for k in (1, 2, 3)])
        clear = F.when(number.isNotNull(), rest.rlike(_HEAD) & ahead.rlike(rf"\b{YEAR}\b")).otherwise(F.lit(False))
        dated = t.rlike(_HEAD) & ahead.rlike(rf"\b{YEAR}") & ~F.coalesce(F.get("t", i - 1).rlike(_OPEN), F.lit(False))
        return F.struct(number.alias("number"), rest.alias("rest"), clear.alias("clear"), dated.alias("dated"))

    # Each step's arrays are used more than once after it, so the optimiser keeps it apart.
    lines = lines.withColumn("x", F.transform("t", labelled)).withColumn("x", F.transform("x", marked))
    lines = lines.withColumn("labels", F.filter(F.transform("x", lambda x, i: F.struct(i.alias("i"), x["number"].alias("number"), x["clear"].alias("clear"))), lambda x: x["number"].isNotNull()))
    lines = lines.withColumns({"labels": _labels(F.col("labels")), "dated": _places("x", lambda x, i: x["dated"])})
    # Numbered, unless dated entries come before the first label: then the label is a wrapped place or page.
    early = F.coalesce(F.get("dated", F.lit(0)) < F.get("labels", F.lit(0)), F.lit(False))
    lines = lines.withColumn("mode", F.when((F.size("labels") > 0) & ~early, "numbered").when(F.size("dated") > 0, "dated").otherwise("lines"))
    alone = _places("t", lambda t, i: ~t.rlike(_IDENTIFIER) | (i == 0))
    lines = lines.withColumn("starts", F.when(F.col("mode") == "numbered", F.col("labels")).when(F.col("mode") == "dated", F.array_union(F.array(F.lit(0)), "dated")).otherwise(alone))

    def rest_of(starts: str, s: Column, j: Column) -> Column:
        """The lines after the start s, up to the next."""
        return F.slice("t", s + 2, F.coalesce(F.get(starts, j + 1), F.size("t")) - s - 1)

    # A dated entry without a year is the tail of the one before.
    has = lambda s, j: F.exists(F.concat(F.array(F.get("t", s)), rest_of("starts", s, j)), lambda t: t.rlike(rf"\b{YEAR}"))
    lines = lines.withColumn("heads", F.when(F.col("mode") == "dated", F.filter("starts", lambda s, j: (j == 0) | has(s, j))).otherwise(F.col("starts")))

    def entry(s: Column, j: Column) -> Column:
        head = F.when(F.col("mode") == "numbered", F.get("x", s)["rest"]).otherwise(F.get("t", s))
        return F.struct(F.get("x", s)["number"].alias("number"), joined_lines(F.array_join(F.concat(F.array(head), rest_of("heads", s, j)), "\n")).alias("raw"))

    lines = lines.withColumn("found", F.filter(F.transform("heads", entry), lambda e: e["raw"] != ""))
    sizes = F.array_sort(F.transform("found", lambda e: F.length(e["raw"])))
    middle = F.get(sizes, F.floor(F.size("found") / 2).cast("int"))
    # Outer, as a filter on the list's size would go below the step that makes it, and make it twice.
    one = lines.select("doc_id", "mode", F.size("found").alias("all"), middle.alias("middle"), F.posexplode_outer("found").alias("at", "e")).where("at is not null")
    n = F.when(F.col("mode") == "numbered", F.col("e.number")).otherwise(F.col("at") + 1)
    return _cut(one.select("doc_id", n.cast("int").alias("n"), "mode", F.col("e.raw").alias("raw"), "all", "middle"))


def _cut(found: DataFrame) -> DataFrame:
    """Entries far longer than the document's middle one (all: its entries, middle: that one's length), without the prose after their
    last strong element."""
    size = F.length("raw")
    outlier = (F.col("all") >= 3) & (size > F.greatest(F.lit(LONG), TIMES * F.col("middle")))
    sized = found.withColumn("end", F.when(outlier, F.length(F.regexp_extract("raw", rf"(?s)^.*(?:{_STRONG})", 0))).otherwise(0))
    cut = (F.col("end") > 0) & (2 * (size - F.col("end")) > size)
    return sized.select("doc_id", "n", "mode", F.when(cut, F.rtrim(F.left("raw", F.col("end") + AFTER))).otherwise(F.col("raw")).alias("raw"), cut.alias("cut"))


# ---------------------------------------------------------------- readers

_NAME_FIRST = PARTICLES + r"\p{Lu}[\p{L}'’ -]*, (?:\p{Lu}\.[ -]?)+"
_NAME_SHORT = PARTICLES + r"\p{Lu}[\p{L}'’ -]* \p{Lu}{1,3}"
_PAGES = r"[eA-Z]?[0-9]+(?:[-–][eA-Z]?[0-9]+)?"
_DOI = r"10\.[0-9]{4,9}/\S*[^\s.,;]"
FIELDS = ("authors", "year", "title", "container", "volume", "issue", "pages", "place", "publisher", "doi")

#: A reader's grammar of a whole entry, the field of each group, and what separates its names.
GRAMMARS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "dated_journal": (rf"^([^()]+) \(({YEAR})[a-z]?\)\. (.+?)\. ([^.]+), ([0-9]+)(?:\(([^)]+)\))?, ({_PAGES})\.(?: (?:https?://\S*?)?({_DOI}))?\.?$", ("authors", "year", "title", "container", "volume", "issue", "pages", "doi"), r",? & |(?<=\.), "),
    "short_names": (rf"^([^.]+)\. (.+?)\. ([^.]+)\. ({YEAR});([0-9]+)(?:\(([^)]+)\))?:({_PAGES})\.(?: doi: ?({_DOI}))?\.?$", ("authors", "title", "container", "year", "volume", "issue", "pages", "doi"), ", "),
    "semicolons": (rf"^((?:{_NAME_FIRST}; )*{_NAME_FIRST}) ?(.+?)\. ([^.]+) ({YEAR}), ([0-9]+), ({_PAGES})\.$", ("authors", "title", "container", "year", "volume", "pages"), "; "),
    "dated_book": (rf"^([^()]+) \(({YEAR})[a-z]?\)\. ([^.]+)\. ([^:.]+): ([^.]+)\.$", ("authors", "year", "title", "place", "publisher"), r",? & |(?<=\.), "),
    "case": (rf"^(\p{{Lu}}[^,]* v\. \p{{Lu}}[^,]*), ([0-9]+) (\p{{Lu}}[\p{{L}}0-9. ]*?) ([0-9]+) \((?:[^()]* )?({YEAR})\)\.$", ("title", "volume", "container", "pages", "year"), ""),
}


#: Parts the fields of a reader's match.
_PART = "\x1f"


def _match(reader: str) -> Column:
    """All fields of a reader's match by one evaluation of its grammar, each after _PART; raw itself where the grammar does not fit."""
    grammar, fields, _ = GRAMMARS[reader]
    groups = "".join(f"{_PART}${i + 1}" for i in range(len(fields)))
    return F.regexp_replace(F.translate("raw", _PART, " "), rf"{grammar}(?s:.*)", groups)


def _reading(reader: str, parts: Column) -> Column:
    """One reader's struct from the parts of its match: its fields as they stand in raw, and why they can't be right; null without parts."""
    _, fields, between = GRAMMARS[reader]
    got = {f: F.nullif(F.trim(F.get(parts, F.lit(i + 1))), F.lit("")) for i, f in enumerate(fields)}
    names = F.split(got["authors"], between) if between else F.array().cast("array<string>")
    form = _NAME_SHORT if reader == "short_names" else _NAME_FIRST
    range_ = F.regexp_replace(F.coalesce(got.get("pages", F.lit(None)), F.lit("")), "[^0-9–-]", "")
    ends = F.split(range_, "[-–]")
    from_, to = (F.get(ends, F.lit(i)).try_cast("long") for i in (0, 1))
    year = got["year"].cast("int")
    reasons = [
        F.when(F.exists(names, lambda a: ~F.trim(a).rlike(rf"^{form}$")), "authors"),
        F.when(got["title"].isNull() | ~F.coalesce(got["title"], F.lit("")).rlike(r"\p{L}{2}"), "title"),
        # Of a range that is shorter at its end, only the last digits are written.
        F.when((F.size(ends) == 2) & (F.length(from_.cast("string")) <= F.length(to.cast("string"))) & (from_ > to), "pages"),
        F.when(F.coalesce(got.get("publisher", F.lit("")), F.lit("")).rlike("[0-9]"), "publisher"),
        F.when(year > F.lit(2100), "year"),
    ]
    columns = [names.alias("authors"), year.alias("year"), *[got.get(f, F.lit(None).cast("string")).alias(f) for f in FIELDS[2:]]]
    return F.when(parts.isNotNull(), F.struct(F.lit(reader).alias("reader"), F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons"), *columns))


def read_entries(found: DataFrame) -> DataFrame:
    """found (raw, further columns) -> status, reader, reasons and the fields added.

    All readers try; those whose fields are valid compete. status: `parsed` (one valid reading, or several that agree on year and
    title; the first in order is given), `ambiguous` (valid readings differ; no fields), `refused` (only invalid ones, whose
    reasons are given; no fields) or `generic` (none fits; only a year that occurs once and a DOI are given).
    """
    # Each grammar is evaluated once, in generated code. Exploding one row's list keeps the optimiser from copying matches and
    # readings into every use of their result.
    read = found.withColumn("__m", F.explode(F.array(F.array(*[_match(r) for r in GRAMMARS]))))
    matches = {r: F.get("__m", F.lit(i)) for i, r in enumerate(GRAMMARS)}
    read = read.withColumn("__p", F.explode(F.array(F.array(*[F.when(F.startswith(m, F.lit(_PART)), F.split(m, _PART)) for m in matches.values()]))))
    readings = [_reading(r, F.get("__p", F.lit(i))) for i, r in enumerate(GRAMMARS)]
    read = read.withColumn("__all", F.explode(F.array(F.filter(F.array(*readings), lambda r: r.isNotNull()))))
    read = read.withColumn("__ok", F.filter("__all", lambda r: F.size(r["reasons"]) == 0))
    views = F.size(F.array_distinct(F.transform("__ok", lambda r: F.struct(r["year"], F.lower(r["title"])))))
    status = F.when(views == 1, "parsed").when(views > 1, "ambiguous").when(F.size("__all") > 0, "refused").otherwise("generic")
    read = read.withColumn("status", status).withColumn("__r", F.when(F.col("status") == "parsed", F.get("__ok", F.lit(0))))
    years = F.array_distinct(F.regexp_extract_all("raw", F.lit(rf"\b({YEAR})\b"), F.lit(1)))
    doi = F.nullif(F.regexp_extract("raw", _DOI, 0), F.lit(""))
    alone = F.col("status") == "generic"
    extra = {"year": F.coalesce("__r.year", F.when(alone & (F.size(years) == 1), F.get(years, F.lit(0)).cast("int"))), "doi": F.coalesce("__r.doi", F.when(alone, doi))}
    reasons = F.when(F.col("status") == "refused", F.array_sort(F.array_distinct(F.flatten(F.transform("__all", lambda r: r["reasons"])))))
    plain = {f: F.col(f"__r.{f}") for f in FIELDS if f not in extra}
    return read.withColumns({"reader": F.coalesce("__r.reader", F.when(alone, "generic")), "reasons": F.coalesce(reasons, F.array().cast("array<string>")), **plain, **extra}).drop("__m", "__p", "__all", "__ok", "__r")


def kind_of(raw: Column, doi: Column) -> Column:
    """What an entry is, by its marks: article, book, case, page or unknown; an arXiv number counts as an article's identifier."""
    return F.when(doi.isNotNull() | raw.rlike(r"(?i)\barxiv: ?[0-9]{4}\.[0-9]{4,5}|[0-9]+\([0-9]+\)|;[0-9]+[:(]|, [0-9]+, [0-9]+-[0-9]+\.$"), "article").when(raw.rlike(r"\bv\. \p{Lu}.*\([^)]*[0-9]{4}\)"), "case").when(raw.rlike(r"(?i)\bisbn\b|\b(?:Press|Publishers|Verlag)\b"), "book").when(raw.rlike("https?://"), "page").otherwise("unknown")
