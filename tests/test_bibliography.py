"""Reference entries from lines, competing readers, and author-year matching, on hand-made cases."""

import pytest

from folioscope.operators import authoryear, bibliography


def entries(spark, *texts):
    got = bibliography.entries(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "n").collect()
    return {d: [(r.n, r.mode, r.raw, r.cut) for r in got if r.doc_id == d] for d in range(len(texts))}


def test_labels_that_leap_are_part_of_an_entry(spark):
    text = "[1] Abel, A. (1990). One, pp. 293 (2203-\n2209) and so on.\n[2] Baker, B. (1991). Two.\n[2] again\n12\n[4] Cole, C. (1992). Three words\n[40] more words\n[90] Dole, D. (1993). Four.\n"
    got = entries(spark, text)[0]
    assert [x[0] for x in got] == [1, 2, 4, 90] and {x[1] for x in got} == {"numbered"}
    assert got[0][2] == "Abel, A. (1990). One, pp. 293 (2203-2209) and so on." and got[1][2].endswith("Two. [2] again") and got[2][2].endswith("[40] more words")


def test_a_label_after_dated_entries_is_a_wrapped_number(spark):
    text = "Abel, A. (1990). One word. Journal,\n(12) 3-4.\nBaker, B. C., &\nCole, D. (1991). Two. https://doi.org/\n10.1000/x.\ny-1\nWorld Survey Office. (1992). Three.\nvan der Meer, E. & others, in print\n"
    got = entries(spark, text)[0]
    assert [x[2] for x in got] == ["Abel, A. (1990). One word. Journal, (12) 3-4.", "Baker, B. C., & Cole, D. (1991). Two. https://doi.org/10.1000/x.y-1", "World Survey Office. (1992). Three. van der Meer, E. & others, in print"]
    assert [x[0] for x in got] == [1, 2, 3]
    # A full stop at a line's end ends an identifier, unless a token with a digit follows.
    got = entries(spark, "Abel A, Li B. One. J. 1990;1:2. doi:10.1000/x.1.\nSee also that.\nMill A, Rice B. Two. J. 1991;1:2. doi:10.1000/x.\n2-y.\n")[0]
    assert [x[2] for x in got] == ["Abel A, Li B. One. J. 1990;1:2. doi:10.1000/x.1. See also that.", "Mill A, Rice B. Two. J. 1991;1:2. doi:10.1000/x.2-y."]


def test_lines_without_any_shape(spark):
    got = entries(spark, "a plain title\nhttps://doi.org/10.1000/abc\n\nanother title\n", None, "", " \n\n7\n")
    assert [(x[1], x[2]) for x in got[0]] == [("lines", "a plain title https://doi.org/10.1000/abc"), ("lines", "another title")]
    assert got[1] == got[2] == got[3] == []


def test_bleed_is_cut_only_where_more_than_half_is_prose(spark):
    prose = " ".join(["words of a later section"] * 60)
    short = "Abel, A. (1990). One. Oslo: North Press.\nBaker, B. (1991). Two. Oslo: North Press.\n"
    got = entries(spark, short + "Cole, C. (1992). Three. Oslo: North Press. " + prose, short + "Cole, C. (1992). Three, no publisher. " + prose, "Cole, C. (1992). Three. Oslo: North Press. " + prose, short + prose + "Cole, C. (1992). 12(3), 45.")
    assert got[0][2][2:] == ("Cole, C. (1992). Three. Oslo: North Press. words of a later s", True)
    assert not got[1][2][3] and got[1][2][2].endswith("section") and not got[2][0][3] and len(got[3]) == 2 and not got[3][1][3]


def read(spark, *raws):
    return bibliography.read_entries(spark.createDataFrame([(i, r, "kept") for i, r in enumerate(raws)], "n int, raw string, other string")).orderBy("n").collect()


def test_readers(spark):
    got = read(
        spark,
        "Abel, A. B., & O'Neil, C.-D. (1990a). Of goods. A study. Journal of Things, 12(3–4), e5-e19. https://doi.org/10.1000/a.b-(1)c",
        "Abel A, de Boer CD. Of goods. J Things. 1990;12:123-9.",
        "Abel, A.; Baker, B. Of goods. Things 1990, 12, 5-19.",
        "Abel, A. (1990). Of goods. Oslo: North Press.",
        "Abel v. Baker, 12 F. Supp. 345 (N.Y. 1990).",
        "Abel, A. (1990). Of goods. Things, 12(3), 119-105.",
        "1990, something else, 10.1000/xyz.",
        None,
        "",
    )
    assert [(r.status, r.reader) for r in got] == [("parsed", x) for x in ("dated_journal", "short_names", "semicolons", "dated_book", "case")] + [("refused", None), ("generic", "generic"), ("generic", "generic"), ("generic", "generic")]
    assert got[0].authors == ["Abel, A. B.", "O'Neil, C.-D."] and (got[0].title, got[0].container, got[0].issue, got[0].pages, got[0].doi) == ("Of goods. A study", "Journal of Things", "3–4", "e5-e19", "10.1000/a.b-(1)c")
    assert got[1].pages == "123-9" and got[5].reasons == ["pages"] and (got[6].year, got[6].doi) == (1990, "10.1000/xyz") and got[8].year is None
    # What a reader gives stands in the entry.
    assert all(r[f] is None or str(r[f]) in r.raw for r in got for f in bibliography.FIELDS if f != "authors") and {r.other for r in got} == {"kept"}


def test_each_grammar_is_evaluated_once(spark):
    found = bibliography.read_entries(spark.createDataFrame([(1, "Abel, A. (1990). One\x1ftwo. Oslo: North Press.")], "n int, raw string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(grammar) for grammar, _, _ in bibliography.GRAMMARS.values()] == [1] * len(bibliography.GRAMMARS)
    assert [(r.status, r.authors, r.title, r.place, r.publisher) for r in found.collect()] == [("parsed", ["Abel, A."], "One two", "Oslo", "North Press")]


def test_readings_that_differ_are_ambiguous(spark, monkeypatch):
    monkeypatch.setitem(bibliography.GRAMMARS, "report", (rf"^([^()]+) \(({bibliography.YEAR})\)\. (.+)\. ([^.]+)\.$", ("authors", "year", "title", "publisher"), r",? & |(?<=\.), "))
    same, differs = read(spark, "Abel, A. (1990). Of goods. Oslo: North Press.", "Abel, A. (1990). Of goods. A tale. Oslo: North Press.")
    assert (same.status, same.reader, same.place) == ("parsed", "dated_book", "Oslo") and (differs.status, differs.title) == ("parsed", "Of goods. A tale")
    monkeypatch.setitem(bibliography.GRAMMARS, "short_title", (rf"^([^()]+) \(({bibliography.YEAR})\)\. ([^.]+)\..*$", ("authors", "year", "title"), r",? & |(?<=\.), "))
    (differs,) = read(spark, "Abel, A. (1990). Of goods. A tale. Oslo: North Press.")
    assert (differs.status, differs.reader, differs.title) == ("ambiguous", None, None)


ENTRIES = [
    (1, "Abel, A., & Baker, B. (1990). One. Oslo: P."),
    (2, "Abel, A., Cole, C., & Dole, D. (1990). Two. Oslo: P."),
    (3, "Abel, A. (1991a). Three. Oslo: P."),
    (4, "Abel, A. (1991b). Four. Oslo: P."),
    (5, "Feldman-Barrett, L. (1992). Five. Oslo: P."),
    (6, "World Trade Office. (1993). Six, with more, than a grammar takes"),
    (7, "Mill, A. (1994). Seven. Oslo: P."),
    (8, "Mill, B. (1994). Eight. Oslo: P."),
    (9, "no name here 1995"),
]


@pytest.mark.parametrize(
    ("marker", "status", "found"),
    [
        ("(Abel & Baker, 1990)", "unique", [1]),
        ("(Abel et al., 1990)", "unique", [2]),
        ("(Abel, 1990)", "ambiguous", [1, 2]),
        ("(Abel and Zuse, 1990)", "unique", [1]),
        ("Abel (1991a)", "unique", [3]),
        ("(Abel, 1991)", "ambiguous", [3, 4]),
        ("(Abel, 1991c)", "orphan", []),
        ("(FeldmanBarrett, 1992)", "unique", [5]),
        ("(WTO, 1993)", "unique", [6]),
        ("(Mill, 1994)", "ambiguous", [7, 8]),
        ("(Nobody, 1994)", "orphan", []),
    ],
)
def test_matching_stages(spark, marker, status, found):
    read_ = bibliography.read_entries(spark.createDataFrame([(1, n, raw) for n, raw in ENTRIES], "doc_id long, n int, raw string"))
    cites = authoryear.citations(spark.createDataFrame([(1, 5, f"As {marker} and others."), (2, 5, "As Abel (1991a)."), (1, 6, None)], "doc_id long, claim_id long, sentence string"))
    got = authoryear.match(cites, authoryear.index(read_)).orderBy("doc_id").collect()
    assert [(r.status, r.candidates, r.n) for r in got] == [(status, found, found[0] if len(found) == 1 else None), ("orphan", [], None)]


def test_a_printed_date_goes_before_digits_of_an_identifier(spark):
    raw = "Mosi, A. (1996a). Models. Review, 31(7), 351-384. https://doi.org/10.1750/ord.1-1 and further words of it"
    read_ = bibliography.read_entries(spark.createDataFrame([(1, 10, raw)], "doc_id long, n int, raw string"))
    assert [(r.status, r.year) for r in read_.collect()] == [("generic", 1750)]
    assert {(r.year, r.suffix) for r in authoryear.index(read_).collect()} == {(1996, "a")}


def test_a_choice_counts_only_for_candidates(spark):
    matched = spark.createDataFrame([(1, 1, 0, "ambiguous", None, [3, 4]), (1, 2, 0, "ambiguous", None, [3, 4]), (1, 3, 0, "unique", 7, [7])], "doc_id long, claim_id long, place int, status string, n int, candidates array<int>")
    chosen = spark.createDataFrame([(1, 1, 0, 4), (1, 2, 0, 9), (1, 3, 0, 4)], "doc_id long, claim_id long, place int, choice int")
    got = authoryear.resolved(matched, chosen).orderBy("claim_id").collect()
    assert [(r.status, r.n) for r in got] == [("chosen", 4), ("ambiguous", None), ("unique", 7)]


def test_citations_of_a_sentence(spark):
    text = "Von Neumann and Abel (1990) and Cole et al. (1991b) differ (see fig. 2; Dole, Mill, and Rice, 1992; de Boer & Li, 1993a) in (1994) and (12)."
    got = authoryear.citations(spark.createDataFrame([(1, 1, text)], "doc_id long, claim_id long, sentence string")).orderBy("place").collect()
    assert [(r.surname, r.others, r.et_al, r.year, r.suffix) for r in got] == [("Neumann", ["Abel"], False, 1990, ""), ("Cole", [], True, 1991, "b"), ("Dole", ["Mill", "Rice"], False, 1992, ""), ("de Boer", ["Li"], False, 1993, "a")]


def test_lines_of_a_text_stay_in_its_row(spark):
    """Entries are cut within the row of their text: no line is sorted, joined or sent anywhere."""
    text = "\n".join(f"[{i}] Abel, A. (1990). Number {i}." for i in range(1, 3001)) + "\n[3900] Not an entry's start\n\r\n [3001] Baker, B. (1991). Last."
    found = bibliography.entries(spark.createDataFrame([(1, text), (None, "Abel, A. (1990). One.")], "doc_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Window", "Join", "Sort "))
    got = {r.n: r.raw for r in found.collect()}
    assert sorted(got) == list(range(1, 3002)) and got[3000] == "Abel, A. (1990). Number 3000. [3900] Not an entry's start" and got[3001] == "Baker, B. (1991). Last."


def test_numbers_are_spelled_digit_by_digit(spark):
    from folioscope.plans import bibliography as plans

    sql = plans._spell("k")
    assert plans.for_spark(sql) != sql and all("replace(replace(" not in plans.for_spark(e) for stage in plans.STAGES for e in stage.values())
    rows = spark.createDataFrame([(k,) for k in (0, 7, 10, 1234567890, -25, 9223372036854775807, None)], "k long")
    assert all(r.a == r.b for r in rows.selectExpr(f"{sql} AS a", f"{plans.for_spark(sql)} AS b").collect())


def test_coverage_makes_its_entries_once(spark, monkeypatch):
    from folioscope.plans import bibliography as plans

    made, entries = [], plans.B.entries
    monkeypatch.setattr(plans.B, "entries", lambda docs: made.append(docs) or entries(docs))
    plans.QUERIES["authoryear_coverage"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1
