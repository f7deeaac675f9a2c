"""Folds and row-local operators that SQL doesn't express, against plain replays; the pacing stream; record readers."""

import random
from collections import Counter

from pyspark.sql import functions as F

from folioscope.operators import relations, texts, verification
from folioscope.plans import relational, runs
from folioscope.sources import tables
from folioscope.streaming import pacing

SF = "/root/testdata/sf0.001"


def replay(events, level, cap, retries):
    phase, cycle, technical, outcome, seen = "open", 0, 0, None, []

    def gone():
        nonlocal phase, outcome
        if cycle < cap:
            phase, outcome = "open", None
            return
        top = max(((n, o) for o, n in Counter(seen).items()), default=(0, None))
        won = level == "medium" and 2 * top[0] > len(seen)
        phase, outcome = ("accepted", top[1]) if won else ("exhausted", None)

    for _, kind, got in sorted(events):
        if phase not in ("open", "admitted"):
            break
        if kind == "admit" and phase == "open":
            phase, cycle, technical, outcome = "admitted", cycle + 1, 0, got
        elif kind == "reject" and phase == "open":
            cycle += 1
            gone()
        elif kind == "technical":
            technical += 1
            phase = "technical_failure" if technical > retries else phase
        elif kind == "yes" and phase == "admitted":
            phase = "accepted"
        elif kind == "no" and phase == "admitted":
            if level == "low":
                phase = "contested"
            else:
                seen.append(outcome)
                gone()
    return phase, cycle, technical, outcome


def test_replayed_juries(spark):
    events = runs._jury_events(spark, SF)
    by = {}
    for r in events.collect():
        by.setdefault(r.pair, []).append((r.seq, r.kind, r.outcome))
    r = random.Random(1)
    for i in range(200):
        by[f"x{i}"] = [(k, r.choice(["admit", "admit", "no", "no", "yes", "reject", "technical"]), r.choice("ab")) for k in range(r.randint(1, 12))]
    made = spark.createDataFrame([(p, *e) for p, es in by.items() for e in es], "pair string, seq long, kind string, outcome string")
    for level in ("low", "medium", "high"):
        got = {x.pair: (x.phase, x.cycle, x.technical, x.outcome) for x in verification.replayed(made, level, 3, 2).collect()}
        assert got == {p: replay(es, level, 3, 2) for p, es in by.items()}


def test_backoff(spark):
    def plain(events):
        applied, learned, is_open, successes = 0.0, 0.0, False, 0
        for _, refused, floor in sorted(events):
            if refused:
                wait = max(min(2 * applied, 300.0), floor) if is_open and applied > 0 else (max(floor, learned) or 5.0)
                applied, is_open, successes = min(wait, 300.0), True, 0
            elif is_open or learned > 0:
                successes += 1
                if successes >= 2:
                    learned = applied if is_open else (0.0 if learned / 2 < 5 else learned / 2)
                    is_open, successes = False, 0
        return applied, learned, is_open, successes

    r = random.Random(2)
    rows = [(k, i, r.random() < 0.4, r.choice([0.0, 0.0, 12.5, 400.0])) for k in range(40) for i in range(r.randint(1, 30))]
    got = {x.key: (x.applied, x.learned, x.open, x.successes) for x in relations.backoff(spark.createDataFrame(rows, "key long, seq long, refused boolean, floor double")).collect()}
    assert got == {k: plain([x[1:] for x in rows if x[0] == k]) for k in range(40)}
    assert relational.QUERIES["host_backoff"](spark, SF).count() > 0


def scanned(t):
    """Spans of a text by a walk over its characters: what kind of stretch each one is in, then lengths."""
    kind, i = [], 0
    while i < len(t):
        j = i
        if t[i] in " \t\n\r\x0b\f" and i and t[i - 1] in ".!?":
            while j < len(t) and t[j] in " \t\n\r\x0b\f":
                j += 1
            kind += [("after", i)] * (j - i)
        else:
            kind.append(("in", 0))
            j = i + 1
        i = j
    i = 0
    while i < len(t):
        j = i
        while j < len(t) and t[j] == t[i]:
            j += 1
        if t[i] == "\0" or t[i] == "\n" and j - i > 1:
            kind[i:j] = [(k, t[i], i) for k in kind[i:j]]
        i = j
    out = []
    for c, k, was in zip(t, kind, [None, *kind], strict=False):
        if k == was:
            out[-1] += c
        else:
            out.append(c)
    pieces = []
    for x in out:
        while len(x) > texts.SPAN_CHARS:
            blanks = [i + 1 for i in range(texts.SPAN_CHARS // 2, texts.SPAN_CHARS) if x[i] in " \t\n\r\x0b\f"]
            n = blanks[-1] if blanks else texts.SPAN_CHARS
            pieces.append(x[:n])
            x = x[n:]
        pieces.append(x)
    return pieces


def test_span_catalogue_covers_every_text(spark):
    r = random.Random(3)
    whole = ["", None, "a", "x" * 5000, "word " * 900, "One. Two! Three?\n\n\nFour\0\0five.  ", "é日本. " * 400]
    whole += ["a\uf8ff. \uf8fe1\uf8fe0 b\uf8ff" + "\uf8fe" * 1300, ".\n\n\n!  \0", ". \n\nx\n"]
    whole += ["".join(r.choice(["ab", " ", ". ", "\n\n", "\0", "c" * 700, "! "]) for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(whole)), "doc_id long, text string")
    found = texts.spans(df)
    by = {}
    for x in found.collect():
        by.setdefault(x.doc_id, []).append((x.pos, x.start, x.finish, x.text))
    for d, t in enumerate(whole):
        assert "".join(x[3] for x in sorted(by.get(d, []))) == (t or "")
        assert all(0 < b - a <= texts.SPAN_CHARS and (t or "")[a:b] == x for _, a, b, x in by.get(d, []))
    faults = {x.doc_id: x.faults for x in texts.catalogue_faults(found, df).collect()}
    assert set(faults.values()) == {0}
    # Against a scan character by character.
    for d, t in enumerate(whole):
        assert [x[3] for x in sorted(by.get(d, []))] == scanned(t or ""), d
    moved = {x.doc_id: x.faults for x in texts.catalogue_faults(found.withColumn("span_id", F.when(F.col("pos") == 0, "ss1:x").otherwise(F.col("span_id"))), df).collect()}
    assert set(moved.values()) == {1}
    broken = {x.doc_id: x.faults for x in texts.catalogue_faults(found.where("doc_id <> 5 or pos <> 1"), df).collect()}
    assert broken[5] > 0
    merged = texts.merged_ranges(spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 12, 14), (2, 3, 4)], "doc_id long, start int, finish int"))
    assert sorted(map(tuple, merged.collect())) == [(1, 0, 9, 2), (1, 12, 14, 1), (2, 3, 4, 1)]


def test_pacing_stream_equals_the_batch(spark, tmp_path):
    rows = [(k, float(t), 100 * k + t) for k in range(3) for t in (0, 0, 1, 1, 1, 5, 6, 20)]
    source = spark.createDataFrame(rows, "key long, t double, event_id long").distinct()
    source.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = pacing.token_bucket(spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in"), 0.5, 2.0)
    query = stream.writeStream.format("memory").queryName("grants").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("grants").collect())) == sorted(map(tuple, pacing.token_bucket_batch(source, 0.5, 2.0).collect()))


def test_record_readers(spark, tmp_path):
    rule = "--------------------------------------------------------"
    (tmp_path / "j.txt").write_text(f"{rule}\nNlmId: 1\nJournalTitle: A: b\nISSN (Print): 1\nMedAbbr: x\nMedAbbr: y\n{rule}\nNlmId: 2\nISSN (Print): 2\n{rule}\nJournalTitle: no id\n{rule}\n")
    got = [x.fields for x in tables.nlm_records(spark, str(tmp_path / "j.txt")).collect()]
    assert got == [{"NlmId": "1", "JournalTitle": "A: b", "ISSN (Print)": "1", "MedAbbr": "y"}]
    (tmp_path / "c.csv").write_text('id,title\n1,"a, ""b"""\n')
    assert [tuple(x) for x in tables.csv_records(spark, str(tmp_path / "c.csv")).collect()] == [("1", 'a, "b"')]


def test_kappa_edges(spark):
    from folioscope.operators.ledger import kappa

    same = kappa(spark.createDataFrame([(1, 1)] * 3, "a int, b int"), "a", "b").first()
    none = kappa(spark.createDataFrame([], "a int, b int"), "a", "b").first()
    assert (same.items, same.agreement, same.kappa) == (3, 1.0, 1.0) and (none.items, none.agreement, none.kappa) == (0, None, None)


def test_orphan_candidates(spark):
    from difflib import SequenceMatcher

    from folioscope.operators import links

    r = random.Random(5)
    names = ["Miller", "Muller", "Smith", "Smyth", "Jones", "", "Garcia", "Garzia"]
    refs = [(d, n, r.choice(names), r.choice([1999, 2000, 2001, None])) for d in range(12) for n in range(6)]
    lost = sorted({(d, r.choice(names), r.choice([1999, 2000])) for d in range(13) for _ in range(3)})
    got = sorted(map(tuple, links.orphan_candidates(spark.createDataFrame(lost, "doc_id long, surname string, year int"), spark.createDataFrame(refs, "doc_id long, ref_number int, surname string, year int")).collect()))
    want = []
    for d, s, y in lost:
        scored = []
        for e, n, t, z in refs:
            if e == d:
                ratio = SequenceMatcher(None, s.lower(), t.lower()).ratio()
                term = 1.0 if y == z else 0.6 if z and abs(z - y) <= 1 else 0.2
                scored.append((-round(0.7 * ratio + 0.3 * term + 1e-12, 3), n))
        want += [(d, s, y, n, -v, i) for i, (v, n) in enumerate(sorted(x for x in scored if -x[0] >= 0.5)[:5], 1)]
    assert [x[:4] + x[5:] for x in got] == [x[:4] + x[5:] for x in sorted(want)]


def test_uncited_candidates(spark):
    from folioscope.operators import links

    claims = spark.createDataFrame([(1, "a", "As Millr said"), (1, "b", "Nothing here"), (1, "c", "Miller and Miler"), (2, "d", "Miller")], "doc_id long, claim_id string, sentence string")
    gone = spark.createDataFrame([(1, 7, "Miller"), (1, 8, "Li"), (2, 9, None)], "doc_id long, ref_number int, surname string")
    got = [(x.doc_id, x.ref_number, x.claim_id, x["rank"]) for x in links.uncited_candidates(gone, claims).orderBy("rank").collect()]
    assert got == [(1, 7, "c", 1), (1, 7, "a", 2)]


def test_similarity_is_that_of_sequence_matcher_and_computed_once(spark):
    from difflib import SequenceMatcher

    from folioscope.operators import links

    r = random.Random(9)
    word = lambda letters, most: "".join(r.choice(letters) for _ in range(r.randrange(most)))
    pairs = [(word("abc", 14), word("abcd", 14)) for _ in range(2000)] + [(word("aábé😀", 48), word("aábé😀", 48)) for _ in range(300)]
    assert links.ratios(*map(list, zip(*pairs, strict=True))).tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert links.ratios([], []).tolist() == []
    lost, refs = spark.createDataFrame([(1, "Milr", 2000), (1, "Mi" * 200, 2000)], "doc_id long, surname string, year int"), spark.createDataFrame([(1, 1, "Miller", 2000), (1, 2, "Mi" * 150 + "ller", 2000)], "doc_id long, ref_number int, surname string, year int")
    found = links.orphan_candidates(lost, refs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("EvalPython") == 1
    for x in found.collect():
        other = {1: "miller", 2: "mi" * 150 + "ller"}[x.ref_number]
        assert abs(x.score - (0.7 * SequenceMatcher(None, x.surname.lower(), other).ratio() + 0.3)) < 1e-3
