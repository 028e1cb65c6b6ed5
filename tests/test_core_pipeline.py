import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from veilstone.operators import actions, alias, audit, dedupe, direct, judge, masking, metrics, packed, retrieval, roster
from veilstone.sources import mailfiles, opinions, sinks, synthetic, tables
from veilstone.streaming import scan


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_one_per_key(spark):
    rows = [(1, "a", 2), (1, "b", 1), (2, "c", None), (None, "d", 1), (None, "e", 0), (3, None, 1)] + [(9, "hot", 5)] * 500
    df = frame(spark, rows, "k int, v string, t int")
    for few in (500_000, 0):
        got = {(r.k, r.v) for r in dedupe.one_per_key(df, "k", ["v"], "t", few).collect()}
        assert got == {(1, "b"), (2, "c"), (None, "e"), (3, None), (9, "hot")}
    assert dedupe.one_per_key(df.filter("false"), "k", ["v"]).count() == 0


# -- packed fields

def entries(text, known=(), commas=True):
    return packed.Segmenter(list(known), commas).entries(text)


def test_headers_are_cut_into_entries():
    assert entries("'Nailov, Harriet'; Dan Lee </O=X/CN=DLEE>; Ann Hill <ann@x.org>; b@x.org; \"Moss, C.\"") == [("Nailov, Harriet", ""), ("Dan Lee", ""), ("Ann Hill", "ann@x.org"), ("", "b@x.org"), ("Moss, C.", "")]
    assert entries("Lee, Ann </O=X/CN=ALEE>,Hill, Bob R </O=X/CN=BHILL> , cy moss <cy@x.org>") == [("Lee, Ann", ""), ("Hill, Bob R", ""), ("cy moss", "cy@x.org")]
    assert entries("a@x.org b@x.org <c@x.org>") == [("", "a@x.org"), ("", "b@x.org"), ("", "c@x.org")]
    assert entries("a@x.org <A@x.org>") == [("", "a@x.org")]
    assert entries("Bob Lee/HOU/X@X\n<c@x.org>") == [("Bob Lee", ""), ("", "c@x.org")]
    assert entries("Lee, Ann, Hill, Bob") == [("Lee, Ann", ""), ("Hill, Bob", "")]
    assert entries("Ann Lee, Bob Hill") == [("Ann Lee", ""), ("Bob Hill", "")]
    assert entries("Acme Group, Inc., Ann Lee") == [("Acme Group, Inc.", ""), ("Ann Lee", "")]
    assert entries("Lee Group, North", ["lee group, north"]) == [("Lee Group, North", "")]
    assert entries("undisclosed-recipients:;") == entries(";") == entries(" ") == entries(None) == []


def test_cut_lists_are_joined_again():
    cut = ['"Lee', 'Ann" <ann@x.org>; SMTP:b@x.org', None, '"Hill; Bob (HOU)" <bob@x.org>', "Undisclosed recipients"]
    assert [a or n for n, a in entries(packed.joined(cut), commas=False)] == ["ann@x.org", "b@x.org", "bob@x.org"]
    assert packed.joined(None) is None and packed.joined([]) is None


def test_unpack_keeps_positions_and_ignores_other_columns(spark):
    df = frame(spark, [(1, ["a@x.org; b@x.org"], "Lee, Ann; a@x.org", "x"), (2, None, None, "y"), (3, [], "", "z"), (1, ["a@x.org; b@x.org"], "Lee, Ann; a@x.org", "x")], "k int, to array<string>, x string, pos string")
    got = [(r.k, r.hdr, r.pos, r.name, r.address) for r in packed.unpack(df, "k", ["to"], ["x"]).collect()]
    assert sorted(set(got)) == [(1, "to", 1, "", "a@x.org"), (1, "to", 2, "", "b@x.org"), (1, "x", 1, "Lee, Ann", ""), (1, "x", 2, "", "a@x.org")] and len(got) == 8
    assert packed.unpack(df.filter("false"), "k", ["to"], ["x"]).count() == 0
    long = ", ".join(f"Ann{i} Lee" for i in range(3000))
    assert packed.unpack(frame(spark, [(1, long)], "k int, x string"), "k", [], ["x"]).count() == 3000


# -- retrieval

def test_bm25_ranks_and_ties(spark):
    df = frame(spark, [(1, "red fox"), (2, "red red fox den"), (3, None), (4, "blue"), (5, "red fox")], "doc_id int, text string")
    got = [(r.id, r.rank) for r in retrieval.top(retrieval.bm25(df, {"red": 1.0, "den": 1.0}, "doc_id", "text"), 10).collect()]
    assert [i for i, _ in got] == [2, 1, 5] and [r for _, r in got] == [1, 2, 3]
    assert retrieval.bm25(df, {}, "doc_id", "text").count() == 0 and retrieval.bm25(df.filter("false"), {"red": 1.0}, "doc_id", "text").count() == 0
    many = retrieval.bm25_many(df, frame(spark, [("q", "red"), ("q", "den")], "query string, term string"), "doc_id", "text")
    single = {r.id: r.score for r in retrieval.bm25(df, {"red": 1.0, "den": 1.0}, "doc_id", "text").collect()}
    assert {r.id: r.score for r in many.collect()} == pytest.approx(single)


def shuffled_rows(plan):
    """The most rows that any exchange of an executed plan has written."""
    while "QueryStage" in plan.nodeName() or plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.plan() if "QueryStage" in plan.nodeName() else plan.executedPlan()
    rows = plan.metrics().get("shuffleRecordsWritten")
    below = plan.children()
    return max([rows.get().value() if rows.isDefined() else 0, *(shuffled_rows(below.apply(i)) for i in range(below.size()))])


def test_corpus_ranks_without_a_table_of_pairs(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    words = [f"{a}{b}word" for a in "abcd" for b in "vwxyz"]
    rows = [(2 * k + (half == "b"), f"cl-{k}", half, " ".join(w for i, w in enumerate(words) for _ in range(1 + (k * (i + 1) + (half == "b")) % 7))) for k in range(200) for half in "ab"]
    frame(spark, rows, "opinion_id long, subject_id string, half string, message string").write.parquet(str(tmp_path / "opinions.parquet"))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW opinions AS SELECT * FROM read_parquet('{tmp_path}/opinions.parquet/*.parquet')")
        want = c.execute(entry.oracle_sql()["score_corpus_mrr"]).fetchall()
    got = entry.queries()["score_corpus_mrr"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == want
    assert 0 < shuffled_rows(got._jdf.queryExecution().executedPlan()) < 200 * 398 // 4  # every query meets every document


def test_best_ranks_equal_the_full_ranking(spark):
    texts = ["red fox", "red red fox den", "red", "red fox", "red blue", None, "red den den", "red fox den blue", "red red"]
    docs = frame(spark, [(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    queries = frame(spark, [("p", "red"), ("p", "den"), ("q", "fox"), ("q", "blue"), ("r", "den"), ("s", "red")], "query string, term string")
    marked = frame(spark, [("p", "d1", False), ("p", "d2", True), ("p", "d4", True), ("q", "d3", True), ("r", "d0", True), ("r", "d5", True), ("s", "d8", True), ("s", "d7", False)], "query string, id string, target boolean")
    kept = retrieval.bm25_many(docs, queries, "doc_id", "text").join(marked.filter("not target"), ["query", "id"], "left_anti").collect()
    targets, want = {(m.query, m.id) for m in marked.collect() if m.target}, {}
    for query in "pqrs":
        order = sorted((-r.score, r.id) for r in kept if r.query == query)
        found = [(i, n) for n, (_, i) in enumerate(order, 1) if (query, i) in targets]
        want |= {query: found[0]} if found else {}
    assert set(want) == {"p", "q", "s"}
    for slices, blocks in ((1_000_000, 16_384), (3, 1)):
        got = retrieval.best_ranks(docs, queries, marked, "doc_id", "text", slices, blocks)
        assert {r.query: (r.id, r.rank) for r in got.collect()} == want


def test_ranks_of_scores_that_round_to_nothing():
    import pyarrow as pa

    postings = pa.table({"term": ["x", "x", "y"], "id": ["b", "c", "a"], "part": [1e-8, 1e-8, 1e-8]})
    asks = pa.table({"query": ["q"], "terms": [["x"]], "id": ["c"], "score": [0.0]})
    assert retrieval._ahead(postings, asks).to_pylist() == [{"query": "q", "ahead": 1}]
    assert retrieval._ahead(postings.slice(0, 0), asks).to_pylist() == [{"query": "q", "ahead": 0}]


def test_fusion(spark):
    a = frame(spark, [(1, 9.0, 1), (2, 5.0, 2)], "id int, score double, rank int")
    b = frame(spark, [(2, 0.9, 1), (3, 0.1, 2)], "id int, score double, rank int")
    r = {x.id: x.score for x in retrieval.rrf(a, b).collect()}
    assert r == {x.id: x.score for x in retrieval.rrf(b, a).collect()}
    assert r[2] == pytest.approx(1 / 62 + 1 / 61, abs=1e-8) and max(r, key=r.get) == 2
    m = {x.id: x.score for x in retrieval.min_max(a, b, (3, 1)).collect()}
    assert m == {1: 0.75, 2: 0.25, 3: 0.0}
    with pytest.raises(ValueError):
        retrieval.discover(a, "x", fusion="best")


def test_knn_skips_what_has_no_direction(spark):
    df = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0])], "vec_id int, embedding array<float>")
    assert {r.id: r.score for r in retrieval.knn(df, [1.0, 1.0]).collect()} == pytest.approx({1: 0.707107, 2: 0.707107})


# -- direct search, judgment, actions

DOCS = [("1", "Ask Allen at a.allen@x.org", "bob@x.org", ["a.allen@x.org", "cy@x.org"]), ("2", "nothing here", "Allen Lee <q@x.org>", None), ("3", "other allen. call 212-555-0147", None, []), ("4", None, None, None)]
SCHEMA = "_id string, message string, sender string, to array<string>"


def test_direct_search_redaction_and_read_back(spark):
    df = frame(spark, DOCS, SCHEMA)
    ev = direct.discover_direct(df, [("name", "Allen"), ("email", "a.allen@x.org")], index="mail").orderBy("doc_id").collect()
    assert [(e.doc_id, e.is_identifiable) for e in ev] == [("1", True), ("2", True), ("3", True)]
    assert ev[0].identifying_snippets == ["Allen", "a.allen@x.org"] and ev[2].identifying_snippets == ["allen", "212-555-0147"]
    assert [(f.field, f.matched) for f in ev[1].identifying_fields] == [("sender", "Allen")]
    assert direct.discover_direct(df, []).count() == 0
    kept = judge.filter_flagged(spark.createDataFrame(ev, direct.EVALUATION), "strict")
    plan = actions.action_plan(kept, "redact_in_place")
    out = {r._id: r for r in actions.apply_redaction(df, plan, fields=["sender", "to"]).collect()}
    assert out["1"].message == "Ask [GDPR_REDACTED] at [GDPR_REDACTED]"
    assert out["1"].to == ["[GDPR_REDACTED]", "cy@x.org"] and out["2"].sender == "[GDPR_REDACTED]" and out["4"].message is None
    assert all(r.ok for r in actions.read_back(actions.apply_redaction(df, plan), plan).collect())
    gone = actions.hard_delete(df, actions.action_plan(kept, "hard_delete"))
    assert [r._id for r in gone.collect()] == ["4"]
    lines = [r.line for r in actions.remediation_script(actions.action_plan(kept, "hard_delete")).collect()]
    assert lines[0] == "#!/bin/sh" and sum(x.startswith("curl -sS --fail -X DELETE") for x in lines) == 3


EV = "doc_id string, index string, is_identifiable boolean, confidence_score double, identifying_snippets array<string>, identifying_fields array<struct<field:string,value:string,matched:string,type:string>>"


def test_two_indexes_may_share_an_id(spark):
    docs = frame(spark, [("1", "m", "Ann Hill, 555", "Ann <a@x>"), ("1", "o", "Ann Hill, 555", "Ann <a@x>"), ("2", "m", "Ann", None)], "_id string, _index string, message string, sender string")
    direct_ = frame(spark, [("1", "m", True, 1.0, ["Ann"], [("sender", "Ann <a@x>", "Ann", "name")])], EV)
    indirect = frame(spark, [("1", "m", True, 0.9, ["Hill, 555", "Ann"]), ("2", "o", True, 0.8, None)], EV.rsplit(",", 2)[0].rsplit(", identifying_fields", 1)[0])
    both = actions.union_flagged(direct_, indirect)
    got = {(r["index"], r.doc_id): r for r in both.collect()}
    assert set(got) == {("m", "1"), ("o", "2")} and got["m", "1"].confidence_score == 1.0
    assert set(got["m", "1"].identifying_snippets) == {"Ann", "Hill, 555"} and len(got["m", "1"].identifying_fields) == 1 and got["o", "2"].identifying_snippets == []
    for plan in (actions.action_plan(both, "redact_in_place"), actions.action_plan(direct_, "redact_in_place").unionByName(actions.action_plan(indirect, "redact_in_place"))):
        out = actions.apply_redaction(docs, plan, fields=["sender"])
        after = {(r._index, r._id): (r.message, r.sender) for r in out.collect()}
        assert after == {("m", "1"): ("[GDPR_REDACTED] [GDPR_REDACTED]", "[GDPR_REDACTED]"), ("o", "1"): ("Ann Hill, 555", "Ann <a@x>"), ("m", "2"): ("Ann", None)}
        checked = {(r["index"], r.doc_id): r.ok for r in actions.read_back(out, plan, fields=["sender"]).collect()}
        assert checked == {("m", "1"): True, ("o", "2"): False}
        assert not actions.read_back(docs, plan, fields=["sender"]).filter("ok").count()
    left = actions.hard_delete(docs, actions.action_plan(both, "hard_delete"))
    assert {(r._index, r._id) for r in left.collect()} == {("o", "1"), ("m", "2")}
    assert {r.ok for r in actions.read_back(left, actions.action_plan(both, "hard_delete")).collect()} == {True}


def test_the_script_is_valid_shell_and_stays_in_its_lines(spark, tmp_path):
    import json
    import subprocess

    rows = [("a\nrm -rf x'$(id)", "m", True, 1.0, ["it's \"5\"\nJSON"], [("sender", "Ann", None, "name")]), ("b", "m", True, 1.0, [], None)]
    plan = actions.action_plan(frame(spark, rows, EV), "redact_in_place")
    lines = [r.line for r in actions.remediation_script(plan).collect()]
    (tmp_path / "s.sh").write_text("\n".join(lines) + "\n")
    assert subprocess.run(["sh", "-n", str(tmp_path / "s.sh")]).returncode == 0
    assert not [x for line in lines for x in line.split("\n") if x.startswith("rm ")] and sum("--fail -X POST" in x for x in lines) == 2
    bodies = [json.loads(x.split("\n")[1])["script"] for x in lines if "/_update/" in x]
    assert bodies[0]["params"]["snippets"] == ["it's \"5\"\nJSON"] and bodies[1]["params"]["fields"] == {"sender": ["Ann"]} and all(b["source"] for b in bodies)
    seen = actions.request_preview(plan).first()
    assert seen.path.endswith("_update_by_query") and json.loads(seen.body)["script"]["params"]["snippets"] == ["it's \"5\"\nJSON"] and seen.documents == 2
    assert actions.request_preview(plan.filter("false")).count() == 0


def test_sequential_literal_redaction(spark):
    df = frame(spark, [("Boyd Van Gordon v Gordon, gordon", ["Van Gordon", "Gordon"])], "t string, s array<string>")
    assert df.select(actions.redact_text(F.col("t"), F.col("s"), "[R]").alias("x")).first().x == "Boyd [R] v [R], gordon"


@pytest.mark.parametrize("mode, least", [("strict", 0.88), ("balanced", 0.75), ("high_recall", 0.60), ("unknown", 0.60), (None, 0.60)])
def test_modes(mode, least):
    assert judge.threshold_for(mode) == least


def test_filter_details(spark):
    rows = [("a", True, "0.9", ["ok", None, ""]), ("b", True, "0.70", []), ("c", False, "0.99", []), ("d", True, "often", []), ("e", None, None, [])]
    df = frame(spark, rows, "doc_id string, is_identifiable boolean, confidence_score string, identifying_snippets array<string>")
    got = judge.filter_flagged(df, "balanced").collect()
    assert [(r.doc_id, r.identifying_snippets) for r in got] == [("a", ["ok"])]
    cands = frame(spark, [("a", "old", 1), ("a", "new", 2)], "doc_id string, text string, timestamp int")
    assert judge.filter_flagged(df, "balanced", cands).first().text == "new"


def test_legal_hold(spark):
    df = frame(spark, [("1", "hold-2024"), ("2", "logs-a")], "doc_id string, index string")
    assert [(r.doc_id, r.pattern) for r in actions.hold_violations(df, ["x*", "hold-20[12]?"]).collect()] == [("1", "hold-20[12]?")]
    with pytest.raises(actions.LegalHold):
        actions.assert_not_on_hold(df, ["*"])
    actions.assert_not_on_hold(df, [])


def test_audit_chain(spark, tmp_path):
    for i in range(4):
        audit.write_certificate(audit.build_record("redact", [str(i)], "#!/bin/sh"), tmp_path)
    (tmp_path / "erasure-broken.json").write_text("{")
    entries = audit.load_certificates(spark, str(tmp_path))
    assert audit.verify_chain(entries).first().intact and entries.count() == 4 and entries.first().prev_hash == audit.GENESIS
    path = tmp_path / "erasure-00000002.json"
    record = json.loads(path.read_text())
    record["count"] = 99
    path.write_text(json.dumps(record))
    bad = audit.verify_chain(audit.load_certificates(spark, str(tmp_path))).first()
    assert (bad.intact, bad.broken_at) == (False, 2)


# -- roster, aliases, masking

MAIL = [
    (1, "ann.lee@h.example", ["bob.hill@h.example"], None, "Lee, Ann </O=H/CN=ALEE>", "Bob Hill </O=H/CN=BHILL>", None, "lee", "2001-01-01 00:00:00"),
    (2, "bob.hill@h.example", ["ann.lee@h.example", "ann.lee@h.example", "cy@o.example"], ["ann.lee@h.example"], "Bob Hill </O=H/CN=BHILL>", "Lee, Ann </O=H/CN=ALEE>", None, "hill", "2001-02-01 00:00:00"),
    (3, "ann.lee@h.example", ["ann.lee@h.example"], [], "Annie Lee </O=H/CN=ALEE>", None, "", "lee", None),
]


def mail(spark):
    return frame(spark, MAIL, "mail_id int, mail_from string, mail_to array<string>, cc array<string>, x_from string, x_to string, x_cc string, custodian string, ts string").withColumn("ts", F.to_timestamp("ts"))


def test_roster(spark):
    people = roster.participants(mail(spark))
    e = {r.address: r for r in roster.entries(people, "h.example").collect()}
    ann = e["ann.lee@h.example"]
    assert (ann.message_count, ann.sent_count, ann.received_count, ann.internal) == (3, 2, 1, True)
    assert ann.display_name_variants == ["Annie Lee", "Lee, Ann"] and ann.exchange_logins == ["alee"] and ann.distinct_correspondents == 2
    assert [(c.address, c.messages) for c in ann.top_correspondents] == [("bob.hill@h.example", 2), ("cy@o.example", 1)]
    assert not e["cy@o.example"].internal and e["cy@o.example"].display_name_variants == []
    df = roster.entries(people, "h.example")
    assert roster.usable(df, 2).count() == 2 and roster.go_no_go(roster.coverage(df, 3, 2), 2).first().decision == "go"
    counts = frame(spark, [(i,) for i in range(1, 11)], "n bigint")
    p = roster.percentiles(counts, "n").first()
    assert (p.p50, p.p90) == (5, 9) and roster.percentiles(counts.filter("false"), "n").first().p50 == 0
    assert {r.bucket: r.people for r in roster.histogram(counts, "n").collect()} == {"1": 1, "2-4": 3, "5-9": 5, "10-49": 1, "50+": 0}


def test_alias_set_masks_broadly_and_labels_narrowly(spark):
    rows = [("ann.lee@h.example", ["Lee, Ann"], ["alee"]), ("ann@o.example", ["lee, ann"], []), ("ann.moss@h.example", ["Ann Moss"], [])]
    df = frame(spark, rows, "address string, display_name_variants array<string>, exchange_logins array<string>")
    got = {r.variant: r.is_label for r in alias.alias_set(df, "ann.lee@h.example").collect()}
    assert got["Ann"] is False and got["Lee, Ann"] is True and got["alee"] is True and got["ann@o.example"] is True
    assert [(r.variant, r.is_label) for r in alias.alias_set(df, "x@y.example").collect()] == [("x@y.example", True)]


def test_masking_and_gate(spark):
    pattern = alias.build_pattern(["Ann Lee", "Lee", "A. Lee"])
    rows = [("1", "Ask ANN LEE and  Lee; not Leeds, éLee", None), ("2", "plain", None), ("3", None, None)]
    df = frame(spark, rows, "_id string, message string, ts timestamp")
    corpus = masking.masked_corpus(df, pattern, pattern)
    out = {r.original_id: r for r in corpus.collect()}
    assert (out["1"].message, out["1"].hits, out["1"].label_hits) == ("Ask and ; not Leeds, éLee", 2, 2) and out["3"].message == ""
    gate = masking.audit(corpus.select("_id", "message", "ts"), pattern).first()
    assert gate.passed and gate.documents == 3
    assert not masking.audit(df.select(F.lit("plain-id").alias("_id"), "message", "ts"), pattern).first().passed
    assert not masking.audit(corpus.select("_id", "message", F.lit("x").alias("subject")), pattern).first().passed
    assert masking.verify_positives(masking.positives(corpus), df, pattern).first().confirmed == 1
    assert masking.alias_failures([], []) and masking.alias_failures(None, None) == [] and not masking.alias_failures(["a"], ["a"])
    with pytest.raises(masking.NotScorable):
        masking.assert_scorable({"masked_index": "a", "audit": {"passed": False}}, "a")
    with pytest.raises(ValueError):
        masking.audit(corpus, pattern, phone_policy="none")


# -- measures

def test_measures(spark):
    w = frame(spark, [(24, 76), (0, 0)], "h int, n int").select(metrics.wilson(F.col("h"), F.col("n")).alias("w")).collect()
    assert [(x.w.low, x.w.high) for x in w] == [(22.2, 42.7), (0.0, 0.0)]
    s = frame(spark, [(24, 14, 76), (60, 5, 76)], "a int, b int, n int").select(metrics.separable(F.col("a"), F.col("b"), F.col("n")).alias("s")).collect()
    assert [x.s for x in s] == [False, True]
    ranked = frame(spark, [("a", 1), ("b", 2), ("c", 3), ("d", 4)], "doc_id string, rank int")
    r = metrics.recall_at_k(ranked, frame(spark, [("c",), ("z",)], "doc_id string"), [2, 4]).orderBy("k").collect()
    assert [(x.found, x.percent) for x in r] == [(0, 0.0), (1, 50.0)]
    ranks = frame(spark, [("p", 1), ("q", 2), ("r", None)], "subject string, rank int")
    assert metrics.mean_reciprocal_rank(ranks).first().mrr == 0.5
    assert metrics.hit_rate_at_k(ranks, [1]).first().percent == 33.3
    none = frame(spark, [], "doc_id string")
    p = metrics.precision_recall(none, none, 10).first()
    assert p.precision is None and p.recall is None
    assert metrics.extend_ks([50, 10, 10], 76) == [10, 50, 76]
    assert len(metrics.build_profiles(["a", "b"])) == 3 and metrics.build_profiles([]) == []
    runs = frame(spark, [("hybrid", 1, 4.0, 300), ("hybrid", 50, 50.0, 300), ("bm25_only", 1, 26.7, 300), ("bm25_only", 50, 50.3, 300)], "mode string, k int, percent double, of int")
    v = metrics.compare_modes(runs, 50).first()
    assert (v.lead, v.shape, v.widest_k) == ("level", "convergence", 1)


# -- sources and streams

def test_maildir(spark, tmp_path):
    box = tmp_path / "lee" / "inbox" / "sub"
    box.mkdir(parents=True)
    (box / "1.").write_bytes(b"From: Ann <ann@x.org>\r\nTo: b@x.org, c@x.org\r\nSubject: Plan\r\nDate: Mon, 1 Jan 2001 10:00:00 -0600\r\nX-From: Ann\r\n\r\nHello\r\nthere\r\n")
    (box / "2.").write_bytes(b"From: nobody\r\n\r\n")
    mails, skipped = mailfiles.read_maildir(spark, str(tmp_path))
    m = mails.first()
    assert (m._id, m.custodian, m.folder, m.message, m.mail_to) == ("lee/inbox/sub/1", "lee", "inbox/sub", "Plan. Hello\nthere", ["b@x.org", "c@x.org"])
    assert m.ts.hour == 16 and skipped.count() == 1
    assert mailfiles.read_maildir(spark, str(tmp_path), custodians=["nobody"])[0].count() == 0


def test_opinion_documents(spark, tmp_path):
    body = "The plaintiff Smith saw the defendant. " * 40
    (tmp_path / "o.csv").write_text("id,cluster_id,plain_text,html\n1,c1,,\"<p>" + body + "</p>\"\n2,c2," + body + ",\n3,c1,short,\n")
    rows = opinions.select_opinions(opinions.read_csv(spark, str(tmp_path / "o.csv")))
    assert [r.id for r in rows.orderBy("id").collect()] == ["1", "2"]
    caps = frame(spark, [("c1", "John Smith v. State")], "cluster_id string, caption string")
    docs, drops = opinions.build_documents(rows, caps)
    got = docs.orderBy("_id").collect()
    assert [d._id for d in got] == ["1-a", "1-b"] and all("Smith" not in d.message for d in got)
    assert {r["drop"]: r.opinions for r in drops.collect()} == {"no_caption": 1}


def test_synthetic_and_sinks(spark, tmp_path):
    a, b = synthetic.noise(spark, 50), synthetic.noise(spark, 50)
    assert a.exceptAll(b).count() == 0 and a.select("_id").distinct().count() == 50
    sinks.write_collection(a, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 50
    (tmp_path / "x.json").write_text("[1]")
    assert sinks.read_json_arg("[1]") == sinks.read_json_arg(f"@{tmp_path}/x.json") == [1]


def test_streams(spark, tmp_path):
    frame(spark, [("1", "a@b.org and 212-555-0147"), ("2", "none")], "_id string, message string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("_id string, message string").parquet(str(tmp_path / "in"))
    got = []
    query = scan.each_batch(scan.redact_stream(stream), lambda df, _: got.extend(r.message for r in df.collect()), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert sorted(got) == ["[GDPR_REDACTED] and [GDPR_REDACTED]", "none"]


def test_header_scan_never_reads_messages(spark, data_dir):
    from veilstone.plans import people

    plan = people.people(spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    scan_line = [x for x in plan.splitlines() if "ReadSchema" in x]
    assert scan_line and all("message:" not in x for x in scan_line)


def test_entry_and_registered_queries(spark, data_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_addresses_by_the_rules_of_mail(spark):
    assert roster.parse_addresses(['"Allen', 'Phillip K" <P.Allen@x.org>', '"bo@x.org" <bo@x.org>', None]) == [("Allen, Phillip K", "p.allen@x.org"), ("", "bo@x.org")]
    assert roster.parse_addresses("<<broken a@x.org> and a@x.org") and roster.parse_addresses(None) == [] and roster.parse_addresses("no address") == []
    df = frame(spark, [(1, "Ann <a@x.org>", ["b@x.org"]), (2, None, None), (3, "", [])], "mail_id long, mail_from string, mail_to array<string>")
    got = {(r.mail_id, r.field, r.pos, r.name, r.address) for r in roster.address_entries(df, "mail_id", ["mail_from", "mail_to"]).collect()}
    assert got == {(1, "mail_from", 1, "Ann", "a@x.org"), (1, "mail_to", 1, "", "b@x.org")}
    assert roster.address_entries(df.filter("false"), "mail_id", ["mail_from"]).count() == 0


def test_loose_report_finds_names_inside_words(spark):
    df = frame(spark, [("Ann-Draväne", ), ("undravänely", ), ("nobody", ), (None, )], "message string")
    row = masking.loose_report(df, ["Draväne", "Ann"]).first()
    assert (row.documents, row.hits) == (2, 2)
    assert masking.loose_report(df, ["Ann"]).first().documents == 0


def test_fields_in_schemas():
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("a struct<b: array<struct<c: int>>>, d string")
    assert tables.has_field(schema, "a.b.c") and tables.has_field([StructType(), schema], "d")
    assert not tables.has_field(schema, "a.c") and not tables.has_field(schema, "d.e") and not tables.has_field([], "a")


def test_profiles_share_their_terms():
    built = metrics.build_profiles(["t1", "t2", "t3"])
    assert all(all(t in p["profile"] for t in ("t1", "t2", "t3")) for p in built) and {p["keywords"] for p in built} == {"t1 t2 t3"}
    assert len({p["profile"] for p in built}) == 3


def test_positives_in_prose_and_in_lists(spark):
    docs = frame(spark, [("1", "We asked Dravane to sign the lease before noon."), ("2", "To: Dravane; Hill; Moss; Lee"), ("3", None)], "doc_id string, text string")
    found = frame(spark, [("1",), ("1",), ("2",), ("3",), ("4",)], "doc_id string")
    got = {r.doc_id: (r.kind, r.digest is not None) for r in metrics.descriptive_split(found, docs, "Dravane", "X").collect()}
    assert got == {"1": ("descriptive", True), "2": ("list_only", False), "3": ("list_only", False), "4": ("list_only", False)}
    assert {r.doc_id for r in metrics.demo_positives(frame(spark, [("a", "subject"), ("b", "direct"), ("c", "decoy"), ("d", None)], "doc_id string, class string")).collect()} == {"a", "b"}
    basis = metrics.report_basis({"aliases": {"variants": ["x", "y"]}}, [10], metrics.build_profiles(["t"]))
    assert basis["mask_variants"] == 2 and basis["ks"] == [10] and len(basis["wordings"]) == 3


def test_duplicates_count_once_in_significant_terms(spark):
    rows = [("a", "zeta alpha beta"), ("b", "zeta alpha beta"), ("c", "zeta  alpha beta"), ("d", "zeta gamma"), ("e", "zeta delta"), ("f", "alpha"), ("g", "other words")]
    df = frame(spark, rows, "k string, t string")
    fg = df.filter("k in ('c', 'd', 'e')").select("k")
    unique = {r.term: (r.fg, r.bg) for r in retrieval.significant_terms(df, fg, "k", "t").collect()}
    assert unique == {"zeta": (3, 3)}
    every = {r.term: (r.fg, r.bg) for r in retrieval.significant_terms(df, fg, "k", "t", drop_duplicates=False).collect()}
    assert every == {"zeta": (3, 5)}
    assert retrieval.significant_terms(df.filter("false"), fg, "k", "t").count() == 0


def test_two_writers_never_fork_the_chain(spark, tmp_path):
    import threading

    threads = [threading.Thread(target=audit.write_certificate, args=(audit.build_record("redact", [{"index": "m", "doc_id": str(i)}], "#!/bin/sh"), tmp_path)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    files = sorted(p.name for p in tmp_path.iterdir())
    assert files == [f"erasure-{i:08d}.json" for i in range(8)]
    entries = [json.loads((tmp_path / f).read_text())["chain"] for f in files]
    assert [e["prev_hash"] for e in entries] == [audit.GENESIS, *(e["entry_hash"] for e in entries[:-1])]


def test_names_of_roster_entries(spark):
    df = frame(spark, [(["Ann"], ), (["Ann", "Hill,  Ann B"], ), (["Ann B Hill"], ), (["Hill,"], ), ([], )], "n array<string>")
    got = [(r.s, r.g) for r in df.select(roster.surname(F.col("n")).alias("s"), roster.given_name(F.col("n")).alias("g")).collect()]
    assert got == [("", ""), ("Hill", "Ann"), ("Hill", "Ann"), ("Hill", ""), ("", "")]


def test_labelled_demo_documents(spark):
    docs, key = synthetic.with_noise(spark, 20)
    assert docs.count() == 20 + key.count() and docs.select("_id").distinct().count() == docs.count()
    assert {r["class"]: r.documents for r in synthetic.ground_truth(key).collect()} == {"subject": 3, "direct": 2, "decoy": 4}
    assert key.filter("class = 'decoy'").select("decoy_category").distinct().count() == 4
    assert metrics.demo_positives(key).join(docs.withColumnRenamed("_id", "doc_id"), "doc_id").count() == 5


def test_stages_can_be_forgotten(spark):
    import os

    from veilstone import session

    session.forget_stages(spark)
    kept = session.written(spark.range(3))
    assert kept.count() == 3
    path = session._STAGES[-1].removeprefix("file://")
    assert os.path.exists(path) and session.forget_stages(spark) == 1 and not os.path.exists(path)


def test_counts_by_window(spark):
    df = frame(spark, [("2026-01-01 00:01:00", "email"), ("2026-01-01 00:04:00", "email"), ("2026-01-01 00:06:00", "phone")], "ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.kind, r.n) for r in scan.counts_by_window(df, "ts").collect()) == [("email", 2), ("phone", 1)]


def test_only_the_dictionary_keeps_some_values_whole(spark):
    # a firm whose name holds a comma looks like two values, unless it is known from a quoted entry elsewhere
    rows = [(1, None, '"Hall, Moss and Lee" <desk@x.example>'), (2, None, "Hall, Moss and Lee, Zed Corp"), (3, None, 'Anna Hill; "Roe; Doe (HOU)" <r@x.example>'), (4, None, "Roe; Doe (HOU); Bob Lee"), (5, None, None)]
    df = frame(spark, rows, "k long, to array<string>, x string")
    pairs = lambda **m: sorted((r.k, r.pos, r.name or r.address) for r in packed.unpack(df, "k", ["to"], ["x"], **m).collect() if r.k in (2, 4))
    known = [(2, 1, "Hall, Moss and Lee"), (2, 2, "Zed Corp"), (4, 1, "Roe; Doe (HOU)"), (4, 2, "Bob Lee")]
    assert pairs() == known and pairs(limit=1) == known  # broadcast and joined alike
    assert pairs(dictionary=[]) == [(2, 1, "Hall"), (2, 2, "Moss and Lee"), (2, 3, "Zed Corp"), (4, 1, "Roe"), (4, 2, "Doe (HOU)"), (4, 3, "Bob Lee")]
