import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from veilstone.functions import personal
from veilstone.functions import text as tx
from veilstone.operators import alias, captions, direct, suitability


def one(spark, expr, **values):
    return spark.createDataFrame([Row(**values)]).select(expr.alias("x")).first().x


def test_pii_scan(spark):
    found = [(p.kind, p.value) for p in one(spark, personal.scan(F.col("t")), t="Mail jane@x.org or 212-555-0147 from 10.0.0.1, ticket #4091, build 5.2, jane@x.org")]
    assert found == [("email", "jane@x.org"), ("ipv4", "10.0.0.1"), ("phone", "212-555-0147")]
    assert one(spark, personal.phone_signals(F.col("t")), t="212-555-0147 x4411, ext. 123, 212-555-0147") == 4
    assert spark.createDataFrame([Row(t=None)], "t string").select(personal.scan(F.col("t")).alias("x")).first().x == []


@pytest.mark.parametrize("text, hit", [("at 12:30:45", None), ("ratio 3:2", None), ("aa:bb:cc:dd:ee:ff", None), ("std::vector", None), ("host:8080", None), ("a :: b", None), ("fe80::1", "fe80::1"), ("::1 up", "::1"), ("2001:db8:0:0:0:0:0:1", "2001:db8:0:0:0:0:0:1"), ("2001:db8::8a2e", "2001:db8::8a2e")])
def test_ipv6_shapes(spark, text, hit):
    got = [p.value for p in one(spark, personal.scan(F.col("t")), t=text) if p.kind == "ipv6"]
    assert got == ([hit] if hit else [])


def test_verbatim_keeps_the_first_spelling(spark):
    assert one(spark, tx.find_verbatim(F.col("t"), F.lit("ALLEN")), t="see Allen and allen") == "Allen"
    assert one(spark, tx.find_verbatim(F.col("t"), F.lit("nobody")), t="see Allen") is None


def test_halves_bodies_and_lists(spark):
    h = one(spark, tx.split_halves(F.col("t")), t="A" * 300 + ". " + "B" * 300)
    assert (h.a, h.b) == ("A" * 300 + ".", "B" * 300)
    h = one(spark, tx.split_halves(F.col("t")), t="A" * 310 + ". " + "B" * 100)
    assert len(h.a) == 206
    assert one(spark, tx.clean_body(F.col("t"), 60, ("-----Original Message-----", "Forwarded by")), t="word " * 8 + "Forwarded by somebody else entirely") == "word " * 7 + "word"
    assert one(spark, tx.clean_body(F.col("t"), 12, ("Forwarded by", "xx")), t="one two three four") == "one two ..."
    assert one(spark, tx.split_list(F.col("t")), t=" a, ,b ,") == ["a", "b"]
    assert one(spark, tx.strip_tags(F.col("t")), t="<p>a</p>\n <b>b</b>") == "a b"
    assert one(spark, tx.url_path(F.col("t")), t="a/b c*~é") == "a%2Fb%20c%2A~%C3%A9"


def test_near_dup_key_collapses_white_space(spark):
    assert one(spark, tx.near_dup_key(F.col("t")) == tx.near_dup_key(F.lit("a  b\nc")), t=" a b c ")


def python_spans(text):
    pattern = suitability.REFERENCE[len("(?iuU)"):]
    out = []
    for m in re.finditer(pattern, text, re.I):
        if out and m.start() - out[-1][1] <= suitability.GAP:
            out[-1] = (out[-1][0], m.end())
        else:
            out.append(m.span())
    return out


def test_references_against_python(spark):
    texts = ["The analyst who approved it left. Our on-call engineer saw the person responsible.", "Disk full on node 4.", "To: Hill, Ann; Lee, Bob; Moss, Cy; the new engineer", None, ""]
    df = spark.createDataFrame([Row(k=i, t=t) for i, t in enumerate(texts)], "k int, t string")
    got = {(r.k, r.start, r.stop) for r in suitability.references(df, "k", "t").collect()}
    assert got == {(i, a, b) for i, t in enumerate(texts) if t for a, b in python_spans(t)}
    counts = {r.k: (r.prose, r.listed) for r in suitability.classified(df, "k", "t").collect()}
    assert counts[1] == counts[3] == counts[4] == (0, 0) and counts[2] == (0, 1) and counts[0][1] == 0


@pytest.mark.parametrize("density, band", [(21.0, "rich"), (0.2, "sparse"), (0.03, "absent")])
def test_bands(spark, density, band):
    assert one(spark, suitability.band(F.lit(density)), t=1) == band
    few = one(spark, F.size(suitability.reasons(F.lit(density), F.lit(0.05), F.lit(True), F.lit(3))), t=1)
    assert few == 3


def test_applicability_notes():
    assert "says nothing" in suitability.applicability("absent", 0) and "says nothing" not in suitability.applicability("rich", 0)


def test_two_list_profiles_differ(spark):
    t = "write to bob@acme.com soon"
    assert one(spark, suitability.is_list_context(F.col("t")), t=t) and not one(spark, suitability.is_list_context(F.col("t"), suitability.mention_headers("HOUSE")), t=t)
    assert one(spark, suitability.is_list_context(F.col("t"), suitability.mention_headers("HOUSE")), t="Ann Hill/OU/house@house")


def test_mentions_and_subject_ranking(spark):
    rows = [Row(k=1, t="I met Hill about the plan."), Row(k=2, t="I met  Hill about the plan."), Row(k=3, t="Hill found it."), Row(k=4, t="To: Hill, Ann; Lee, Bob; Moss, Cy"), Row(k=5, t=None)]
    df = spark.createDataFrame(rows, "k int, t string")
    p = suitability.profile(df, "k", "t", "Hill", "HOUSE").first()
    assert (p.documents, p.descriptive, p.list_only, p.distinct_descriptive) == (4, 3, 1, 2)
    r = suitability.rank_subjects(df, "k", "t", spark.createDataFrame([Row(surname="Hill"), Row(surname="Lee")]), "HOUSE").collect()
    assert [(x.surname, x.documents, x.descriptive, x.distinct_descriptive) for x in r] == [("Hill", 4, 3, 2), ("Lee", 1, 0, 0)]
    s = suitability.screen(df, "t", "Ann", "Hill").first()
    assert s.surname_hits == 4 and s.full_hits == 0 and not s.rejected


@pytest.mark.parametrize("caption, surnames", [
    ("John Smith v. State of Ohio", ["Smith"]), ("In re Jane Roe, a minor child", []), ("United States v. Acme Holdings, Inc.", []), ("James E. Gaines, United States of America v. Maria Lopez, et al.", ["Gaines", "Lopez"]),
    ("State, ex rel. Latonya Campbell v. Robert Jones, Jr.", ["Campbell", "Jones"]), ("", []), ("British Government General v. Li Wu", []),
])
def test_captions(spark, caption, surnames):
    df = spark.createDataFrame([Row(k=1, caption=caption)])
    got = [r.surname for r in captions.caption_parties(df, "k", "caption").orderBy("pos").collect() if r.surname]
    assert got == surnames


def test_alias_forms(spark):
    got = one(spark, alias.name_forms(F.col("t")), t="'Allen, Phillip K'")
    assert set(got) == {"Allen, Phillip K", "Phillip K Allen", "Phillip", "Allen", "Phillip Allen", "P Allen", "P. Allen", "PKA", "P.K.A."}
    assert one(spark, alias.name_forms(F.col("t")), t="Cher") == ["Cher"] and one(spark, alias.name_forms(F.col("t")), t=" ") == []
    assert set(one(spark, alias.login_forms(F.col("t")), t="ann.lee@x.org")) == {"ann.lee", "ann_lee", "annlee", "alee", "leea"}
    assert alias.build_pattern([]) is None


def test_naming_fields(spark):
    df = spark.createDataFrame([], "message string, user_name string, to array<string>, meta struct<owner:string,size:int>, tone string, note string")
    assert direct.naming_fields(df.schema, "message") == [("meta.owner", "string", True), ("to", "array", True), ("user_name", "string", True)]
    assert direct.normalize_identifiers(email=[" a@b.c ", ""], id=["7"], phone=None) == [("email", "a@b.c"), ("employee_id", "7")]


def test_scan_of_documents_reports_every_kind(spark, tmp_path):
    from veilstone.plans import people

    spark.createDataFrame([(1, "From 2001:db8::8a2e:370:7334 and 10.0.0.1 by a@b.example"), (2, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.kind, r.value) for r in people.pii_scan_long(spark, str(tmp_path)).collect()}
    assert got == {(1, "email", "a@b.example"), (1, "ipv4", "10.0.0.1"), (1, "ipv6", "2001:db8::8a2e:370:7334")}


def test_names_beyond_the_limit_give_the_same_values(spark):
    from veilstone.operators import packed

    rows = [(1, ["a@x.example"], '"Hill; Anna (HOU)" <a@x.example>'), (2, None, "Bob Lee; Hill; Anna (HOU); Cara Moss"), (3, None, '"Moss, Cara May Ann" <c@x.example>, "Lee, Bob" <b@x.example>'), (4, [None, "x"], "Moss, Cara May Ann, Lee, Bob"), (4, [None, "x"], "Moss, Cara May Ann, Lee, Bob"), (5, None, None)]
    df = spark.createDataFrame(rows, "k int, to array<string>, x string")
    few, many = (sorted(map(tuple, packed.unpack(df, "k", ["to"], ["x"], limit=n).collect())) for n in (100, 1))
    assert few == many and (2, "x", 2, "Hill; Anna (HOU)", "") in many and (4, "x", 1, "Moss, Cara May Ann", "") in many


def test_names_beyond_the_limit_do_not_multiply_the_rows(spark):
    from veilstone.operators import packed

    texts = ["; ".join(f'"Lee, Ann{j} (HOU {i})" <a{j}@x.example>, Bob Moss {i} <b{j}@x.example>' for j in range(8)) for i in range(300)]
    rows = [(i, [f"a{i}@x.example"], t) for i, t in enumerate(texts)] + [(300, None, "Zed Corp, Lee, Ann1 (HOU 7), Hill, Bob")]
    df = spark.createDataFrame(rows, "k int, to array<string>, x string")
    jvm, store = spark.sparkContext._gateway, spark._jsc.sc().statusStore()

    def moved() -> int:
        none = jvm.jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, jvm.new_array(jvm.jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    def values(limit: int) -> list[tuple]:
        return sorted(map(tuple, packed.unpack(df, "k", ["to"], ["x"], limit=limit).collect()))

    few, before = values(10_000), moved()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of some size
    try:
        assert values(1) == few and (300, "x", 2, "Lee, Ann1 (HOU 7)", "") in few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the names are 8 for each row; the rows are moved with few values each, not with every part of their texts
    assert moved() - before < 40 * len(rows)


def test_what_a_cover_could_take_from_the_dictionary():
    from veilstone.operators import packed

    assert packed.parts_between("a b, c; d, , e") == {"a b", "a b, c"}
    assert {"hill; anna (hou)", "bob lee; hill", "lee; hill; anna"} <= packed.parts_around("bob lee; hill; anna (hou)")
    assert packed.parts_around('bob lee; "hill, anna') == set() and packed.parts_around("") == packed.parts_between("") == set()


def test_known_name_of_many_parts_is_one_value():
    from veilstone.operators.packed import Segmenter

    name = "Hill, Lee, Moss, Zorin, Inc"
    assert Segmenter([name]).split_plain(f"Bob Lee, {name}, Cara Moss") == ["Bob Lee", name, "Cara Moss"]
