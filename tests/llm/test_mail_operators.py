import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from veilstone.llm import fresh, personal, variants


# -- newly written text

def new(message, subject=None, sender=("Anna Hill <anna.hill@x.example>",), recurring=None):
    r = np.array([], np.int64) if recurring is None else recurring
    return fresh.new_text(message, subject, fresh.Sender(*sender), r, fresh.Winnower())


def test_quotes_and_signatures_are_cut():
    assert new("Plan. Hi Bob,\n\nSee you.\n\nThanks,\nAnna\n\n--\nAnna Hill\nDirector, Sales\nTel: 555-0101\n\n-----Original Message-----\nFrom: Bob\nSent: Mon\nSubject: Plan\n\nOld", "Plan") == ("Hi Bob, See you. Thanks, Anna", True)
    assert new("Plan. On Sun, Apr 1, 2001 at 19:06, Bob Lee <b@x.example> wrote:\n> One?\n\nYes.\n\n> Two?\nNo.", "Plan") == ("Yes. No.", True)
    assert new("Hi, all is fine. Anything > 5 goes. Counsel wrote: check it.") == ("Hi, all is fine. Anything > 5 goes. Counsel wrote: check it.", False)
    assert new("Fine. Best, Annie Anna Hill Director, Sales 555-0101") == ("Fine. Best, Annie", True)
    assert new("Plan. ", "Plan") == ("", False)
    assert new("") == ("", False)


def test_recurring_notice_is_found_by_fingerprints():
    notice = "This message and any attachment are meant only for the addressee and may hold privileged matter. If you received it by mistake, delete every copy and tell the sender."
    w = fresh.Winnower()
    recurring = np.sort(w.pick(fresh.tokens(notice))[0])
    assert new("We meet on Monday at noon in room five. Best, Anna " + notice, recurring=recurring)[0] == "We meet on Monday at noon in room five. Best, Anna"
    assert new("The confidential notice to the addressee is late.", recurring=recurring)[1] is False


def test_winnowing_in_one_pass_equals_one_by_one():
    rnd = np.random.default_rng(2)
    texts = [list(rnd.choice(list("abcdefgh"), n)) for n in (0, 3, 8, 9, 15, 16, 40, 7, 100)]
    w = fresh.Winnower()
    fps, owner = w.pick_many(texts)
    assert sorted(zip(owner.tolist(), fps.tolist())) == sorted((i, f) for i, t in enumerate(texts) for f in w.pick(t)[0].tolist())


def test_newly_written_defined_cases(spark):
    rows = [Row(mail_id=1, message="Hello there.", subject=None, mail_from=None, x_from=None), Row(mail_id=2, message=None, subject="s", mail_from="a@b.example", x_from=""), Row(mail_id=3, message="", subject="", mail_from="", x_from=None), Row(mail_id=4, message="S. Bob Lee writes:\n> " + "long " * 400, subject="S", mail_from="a@b.example", x_from=None)]
    df = spark.createDataFrame(rows, "mail_id bigint, message string, subject string, mail_from string, x_from string")
    got = {r.mail_id: (r.new_text, r.trimmed) for r in fresh.newly_written(df, "mail_id").collect()}
    assert got == {1: ("Hello there.", False), 3: ("", False), 4: ("", True)}
    assert fresh.newly_written(df.filter("false"), "mail_id").count() == 0


def test_ancestor_is_chosen_by_exact_counts(spark):
    hot, own = [f"hot{i:02}" for i in range(40)], [f"own{i:02}" for i in range(20)]
    lines = lambda ws: " ".join("> " + " ".join(ws[i : i + 10]) for i in range(0, len(ws), 10))
    answer = " > " + "an answer that is longer than one quoted line can be and so may end in new text"
    texts = {0: "Fine. Bob Lee writes: " + lines(hot) + answer, 200: "Fine. Bob Lee writes: " + lines(hot + own) + answer}
    texts |= {i: " ".join(hot + [f"w{i}x{j}" for j in range(9)]) for i in range(1, 100)}
    texts[90] = " ".join(hot + own)
    df = spark.createDataFrame(list(texts.items()), "k int, t string")
    got = {r.k: r.ancestor for r in fresh.ancestors(df, fresh.fingerprint_index(df, "k", "t"), "k", "t").collect()}
    # the asker 0 is the smallest holder of every hot run; for 200, a message that holds all runs outvotes the smallest holder
    assert got == {0: texts[1], 200: texts[90]}


ORIGINAL = "The second storage report for the northern line was filed on Monday by the desk and nobody has signed the corrected copy so far. Please send the missing readings to the terminal before the audit of the southern meters starts."


def test_spans_of_the_ancestor_are_removed(spark):
    one, two = ORIGINAL.split(". ")
    head = "On Tue, Jul 13, 1999 at 2:38, Bob Lee <bob.lee@x.example> wrote:"
    # one quoted line has lost its mark, with line breaks and without
    in_lines = f"Fine with me.\n{head}\n> {one[:60]}\n> {one[60:]}.\n{two}\nI will do it.\n> Bob"
    in_flow = f"Fine with me. {head} > {one[:59].strip()} > {one[59:118].strip()} > {one[118:].strip()}. {two} I will do it. > Bob"
    rows = [(1, ORIGINAL, "Bob Lee <bob.lee@x.example>"), (2, in_lines, "Ann Hill <ann.hill@x.example>"), (3, in_flow, "Ann Hill <ann.hill@x.example>"), (4, None, None)]
    df = spark.createDataFrame([(k, t, None, s, s) for k, t, s in rows], "mail_id long, message string, subject string, mail_from string, x_from string")
    got = {r.mail_id: r.new_text for r in fresh.newly_written(df, "mail_id").collect()}
    assert got[2] == got[3] == "Fine with me. I will do it." and got[1] == ORIGINAL
    # without the ancestor nothing tells the line from an answer
    alone = {r.mail_id: r.new_text for r in fresh.newly_written(df.filter("mail_id <> 1 and mail_id <> 3"), "mail_id").collect()}
    assert alone == {2: f"Fine with me. {two} I will do it."}
    # what an ancestor only quotes itself is no source
    nested = f"Hello. {head} > {two} > Bob"
    assert fresh.without_quoted(two, nested) == two and fresh.without_quoted(f"Yes. {two} Done.", two).split() == ["Yes.", "Done."]


def test_only_the_writer_of_a_quotation_is_its_ancestor(spark):
    one, two = ORIGINAL.split(". ")
    head = "On Tue, Jul 13, 1999 at 2:38, Bob Lee <bob.lee@x.example> wrote:"
    reply = f"Fine with me.\n{head}\n> {one[:60]}\n> {one[60:]}.\n{two}\nI will do it.\n> Bob"
    # a copy of the reply and another reply hold the same quotation under smaller keys
    rows = [(1, reply), (2, reply), (3, f"No, not yet.\n{head}\n> {one[:60]}\n> {one[60:]}.\n> {two}"), (4, ORIGINAL)]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], "mail_id long, message string, subject string, mail_from string, x_from string")
    index = fresh.fingerprint_index(df, "mail_id", "message")
    assert {r.mail_id: r.ancestor for r in fresh.ancestors(df, index, "mail_id", "message").collect()} == {1: ORIGINAL, 2: ORIGINAL}
    got = {r.mail_id: r.new_text for r in fresh.newly_written(df, "mail_id").collect()}
    assert got == {1: "Fine with me. I will do it.", 2: "Fine with me. I will do it.", 3: "No, not yet.", 4: ORIGINAL}


def test_quotations_without_marks_ask_for_their_ancestor(spark):
    one, two = ORIGINAL.split(". ")
    head = "Le 13/07/1999 à 2:38, Bob Lee a écrit :"
    answer = "I will bring both copies on Friday."
    flow, lines = (f"Fine.{b}{head}{b}{one}.{b}{answer}{b}{two}" for b in (" ", "\n"))
    rows = [(1, ORIGINAL), (2, flow), (3, lines), (4, f"Fine.\n{head}\nBob,\nnobody else has seen this mail, which lies in no mailbox here.\nBob")]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], "mail_id long, message string, subject string, mail_from string, x_from string")
    got = {r.mail_id: r.new_text for r in fresh.newly_written(df, "mail_id").collect()}
    assert got == {1: ORIGINAL, 2: f"Fine. {answer}", 3: f"Fine. {answer}", 4: "Fine."}
    # a sentence that stands in another mail by chance makes nothing beside it an answer
    assert fresh._answers_unmarked(f" {one}. More of the quoted mail.", f"Hello. {one}.") and fresh._answers_unmarked(f" Bob, {one}.", f"Hello. {one}.") == []
    # an unmarked quotation may stand before marked ones
    assert len(fresh.open_quotation(f"Fine.\n{head}\n{one}\n{head}\n> {two}\n{ORIGINAL}")) == 2


def test_long_notices_and_signatures_are_removed(spark):
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    notice = "NOTICE: " + " ".join(words[:330])
    assert len(notice) > 1800
    # more own text than notice, so that the messages are unlike
    own = lambda: " ".join("".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(400))
    rows = [(k, f"The report number {k} on {own()} is done.\n\n{notice}") for k in range(1, 40)]
    df = spark.createDataFrame([(k, t, None, "ann.hill@x.example", None) for k, t in rows], "mail_id long, message string, subject string, mail_from string, x_from string")
    got = {r.mail_id: r.new_text for r in fresh.newly_written(df, "mail_id").collect()}
    assert all(got[k] == t.split("\n")[0] for k, t in rows)
    block = "Ann Hill\nDirector\n" + "\n".join(f"Office {i}: +1 303 555 {i:04d}" for i in range(40))
    assert len(block) > 900
    sender = fresh.Sender("ann.hill@x.example", "Ann Hill")
    text = f"All is signed now, we can go on with it.\n\n{block}"
    assert text[: fresh.signature_start(text, sender, len(text))].strip() == "All is signed now, we can go on with it."


# -- personal values

PATTERNS = personal.Patterns(given=frozenset({"anna", "bob", "lars"}), surnames=frozenset({"hill", "gaskano"}), cities=frozenset({"millbeck"}))


def found(text):
    f = personal.Finder(PATTERNS)
    return [(k, personal.squeeze(text[a:b])) for a, b, k in f.values(text)]


def test_values_of_every_kind():
    assert found("Write to anna.hill (at) x.example or a@b.example.") == [("email", "anna.hill (at) x.example"), ("email", "a@b.example")]
    assert found("Dial (503)199-8146 ext. 661, +49 (0)30/23125-001 or 555-0102; Part no. 034-64-3149") == [("phone", "(503)199-8146 ext. 661"), ("phone", "+49 (0)30/23125-001"), ("phone", "555-0102")]
    assert found("SSN 990 79 1582, passport X90760814, purchase order 436-1896-623") == [("id_number", "990 79 1582"), ("id_number", "X90760814")]
    assert found("Mail it to 6198 Old Tannery Ave #50, Millbeck, OH 43827-0010 instead") == [("street_address", "6198 Old Tannery Ave #50, Millbeck, OH 43827-0010")]
    assert found("Hill, Anna B. and lars gaskano met A.B. Hill and Anna at the Hill") == [("name", "Hill, Anna B."), ("name", "lars gaskano"), ("name", "A.B. Hill")]


def test_fast_runs_equal_plain_search():
    text = "x 540 087 5565 CO 80529 540-087-5565, E680263 EMP-0429. 971-13-2044 (504) 555-0100 1-504-555-0100 12345 09-310-681-T 2001-11-12"
    assert [m.span() for m in personal.phones_in(text)] == [m.span() for m in personal._PHONE.finditer(text)]
    assert [m.span() for m in personal.numbers_in(text)] == [m.span() for m in personal._NUMBER.finditer(text)]


def test_bootstrapping_finds_unseen_people(spark):
    seeds = spark.createDataFrame([("anna", "hill", 9), ("bob", "lee", 9), ("cara", "moss", 9)], "given string, surname string, n bigint")
    texts = spark.createDataFrame([Row(k=i, message=t) for i, t in enumerate(["I met Anna Zorin today.", "Ask Bob Zorin about it.", "Then Cara Hill and Cara Moss left.", None, "The Staguvix order"])], "k int, message string")
    patterns, many = personal.learn(texts, "message", seeds)
    assert many is None and "zorin" in patterns.surnames and "staguvix" not in patterns.surnames
    got = {r.val for r in personal.find_values(texts, "k", "message", patterns).collect()}
    assert got == {"Anna Zorin", "Bob Zorin", "Cara Hill", "Cara Moss"}
    # the same through the join that serves lexicons too large to broadcast
    patterns2, many2 = personal.learn(texts, "message", seeds, limit=2)
    wide = personal.Patterns(patterns.given, frozenset(), patterns.labels, patterns.cities)
    assert many2 is not None and {r.val for r in personal.find_values(texts, "k", "message", wide, many2).collect()} == got


def test_limit_of_the_lexicon_changes_nothing(spark):
    seeds = spark.createDataFrame([("anna", "hill", 9), ("bob", "lee", 9), ("cara", "moss", 9)], "given string, surname string, n bigint")
    lines = ["Take Anna Hill's car.", "Ask Bob Lee- now.", "Cara Moss' desk", "Anna Hill-Side", "Anna Lee’ and Bob O'Moss"] + [f"12 Oak Street, {c}, OH 43827" for c in ("Millbeck", "Oxbar", "Lanter") for _ in range(2)] + [f"Zeta ref {i}1 SSN 990-79-158{i}, Zeta ref 990-79-158{i}" for i in range(4)]
    texts = spark.createDataFrame([Row(k=i, message=t) for i, t in enumerate(lines)], "k int, message string")
    few, none = personal.learn(texts, "message", seeds)
    cut, many = personal.learn(texts, "message", seeds, limit=1)
    assert none is None and many is not None
    assert len(few.cities) == 3 and (cut.given, cut.cities, cut.labels) == (few.given, few.cities, few.labels)
    values = lambda *a: sorted((r.k, r.start, r.val) for r in personal.find_values(texts, "k", "message", *a).collect())
    assert values(few) == values(cut, many) and {"Anna Hill", "Bob Lee", "Cara Moss"} <= {v for _, _, v in values(cut, many)}


def test_first_names_are_no_surnames(spark):
    entries = ["Hill, Anna <anna.hill@x.example>", "Moss, Anna <anna.moss@x.example>", "Lee, Anna </O=X/CN=ALEE>", "Hill, Lars <lars.hill@x.example>", "Moss, Lars <lars.moss@x.example>", "Lee, Lars <lars.lee@x.example>",
               "Zorin Anna <azorin@x.example>", "Hill, IS <hill.is@x.example>", "Moss, IS <m.is@x.example>", "Lee, IS <l.is@x.example>", "Moss Law <billing.moss@x.example>", "Lars, Bob <bob.lars@x.example>", "bob.lars@x.example"]
    mails = spark.createDataFrame([Row(h=e) for e in entries for _ in range(3)], "h string")
    seeds = personal.seed_pairs(mails, ["h"])
    assert {(r.given, r.surname) for r in seeds.collect()} == {(g, s) for g in ("anna", "lars") for s in ("hill", "moss", "lee")} | {("anna", "zorin"), ("bob", "lars")}
    lines = ["Thanks, Anna Anna Hill Manager", "Lars Anna will see what is short", "That is late and Is Hill here", "Anna Lars or Bob Lars", "Lars Lars Zorin", "we get that", "Liz Moss came", "Liz Moss went", "Liz Moss is here"]
    texts = spark.createDataFrame([Row(k=i, message=t) for i, t in enumerate(lines)], "k int, message string")
    patterns, _ = personal.learn(texts, "message", seeds)
    assert patterns.dual == {("bob", "lars")} and not patterns.given & patterns.surnames and "is" not in patterns.given and "liz" in patterns.given
    got = sorted((r.k, r.val) for r in personal.find_values(texts, "k", "message", patterns).collect())
    assert got == [(0, "Anna Hill"), (3, "Bob Lars"), (4, "Lars Zorin"), (6, "Liz Moss"), (7, "Liz Moss"), (8, "Liz Moss")]


def test_slips_of_given_names():
    f = personal.Finder(personal.Patterns(given=frozenset({"francesca", "anna"}), surnames=frozenset({"hill"})))
    for word in ("Francseca", "Francesa", "Francessca", "Franzesca"):
        assert f._slip(word)
    assert not f._slip("Frenzesca") and not f._slip("Prancesca") and not f._slip("Anan") and not f._slip("francseca")


def test_addresses_in_words_across_lines():
    assert found("Copy anna.hill at x dot\nexample or\n> bob.lee at x\n> dot example on it") == [("email", "anna.hill at x dot example"), ("email", "bob.lee at x dot example")]


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([Row(k=1, message="Anna Hill, a@b.example: hi"), Row(k=2, message=None), Row(k=3, message="")], "k int, message string")
    got = {r.k: r.redacted for r in personal.redact(df, "k", "message", PATTERNS).collect()}
    assert got == {1: "[NAME], [EMAIL]: hi", 2: None, 3: ""}


# -- variants of names

def test_variants_link_through_persons(spark):
    rows = [
        ("Thomas Hill <thomas.hill@x.example>", "T. Hill", None, []), ("Theodore Hill <theodore.hill@x.example>", "T. Hill", "", None),
        ("thomas.hill@x.example", "Hill, Thomas (E-mail) </O=X/CN=THILL>", None, None), ("thomas.hill@x.example", "Thoams Hill", None, None),
        ("info.sistik@x.example", "The Sistik Pipeline Company", None, None), ("info.sistik@x.example", "Sistik Pipeline Co.", None, None), (None, None, None, None),
        ("thomas.hill@x.example", "Thomas Hill", "'Hill, Theo'; Thomas Hill", ["theodore.hill@x.example", "thomas.hill@x.example"]),
    ]
    df = spark.createDataFrame(rows, "mail_from string, x_from string, x_to string, mail_to array<string>")
    got = {(r.name_a, r.name_b) for r in variants.link_variants(df).collect()}
    thomas, theodore = {"Thomas Hill", "T. Hill", "Hill, Thomas (E-mail)", "Thoams Hill"}, {"Theodore Hill", "T. Hill", "Hill, Theo"}
    expected = {(a, b) for group in (thomas, theodore, {"The Sistik Pipeline Company", "Sistik Pipeline Co."}) for a in group for b in group if a < b}
    assert got == expected
    assert variants.link_variants(df.filter("false")).count() == 0


def test_spellings_without_address_are_linked(spark):
    rows = [("deborah.rindomham@x.example", "Deborah Rindomham", "Debbie Rindomham; Rindomam, Deborah; D. Rindomham; Dora Rindomham; Anna Hall", ["a@x.example"]), ("thomas.hill@x.example", "Thomas Hill", "Theo Hill; Anna Hill", None),
            (None, None, "Larry Kouzrano; Kouzrano, Larry; L. Kouzrano; Lena Kouzrano", None)]
    df = spark.createDataFrame(rows, "mail_from string, x_from string, x_to string, mail_to array<string>")
    got = {(r.name_a, r.name_b) for r in variants.link_variants(df).collect()}
    groups = [{"Deborah Rindomham", "Debbie Rindomham", "Rindomam, Deborah", "D. Rindomham"}, {"D. Rindomham", "Dora Rindomham"}, {"Larry Kouzrano", "Kouzrano, Larry", "L. Kouzrano"}, {"L. Kouzrano", "Lena Kouzrano"}]
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}


def test_every_spelling_is_compared_with_all_of_its_person(spark):
    # short names share no suffix of four letters; the slip agrees with neither the first nor the last spelling
    names = {"kim.ng@x.example": ["Kim Ng", "Ng, Kim", "K. Ng"], "bo.zu@x.example": ["Bo Zu", "Zu, Bo"]}
    df = spark.createDataFrame([(a, n, None, None) for a, ns in names.items() for n in ns], "mail_from string, x_from string, x_to string, mail_to array<string>")
    got = {(r.name_a, r.name_b) for r in variants.link_variants(df).collect()}
    assert got == {(a, b) for ns in names.values() for a in ns for b in ns if a < b}
    spellings = ["Abcdefgh Mnopqrst", "Zyxwvuts Kjihgfed", "Mid Qazwsxed", "Mid Qazwsxrf"]
    nodes = spark.createDataFrame([(s, "p") for s in spellings], "spelling string, person string")
    agreed = nodes.filter(F.col("spelling") != "Mid Qazwsxrf")
    assert {r.spelling for r in variants._unmet(nodes, agreed, 0.7).collect()} == {"Mid Qazwsxrf"}


def test_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for a, b in (("kitten", "sitting"), ("abc", ""), ("aaaa", "aa"), ("thoams hill", "thomas hill")):
        assert variants.common(a, b) == slow(a, b)
