import json

from veilstone.cli import main


def call(spark, capsys, *argv):
    code = main([str(x) for x in argv], spark)
    return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_search_to_script(spark, capsys, tmp_path):
    spark.createDataFrame([("1", "Ask Ann Lee at ann@x.org"), ("2", "nothing")], "_id string, message string").write.parquet(str(tmp_path / "c"))
    assert call(spark, capsys, "status")[1]["ok"]
    code, out = call(spark, capsys, "discover-direct", tmp_path / "c", "--name", "Ann Lee")
    assert code == 0 and [e["doc_id"] for e in out["evaluations"]] == ["1"]
    (tmp_path / "ev.json").write_text(json.dumps(out))
    ev = f"@{tmp_path}/ev.json"
    assert call(spark, capsys, "plan", "--evaluations", ev)[1]["operations"][0]["operation"] == "preview_redact"
    code, out = call(spark, capsys, "export-script", "--evaluations", ev, "--action", "hard_delete", "--out", tmp_path / "s.sh", "--log", tmp_path / "log")
    assert code == 0 and (tmp_path / "s.sh").stat().st_mode & 0o100 and "DELETE" in (tmp_path / "s.sh").read_text()
    assert call(spark, capsys, "verify-chain", "--log", tmp_path / "log")[1]["intact"]
    assert len(call(spark, capsys, "audit-log", "--log", tmp_path / "log")[1]["entries"]) == 1
    code, out = call(spark, capsys, "export-script", "--evaluations", ev, "--action", "hard_delete", "--out", tmp_path / "t.sh", "--hold", "*")
    assert code == 1 and "LegalHold" in out["error"]
    code, out = call(spark, capsys, "export-script", "--evaluations", "[]", "--action", "hard_delete", "--out", tmp_path / "t.sh")
    assert code == 1 and not out["ok"]


def test_discover_and_assess(spark, capsys, data_dir):
    code, out = call(spark, capsys, "discover", f"{data_dir}/logs.parquet", "--key", "log_id", "--profile", "the sole maintainer of search", "--size", 5)
    assert code == 0 and out["mode"] == "bm25_fallback" and len(out["candidates"]) == 5
    code, out = call(spark, capsys, "assess", f"{data_dir}/logs.parquet", "--key", "log_id", "--sample", 0)
    assert code == 0 and out["assessment"]["band"] in ("rich", "sparse", "absent")


def test_roster_to_masked_corpus_and_scores(spark, capsys, data_dir, tmp_path):
    mail, domain = f"{data_dir}/mail.parquet", "halverton.example"
    code, out = call(spark, capsys, "roster", mail, "--domain", domain, "--min-messages", 2, "--out", tmp_path / "roster")
    assert code == 0 and out["coverage"]["people"] > 0 and sum(b["people"] for b in out["histogram"]) == out["coverage"]["people"]
    person = spark.read.json(str(tmp_path / "roster")).filter("size(display_name_variants) > 1 and internal").orderBy("message_count", ascending=False).first().address
    code, out = call(spark, capsys, "mask-corpus", mail, "--key", "mail_id", "--roster", tmp_path / "roster", "--subject", person, "--out", tmp_path / "masked", "--labels", tmp_path / "labels")
    assert code == 0, out
    assert out["audit"]["passed"] and out["stats"]["masked"] > 0
    code, out = call(spark, capsys, "audit-mask", tmp_path / "masked", "--roster", tmp_path / "roster", "--subject", person)
    assert code == 0 and out["audit"]["passed"]
    code, out = call(spark, capsys, "score-discovery", tmp_path / "masked", "--labels", tmp_path / "labels", "--ks", 5, 50)
    assert code == 0, out
    ev = json.dumps([{"doc_id": "m-0", "is_identifiable": True, "confidence_score": 0.9}])
    code, out = call(spark, capsys, "score-judgment", tmp_path / "masked", "--labels", tmp_path / "labels", "--evaluations", ev)
    assert code == 0 and out["strict"]["precision"] == 0.0
    assert call(spark, capsys, "score-judgment", mail, "--labels", tmp_path / "labels", "--evaluations", ev)[0] == 1


def test_demo_and_corpus_scores(spark, capsys, data_dir, tmp_path):
    assert call(spark, capsys, "seed-demo", "--out", tmp_path / "demo", "--noise", 20)[1]["documents"] == 20
    code, out = call(spark, capsys, "score-corpus", f"{data_dir}/opinions.parquet", "--key", "opinion_id", "--ks", 1, 5)
    assert code == 0 and [r["k"] for r in out["hit_rate"]] == [1, 5]
