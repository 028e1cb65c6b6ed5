"""Command line: every operation on parquet collections, results as one JSON object.

    python -m veilstone.cli discover /data/mail.parquet --key mail_id --profile "..." --size 20

Every command prints {"ok": true, ...}; any error prints {"ok": false, "error": ...} and exits with 1.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import actions, alias, audit, direct, judge, masking, metrics, retrieval, roster, suitability
from .session import local_session
from .sources import mailfiles, opinions, sinks, synthetic

#: Rows that a command prints at most; full results go to --out.
SHOWN = 1000


def rows(df: DataFrame, limit: int = SHOWN) -> list[dict]:
    return [json.loads(r) for r in df.limit(limit).toJSON().collect()]


def collection(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return spark.read.parquet(a.path)


def _flagged(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    given = sinks.read_json_arg(a.evaluations)
    listed = given["evaluations"] if isinstance(given, dict) else given
    known = {f.split(" ")[0] for f in direct.EVALUATION.replace(">>", ">").split(", ")}
    lines = spark.sparkContext.parallelize([json.dumps({k: v for k, v in e.items() if k in known}) for e in listed])
    return judge.filter_flagged(spark.read.schema(direct.EVALUATION).json(lines), a.mode)


def status(spark, a):
    return {"spark": spark.version, "master": spark.sparkContext.master}


def assess(spark, a):
    df = collection(spark, a)
    channel = direct.naming_fields(df.schema, a.text)
    sample = retrieval.hash_sample(df, a.key, a.sample) if a.sample else df
    return {"assessment": rows(suitability.assess(sample, a.key, a.text, bool(channel)))[0], "phrases": rows(suitability.phrases(sample, a.key, a.text)), "naming_channel": [{"field": f, "type": t, "searchable": s} for f, t, s in channel]}


def discover(spark, a):
    df = collection(spark, a)
    vectors = spark.read.parquet(a.vectors) if a.vectors else None
    query = json.loads(a.query_vector) if a.query_vector else None
    ranked = retrieval.discover(df, a.profile, a.keywords, vectors, query, a.size, a.fusion, a.key, a.text, a.vector_key, a.vector)
    found = rows(retrieval.candidates(ranked, df, a.key, a.text, a.path).orderBy(F.desc("score"), "doc_id"), a.size)
    band = suitability.assess(retrieval.hash_sample(df, a.key, 300), a.key, a.text).first().band
    return {"mode": "hybrid" if vectors is not None and query else "bm25_fallback", "candidates": found, "note": suitability.applicability(band, len(found))}


def discover_direct(spark, a):
    wanted = direct.normalize_identifiers(email=a.email, phone=a.phone, ip=a.ip, name=a.name, id=a.id, term=a.term)
    df = collection(spark, a)
    return {"identifiers": wanted, "evaluations": rows(direct.discover_direct(df, wanted, a.key, a.text, a.path, a.stamp, None, not a.no_pii, a.size).orderBy("doc_id"), a.size or SHOWN)}


def evaluate(spark, a):
    given = sinks.read_json_arg(a.candidates)
    listed = given["candidates"] if isinstance(given, dict) else given
    df = spark.createDataFrame([(str(c["doc_id"]), c.get("text") or "") for c in listed], "doc_id string, text string")
    return {"evaluations": rows(judge.evaluate(df))}


def plan(spark, a):
    return {"action": a.action, "operations": rows(actions.action_plan(_flagged(spark, a), a.action))}


def export_script(spark, a):
    flagged = _flagged(spark, a)
    actions.assert_not_on_hold(flagged, a.hold or [])
    todo = actions.action_plan(flagged, a.action)
    lines = [r.line for r in actions.remediation_script(todo).toLocalIterator()]
    if len(lines) <= 2:
        raise ValueError("nothing is flagged")
    text = "\n".join(lines) + "\n"
    Path(a.out).write_text(text)
    Path(a.out).chmod(0o755)
    done = [r.asDict() for r in todo.select("index", "doc_id", "operation").distinct().orderBy("index", "doc_id").toLocalIterator()]
    return {"script": a.out, "certificate": audit.write_certificate(audit.build_record(a.action, done, text), a.log)}


def verify_chain(spark, a):
    return rows(audit.verify_chain(audit.load_certificates(spark, a.log)))[0]


def audit_log(spark, a):
    return {"entries": rows(audit.list_entries(audit.load_certificates(spark, a.log), a.limit))}


def _roster(spark, a) -> DataFrame:
    return roster.entries(roster.participants(collection(spark, a)), a.domain, a.top)


def build_roster(spark, a):
    entries = _roster(spark, a)
    if a.out:
        sinks.write_rows(entries, a.out)
    cov = roster.coverage(entries, collection(spark, a).count(), a.min_messages)
    return {"coverage": rows(cov)[0], "percentiles": rows(roster.percentiles(entries, "message_count"))[0], "histogram": rows(roster.histogram(entries, "message_count")), "decision": roster.go_no_go(cov, a.min_subjects).first().decision, "out": a.out}


def subjects(spark, a):
    pool = roster.usable(_roster(spark, a), a.min_messages).filter("internal").orderBy(F.desc("message_count"), "address").limit(a.candidates)
    wanted = pool.select(roster.surname(F.col("display_name_variants")).alias("surname")).filter(F.length("surname") >= 4).distinct()
    return {"ranked": rows(suitability.rank_subjects(collection(spark, a), a.key, a.text, wanted, a.house).limit(a.size))}


def _patterns(spark, a) -> tuple[str | None, str | None, list]:
    found = alias.alias_set(spark.read.json(a.roster), a.subject, a.min_length).collect()
    names, labels = [r.variant for r in found], [r.variant for r in found if r.is_label]
    failures = masking.alias_failures([r.variant for r in found if r.kind == "name"], labels)
    return alias.build_pattern(names), alias.build_pattern(labels), failures


def mask_corpus(spark, a):
    pattern, labels, failures = _patterns(spark, a)
    if failures:
        raise ValueError("; ".join(failures))
    corpus = masking.masked_corpus(collection(spark, a), pattern, labels, a.key, a.text, a.stamp or "ts", a.replacement)
    sinks.write_collection(corpus.select("_id", "message", "ts"), a.out)
    found = masking.positives(corpus)
    gate = rows(masking.audit(spark.read.parquet(a.out), pattern, a.phone_policy, a.replacement, found.count()))[0]
    sinks.write_labels(found, {"masked_index": a.out, "source_index": a.path, "subject": a.subject, "audit": gate, "phone_policy": a.phone_policy, "mask_replacement": a.replacement}, a.labels)
    if not gate["passed"]:
        raise ValueError("the leakage gate failed: " + "; ".join(gate["failures"]))
    return {"masked": a.out, "stats": rows(masking.masking_stats(corpus))[0], "audit": gate}


def audit_mask(spark, a):
    return {"audit": rows(masking.audit(collection(spark, a), _patterns(spark, a)[0], a.phone_policy))[0]}


def _labels(spark, a) -> DataFrame:
    masking.assert_scorable(json.loads(Path(a.labels, "meta.json").read_text()), a.path)
    return spark.read.schema("doc_id string, original_id string, label_hits bigint").json(f"{a.labels}/positives")


def score_discovery(spark, a):
    df, found = collection(spark, a), _labels(spark, a)
    derive, held = found.filter(metrics.in_derive_half(F.col("doc_id"))), found.filter(~metrics.in_derive_half(F.col("doc_id")))
    marks = metrics.usable_terms(retrieval.significant_terms(df, derive.select(F.col("doc_id").alias("_id")), "_id", "message", a.terms), [])
    ks = metrics.extend_ks(a.ks, held.count())
    runs = []
    built = metrics.build_profiles([r.term for r in marks.collect()])
    for p in built:
        ranked = retrieval.discover(df, p["profile"], p["keywords"], size=max(ks), key="_id", text="message").withColumnRenamed("id", "doc_id")
        runs.append({**p, "mode": "bm25_only", "recall": rows(metrics.recall_at_k(ranked.join(derive, "doc_id", "left_anti"), held, ks))})
    labels = json.loads(Path(a.labels, "meta.json").read_text())
    return {"positives": held.count(), "runs": runs, "basis": metrics.report_basis(labels, ks, built)}


def score_judgment(spark, a):
    given = sinks.read_json_arg(a.evaluations)
    ev = spark.createDataFrame([(str(e["doc_id"]), bool(e.get("is_identifiable")), float(e.get("confidence_score") or 0)) for e in given], "doc_id string, is_identifiable boolean, confidence_score double")
    found = _labels(spark, a)
    ev = judge.without(ev, found.filter(metrics.in_derive_half(F.col("doc_id"))))
    scanned = collection(spark, a).count()
    return {mode: rows(metrics.precision_recall(judge.flagged_at(ev, t), found, scanned))[0] for mode, t in judge.MODES.items()}


def score_corpus(spark, a):
    halves = collection(spark, a).filter("half in ('a', 'b') and subject_id is not null")
    some = halves.filter("half = 'a'").select("subject_id").distinct().orderBy("subject_id").limit(a.subjects)
    queries = metrics.subject_terms(halves.filter("half = 'a'"), "subject_id", a.key, a.text, a.terms).withColumnRenamed("subject", "query").join(some.withColumnRenamed("subject_id", "query"), "query", "left_semi")
    scored = retrieval.bm25_many(halves, queries, a.key, a.text)
    own = halves.filter("half = 'a'").select(F.col("subject_id").alias("query"), F.col(a.key).alias("id"))
    from pyspark.sql import Window

    ranked = scored.join(own, ["query", "id"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).select(F.col("query").alias("subject"), F.col("id").alias("doc_id"), "rank")
    targets = halves.filter("half = 'b'").join(some, "subject_id", "left_semi").select(F.col("subject_id").alias("subject"), F.col(a.key).alias("doc_id"))
    ranks = metrics.target_ranks(ranked, targets)
    return {"hit_rate": rows(metrics.hit_rate_at_k(ranks, a.ks)), "mrr": rows(metrics.mean_reciprocal_rank(ranks))[0]}


def seed_demo(spark, a):
    if not a.labels:
        return {"written": sinks.write_collection(synthetic.noise(spark, a.noise), a.out), "documents": a.noise}
    docs, key = synthetic.with_noise(spark, a.noise)
    out = {"written": sinks.write_collection(docs, a.out), "documents": docs.count(), "labels": sinks.write_rows(key, a.labels)}
    return {**out, "classes": rows(synthetic.ground_truth(key))} if a.reveal else out  # the key stays on disk unless asked for


def seed_mail(spark, a):
    mails, skipped = mailfiles.read_maildir(spark, a.path, a.custodians, a.folders)
    sinks.write_collection(mails.orderBy("_id").limit(a.limit) if a.limit else mails, a.out)
    return {"written": a.out, "documents": spark.read.parquet(a.out).count(), "skipped": [r.path for r in skipped.limit(SHOWN).collect()]}


def seed_opinions(spark, a):
    picked = opinions.select_opinions(opinions.read_csv(spark, a.path), a.max_chars, limit=a.limit)
    docs, drops = opinions.build_documents(picked, spark.read.parquet(a.captions), not a.whole)
    sinks.write_collection(docs, a.out)
    return {"written": a.out, "dropped": rows(drops)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veilstone", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *options: tuple[str, dict], path: bool = True) -> None:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        if path:
            p.add_argument("path")
            p.add_argument("--key", default="_id")
            p.add_argument("--text", default="message")
            p.add_argument("--stamp")
        for flag, settings in options:
            p.add_argument(flag, **settings)

    def o(flag: str, **settings) -> tuple[str, dict]:
        return flag, settings

    many = {"nargs": "*", "default": None}
    ks = lambda *d: o("--ks", nargs="*", type=int, default=list(d))
    evaluations, mode, log = o("--evaluations", required=True), o("--mode", default="high_recall"), o("--log", default="certificates")
    subject = (o("--roster", required=True), o("--subject", required=True), o("--min-length", type=int, default=3))
    policy = o("--phone-policy", default="identification", choices=["identification", "leakage"])
    people = (o("--domain", required=True), o("--top", type=int, default=5), o("--min-messages", type=int, default=20))
    command("status", status, path=False)
    command("assess", assess, o("--sample", type=int, default=500))
    command("seed-demo", seed_demo, o("--noise", type=int, default=450), o("--out", required=True), o("--labels"), o("--reveal", action="store_true"), path=False)
    command("seed-mail", seed_mail, o("--out", required=True), o("--limit", type=int, default=2000), o("--custodians", **many), o("--folders", **many))
    command("seed-opinions", seed_opinions, o("--out", required=True), o("--captions", required=True), o("--limit", type=int, default=2000), o("--max-chars", type=int, default=8000), o("--whole", action="store_true"))
    command("discover", discover, o("--profile", required=True), o("--keywords"), o("--size", type=int, default=100), o("--fusion", default="rrf", choices=["rrf", "normalization"]), o("--vectors"), o("--vector-key", default="vec_id"), o("--vector", default="embedding"), o("--query-vector"))
    command("discover-direct", discover_direct, *(o(f"--{k}", **many) for k in ("email", "phone", "ip", "name", "id", "term")), o("--size", type=int, default=None), o("--no-pii", action="store_true"))
    command("evaluate", evaluate, o("--candidates", required=True), path=False)
    command("plan", plan, evaluations, mode, o("--action", default="dry_run"), path=False)
    command("export-script", export_script, evaluations, mode, log, o("--action", required=True, choices=["redact_in_place", "hard_delete"]), o("--out", required=True), o("--hold", **many), path=False)
    command("verify-chain", verify_chain, log, path=False)
    command("audit-log", audit_log, log, o("--limit", type=int, default=20), path=False)
    command("roster", build_roster, *people, o("--min-subjects", type=int, default=5), o("--out"))
    command("subjects", subjects, *people, o("--candidates", type=int, default=80), o("--size", type=int, default=20), o("--house", required=True))
    command("mask-corpus", mask_corpus, *subject, policy, o("--replacement", default=""), o("--out", required=True), o("--labels", required=True))
    command("audit-mask", audit_mask, *subject, policy)
    command("score-discovery", score_discovery, o("--labels", required=True), o("--terms", type=int, default=30), ks(*metrics.KS))
    command("score-judgment", score_judgment, o("--labels", required=True), evaluations)
    command("score-corpus", score_corpus, o("--subjects", type=int, default=300), o("--terms", type=int, default=20), ks(1, 5, 10, 25, 50))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        result = a.run(spark or local_session(), a)
        print(json.dumps({"ok": True, **result}, ensure_ascii=False, default=str))
        return 0
    except Exception as error:  # noqa: BLE001  every failure is reported the same way
        print(json.dumps({"ok": False, "error": f"{type(error).__name__}: {error}"[:2000]}, ensure_ascii=False))
        return 1


if __name__ == "__main__":
    sys.exit(main())
