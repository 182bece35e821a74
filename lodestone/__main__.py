"""Command line over a folder of tables: ``python -m lodestone --root FOLDER <group> <command> …``.

Models and encoders are named as module:function; a model takes a prompt and gives a reply, an encoder takes texts and gives vectors.
"""

from __future__ import annotations

import argparse
import datetime
import importlib
import json
import sys
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import calls, documents, evals, extraction, golden, indexing, ingest, release, reports, review, turns
from lodestone.session import session
from lodestone.sources import readers, sinks
from lodestone.warehouse import CANDIDATE, FACTS, FAMILIES, Warehouse

CITIES = "state string, region string, cities array<string>, office_id string"


def seam(name: str | None) -> Callable | None:
    if name is None:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def get(url: str) -> tuple[bytes, str]:
    with urllib.request.urlopen(url, timeout=30) as r:  # noqa: S310  addresses come from the source list
        return r.read(), r.headers.get("Content-Type") or ""


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _show(df: DataFrame, limit: int = 1000) -> None:
    for r in df.orderBy("n").limit(limit).collect():
        print(r.line)


def _json(df: DataFrame, limit: int = 1000) -> None:
    for line in df.select(F.to_json(F.struct("*")).alias("j")).limit(limit).collect():
        print(line.j)


def _families(w: Warehouse, path: str | None) -> DataFrame | None:
    return readers.dimension(w.spark, _text(path), "families", FAMILIES) if path else None


def _regions(w: Warehouse, path: str | None) -> DataFrame:
    return readers.dimension(w.spark, _text(path), "regions", CITIES) if path else w.spark.createDataFrame([], CITIES)


def ingest_run(w: Warehouse, a) -> None:
    stored = w.spark.read.parquet(f"{w.root}/sources/documents") if w.has("sources/documents") else w.spark.createDataFrame([], "sha256 string")
    made = ingest.run(readers.source_list(w.spark, _text(a.sources)), get, stored, a.start, datetime.datetime.now(datetime.timezone.utc).isoformat(), render=seam(a.renderer))
    ingest.store(made, f"{w.root}/sources")
    rows = made.manifest.groupBy("doc_id").agg(F.min_by(F.struct("kind", "url", "sha256"), "position").alias("m")).select("doc_id", "m.*")
    titles = made.written.select("sha256", "title", "page_count")
    fresh = rows.join(titles, "sha256", "left").withColumn("review_status", F.lit("pending"))
    name = f"staging/{a.candidate}/document"
    w.write(name, release.upsert(w.read(name), fresh, ["doc_id"]) if w.has(name) else fresh)
    _show(ingest.lines(made, a.client, a.candidate))


def converted(w: Warehouse) -> DataFrame:
    """(sha256, doc_id, url, kind, body) of the stored files."""
    files = w.spark.read.parquet(f"{w.root}/sources/documents")
    return files.withColumn("body", documents.front_matter(F.col("document"))["body"]).drop("document")


def ingest_verify(w: Warehouse, a) -> None:
    files, manifest = converted(w), w.spark.read.json(f"{w.root}/sources/manifest")
    raw = w.spark.read.parquet(f"{w.root}/sources/raw").where("kind = 'pdf'")
    seen = readers.witnesses(raw, seam(a.reader)) if a.reader else w.spark.createDataFrame([], "sha256 string, witness string")
    _show(reports.verify_lines(documents.verify(manifest.select("url", "kind"), manifest, files, seen)))


def extract_run(w: Warehouse, a) -> None:
    files = converted(w).join(w.read(f"staging/{a.candidate}/document").select("sha256"), "sha256", "left_semi")
    name = f"staging/{a.candidate}/classification"
    stored = w.read(name) if w.has(name) and not a.redo else None
    reached = extraction.run(documents.sections(files), seam(a.model), _families(w, a.families), classified=stored)
    if stored is None:
        w.write(name, reached.classified)
    if reached.proposals is not None:
        print(sinks.as_yaml(reached.proposals.withColumnRenamed("id", "family_id"), "families", "family_id"), end="")
        return
    for table, rows in extraction.stage(w.staged(a.candidate), reached.extracted).items():
        w.write(f"staging/{a.candidate}/{table}", rows)
    _show(extraction.lines(reached.extracted, _families(w, a.families)))


def release_create(w: Warehouse, a) -> None:
    after = turns.settled(release.create_candidate(w.read("candidate", CANDIDATE), a.client))
    w.write("candidate", after)
    print(after.where(F.col("client") == a.client).agg(F.max("id")).first()[0])


def release_list(w: Warehouse, a) -> None:
    _json(release.ledger_order(w.read("candidate", CANDIDATE)))


def release_export(w: Warehouse, a) -> None:
    for table, sheet in review.sheets({t: r for t, r in w.staged(a.candidate).items() if t in review.SHEETS}).items():
        sinks.write_sheet(sheet, f"{a.out}/{table}")
    w.write("candidate", turns.settled(release.set_status(w.read("candidate", CANDIDATE), a.candidate, "exported")))


def release_import(w: Warehouse, a) -> None:
    staged = {t: r for t, r in w.staged(a.candidate).items() if t in review.SHEETS}
    found = {t: f"{a.sheets}/{t}" for t in staged}
    given = {t: w.spark.read.csv(p, header=True, multiLine=True, escape='"', quote='"') for t, p in found.items() if Warehouse(w.spark, a.sheets).has(t)}
    done = review.take_in(staged, given, _families(w, a.families), w.read("candidate", CANDIDATE), a.candidate, a.reviewer)
    for table, rows in done.tables.items():
        w.write(f"staging/{a.candidate}/{table}", rows)
    w.write("candidate", done.ledger)
    _json(done.counts)


def release_check(w: Warehouse, a) -> None:
    cities = readers.city_states(_regions(w, a.regions))
    found = turns.settled(release.check(w.staged(a.candidate), _families(w, a.families), cities))
    _show(reports.check_lines(found))
    if not found.where("severity = 'hard'").isEmpty():
        sys.exit(1)


def release_diff(w: Warehouse, a) -> None:
    now = w.releases().where("is_active").first()
    before = w.facts("capability_row", now.release_id if now else "")
    _show(reports.diff_lines(release.diff(before, release.surviving(w.staged(a.candidate)["capability_row"]), "cap_id", ["capacity_min", "capacity_max", "discharge_p_min", "discharge_p_max"]), "cap_id"))


def release_promote(w: Warehouse, a) -> None:
    at = datetime.date.today()
    regions = _regions(w, a.regions).select("state", "region", "office_id")
    staged = {t: r for t, r in w.staged(a.candidate).items() if t in FACTS}
    name, tables, ledger = release.run_promotion(w.read("candidate", CANDIDATE), a.candidate, staged, _families(w, a.families), regions, w.releases(), a.year or at.year, a.month or at.month)
    for table, rows in tables.items():
        if table in FACTS:
            w.publish(table, rows)
    # The release is known, and the candidate promoted, only once all its facts are written.
    w.write("release", w.releases().unionByName(tables["release"], allowMissingColumns=True))
    w.write("candidate", ledger)
    print(name)


def release_embed(w: Warehouse, a) -> None:
    docs = w.facts("document", a.release).join(converted(w).select("sha256", "body"), "sha256")
    of = lambda t: w.facts(t, a.release)
    cover = documents.family_refs(of("product_family"), of("capability_row"), of("product"))
    made = indexing.release_index(docs.select("doc_id", "kind", "body", "division"), of("product_family").select("family_id", "name", "division"), cover, a.release, f"{w.root}/facts", seam(a.encoder), a.dimension)
    sinks.write_vectors(w.spark.read.parquet(made.vectors), f"{w.root}/vectors", a.release)
    _show(indexing.lines(made))


def release_activate(w: Warehouse, a) -> None:
    """Golden-gated where questions are given: a release that fails them stays as it was."""
    if a.questions:
        results = suite(w, a, a.release)
        if not golden.failing(results).isEmpty():
            _show(golden.lines(results))
            sys.exit(1)
    w.write("release", turns.settled(release.activate(w.releases(), a.release)))


def suite(w: Warehouse, a, name: str | None = None) -> DataFrame:
    asked = readers.questions(w.spark, _text(a.questions), golden.QUESTION)
    return turns.settled(golden.run(asked, w.tools(name), seam(a.model), None, seam(a.encoder), a.dimension or 0))


def eval_run(w: Warehouse, a) -> None:
    results = suite(w, a)
    _show(golden.lines(results))
    if not evals.report(results.select("layer", "status")).where("NOT ok").isEmpty():
        sys.exit(1)


def tools(w: Warehouse, a) -> None:
    row = w.spark.createDataFrame([("1", a.tool.replace("-", "_"), a.args)], "call_id string, tool string, args string")
    done = calls.run(row, w.tools()).first()
    if done.error:
        sys.exit(done.error)
    print(json.dumps(json.loads(done.result or "{}"), ensure_ascii=False, indent=1))


def chat(w: Warehouse, a) -> None:
    """One turn; its rows are appended to the log."""
    seq = w.spark.read.parquet(f"{w.root}/ops/turn").where(F.col("session_id") == a.session).count() + 1 if w.has("ops/turn") else 1
    asked = w.spark.createDataFrame([(f"{a.session}:{seq}", a.session, seq, a.text, None)], "turn_id string, session_id string, seq int, text string, history array<struct<role:string,text:string>>")
    r = turns.answer(asked, w.tools(), seam(a.model), encode=seam(a.encoder), dimension=a.dimension or 0)
    sinks.append_turn({"message": r.messages, "agent_invocation": r.invocations, "tool_call": r.tool_calls, "citation": r.citations, "turn": r.turns}, f"{w.root}/ops", f"{a.session}:{seq}")
    for m in r.messages.where("role = 'assistant'").orderBy("seq_in_turn").collect():
        print(m.text or m.payload)
    _json(r.sources.orderBy("position"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--root", required=True, help="folder of the tables")
    groups = p.add_subparsers(required=True)

    def command(group, name: str, run: Callable, *required: str, **optional) -> None:
        c = group.add_parser(name)
        for r in required:
            c.add_argument(f"--{r}", required=True)
        for o, kind in optional.items():
            c.add_argument(f"--{o}", type=kind, default=None)
        c.set_defaults(run=run)

    def group(name: str):
        return groups.add_parser(name).add_subparsers(required=True)

    g = group("ingest")
    command(g, "run", ingest_run, "client", "candidate", "sources", start=str, renderer=str)
    command(g, "verify", ingest_verify, reader=str)
    g = group("extract")
    command(g, "run", extract_run, "candidate", "model", families=str, redo=bool)
    g = group("release")
    command(g, "create", release_create, "client")
    command(g, "list", release_list)
    command(g, "export", release_export, "candidate", "out")
    command(g, "import", release_import, "candidate", "sheets", "families", "reviewer")
    command(g, "check", release_check, "candidate", "families", regions=str)
    command(g, "diff", release_diff, "candidate")
    command(g, "promote", release_promote, "candidate", "families", regions=str, year=int, month=int)
    command(g, "embed", release_embed, "release", "encoder", dimension=int)
    command(g, "activate", release_activate, "release", questions=str, model=str, encoder=str, dimension=int)
    g = group("eval")
    command(g, "run", eval_run, "questions", model=str, encoder=str, dimension=int)
    c = groups.add_parser("tools")
    c.add_argument("tool", choices=[t.replace("_", "-") for t in sorted(calls.TOOLS)])
    c.add_argument("args", help="arguments as JSON")
    c.set_defaults(run=tools)
    c = groups.add_parser("chat")
    c.add_argument("text")
    for name in ("session", "model"):
        c.add_argument(f"--{name}", required=True)
    c.add_argument("--encoder")
    c.add_argument("--dimension", type=int)
    c.set_defaults(run=chat)
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(Warehouse(spark or session(), a.root), a)


if __name__ == "__main__":
    main()
