"""The queries of the core, by name, over a folder of tables, and their statements in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import mask
from siftline.operators import code, configs, containers, findings, graph, lexical, nested, rules, sca, semantic, taint
from siftline.plans import sql
from siftline.plans.scan import Scan
from siftline.session import written
from siftline.sinks import reports
from siftline.sources import baseline, corpus, manifests
from siftline.sources.tables import table
from siftline.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2026-10-01"
FILE = ["project", "rel_path"]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.version_bounds(table(spark, folder, "advisory_raw"))


def _level(name: str, *cols: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return nested.flat_tables(table(spark, folder, "advisory_raw"))[name].select(*nested.KEYS[name], *cols)

    return query


def p4_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """How often each state of the automaton occurs on each level."""
    raw = table(spark, folder, "advisory_raw")
    t = nested.flat_tables(raw, written(nested.classified(raw), "classified"))
    out = [t[level].groupBy("state").agg(F.count(F.lit(1)).alias("n")).select(F.lit(level).alias("level"), "state", "n") for level in nested.KEYS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def src_files(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.gated(table(spark, folder, "source_files"), exclude=("*.xml", "services/schema-10014")).select("file_key", "verdict")


def src_lines(spark: SparkSession, folder: str) -> DataFrame:
    x = corpus.lines(table(spark, folder, "source_files"), ["file_key"])
    return x.groupBy("file_key").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("line")).alias("longest"))


def _file_lines(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.lines(table(spark, folder, "source_files"), ["file_key"])


def lex_code_hits(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rule_hits(_file_lines(spark, folder), ["file_key"], rules.CODE_RULES).select("file_key", "line_no", "rule_id", "severity")


def lex_secret_hits(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rule_hits(_file_lines(spark, folder), ["file_key"], rules.SECRET_RULES).select("file_key", "line_no", "rule_id", "evidence")


def lex_document_hits(spark: SparkSession, folder: str) -> DataFrame:
    x = lexical.rule_hits(corpus.lines(table(spark, folder, "documents"), ["doc_id"], "text"), ["doc_id"])
    return x.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


def lex_evidence_hits(spark: SparkSession, folder: str) -> DataFrame:
    x = lexical.rule_hits(corpus.lines(table(spark, folder, "findings"), ["finding_key"], "evidence"), ["finding_key"])
    return x.select("finding_key", "line_no", "rule_id", "severity")


def lex_webhooks(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.missing_webhook_signature(corpus.lines(table(spark, folder, "documents"), ["doc_id"], "text"), ["doc_id"])


def flt_masked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "findings").select("finding_key", mask("evidence").alias("masked"))


def fnd_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return findings.tagged(table(spark, folder, "findings")).select("finding_key", "canon", "cwe", "fp")


def ddp_exact(spark: SparkSession, folder: str) -> DataFrame:
    return findings.first_by_fingerprint(table(spark, folder, "findings"))


def ddp_merged(spark: SparkSession, folder: str) -> DataFrame:
    m = findings.merged(table(spark, folder, "findings"))
    lists = [F.array_join(c, "|").alias(c) for c in ("detector_ids", "evidences", "related_findings")]
    return m.select("project", "base_key", "file_lc", "line", "n", "title", "canonical_rule", "category", "severity", "cwe", "confidence", "source", "sink", "evidence", *lists)


def ddp_wide(spark: SparkSession, folder: str) -> DataFrame:
    m = findings.merged(table(spark, folder, "findings"), wide=True)
    return m.select("project", "base_key", "file_lc", "line", "n", "severity", F.array_join("detector_ids", "|").alias("detector_ids"))


def dif_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Every source file as the diff that adds it."""
    text = F.concat(F.lit("diff --git a/"), "rel_path", F.lit(" b/"), "rel_path", F.lit("\n+++ b/"), "rel_path", F.lit("\n+"), F.regexp_replace("content", "\n", "\n+"))
    d = corpus.lines(table(spark, folder, "source_files").select("file_key", text.alias("diff")), ["file_key"], "diff")
    return lexical.diff_secrets(corpus.diff_added(d, "file_key"), ["file_key", "line_no"])


def git_tracked(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.tracked_sensitive(table(spark, folder, "source_files"), ["file_key"])


def cnf_scores(spark: SparkSession, folder: str) -> DataFrame:
    return findings.scored(table(spark, folder, "findings")).select("finding_key", "score", "label")


def cor_chains(spark: SparkSession, folder: str) -> DataFrame:
    return findings.chains(table(spark, folder, "findings"))


def cor_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return findings.ranked_chains(table(spark, folder, "findings")).select("project", "chain_id", "vuln_class", "file", "score", "rationale")


def cor_members(spark: SparkSession, folder: str) -> DataFrame:
    return findings.chain_members(table(spark, folder, "findings"))


def flt_ignored(spark: SparkSession, folder: str) -> DataFrame:
    """Files that the suppressed paths of their project would ignore."""
    s = table(spark, folder, "suppressions").where("project IS NOT NULL AND file IS NOT NULL").select("project", F.col("file").alias("pattern")).distinct()
    return corpus.ignored(table(spark, folder, "source_files"), s).select("file_key")


def flt_changed(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "findings")
    return findings.changed_only(f, table(spark, folder, "source_files")).select("finding_key")


def cor_scope(spark: SparkSession, folder: str) -> DataFrame:
    return findings.scope(table(spark, folder, "findings"))


def sup_active(spark: SparkSession, folder: str) -> DataFrame:
    return findings.unsuppressed(table(spark, folder, "findings"), table(spark, folder, "suppressions"), AS_OF).select("finding_key", "project")


def rsk_projects(spark: SparkSession, folder: str) -> DataFrame:
    return findings.project_scores(table(spark, folder, "findings"))


def cat_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return findings.by_category(table(spark, folder, "findings"))


def sca_matches(spark: SparkSession, folder: str) -> DataFrame:
    return sca.matches(table(spark, folder, "deps"), table(spark, folder, "advisories")).select("eco", "pkg", "version", "adv_key")


def sca_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return sca.distinct_deps(table(spark, folder, "deps"))


def sca_severity(spark: SparkSession, folder: str) -> DataFrame:
    return sca.derived_severity(table(spark, folder, "advisories"))


def sca_best_fix(spark: SparkSession, folder: str) -> DataFrame:
    return sca.best_fixes(table(spark, folder, "advisories"))


def sca_upsert(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "advisories")
    late = F.col("loaded_at") >= F.lit(AS_OF).cast("timestamp")
    return sca.upserted(a.where(~late), a.where(late)).select("adv_key", "id")


def sca_stats(spark: SparkSession, folder: str) -> DataFrame:
    return sca.stats(table(spark, folder, "advisories"))


def sca_top(spark: SparkSession, folder: str) -> DataFrame:
    return sca.top_advisories(sca.matches(table(spark, folder, "deps"), table(spark, folder, "advisories")))


def sca_findings(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "advisories")
    return sca.dep_findings(sca.matches(table(spark, folder, "deps"), a), a)


def sca_cache(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "deps")
    rows = sca.distinct_deps(d).select("eco", "pkg", "version")
    eco, pkg = sca.package_key("ecosystem", "name")
    cache = d.where("version IS NOT NULL").select(eco.alias("eco"), pkg.alias("pkg"), F.trim("version").alias("version"), F.col("seen_at").alias("cached_at"))
    return sca.cache_lookup(rows, cache, AS_OF, hours=24 * 60)


def sca_saved(spark: SparkSession, folder: str) -> DataFrame:
    """What was seen of each dependency up to a day, as the cache, after what was seen later is saved."""
    d = table(spark, folder, "deps").where("version IS NOT NULL AND seen_at IS NOT NULL")
    eco, pkg = sca.package_key("ecosystem", "name")
    rows = d.select(eco.alias("eco"), pkg.alias("pkg"), F.trim("version").alias("version"), F.col("seen_at").alias("cached_at"), "source_file")
    late = F.col("cached_at") >= F.lit("2026-07-01").cast("timestamp")
    return sca.cache_saved(rows.where(~late), rows.where(late))


def cfg_entries(spark: SparkSession, folder: str) -> DataFrame:
    return configs.flat_entries(table(spark, folder, "source_files")).select(*FILE, "line_no", "format", "section", "key", "value")


def cfg_nested(spark: SparkSession, folder: str) -> DataFrame:
    return configs.nested_entries(table(spark, folder, "source_files")).select(*FILE, "line_no", "format", "key", "value")


def cfg_hits(spark: SparkSession, folder: str) -> DataFrame:
    return configs.config_hits(configs.entries(table(spark, folder, "source_files")))


def cfg_flat_hits(spark: SparkSession, folder: str) -> DataFrame:
    return configs.config_hits(configs.flat_entries(table(spark, folder, "source_files"))).select(*FILE, "line_no", "rule_id", "severity", "key")


def cfg_env_ignored(spark: SparkSession, folder: str) -> DataFrame:
    return configs.env_not_ignored(table(spark, folder, "source_files"))


def dck_instructions(spark: SparkSession, folder: str) -> DataFrame:
    return containers.instructions(table(spark, folder, "source_files"))


def dck_hits(spark: SparkSession, folder: str) -> DataFrame:
    return containers.dockerfile_hits(table(spark, folder, "source_files"))


def dck_services(spark: SparkSession, folder: str) -> DataFrame:
    lists = [F.array_join(c, "|").alias(c) for c in ("ports", "volumes", "cap_add", "env")]
    return containers.services(table(spark, folder, "source_files")).select(*FILE, "service", "line_no", "image", "user", "privileged", *lists)


def dck_compose(spark: SparkSession, folder: str) -> DataFrame:
    return containers.compose_hits(containers.services(table(spark, folder, "source_files")))


def dck_context(spark: SparkSession, folder: str) -> DataFrame:
    return containers.exposed_context(table(spark, folder, "source_files"))


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return written(code.facts(table(spark, folder, "source_files")), "facts")


def ast_functions(spark: SparkSession, folder: str) -> DataFrame:
    f = code.facts(table(spark, folder, "source_files")).where("kind = 'function'")
    return f.select(*FILE, "func", "line", "end_line", "name", F.array_join("args", ",").alias("params"))


def ast_facts(spark: SparkSession, folder: str) -> DataFrame:
    return code.facts(table(spark, folder, "source_files")).groupBy(*FILE, "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"))


def sem_imports(spark: SparkSession, folder: str) -> DataFrame:
    return graph.resolved_imports(_facts(spark, folder))


def sem_calls(spark: SparkSession, folder: str) -> DataFrame:
    return graph.call_edges(_facts(spark, folder))


def sem_paths(spark: SparkSession, folder: str) -> DataFrame:
    facts = _facts(spark, folder)
    at = lambda a, b: F.concat_ws(":", a, b)
    edges = graph.call_edges(facts).select("project", at("caller_file", "caller").alias("a"), at("callee_file", "callee").alias("b"))
    sinks = facts.where("kind = 'call' AND func <> ''").where(taint.sink_kind(F.col("name")).isNotNull()).select("project", at("rel_path", "func").alias("node"))
    sources = semantic.entries(facts).select("project", at("rel_path", "func").alias("node"))
    p = graph.paths_to(edges, sinks.unionByName(edges.select("project", F.col("b").alias("node"))).distinct(), sources=sources)
    return p.select("project", "start", "sink", F.array_join("path", " > ").alias("path"))


def grf_levels(spark: SparkSession, folder: str) -> DataFrame:
    e = written(graph.flow_edges(table(spark, folder, "findings")), "flow-edges")
    roots = e.where(F.startswith("a", F.lit("request."))).select("project", F.col("a").alias("node"))
    return graph.levels(e, roots)


def tnt_flows(spark: SparkSession, folder: str) -> DataFrame:
    return taint.flows(_facts(spark, folder))


def tnt_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return taint.flow_kinds(table(spark, folder, "findings"))


def tnt_tiers(spark: SparkSession, folder: str) -> DataFrame:
    return semantic.verified(table(spark, folder, "findings"))


def rul_hits(spark: SparkSession, folder: str) -> DataFrame:
    return semantic.semantic_hits(_facts(spark, folder))


def rul_markup(spark: SparkSession, folder: str) -> DataFrame:
    return semantic.raw_html_hits(corpus.lines(table(spark, folder, "findings"), ["finding_key"], "evidence"), ["finding_key"])


def sec_scores(spark: SparkSession, folder: str) -> DataFrame:
    return semantic.secret_scores(corpus.lines(table(spark, folder, "source_files"), ["file_key", "rel_path"]), ["file_key", "rel_path"])


def ben_labels(spark: SparkSession, folder: str) -> DataFrame:
    return semantic.label_percentages(findings.scored(table(spark, folder, "findings")))


def rsk_levels(spark: SparkSession, folder: str) -> DataFrame:
    p = findings.project_scores(table(spark, folder, "findings"))
    return p.select("project", "score", semantic.risk_level(F.col("score")).alias("level"))


def ldf_scopes(spark: SparkSession, folder: str) -> DataFrame:
    return semantic.enclosing_functions(_facts(spark, folder))


def str_sessions(spark: SparkSession, folder: str) -> DataFrame:
    s = streams.stream_table(spark, folder, "incoming_findings").select("received_at", "project")
    return streams.drained(streams.session_counts(s, "received_at", "project", late="1500 days"), "sessions", "complete")


def fwk_routes(spark: SparkSession, folder: str) -> DataFrame:
    return code.routes(corpus.lines(table(spark, folder, "source_files"), FILE))


def fwk_detected(spark: SparkSession, folder: str) -> DataFrame:
    return code.frameworks(table(spark, folder, "source_files"))


def dep_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """The dependencies read back from manifests that are written from the table of dependencies."""
    return manifests.dependencies(manifests.rendered(table(spark, folder, "deps"))).distinct()


def osv_records(spark: SparkSession, folder: str) -> DataFrame:
    r = baseline.advisory_records(table(spark, folder, "advisory_raw"))
    return r.select("raw_id", "vuln_pos", "affected_pos", "id", "package", "ecosystem", F.array_join("fixed_versions", ",").alias("fixed_versions"), "n_ranges")


def osv_ratings(spark: SparkSession, folder: str) -> DataFrame:
    r = baseline.advisory_ratings(table(spark, folder, "advisory_raw"))
    return r.select("raw_id", "vuln_pos", "severity", F.array_join("cwes", ",").alias("cwes"), "cvss")


def rep_document(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines each part of the SARIF document has, and how many of them follow a comma."""
    x = reports.sarif_document(table(spark, folder, "findings"))
    return x.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.startswith("text", F.lit(",")).cast("int")).cast("bigint").alias("commas"))


def rep_results(spark: SparkSession, folder: str) -> DataFrame:
    return reports.sarif_results(table(spark, folder, "findings"))


def rep_rules(spark: SparkSession, folder: str) -> DataFrame:
    return reports.sarif_rules(table(spark, folder, "findings"))


def rep_html(spark: SparkSession, folder: str) -> DataFrame:
    return reports.html_rows(table(spark, folder, "findings"))


def str_days(spark: SparkSession, folder: str) -> DataFrame:
    return streams.severity_days(spark, folder)


def _scanned(spark: SparkSession, folder: str) -> Scan:
    return Scan(table(spark, folder, "source_files"), deps=table(spark, folder, "deps"), advisories=table(spark, folder, "advisories"), suppressions=table(spark, folder, "suppressions"))


def scn_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of a whole scan of the source files and dependencies."""
    return _scanned(spark, folder).run().findings.select("project", "file", "line", "canonical_rule", "severity", "score", "label", F.array_join("detector_ids", ",").alias("detectors"))


def scn_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scanned(spark, folder).run().scores


def queries() -> dict[str, Query]:
    own = [
        p4_found, p4_shapes, src_files, src_lines, lex_code_hits, lex_secret_hits, lex_document_hits, lex_evidence_hits, lex_webhooks, flt_masked,
        fnd_canonical, ddp_exact, ddp_merged, ddp_wide, dif_secrets, git_tracked, cnf_scores, cor_chains, cor_ranked, cor_members, cor_scope, flt_ignored, flt_changed, sup_active, rsk_projects, cat_rollup,
        sca_matches, sca_distinct, sca_severity, sca_best_fix, sca_upsert, sca_stats, sca_top, sca_findings, sca_cache, sca_saved,
        cfg_entries, cfg_nested, cfg_hits, cfg_flat_hits, cfg_env_ignored, dck_instructions, dck_hits, dck_services, dck_compose, dck_context,
        ast_functions, ast_facts, sem_imports, sem_calls, sem_paths, grf_levels, tnt_flows, tnt_kinds, fwk_routes, fwk_detected,
        dep_manifests, osv_records, osv_ratings, rep_document, rep_results, rep_rules, rep_html, str_days, str_sessions,
        tnt_tiers, rul_hits, rul_markup, sec_scores, ben_labels, rsk_levels, ldf_scopes, scn_findings, scn_scores,
    ]
    levels = {
        "p4_vulnerabilities": _level("vulnerabilities", "envelope", "vuln_id", "summary"),
        "p4_affected": _level("affected", "package", "ecosystem"),
        "p4_ranges": _level("ranges", "range_type"),
    }
    return {q.__name__: q for q in own} | levels


def oracle_sql() -> dict[str, str]:
    return sql.statements()
