"""The registered queries: every operator applied to the whole of its input view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.text import byte_length, normalize
from ..operators import chains, cleaning, clones, contracts, documents, findings, graphs, imports, packing, scans, selection, tokens
from ..sources import files as sources
from ..sources import sink
from .views import table, view

# Dates the time-dependent checks are run for.
AS_OF = "1999-06-30"
DEBT_AS_OF = "2024-09-01"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    """Register ``fn(v)``, where ``v(name)`` gives a view or a table, under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        known: dict[str, DataFrame] = {}

        def v(name: str) -> DataFrame:
            if name not in known:
                known[name] = (view if name.startswith("fx_") else table)(spark, sf_dir, name)
            return known[name]

        v.spark, v.sf_dir = spark, sf_dir
        return fn(v)

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def joined(column: str, sep: str = " | "):
    return F.array_join(column, sep).alias(column)


# A: file selection


@query
def a02_ignore_rules(v):
    return selection.ignore_rules(v("fx_ignore_files")).drop("regex")


@query
def a03_ignore_filter(v):
    rules = selection.ignore_rules(v("fx_ignore_files"))
    return selection.ignore_filter(v("fx_files"), rules).select("project", "path", "length")


@query
def a04_vcs_dir_filter(v):
    return selection.vcs_dir_filter(v("fx_files")).select("project", "path")


@query
def a05_root_path_filter(v):
    return selection.root_path_filter(v("fx_files"), ["src/", "docs"]).select("project", "path")


@query
def a06_size_filter(v):
    return selection.size_filter(v("fx_files"), 4096).select("project", "path", "length")


@query
def a06_oversize_report(v):
    return selection.oversize_files(v("fx_files"), 4096)


@query
def a07_text_filter(v):
    return selection.text_filter(v("fx_files"), by_content=True).select("project", "path")


@query
def a08_locale_order(v):
    return selection.locale_order(v("fx_files").select("project", "path", "seq"), "project", "path")


@query
def a09_effective_config(v):
    config = selection.effective_config(v("fx_config"))
    return config.withColumns(
        {c: F.array_join(c, ",") for c in ("whitelist", "clean_ignore", "pack_ignore")}
    )


@query
def a10_extension_filter(v):
    return selection.extension_filter(v("fx_files")).select("project", "path")


@query
def a11_input_path_filter(v):
    return selection.input_path_filter(v("fx_files"), ["src/auth/", "docs", "package.json"]).select("project", "path")


@query
def a12_changed_filter(v):
    return selection.changed_filter(v("fx_code"), v("fx_changes")).select("project", "path")


@query
def a12_staged_filter(v):
    return selection.changed_filter(v("fx_code"), v("fx_changes"), "staged").select("project", "path")


@query
def a12_audit_scope(v):
    return selection.audit_scope(v("fx_changes"))


@query
def a13_list_files(v):
    return selection.list_files(selection.vcs_dir_filter(v("fx_files")))


@query
def a13_list_files_with_reasons(v):
    files = v("fx_imports")
    return selection.list_files(files, imports.explain(_reach(v)))


@query
def a00_find_files(v):
    """The whole selection chain."""
    rules = selection.ignore_rules(v("fx_ignore_files"))
    found = selection.find_files(v("fx_files"), rules, ["src", "lib", "docs"], 16384, by_content=True)
    return found.select("project", "path", "length")


@query
def a00_clean_configured(v):
    """The whole cleaning command under each project's settings."""
    cleaned = chains.clean_configured(v("fx_tree"), v("fx_tree_config"))
    return cleaned.select("project", "path", "content", "removed")


@query
def a00_clean_configured_summary(v):
    return cleaning.clean_summary(chains.clean_configured(v("fx_tree"), v("fx_tree_config")), "project")


@query
def a00_pack_configured(v):
    return chains.pack_configured(v("fx_tree"), v("fx_tree_config")).select("project", "path", "text")


# B: comment removal


@query
def b01_strip_html_comments(v):
    cleaned = cleaning.clean_files(v("fx_pages"), selection.DEFAULT_WHITELIST)
    return cleaned.select("path", "content", "removed")


@query
def b02_strip_code_comments(v):
    cleaned = cleaning.clean_files(v("fx_code"), selection.DEFAULT_WHITELIST)
    return cleaned.select("project", "path", "content", "removed")


@query
def b02_strip_nested_comments(v):
    """Comments of code in templates and between tags; the texts there stay."""
    cleaned = cleaning.clean_files(v("fx_components"), selection.DEFAULT_WHITELIST)
    return cleaned.select("project", "path", "content", "removed")


@query
def b03_comment_keep_predicate(v):
    """What stays with other settings: doc blocks go, comments about rings stay."""
    cleaned = cleaning.clean_files(v("fx_code"), ["Ring"], keep_doc=False)
    return cleaned.select("path", "removed", joined("matches"))


@query
def b04_token_boundary_space(v):
    """Whole texts; in each a comment stands between two names."""
    return cleaning.clean_files(v("fx_code")).select("project", "path", "content")


def _cleaned_corpus(v):
    files = v("fx_pages").unionByName(v("fx_code"))
    return cleaning.clean_files(files, selection.DEFAULT_WHITELIST)


@query
def b05_clean_summary(v):
    return cleaning.clean_summary(_cleaned_corpus(v), "project")


@query
def b05_clean_total(v):
    """Bytes and tokens saved over all pages."""
    return cleaning.clean_summary(cleaning.clean_files(v("fx_pages"), selection.DEFAULT_WHITELIST))


@query
def b06_comment_previews(v):
    return cleaning.previews(_cleaned_corpus(v)).withColumn("previews", joined("previews"))


@query
def b07_clean_report(v):
    return cleaning.clean_report(_cleaned_corpus(v)).withColumn("previews", joined("previews"))


@query
def b08_write_cleaned(v):
    """Changed files, written by the sink and read back."""
    return _written(v, sources.write_cleaned)


@query
def b09_backup_originals(v):
    """Originals of the changed files, written by the sink and read back."""
    return _written(v, sources.backup_originals)


def _written(v, write):
    root = sink.new_folder(v.spark)
    write(_cleaned_corpus(v), root)
    place = F.split("path", "/", 2)
    return sources.scan_files(v.spark, root, in_tasks=True).select(place[0].alias("project"), place[1].alias("path"), F.col("content").cast("string").alias("content"))


# C: tokens


@query
def c02_token_cost(v):
    estimated = v("documents").groupBy("source").agg(
        F.sum(tokens.estimate_tokens(byte_length(F.col("text")))).alias("tokens")
    )
    return estimated.select(
        "source", "tokens", tokens.usd_text(tokens.token_cost(F.col("tokens"))).alias("usd")
    )


@query
def c03_token_estimate(v):
    return v("documents").select("doc_id", tokens.estimate_tokens(byte_length(F.col("text"))).alias("tokens"))


# D: packing

# Ties of files that may lack a text or share path and seq.
LOOSE = ("seq", "nth")


@query
def d01_pack_xml(v):
    """The whole context of each project."""
    return sources.assemble_context(packing.pack_xml(v("fx_files"), tie=("seq",), nameless=True), tie=("seq",))


@query
def d01_pack_xml_rows(v):
    return packing.pack_xml(v("fx_files"), tie=("seq",)).select("project", F.col("path").alias("first_path"), "text")


@query
def d02_pack_text(v):
    return sources.assemble_context(packing.pack_text(v("fx_files"), tie=("seq",), nameless=True, loose=True), tie=LOOSE)


@query
def d03_file_list(v):
    return sources.assemble_context(packing.file_list(v("fx_files"), tie=("seq",), nameless=True, loose=True), tie=LOOSE)


def _contexts(v, loose):
    files = v("fx_files")
    totals = packing.pack_summary(files).select("project", "tokens", "usd")
    totals = totals.na.fill(0) if loose else totals  # a project without any text
    return packing.pack_xml(files, tie=("seq",), loose=loose), packing.file_list(files, tie=("seq",), loose=loose), totals


def _filled(v, tie=("seq",)):
    parts, listed, totals = _contexts(v, tie == LOOSE)
    named = packing.resolve_source(v("fx_project_prompts").select("project", "source"), v("fx_templates"))
    return packing.fill_template(parts, listed, named.where("found").join(totals, "project"), tie=tie)


@query
def d04_fill_template(v):
    """Contexts filled into the template their project configures."""
    return sources.assemble_context(_filled(v, LOOSE), tie=LOOSE)


@query
def d04_fill_template_rows(v):
    return _filled(v).select("project", "slot", F.col("path").alias("first_path"), "text")


@query
def d05_resolve_template(v):
    return packing.resolve_source(v("fx_prompts").select("id", "source"), v("fx_templates"))


@query
def d05_resolve_template_name(v):
    return packing.resolve_name(v("fx_prompts").select("id", "named"), v("fx_templates"))


def _chosen(v, tie=("seq",)):
    prompts = v("fx_project_prompts")
    sources, names = prompts.select("project", "source"), prompts.select("project", "named")
    return packing.choose_output(*_contexts(v, tie == LOOSE), sources, names, v("fx_templates"), tie=tie)


@query
def d06_choose_output(v):
    """The whole output of each project, or why it has none."""
    chosen = _chosen(v, LOOSE)
    whole = sources.assemble_context(chosen.where("error IS NULL").drop("error"), tie=LOOSE)
    none = chosen.where("error IS NOT NULL").select("project", *[F.lit(0).cast("bigint").alias(c) for c in ("part", "start", "pieces")], "text", "error")
    return whole.withColumn("error", F.lit(None).cast("string")).unionByName(none)


@query
def d07_write_context(v):
    """Every piece of the written contexts, read back from its place in its project's file."""
    root = sink.new_folder(v.spark)
    pieces = sources.write_context(packing.pack_text(v("fx_files"), tie=("seq",)), root, tie=("seq",))
    return sink.read_pieces(pieces, root).select("project", "path", "seq", "start", F.col("content").cast("string").alias("text"))


@query
def d07_context_files(v):
    """Files the sink makes of the chosen outputs, templates included, and their sizes."""
    root = sink.new_folder(v.spark)
    sources.write_context(_chosen(v), root, "context.xml", tie=("seq",))
    return sources.scan_files(v.spark, root, in_tasks=True, content=False).select("path", "length")


@query
def d08_pack_summary(v):
    return packing.pack_summary(v("fx_files"), "markdown")


@query
def d09_pack_clean(v):
    return sources.assemble_context(packing.pack(v("fx_code"), clean=True, nameless=True, keep_words=selection.DEFAULT_WHITELIST))


# E: import graph


@query
def e01_import_edges_raw(v):
    return imports.import_edges_raw(v("fx_imports"))


def _edges(v):
    files = v("fx_imports")
    return imports.resolve_imports(imports.import_edges_raw(files), files.select("project", "path"))


@query
def e02_resolve_imports(v):
    return _edges(v)


def _configs(v):
    return v("fx_aliased").where("path LIKE '%.json'")


@query
def e02_path_aliases(v):
    """Aliases in force in each project, inherited ones included."""
    return imports.path_aliases(_configs(v)).withColumn("targets", joined("targets"))


@query
def e02_resolve_aliases(v):
    files = v("fx_aliased")
    return imports.resolve_imports(imports.import_edges_raw(files), files.select("project", "path"), imports.path_aliases(_configs(v)))


def _reach(v, max_depth: int = 0):
    entries = v.spark.createDataFrame([("app", "src/part0.ts")], "project string, path string")
    return imports.reachable(imports.graph_edges(_edges(v)), entries, max_depth)


@query
def e03_reachable(v):
    return _reach(v).select("project", "path", "depth")


@query
def e03_reachable_bounded(v):
    return _reach(v, 3).select("project", "path", "depth")


@query
def e04_explain(v):
    return imports.explain(_reach(v))


@query
def e05_pack_reachable(v):
    return imports.pack_reachable(v("fx_imports"), _reach(v)).select("project", "path", "text")


@query
def e06_import_cycles(v):
    """Files on a circle of imports, with the first file of their strongly connected component."""
    files = v("fx_modules")
    resolved = imports.resolve_imports(imports.import_edges_raw(files), files.select("project", "path"))
    return graphs.cycles(imports.graph_edges(resolved))


# F: product documents


@query
def f01_sections(v):
    return documents.sections(v("fx_docs"))


@query
def f01_stand_block(v):
    return documents.stand_block(v("fx_runbooks"), "dev")


@query
def f02_list_items(v):
    return documents.section_items(v("fx_docs"), "## Out of scope").select("project", "item")


@query
def f03_table_first_column(v):
    return documents.section_cells(v("fx_docs"), "## Entities", documents.ENTITY_HEADERS).select("project", "cell")


@query
def f04_keywords(v):
    words = md.keywords(F.col("text"))
    return v("conversations").select("conv_id", "turn", F.array_join(words, " ").alias("words"))


@query
def f05_normalize(v):
    return v("conversations").select("conv_id", "turn", normalize(F.col("text")).alias("text"))


@query
def f06_doc_metadata(v):
    return documents.doc_metadata(v("fx_docs"))


@query
def f06_metadata_issues(v):
    return documents.metadata_issues(v("fx_docs")).select("project", "rel_path", "detail")


@query
def f07_required_documents_and_headings(v):
    return documents.required_documents_and_headings(
        v("fx_docs").unionByName(v("fx_runbooks").withColumn("rel_path", F.lit(documents.INDEX)))
    ).select("project", "rel_path", "rule", "detail")


@query
def f08_placeholders(v):
    return documents.placeholders(v("fx_docs")).select("project", "rel_path", "line", "detail")


def _texts(v):
    return v("fx_texts").withColumnRenamed("path", "rel_path")


@query
def f09_banned_words(v):
    found = documents.banned_words(v("fx_docs").unionByName(_texts(v)))
    return found.select("project", "rel_path", "line", "rule", "detail")


@query
def f10_short_sections(v):
    return documents.short_sections(v("fx_docs")).select("project", "rel_path", "detail")


@query
def f11_metrics_without_number(v):
    return documents.metrics_without_number(v("fx_docs")).select("project", "detail")


@query
def f12_scope_contradictions(v):
    return documents.scope_contradictions(v("fx_docs"))


@query
def f13_excluded_but_specified(v):
    return documents.excluded_but_specified(v("fx_docs"))


@query
def f14_capability_coverage(v):
    return documents.capability_coverage(v("fx_docs"))


@query
def f15_inscope_coverage(v):
    return documents.inscope_coverage(v("fx_docs"))


@query
def f16_entities_without_operation(v):
    return documents.entities_without_operation(v("fx_docs"))


@query
def f17_testing_subsections(v):
    return documents.testing_subsections(v("fx_docs"))


@query
def f18_unused_glossary_terms(v):
    return documents.unused_glossary_terms(v("fx_docs"))


@query
def f19_goal_conflicts(v):
    return documents.goal_conflicts(v("fx_docs"))


@query
def f20_unmentioned_artifacts(v):
    return documents.unmentioned_artifacts(v("fx_artifacts"), v("fx_docs"))


@query
def f21_status_report(v):
    return documents.status_report(v("fx_docs"))


@query
def f22_set_status(v):
    return documents.set_status(v("fx_docs"), "approved", "2024-12-31")


@query
def f23_validate_documents(v):
    return documents.validate_documents(v("fx_docs"), v("fx_artifacts")).select(
        "project", "stage", "rel_path", "rule", "detail"
    )


@query
def f23_validate_projects(v):
    """The gate on documents that reach its later stages, names first."""
    return documents.validate_projects(v("fx_gate"), v("fx_artifacts")).select("project", "stage", "rel_path", "rule", "detail")


@query
def f24_project_name_issues(v):
    return documents.project_name_issues(v("fx_names"))


# G: technical contracts


@query
def g01_missing_files(v):
    return contracts.missing_files(v("fx_blueprints"))


@query
def g02_code_block(v):
    return contracts.code_blocks(v("fx_blueprints"))


@query
def g03_layer_paths(v):
    return contracts.layer_paths(v("fx_blueprints"))


@query
def g04_model_coverage(v):
    return contracts.model_coverage(v("fx_blueprints"))


@query
def g05_traceability(v):
    return contracts.traceability(v("fx_blueprints"))


@query
def g06_list_fields_without_paging(v):
    return contracts.list_fields_without_paging(v("fx_blueprints"))


@query
def g07_models_without_timestamps(v):
    return contracts.models_without_timestamps(v("fx_blueprints"))


@query
def g08_guide_sections(v):
    return contracts.guide_sections(v("fx_blueprints"))


@query
def g09_migration_section(v):
    return contracts.migration_section(v("fx_blueprints"))


@query
def g10_blueprint_verdict(v):
    return contracts.blueprint_verdict(v("fx_blueprints"))


# H: findings and scans


@query
def h01_detect_runtime(v):
    return scans.detect_runtime(v("fx_files").unionByName(v("fx_env"), allowMissingColumns=True))


@query
def h02_detect_stack(v):
    return scans.detect_stack(v("fx_files"))


@query
def h03_parse_findings(v):
    return findings.parse_findings(v("fx_reports"))


def _accepted(v):
    return findings.apply_baseline(v("fx_findings"), v("fx_baseline"))


@query
def h04_apply_baseline(v):
    return _accepted(v).select("session", "audit", "check_id", "solution", "status", "expires", "baseline_type")


@query
def h05_expire_baseline(v):
    expired = findings.expire_baseline(_accepted(v), AS_OF)
    return expired.select("session", "check_id", "solution", "status", "severity", "note")


@query
def h05_expired_entries(v):
    return findings.expired_entries(v("fx_baseline"), AS_OF).select("check_id", "expires", "accepted_by", "reason")


@query
def h05_session_status(v):
    """Every finding as its baseline had it on the day of its session."""
    known = v("fx_findings").select("project", "session", "check_id", "file", "status", "severity", "solution")
    return findings.session_status(known, v("fx_baseline_periods"))


@query
def h06_untyped_baseline(v):
    return findings.untyped_baseline(v("fx_baseline"))


@query
def h07_component_summary(v):
    return findings.component_summary(_accepted(v))


@query
def h08_critical_breakdown(v):
    return findings.critical_breakdown(v("fx_findings"))


@query
def h09_uncovered_modules(v):
    return findings.uncovered_modules(v("fx_files"), v("fx_findings"))


@query
def h10_weak_evidence(v):
    return findings.weak_evidence(v("fx_findings")).select("session", "check_id", "solution", "problem")


@query
def h11_verify_findings(v):
    verified = findings.verify_findings(v("fx_findings").withColumn("project", F.lit("app")), v("fx_imports"))
    return verified.select("session", "check_id", "solution", "evidence", "verdict")


def _verified_secrets(v):
    return findings.verify_findings(v("fx_secret_findings"), v("fx_secrets"))


@query
def h11_verify_project_findings(v):
    """Ten projects with equal paths: each finding is held against the files of its own."""
    return _verified_secrets(v).select("project", "check_id", "severity", "evidence", "verdict")


@query
def h12_stale_sessions(v):
    return findings.stale_sessions(v("fx_sessions"), AS_OF)


@query
def h13_latest_session(v):
    return findings.latest_session(v("fx_sessions"))


@query
def h13_keep_newest(v):
    return findings.keep_newest(v("fx_sessions"))


@query
def h14_merge_reports(v):
    parsed = findings.parse_findings(v("fx_reports"))
    merged = findings.merge_reports(parsed, v("fx_findings"))
    return merged.select("session", "audit", "component", "check_id", "check", "status", "severity", "evidence", "solution")


def _rewritten(v):
    reports = v("fx_reports").withColumn("project", F.col("component"))
    rows = findings.report_rows(reports, "project", "report")
    verified = findings.verify_findings(rows, v("fx_report_files"))
    verdict = F.when(F.col("verdict") == "stale", "gone").when((F.col("verdict") == "confirmed") & (F.col("report") % 5 == 0), "stale")
    note = F.when((F.col("verdict") == "confirmed") & (F.col("status") == "ACCEPTED") & (F.col("report") % 5 != 0), "[baseline expired: 1997-01-01]")
    verdicts = verified.withColumns({"note": note, "verdict": verdict.otherwise(F.col("verdict"))})
    added = reports.where("report % 4 = 0").select("project", "report", F.lit("| SEC-07 | Missed | ❌ FAIL 🔴 | `src/b.ts:1` | — | No |").alias("row"))
    return findings.rewrite_reports(reports, verdicts, added, "project", "report")


@query
def h14_rewrite_reports(v):
    """Reports that change after verification, whole."""
    return _rewritten(v)[0].select("project", "report", "content")


@query
def h14_removal_log(v):
    return _rewritten(v)[1]


@query
def h15_scan_patterns(v):
    return scans.scan_patterns(v("fx_texts"))


@query
def h15_scan_secrets(v):
    """Every kind of secret and of placeholder."""
    return scans.scan_patterns(v("fx_secrets"))


@query
def h16_critical_paths(v):
    """Files of the layout whose text, headed by its path, mentions a critical word."""
    named = v("fx_files").withColumn("content", F.concat_ws("\n", "path", "content"))
    return scans.critical_paths(named)


@query
def h17_extract_env_vars(v):
    files = v("fx_env")
    return scans.extract_env_vars(files, scans.detect_runtime(files))


@query
def h18_env_sync(v):
    files = v("fx_env")
    used = scans.extract_env_vars(files, scans.detect_runtime(files))
    return scans.env_sync(used, scans.documented_env_vars(files))


@query
def h18_command_sync(v):
    return scans.env_sync(scans.manifest_commands(v("fx_manifests")), scans.documented_commands(v("fx_readmes")))


@query
def h19_broken_links(v):
    artifacts = v("fx_artifacts").withColumnRenamed("rel_path", "path")
    return scans.broken_links(v("fx_docs"), artifacts)


@query
def h20_duplicate_blocks(v):
    return scans.duplicate_blocks(v("fx_texts"))


@query
def h20_clone_classes(v):
    """What each duplicated region is a copy of, wherever the lines break."""
    broken = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "\n", " ")).when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit(". "), F.lit(".\n")))
    files = v("documents").select(
        F.col("source").alias("project"), F.concat(F.lit("doc"), "doc_id", F.lit(".md")).alias("path"), F.coalesce(broken, "text").alias("content")
    )
    return clones.clone_classes(files)


@query
def h21_debt_markers(v):
    return scans.debt_markers(v("fx_debt"), DEBT_AS_OF)


@query
def h22_verification_totals(v):
    known = v("fx_findings").withColumn("project", F.lit("app"))
    return findings.verification_totals(findings.verify_findings(known, v("fx_imports")), "audit")


def _missed(v):
    return findings.missed_findings(_verified_secrets(v), scans.scan_patterns(v("fx_secrets")))


@query
def h22_missed_findings(v):
    return _missed(v)


@query
def h22_verification_with_missed(v):
    both = _verified_secrets(v).select("project", "verdict").unionByName(_missed(v).select("project", "verdict"))
    return findings.verification_totals(both, "project")


# Components of the import graph: the leading digit of a part.
ROLES = [(f"parts_{d}", rf"^src/part{d}") for d in range(1, 8)]


@query
def h23_call_matrix(v):
    edges = _edges(v).where("resolved IS NOT NULL").select(
        F.col("path").alias("src"), F.col("resolved").alias("dst"), F.col("kind").alias("purpose")
    )
    return scans.call_matrix(edges, ROLES)


def _merged(v):
    role = F.regexp_extract(F.col("path"), r"part(\d{1,2})", 1)
    edges = _edges(v).where("resolved IS NOT NULL")
    callee = F.regexp_extract("resolved", r"part(\d{1,2})", 1)
    return scans.merge_components(edges.select(role.alias("caller"), callee.alias("callee"), F.col("kind").alias("purpose")))


@query
def h23_merged_components(v):
    """A hundred components of the import graph merged until a matrix stays readable."""
    return _merged(v)[0]


@query
def h23_merged_calls(v):
    return _merged(v)[1]


@query
def h24_classify_manifest(v):
    return scans.classify_manifest(v("fx_manifests"))


@query
def h25_active_decisions(v):
    return scans.active_decisions(v("fx_decisions"))


@query
def h26_project_stage(v):
    return scans.project_stage(v("fx_workspace"))


@query
def h27_checks_catalog(v):
    return findings.catalog_coverage(v("fx_findings"))
