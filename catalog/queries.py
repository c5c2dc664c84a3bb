"""One query per operator; each takes (spark, sf_dir)."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from veilframe.functions import match, paths as P, secrets as S, text as T
from veilframe.operators import audit, context, detectors as D, mapping, reuse, rollups, rule_index, rules, symbols
from veilframe.plans import flows
from veilframe.policy import REDACT, policy_fingerprint
from veilframe.sources import manifest as M, tables
from veilframe.sources.scratch import new_folder, written
from veilframe.sources.workspace import read_workspace
from veilframe.streaming import lines, state, sync

from . import inputs as I

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def evaluated(spark, sf_dir) -> DataFrame:
    return rules.apply_policy(I.files(spark, sf_dir), I.FILES_POLICY)


# --- sources and sinks ---------------------------------------------------------------------------

def write_tree(files: DataFrame, folder: str) -> str:
    """Every file of a frame (path, text) as a real file, written by the executors; the local path of the folder."""
    top = folder.removeprefix("file://").removeprefix("file:")

    def write(batches):
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                os.makedirs(os.path.dirname(f"{top}/{path}"), exist_ok=True)
                with open(f"{top}/{path}", "wb") as file:
                    file.write((text or "").encode())
            yield batch.select(["path"])

    files.select("path", "text").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    return top


@query
def s1_read_workspace(spark, sf_dir):
    """All documents as files of a tree, listed and read back."""
    root = write_tree(I.files(spark, sf_dir), new_folder(spark, "tree"))
    return read_workspace(spark, root).select("path", "size", T.decode_text(F.col("content")).isNotNull().alias("is_text"),
                                              F.sha2("content", 256).alias("sha"))


@query
def j1_reuse_from_tree(spark, sf_dir):
    """A second run over a tree in which every seventh file has grown: only these are read."""
    folder = new_folder(spark, "tree-run")
    files = I.files(spark, sf_dir)
    root = write_tree(files, f"{folder}/tree")
    flows.run_tree(spark, root, I.FILES_POLICY, f"{folder}/kept")
    write_tree(files.where("doc_id % 7 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("!"))), f"{folder}/tree")
    run = flows.run_tree(spark, root, I.FILES_POLICY, f"{folder}/kept")
    staged = M.read_staged(spark, f"{folder}/kept/staged").select("root", "path", "text")
    return run.decisions.join(staged, ["root", "path"], "left").select(
        "path", "size", "cache_hit", "disposition", F.sha2("text", 256).alias("text_sha"), I.finding_lines().alias("findings"))


@query
def s2_files_from_table(spark, sf_dir):
    return I.files(spark, sf_dir).select("root", "source_path", "path", F.sha2("text", 256).alias("text_sha"),
                                         "size", "mtime_ms")


@query
def s3_rules_frame(spark, sf_dir):
    frame = tables.rules_frame(spark, I.FILES_POLICY, "files")
    hits = rules.rule_hits(I.files(spark, sf_dir), I.FILES_POLICY).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("files"))
    return frame.join(hits, "rule_id", "left").select(
        "policy_id", F.col("rule_ord").cast("long"), "rule_id", "action", F.concat_ws(" ", "paths").alias("paths"),
        F.concat_ws(" ", "path_regex").alias("path_regex"), F.coalesce("replacement", "default_replacement")
        .alias("replacement"), F.coalesce("files", F.lit(0)).alias("files"))


@query
def s4_manifest_roundtrip(spark, sf_dir):
    folder = new_folder(spark, "manifest")
    M.write_manifest(evaluated(spark, sf_dir), folder, I.FILES_POLICY)
    return M.read_manifest(spark, folder, I.FILES_POLICY).select(
        F.col("version").cast("long"), "root", "source_path", "size", "mtime_ms", "disposition",
        F.sha2("sanitized_text", 256).alias("sanitized_sha"), I.finding_lines().alias("findings"))


@query
def s5_write_staged(spark, sf_dir):
    folder = new_folder(spark, "staged")
    # Every 17th file is binary: it has bytes and no text.
    files = I.files(spark, sf_dir).withColumn("content", F.encode("text", "UTF-8")).withColumn(
        "text", F.when(F.col("doc_id") % 17 != 0, F.col("text")))
    M.write_staged(rules.apply_policy(files, I.FILES_POLICY), folder)
    return spark.read.parquet(folder).select("root", "workspace", "path", "disposition", F.sha2("text", 256).alias("text_sha"),
                                             F.sha2("content", 256).alias("content_sha"))


def detector_json(docs: DataFrame) -> DataFrame:
    """Detector outputs of every kind: text, spans, nothing, broken, missing."""
    n, kind = F.col("n_chars").cast("int"), F.col("doc_id") % 5

    def span(start, end):
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

    spans = F.array(span(F.lit(0), F.lit(2)), span(F.lit(-1), F.lit(3)), span((n / 2), (n / 2) + 1),
                    span(n - 1, n + 5), span(F.lit(1), F.lit(1)))
    whole = F.to_json(F.struct(F.concat(F.lit("clean "), "lang").alias("redacted_text"),
                               F.concat(F.lit("found "), "source").alias("summary"), F.lit(1).alias("version")))
    spanned = F.to_json(F.struct(F.lit("careful").alias("warning"), spans.alias("detected_spans")))
    privacy = F.when(kind == 0, whole).when(kind == 1, spanned).when(kind == 2, F.lit("{oops")) \
        .when(kind == 3, F.lit("{}"))
    def secret(value):
        return F.struct(value.alias("Secret"), F.lit("rule").alias("RuleID"))

    leaks = F.to_json(F.array(secret(F.col("lang")), secret(F.lit("REDACTED")), secret(F.lit("  ")),
                              secret(F.col("source")), secret(F.lit(None).cast("string"))))
    return docs.withColumn("privacy_json", privacy).withColumn(
        "leaks_json", F.when(kind == 0, leaks).when(kind == 1, F.lit(" [] ")).when(kind == 2, F.lit("no json"))
        .when(kind == 3, leaks))


@query
def s6_read_detector_output(spark, sf_dir):
    docs = detector_json(I.documents(spark, sf_dir))
    out = D.read_detector_output(docs, "privacy_json", D.PRIVACY_FILTER).withColumnsRenamed(
        {"redacted_text": "p_text", "matched_values": "p_values", "summary": "p_summary",
         "detector_status": "p_status"})
    out = D.read_detector_output(out, "leaks_json", D.GITLEAKS)
    return out.select("doc_id", "p_text", F.array_join("p_values", "|").alias("p_values"), "p_summary", "p_status",
                      F.array_join("matched_values", "|").alias("l_values"), F.col("summary").alias("l_summary"),
                      F.col("detector_status").alias("l_status"))


# --- predicates ----------------------------------------------------------------------------------

GLOBS = {"any_keys": ["**/*.jks"], "top_only": ["*.txt"], "one_level": ["src/*/en/k?/*"],
         "group": ["**/{src1,src2}/**"], "range": ["src/src[3-5]/**"], "negated": ["src/src[!0-4]/**", "build/**"]}


@query
def p1_glob_match(spark, sf_dir):
    path = F.col("path")
    return I.files(spark, sf_dir).select("path", *(match.glob_match(path, g).alias(n) for n, g in GLOBS.items()))


@query
def p2_path_regex_match(spark, sf_dir):
    return I.files(spark, sf_dir).select("path", match.path_regex_match(
        F.col("path"), ["/src1[0-9]/", r"^build/.*\.kt"]).alias("matched"))


@query
def p3_content_regex_match(spark, sf_dir):
    text = F.col("text")
    return I.documents(spark, sf_dir).select(
        "doc_id", match.content_regex_match(text, [I.EMAIL, I.CARD]).alias("contact"),
        match.content_regex_match(text, [I.IPV4]).alias("address"),
        match.content_regex_match(text, [I.LICENSE]).alias("license"))


@query
def p4_rule_matches(spark, sf_dir):
    files = I.files(spark, sf_dir)
    by_id = {r.id: r.match for r in I.FILES_POLICY.rules}
    return files.select("path", *(match.rule_matches(by_id[i], F.col("path"), F.col("text")).alias(i.replace("-", "_"))
                                  for i in ("redact-card", "review-src7", "confirm-ip")))


@query
def p5_path_findings(spark, sf_dir):
    files = I.files(spark, sf_dir)
    return files.withColumn("findings", rules.path_findings(F.col("path"), "path", I.FILES_POLICY)).select(
        "path", I.finding_lines().alias("findings"))


@query
def p6_relative_path(spark, sf_dir):
    kind, page = F.col("page_id") % 5, F.col("page_id").cast("string")
    inner = F.substring("host", F.lit(2), F.length("host"))
    raw = (F.when(kind == 0, F.concat(F.lit("/w/./"), inner, F.lit("//x/../"), page))
           .when(kind == 1, F.concat(F.lit("/w/../ext/"), inner, F.lit("/"), page))
           .when(kind == 2, F.concat(inner, F.lit("/"), page)).when(kind == 3, F.concat(F.lit("/wide/"), page))
           .otherwise(F.concat(F.lit("../w/"), inner, F.lit("/../../w/"), page, F.lit("/"))))
    return I.page_paths(spark, sf_dir).select("page_id", P.relative_path(F.lit("/w"), raw).alias("rel_path"))


@query
def p7_decode_text(spark, sf_dir):
    raw = F.col("text").cast("binary")
    content = F.when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FF")), raw)) \
        .when(F.col("doc_id") % 3 == 2, F.concat(raw, F.unhex(F.lit("C3")))).otherwise(raw)
    return I.documents(spark, sf_dir).select("doc_id", F.sha2(T.decode_text(content), 256).alias("text_sha"))


@query
def p8_skip_dirs(spark, sf_dir):
    return I.files(spark, sf_dir).filter(~P.in_skipped_directory(F.col("path"))).select("path")


@query
def p9_is_sanitizable_line(spark, sf_dir):
    return I.turns(spark, sf_dir).select("conv_id", "turn", match.is_sanitizable_line(F.col("text")).alias("checked"))


@query
def p11_validate_policies(spark, sf_dir):
    size = F.col("p_size")
    rules_table = I.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("policy_id"), F.when(size == 50, 2).otherwise(1).alias("version"),
        F.when(size % 10 == 9, " ").otherwise(F.concat_ws(" ", "p_name", "p_type", "p_size")).alias("rule_id"),
        F.when(size % 7 != 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("paths"),
        F.lit(None).cast("array<string>").alias("path_regex"),
        F.when(size % 5 == 0, F.array("p_name")).alias("content_regex"),
        F.when(size % 11 == 0, F.struct(F.array("p_name").alias("classes"))).alias("kotlin"),
        F.when(F.col("p_type") == "SMALL", " redact").otherwise("Block").alias("action"),
        F.when(size % 6 == 0, " ").when(size % 4 == 0, "x").alias("replacement"),
        F.when(size % 8 == 1, "").otherwise("<redacted>").alias("default_replacement"))
    return audit.validate_policies(rules_table)


# --- text transformations ------------------------------------------------------------------------

@query
def t1_apply_policy(spark, sf_dir):
    return evaluated(spark, sf_dir).select("path", "disposition", F.sha2("sanitized_text", 256).alias("sanitized_sha"),
                                           F.length("sanitized_text").cast("long").alias("sanitized_chars"),
                                           I.finding_lines().alias("findings"))


@query
def t1_apply_policy_symbols(spark, sf_dir):
    return rules.apply_policy(I.sources(spark, sf_dir), I.SYMBOLS_POLICY).select(
        "path", "disposition", "sanitized_text", I.finding_lines().alias("findings"))


@query
def t1_apply_policy_detectors(spark, sf_dir):
    """Detector output of a run on the original text, behind a rule that changes it."""
    policy = I.DETECTORS_POLICY
    files = I.files(spark, sf_dir).join(detector_json(I.documents(spark, sf_dir)).select("doc_id", "privacy_json", "leaks_json"), "doc_id")
    readers = [D.privacy_filter_detector(policy, "privacy_json"), D.gitleaks_detector(policy, "leaks_json")]
    items = rules.apply_policy(files, policy, detectors=readers)
    return items.select("path", "disposition", F.sha2("sanitized_text", 256).alias("sanitized_sha"), I.finding_lines().alias("findings"),
                        F.col("detector_status")[D.GITLEAKS].alias("leaks_status"),
                        F.col("detector_status")[D.PRIVACY_FILTER].alias("privacy_status"))


@query
def t2_redact_content(spark, sf_dir):
    redacted = T.redact_content(F.col("text"), [I.PHONE, I.EMAIL, I.CARD], "[$0]")
    return I.documents(spark, sf_dir).select("doc_id", F.sha2(redacted, 256).alias("sha"))


@query
def t5_find_secrets(spark, sf_dir):
    return I.documents(spark, sf_dir).select("doc_id", F.posexplode(S.find_secrets(F.col("text")))) \
        .select("doc_id", F.col("pos").cast("long").alias("ord"), F.col("col").alias("secret"))


@query
def t5_secret_formats(spark, sf_dir):
    """One row per format: a value of it beside two words in every document's place, found and redacted as a whole."""
    digits = F.sha2(F.col("doc_id").cast("string"), 256)

    def cut(start: int, length: int) -> Column:
        return F.substring(digits, start, length)

    formats = {"assignment": F.concat(F.lit('token = "'), cut(1, 20), F.lit('"')), "access key": F.concat(F.lit("AKIA"), F.upper(cut(1, 16))),
               "repository token": F.concat(F.lit("ghp_"), cut(1, 36)), "private key": F.lit("-----BEGIN RSA PRIVATE KEY-----"),
               "web token": F.concat(F.lit("eyJ"), cut(1, 12), F.lit("."), cut(13, 12), F.lit("."), cut(25, 12)),
               "near miss": F.concat(F.lit("token: "), cut(1, 15), F.lit(" AKIA"), F.upper(cut(1, 15)), F.lit(" eyJabcdefgh.x"))}
    kind = F.col("doc_id") % len(formats)
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (own, text) in enumerate(formats.items()):
        name, value = F.when(kind == i, own).otherwise(name), F.when(kind == i, text).otherwise(value)
    texts = I.documents(spark, sf_dir).select(name.alias("format"), "lang", "source", F.concat_ws(" ", "lang", value, "source").alias("text"))
    counted = texts.withColumn("n", S.count_secrets(F.col("text")))
    whole = F.when(F.col("format") == "near miss", F.col("text")).otherwise(F.concat_ws(" ", "lang", F.lit("<redacted>"), "source"))
    right = S.redact_secrets(F.col("text"), F.col("n"), REDACT, "<redacted>") == whole
    return counted.groupBy("format").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("n").cast("long")).alias("found"), F.count_if(right).alias("as_expected"))


@query
def t6_redact_secrets(spark, sf_dir):
    counted = I.documents(spark, sf_dir).withColumn("found", S.count_secrets(F.col("text")))
    text, found = F.col("text"), F.col("found")
    return counted.select(
        "doc_id", found.cast("long").alias("found"),
        F.sha2(S.redact_secrets(text, found, "REDACT", "<$secret>"), 256).alias("redacted"),
        F.sha2(S.redact_secrets(text, found, "SUMMARIZE", ""), 256).alias("summarized"),
        F.sha2(S.redact_secrets(text, found, "BLOCK", ""), 256).alias("blocked"),
        F.when(found > 0, F.expr(S.secret_message("found", "CONFIRM"))).alias("message"))


@query
def t7_replace_ranges(spark, sf_dir):
    n = F.col("n_chars").cast("int")
    ranges = F.transform(F.filter(F.sequence(F.lit(0), n, F.lit(50)), lambda i: i < n), lambda i: F.struct(
        i.alias("start"), F.least(i + 5, n).alias("end"), F.concat(F.lit("#"), (i / 50).cast("int").cast("string"))
        .alias("replacement")))
    return I.documents(spark, sf_dir).select("doc_id", F.sha2(T.replace_ranges(F.col("text"), F.shuffle(
        ranges, seed=F.lit(7))), 256).alias("sha"))


@query
def t8_redact_values(spark, sf_dir):
    values = F.array(F.col("lang"), F.lit("the"), F.lit(" "), F.lit("then"), F.lit("the"),
                     F.concat("lang", F.lit("th")))
    return I.documents(spark, sf_dir).select("doc_id", F.sha2(T.redact_values(F.col("text"), values, "<x>"), 256)
                                             .alias("sha"))


@query
def t9_extract_spans(spark, sf_dir):
    n = F.col("n_chars").cast("int")
    half = (n / 2).cast("int")
    spans = F.array(*(F.struct(a.alias("start"), b.alias("end")) for a, b in (
        (F.lit(0), F.lit(3)), (F.lit(-1), F.lit(3)), (half, half + 4), (n - 1, n), (n - 1, n + 1), (n, n), (F.lit(3), F.lit(1)))))
    return I.documents(spark, sf_dir).select("doc_id", F.array_join(T.extract_spans(F.col("text"), spans), "|")
                                             .alias("values"))


def mail_leaks(docs: DataFrame) -> DataFrame:
    """A scanner's report that lists the mail addresses of each text."""
    found = F.regexp_extract_all("text", F.lit(I.EMAIL), F.lit(0))
    return docs.withColumn("json", F.to_json(F.transform(found, lambda v: F.struct(v.alias("Secret")))))


@query
def t10_apply_detector(spark, sf_dir):
    docs = mail_leaks(I.documents(spark, sf_dir))
    scanner = D.Detector(D.GITLEAKS, REDACT, lambda text: D.leaks_result(F.col("json"), text))
    return D.apply_detector(docs, scanner, "<mail>").select(
        "doc_id", F.sha2("sanitized_text", 256).alias("sha"), F.col("detector_finding.message").alias("message"),
        F.col("detector_finding.rule_id").alias("rule_id"), "detector_status")


@query
def t11_kotlin_symbols(spark, sf_dir):
    found = symbols.kotlin_symbols(I.sources(spark, sf_dir), I.SYMBOLS)
    return found.select("path", "kind", "name", *(F.col(c).cast("long").alias(c) for c in
                                                  ("start_line", "end_line", "start", "end")))


@query
def t12_redact_kotlin(spark, sf_dir):
    return symbols.redact_kotlin(I.sources(spark, sf_dir), I.SYMBOLS, "<hidden>").select("path", "redacted_text")


def conversation_request(spark, sf_dir):
    """A request per conversation: the opening turn is the prompt, the others are files."""
    turns = I.turns(spark, sf_dir)
    opening = F.col("turn") == 0
    prompts = turns.filter(opening).select(F.col("conv_id").alias("request_id"), F.col("role").alias("source_label"), "text")
    name = F.concat(F.lit("turns/"), F.col("request_id").cast("string"), F.lit("/"), F.col("turn").cast("string"),
                    F.when(F.col("role") == "system", ".jks").otherwise(".txt"))
    files = tables.files_from_table(turns.filter(~opening).withColumnRenamed("conv_id", "request_id"), name, "text",
                                    carry=("request_id", "turn"))
    return prompts, files


@query
def t13_assemble_context(spark, sf_dir):
    prompts, files = conversation_request(spark, sf_dir)
    return context.assemble_context(
        rules.evaluate_prompts(prompts, I.TURNS_POLICY), turn_files(files), position="turn", part_lines=4
    ).select("request_id", F.col("section").cast("long").alias("section"), "part", "text")


def turn_files(files: DataFrame) -> DataFrame:
    return rules.apply_policy(files, I.ATTACHMENTS_POLICY)


@query
def t13_context_lines(spark, sf_dir):
    prompts, files = conversation_request(spark, sf_dir)
    blocks = context.context_lines(rules.evaluate_prompts(prompts, I.TURNS_POLICY), turn_files(files), position="turn")
    return blocks.select("request_id", F.col("section").cast("long").alias("section"), "ord", "content")


@query
def t14_sanitize_turns(spark, sf_dir):
    return context.sanitize_turns(I.turns(spark, sf_dir), I.TURNS_POLICY).select(
        "conv_id", "turn", "sanitized_text", "was_redacted")


# --- joins ---------------------------------------------------------------------------------------

def stored_manifest(files: DataFrame) -> DataFrame:
    """An earlier manifest: some sizes have changed since, some paths are gone."""
    d = F.col("doc_id")
    path = F.when(d % 11 == 0, F.concat(F.lit("/w/gone/"), d.cast("string"))).otherwise(F.col("source_path"))
    return files.select(
        F.lit(1).alias("version"),
        F.when(d % 13 == 0, "other").otherwise(policy_fingerprint(I.FILES_POLICY)).alias("policy_fingerprint"),
        "root", path.alias("source_path"), F.when(d % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        "mtime_ms", F.when(d % 5 == 0, rules.WRITE_SANITIZED_TEXT).otherwise(rules.COPY_ORIGINAL).alias("disposition"),
        F.when(d % 5 == 0, F.concat(F.lit("stored "), d.cast("string"))).alias("sanitized_text"),
        F.array(F.expr(rules.finding("path", REDACT, rules.POLICY_RULE, "'stored'", "earlier"))).alias("findings"))


@query
def j1_reuse_decisions(spark, sf_dir):
    files = I.files(spark, sf_dir)
    return reuse.reuse_decisions(files, stored_manifest(files), I.FILES_POLICY).select(
        "source_path", "cache_hit", "disposition", F.sha2("sanitized_text", 256).alias("sanitized_sha"),
        I.finding_lines().alias("findings"))


@query
def j2_external_files(spark, sf_dir):
    pages = I.page_paths(spark, sf_dir)
    roots = pages.filter(F.col("host").startswith("/blog.")).select("session", F.col("host").alias("directory"))
    directories = pages.filter(F.col("section").endswith("/fr")).select("session", F.col("section").alias("directory"))
    return mapping.external_files(pages, roots, directories)


def staged_mapping(pages: DataFrame) -> DataFrame:
    """Project: the blogs; include directories: sections of www hosts; files: Spanish pages."""
    number = F.col("page_id")
    project = pages.filter(F.col("host").startswith("/blog.")).groupBy("session", F.col("host").alias("from_path")).agg(
        F.min(number).alias("ord")).select("session", F.lit("PROJECT").alias("kind"), "ord", "from_path", F.lit("/stage").alias("to_path"))
    sections = pages.filter(F.col("host").startswith("/www.")).groupBy("session", F.col("section").alias("from_path")).agg(F.min(number).alias("ord"))
    hosts = pages.filter(F.col("host").startswith("/www.")).groupBy("session", F.col("host").alias("from_path")).agg(F.max(number).alias("ord"))
    directories = sections.unionByName(hosts).select("session", F.lit("DIR").alias("kind"), "ord", "from_path", F.concat(
        F.lit("/stage/_external/"), F.col("ord").cast("string")).alias("to_path"))
    files = pages.filter(F.col("section").endswith("/es")).groupBy("session", F.col("path").alias("from_path")).agg(
        F.min(number).alias("ord")).select("session", F.lit("FILE").alias("kind"), "ord", "from_path", F.concat(
            F.lit("/stage/_external_files/"), F.col("ord").cast("string")).alias("to_path"))
    return project.unionByName(directories).unionByName(files)


@query
def j3_map_paths(spark, sf_dir):
    pages = I.page_paths(spark, sf_dir)
    return mapping.map_paths(pages, staged_mapping(pages), "/stage")


@query
def j3_map_includes(spark, sf_dir):
    pages = I.page_paths(spark, sf_dir)
    wanted = pages.select("session", F.explode(F.array("path", "section", "host", F.lit("/"))).alias("path"))
    return mapping.map_includes(wanted, staged_mapping(pages), "/stage")


@query
def j4_nearest_policy(spark, sf_dir):
    pages = I.page_paths(spark, sf_dir)
    no = F.lit(None).cast("string")
    directories = pages.select(
        F.col("path").alias("directory"), F.when(F.col("path").endswith("1"), "/explicit.yaml").alias("explicit"),
        F.when(F.col("path").endswith("2"), "/env.yaml").otherwise(no).alias("environment"))
    hosts = pages.filter(F.col("host").endswith(".com")).select(F.concat("host", F.lit("/llm-policy.yml")).alias("path"))
    sections = pages.filter(F.col("section").endswith("/en")).select(F.explode(F.array(
        F.concat("section", F.lit("/llm-policy.yml")), F.concat("section", F.lit("/llm-policy.yaml")),
        F.concat("section", F.lit("/other.yaml")))).alias("path"))
    return mapping.nearest_policy(directories, hosts.unionByName(sections))


@query
def j5_rule_hits(spark, sf_dir):
    return rules.rule_hits(I.files(spark, sf_dir), I.FILES_POLICY).select(
        "path", F.col("rule_ord").cast("long"), "rule_id", "action")


def phrase_rules(spark, sf_dir) -> DataFrame:
    """A rule per test item (its first words, in some folders only, or words further on) and per customer (the name)."""
    words = F.split("text", " ")
    item = F.col("item_id")

    def phrase(first: int) -> Column:
        return F.regexp_replace(F.array_join(F.slice(words, first, 4), " "), r"([^\p{L}\p{N}\s])", r"\\$1")

    nothing = F.array().cast("array<string>")
    items = I.table(spark, sf_dir, "benchmark").select(
        item.cast("int").alias("rule_ord"), F.concat(F.lit("item-"), item.cast("string")).alias("rule_id"), F.lit("BLOCK").alias("action"),
        F.when(item % 4 == 1, F.array(F.lit("src/**"))).otherwise(nothing).alias("paths"),
        F.when(item % 3 == 0, F.array(F.lit("/src[0-9]*[02468]/"))).otherwise(nothing).alias("path_regex"),
        F.when(item % 5 == 0, F.array(phrase(1), phrase(9))).otherwise(F.array(phrase(1))).alias("content_regex"))
    names = I.table(spark, sf_dir, "customer").select(
        (F.lit(1_000_000) + F.col("c_custkey")).cast("int").alias("rule_ord"), F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("rule_id"),
        F.lit("REDACT").alias("action"), nothing.alias("paths"), nothing.alias("path_regex"), F.array("c_name").alias("content_regex"))
    return items.unionByName(names).withColumn("kotlin", F.lit(None).cast("struct<packages:array<string>>"))


@query
def j5_rule_table(spark, sf_dir):
    """Thousands of rules from tables; none of them is in the plan."""
    return rule_index.indexed_rule_hits(I.files(spark, sf_dir), phrase_rules(spark, sf_dir)).select(
        "path", F.col("rule_ord").cast("long"), "rule_id", "action")


@query
def j5_symbol_rule_hits(spark, sf_dir):
    return rules.rule_hits(I.sources(spark, sf_dir), I.SYMBOLS_POLICY).select(
        "path", F.col("rule_ord").cast("long"), "rule_id", "action")


@query
def j6_block_end(spark, sf_dir):
    key = ["root", "path"]
    files = I.sources(spark, sf_dir).filter(F.col("path").endswith(".kt"))
    lined = symbols.line_kinds(symbols.brace_balance(symbols.line_offsets(
        symbols.source_lines(files, key), key), key))
    declared = lined.withColumn("is_target", F.col("kind").isin("class", "fun"))
    return symbols.block_end(declared, key).select(
        "path", F.col("line").cast("long"), "kind", "name", F.col("end_line").cast("long"))


@query
def j7_removed_paths(spark, sf_dir):
    files = I.files(spark, sf_dir)
    return reuse.removed_paths(stored_manifest(files), files).select("source_path")


@query
def j8_invalidate_prefix(spark, sf_dir):
    files = I.files(spark, sf_dir)
    removed = files.filter(F.col("path").rlike("/(fr|es)/")).select(
        "root", F.concat(F.lit("/w/"), F.regexp_extract("path", "^.*/(fr|es)", 0)).alias("source_path"))
    return reuse.invalidate_prefix(stored_manifest(files), removed).select("source_path", "size")


# --- aggregations --------------------------------------------------------------------------------

def workspace_items(spark, sf_dir) -> DataFrame:
    return rules.apply_policy(I.files(spark, sf_dir).filter(~P.in_skipped_directory(F.col("path"))), I.FILES_POLICY)


@query
def a1_request_decision(spark, sf_dir):
    return rollups.request_decision(rules.explode_findings(evaluated(spark, sf_dir), "request_id", "path"))


def request_prompts(spark, sf_dir) -> DataFrame:
    return I.turns(spark, sf_dir).select((F.col("conv_id") % 50).alias("request_id"), "conv_id", "turn",
                                         F.col("role").alias("source_label"), "text")


@query
def a2_gate(spark, sf_dir):
    prompts = rules.evaluate_prompts(request_prompts(spark, sf_dir), I.TURNS_POLICY)
    decisions = rollups.request_result(prompts, evaluated(spark, sf_dir))
    gated = decisions
    for name, mode, approve in (("request_gate", "request", False), ("approved_gate", "request", True),
                                ("workspace_gate", "workspace", False)):
        gated = rollups.gate(gated, mode=mode, approve=approve).withColumn(name, F.col("gate").cast("long")).drop("gate")
    return gated


@query
def a3_stage_stats(spark, sf_dir):
    files = I.files(spark, sf_dir)
    decisions = reuse.reuse_decisions(files, stored_manifest(files), I.FILES_POLICY)
    return rollups.stage_stats(decisions)


@query
def a4_directory_rollup(spark, sf_dir):
    return rollups.directory_rollup(workspace_items(spark, sf_dir))


@query
def a5_safe_subtrees(spark, sf_dir):
    return rollups.safe_subtrees(rollups.directory_rollup(workspace_items(spark, sf_dir))).select(
        "root", "directory", "mirrored")


@query
def a6_findings_summary(spark, sf_dir):
    return rollups.findings_summary(rules.explode_findings(evaluated(spark, sf_dir), "path"))


@query
def a8_disposition_counts(spark, sf_dir):
    return rollups.disposition_counts(evaluated(spark, sf_dir))


# --- windows, top-k, sets ------------------------------------------------------------------------

KEY = ["root", "path"]


@query
def w1_annotation_groups(spark, sf_dir):
    kinds = symbols.line_kinds(symbols.source_lines(I.sources(spark, sf_dir), KEY))
    return symbols.annotation_groups(kinds, KEY).select(
        "path", F.col("line").cast("long"), "kind", "island", F.col("group_start").cast("long"))


@query
def w2_line_offsets(spark, sf_dir):
    docs = I.documents(spark, sf_dir)
    return symbols.line_offsets(symbols.source_lines(docs, ["doc_id"]), ["doc_id"]).select(
        "doc_id", *(F.col(c).cast("long").alias(c) for c in ("line", "start", "end")))


@query
def w3_brace_balance(spark, sf_dir):
    pages = tables.spread(I.table(spark, sf_dir, "pages"), I.shuffle_partitions(spark), "page_id")
    return symbols.brace_balance(symbols.source_lines(pages, ["page_id"], "html"), ["page_id"]).select(
        "page_id", *(F.col(c).cast("long").alias(c) for c in ("line", "delta", "balance")))


@query
def w4_merge_ranges(spark, sf_dir):
    docs = I.documents(spark, sf_dir)
    lined = symbols.line_offsets(symbols.source_lines(docs, ["doc_id"]), ["doc_id"])
    length = F.length("line_text")
    ranges = lined.select(
        "doc_id", "line", "start", (F.col("start") + length + F.col("line") % 3).cast("int").alias("end"),
        F.concat(F.lit("l"), F.col("line").cast("string")).alias("description"))
    return symbols.merge_ranges(ranges, ["doc_id"]).select(
        "doc_id", F.col("start").cast("long"), F.col("end").cast("long"), F.md5("description").alias("description_md5"))


@query
def w5_number_externals(spark, sf_dir):
    pages = I.page_paths(spark, sf_dir)
    includes = pages.select(F.col("session").alias("root"), F.concat("host", F.lit("/a b")).alias("path"),
                            F.col("page_id").alias("position"))
    return mapping.number_externals(includes)


@query
def k1_top_findings(spark, sf_dir):
    items = evaluated(spark, sf_dir).withColumn("root", F.concat(F.lit("/w/"), F.regexp_extract("path", "^[^/]+/[^/]+", 0)))
    found = written(rules.explode_findings(items, "root", "path"), "findings")
    return rollups.top_findings(found, 10).withColumn("rank", F.col("rank").cast("long"))


@query
def x1_all_findings(spark, sf_dir):
    prompts = rules.evaluate_prompts(request_prompts(spark, sf_dir), I.TURNS_POLICY)
    return rules.all_findings(prompts, evaluated(spark, sf_dir)).select(
        "request_id", F.col("part_ord").cast("long"), F.col("finding_ord").cast("long"), "target", "action", "source",
        "message", "rule_id")


# --- streams and plugged detectors ---------------------------------------------------------------

def change_events(files: DataFrame) -> DataFrame:
    """Creation of every file; some are changed, deleted, or followed by an old event."""
    d, m = F.col("doc_id"), F.col("mtime_ms")
    big = 1_000_000_000_000

    def event(condition, number, op, text, at):
        return F.when(condition, F.struct((d + number * big).alias("event_id"), F.lit(op).alias("op"),
                                          text.alias("text"), at.alias("mtime_ms")))

    events = F.array_compact(F.array(
        event(F.lit(True), 0, "CREATE", F.col("text"), m),
        event(d % 4 == 1, 1, "MODIFY", F.concat(F.lit("new mail a.b@example.com "), "text"), m + 500),
        event(d % 9 == 2, 2, "DELETE", F.lit(None).cast("string"), m + 800),
        event(d % 5 == 0, 3, "MODIFY", F.lit("late"), m - 500)))
    outside = F.when(d % 10 == 7, F.concat(F.lit("/elsewhere/"), d.cast("string"))).otherwise(F.col("source_path"))
    return files.select("root", outside.alias("path"), F.explode(events).alias("e")).select(
        "e.event_id", "root", "path", "e.op", "e.text", F.length("e.text").cast("long").alias("size"), "e.mtime_ms")


@query
def r1_sync_stream(spark, sf_dir):
    folder = new_folder(spark, "sync")
    change_events(I.files(spark, sf_dir)).write.parquet(f"{folder}/changes")
    changes = spark.readStream.schema(sync.CHANGES_SCHEMA).parquet(f"{folder}/changes")
    sync.sync_stream(changes, I.FILES_POLICY, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return sync.current_state(sync.read_staged_log(spark, f"{folder}/log")).select(
        "path", "event_id", "status", F.sha2("sanitized_text", 256).alias("text_sha"))


@query
def r1_sync_manifest(spark, sf_dir):
    """A second stream over the same events finds every decision in the manifest of the first."""
    folder = new_folder(spark, "sync")
    change_events(I.files(spark, sf_dir)).write.parquet(f"{folder}/changes")
    for n in (1, 2):
        changes = spark.readStream.schema(sync.CHANGES_SCHEMA).parquet(f"{folder}/changes")
        sync.sync_stream(changes, I.FILES_POLICY, f"{folder}/log{n}", f"{folder}/checkpoint{n}",
                         manifest_folder=f"{folder}/manifest").awaitTermination()
    hits = sync.read_staged_log(spark, f"{folder}/log2").select(F.col("path").alias("source_path"), "cache_hit")
    return M.current_manifest(spark, f"{folder}/manifest", I.FILES_POLICY).join(hits, "source_path").select(
        F.col("source_path").alias("path"), "size", "disposition", F.sha2("sanitized_text", 256).alias("sanitized_sha"), "cache_hit")


@query
def r1_sync_state(spark, sf_dir):
    """The staged log of a stream that keeps what it knows of a path in its state store."""
    folder = new_folder(spark, "sync")
    change_events(I.files(spark, sf_dir)).write.parquet(f"{folder}/changes")
    changes = spark.readStream.schema(sync.CHANGES_SCHEMA).parquet(f"{folder}/changes")
    state.sync_state_stream(changes, I.FILES_POLICY, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return sync.read_staged_log(spark, f"{folder}/log").select(
        "path", "event_id", "op", "action", "status", "disposition", I.finding_lines().alias("findings"))


@query
def workspace_run(spark, sf_dir):
    """The staged copy of a second run, in which every seventh file has changed since the first."""
    folder = new_folder(spark, "workspace")
    files = I.files(spark, sf_dir)
    before = files.withColumn("size", F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    flows.run_workspace(before, I.FILES_POLICY, folder)
    run = flows.run_workspace(files, I.FILES_POLICY, folder)
    return M.read_staged(spark, f"{folder}/staged").join(run.decisions.select("root", "path", "cache_hit"), ["root", "path"]).select(
        "root", "path", "disposition", "cache_hit", F.sha2("text", 256).alias("text_sha"))


@query
def r1_sync_batch(spark, sf_dir):
    return sync.sync_batch(change_events(I.files(spark, sf_dir)), I.FILES_POLICY).select(
        "path", "event_id", "op", "action", "status", "disposition", I.finding_lines().alias("findings"))


@query
def r2_sanitize_stream(spark, sf_dir):
    folder = new_folder(spark, "lines")
    I.turns(spark, sf_dir).write.parquet(f"{folder}/typed")
    typed = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{folder}/typed")
    lines.run_lines(typed, I.TURNS_POLICY, f"{folder}/out", f"{folder}/checkpoint", approve=True).awaitTermination()
    return spark.read.schema("conv_id long, turn long, role string, text string, sanitized_text string, "
                             "was_redacted boolean").parquet(f"{folder}/out") \
        .select("conv_id", "turn", "sanitized_text", "was_redacted")


@query
def r3_collapse_changes(spark, sf_dir):
    events = I.table(spark, sf_dir, "events").withColumn("mtime_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return sync.collapse_changes(events, ("user_id",)).select("user_id", "event_id", "event_type", "value")


def address_detector():
    """A Python detector that reports network addresses."""
    address = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")

    def find(texts: pd.Series) -> pd.DataFrame:
        found = texts.map(address.findall)
        return pd.DataFrame({"redacted_text": None, "matched_values": found,
                             "summary": found.map(lambda v: f"{len(v)} address(es)" if v else None)})

    return D.register_detector("addresses", find)


@query
def u1_register_detector(spark, sf_dir):
    items = rules.apply_policy(I.files(spark, sf_dir), I.FILES_POLICY, detectors=[address_detector()])
    return items.select("path", "disposition", F.sha2("sanitized_text", 256).alias("sanitized_sha"),
                        I.finding_lines().alias("findings"))
