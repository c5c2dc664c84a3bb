"""Inputs of the registered queries, derived by Spark from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.policy import SymbolCriteria, load_policy
from veilframe.sources.tables import files_from_table, spread

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# The second form is the same condition for engines without lookaround.
IPV4 = r"(?<![0-9.])[0-9]{1,3}(\.[0-9]{1,3}){3}(?![0-9])"
IPV4_PLAIN = r"(^|[^0-9.])[0-9]{1,3}(\.[0-9]{1,3}){3}([^0-9]|$)"
CARD = "[0-9]{16}"
PHONE = r"(\+1 )\(([0-9]{3})\) [0-9]{3}-[0-9]{4}"
LICENSE = "Licensed under|Released under"

#: Shares files: every kind of path and content rule, in an order that matters.
FILES_POLICY = load_policy({
    "version": 1,
    "detectors": {"secrets": {"enabled": True, "action": "redact"}},
    "rules": [
        {"id": "allow-text", "match": {"path_regex": [r"\.txt$"]}, "action": {"type": "allow"}},
        {"id": "block-keys", "match": {"paths": ["**/*.jks", "**/*.keystore"]}, "action": {"type": "block"}},
        {"id": "review-src7", "match": {"paths": ["**/src7/**"]}, "action": {"type": "confirm"}},
        {"id": "confirm-ip", "match": {"content_regex": [IPV4]}, "action": {"type": "confirm"}},
        {"id": "mask-phone", "match": {"content_regex": [PHONE]},
         "action": {"type": "redact", "replacement": "$1($2) <phone>"}},
        {"id": "redact-email", "match": {"content_regex": [EMAIL]},
         "action": {"type": "redact", "replacement": "<redacted:email>"}},
        {"id": "redact-card", "match": {"path_regex": ["/src[0-9]*[02468]/"], "content_regex": [CARD]},
         "action": {"type": "redact", "replacement": "<redacted:card>"}},
        {"id": "summarize-license", "match": {"content_regex": [LICENSE]}, "action": {"type": "summarize"}},
        {"id": "confirm-summary", "match": {"content_regex": ["summarized by summarize-license"]},
         "action": {"type": "confirm"}},
        {"id": "hide-built", "match": {"paths": ["build/**/es/**"]}, "action": {"type": "redact"}},
    ]})

BLOCK_WORD = "(^|[^a-z])heti([^a-z]|$)"
CONFIRM_WORD = "(^|[^a-z])qui([^a-z]|$)"
REDACT_WORD = "(rent|rest)"

WORD_RULES = [
    {"id": "block-word", "match": {"content_regex": [BLOCK_WORD]}, "action": {"type": "block"}},
    {"id": "confirm-word", "match": {"content_regex": [CONFIRM_WORD]}, "action": {"type": "confirm"}},
    {"id": "redact-word", "match": {"content_regex": [REDACT_WORD]}, "action": {"type": "redact", "replacement": "<$1>"}},
]

#: Forwards conversation lines; its first rule looks at files and never holds for lines.
TURNS_POLICY = load_policy({"version": 1, "rules": [
    {"id": "files-only", "match": {"paths": ["**"], "content_regex": ["a"]}, "action": {"type": "block"}}, *WORD_RULES]})

#: Shares attachments of conversations.
ATTACHMENTS_POLICY = load_policy({"version": 1, "rules": WORD_RULES})

#: A redacting rule before both outside detectors.
DETECTORS_POLICY = load_policy({
    "version": 1,
    "detectors": {"secrets": {"enabled": False}, "gitleaks": {"enabled": True, "action": "redact"},
                  "privacy_filter": {"enabled": True, "action": "redact"}},
    "rules": [{"id": "redact-email", "match": {"content_regex": [EMAIL]},
               "action": {"type": "redact", "replacement": "<redacted:email>"}}]})

#: Kotlin declarations to hide.
SYMBOLS = SymbolCriteria(packages=("com.acme.pay",), classes=("Ledger",), functions=("charge",),
                         annotations=("com.acme.Hidden",))

SYMBOLS_POLICY = load_policy({
    "version": 1,
    "rules": [
        {"id": "hide-symbols", "match": {"kotlin": {
            "packages": list(SYMBOLS.packages), "classes": list(SYMBOLS.classes),
            "functions": list(SYMBOLS.functions), "annotations": list(SYMBOLS.annotations)}},
         "action": {"type": "redact", "replacement": "<hidden>"}},
        {"id": "confirm-hidden", "match": {"content_regex": ["<hidden> // class"]}, "action": {"type": "confirm"}},
    ]})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The test tables are one file each; the session says over how many tasks to share them out."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), shuffle_partitions(spark), "doc_id")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of the workspace /w: directories by source, language and size."""
    d = F.col("doc_id")
    top = F.when(d % 25 == 3, "build").otherwise("src")
    ext = F.when(d % 20 == 0, ".jks").when(d % 10 == 0, ".kt").otherwise(".txt")
    folder = F.concat(F.lit("k"), F.floor(F.col("n_chars") / 1000).cast("string"))
    path = F.concat(F.concat_ws("/", top, "source", "lang", folder, d.cast("string")), ext)
    docs = documents(spark, sf_dir).withColumn("request_id", d % 50)
    return files_from_table(docs, path, "text", size=F.col("n_chars"), mtime_ms=d * 1000,
                            carry=("doc_id", "request_id"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns; some are commands or blank, as typed lines are."""
    typed = (F.when(F.col("turn") % 5 == 4, F.concat(F.lit("  /run "), "text"))
             .when(F.col("turn") == 6, F.lit(" \t ")).otherwise(F.col("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", typed.alias("text"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kotlin sources written from the parts, one of six shapes each."""
    k, size, name = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_name")

    def source(*lines) -> "F.Column":
        return F.concat_ws("\n", *(line if not isinstance(line, str) else F.lit(line) for line in lines))

    def c(*parts):
        return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))

    shapes = [
        # a named class below the package, closed by its brace
        source(c("package com.acme.pay.p", k), "", "data class Ledger(val id: Int) {", "    fun total(): Int {",
               c("        return ", size), "    }", "}", "", c('val tail = "', name, '"')),
        # an annotated function without braces
        source("package com.acme.pay", "", '@Deprecated("x")', "@Hidden", c("fun price() = ", size),
               "fun other() = 1", c("// ", name), ""),
        # two adjacent matches inside a class that is not matched
        source("package com.acme.pay", "class Outer {", "    fun charge() {", c("        use(", size, ")"), "    }",
               "    private class Ledger {", "    }", c('    val n = "', name, '"'), "}"),
        # a function over indented lines, with a blank one between
        source("package com.acme.pay", "fun charge(", "    amount: Int,", "", c("    rate: Int // ", name),
               c(") = amount * ", size), "val x = 1"),
        # a package that only starts alike
        source("package com.acme.payroll", "class Ledger {", c("    val a = ", size), "}"),
        # nothing to hide
        source("package com.acme.pay", "@Visible", c("fun shown() = ", size), c("// ", name)),
    ]
    shape = F.col("p_partkey") % 6
    text = F.when(shape == 0, shapes[0])
    for i, s in enumerate(shapes[1:], 1):
        text = text.when(shape == i, s)
    path = F.concat(F.lit("app/"), F.regexp_replace("p_brand", "#", ""), F.lit("/P"), k,
                    F.when(F.col("p_partkey") % 7 == 6, ".kts").otherwise(".kt"))
    parts = spread(table(spark, sf_dir, "part"), shuffle_partitions(spark), "p_partkey")
    return files_from_table(parts, path, text, carry=("p_partkey",))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as absolute paths /host/language/name, in four sessions."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?:/|[?#].*", ""), "/+$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("s"), (F.col("page_id") % 4).cast("string")).alias("session"),
        path.alias("path"), F.regexp_extract(path, "^/[^/]+", 0).alias("host"),
        F.regexp_extract(path, "^/[^/]+/[^/]+", 0).alias("section"))


def finding_lines(findings: str = "findings") -> "F.Column":
    """The findings of an item as one text, for comparison."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(
        "|", f["action"], f["source"], f["message"], F.coalesce(f["rule_id"], F.lit("")))), "\n")
