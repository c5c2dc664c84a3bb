"""One registered query per operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import new_folder
from . import conversation_repair, decontaminate, lattice_lm, merkle, mixing, quality_net, quality_rules, secret_scan, simhash, substrings, tool_calls, toxicity, warc
from .labels import held_out, labelled_sample
from .words import table

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_substrings(table(spark, sf_dir, "documents"), window=13, longest=True, every=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan_secrets(docs, into="secrets").drop("text")
    base = ["assign", "access", "hex"]

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    plain = F.filter("secrets", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in base), F.sha2(listed(plain), 256).alias("base_sha256"),
                        listed(F.col("secrets")).alias("spans"))


#: Rows that the network is fitted to at most.
QUALITY_SAMPLE = 3_000


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", learn=~held_out("doc_id", 4, 2), max_rows=QUALITY_SAMPLE)
    network = quality_net.learn_network(sample)
    return quality_net.score_quality(docs, network).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: Rows that rules are learned from at most.
RULES_SAMPLE = 20_000


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", learn=F.lit(True), max_rows=RULES_SAMPLE)
    verdict = quality_rules.learn_rules(quality_rules.text_statistics(sample)).expression()
    failed = quality_rules.base_failed()
    return quality_rules.text_statistics(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & verdict).alias("kept"))


#: Rows that the lexicon is learned from at most.
TOXIC_SAMPLE = 12_000


def toxicity_lexicon(docs: DataFrame, labels: DataFrame) -> toxicity.Lexicon:
    sample = labelled_sample(docs, labels, "toxic", learn=~held_out("doc_id", 5, 0), max_rows=TOXIC_SAMPLE)
    return toxicity.learn_lexicon(sample)


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity_lexicon(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, lexicon).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Tools that conversations call, with their parameters.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "lookup": {"query": ("string", True), "limit": ("integer", False)},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assistant turns as calls, each after the assistant turn two before; user turns as results of the turn before.

    Some calls name an unknown tool, leave a parameter out or give it as text, or need nothing.
    """
    def call_id(turn):
        return F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))

    turn, n = F.col("turn"), F.length("text")
    query, limit = F.col("text").alias("query"), F.col("turn").alias("limit")
    arguments = (F.when(n % 7 == 0, F.to_json(F.struct(query, limit.cast("string").alias("limit"))))
                 .when(n % 5 == 0, F.to_json(F.struct(query))).when(n % 17 == 0, F.lit("{query"))
                 .otherwise(F.to_json(F.struct(query, limit))))
    name = F.when(n % 11 == 0, "missing").when(turn % 3 == 0, "search").otherwise("lookup")
    calls = turns.where("role = 'assistant'").select(
        "conv_id", call_id(turn).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"),
        F.when(turn % 9 != 5, call_id(turn - 2)).alias("after"))
    results = turns.where("role = 'user'").select("conv_id", call_id(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


@query
def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = tool_calls.link_calls(*conversation_calls(table(spark, sf_dir, "conversations")), TOOLS)
    return linked.select("conv_id", "call_id", "turn", "depth", "copies", F.array_join("problems", ",").alias("problems"),
                         F.sha2("json", 256).alias("json_sha256"))


@query
def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    rows = warc.read_records(warc.reconstruct(spark, folder))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, max_bits=2)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The vocabulary of the language model; one of the box's public tokenizers.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_texts(table(spark, sf_dir, "documents"), lattice_lm.vocabulary(PIECES), held_out=held_out("doc_id", 7, 2))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    changed = merkle.digest_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields])
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", merkle.digest_of([F.col(c) for c in fields]).alias("leaf"), F.when(tampered, changed).alias("changed"))
    proved = merkle.prove_rows(rows, F.col("leaf"))
    out = proved.select("row.doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")).alias("proof_sha256"),
                        merkle.fold_path(F.coalesce("row.changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    repaired = conversation_repair.repair_conversations(conversation_repair.damaged(turns)).withColumnRenamed("conv_id", "id")
    ids = turns.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(repaired, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: CRC-32 of a text in SQL, byte by byte and bit by bit.
CRC32_SQL = """xor(list_reduce(list_transform(range(1, 1 + length(TEXT)), lambda i: CAST(ascii(substr(TEXT, CAST(i AS INT), 1)) AS BIGINT)),
    lambda c, b: list_reduce(range(0, 8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)),
    4294967295), 4294967295)"""

ORACLES = {
    "op7_tool_calls": """
        WITH RECURSIVE calls AS (
            SELECT conv_id, 'c' || conv_id || '-' || turn AS call_id, turn, length(text) AS n, text,
                   CASE WHEN length(text) % 11 = 0 THEN 'missing' WHEN turn % 3 = 0 THEN 'search' ELSE 'lookup' END AS name,
                   CASE WHEN turn % 9 <> 5 THEN 'c' || conv_id || '-' || (turn - 2) END AS after
            FROM conversations WHERE role = 'assistant'),
        results AS (SELECT conv_id, 'c' || conv_id || '-' || (turn - 1) AS call_id, turn AS rturn, text AS content
                    FROM conversations WHERE role = 'user'),
        parents AS (SELECT c.conv_id, c.call_id, p.call_id AS up FROM calls c LEFT JOIN calls p
                    ON p.conv_id = c.conv_id AND p.call_id = c.after),
        depths(conv_id, call_id, depth) AS (
            SELECT conv_id, call_id, 0 FROM parents WHERE up IS NULL
            UNION ALL
            SELECT p.conv_id, p.call_id, d.depth + 1 FROM depths d JOIN parents p ON p.conv_id = d.conv_id AND p.up = d.call_id),
        linked AS (
            SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, c.n, c.text, c.name,
                   c.after, d.depth, p.up, r.rturn, r.content, c.call_id IS NOT NULL AS is_call,
                   c.n % 7 <> 0 AND c.n % 5 <> 0 AND c.n % 17 = 0 AS broken
            FROM calls c JOIN depths d ON d.conv_id = c.conv_id AND d.call_id = c.call_id
            JOIN parents p ON p.conv_id = c.conv_id AND p.call_id = c.call_id
            FULL JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id),
        args AS (
            SELECT *, CASE WHEN broken THEN '"{query"'
                WHEN n % 7 = 0 THEN '{"limit":"' || turn || '","query":' || to_json(text) || '}'
                WHEN n % 5 = 0 THEN '{"query":' || to_json(text) || '}'
                ELSE '{"limit":' || turn || ',"query":' || to_json(text) || '}' END AS arguments FROM linked)
        SELECT conv_id, call_id, coalesce(turn, rturn) AS turn, CAST(depth AS BIGINT) AS depth,
               CASE WHEN is_call THEN 1 ELSE 0 END :: BIGINT AS copies,
               CASE WHEN NOT is_call THEN 'no call' ELSE concat_ws(',',
                   CASE WHEN broken THEN 'bad json' WHEN name = 'missing' THEN 'unknown tool'
                        WHEN n % 7 = 0 THEN 'type of limit' WHEN n % 5 = 0 AND name = 'search' THEN 'missing limit' END,
                   CASE WHEN content IS NULL THEN 'no result' END,
                   CASE WHEN after IS NOT NULL AND up IS NULL THEN 'dangling' END) END AS problems,
               sha256('{' || CASE WHEN is_call THEN '"arguments":' || arguments || ',' ELSE '' END || '"id":' || to_json(call_id)
                      || CASE WHEN is_call THEN ',"name":' || to_json(name) ELSE '' END
                      || CASE WHEN content IS NOT NULL THEN ',"result":' || to_json(content) ELSE '' END || '}') AS json_sha256
        FROM args""",

    "op8_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        q AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS h,
                     max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST((CAST(('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INT), 5)) AS BIGINT)
                             >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
               CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
        FROM q""",

    "op12_merkle_manifest": f"""
        WITH RECURSIVE parts AS (
            SELECT doc_id, lang, n_chars, row_number() OVER () AS rn, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
                   || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
                   coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail, CAST(doc_id AS VARCHAR) AS id FROM documents),
        hashed AS (
            SELECT *, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
                   CASE WHEN {CRC32_SQL.replace("TEXT", "id")} % 7 = 0 THEN
                   sha256(head || coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS changed FROM parts),
        leaves AS (SELECT rn, doc_id, lang, leaf, coalesce(changed, leaf) AS shown,
                          row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM hashed),
        levels(lang, level, nodes) AS (
            SELECT lang, 0, list(leaf ORDER BY rank) FROM leaves GROUP BY lang
            UNION ALL
            SELECT lang, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(array_to_string(nodes[2 * i + 1:2 * i + 2], '')))
            FROM levels WHERE len(nodes) > 1),
        subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank FROM levels WHERE len(nodes) = 1),
        tops(level, nodes) AS (
            SELECT 0, list(subroot ORDER BY rank) FROM subroots
            UNION ALL
            SELECT level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(array_to_string(nodes[2 * i + 1:2 * i + 2], '')))
            FROM tops WHERE len(nodes) > 1),
        steps AS (
            SELECT rn, 0 AS part, level, rank >> level AS place, nodes FROM leaves x JOIN levels v ON v.lang IS NOT DISTINCT FROM x.lang AND len(nodes) > 1
            UNION ALL SELECT rn, 1, level, s.rank >> level, nodes FROM leaves x JOIN subroots s ON s.lang IS NOT DISTINCT FROM x.lang
            JOIN tops ON len(nodes) > 1),
        siblings AS (SELECT rn, row_number() OVER (PARTITION BY rn ORDER BY part, level) AS step, place & 1 AS on_right,
                            coalesce(nodes[CAST(xor(place, 1) AS BIGINT) + 1], '') AS other FROM steps),
        fold(rn, step, node) AS (
            SELECT rn, CAST(0 AS BIGINT), shown FROM leaves
            UNION ALL
            SELECT f.rn, s.step, sha256(CASE WHEN on_right = 1 THEN other || node ELSE node || other END) FROM fold f JOIN siblings s ON s.rn = f.rn AND s.step = f.step + 1),
        proofs AS (SELECT x.rn, sha256(coalesce(string_agg(other, '' ORDER BY step), '')) AS proof_sha256 FROM leaves x LEFT JOIN siblings s ON s.rn = x.rn GROUP BY x.rn)
        SELECT x.doc_id, x.leaf, s.subroot, t.nodes[1] AS root, p.proof_sha256, f.node AS folded_root, f.node = t.nodes[1] AS verified
        FROM leaves x JOIN subroots s ON s.lang IS NOT DISTINCT FROM x.lang JOIN (SELECT nodes FROM tops WHERE len(nodes) = 1) t ON true
        JOIN proofs p ON p.rn = x.rn JOIN (SELECT rn, arg_max(node, step) AS node FROM fold GROUP BY rn) f ON f.rn = x.rn""",

    "op13_conversation_repair": f"""
        WITH RECURSIVE shown AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
        dealt AS (SELECT *, {CRC32_SQL.replace("TEXT", "id")} % 20 AS k FROM shown),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                   CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM dealt, unnest(range(0, CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy(i)),
        placed AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
        turns AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                           WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                           WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
                   lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
        wanted(p, q, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
        keep(p, initial, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
        added AS (
            SELECT p, p AS q, 0 AS cost, '' AS letters, CAST([] AS VARCHAR[]) AS lines FROM wanted
            UNION ALL SELECT p, q, 3, 'I', [role || ':'] FROM wanted
            UNION ALL SELECT x.p, y.q, 6, 'II', [x.role || ':', y.role || ':'] FROM wanted x JOIN wanted y ON y.p = x.q),
        ways AS (
            SELECT p, q, cost + 4 AS cost, letters || 'D' AS letters, lines, CAST(NULL AS VARCHAR) AS initial, CAST(NULL AS VARCHAR) AS role, false AS stays FROM added
            UNION ALL SELECT a.p, w.q, cost + 3, letters || 'R', lines, NULL, w.role, true FROM added a JOIN wanted w ON w.p = a.q
            UNION ALL SELECT a.p, k.q, cost, letters || 'K', lines, k.initial, NULL, true FROM added a JOIN keep k ON k.p = a.q),
        best(conv_id, i, q, way) AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}} FROM turns
            UNION ALL
            SELECT t.conv_id, t.i, w.q, min({{'c': b.way.c + w.cost + CASE WHEN w.stays AND t.fault = 'truncated' THEN 3 ELSE 0 END, 'a': b.way.a || w.letters,
                                             't': b.way.t || w.lines || CASE WHEN w.stays THEN [coalesce(w.role, t.role) || ':' || t.text] ELSE [] END}})
            FROM best b JOIN turns t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i + 1
            JOIN ways w ON w.p = b.q AND (NOT w.stays OR t.fault NOT IN ('blank', 'duplicate')) AND (w.initial IS NULL OR w.initial = t.initial)
            GROUP BY t.conv_id, t.i, w.q),
        counts AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
        ended AS (
            SELECT b.conv_id, min({{'c': b.way.c + a.cost, 'a': b.way.a || a.letters, 't': b.way.t || a.lines}}) AS way
            FROM best b JOIN counts n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.n = b.i JOIN added a ON a.p = b.q AND a.q IN (0, 3) GROUP BY b.conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, CAST(coalesce(e.way.c, 0) AS BIGINT) AS cost, coalesce(e.way.a, '') AS audit,
               sha256(coalesce(array_to_string(e.way.t, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
