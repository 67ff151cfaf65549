"""The registered queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.llm import ann, bpe, conversations, extract, line_dedup, mixing, ngram_join, packing, quality, secret_scan, spelling, token_files, toxicity
from cleanloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: SQL macros in place: crc32 of a text, whose table and bytes are lists.
CRC_TABLE = """
    bits AS (
        SELECT i, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
        UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
    ), crc_table AS (SELECT list(c ORDER BY i) AS crc_list FROM bits WHERE k = 8)"""


def crc_sql(text: str, table: str = "crc_list") -> str:
    """crc32 of the UTF-8 bytes of the SQL expression ``text``."""
    byte = f"list_transform(range(length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::UBIGINT)"
    return f"xor(list_reduce({byte}, lambda c, b: xor(c // 256, {table}[(xor(c, b) & 255)::INT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)"


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_token_files")
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    files, manifest = token_files.write_tokens(docs, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.read_tokens(spark, files, manifest, with_ids=False)


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    judged = quality.judge(docs, quality.learn(docs, table(spark, folder, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, folder, "labels")))


@query("op9_main_text")
def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(table(spark, folder, "pages"))


@query("op10_bpe")
def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


@query(
    "op2_line_dedup",
    r"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (
        SELECT doc_id, generate_subscripts(lines, 1) AS n, unnest(lines) AS line FROM d
    ), k AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM l
    ), shared AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE s.key IS NOT NULL) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN shared s ON k.key = s.key GROUP BY doc_id
    """,
)
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op5_mixing",
    r"""
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
    f AS (
        SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
        FROM s WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), t AS (
        SELECT source, source_size, weight,
            least((3 * source_size)::DOUBLE, (SELECT arg_min(level, source_size / weight) FROM f WHERE level * weight <= 3 * source_size) * weight) AS target
        FROM f
    ), c AS (
        SELECT d.*, t.source_size, t.target, t.weight, size / 2 +
            coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS demand
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    ), x AS (
        SELECT *, target > 0 AND demand <= target AS first, target > 0 AND source_size + demand <= target AS second, target > 0 AND 2 * source_size + demand <= target AS third,
            CASE WHEN target > 0 THEN demand / target END AS share
        FROM c
    )
    SELECT doc_id, size, source_size, target, size * (first::BIGINT + second::BIGINT + third::BIGINT) AS taken,
        CASE WHEN first THEN round(CASE
            WHEN weight = 1 THEN 2 * share / (1.5 + sqrt(greatest(0, 2.25 - 2 * share)))
            WHEN weight = 2 THEN share
            WHEN 0.9375 * share <= 0.3125 THEN 2 * (0.9375 * share) / (0.5 + sqrt(0.25 + 0.9375 * share))
            ELSE 0.5 + 2 * (0.9375 * share - 0.3125) / (0.75 + sqrt(0.5625 + 4 * (0.9375 * share - 0.3125))) END, 9) END AS first_position
    FROM x
    """,
)
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    planned = mixing.placed(mixing.plan(table(spark, folder, "documents")))
    out = ["doc_id", "size", "source_size", "target", "taken", F.round("first_position", 9).alias("first_position")]
    rows = planned.select(*out, F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    return rows.drop("col")


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("found")).alias("spans")
    )


@query("op1_nearest")
def op1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op3_ngram_join")
def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_documents(table(spark, folder, "documents"))


@query(
    "op13_spelling",
    rf"""
    WITH RECURSIVE {CRC_TABLE},
    runs AS (
        SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run
        FROM documents
    ), counted AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL
    ), hashed AS (SELECT run, n, length(run) AS size, {crc_sql("doc || ':' || run")} AS h FROM counted, crc_table
    ), damaged AS (
        SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % size)::BIGINT) || substr(run, (h % size)::BIGINT + 2) ELSE run END AS word, n FROM hashed
    ), words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
    ), holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS hole FROM words, range(1, length(word) + 1) t(i)
    ), pairs AS (
        SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.i = b.i AND a.hole = b.hole AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.hole = b.word
        UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.hole = b.word
    ), best AS (
        SELECT word, count(*) AS n_near, max(other_n) AS top FROM pairs GROUP BY word
    ), forms AS (
        SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.top >= 5 * w.n THEN b.top END AS form_n,
            CASE WHEN b.top >= 5 * w.n THEN (SELECT min(p.other) FROM pairs p WHERE p.word = w.word AND p.other_n = b.top) END AS form
        FROM words w LEFT JOIN best b ON w.word = b.word
    ), chain AS (
        SELECT word, word AS root, form AS further FROM forms
        UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.further = f.word
    )
    SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM forms f JOIN chain c ON f.word = c.word AND c.further IS NULL
    """,
)
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Spelling variants over whole ``documents``; nulls, empty tables and ties as :func:`spelling.variants` says."""
    return spelling.variants(table(spark, folder, "documents"))


def edited(row: str, state: int) -> str:
    """SQL: the cheapest way on from ``state`` that does something with the row (a struct of cost, letters, text)."""
    line = lambda role, rest: f"{role} || ':' || text || CASE WHEN {rest}.r = '' THEN '' ELSE chr(10) || {rest}.r END"
    on = {0: 2, 1: 2, 2: 3, 3: 2}[state]
    name = {2: "'user'", 3: "'assistant'"}[on]
    keep = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[state]
    more = "CASE fault WHEN 't' THEN 5 ELSE 0 END"
    ways = [f"{{c: 2 + v{state}.c, s: 'D' || v{state}.s, r: v{state}.r}}"]
    ways += [f"CASE WHEN fault IN ('t', 'o') AND left(role, 1) = '{x}' THEN {{c: {more} + v{q}.c, s: 'K' || v{q}.s, r: {line('role', f'v{q}')}}} END" for x, q in keep]
    ways += [f"CASE WHEN fault IN ('t', 'o') THEN {{c: 1 + {more} + v{on}.c, s: 'R' || v{on}.s, r: {line(name, f'v{on}')}}} END"]
    return f"list_min([{', '.join(ways)}])"


def with_inserts(state: int) -> str:
    """SQL: the cheapest way on from ``state`` with up to two rows inserted first."""
    new = lambda role, rest: f"'{role}:' || CASE WHEN {rest} = '' THEN '' ELSE chr(10) || {rest} END"
    user, answer = new("user", "b2.r"), new("assistant", "b3.r")
    one = {2: f"{{c: 5 + b3.c, s: 'I' || b3.s, r: {answer}}}"}.get(state, f"{{c: 5 + b2.c, s: 'I' || b2.s, r: {user}}}")
    two = [f"{{c: 10 + b3.c, s: 'II' || b3.s, r: 'user:' || chr(10) || {answer}}}"] if state < 2 else []
    return f"list_min([{', '.join([f'b{state}', one, *two])}])"


@query(
    "op11_conversation_repair",
    rf"""
    WITH RECURSIVE {CRC_TABLE},
    hashed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h
        FROM conversations, crc_table
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
        FROM hashed WHERE h <> 0
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
            rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
        FROM damaged
    ), rows AS (
        SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS fault,
            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
        FROM placed
    ), steps AS (
        SELECT DISTINCT conv_id, n + 1 AS i, {{c: 0::BIGINT, s: '', r: ''}} AS v0, {{c: 10::BIGINT, s: 'II', r: 'user:' || chr(10) || 'assistant:'}} AS v1,
            {{c: 5::BIGINT, s: 'I', r: 'assistant:'}} AS v2, {{c: 0::BIGINT, s: '', r: ''}} AS v3
        FROM rows
        UNION ALL
        SELECT conv_id, i, {with_inserts(0)}, {with_inserts(1)}, {with_inserts(2)}, {with_inserts(3)}
        FROM (
            SELECT rows.conv_id, rows.i, {edited("rows", 0)} AS b0, {edited("rows", 1)} AS b1, {edited("rows", 2)} AS b2, {edited("rows", 3)} AS b3
            FROM steps JOIN rows ON steps.conv_id IS NOT DISTINCT FROM rows.conv_id AND rows.i = steps.i - 1
        )
    ), facts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
            count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
            count(*) FILTER (WHERE i > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
        FROM rows GROUP BY conv_id
    )
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
        coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0.c, 0)::BIGINT AS cost,
        coalesce(v0.s, '') AS audit, sha256(coalesce(v0.r, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
        LEFT JOIN steps s ON o.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = 1
    """,
)
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repairs of all ``conversations`` after damage; nulls, ties and empty tables as :mod:`conversations` says."""
    rows = table(spark, folder, "conversations")
    return conversations.report(rows, conversations.damage(rows))


@query("op12_packing")
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All ``documents`` packed into sequences of 1024 ids; nulls, repeats and empty tables as :func:`packing.pack` says."""
    return packing.pack(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))
