"""The registered queries of the operators, and the SQL that must give the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consentry.llm import (
    chat, decontam, jaccard, langid, lexical, linededup, packing, pii, repair, tokencounts, tokenfiles, topk, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(function):
        QUERIES[name] = function
        if check:
            ORACLES[name] = check.strip()
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Words in SQL: A-Z lower-cased, then the runs of word characters.
SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

PROBE = "\\### Assistant: </turn> ok"


@query(
    "op1_ngram_jaccard_join",
    rf"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_WORDS} AS ws FROM documents),
    s AS (
      SELECT DISTINCT rid, array_to_string(ws[i + 1 : i + 5], ' ') AS sh
      FROM (SELECT rid, ws, unnest(range(0, greatest(len(ws) - 5, 0) + 1)) AS i FROM d WHERE len(ws) > 0)),
    n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
    common AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rid <> b.rid GROUP BY 1, 2),
    links AS (
      SELECT x, y, a.n = c AND b.n = c AS same FROM common JOIN n a ON a.rid = x JOIN n b ON b.rid = y
      WHERE c >= 0.8 * (a.n + b.n - c)
      UNION ALL
      SELECT a.rid, b.rid, true FROM d a JOIN d b ON len(a.ws) = 0 AND len(b.ws) = 0 AND a.rid <> b.rid),
    reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x),
    classes AS (SELECT a, min(doc_id) AS class_id FROM reach JOIN d ON d.rid = b GROUP BY 1),
    counts AS (SELECT x, count(*) AS n, min(CASE WHEN same THEN doc_id END) AS copy FROM links JOIN d ON d.rid = y GROUP BY 1)
    SELECT doc_id, class_id, least(doc_id, coalesce(copy, doc_id)) AS copy_id, coalesce(n, 0) AS n_links
    FROM d JOIN classes ON a = rid LEFT JOIN counts ON x = rid""",
)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


@query(
    "op2_chat_format",
    r"""
    WITH turns AS (
      SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
      UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
           CAST(sum(4 + length(role) + 2 + length(regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g')) + 8) AS BIGINT)
             AS formatted_chars
    FROM turns GROUP BY conv_id""",
)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, streamed as deltas, folded, rendered to files, and read back from them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    return chat.read_back(chat.durable_pieces(chat.turns_as_events(turns.unionByName(probe))))


@query("op3_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query("op4_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text, and the ranges of code points that went: start:stop, joined with commas."""
    cut = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("deleted"), F.lit(2)),
        lambda i: F.concat_ws(":", F.element_at("deleted", i), F.element_at("deleted", i + 1)),
    )
    spans = F.when(F.size("deleted") > 0, F.array_join(pairs, ",")).otherwise(F.lit(""))
    return cut.select(F.col("row.doc_id").alias("doc_id"), "text", spans.alias("deleted"), "n_deleted")


WORD_TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"


@query("op5_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.read_indexed(tokenfiles.write_indexed(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end=2))


@query(
    "op6_benchmark_decontamination",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_WORDS} AS ws FROM documents),
    i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {SQL_WORDS} AS ws FROM benchmark),
    sized AS (SELECT item_id, ws, least(10, len(ws)) AS size FROM i WHERE len(ws) > 0),
    windows AS (
      SELECT DISTINCT item_id, size, array_to_string(ws[s + 1 : s + size], ' ') AS win
      FROM (SELECT *, unnest(range(0, len(ws) - size + 1)) AS s FROM sized)),
    places AS (
      SELECT rid, s, size, array_to_string(ws[s + 1 : s + size], ' ') AS win
      FROM (SELECT rid, ws, size, unnest(range(0, len(ws) - size + 1)) AS s
            FROM d, (SELECT DISTINCT size FROM windows) WHERE len(ws) >= size)),
    hits AS (SELECT rid, s, p.size AS size, item_id FROM places p JOIN windows w ON p.win = w.win AND p.size = w.size),
    covered AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(s, s + size)) AS place FROM hits) GROUP BY 1),
    found AS (
      SELECT rid, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS names
      FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY 1)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered c ON d.rid = c.rid LEFT JOIN found f ON d.rid = f.rid""",
)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = decontam.match_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return matched.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


@query("op7_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(packing.pack(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, end=0))


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op8_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document without its separator, found in flat files by their separators alone."""
    end = 49407  # the tokenizer's own end-of-text id
    files, written = tokencounts.write_flat(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end)
    counted = tokencounts.count_tokens(files, end)
    part = F.regexp_extract("file", r"([0-9]+)-[0-9a-f]+[.]flat$", 1).cast("int")
    return counted.join(written, ["file", "ordinal"]).select(
        "doc_id", part.alias("file"), "ordinal", "start", "n_tokens"
    )


@query("op9_toxicity")
def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    doc_id = F.col("row.doc_id")
    return toxicity.score_documents(documents, toxicity.train(documents, labels)).select(
        doc_id.alias("doc_id"), toxicity.held_out(doc_id).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "spans",
    )


@query(
    "op10_exact_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
    SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10""",
)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query(
    "op11_conversation_repair",
    r"""
    WITH RECURSIVE
    polynomial AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    filled AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
    hashed AS (
      SELECT f.*, xor(list_reduce([4294967295] || list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)),
             lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1])), 4294967295) % 20 AS kind FROM filled f, polynomial),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
      FROM hashed WHERE kind <> 0),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place FROM damaged),
    flagged AS (
      SELECT *, left(role, 1) AS initial, left(lag(role) OVER c, 1) AS before,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                  WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated'
                  ELSE '' END AS fault
      FROM placed WINDOW c AS (PARTITION BY conv_id ORDER BY place)),
    facts AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
      FROM flagged GROUP BY conv_id),
    steps AS (
      SELECT conv_id, CAST(0 AS BIGINT) AS place, {'c': CAST(0 AS BIGINT), 'a': ''} AS s0, {'c': CAST(999999999 AS BIGINT), 'a': ''} AS s1,
             {'c': CAST(999999999 AS BIGINT), 'a': ''} AS s2, {'c': CAST(999999999 AS BIGINT), 'a': ''} AS s3 FROM facts
      UNION ALL
      SELECT conv_id, place, {'c': s0.c + 4, 'a': s0.a || 'D'},
             list_sort([{'c': s1.c + 4, 'a': s1.a || 'D'}, {'c': s0.c + t + k_s, 'a': s0.a || 'K'}])[1],
             list_sort([{'c': s2.c + 4, 'a': s2.a || 'D'}]
                       || list_transform(to_u, lambda b: {'c': b.c + t + k_u, 'a': b.a || 'K'})
                       || list_transform(to_u, lambda b: {'c': b.c + t + 3, 'a': b.a || 'R'}))[1],
             list_sort([{'c': s3.c + 4, 'a': s3.a || 'D'}]
                       || list_transform(to_a, lambda b: {'c': b.c + t + k_a, 'a': b.a || 'K'})
                       || list_transform(to_a, lambda b: {'c': b.c + t + 3, 'a': b.a || 'R'}))[1]
      FROM (
        SELECT s.conv_id, f.place, s0, s1, s2, s3,
               CASE WHEN fault = '' THEN 0 WHEN fault = 'truncated' THEN 3 ELSE 999999999 END AS t,
               CASE WHEN initial = 's' THEN 0 ELSE 999999999 END AS k_s, CASE WHEN initial = 'u' THEN 0 ELSE 999999999 END AS k_u,
               CASE WHEN initial = 'a' THEN 0 ELSE 999999999 END AS k_a,
               [s0, s1, s3, {'c': s2.c + 3, 'a': s2.a || 'I'}, {'c': s0.c + 6, 'a': s0.a || 'II'}, {'c': s1.c + 6, 'a': s1.a || 'II'},
                {'c': s3.c + 6, 'a': s3.a || 'II'}] AS to_u,
               [s2, {'c': s0.c + 3, 'a': s0.a || 'I'}, {'c': s1.c + 3, 'a': s1.a || 'I'}, {'c': s3.c + 3, 'a': s3.a || 'I'},
                {'c': s2.c + 6, 'a': s2.a || 'II'}] AS to_a
        FROM steps s JOIN flagged f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.place = s.place + 1)),
    best AS (
      SELECT s.conv_id, list_sort([s0, s3, {'c': s2.c + 3, 'a': s2.a || 'I'}, {'c': s1.c + 6, 'a': s1.a || 'II'}])[1] AS b
      FROM steps s JOIN facts f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.place = f.n),
    letters AS (
      SELECT conv_id, unnest(string_split(b.a, '')) AS letter, unnest(range(1, length(b.a) + 1)) AS nth FROM best WHERE b.a <> ''),
    spoken AS (
      SELECT *, 1 + count(*) FILTER (letter <> 'I') OVER earlier AS place, count(*) FILTER (letter <> 'D') OVER earlier AS said
      FROM letters WINDOW earlier AS (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    joined AS (
      SELECT p.*, f.role, f.text, max(CASE WHEN said = 0 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS system
      FROM spoken p LEFT JOIN flagged f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.place = f.place WHERE letter <> 'D'),
    lines AS (
      SELECT conv_id, nth, CASE WHEN letter = 'K' THEN role WHEN (said + system) % 2 = 0 THEN 'user' ELSE 'assistant' END
                           || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END AS line FROM joined),
    digests AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY nth)) AS d FROM lines GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost,
           coalesce(b.a, '') AS audit, coalesce(d, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN facts f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
    LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id
    LEFT JOIN digests g ON c.conv_id IS NOT DISTINCT FROM g.conv_id""",
)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair_report(conversations, repair.decide(repair.damage(conversations), F.col("copies")))


@query("op12_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    doc_id = F.col("row.doc_id")
    return langid.identify(documents, langid.train(documents)).select(
        doc_id.alias("doc_id"), langid.held_out(doc_id).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


@query(
    "op13_ranked_search",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_WORDS} AS ws FROM documents),
    i AS (SELECT row_number() OVER () AS iid, item_id, list_distinct({SQL_WORDS}) AS ws FROM benchmark),
    sizes AS (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n FROM d WHERE len(ws) > 0),
    total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM sizes),
    tfs AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) GROUP BY 1, 2),
    weights AS (
      SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM tfs, total GROUP BY term, nd),
    asked AS (SELECT iid, item_id, unnest(ws) AS term FROM i),
    scored AS (
      SELECT iid, item_id, rid, doc_id,
             CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt)))) AS BIGINT) AS score
      FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (rid), total GROUP BY ALL),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored WHERE score > 0)
    SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 50""",
)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
