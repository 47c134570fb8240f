"""The queries of this package, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import spread
from .embedding_dedup import near_vectors
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .language import identify_language
from .mixing import mix_sources
from .ngram_join import near_texts
from .packing import pack
from .repair import repair_conversations
from .repeats import drop_repeats
from .runs import find_runs, strongest
from .secrets import scan_secrets
from .tables import table
from .unit_dedup import drop_repeated_units
from .warc import archive_pages, page_of, read_archives


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = scan_secrets(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return told.select("doc_id", *map(count, ("assign", "access", "hex", "random")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return identify_language(docs).select("doc_id", "held_out", "lang_pred", "score", "label_share")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = drop_repeated_units(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    spans = F.concat_ws(",", F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    kept_text = F.coalesce("text_kept", F.lit(""))
    return told.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_removed", "n_spans", spans.alias("spans"), F.sha2(kept_text, 256).alias("kept_sha256"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = drop_repeats(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return told.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))).select("page_id", "url", "text", "n_chars")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "class_id", "n_links", "n_shingles")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record that doesn't read back fails the query."""
    records = read_archives(archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")), payloads=False)
    sound = F.when(F.col("error").isNotNull(), F.raise_error("error").cast("boolean")).otherwise(F.col("record_type").isin("response", "revisit"))
    return records.where(sound).select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    h = F.crc32(F.col("doc_id").cast("string"))

    def repeated(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(words, lambda x, i: F.when(i < a, x).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    damaged = F.array_join(F.transform(F.array(words), lambda w: F.array_join(F.when(F.size(w) > 0, repeated(w)), " ")), "")  # one array, so that words are taken once
    told = find_runs(docs.withColumn("text", F.when(h % 10 == 0, damaged).otherwise(F.col("text"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    best = told.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    kind = F.crc32(key) % 20
    damaged = told.withColumns(
        {
            "role": F.when(kind == 4, "user").otherwise(F.col("role")),
            "text": F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "times": F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1),
        }
    )
    return repair_conversations(damaged, times_col="times").drop("n_rows", "n_repaired")


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_language_id": op2_language_id,
    "op3_mix_sources": op3_mix_sources,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_pack": op5_pack,
    "op6_unit_dedup": op6_unit_dedup,
    "op7_repeats": op7_repeats,
    "op8_html_text": op8_html_text,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_warc": op11_warc,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {
    "op3_mix_sources": r"""
        WITH RECURSIVE sized AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) AS place,
                   CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS second
            FROM documents
        ), sums AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
            FROM sized GROUP BY source
        ), dealt AS (  -- one round after another: sources above their cap stay at it, the rest share what is left
            SELECT 0 AS round, source, source_size, weight, FALSE AS capped,
                   sum(source_size) OVER () * 1.5 / sum(weight) OVER () AS level
            FROM sums
            UNION ALL
            SELECT round + 1, source, source_size, weight, capped OR level * weight > 2.0 * source_size,
                   (sum(source_size) OVER () * 1.5 - sum(CASE WHEN capped OR level * weight > 2.0 * source_size THEN 2.0 * source_size ELSE 0 END) OVER ())
                   / nullif(sum(CASE WHEN capped OR level * weight > 2.0 * source_size THEN 0 ELSE weight END) OVER (), 0)
            FROM dealt WHERE round < (SELECT count(*) FROM sums)
        ), targets AS (
            SELECT source, source_size, CASE WHEN capped OR level IS NULL THEN 2.0 * source_size ELSE level * weight END AS target
            FROM dealt WHERE round = (SELECT count(*) FROM sums)
        ), edges AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS repeats FROM targets
        ), running AS (  -- of rows that share both places, which are alike, any order gives the same
            SELECT s.doc_id, s.size, e.source_size, e.target, e.repeats, e.target - e.repeats * e.source_size AS budget,
                   sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.second ROWS UNBOUNDED PRECEDING) AS upto
            FROM edges e JOIN sized s ON e.source IS NOT DISTINCT FROM s.source
        )
        SELECT doc_id, size, source_size, target,
               CAST(size * (repeats + CASE WHEN upto <= budget OR (upto - size <= budget AND (budget - upto + size) * 2 >= size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM running
    """,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_unit_dedup": r"""
        WITH pieces AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n.!?]*[\n.!?]+|[^\n.!?]+') AS p FROM documents
        ), cut AS (
            SELECT doc_id, unnest(p) AS unit, unnest(range(1, len(p) + 1)) AS k FROM pieces
        ), placed AS (
            SELECT *, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY k) AS "end",
                   lower(trim(regexp_replace(unit, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
            FROM cut
        ), units AS (  -- those that aren't blank, in order; again: an equal one comes earlier
            SELECT doc_id, norm, k, "end" - length(unit) AS start, "end", row_number() OVER (PARTITION BY norm ORDER BY doc_id, k) > 1 AS again,
                   greatest(len(norm) - len(replace(norm, ' ', '')) + 1, len(regexp_extract_all(norm,
                       '[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]')) // 2) AS words
            FROM placed WHERE norm <> ''
        ), islands AS (
            SELECT *, count(*) FILTER (NOT again) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM units
        ), runs AS (
            SELECT doc_id, min(start) AS start, max("end") AS "end" FROM islands WHERE again GROUP BY doc_id, island HAVING sum(words) >= 20
        ), per_doc AS (
            SELECT doc_id, sum("end" - start) AS n_removed, count(*) AS n_spans, string_agg(start || ':' || "end", ',' ORDER BY start) AS spans FROM runs GROUP BY doc_id
        ), left_over AS (
            SELECT p.doc_id, string_agg(p.unit, '' ORDER BY p.k) AS kept FROM placed p
            LEFT JOIN runs r ON p.doc_id = r.doc_id AND p."end" - length(p.unit) >= r.start AND p."end" <= r."end" WHERE r.doc_id IS NULL GROUP BY p.doc_id
        )
        SELECT p.doc_id, CAST(length(p.text) AS BIGINT) AS n_chars, CAST(coalesce(d.n_removed, 0) AS BIGINT) AS n_removed,
               CAST(coalesce(d.n_spans, 0) AS BIGINT) AS n_spans, coalesce(d.spans, '') AS spans, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM pieces p LEFT JOIN per_doc d ON p.doc_id = d.doc_id LEFT JOIN left_over k ON p.doc_id = k.doc_id
    """,
    "op9_embedding_dedup": """
        WITH RECURSIVE good AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION
            SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(c.n, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
        FROM embeddings e JOIN roots r ON e.vec_id = r.a LEFT JOIN counts c ON e.vec_id = c.a
    """,
    "op11_warc": """
        WITH told AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                   row_number() OVER w > 1 AND strlen(coalesce(html, '')) >= 100 AS again, min(page_id) OVER w AS first
            FROM pages WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST)
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM told
    """,
    "op13_conversation_repair": r"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
        ), hashed AS (  -- the CRC by its bits
            SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(k) + 1), lambda i: CAST(unicode(k[i]) AS BIGINT))),
                lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS d FROM keyed
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
                   CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed
        ), ordered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS r, substr(role, 1, 1) AS initial,
                   right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM damaged
        ), faulted AS (
            SELECT *, CASE WHEN last = '' THEN 'blank' WHEN r > min(r) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault,
                   lag(initial) OVER (PARTITION BY conv_id ORDER BY r) || initial AS pair FROM ordered
        ), facts AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulted GROUP BY conv_id
        ), inserts(q, letters, q1, price, added) AS (
            VALUES ('0', '', '0', 0, []), ('s', '', 's', 0, []), ('u', '', 'u', 0, []), ('a', '', 'a', 0, []),
                   ('0', 'I', 'u', 3, ['user:']), ('s', 'I', 'u', 3, ['user:']), ('u', 'I', 'a', 3, ['assistant:']), ('a', 'I', 'u', 3, ['user:']),
                   ('0', 'II', 'a', 6, ['user:', 'assistant:']), ('s', 'II', 'a', 6, ['user:', 'assistant:']), ('u', 'II', 'u', 6, ['assistant:', 'user:']), ('a', 'II', 'a', 6, ['user:', 'assistant:'])
        ), ways(q, letter, q2, price, initial) AS (  -- initial: of the row that is kept
            VALUES ('0', 'D', '0', 4, NULL), ('s', 'D', 's', 4, NULL), ('u', 'D', 'u', 4, NULL), ('a', 'D', 'a', 4, NULL),
                   ('0', 'K', 's', 0, 's'), ('0', 'K', 'u', 0, 'u'), ('s', 'K', 'u', 0, 'u'), ('u', 'K', 'a', 0, 'a'), ('a', 'K', 'u', 0, 'u'),
                   ('0', 'R', 'u', 3, NULL), ('s', 'R', 'u', 3, NULL), ('u', 'R', 'a', 3, NULL), ('a', 'R', 'u', 3, NULL)
        ), steps AS (
            SELECT i.q, i.letters || w.letter AS letters, w.letter, w.q2, i.price + w.price AS price, i.added, w.initial FROM inserts i JOIN ways w ON w.q = i.q1
        ), best AS (  -- of each state after each row the cheapest edits, and the first of those by their letters
            SELECT conv_id, CAST(0 AS BIGINT) AS r, '0' AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, r, q, cost, audit, lines FROM (
                SELECT b.conv_id, b.r + 1 AS r, s.q2 AS q, b.cost + s.price + CASE WHEN s.letter <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END AS cost, b.audit || s.letters AS audit,
                       b.lines || CAST(s.added AS VARCHAR[]) || CASE s.letter WHEN 'K' THEN [f.role || ':' || f.text] WHEN 'R' THEN [CASE s.q2 WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text] ELSE CAST([] AS VARCHAR[]) END AS lines,
                       row_number() OVER (PARTITION BY b.conv_id, s.q2 ORDER BY b.cost + s.price + CASE WHEN s.letter <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END, b.audit || s.letters) AS k
                FROM best b JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.r = b.r + 1
                JOIN steps s ON s.q = b.q AND (s.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (s.initial IS NULL OR s.initial = f.initial)
            ) WHERE k = 1
        ), ended AS (
            SELECT b.conv_id, b.cost + i.price AS cost, b.audit || i.letters AS audit, b.lines || CAST(i.added AS VARCHAR[]) AS lines,
                   row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + i.price, b.audit || i.letters) AS k
            FROM best b LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id JOIN inserts i ON i.q = b.q AND i.q1 IN ('0', 'a') WHERE b.r = coalesce(f.n, 0)
        )
        SELECT e.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
               e.cost, e.audit, sha256(array_to_string(e.lines, chr(10))) AS repaired_sha256
        FROM ended e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.k = 1
    """,
}
