"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.tables import table
from tablewright.llm import (
    chat,
    decontam,
    exact_index,
    langid,
    lexical,
    minhash,
    mixing,
    pieces,
    pii,
    quality,
    resample,
    templates,
    tokens,
)


def op1_quality(spark, d):
    """Hosts are the sources, paths the languages within a source."""
    docs = table(spark, d, "documents")
    return quality.classify(docs, table(spark, d, "labels"), F.col("source"), F.col("lang"))


def op2_exact_dedup(spark, d):
    return exact_index.deduplicate_new(table(spark, d, "documents"))


def op3_pii(spark, d):
    model = pii.train(pii.labelled_table(spark))
    return pii.digest_columns(pii.find(table(spark, d, "documents"), model))


def op4_language(spark, d):
    return langid.held_out_predictions(table(spark, d, "documents"))


def op6_line_templates(spark, d):
    return templates.drop_recurring_lines(table(spark, d, "documents"))


def op5_mixing(spark, d):
    return mixing.Mix(table(spark, d, "documents")).allotments()


def op7_decontamination(spark, d):
    found = decontam.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.selectExpr(
        "doc_id", "n_words", "n_hit", "n_items", "sha2(array_join(items, ','), 256) AS items_sha256", "contaminated"
    )


def op8_minhash(spark, d):
    return minhash.near_duplicates(table(spark, d, "documents"), width=2)


def op9_chat(spark, d):
    return chat.read_back(chat.windows(chat.with_probe(table(spark, d, "conversations"))))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_tokens(spark, d):
    return tokens.token_table(table(spark, d, "documents"), tokenizer_path())


def op11_lexical_search(spark, d):
    return lexical.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_pieces(spark, d):
    return pieces.digests(table(spark, d, "documents"), piece_model_path())


def op13_resampling(spark, d):
    return resample.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pii": op3_pii,
    "op4_language": op4_language,
    "op5_mixing": op5_mixing,
    "op6_line_templates": op6_line_templates,
    "op7_decontamination": op7_decontamination,
    "op8_minhash": op8_minhash,
    "op9_chat": op9_chat,
    "op10_tokens": op10_tokens,
    "op11_lexical_search": op11_lexical_search,
    "op12_pieces": op12_pieces,
    "op13_resampling": op13_resampling,
}

ORACLES = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             h AS (SELECT doc_id, length(text) AS n,
                          sha256(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM t),
             g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op5_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5(coalesce(doc_id::VARCHAR, '') || ':17') AS key FROM documents),
        src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM src),
        weighed AS (SELECT *, [3, 1, 2][((sid - 1) % 3 + 1)::INT] AS w FROM numbered),
        level AS (
            SELECT *, sum(2 * source_size) OVER o - 2 * source_size AS before,
                   sum(w) OVER (ORDER BY (2 * source_size)::DOUBLE / w, sid
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_on,
                   sum(source_size) OVER () AS total
            FROM weighed WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / w, sid ROWS UNBOUNDED PRECEDING)),
        marked AS (SELECT *, (2 * source_size)::DOUBLE * 2 * w_on::DOUBLE <= (3 * total - 2 * before)::DOUBLE * w AS capped
                   FROM level),
        summed AS (SELECT *, 3 * total - 2 * sum(CASE WHEN capped THEN 2 * source_size ELSE 0 END) OVER () AS room,
                          sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS free FROM marked),
        goal AS (SELECT sid, source, source_size, (3 * total) // 2 AS budget,
                        CASE WHEN capped THEN (2 * source_size)::DOUBLE
                             ELSE (room * w)::DOUBLE / (free * 2)::DOUBLE END AS target FROM summed),
        sent AS (SELECT s.*, g.sid, g.source_size, g.target, g.budget,
                        sum(s.size) OVER (PARTITION BY g.sid ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS up_to
                 FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
        turns AS (SELECT s.*, p, (p * source_size + up_to)::DOUBLE / target AS finish
                  FROM sent s, (VALUES (0), (1)) AS passes(p) WHERE size > 0 AND target > 0),
        ran AS (SELECT *, sum(size) OVER (ORDER BY finish, sid, p, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS spent FROM turns),
        got AS (SELECT doc_id, key, source, size, sum(size) AS taken FROM ran WHERE spent <= budget GROUP BY ALL)
        SELECT s.doc_id, s.size, s.source_size, s.target, coalesce(g.taken, 0)::BIGINT AS taken
        FROM sent s LEFT JOIN got g ON s.doc_id = g.doc_id
    """,
    "op7_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        g AS (SELECT DISTINCT item, least(13, len(w)) AS n,
                     unnest([array_to_string(w[i + 1:i + least(13, len(w))], ' ')
                             FOR i IN range(0, len(w) - least(13, len(w)) + 1)]) AS win FROM b WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM g),
        places AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS win
                   FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
        hit AS (SELECT DISTINCT doc_id, n, i, item FROM places JOIN g USING (n, win)),
        words AS (SELECT doc_id, count(DISTINCT j) AS n_hit
                  FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s
                  FROM hit GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op8_minhash": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                     ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS g FROM d),
        c AS (SELECT min(doc_id) AS rep, any_value(g) AS g, len(any_value(g)) AS n
              FROM (SELECT doc_id, list_sort(g) AS g FROM s) WHERE len(g) > 0 GROUP BY g),
        x AS (SELECT rep, n, unnest(g) AS t FROM c),
        links AS (SELECT a.rep AS u, b.rep AS v FROM x a JOIN x b ON a.t = b.t AND a.rep < b.rep
                  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
        reach AS (SELECT rep AS u, rep AS v FROM c
                  UNION SELECT r.u, e.v FROM reach r JOIN both_ways e ON r.v = e.u),
        comp AS (SELECT u AS rep, min(v) AS component_id FROM reach GROUP BY u),
        member AS (SELECT doc_id, len(g) AS n_shingles,
                          CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(g)) END AS rep FROM s)
        SELECT doc_id, n_shingles, coalesce(component_id, doc_id) AS component_id,
               doc_id = coalesce(component_id, doc_id) AS kept
        FROM member LEFT JOIN comp USING (rep)
    """,
    "op9_chat": r"""
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p,
                     len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tok,
                     10 + length(role) + len(regexp_extract_all(role, '[\\<\[|]'))
                        + length(text) + len(regexp_extract_all(text, '[\\<\[|]')) AS chars FROM c),
        f AS (SELECT conv_id, CASE WHEN role = 'system' THEN 1 ELSE 0 END AS first,
                     CASE WHEN role = 'system' THEN tok ELSE 0 END AS fixed FROM t WHERE p = 0),
        s AS (SELECT t.conv_id, p, tok, first, fixed, sum(tok) OVER (PARTITION BY t.conv_id ORDER BY p) AS s,
                     coalesce(lag(tok, 1) OVER (PARTITION BY t.conv_id ORDER BY p), 0) AS b1,
                     coalesce(lag(tok, 2) OVER (PARTITION BY t.conv_id ORDER BY p), 0) AS b2
              FROM t JOIN f ON t.conv_id = f.conv_id),
        h AS (SELECT *, CASE WHEN p - 2 >= first AND b1 + b2 <= 128 THEN p - 2
                             WHEN p - 1 >= first AND b1 <= 128 THEN p - 1 ELSE p END AS hist FROM s),
        w AS (SELECT conv_id, p, 0 AS win, p AS lo, p AS start, s - tok AS base FROM h WHERE p = first
              UNION ALL
              SELECT h.conv_id, h.p,
                     CASE WHEN h.fixed + h.s - w.base <= 512 THEN w.win ELSE w.win + 1 END,
                     CASE WHEN h.fixed + h.s - w.base <= 512 THEN w.lo ELSE h.hist END,
                     CASE WHEN h.fixed + h.s - w.base <= 512 THEN w.start ELSE h.p END,
                     CASE WHEN h.fixed + h.s - w.base <= 512 THEN w.base
                          ELSE h.s - h.tok - CASE WHEN h.hist = h.p - 2 THEN h.b1 + h.b2 WHEN h.hist = h.p - 1 THEN h.b1 ELSE 0 END END
              FROM w JOIN h ON h.conv_id = w.conv_id AND h.p = w.p + 1),
        spans AS (SELECT conv_id, win, min(lo) AS lo, max(p) AS hi FROM w GROUP BY conv_id, win
                  UNION ALL SELECT conv_id, 0, 1, 0 FROM f WHERE first = 1
                            AND conv_id NOT IN (SELECT conv_id FROM t WHERE p = 1)),
        size AS (SELECT x.conv_id, sum(t.chars)::BIGINT AS formatted_chars
                 FROM spans x JOIN f ON f.conv_id = x.conv_id
                 JOIN t ON t.conv_id = x.conv_id AND ((t.p BETWEEN x.lo AND x.hi) OR (f.first = 1 AND t.p = 0))
                 GROUP BY x.conv_id),
        digest AS (SELECT conv_id, count(*) AS n_turns,
                          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
                          coalesce(string_agg(text, '' ORDER BY p) FILTER (role = 'assistant'), '') AS loss
                   FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
        FROM digest JOIN size USING (conv_id)
    """,
    "op11_lexical_search": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
        b AS (SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        asked AS (SELECT item, item_id, unnest(t) AS term FROM b),
        c AS (SELECT count(*)::BIGINT AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
        tf AS (SELECT doc_id, len(t)::BIGINT AS n, term, count(*)::BIGINT AS tf
               FROM (SELECT row_number() OVER () AS r, doc_id, t, unnest(t) AS term FROM d)
               WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, len(t), term),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
              FROM tf, c GROUP BY term),
        s AS (SELECT item, item_id, doc_id,
                     sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score
              FROM asked JOIN tf USING (term) JOIN w USING (term), c GROUP BY item, item_id, doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
    """,
}
