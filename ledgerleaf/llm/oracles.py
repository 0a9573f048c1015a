"""Checking SQL (DuckDB) for the queries of this subpackage."""

SQL = {
    "op2_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM d
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), i AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
        ), l AS (
            SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)
        ), r AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
        ), c AS (
            SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
    """,
    "op3_ball_tree_top_k": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM e q JOIN e c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_content_sort": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        ), g AS (
            SELECT *, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM d WINDOW w AS (PARTITION BY text_sha256)
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op11_phrases": r"""
        WITH d AS (
            SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ), p AS (
            SELECT lang, d, unnest(string_split(regexp_replace(t, '[.,;:!?\x0A-\x0D]', chr(10), 'g'), chr(10))) AS piece FROM d
        ), e AS (
            SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
        ), o AS MATERIALIZED (
            SELECT p, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM e
        ), n AS (
            SELECT lang, count(*) AS n FROM o GROUP BY lang
        ), t AS (
            SELECT lang, x, lead(x, 1) OVER s AS y, lead(x, 2) OVER s AS z FROM o WINDOW s AS (PARTITION BY p ORDER BY i)
        ), g AS MATERIALIZED (
            SELECT lang, 1 AS k, x AS phrase, count(*) AS f FROM t GROUP BY ALL HAVING f >= 10
            UNION ALL SELECT lang, 2, x || ' ' || y, count(*) AS f FROM t WHERE y IS NOT NULL GROUP BY ALL HAVING f >= 10
            UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) AS f FROM t WHERE z IS NOT NULL GROUP BY ALL HAVING f >= 10
        ), c AS (
            SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1
        ), v AS MATERIALIZED (
            SELECT c.*, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest FROM c, (VALUES (1), (2)) AS v(cut) WHERE cut < k
        ), l AS MATERIALIZED (
            SELECT v.*, g.f AS l FROM v JOIN g ON g.lang = v.lang AND g.phrase = v.head
        ), s AS (
            SELECT l.*, g.f AS r, CAST(1000000 * CAST(l.a AS HUGEINT) * l.a // (CAST(l.l AS HUGEINT) * g.f) AS BIGINT) AS score
            FROM l JOIN g ON g.lang = l.lang AND g.phrase = l.rest
        ), b AS (
            SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        ), inside AS (
            SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS around FROM c, (VALUES (1), (2)) AS v(i) WHERE k = 3 GROUP BY ALL
        ), k AS (
            SELECT b.* FROM b LEFT JOIN inside USING (lang, phrase) WHERE around IS NULL OR 100 * around < 50 * a
        ), q AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) WHERE rank <= 2000
    """,
    "op12_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS d, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT CAST(item_id AS VARCHAR) AS item,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i + 9], ' '))) AS s FROM b WHERE len(w) > 0
        ), spans AS (
            SELECT d, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {'i': i, 's': array_to_string(w[i:i + k - 1], ' ')})) AS x
            FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k
        ), hits AS (
            SELECT d, spans.k AS k, x.i AS i, item FROM spans JOIN windows ON windows.k = spans.k AND windows.s = x.s
        ), h AS (
            SELECT d, count(DISTINCT place) AS n_hit FROM (SELECT d, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT d, k, i FROM hits)) GROUP BY d
        ), m AS (
            SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT d, item FROM hits WHERE item IS NOT NULL) GROUP BY d
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (d) LEFT JOIN m USING (d)
    """,
    "op13_spelling_variants": r"""
        WITH RECURSIVE step(i, c) AS (
            SELECT 0, range(256) UNION ALL
            SELECT i + 1, list_transform(c, lambda x: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) FROM step WHERE i < 8
        ), crc AS (
            SELECT c AS t FROM step WHERE i = 8
        ), o AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents
        ), u AS (
            SELECT doc_id, w, count(*) AS n, length(w) AS size, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM o WHERE length(w) >= 7 GROUP BY doc_id, w
        ), h AS (
            SELECT u.*, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT)),
                lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1]), 4294967295), 4294967295) AS h FROM u, crc
        ), r AS (
            SELECT CASE WHEN h % 31 = 0 THEN w[:h % size] || w[h % size + 2:] ELSE w END AS word, n FROM h
        ), words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM r WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
        ), cuts AS (
            SELECT word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: {'i': i, 'a': word[:i - 1], 'b': word[i + 1:]})) AS c FROM words
        ), pairs AS (
            SELECT x.word, y.word AS near, y.n FROM cuts x JOIN cuts y ON x.c = y.c AND x.word <> y.word
            UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON y.word = x.c.a || x.c.b
            UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON y.word = x.c.a || x.c.b
        ), best AS (
            SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM pairs GROUP BY word
        ), f AS (
            SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * words.n THEN near END AS form,
                CASE WHEN near_n >= 10 * words.n THEN near_n END AS form_n
            FROM words LEFT JOIN best USING (word)
        ), walk AS (
            SELECT word, word AS place, form AS next FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.next
        )
        SELECT f.word, form, place AS root, n, n_near, form_n FROM f JOIN walk ON walk.word = f.word AND walk.next IS NULL
    """,
}
