"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from luminal.llm.common import table


def op1_url_filters(spark, sf_dir):
    """Every url of pages by the rules and the template tree. A null url has an empty host and path."""
    from pyspark.sql import functions as F

    from luminal.llm.urls import UrlRule, judge

    rules = [UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/")]
    return judge(table(spark, sf_dir, "pages"), rules).withColumn("purity", F.round("purity", 9))


def op3_exact_dedup(spark, sf_dir):
    """Every document with the one that stays of its equals."""
    from luminal.llm.exact import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe(spark, sf_dir):
    """Every document encoded whole and decoded again."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from luminal.llm.bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_simhash(spark, sf_dir):
    """Every document with its fingerprint and component."""
    from luminal.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4, lanes=1, most=4)


def op5_suffix_dedup(spark, sf_dir):
    """Every document without what starts earlier elsewhere."""
    from pyspark.sql import functions as F

    from luminal.llm.suffix import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_counts(spark, sf_dir):
    """Every document with its count of tokens."""
    import public_tokenizers

    from luminal.llm.counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_fingerprints(spark, sf_dir):
    """Every document and its edited text, fingerprinted."""
    from luminal.llm.minhash import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    """Every document with the words that the mix takes of it."""
    from luminal.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op8_quality(spark, sf_dir):
    """Every document with its score, learned outside the held-out third."""
    from luminal.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii(spark, sf_dir):
    """Pseudonyms under the key in luminal.pii.key; where it is unset, under a key of this run alone."""
    import secrets

    from luminal.llm.pii import pseudonymise

    key = spark.conf.get("luminal.pii.key", None) or secrets.token_hex(32)
    return pseudonymise(table(spark, sf_dir, "documents"), key)


def op11_phrases(spark, sf_dir):
    """The best 2,000 phrases of each language, over all documents."""
    from luminal.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_periods(spark, sf_dir):
    """Every document, one in ten with a stretch of its words repeated to the end, with its periodic runs."""
    from pyspark.sql import functions as F

    from luminal.llm.periods import digests, periodic_runs, planted

    return digests(periodic_runs(table(spark, sf_dir, "documents"), planted(F.col("text"), F.col("doc_id"))))


def op13_html(spark, sf_dir):
    """The main text of every page."""
    from luminal.llm.html import main_texts

    return main_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def pipeline(spark, sf_dir):
    """The five stages of corpus_pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_bpe, op3_exact_dedup, op4_simhash, op5_suffix_dedup, op6_mixing, op7_token_counts, op8_quality, op9_pii, op10_fingerprints, op11_phrases, op12_periods, op13_html, pipeline)}

#: A level of the template tree of op1: segment k of the rows of l<k-1>, and what becomes of it. SQL has eight levels.
_LEVEL = """
    s{k} AS (SELECT *, coalesce(segs[{k}], chr(1)) AS seg, segs[{k} + 1] AS below FROM l{j}),
    b{k} AS (SELECT host, node, seg, sum(n) AS n, sum(bad) AS bad, sum(CASE WHEN below IS NULL THEN n ELSE 0 END) AS last, sum(CASE WHEN contains(below, '#') THEN n ELSE 0 END) AS numbered FROM s{k} GROUP BY ALL),
    w{k} AS (SELECT *, count(*) OVER p AS kinds, sum(n) OVER p AS an, sum(bad) OVER p AS ab, sum(last) OVER p AS al, sum(numbered) OVER p AS ad FROM b{k} WINDOW p AS (PARTITION BY host, node)),
    c{k} AS (SELECT *, CASE WHEN n * al / an > 0 THEN pow(last - n * al / an, 2) / (n * al / an) ELSE 0 END + CASE WHEN n * ad / an > 0 THEN pow(numbered - n * ad / an, 2) / (n * ad / an) ELSE 0 END
        + CASE WHEN n * (an - al - ad) / an > 0 THEN pow(n - last - numbered - n * (an - al - ad) / an, 2) / (n * (an - al - ad) / an) ELSE 0 END AS chi2, sqrt(ab / an * (1 - ab / an) * (1 / n + 1 / an)) AS spread FROM w{k}),
    t{k} AS (SELECT host, node, seg, CASE WHEN seg = chr(1) THEN '' WHEN seg = '' THEN '/' WHEN contains(seg, '#') OR seg = '**' OR kinds >= 20 AND n * 20 < an
        OR kinds > 1 AND chi2 < 5.99 AND CASE WHEN spread > 0 THEN abs(bad / n - ab / an) / spread ELSE 0 END < 1.96 THEN '/*' ELSE '/' || seg END AS token FROM c{k}),
    l{k} AS (SELECT s.host, s.shape, s.segs, s.node || token AS node, s.n, s.seen, s.bad FROM s{k} s JOIN t{k} t ON s.host = t.host AND s.node = t.node AND s.seg = t.seg),"""

ORACLE_SQL = {
    "op1_url_filters": r"""
    WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    u AS (SELECT *, CASE WHEN ('.' || host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/' WHEN ('.' || host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN ('.' || host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/' WHEN ('.' || host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p),
    v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said, regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM u),
    g AS (SELECT host, shape, count(*) AS n, count(said) AS seen, count(*) FILTER (WHERE said = 'block') AS bad, string_split(shape, '/')[2:] AS parts FROM v GROUP BY host, shape),
    l0 AS (SELECT host, shape, parts AS segs, '' AS node, n::DOUBLE AS n, seen::DOUBLE AS seen, bad::DOUBLE AS bad FROM g),"""
    + "".join(_LEVEL.format(k=k, j=k - 1) for k in range(1, 9))
    + """
    q AS (SELECT CASE WHEN sum(seen) > 0 THEN sum(bad) / sum(seen) ELSE 0.0 END AS prior FROM l0),
    f AS (SELECT host, node, (sum(bad) + any_value(prior) * (4 + (sum(n) - sum(seen)) / 2)) / (sum(seen) + 4 + (sum(n) - sum(seen)) / 2) AS purity FROM l8, q GROUP BY host, node)
    SELECT v.page_id, v.host, v.path, v.rule, coalesce(v.said, CASE WHEN f.purity >= 0.9 THEN 'block' ELSE 'allow' END) AS verdict, v.host || l8.node AS template, round(f.purity, 9) AS purity
    FROM v JOIN l8 ON v.host = l8.host AND v.shape = l8.shape JOIN f ON l8.host = f.host AND l8.node = f.node""",
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op6_mixing": r"""
    WITH d AS (SELECT doc_id AS id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS mark, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
    b AS (SELECT *, 8 * (length(bin(size + 1)) - 1) + floor((size + 1) * 8 / pow(2.0, length(bin(size + 1)) - 1))::BIGINT - 8 AS band FROM d),
    c AS (SELECT *, count(*) OVER (PARTITION BY skey, band) AS k FROM b),
    s AS (SELECT *, ('0x' || substr(md5(mark), 1, 8))::BIGINT % (1 + k // 500) AS salt FROM c),
    cells AS (SELECT skey, band, salt, count(*) AS n, sum(size) AS cell_size FROM s GROUP BY ALL),
    offs AS (SELECT skey, band, salt, sum(n) OVER (PARTITION BY skey ORDER BY band, salt) - n AS base FROM cells),
    src AS (SELECT skey, sum(cell_size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1]::DOUBLE AS w FROM cells GROUP BY skey),
    r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio FROM src),
    l AS (SELECT *, ((SELECT sum(source_size) FROM src)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY ratio, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM r),
    lv AS (SELECT arg_min(lam, (ratio, skey)) FILTER (WHERE lam <= ratio) AS level FROM l),
    t AS (SELECT skey, source_size, CASE WHEN level IS NULL OR ratio <= level THEN cap ELSE level * w END AS target, ('0x' || substr(md5('0/' || skey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l, lv),
    p AS (SELECT s.id, s.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate, base + row_number() OVER (PARTITION BY s.skey, s.band, s.salt ORDER BY s.size, s.id NULLS FIRST) AS i
        FROM s JOIN offs o ON s.skey = o.skey AND s.band = o.band AND s.salt = o.salt JOIN t ON s.skey = t.skey),
    q AS (SELECT *, (floor(i::BIGINT * rate + u) - floor((i::BIGINT - 1) * rate + u))::BIGINT AS copies FROM p)
    SELECT id AS doc_id, size, source_size, target, copies * size AS taken, copies FROM q""",
    "op11_phrases": r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
    g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS t(k) WHERE len(ws) >= k),
    c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
    a AS (SELECT *, string_split(phrase, ' ') AS ws FROM c WHERE k > 1 AND f >= 10),
    cuts AS (SELECT a.*, j, array_to_string(ws[1:j], ' ') AS p1, array_to_string(ws[j + 1:k], ' ') AS p2 FROM a, (VALUES (1), (2)) AS t(j) WHERE j < k),
    s AS (SELECT x.lang, x.phrase, x.k, x.f AS a, j, l.f AS l, r.f AS r, (1000000::HUGEINT * x.f * x.f // (l.f::HUGEINT * r.f))::BIGINT AS score
        FROM cuts x JOIN c l ON l.lang = x.lang AND l.phrase = p1 JOIN c r ON r.lang = x.lang AND r.phrase = p2),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    i AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, f FROM a WHERE k = 3),
    o AS (SELECT lang, phrase, max(f) AS longest FROM i GROUP BY ALL),
    q AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.longest IS NULL OR 100 * o.longest < 50 * b.a)
    SELECT q.lang, row_number() OVER (PARTITION BY q.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM q JOIN n ON n.lang = q.lang QUALIFY rank <= 2000""",
    "op12_periods": r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ow FROM documents),
    h AS (SELECT *, len(ow) AS n, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))) AS h FROM d),
    g AS (SELECT *, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM h),
    w AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ow[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE ow END AS ws FROM g),
    e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i, len(ws) AS n FROM w),
    m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    t AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM m),
    s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM t GROUP BY doc_id, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)),
    r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
    o AS (SELECT doc_id, count(*) AS n_runs, arg_min((start, length, period), (-length, start, period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
    k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = e.doc_id AND e.i >= r.start + r.period AND e.i < r.start + r.length) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli,
        sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
    FROM d LEFT JOIN o USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
