"""The registered queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datelode.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datelode.llm.bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datelode.llm.quality_rules import judge

    return judge(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datelode.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datelode.llm.token_ids import token_ids

    return token_ids(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datelode.llm.passages import WORDS
    from datelode.llm.suffix_dedup import report

    return report(_table(spark, sf_dir, "documents"), by_words=WORDS)


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datelode.llm.url_filter import judge

    return judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


OP6_SQL = """
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(rh, rp, verdict)),
m AS (SELECT page_id, host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS v
    FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m
"""


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datelode.llm.html_crf import extract

    return extract(_table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datelode.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS p
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT rid, k, n, array_to_string(w[k:k + n - 1], ' ') AS p
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
hit AS (SELECT rid, k, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.p = iw.p),
words AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS place FROM hit) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datelode.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datelode.llm.secrets import report

    return report(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datelode.llm.collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, 1 AS m, unnest(w) AS phrase FROM w
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w WHERE len(w) > 2),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 10),
longer AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE m = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE m = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r, (1000000::HUGEINT * cuts.a * cuts.a // (x.a::HUGEINT * y.a))::BIGINT AS score
    FROM cuts JOIN f x ON cuts.lang = x.lang AND first = x.phrase JOIN f y ON cuts.lang = y.lang AND rest = y.phrase),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS lowest FROM s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE lowest = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datelode.llm.spelling import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"))


#: CRC-32 of a list of bytes, bit by bit.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
OP13_SQL = rf"""
WITH r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)),
e AS (SELECT id, run, count(*) AS c FROM r WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT run, c, hex(encode(id || ':' || run)) AS x FROM e),
h AS (SELECT run, c, {_CRC32.format(bytes="list_transform(range(1, length(x), 2), lambda i: 16 * (strpos('0123456789ABCDEF', substr(x, i, 1)) - 1) + strpos('0123456789ABCDEF', substr(x, i + 1, 1)) - 1)")} AS h FROM b),
m AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
star AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS key FROM k),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM k),
near AS (SELECT x.word, y.word AS other, y.n AS other_n FROM star x JOIN star y USING (key) WHERE x.word <> y.word
    UNION ALL SELECT cut.word, v.word, v.n FROM cut JOIN v ON short = v.word
    UNION ALL SELECT v.word, cut.word, cut.n FROM cut JOIN v ON short = v.word),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
    FROM v LEFT JOIN best ON v.word = best.word AND k = 1)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (
    WITH RECURSIVE chain AS (SELECT word AS start, word AS last FROM f UNION ALL SELECT start, form FROM chain JOIN f ON last = f.word WHERE form IS NOT NULL)
    SELECT start, last AS root FROM chain JOIN f ON last = f.word WHERE form IS NULL) ON start = word
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_toxicity, op4_token_ids, op5_suffix_dedup, op6_url_filter, op7_html_extraction, op8_decontamination, op9_simhash, op10_bpe, op11_secrets, op12_collocations, op13_spelling)}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": OP6_SQL, "op8_decontamination": OP8_SQL, "op12_collocations": OP12_SQL, "op13_spelling": OP13_SQL}
