"""The registered queries of this subpackage: thin digests over the operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import encoding, token_output
from .ann import nearest
from .common import documents, fresh_path
from .decontam import contaminated
from .language_id import identify_pages
from .licenses import TEMPLATES, scan
from .near_dedup import near_duplicates
from .pii import personal_data
from .suffix_dedup import repeated_passages
from .toxicity import toxicity


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words and five-word shingles of a text in SQL: A-Z lower-cased, words split at space and 0x09-0x0D.
_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_SHINGLES = "unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, least(len(w), 1) + 1)), lambda i: array_to_string(w[i:i + 4], ' '))))"


def op1_suffix_dedup(spark, sf_dir):
    found = repeated_passages(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.stop - x.start)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_language_id(spark, sf_dir):
    return identify_pages(documents(spark, sf_dir, "pages"), documents(spark, sf_dir))


def op3_licenses(spark, sf_dir):
    return scan(documents(spark, sf_dir))


_LICENSE_WORDS = "list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\"''()[]*' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz' || repeat(' ', 18)), ' '), lambda x: x <> '')"
_FIVE = "unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))"
_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_LICENSE_WORDS} AS w FROM documents),
i AS (SELECT license, {_LICENSE_WORDS} AS w FROM (VALUES {_TEMPLATE_ROWS}) t(license, text)),
ds AS (SELECT doc_id, {_FIVE} AS g FROM d WHERE len(w) >= 5), s AS (SELECT license, {_FIVE} AS g FROM i WHERE len(w) >= 5),
n AS (SELECT license, count(*) AS n_template FROM s GROUP BY license)
SELECT doc_id, license, n_template, count(*) AS n_common, count(*) / n_template AS containment
FROM ds JOIN s USING (g) JOIN n USING (license) GROUP BY doc_id, license, n_template HAVING 100 * count(*) >= 80 * n_template
"""


def op4_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


OP4_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, {_SHINGLES} AS g FROM words WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON l.u = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.v, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.v, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT u, min(v) AS v FROM reach GROUP BY u) m ON m.u = d.doc_id
"""


def op5_ann(spark, sf_dir):
    vectors = documents(spark, sf_dir, "embeddings")
    return nearest(vectors.filter("vec_id % 100 = 0"), vectors)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))) AS score
FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op6_pii(spark, sf_dir):
    return personal_data(documents(spark, sf_dir))


def op7_toxicity(spark, sf_dir):
    return toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op8_decontamination(spark, sf_dir):
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT doc_id, {_SHINGLES} AS g FROM d WHERE len(w) > 0), s AS (SELECT item_id, {_SHINGLES} AS g FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_common, count(*) / n_item AS containment
FROM ds JOIN s USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""


def op9_bpe(spark, sf_dir):
    return encoding.round_trip_digests(documents(spark, sf_dir), tokenizer_path())


def op10_token_output(spark, sf_dir):
    docs, folder = documents(spark, sf_dir), fresh_path(spark, "tokens")
    shards = token_output.write_tokens(docs, folder, token_output.Settings(tokenizer_path()))
    return token_output.read_tokens(spark, folder, shards, with_ids=False).drop("ids")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_language_id": op2_language_id,
    "op3_licenses": op3_licenses,
    "op4_near_dedup": op4_near_dedup,
    "op5_ann": op5_ann,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_bpe": op9_bpe,
    "op10_token_output": op10_token_output,
}
ORACLE_SQL = {"op3_licenses": OP3_SQL, "op4_near_dedup": OP4_SQL, "op5_ann": OP5_SQL, "op8_decontamination": OP8_SQL}
