"""The numbered corpus queries on the fixture tables, and the SQL of those that SQL can express."""

import public_tokenizers

import corpus_pipeline
from rentroll.llm import (
    collocations,
    decontaminate,
    exact_dedup,
    html_extract,
    license_scan,
    mixing,
    near_dedup,
    periodic_runs,
    piece_codec,
    pii,
    shared,
    token_files,
    toxicity,
    url_filters,
)


def table(spark, sf_dir, name):
    shared.reachable(spark)
    return shared.table(spark, sf_dir, name)


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op7_url_filters(spark, sf_dir):
    """Verdict of the nested host and path rules for every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters.judge(pages, url_filters.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = """
WITH parts AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages
), ruled AS (
    SELECT *, CASE
        WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/'
        WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
        END AS rule
    FROM parts
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

def op3_exact_dedup(spark, sf_dir):
    """Every document with the copy of its text that stays."""
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
WITH rows AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
), sized AS (
    SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM rows JOIN sized USING (text_sha256)
"""


def op4_license_scan(spark, sf_dir):
    """License phrases and template spans of every document."""
    return license_scan.label(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_files(spark, sf_dir):
    """Boundaries and checksums of every document, read back from the token files."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.round_trip(documents, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op8_near_dedup(spark, sf_dir):
    """Class of near-duplicates of every document, and the one document of each class that stays."""
    found = near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", "kept")


def op10_decontaminate(spark, sf_dir):
    """Benchmark items that documents hold, with how much of each."""
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.find(documents.select("doc_id", "text"), items.select("item_id", "text"))


OP10_SQL = r"""
WITH doc_words AS (
    SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_shingles AS (
    SELECT DISTINCT item_id, least(len(w), 5) AS width,
        unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS shingle
    FROM item_words WHERE len(w) > 0
), widths AS (
    SELECT DISTINCT width FROM item_shingles
), doc_shingles AS (
    SELECT DISTINCT n, doc_id, width,
        unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS shingle
    FROM doc_words, widths WHERE len(w) >= width
), sizes AS (
    SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id
), held AS (
    SELECT n, doc_id, item_id, count(*) AS n_found FROM doc_shingles JOIN item_shingles USING (width, shingle) GROUP BY ALL
), best AS (
    SELECT doc_id, item_id, max(n_found) AS n_found FROM held GROUP BY ALL
)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
FROM best JOIN sizes USING (item_id) WHERE n_found >= 0.8 * n_shingles
"""


def op2_mixing(spark, sf_dir):
    """Raked weight, probability and fate of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    """Toxicity score of every document, learned from the labels that aren't held out."""
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark, sf_dir):
    """Every document with its personal data replaced by surrogates."""
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key="rotate me")


def op1_html_extract(spark, sf_dir):
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_collocations(spark, sf_dir):
    """Collocations of every language."""
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), split AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sized AS (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), counted AS (
    SELECT lang, w[i:i + k - 1] AS p, k, count(*) AS a FROM sized GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT * FROM counted WHERE k > 1 AND a >= 30
), inside AS (
    SELECT lang, p[i:i + m - 1] AS p, max(a) AS longer
    FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM candidates, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL
), cuts AS (
    SELECT c.lang, c.p, c.a, c.k, unnest(range(1, c.k)) AS cut
    FROM candidates c LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(c.a AS HUGEINT) * 80
), scored AS (
    SELECT x.lang, x.p, x.a, x.cut, f.a AS l, r.a AS r, CAST(CAST(x.a AS HUGEINT) * 2000000 // (f.a + r.a) AS BIGINT) AS score
    FROM cuts x JOIN counted f ON f.lang = x.lang AND f.p = x.p[1:x.cut] JOIN counted r ON r.lang = x.lang AND r.p = x.p[x.cut + 1:x.k]
), lowest AS (
    SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM scored
    QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op12_piece_codec(spark, sf_dir):
    """Digests of the pieces of every document and of the text they decode to."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.digests(piece_codec.encode(documents, public_tokenizers.path("piece_bpe_32k.model"), decoded=True))


def op13_periodic_runs(spark, sf_dir):
    """Periodic runs of words in every document, some of them with a repeated tail, and the texts without repetitions."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.find(documents, rewritten=periodic_runs.repeated_tails, keep_text=False)
    return periodic_runs.summary(found)


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_mixing": op2_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_token_files": op5_token_files,
    "op6_pii": op6_pii,
    "op7_url_filters": op7_url_filters,
    "op8_near_dedup": op8_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
    "op11_collocations": op11_collocations,
    "op12_piece_codec": op12_piece_codec,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op3_exact_dedup": OP3_SQL,
    "op7_url_filters": OP7_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_collocations": OP11_SQL,
}
