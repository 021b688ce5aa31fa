"""Queries p1, p3, p4, p6, p7, p8, p9 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from edgewright.llm.cross_split import cross_split_overlaps, graph_overlaps, overlap_report
from edgewright.llm.encode import encode_texts, token_counts
from edgewright.llm.history import batch_duplicates
from edgewright.llm.merkle import collapse_triples, copies
from edgewright.llm.packing import fill_report, pack_documents
from edgewright.llm.subjects import document_subjects, leaf_terms, subject_composition
from edgewright.llm.terms import triple_terms
from edgewright.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_overlaps(table(spark, d, "min_fill_dataset"), table(spark, d, "triples_clean"), table(spark, d, "relations"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(table(spark, d, "min_fill_dataset"), table(spark, d, "triples_clean"), table(spark, d, "relations"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return batch_duplicates(table(spark, d, "min_fill_dataset"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies(table(spark, d, "triples_clean"), table(spark, d, "relations"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return collapse_triples(table(spark, d, "triples_clean"), table(spark, d, "relations"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return triple_terms(table(spark, d, "triples_clean")).filter("mark is not null").select("term", "mark")


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    return triple_terms(table(spark, d, "triples_clean"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), table(spark, d, "containers"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p8_containers(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return document_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects")).select("doc_id", "subject")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return subject_composition(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p9_leaves(spark: SparkSession, d: str) -> DataFrame:
    return leaf_terms(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p6_found": p6_found,
    "p6_terms": p6_terms,
    "p7_ids": p7_ids,
    "p7_counts": p7_counts,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
    "p9_leaves": p9_leaves,
}


def _bare(c: str) -> str:
    return f"regexp_replace({c}, '^(/c/en|/c|/r)/', '')"


def _leaf(c: str) -> str:
    return f"regexp_replace(lower({_bare(c)}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


_READ = f"""known AS (SELECT DISTINCT {_leaf('relation')} AS x FROM relations),
leaves AS (SELECT triple_id, split, source, {_leaf('r')} AS a, {_leaf('h')} AS b, {_leaf('t')} AS c FROM triples_clean
  WHERE r IS NOT NULL AND h IS NOT NULL AND t IS NOT NULL),
placed AS (SELECT *, CASE WHEN a IN (FROM known) THEN 1 WHEN b IN (FROM known) THEN 2 WHEN c IN (FROM known) THEN 3 ELSE 1 END AS k FROM leaves),
reads AS (SELECT triple_id, split, source, CASE k WHEN 1 THEN a WHEN 2 THEN b ELSE c END AS rel,
  CASE k WHEN 1 THEN b ELSE a END AS head, CASE k WHEN 3 THEN b ELSE c END AS tail FROM placed)"""

_TERMS = f"""rows AS (SELECT triple_id, list_concat(list_concat({', '.join(f"coalesce(regexp_extract_all(lower({_bare(c)}), '[\\p{{L}}\\p{{N}}]+'), [])" for c in ('r', 'h'))}),
  coalesce(regexp_extract_all(lower({_bare('t')}), '[\\p{{L}}\\p{{N}}]+'), [])) AS terms FROM triples_clean),
tokens AS (SELECT triple_id, unnest(terms) AS term FROM rows),
counts AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT triple_id) AS n_records FROM tokens GROUP BY term),
marks AS (SELECT *, CASE WHEN n_records > (SELECT count(*) FROM triples_clean) / 20.0 THEN 'common' WHEN n_records < 3 THEN 'rare' END AS mark FROM counts)"""

_PAIRS = """sound AS (SELECT graph_id, split, source, batch_no, list_filter(edges, lambda p: len(p) = 2 AND p[1] IS NOT NULL AND p[2] IS NOT NULL) AS e FROM min_fill_dataset),
lows AS (SELECT *, list_min(flatten(e)) AS low FROM sound),
sets AS (SELECT graph_id, split, source, batch_no, list_distinct(list_transform(list_filter(e, lambda p: p[1] <> p[2]),
  lambda p: CAST(least(p[1], p[2]) - low AS BIGINT) * 4294967296 + (greatest(p[1], p[2]) - low))) AS pairs FROM lows),
graphs AS (SELECT * FROM sets WHERE len(pairs) > 0),
items AS (SELECT graph_id, split, batch_no, len(pairs) AS n, unnest(pairs) AS p FROM graphs)"""

_P1 = f"""{_PAIRS},
graph_pairs AS (SELECT a.graph_id AS x, b.graph_id AS y FROM items a JOIN items b ON a.p = b.p AND a.split = 'train' AND b.split IN ('val', 'test')
  GROUP BY a.graph_id, b.graph_id, a.n, b.n HAVING count(*) * 5 >= greatest(a.n, b.n) * 4),
{_READ},
classes AS (SELECT rel, head, tail, list(triple_id) FILTER (split = 'train') AS trains, list(triple_id) FILTER (split IN ('valid', 'test')) AS helds FROM reads GROUP BY ALL),
met AS (SELECT a.trains, b.helds FROM classes a JOIN classes b ON a.rel = b.rel AND abs(length(a.head) - length(b.head)) + abs(length(a.tail) - length(b.tail)) <= 2
  AND a.trains IS NOT NULL AND b.helds IS NOT NULL AND (a.head = b.head OR a.tail = b.tail OR (levenshtein(a.head, b.head) <= 1 AND levenshtein(a.tail, b.tail) <= 1))
  AND levenshtein(a.head, b.head) + levenshtein(a.tail, b.tail) <= 2),
spread AS (SELECT unnest(trains) AS x, helds FROM met),
triple_pairs AS (SELECT x, unnest(helds) AS y FROM spread),
found_pairs AS (SELECT 'graph' AS kind, least(x, y) AS id_a, greatest(x, y) AS id_b FROM graph_pairs UNION ALL SELECT 'triple', least(x, y), greatest(x, y) FROM triple_pairs)"""

_P3 = f"""{_PAIRS},
near AS (SELECT a.graph_id AS x, b.graph_id AS y, b.batch_no AS y_no FROM items a JOIN items b ON a.p = b.p AND a.batch_no > 0 AND a.graph_id <> b.graph_id
  AND (b.batch_no < a.batch_no OR (b.batch_no = a.batch_no AND b.graph_id < a.graph_id))
  GROUP BY a.graph_id, b.graph_id, b.batch_no, a.n, b.n HAVING count(*) * 5 >= greatest(a.n, b.n) * 4),
queue AS (SELECT row_number() OVER (ORDER BY batch_no, graph_id) AS k, graph_id AS x, coalesce(old, false) AS old, coalesce(earlier, []) AS earlier
  FROM graphs LEFT JOIN (SELECT x, bool_or(y_no = 0) AS old, list(y) AS earlier FROM near GROUP BY x) ON x = graph_id WHERE batch_no > 0),
steps AS (SELECT 0 AS k, CAST([] AS BIGINT[]) AS taken
  UNION ALL SELECT q.k, CASE WHEN q.old OR list_has_any(taken, q.earlier) THEN taken ELSE list_append(taken, q.x) END FROM steps JOIN queue q ON q.k = steps.k + 1),
accepted AS (SELECT graph_id AS y FROM graphs WHERE batch_no = 0 UNION ALL SELECT unnest(taken) FROM steps WHERE k = (SELECT max(k) FROM steps))"""

SQL: dict[str, str] = {
    "p3_found": f"WITH RECURSIVE {_P3} SELECT least(x, y) AS id_a, greatest(x, y) AS id_b FROM near WHERE y IN (FROM accepted) AND x NOT IN (FROM accepted)",
    "p1_report": f"""WITH {_P1}, ends AS (SELECT kind, id_a AS id FROM found_pairs UNION ALL SELECT kind, id_b FROM found_pairs),
counts AS (SELECT kind, id, count(*) AS n FROM ends GROUP BY kind, id),
origin AS (SELECT 'graph' AS kind, graph_id AS id, split, source FROM min_fill_dataset UNION ALL SELECT 'triple', triple_id, split, source FROM triples_clean)
SELECT kind, split, source, CAST(sum(n) AS BIGINT) AS n_pairs, count(*) AS n_records FROM counts JOIN origin USING (kind, id) WHERE split IN ('val', 'valid', 'test') GROUP BY kind, split, source""",
    "p1_found": f"WITH {_P1} SELECT kind, id_a, id_b FROM found_pairs",
    "p4_found": f"""WITH {_READ}, firsts AS (SELECT *, min(triple_id) OVER (PARTITION BY rel, head, tail) AS first_id FROM reads)
SELECT first_id, triple_id AS copy_id FROM firsts WHERE triple_id <> first_id""",
    "p4_records": f"""WITH {_READ} SELECT min(triple_id) AS first_id, rel, head, tail, count(*) AS n_copies FROM reads GROUP BY rel, head, tail""",
    "p6_found": f"WITH {_TERMS} SELECT term, mark FROM marks WHERE mark IS NOT NULL",
    "p6_terms": f"WITH {_TERMS} SELECT term, n_occurrences, n_records, mark FROM marks",
}
