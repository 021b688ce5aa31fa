"""Queries of the general data problems (p2, p5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.operators.bad_rows import failing_lines, loaded_rows, parse_lines
from edgewright.operators.key_chunks import heavy_users, user_totals
from edgewright.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return failing_lines(table(spark, d, "raw_lines"), table(spark, d, "relations"))


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    return loaded_rows(table(spark, d, "raw_lines"), table(spark, d, "relations"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    parsed = parse_lines(table(spark, d, "raw_lines"), table(spark, d, "relations"))
    return parsed.groupBy("file_name", F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count("*").alias("n_lines"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_users(table(spark, d, "higgs_retweet_network"))


def p5_users(spark: SparkSession, d: str) -> DataFrame:
    return user_totals(table(spark, d, "higgs_retweet_network")).drop("n_chunks")


QUERIES: dict[str, Query] = {"p2_found": p2_found, "p2_rows": p2_rows, "p2_counts": p2_counts, "p5_found": p5_found, "p5_users": p5_users}

_SIDES = """SELECT 'u' AS side, u AS node_id, v AS partner, weight FROM higgs_retweet_network
UNION ALL SELECT 'v', v, u, weight FROM higgs_retweet_network"""

# A field, quoted or not; lines that these don't cover have broken quotes.
_QUOTED = '"(?:[^"]|"")*"'
_BLANK_FIELD = f'(?:{_QUOTED}|[^ \\t"]+)'
_TAB_FIELD = f' *(?:{_QUOTED} *|[^\\t"]*)'
_VALUE = "(regexp_matches({0}, '[\\p{{L}}\\p{{N}}]') AND NOT contains({0}, chr(65533)))"


def _number(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '0*[0-9]{{1,10}}') THEN CAST(right('0' || {c}, 11) AS BIGINT) <= 2147483647 ELSE false END"


_P2 = f"""counted AS (SELECT line_id, file_name, file_name = 'train.txt' AS tabs, rtrim(line, chr(13)) AS x,
  CASE file_name WHEN 'facebook_combined.txt' THEN 2 ELSE 3 END AS width FROM raw_lines
  WHERE file_name IN ('higgs-retweet_network.edgelist', 'facebook_combined.txt', 'train.txt') AND NOT regexp_full_match(line, '[ \\t\\r]*') AND NOT starts_with(line, '#')),
quoted AS (SELECT *, CASE WHEN tabs THEN regexp_full_match(x, '{_TAB_FIELD}(?:\\t{_TAB_FIELD})*')
  ELSE regexp_full_match(x, '[ \\t]*(?:{_BLANK_FIELD}(?:[ \\t]+{_BLANK_FIELD})*)?[ \\t]*') END AS sound FROM counted),
cut AS (SELECT *, CASE WHEN NOT sound THEN [] WHEN tabs THEN list_transform(regexp_extract_all(x || chr(9), '({_TAB_FIELD})\\t', 1), lambda f: trim(f, ' '))
  ELSE regexp_extract_all(x, '{_BLANK_FIELD}') END AS raw FROM quoted),
fields AS (SELECT *, list_transform(raw, lambda f: CASE WHEN starts_with(f, '"') THEN replace(f[2:-2], '""', '"') ELSE f END) AS f FROM cut),
named AS (SELECT *, CASE WHEN starts_with(f[1], '/r/') THEN f[1][4:] ELSE f[1] END AS rel FROM fields),
parsed AS (SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN len(f) <> width THEN 'column_count'
  WHEN CASE WHEN tabs THEN NOT (rel IN (SELECT relation FROM relations WHERE relation IS NOT NULL) AND {_VALUE.format('f[2]')} AND {_VALUE.format('f[3]')})
    ELSE NOT ({_number('f[1]')} AND {_number('f[2]')} AND (width = 2 OR {_number('f[3]')})) END THEN 'invalid_value' END AS reason FROM named)"""


def _typed(c: int, name: str, tabs: bool, wide: bool = False) -> str:
    value = ("rel" if c == 1 else f"f[{c}]") if tabs else f"CAST(f[{c}] AS BIGINT)"
    when = ("tabs" if tabs else "NOT tabs") + (" AND width = 3" if wide else "")
    return f"CASE WHEN {when} THEN {value} END AS {name}"


SQL: dict[str, str] = {
    "p2_found": f"WITH {_P2} SELECT line_id, reason FROM parsed WHERE reason IS NOT NULL",
    "p2_rows": f"""WITH {_P2} SELECT line_id, file_name, {_typed(1, 'u', False)}, {_typed(2, 'v', False)}, {_typed(3, 'weight', False, True)},
{_typed(1, 'r', True)}, {_typed(2, 'h', True)}, {_typed(3, 't', True)} FROM parsed WHERE reason IS NULL""",
    "p2_counts": f"WITH {_P2} SELECT file_name, coalesce(reason, 'loaded') AS outcome, count(*) AS n_lines FROM parsed GROUP BY ALL",
    "p5_found": f"""SELECT side, node_id FROM ({_SIDES}) WHERE node_id IS NOT NULL GROUP BY side, node_id
HAVING count(*) * 50 >= (SELECT count(*) FROM higgs_retweet_network)""",
    "p5_users": f"""SELECT side, node_id, count(*) AS n_rows, count(DISTINCT partner) AS n_partners, CAST(sum(weight) AS BIGINT) AS sum_weight
FROM ({_SIDES}) WHERE node_id IS NOT NULL GROUP BY side, node_id""",
}
