"""The query of languages told by profiles, on documents that the profiles haven't seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import language
from ledgerloom.plans.tables import table

FOLDS = 2


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a profile of the documents in the other half."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    halves = [d.where(F.col("doc_id") % FOLDS == i) for i in range(FOLDS)]
    out = [language.detect(halves[i], language.fit(halves[1 - i], "text", "lang"), "doc_id", "text") for i in range(FOLDS)]
    return out[0].unionByName(out[1])


LANGUAGES = r"""
with d as (select doc_id, doc_id % 2 as f, text, lang, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' as flat from documents where text is not null),
g as (select doc_id, f, lang, length(trim(text)) >= 30 as long, unnest(list_concat(list_concat(regexp_extract_all(flat, '...'), regexp_extract_all(flat[2:], '...')), regexp_extract_all(flat[3:], '...'))) as gram from d),
c as (select f, lang, gram, count(*) as n from g where lang is not null group by all),
p as (select f, lang, gram, greatest(ln(n / sum(n) over (partition by f, lang)), -14.0) + 14.0 as gain, row_number() over (partition by f, lang order by n desc, gram) as place from c),
s as (select doc_id, p.lang, sum(gain) as score from g join p on p.f <> g.f and p.gram = g.gram and place <= 3000 where long group by 1, 2),
b as (select doc_id, arg_min(lang, (-round(score, 6), lang)) as language from s group by 1)
select documents.doc_id, coalesce(language, 'unknown') as language from documents left join b on b.doc_id = documents.doc_id"""

QUERIES = {"i21_told_languages": told}
ORACLES = {"i21_told_languages": LANGUAGES}
